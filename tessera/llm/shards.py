"""Sharding by jump consistent hashing of stable keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import gapless_rank, mix64, text_or_empty, written


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of every 64-bit key: no table, and one more shard takes keys only into itself."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    out = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        out[live] = at[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        at[live] = ((out[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[at[live] < shards]
    return out


#: The state that null keys start from.
_NULL = np.uint64(0x5BF03635D1F4BB21)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of an integer key column. A null key has a place of its own.

    The step on executors sees whole numbers without nulls, so that 64-bit keys keep all their bits.
    """

    @F.pandas_udf("int")
    def place(k: pd.Series, null: pd.Series) -> pd.Series:
        ids = k.to_numpy(np.int64).view(np.uint64)
        return pd.Series(jump_hash(np.where(null.to_numpy(bool), _NULL, mix64(ids + np.uint64(1))), shards).astype(np.int32))

    return place(F.coalesce(key, F.lit(0)).cast("long"), key.isNull())


def shard(docs: DataFrame, key: str = "doc_id", shards: int = 8, text: str = "text", per_bucket: int = 4_000) -> DataFrame:
    """Deals every row to a shard: (key, size, text_crc32, law, shard, slot, grown_shard).

    The key (whole numbers of up to 64 bits, or anything else by its hash) and the number of shards alone decide, whatever
    other rows there are; grown_shard is the place with one shard more. size is the text's UTF-8 bytes plus 1; a null text
    counts as empty; a null key goes where all null keys go. Rows with the same key share a shard but have slots of their
    own. slot runs from 0 without gaps in a shard. An empty table gives an empty table; other columns are not looked at.
    """
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    body = docs.select((F.col(key).cast("long") if whole else F.col(key)).alias(key), text_or_empty(text).alias("_text"))
    stable = F.col(key) if whole else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    size = (F.octet_length("_text").cast("long") + 1).alias("size")
    narrow = body.select(key, stable.alias("_stable"), size, F.crc32(F.col("_text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    dealt = narrow.withColumn("shard", shard_of(F.col("_stable"), shards)).withColumn("grown_shard", shard_of(F.col("_stable"), shards + 1))
    placed = written(dealt.drop("_stable"), "shards")
    ranked = gapless_rank(placed, ["shard"], [key, "text_crc32", "size"], "slot", placed.count(), per_bucket)
    return ranked.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
