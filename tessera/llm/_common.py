"""Shared helpers: written tables, distributed ranks, components and byte-level text views."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.interim import discard, shared_folder, written  # noqa: F401  (operators take them from here)

#: Text bytes that a Python step looks at together; whole texts only, so one long text may exceed it. A step needs up to
#: fifty times its slice, so a worker's memory follows the longest text.
SLICE_BYTES = 256_000
#: Bits of a filter of names that goes to executors: its size is fixed, what passes wrongly drops out later.
FILTER_BITS = 1 << 23


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_filter(names: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of so many bits over a column of 64-bit names; executors add bits up, and at most bits / 64 rows reach the driver."""
    slots = names.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("slot"))
    found = slots.groupBy(F.expr("cast(shiftright(slot, 6) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which 64-bit names the filter may hold."""
    slots = (names.view(np.int64) & (8 * len(bits) - 1)).astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


_RESIDENT: dict[str, object] = {}


def resident(name: str = "", make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps between tasks: one thing at a time, so that a step begins without the memory of another one.

    Without make nothing is kept.
    """
    if name not in _RESIDENT or make is None:
        _RESIDENT.clear()
        _POWERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        if make is not None:
            _RESIDENT[name] = make()
    return _RESIDENT.get(name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int, per_bucket: int = 4_000) -> DataFrame:
    """Adds a rank from 0 without gaps within keys, without gathering a key's rows in one task.

    Rows go to hash buckets of about per_bucket rows; a row's rank is its place in the bucket plus the sizes of the key's
    buckets before it. rows: the row count of df. Rows equal in every order column are interchangeable.
    """
    buckets = max(1, math.ceil(rows / per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    return ranked.join(base, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.col("_place")).drop("_bucket", "_base", "_place")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b, same type): (node, component), component the smallest node.

    Alternating large and small stars: every round is two aggregations over the remaining edges, each round a written table. Rounds
    grow with the logarithm of the longest path, and the last one changes nothing.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        done, edges = edges, written(small, "edges")
        discard(done)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of whole rows with about limit bytes of text, so that arrays made from them stay small."""
    at, n = 0, batch.num_rows
    texts = batch.column(batch.schema.get_field_index(column))
    if n == 0:
        return
    ends = np.cumsum(np.diff(offsets_of(texts)))
    while at < n:
        reach = (ends[at - 1] if at else 0) + limit
        to = max(at + 1, int(np.searchsorted(ends, reach, side="right")))
        yield batch.slice(at, to - at)
        at = to


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a string array's values, n + 1 of them, within bytes_of(texts)'s buffer."""
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32) if texts.buffers()[1] is not None else np.zeros(1, np.int64)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all values one after another, n + 1 offsets from 0); null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    off = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, n of them at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


def words_of(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with is_word[byte], never across texts: (start, end, text number) of each run."""
    inside = is_word[raw]
    edge = np.empty(len(raw) + 1, np.int8)
    edge[0] = 0
    edge[-1] = 0
    if len(raw):
        edge[0] = inside[0]
        edge[1:-1] = inside[1:].view(np.int8) - inside[:-1].view(np.int8)
        edge[-1] = -inside[-1].view(np.int8)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    if len(cuts):
        cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run's bytes, the same wherever the run stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=total[1:])
    body = (total[ends] - total[starts]) * up[starts]
    return mix64(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def class_table(separators: bytes | None = None, words: bytes | None = None) -> np.ndarray:
    """256 flags: which bytes belong to words."""
    out = np.ones(256, bool) if words is None else np.zeros(256, bool)
    for c in separators or b"":
        out[c] = False
    for c in words or b"":
        out[c] = True
    return out


LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
