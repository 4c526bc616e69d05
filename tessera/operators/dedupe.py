"""Duplicate documents: which of each group stays, and what goes with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import writes


def plan(docs: DataFrame, default_corpus: str) -> DataFrame:
    """(digest, doc_id, canonical_id, keeps) of every document whose digest another one has too.

    docs: doc_id, digest, corpus, status, chunk_count, version_count, updated_at. The canonical one is in the default corpus,
    indexed, has most chunks, then versions, is the latest by its time as text, then the one of the greatest id, in this order;
    nulls come last. Groups are added up where their rows are; rows without a digest are in no group.
    """
    rank = F.struct(
        (F.coalesce(F.col("corpus") == default_corpus, F.lit(False))).alias("own"), F.coalesce(F.col("status") == "indexed", F.lit(False)).alias("indexed"), F.coalesce("chunk_count", F.lit(0)).alias("chunks"),
        F.coalesce("version_count", F.lit(0)).alias("versions"), F.coalesce(F.col("updated_at").cast("string"), F.lit("")).alias("updated"), F.col("doc_id").alias("id"),
    )
    named = docs.where(F.col("digest").isNotNull())
    groups = named.groupBy("digest").agg(F.count("*").alias("n"), F.max(rank)["id"].alias("canonical_id")).where("n > 1").drop("n")
    return named.select("digest", "doc_id").join(groups, "digest").select("digest", "doc_id", "canonical_id", (F.col("doc_id") == F.col("canonical_id")).alias("keeps"))


def applied(rows: DataFrame, planned: DataFrame, doc: str = "doc_id") -> DataFrame:
    """rows of any table without those of documents that the plan lets go; doing it twice changes nothing."""
    return writes.deleted(rows, planned.where("not keeps"), {doc: "doc_id"})
