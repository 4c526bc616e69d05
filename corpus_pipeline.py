"""A training corpus from raw documents: five stages, each a table for the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, langid, packing, secrets
from tessera.llm._common import load, text_or_empty, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language can be told; lang becomes the language told. Null texts and texts without a letter go."""
    rows = docs.select(*COLUMNS)
    model = langid.learn(rows.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(rows, model)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _named(columns: list[str]) -> tuple[Column, Column]:
    """128 bits, as two numbers, that name the values of columns; nulls count as values."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays, whatever their doc_ids: the one with the smallest doc_id, null ids last, and of several with that the one with the smallest name. Of rows equal in all columns one stays."""
    a, b = _named(COLUMNS)
    rows = docs.select(*COLUMNS, a.alias("_a"), b.alias("_b"))
    # the smallest key of a component is a row of it, not only a doc_id
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b").alias("_row"), "text")
    groups = jaccard.jaccard_components(keyed, key="_row")
    kept = groups.where("_row = component_id").select("_row._a", "_row._b").distinct()
    return rows.join(kept.hint("shuffle_hash"), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, clean ones stay as they are. Texts decide: rows with one doc_id may fare differently."""
    a, b = _named(["text"])
    rows = docs.select(*COLUMNS, a.alias("_a"), b.alias("_b"))
    found = decontam.decontaminate(rows.select(F.struct("_a", "_b").alias("_text"), "text"), load(spark, sf_dir, "benchmark"), key="_text")
    dirty = found.where("contaminated").select("_text._a", "_text._b").distinct()
    return rows.join(dirty.hint("shuffle_hash"), ["_a", "_b"], "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mask, and n_chars follows; no document goes."""
    found, _ = secrets.scan(docs)
    # spans belong to a text, which its sha names
    hits = found.where(F.size("spans") > 0).select("sha", "spans").dropDuplicates(["sha"])
    rows = docs.select(*COLUMNS, F.sha2(text_or_empty(), 256).alias("sha")).join(hits.hint("shuffle_hash"), "sha", "left")
    text = F.when(F.col("spans").isNotNull(), secrets.redacted(text_or_empty(), F.col("spans"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]
#: A learned model and a tokenizer stand between the rows and SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written before the next one reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
