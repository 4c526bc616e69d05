"""What answers rest on: evidence, verdicts on it, and whether an answer is supported; models' outputs come in as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

OWN_CONTENT = ["atomic_text", "table_record", "spec_record", "datasheet_record", "procedure_record", "warning_record"]
VERDICTS = ["relevant", "potentially_relevant", "not_relevant"]


def evidence() -> Column:
    """A hit's own content if it stands for itself, else its section's window, if it has one."""
    window = F.nullif(F.trim(F.coalesce("context_window", F.lit(""))), F.lit(""))
    return F.when(F.col("chunk_type").isin(OWN_CONTENT), F.trim("content")).otherwise(F.coalesce(window, F.trim("content")))


def model_conflict(query: Column) -> Column:
    """Whether a table hit names models, but none of those of the question, nor of its series where it asks for one."""
    asked = T.models(query)
    series = F.when(F.lower(query).rlike(r"\b(series|family)\b"), F.array_compact(F.transform(asked, T.series_of))).otherwise(F.array().cast("array<string>"))
    own = T.models(F.concat_ws(" ", "content", "identifier_tokens"))
    fits = F.exists(own, lambda m: F.array_contains(asked, m) | F.exists(series, lambda s: m.startswith(s)))
    return (F.col("chunk_type") == "table_record") & (F.size(asked) > 0) & (F.size(own) > 0) & ~fits


def relevance(hits: DataFrame) -> DataFrame:
    """hits (query, chunk_type, content, context_window, identifier_tokens) with a verdict by shared terms: relevant from half of
    the question's terms on, one at least."""
    terms = T.answer_terms(F.col("query"))
    shared = F.size(F.array_intersect(terms, T.answer_terms(evidence())))
    found = F.when(model_conflict(F.col("query")), "not_relevant").when(shared >= F.greatest(F.lit(1), F.floor(F.size(terms) / 2)), "relevant").when(shared > 0, "potentially_relevant").otherwise("not_relevant")
    return hits.withColumn("verdict", found)


def merged_verdicts(hits: DataFrame, judged: DataFrame, order_by: str = "place") -> DataFrame:
    """hits with a verdict of their own, and those of a model (query_id, chunk_id, verdict) in its place where it gave a known one; source says which.

    Of several verdicts on a hit the first in the order of order_by counts, if there is such a column, then by the verdict's name.
    """
    order = Window.partitionBy("query_id", "chunk_id").orderBy(*([order_by] if order_by in judged.columns else []), "verdict")
    clean = judged.where("chunk_id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "chunk_id", F.lower(F.trim("verdict")).alias("_given"))
    both = hits.join(clean, ["query_id", "chunk_id"], "left")
    known = F.coalesce(F.col("_given").isin(VERDICTS), F.lit(False)) & ~model_conflict(F.col("query"))
    return both.withColumn("source", F.when(known, "model").otherwise("terms")).withColumn("verdict", F.when(known, F.col("_given")).otherwise(F.col("verdict"))).drop("_given")


def verdict_faults(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, missing, invalid): required hits without a known verdict, and what was judged though no such hit was asked for, sorted."""
    known = F.coalesce(F.lower(F.trim("verdict")).isin(VERDICTS), F.lit(False))
    given = judged.where(F.col("chunk_id").isNotNull()).groupBy("query_id", "chunk_id").agg(F.max(known).alias("known"))
    both = hits.select("query_id", "chunk_id", F.lit(True).alias("asked")).join(given, ["query_id", "chunk_id"], "full")
    ids = lambda fits: F.array_sort(F.collect_list(F.when(fits, F.col("chunk_id"))))
    return both.groupBy("query_id").agg(ids(F.col("asked").isNotNull() & ~F.coalesce("known", F.lit(False))).alias("missing"), ids(F.col("asked").isNull()).alias("invalid"))


def prioritised(hits: DataFrame, limit: int = 8) -> DataFrame:
    """The first limit hits of each question: relevant ones by rank, then potentially relevant ones; all by rank if there are neither."""
    kind = F.when(F.col("verdict") == "relevant", 0).when(F.col("verdict") == "potentially_relevant", 1)
    told = hits.withColumn("_kind", kind).withColumn("_any", F.max(kind.isNotNull()).over(Window.partitionBy("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("_kind", F.lit(2)), "rank")
    placed = told.where(F.col("_kind").isNotNull() | ~F.col("_any")).withColumn("place", F.row_number().over(order))
    return placed.where(F.col("place") <= limit).drop("_kind", "_any")


def supported(answers: DataFrame, hits: DataFrame, first: int = 5) -> DataFrame:
    """answers (query_id, answer) with supported: whether enough of their terms stand in their first hits, titles and sections.

    One term is enough for answers of three at most; else a quarter, two to five. An answer without terms has no support.
    """
    told = hits.where(F.col("rank") <= first).withColumn("t", F.array_union(F.array_union(T.answer_terms(F.coalesce(F.nullif("context_window", F.lit("")), "content")), T.answer_terms(F.coalesce("section", F.lit("")))), T.answer_terms(F.coalesce("title", F.lit("")))))
    held = told.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("held"))
    both = answers.join(held, "query_id", "left")
    terms = T.answer_terms(F.col("answer"))
    shared = F.size(F.array_intersect(terms, F.coalesce("held", F.array().cast("array<string>"))))
    least = F.when(F.size(terms) <= 3, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.size(terms) / 4))))
    return both.withColumn("supported", (F.size(terms) > 0) & (shared >= least)).drop("held")


def plain_answers(hits: DataFrame, length: int = 700) -> DataFrame:
    """(query_id, answer) without a model: the first hit's evidence with its chunk's name before it."""
    best = hits.where("place = 1")
    return best.select("query_id", F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.substring(evidence(), 1, length)).alias("answer"))
