"""Answers from hits: summaries merged in rounds, payloads of models made regular, answers validated, their sources told.

Hits are rows (query_id, chunk_id, rank, score, doc, version_id, title, section, page_from, page_to, content, chunk_type, context_window);
payloads of models come in as JSON text and may be anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.sources.interim import discard, written

# What answers warn of, and the bounds that rules name.
UNSUPPORTED = "Generated answer was not sufficiently supported by retrieved evidence; using retrieval-grounded fallback."
RECONSTRUCTED = "Citations were reconstructed from top retrieval evidence."
VERSIONS = "Retrieved evidence spans multiple document versions; verify revision-specific details."
WEAK = "Retrieved evidence scored weakly for this question."
HIGH, MEDIUM, WEAK_SCORE = 0.8, 0.4, 0.02
BATCH, LEFT, LENGTH = 3, 4, 2000


def joined_summaries(parts: Column) -> Column:
    """The summaries of a batch one after another: what stands in for a model."""
    return F.array_join(parts, " ")


def merged_summaries(summaries: DataFrame, merge: Callable[[Column], Column] = joined_summaries, batch: int = BATCH, left: int = LEFT, length: int = LENGTH) -> DataFrame:
    """(query_id, place, chunk_ids, title, pages, summary): summaries (query_id, place from 1, chunk_id, title, pages, summary) of each
    question merged in batches, round by round, until left of them are left.

    All questions go through a round together; those with few summaries wait. merge makes one text of a batch's texts, in
    order; a batch of one stays as it is, others are cut to length. Rounds grow with the logarithm of the longest list.
    """
    state = summaries.select("query_id", "place", F.array(F.col("chunk_id").cast("string")).alias("chunk_ids"), "title", "pages", "summary")
    state = written(state, "summaries")
    while state.groupBy("query_id").count().where(F.col("count") > left).limit(1).count():
        most = state.groupBy("query_id").agg(F.count("*").alias("many"))
        told = state.join(most, "query_id")
        dealt = told.withColumn("to", F.when(F.col("many") > left, F.floor((F.col("place") - 1) / batch) + 1).otherwise(F.col("place")))
        listed = dealt.groupBy("query_id", "to").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_ids", "title", "pages", "summary"))).alias("parts"))
        texts = F.transform("parts", lambda p: p["summary"])
        pages = F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["pages"]))))
        one = F.size("parts") == 1
        after = listed.select(
            "query_id",
            F.col("to").cast("int").alias("place"),
            F.flatten(F.transform("parts", lambda p: p["chunk_ids"])).alias("chunk_ids"),
            F.col("parts")[0]["title"].alias("title"),
            F.when(one, F.col("parts")[0]["pages"]).otherwise(pages).alias("pages"),
            F.when(one, F.col("parts")[0]["summary"]).otherwise(F.substring(merge(texts), 1, length)).alias("summary"),
        )
        after = written(after, "summaries")
        discard(state)
        state = after
    return state


PAYLOAD = "struct<answer:string,confidence:string,warnings:string,followup_questions:string,citations:string,used_documents:string,insufficient_evidence:string>"
_CITED = "array<struct<chunk_id:string>>"


def _listed(json: Column) -> Column:
    """A JSON list's values as texts; anything else that is there as a list of one, what is empty as none."""
    items = F.from_json(json, "array<string>")
    there = json.isNotNull() & ~json.isin("", "null", "[]", "{}", "false", "0", '""')
    return F.when(json.startswith("[") & items.isNotNull(), F.coalesce(F.array_compact(items), F.array().cast("array<string>"))).when(there, F.array(json)).otherwise(F.array().cast("array<string>"))


def regular(payloads: DataFrame, hits: DataFrame, payload: str = "payload") -> DataFrame:
    """(query_id, answer, confidence, warnings, followup_questions, cited, insufficient) of payloads (query_id, payload as JSON).

    A confidence is high, medium or low, numbers are told by size, anything else is medium. Lists that are no lists become
    lists of one. Citations that are no list of objects become the first three hits. A payload that is no JSON is empty.
    """
    parsed = payloads.select("query_id", F.from_json(payload, PAYLOAD).alias("p"))
    said = F.lower(F.trim("p.confidence"))
    number = F.expr("try_cast(p.confidence AS DOUBLE)")
    confidence = F.when(said.isin("high", "medium", "low"), said).when(number >= HIGH, "high").when(number < MEDIUM, "low").otherwise("medium")
    first = hits.where("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("c")))), lambda h: h["c"]).alias("_first"))
    items = F.from_json("p.citations", _CITED)
    objects = F.col("p.citations").startswith("[") & items.isNotNull() & ~F.exists(items, lambda c: c.isNull())
    cited = F.when(objects, F.transform(items, lambda c: c["chunk_id"])).otherwise(F.coalesce("_first", F.array().cast("array<string>")))
    insufficient = F.lower(F.coalesce("p.insufficient_evidence", F.lit(""))).isin("1", "true", "yes")
    return parsed.join(first, "query_id", "left").select("query_id", F.coalesce("p.answer", F.lit("")).alias("answer"), confidence.alias("confidence"), _listed(F.col("p.warnings")).alias("warnings"), _listed(F.col("p.followup_questions")).alias("followup_questions"), cited.alias("cited"), insufficient.alias("insufficient"))


def validated(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers (as regular gives them) checked against their hits: (query_id, answer, confidence, warnings, cited, insufficient).

    An answer that its hits do not support gives way to the first hit's own text, cited, with high confidence in nothing:
    medium; without citations the first hit is cited; hits of several versions and weak scores are warned of, and weak ones
    leave the evidence insufficient. Answers without hits stay as they are.
    """
    counted = hits.groupBy("query_id").agg(F.max("score").alias("_score"), F.countDistinct("version_id").alias("_versions"))
    best = hits.where("rank = 1").select("query_id", A.evidence().alias("_plain"))
    top = hits.where("rank = 1").select("query_id", F.col("chunk_id").cast("string").alias("_top"))
    told = A.supported(answers, hits).join(counted, "query_id", "left").join(best, "query_id", "left").join(top, "query_id", "left")
    there = F.col("_score").isNotNull()
    lost = there & ~F.col("supported")
    weak = there & (F.col("_score") < WEAK_SCORE)
    bare = there & ~lost & (F.size("cited") == 0)
    warned = F.array_compact(F.array(*(F.when(fits, F.lit(text)) for fits, text in ((lost, UNSUPPORTED), (bare, RECONSTRUCTED), (there & (F.col("_versions") > 1), VERSIONS), (weak, WEAK)))))
    return told.select(
        "query_id",
        F.when(lost, F.col("_plain")).otherwise(F.col("answer")).alias("answer"),
        F.when(weak, "low").when(lost, "medium").otherwise(F.col("confidence")).alias("confidence"),
        F.concat("warnings", warned).alias("warnings"),
        F.when(lost | bare, F.array("_top")).otherwise(F.col("cited")).alias("cited"),
        (weak | (~lost & F.col("insufficient"))).alias("insufficient"),
    )


def sources(answers: DataFrame, hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, doc, pages, tables): what answers cite by document: the pages of cited hits, and the tables on them.

    nodes: (doc, ordinal, page, kind) of documents. A table is named by its ordinal. Pages join by equality.
    """
    cited = answers.select("query_id", F.explode(F.array_distinct("cited")).alias("chunk"))
    met = cited.join(hits.withColumn("chunk", F.col("chunk_id").cast("string")), ["query_id", "chunk"]).select("query_id", "doc", F.explode(F.sequence("page_from", "page_to")).alias("page")).distinct()
    tables = nodes.where("kind = 'table'").select("doc", "page", "ordinal")
    return met.join(tables, ["doc", "page"], "left").groupBy("query_id", "doc").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set("ordinal")).alias("tables"))


def objects_in(text: Column) -> Column:
    """The outermost JSON objects in mixed output, by the depth of braces outside of strings; unfinished ones are left out.

    Matched by patterns of nested braces up to three levels, strings with escapes whole.
    """
    string = r'"(?:[^"\\]|\\.)*+"'
    level = r"\{(?:[^{}\"]|" + string + r")*+\}"
    for _ in range(3):
        level = r"\{(?:[^{}\"]|" + string + "|" + level + r")*+\}"
    return F.regexp_extract_all(text, F.lit(level), F.lit(0))
