"""Answers, their sources and summaries, over the hits of questions; payloads are made from hits and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import checks as K
from tessera.catalog import sqltext as S
from tessera.catalog.registry import query
from tessera.operators import questions as Q
from tessera.operators import replies as P
from tessera.sources import manuals
from tessera.sources.interim import written
from tessera.sources.tables import table

_VERSION = "chunk_id % 3"
HITS = f"""{K.PAIRS}, hv AS (SELECT *, {_VERSION} AS version_id FROM y)"""
_SUMMARY = "'[' || CAST(chunk_id AS STRING) || '] ' || substr(content, 1, 40)"


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(hits of the different questions, whose questions they are)."""
    hits, same = K._pairs(spark, d)
    return written(hits.withColumn("version_id", F.expr(_VERSION)), "hits"), same


def _round(before: str, after: str) -> str:
    """SQL of one round of merging for questions that still have more than four summaries."""
    return f"""{after} AS (SELECT query_id, g AS place, flatten(list(ids ORDER BY place)) AS ids, arg_min(title, place) AS title, CASE WHEN count(*) = 1 THEN any_value(pages) ELSE list_sort(list_distinct(flatten(list(pages)))) END AS pages,
    CASE WHEN count(*) = 1 THEN any_value(summary) ELSE substr(string_agg(summary, ' ' ORDER BY place), 1, 2000) END AS summary
    FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) > 4 THEN (place - 1) // 3 + 1 ELSE place END AS g FROM {before}) GROUP BY query_id, g)"""


@query(f"""WITH {HITS}, m0 AS (SELECT query_id, rank AS place, [CAST(chunk_id AS VARCHAR)] AS ids, title, range(page_from, page_to + 1) AS pages, {_SUMMARY} AS summary FROM hv), {_round('m0', 'm1')}, {_round('m1', 'm2')}, {_round('m2', 'm3')}
  SELECT query_id, place, array_to_string(ids, ',') AS chunk_ids, title, array_to_string(pages, ',') AS pages, summary FROM m3""")
def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    hits, same = _hits(spark, d)
    own = hits.select("query_id", F.col("rank").alias("place"), "chunk_id", "title", F.sequence("page_from", "page_to").alias("pages"), F.expr(_SUMMARY).alias("summary"))
    found = Q.for_all(P.merged_summaries(own), same)
    return found.select("query_id", "place", F.array_join("chunk_ids", ",").alias("chunk_ids"), "title", F.array_join("pages", ",").alias("pages"), "summary")


#: What a model may have said, by question: supported or not, with and without citations, confidences of every kind.
_ANSWER = "CASE query_id % 4 WHEN 0 THEN 'Nothing known about bananas, oranges and mangoes whatsoever' ELSE said END"
_CONFIDENCE = """CASE query_id % 6 WHEN 0 THEN '"High "' WHEN 1 THEN '0.85' WHEN 2 THEN '0.5' WHEN 3 THEN '0.1' WHEN 4 THEN '"sure"' ELSE 'null' END"""
_WARNINGS = """CASE query_id % 3 WHEN 0 THEN '["Old."]' WHEN 1 THEN '"Check."' ELSE 'null' END"""
_CITED = """CASE query_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '"none"' ELSE '[{"chunk_id": "' || CAST(chunk_id AS STRING) || '", "pages": [1]}]' END"""
_SURE = """CASE query_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' ELSE 'false' END"""
_TEXT = "replace(substr(content, 1, 200), '\"', '')"
_FIRST = "array_to_string(list(CAST(chunk_id AS VARCHAR) ORDER BY rank) FILTER (WHERE rank <= 3), ',')"
_JSON = f"""'{{"answer": "' || {_ANSWER} || '", "confidence": ' || {_CONFIDENCE} || ', "warnings": ' || {_WARNINGS} || ', "citations": ' || {_CITED} || ', "insufficient_evidence": ' || {_SURE} || '}}'"""
ANSWERS = f"""{HITS}, b AS (SELECT query_id, chunk_id, {_TEXT} AS said FROM hv WHERE rank = 1), f3 AS (SELECT query_id, {_FIRST} AS firsts, max(score) AS best, count(DISTINCT version_id) AS versions FROM hv GROUP BY query_id),
  n AS (SELECT b.query_id, chunk_id, {_ANSWER} AS answer, CASE query_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS confidence, CASE query_id % 3 WHEN 0 THEN ['Old.'] WHEN 1 THEN ['Check.'] ELSE CAST([] AS VARCHAR[]) END AS warnings,
    query_id % 7 < 2 AS insufficient FROM b),
  n1 AS (SELECT n.*, CASE n.query_id % 5 WHEN 0 THEN '' WHEN 1 THEN firsts ELSE CAST(chunk_id AS VARCHAR) END AS cited, best, versions, chunk_id AS top FROM n JOIN f3 ON f3.query_id = n.query_id)"""


def _regular(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hits = written(Q.for_all(*_hits(spark, d)), "hits")
    payloads = hits.where("rank = 1").withColumn("said", F.expr(_TEXT)).select("query_id", F.expr(_JSON).alias("payload"))
    return P.regular(payloads, hits), hits


@query(f"WITH {ANSWERS} SELECT query_id, answer, confidence, array_to_string(warnings, '|') AS warnings, cited, insufficient FROM n1")
def regular_payloads(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _regular(spark, d)
    return found.select("query_id", "answer", "confidence", F.array_join("warnings", "|").alias("warnings"), F.array_join("cited", ",").alias("cited"), "insufficient")


_HELD = f"""th AS (SELECT DISTINCT query_id, unnest({K._TERMS("content || ' ' || section || ' ' || title")}) AS term FROM hv WHERE rank <= 5), s0 AS (SELECT *, {K._TERMS('answer')} AS terms FROM n1),
  s1 AS (SELECT *, len(terms) > 0 AND (SELECT count(*) FROM th WHERE th.query_id = s0.query_id AND list_contains(s0.terms, th.term)) >= CASE WHEN len(terms) <= 3 THEN 1 ELSE greatest(2, least(5, floor(len(terms) / 4))) END AS supported FROM s0),
  s2 AS (SELECT s1.*, hv.content AS plain, best < 0.02 AS weak FROM s1 JOIN hv ON hv.query_id = s1.query_id AND hv.rank = 1),
  s3 AS (SELECT query_id, CASE WHEN supported THEN answer ELSE trim(plain) END AS answer, CASE WHEN weak THEN 'low' WHEN NOT supported THEN 'medium' ELSE confidence END AS confidence,
    warnings || list_filter([CASE WHEN NOT supported THEN {S.quoted(P.UNSUPPORTED)} END, CASE WHEN supported AND cited = '' THEN {S.quoted(P.RECONSTRUCTED)} END, CASE WHEN versions > 1 THEN {S.quoted(P.VERSIONS)} END, CASE WHEN weak THEN {S.quoted(P.WEAK)} END], lambda w: w IS NOT NULL) AS warnings,
    CASE WHEN NOT supported OR cited = '' THEN CAST(top AS VARCHAR) ELSE cited END AS cited, weak OR (supported AND insufficient) AS insufficient FROM s2)"""


@query(f"WITH {ANSWERS}, {_HELD} SELECT query_id, answer, confidence, array_to_string(warnings, '|') AS warnings, cited, insufficient FROM s3")
def validated_answers(spark: SparkSession, d: str) -> DataFrame:
    found = P.validated(*_regular(spark, d))
    return found.select("query_id", "answer", "confidence", F.array_join("warnings", "|").alias("warnings"), F.array_join("cited", ",").alias("cited"), "insufficient")


@query(f"""WITH {ANSWERS}, {_HELD}, bl AS ({manuals.BLOCKS_SQL}), ci AS (SELECT DISTINCT query_id, unnest(string_split(cited, ',')) AS chunk FROM s3), pg AS (SELECT DISTINCT ci.query_id, doc, unnest(range(page_from, page_to + 1)) AS page FROM ci JOIN hv ON hv.query_id = ci.query_id AND CAST(hv.chunk_id AS VARCHAR) = ci.chunk)
  SELECT pg.query_id, pg.doc, array_to_string(list_sort(list_distinct(list(pg.page))), ',') AS pages, coalesce(array_to_string(list_sort(list_distinct(list(bl.ordinal) FILTER (WHERE bl.ordinal IS NOT NULL))), ','), '') AS tables
  FROM pg LEFT JOIN bl ON bl.doc = pg.doc AND bl.page = pg.page AND contains(bl.text, ' | ') GROUP BY pg.query_id, pg.doc""")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    answers, hits = _regular(spark, d)
    nodes = manuals.blocks(spark, d).where(F.col("text").contains(" | ")).select("doc", "ordinal", "page", F.lit("table").alias("kind"))
    found = P.sources(P.validated(answers, hits), hits, nodes)
    return found.select("query_id", "doc", F.array_join("pages", ",").alias("pages"), F.array_join("tables", ",").alias("tables"))



@query("""WITH e AS (SELECT event_id, props, [props, '{"a": "}{", "b": {"c": ' || CAST(event_id AS VARCHAR) || '}}'] AS found FROM events) SELECT event_id, len(found) AS n, array_to_string(found, '~') AS objects FROM e""")
def mixed_output(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("INFO started }\n"), "props", F.lit(' done } {"a": "}{", "b": {"c": '), F.col("event_id").cast("string"), F.lit('}} tail { "open": 1'))
    found = table(spark, d, "events").select("event_id", P.objects_in(text).alias("found"))
    return found.select("event_id", F.size("found").alias("n"), F.array_join("found", "~").alias("objects"))
