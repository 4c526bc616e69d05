"""Benchmark cases, scoring, quality checks, verdicts on evidence and metadata, over the library and the manuals."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import retrieval as C
from tessera.catalog import sqltext as S
from tessera.catalog.nodes import NORMALISED, _normal, nodes_sql
from tessera.catalog.registry import query
from tessera.catalog.retrieval import CHUNKS
from tessera.functions import text as T
from tessera.operators import answers as A
from tessera.operators import evaluation as E
from tessera.operators import health as H
from tessera.operators import metadata as M
from tessera.operators import questions as Q
from tessera.operators import retrieval as R
from tessera.operators import structure as P
from tessera.plans import retrieve as plan
from tessera.plans import scoped
from tessera.sources import library, manuals
from tessera.sources.interim import written
from tessera.sources.tables import table

_RECORDS = S.listed(E.RECORDS)
_FIELDS = r"len(regexp_extract_all(content, '([A-Za-z][A-Za-z0-9 /_()-]{1,40})\s*:\s*([^\n;]{1,80})')) > 0"
_MEASURED = r"len(list_filter(et, lambda t: regexp_matches(t, '\b\d+(?:\.\d+)?(?:v|a|ma|w|kw|mm|cm|m|ms|s|hz|khz|mhz|fps|kg|g|n|mpa|°c|c|%)\b'))) > 0"
_ACTING = f"len(list_filter(et, lambda t: t IN {S.listed(T.TECHNICAL_VERBS)})) > 0"
_LABELS = f"list_filter([trim(m) for m in regexp_extract_all(content, {S.quoted(T.MENU)})], lambda m: length(m) >= 3)"
_STRONG = f"len(list_filter(anchors, lambda x: {S.high_signal('x')})) >= 1"
_ASKED = f"list_distinct(list_filter({S.eval_tokens('query')}, lambda t: t NOT IN {S.listed(E.IGNORED)}))"


def _one(q: str, method: str, fits: str = "true") -> str:
    return f"CASE WHEN {fits} THEN {{'query': {q}, 'method': '{method}'}} END"


_TWO, _THREE = "s <> p", "t NOT IN (p, s)"
_CASES = f"""CASE WHEN chunk_type IN ('spec_record', 'datasheet_record') THEN [{_one("about || ' ' || p || ' ' || s", 'spec_primary_multi', _TWO)}, {_one("about || ' ' || p || ' ' || s || ' ' || t", 'spec_context_multi', _THREE)}, {_one("p || ' ' || s || ' for ' || about", 'spec_value')}, {_one("about || ' ' || p || ' ' || s", 'spec_multi', _TWO)}]
  WHEN chunk_type = 'table_record' THEN [{_one("about || ' ' || p || ' ' || s", 'table_primary_multi', _TWO)}, {_one("p || ' ' || s || ' ' || t || ' ' || about", 'table_context_multi', _THREE)}, {_one("about || ' ' || p", 'table_primary')}]
  WHEN chunk_type = 'procedure_record' THEN [{_one("'how to ' || p || ' ' || about", 'procedure_howto')}, {_one("p || ' ' || s || ' steps ' || about", 'procedure_step', _TWO)}, {_one("p || ' procedure ' || about", 'procedure_describe')}]
  WHEN chunk_type = 'warning_record' THEN [{_one("about || ' warning ' || p", 'warning_primary')}, {_one("about || ' caution ' || p || ' ' || s", 'warning_caution', _TWO)}]
  ELSE [{_one("about || ' ' || p || ' ' || s", 'general_multi', 'len(words) >= 2')}, {_one("about || ' ' || p", 'general_primary')}] END"""
ASKED = f"""{CHUNKS}, v0 AS (SELECT *, {S.anchors('content')} AS anchors, {S.eval_tokens('content')} AS et, {_LABELS} AS labels FROM c),
  v1 AS (SELECT *, CASE WHEN len(labels) > 0 AND NOT list_contains(anchors, labels[1]) THEN list_slice([labels[1]] || anchors, 1, 6) ELSE anchors END AS words FROM v0 WHERE length(content) >= 40 AND NOT {S.contains_any(f"lower({S.collapsed('content')})", T.BOILERPLATE)}
    AND NOT ((contains(lower(content), 'procedure step') AND regexp_matches(lower(content), '\\d+-\\d+\\b')) OR regexp_matches(content, '\\.{{4,}}\\s*\\d+(?:-\\d+)?\\b')) AND len(anchors) >= 1
    AND CASE WHEN chunk_type IN {_RECORDS} THEN {_FIELDS} OR {_MEASURED} OR {_STRONG} WHEN chunk_type = 'procedure_record' THEN {_ACTING} AND {_STRONG} WHEN chunk_type = 'warning_record' THEN {_STRONG} ELSE ({_FIELDS} OR {_MEASURED} OR len(labels) > 0 OR {_ACTING}) AND {_STRONG} END),
  v2 AS (SELECT *, coalesce(product_models[1], nullif(trim(title), ''), 'this document') AS about, words[1] AS p, coalesce(words[2], words[1]) AS s, coalesce(words[3], words[2], words[1]) AS t FROM v1),
  v3 AS (SELECT *, list_slice(list_filter({_CASES}, lambda q: q IS NOT NULL), 1, 3) AS qs FROM v2), v4 AS (SELECT *, generate_subscripts(qs, 1) AS n, unnest(qs) AS q FROM v3), v5 AS (SELECT *, q.query AS query, q.method AS method FROM v4),
  v6 AS (SELECT *, {_ASKED} AS asked, {S.eval_tokens("content || ' ' || section || ' ' || title || ' ' || coalesce(product_models[1], '')")} AS known FROM v5),
  v7 AS (SELECT *, list_filter(asked, lambda t: list_contains(known, t) OR {S.high_signal('t')}) AS terms, {S.eval_tokens('query')} AS qt FROM v6),
  v8 AS (SELECT *, len(list_filter(terms, lambda t: list_contains(et, t))) + len(list_filter(terms, lambda t: list_contains(anchors, t))) + len(list_filter(terms, lambda t: {S.high_signal('t')})) AS affinity, len(list_filter(qt, lambda t: t NOT IN {S.listed(E.IGNORED)} AND list_contains(et, t))) AS shared,
    CASE WHEN len(list_filter(qt, lambda t: regexp_matches(t, '\\d'))) > 0 THEN 2 ELSE 0 END + CASE WHEN len(list_filter(qt, lambda t: t IN {S.listed(T.TECHNICAL_TERMS)})) > 0 THEN 2 ELSE 0 END + CASE WHEN len(list_slice(anchors, 1, 4)) >= 2 THEN 2 ELSE 0 END
    + CASE WHEN len(list_filter(list_slice(anchors, 1, 4), lambda t: {S.specific('t')})) > 0 THEN 2 ELSE 0 END + CASE WHEN length(query) >= 28 THEN 1 ELSE 0 END AS specificity FROM v7),
  v AS (SELECT *, CASE WHEN len(anchors) = 0 THEN 'no_specific_anchor' WHEN {S.contains_any(f"lower({S.collapsed('query')})", E.BOUND)} THEN 'document_bound_query' WHEN {" OR ".join(f"starts_with(lower({S.collapsed('query')}), '{x}')" for x in E.META_STARTS)} OR {S.contains_any(f"lower({S.collapsed('query')})", E.META_PARTS)} THEN 'meta_query'
    WHEN chunk_type = 'atomic_text' AND len(anchors) < 2 THEN 'atomic_requires_two_anchors' WHEN chunk_type = 'atomic_text' AND NOT ({_STRONG}) THEN 'atomic_requires_high_signal_anchor' WHEN specificity < 5 THEN 'low_specificity'
    WHEN affinity < CASE WHEN chunk_type IN {_RECORDS} THEN 4 ELSE 3 END OR (chunk_type IN {_RECORDS} AND shared < 2) THEN 'weak_source_affinity' ELSE 'validated' END AS quality FROM v8)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return E.verdict(E.questions_of(library.chunks(spark, d)))


@query(f"WITH {ASKED} SELECT chunk_id, n, query, method, specificity, affinity, quality FROM v")
def benchmark_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("chunk_id", "n", "query", "method", "specificity", "affinity", "quality")


#: Search by words within documents: the scope of a chunk is its document.
_WITHIN_DOCUMENTS = re.sub(r"p AS \(SELECT p2\.\*, scope FROM p2 JOIN sc ON .*\),\n", "p AS (SELECT p2.*, c.doc AS scope FROM p2 JOIN c ON c.chunk_id = p2.chunk_id),\n", C.LEXICAL)
_HITS = f"""{ASKED}, ca AS (SELECT chunk_id * 10 + n AS case_id, query, chunk_id, doc, section, chunk_type, list_slice(anchors, 1, 4) AS terms FROM v WHERE quality = 'validated'),
  qs AS (SELECT case_id AS query_id, query, doc AS scope FROM ca), {_WITHIN_DOCUMENTS}, h0 AS (SELECT query_id AS case_id, chunk_id, rank FROM lx WHERE rank <= 5)"""


def _has(term: str) -> str:
    own = S.eval_tokens(term)
    parts = f"list_filter(string_split({own}[1], '/'), lambda p: p <> '' AND p NOT IN {S.listed(T.EVAL_STOPWORDS)})"
    every = lambda xs: f"len(list_filter({xs}, lambda y: NOT list_contains(held, y))) = 0"
    rest = f"list_filter({own}, lambda y: y NOT IN {S.listed(T.EVAL_STOPWORDS)})"
    return f"(lower({S.collapsed(term)}) <> '' AND (contains(evidence, lower({S.collapsed(term)})) OR CASE WHEN len({own}) = 0 THEN false WHEN len({own}) = 1 THEN CASE WHEN contains({own}[1], '/') THEN len({parts}) > 0 AND {every(parts)} ELSE list_contains(held, {own}[1]) END ELSE {every(rest)} END))"


JUDGED = f"""{_HITS}, j0 AS (SELECT ca.*, h0.rank, x.chunk_id AS h_chunk, x.doc AS h_doc, x.section AS h_section, x.chunk_type AS h_type, x.content || ' ' || x.title || ' ' || x.section || ' ' || coalesce(x.product_models[1], '') || ' ' || x.chunk_type AS told FROM h0 JOIN ca ON ca.case_id = h0.case_id JOIN c x ON x.chunk_id = h0.chunk_id WHERE h0.rank <= 5),
  j1 AS (SELECT *, lower({S.collapsed('told')}) AS evidence, {S.eval_tokens('told')} AS held FROM j0), j2 AS (SELECT *, len(list_filter(terms, lambda t: {_has('t')})) AS overlap, len(list_filter({_ASKED}, lambda t: {_has('t')})) AS n_asked FROM j1),
  j3 AS (SELECT *, CASE WHEN h_chunk = chunk_id THEN 'exact_chunk' WHEN h_doc = doc AND h_section = section AND overlap >= greatest(2, least(3, len(terms))) THEN 'same_section_term_overlap' WHEN h_doc = doc AND overlap >= greatest(2, least(3, len(terms))) THEN 'same_document_term_overlap'
    WHEN h_doc = doc AND overlap >= 2 AND n_asked >= 2 THEN 'same_document_answerable_evidence' END AS reason FROM j2),
  j4 AS (SELECT case_id, min(rank) FILTER (WHERE reason IS NOT NULL) AS rank, arg_min(reason, rank) FILTER (WHERE reason IS NOT NULL) AS reason, bool_or(h_doc = doc) AS same, bool_or(h_type = chunk_type) AS kind, max(overlap) AS overlap FROM j3 GROUP BY case_id),
  j AS (SELECT ca.case_id, ca.doc, ca.chunk_type, j4.reason IS NOT NULL AS passed, coalesce(j4.rank, 0) AS rank, coalesce(j4.reason, 'no_match') AS reason, CASE WHEN j4.reason IS NOT NULL THEN NULL WHEN same THEN 'ranking_or_context_loss' WHEN kind AND overlap >= 1 THEN 'wrong_document_or_filter_loss' ELSE 'candidate_miss' END AS failure,
    j4.reason IS NOT NULL OR coalesce(same, false) AS candidate_recall FROM ca LEFT JOIN j4 ON j4.case_id = ca.case_id)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    chunks = library.written_chunks(spark, d)
    cases = E.verdict(E.questions_of(chunks)).where("quality = 'validated'").select((F.col("chunk_id") * 10 + F.col("n")).alias("case_id"), "query", "chunk_id", "doc", "section", "chunk_type", F.slice("anchors", 1, 4).alias("terms"))
    cases = written(cases, "cases")
    # each case is asked within its document
    within = written(chunks.select(F.col("doc").alias("scope"), "chunk_id"), "members")
    asked = cases.select(F.col("case_id").alias("query_id"), "query", F.col("doc").alias("scope"))
    told = scoped.lexical_within(chunks, within, asked, 5).withColumnRenamed("query_id", "case_id")
    return E.judged(cases, told.select("case_id", "chunk_id", "score", "rank"), chunks)


@query(f"WITH {JUDGED} SELECT * FROM j")
def judged_results(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


_WITHIN = "round(avg(CAST(passed AND rank <= {0} AS DOUBLE)), 6) AS pass_at_{0}"


@query(f"""WITH {JUDGED} SELECT CASE WHEN grouping(chunk_type) = 0 THEN 'type ' || chunk_type WHEN grouping(doc) = 0 THEN 'doc ' || doc ELSE 'all' END AS grp, count(*) AS total, count(*) FILTER (WHERE passed) AS passes, {_WITHIN.format(1)}, {_WITHIN.format(3)}, {_WITHIN.format(5)},
  round(coalesce(avg(CASE WHEN passed THEN rank END), 0), 6) AS mean_rank, round(avg(CAST(candidate_recall AS DOUBLE)), 6) AS recall, count(*) FILTER (WHERE failure = 'ranking_or_context_loss') AS ranking_or_context_loss, count(*) FILTER (WHERE failure = 'wrong_document_or_filter_loss') AS wrong_document_or_filter_loss, count(*) FILTER (WHERE failure = 'candidate_miss') AS candidate_miss
  FROM j GROUP BY GROUPING SETS ((), (chunk_type), (doc))""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(_judged(spark, d))


@query(f"""WITH {JUDGED}, va AS (SELECT chunk_type, count_if(quality = 'validated') / count(*) AS validity FROM v GROUP BY chunk_type),
  r AS (SELECT j.chunk_type, count(*) AS total, count_if(passed) AS passed, any_value(va.validity) AS validity FROM j JOIN va ON va.chunk_type = j.chunk_type GROUP BY j.chunk_type), o AS (SELECT sum(total) AS total, round(sum(validity * total) / sum(total), 4) AS validity, sum(passed) AS passes, coalesce(sum(passed) FILTER (WHERE chunk_type = 'atomic_text') / greatest(sum(total) FILTER (WHERE chunk_type = 'atomic_text'), 1), 0) AS atomic_rate,
  coalesce(min(passed / total) FILTER (WHERE chunk_type IN ('spec_record', 'table_record', 'procedure_record')), 0) AS structured_rate FROM r)
  SELECT CAST(total AS BIGINT) AS total, CAST(passes AS BIGINT) AS passes, round(passes / total, 4) AS pass_rate, validity, round(atomic_rate, 6) AS atomic_rate, round(structured_rate, 6) AS structured_rate, round(passes / total, 4) >= 0.7 AND validity >= 0.95 AND atomic_rate >= 0.6 AND structured_rate >= 0.75 AS ready FROM o""")
def readiness_gates(spark: SparkSession, d: str) -> DataFrame:
    valid = _cases(spark, d).groupBy("chunk_type").agg((F.count_if(F.col("quality") == "validated") / F.count("*")).alias("validity"))
    runs = _judged(spark, d).groupBy("chunk_type").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return E.gates(runs.join(valid, "chunk_type"))


_V = S.quoted(T.VALUE.split("|", 1)[1])


def flags_sql(source: str, text: str, structured: str) -> str:
    """Common table expressions up to g: flags of the texts of a source."""
    return rf"""k AS (SELECT *, {structured} AS structured, trim({text}) AS x, {S.tokens(f'trim({text})')} AS t, lower(trim({text})) AS low FROM {source}),
  f AS (SELECT *, len(t) AS n_words, len(list_filter(t, lambda y: regexp_matches(y, '[a-z]'))) AS lettered, len(list_filter(t, lambda y: regexp_matches(y, '\d'))) AS digits, regexp_matches(low, {_V}) AS has_value, {S.like('low', T.URL)} AS url_like, {S.like('low', T.PAGE_MARK)} AS page_marker,
    {S.like('low', T.PHONE_WORD)} OR {S.like('x', T.PHONE)} AS contact_like, regexp_matches(low, '\.(?:gif|jpg|jpeg|png|svg|tif|tiff|bmp)\b') AS asset_like, regexp_matches(x, '[.:;]') OR len(t) >= 8 AS sentence FROM k),
  g0 AS (SELECT *, x <> '' AND (url_like OR page_marker OR contact_like OR asset_like OR (n_words <= 2 AND NOT has_value) OR (lettered <= 1 AND NOT has_value AND NOT sentence) OR (n_words > 0 AND digits >= lettered AND NOT has_value)) AS low_information FROM f),
  g AS (SELECT *, low_information AND structured AS structured_low, CASE WHEN n_words = 0 THEN 0 ELSE round(CAST(CASE WHEN n_words >= 5 THEN 0.3 ELSE 0 END + CASE WHEN has_value THEN 0.4 ELSE 0 END
    + CASE WHEN len(list_filter(t, lambda y: regexp_matches(y, '\d') AND regexp_matches(y, '[a-z]'))) > 0 THEN 0.2 ELSE 0 END + CASE WHEN structured THEN 0.15 ELSE 0 END - CASE WHEN {S.like('x', T.PHONE)} OR url_like THEN 0.4 ELSE 0 END - CASE WHEN page_marker THEN 0.3 ELSE 0 END AS DOUBLE), 4) END AS signal FROM g0)"""


@query(f"""WITH {nodes_sql(manuals.BLOCKS_SQL)}, {flags_sql('n', 'text', "kind IN ('spec', 'table', 'procedure_step', 'warning', 'caution')")}
  SELECT doc, ordinal, n_words AS n_tokens, has_value, url_like, page_marker, contact_like, asset_like, low_information, structured_low, signal FROM g""")
def content_quality(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the nodes of all manuals, each as a chunk of the type that its kind gives."""
    flags = E.quality(F.col("text"), H.chunk_type_of(F.col("kind")))
    return P.nodes(manuals.blocks(spark, d)).select("doc", "ordinal", *(c.alias(n) for n, c in flags.items()))


_STRUCTURED = f"chunk_type IN {S.listed(H.STRUCTURED)}"
_ZERO = lambda *names: ", ".join(f"coalesce({x}, 0) AS {x}" for x in names)
_RATIO = lambda part, whole, scale: f"floor((2 * {scale} * ({part}) + {whole}) / (2 * ({whole}))) / {scale}"
_PROSE, _SAID = "kind IN ('paragraph', 'note')", "FILTER (WHERE trim(text) <> '')"
MEASURES = rf"""{nodes_sql(manuals.BLOCKS_SQL)}, {CHUNKS}, {flags_sql('c', 'content', _STRUCTURED)}, dc AS (SELECT doc, max(page) AS page_count FROM b GROUP BY doc),
  na AS (SELECT doc, page, count(*) AS m FROM n GROUP BY doc, page), nd AS (SELECT doc, count(*) AS node_pages, min(page) AS first_node_page, max(page) AS last_node_page, {_RATIO('sum(m)', 'count(*)', 100)} AS mean_nodes, max(m) AS most_nodes FROM na GROUP BY doc),
  ca AS (SELECT doc, page_from, count(*) AS m FROM c GROUP BY doc, page_from), cd AS (SELECT doc, count(*) AS chunk_pages, min(page_from) AS first_chunk_page, max(page_from) AS last_chunk_page, {_RATIO('sum(m)', 'count(*)', 100)} AS mean_chunks, max(m) AS most_chunks FROM ca GROUP BY doc),
  nr AS (SELECT doc, {_RATIO(f'count_if({_PROSE} AND n_tokens <= 3)', f'greatest(count_if({_PROSE}), 1)', 10000)} AS short_ratio, {_RATIO(f'count(*) {_SAID} - count(DISTINCT lower(trim(text))) {_SAID}', f'greatest(count(*) {_SAID}, 1)', 10000)} AS repeat_ratio FROM n GROUP BY doc),
  cq AS (SELECT doc, count(*) AS n_chunks, CAST(count_if(structured) AS BIGINT) AS n_structured, {_RATIO('count_if(low_information)', 'count(*)', 10000)} AS low_ratio, {_RATIO('count_if(structured_low)', 'greatest(count_if(structured), 1)', 10000)} AS structured_low_ratio,
    {_RATIO('sum(CAST(round(100 * signal) AS BIGINT))', '100 * count(*)', 10000)} AS signal_mean FROM g GROUP BY doc),
  ms AS (SELECT dc.doc, page_count, {_ZERO('node_pages')}, first_node_page, last_node_page, {_ZERO('mean_nodes', 'most_nodes', 'chunk_pages')}, first_chunk_page, last_chunk_page, {_ZERO('mean_chunks', 'most_chunks', 'short_ratio', 'repeat_ratio', 'n_chunks', 'n_structured', 'low_ratio', 'structured_low_ratio', 'signal_mean')}
    FROM dc LEFT JOIN nd ON nd.doc = dc.doc LEFT JOIN cd ON cd.doc = dc.doc LEFT JOIN nr ON nr.doc = dc.doc LEFT JOIN cq ON cq.doc = dc.doc)"""


def _measures(spark: SparkSession, d: str) -> DataFrame:
    blocks = manuals.blocks(spark, d)
    return H.measures(blocks.groupBy("doc").agg(F.max("page").alias("page_count")), P.nodes(blocks), library.chunks(spark, d))


@query(f"WITH {MEASURES} SELECT * FROM ms")
def stage_measures(spark: SparkSession, d: str) -> DataFrame:
    return _measures(spark, d)


@query(f"""WITH {MEASURES}, er AS (SELECT doc, 'page_provenance' AS check_name, CASE WHEN page_count > 1 AND node_pages <= 1 THEN 'nodes stand on a single page' WHEN node_pages > 0 AND (first_node_page < 1 OR last_node_page > page_count) THEN 'nodes stand outside the pages of the source' END AS error FROM ms
  UNION ALL SELECT doc, 'fragmentation', CASE WHEN page_count > 1 AND chunk_pages <= 1 THEN 'chunks stand on a single page' WHEN mean_chunks > 40 OR most_chunks > 150 THEN 'too many chunks a page' WHEN page_count > 1 AND short_ratio > 0.45 THEN 'too many short texts' END FROM ms
  UNION ALL SELECT doc, 'chunk_quality', CASE WHEN low_ratio > 0.35 THEN 'too many chunks say little' WHEN n_structured > 0 AND structured_low_ratio > 0.15 THEN 'too many structured chunks say little' END FROM ms)
  SELECT doc, check_name, CASE WHEN error IS NULL THEN 'pass' ELSE 'fail' END AS status, error FROM er""")
def stage_findings(spark: SparkSession, d: str) -> DataFrame:
    return H.findings(_measures(spark, d))


@query(f"""WITH {CHUNKS} SELECT doc, CASE WHEN grouping(level) = 0 THEN 'level ' || CAST(level AS STRING) WHEN grouping(chunk_type) = 0 THEN 'type ' || chunk_type ELSE 'all' END AS grp, count(*) AS n
  FROM c GROUP BY GROUPING SETS ((doc), (doc, level), (doc, chunk_type))""")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.chunk_counts(library.chunks(spark, d))


@query(f"""WITH {NORMALISED}, pg AS (SELECT doc, page, count(*) AS n FROM o GROUP BY doc, page), de AS (SELECT doc, count(DISTINCT page) AS n_pages, min(page) AS first_page, max(page) AS last_page, round(avg(n), 6) AS mean_density, max(n) AS most_density FROM pg GROUP BY doc),
  ra AS (SELECT doc, count(*) AS n_nodes, round(count_if(n_tokens <= 3) / count(*), 6) AS short_ratio, round(1 - count(DISTINCT text) / count(*), 6) AS repeat_ratio, count(*) FILTER (WHERE kind = 'section') AS n_sections FROM o GROUP BY doc)
  SELECT de.*, ra.* EXCLUDE (doc), CASE WHEN mean_density > 40 OR most_density > 150 OR short_ratio > 0.45 THEN 'fail' ELSE 'pass' END AS status FROM de JOIN ra ON de.doc = ra.doc""")
def parse_checks(spark: SparkSession, d: str) -> DataFrame:
    return E.parse_checks(_normal(spark, d))


_TERMS = lambda x: f"list_distinct(list_filter({S.tokens(x)}, lambda t: length(t) >= 3 AND t NOT IN {S.listed(T.STOPWORDS)}))"
_MODELS = lambda x: f"list_distinct(regexp_extract_all({x}, {S.quoted(T.MODEL)}))"
PAIRS = f"""{C.SEARCHES}, y0 AS (SELECT a.query_id, a.query, c.chunk_id, doc, title, section, c.chunk_type, content, identifier_tokens, page_from, page_to, lx.score, lx.rank
    FROM lx JOIN a ON a.query_id = lx.query_id JOIN c ON c.chunk_id = lx.chunk_id WHERE lx.scope = 'all' AND lx.rank <= 12),
  y1 AS (SELECT *, {_TERMS('query')} AS terms, trim(content) AS evidence, {_MODELS('query')} AS asked, {_MODELS("content || ' ' || array_to_string(identifier_tokens, ' ')")} AS own FROM y0),
  y2 AS (SELECT *, len(list_intersect(terms, {_TERMS('evidence')})) AS shared, [regexp_extract(m, {S.quoted(T.SERIES)}, 1) for m in list_filter(asked, lambda m: regexp_matches(m, {S.quoted(T.SERIES)}) AND regexp_matches(lower(query), '\\b(series|family)\\b'))] AS series FROM y1),
  y3 AS (SELECT *, chunk_type = 'table_record' AND len(asked) > 0 AND len(own) > 0 AND len(list_filter(own, lambda m: list_contains(asked, m) OR len(list_filter(series, lambda s: starts_with(m, s))) > 0)) = 0 AS conflict FROM y2),
  y AS (SELECT *, CASE WHEN conflict THEN 'not_relevant' WHEN shared >= greatest(1, floor(len(terms) / 2)) THEN 'relevant' WHEN shared > 0 THEN 'potentially_relevant' ELSE 'not_relevant' END AS verdict FROM y3),
  z0 AS (SELECT *, CASE verdict WHEN 'relevant' THEN 0 WHEN 'potentially_relevant' THEN 1 END AS kind, max(CASE verdict WHEN 'relevant' THEN 1 WHEN 'potentially_relevant' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_kind FROM y),
  z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(kind, 2), rank) AS place FROM z0 WHERE kind IS NOT NULL OR any_kind = 0) WHERE place <= 8)"""


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(judged hits of the different questions, whose questions they are)."""
    chunks, (analysis, same) = library.written_chunks(spark, d), C._once(spark, d)
    every, wanted = plan.scopes(analysis)
    hits = R.lexical(chunks, wanted.where("scope = 'all'"), every.where("scope = 'all'")).where("rank <= 12").select("query_id", "chunk_id", "score", "rank")
    told = chunks.select("chunk_id", "doc", "title", "section", "chunk_type", "content", "identifier_tokens", "page_from", "page_to").withColumn("context_window", F.lit(None).cast("string"))
    return A.relevance(hits.join(analysis.select("query_id", "query"), "query_id").join(told, "chunk_id")), same


@query(f"WITH {PAIRS} SELECT query_id, chunk_id, rank, verdict FROM y")
def relevance_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return Q.for_all(*_pairs(spark, d)).select("query_id", "chunk_id", "rank", "verdict")


@query(f"WITH {PAIRS} SELECT query_id, chunk_id, place, verdict FROM z")
def prioritised_evidence(spark: SparkSession, d: str) -> DataFrame:
    hits, same = _pairs(spark, d)
    return Q.for_all(A.prioritised(hits), same).select("query_id", "chunk_id", "place", "verdict")


@query(f"""WITH {PAIRS}, an AS (SELECT query_id, '[' || CAST(chunk_id AS STRING) || '] ' || substr(evidence, 1, 700) AS answer FROM z WHERE place = 1), th AS (SELECT DISTINCT query_id, unnest({_TERMS("content || ' ' || section || ' ' || title")}) AS term FROM y WHERE rank <= 5),
  aq AS (SELECT query_id, answer, {_TERMS('answer')} AS terms FROM an) SELECT query_id, answer, len(terms) > 0 AND (SELECT count(*) FROM th WHERE th.query_id = aq.query_id AND list_contains(aq.terms, th.term)) >= CASE WHEN len(terms) <= 3 THEN 1 ELSE greatest(2, least(5, floor(len(terms) / 4))) END AS supported FROM aq""")
def supported_answers(spark: SparkSession, d: str) -> DataFrame:
    hits, same = _pairs(spark, d)
    hits = written(hits, "hits")
    return Q.for_all(A.supported(A.plain_answers(A.prioritised(hits)), hits), same).select("query_id", "answer", "supported")


_VALUES = f"""vals AS (SELECT doc, ordinal AS seq, 'product_models' AS field, m AS value FROM (SELECT doc, ordinal, unnest(regexp_extract_all(text, {S.quoted(T.MODEL)})) AS m FROM b) UNION ALL SELECT doc, ordinal, 'protocol_terms', m FROM (SELECT doc, ordinal, unnest(regexp_extract_all(lower(text), {S.quoted(T.PROTOCOLS)})) AS m FROM b)
  UNION ALL SELECT doc, ordinal, 'menu_labels', m FROM (SELECT doc, ordinal, unnest(regexp_extract_all(text, {S.quoted(T.MENU)})) AS m FROM b) UNION ALL SELECT doc, ordinal, 'companies', 'Warning' FROM b UNION ALL SELECT doc, ordinal, 'devices', substr(text, 1, 24) FROM b UNION ALL SELECT doc, ordinal, 'settings', text FROM b WHERE contains(text, ' Set ') UNION ALL SELECT doc, ordinal, 'part_numbers', 'X_' || CAST(ordinal AS STRING) FROM b)"""
_SRC = r"""lower(trim(regexp_replace('FILENAME:' || chr(10) || doc || '.pdf' || chr(10) || chr(10) || 'TEXT:' || chr(10) || substr(whole, 1, 12000), '\s+', ' ', 'g')))"""
GROUNDED = rf"""b AS ({manuals.BLOCKS_SQL}), {_VALUES}, tx AS (SELECT doc, string_agg(text, chr(10) ORDER BY ordinal) AS whole FROM b GROUP BY doc), so AS (SELECT doc, {_SRC} AS src FROM tx),
  gr AS (SELECT vals.doc, seq, field, trim(value) AS value FROM vals JOIN so ON so.doc = vals.doc WHERE lower(trim(value)) NOT IN {S.listed(M.NO_ENTITY)} AND NOT contains(value, '|') AND NOT (field IN ('companies', 'devices') AND len({S.words('trim(value)')}) > 6) AND NOT (field = 'protocol_terms' AND lower(trim(value)) NOT IN {S.listed(M.PROTOCOLS)})
    AND NOT (field = 'product_models' AND NOT (regexp_matches(value, '\d') AND regexp_matches(value, '[A-Z]{{1,5}}-?[A-Z0-9]'))) AND NOT (field = 'menu_labels' AND NOT (starts_with(trim(value), '[') AND ends_with(trim(value), ']'))) AND NOT (field = 'devices' AND lower(trim(value)) IN (lower(vals.doc), lower(vals.doc || '.pdf')))
    AND NOT (field IN ('part_numbers', 'product_models') AND (contains(value, '_') OR ends_with(lower(trim(value)), '.pdf'))) AND NOT (field = 'settings' AND NOT {S.contains_any('lower(value)', M.SETTING_WORDS)}) AND lower({S.collapsed('value')}) <> '' AND contains(src, lower({S.collapsed('value')}))),
  li AS (SELECT doc, field, list(value ORDER BY seq, value) AS l FROM gr GROUP BY doc, field), fi AS (SELECT doc, field, list_filter(l, lambda v, i: list_position([lower(y) for y in l], lower(v)) = i) AS found FROM li)"""


def _grounded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = manuals.blocks(spark, d)
    whole = blocks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text")).withColumn("filename", F.concat("doc", F.lit(".pdf")))
    one = lambda field, value: F.transform(value, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))
    text = F.col("text")
    fields = {
        "product_models": T.all_matches(text, T.MODEL), "protocol_terms": T.all_matches(F.lower(text), T.PROTOCOLS), "menu_labels": T.menu_labels(text), "companies": F.array(F.lit("Warning")), "devices": F.array(F.substring(text, 1, 24)),
        "settings": F.when(text.contains(" Set "), F.array(text)).otherwise(F.array().cast("array<string>")), "part_numbers": F.array(F.concat(F.lit("X_"), F.col("ordinal").cast("string"))),
    }
    values = blocks.select("doc", F.col("ordinal").alias("seq"), F.inline(F.concat(*(one(f, v) for f, v in fields.items()))))
    sources = written(whole.select("doc", "filename", M.source_of(F.col("filename"), F.col("text")).alias("source")), "sources")
    return M.listed(M.kept(values.join(sources, "doc"))), whole


@query(f"WITH {GROUNDED} SELECT doc, field, len(found) AS n, array_to_string(list_slice(found, 1, 5), '|') AS first_values FROM fi")
def grounded_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d)[0].select("doc", "field", F.size("found").alias("n"), F.array_join(F.slice("found", 1, 5), "|").alias("first_values"))


@query(f"""WITH {GROUNDED}, re AS (SELECT doc, max(CASE WHEN field = 'product_models' THEN found[1] END) AS m FROM fi GROUP BY doc)
  SELECT tx.doc, trim(tx.doc) AS title, 'Acme Controls' AS manufacturer, re.m AS product_model, CASE WHEN contains(src, 'warning') THEN 'Warning' END AS product_family FROM tx JOIN so ON so.doc = tx.doc LEFT JOIN re ON re.doc = tx.doc""")
def resolved_metadata(spark: SparkSession, d: str) -> DataFrame:
    lists, whole = _grounded(spark, d)
    return M.resolved(whole.select("doc", "filename", "text", F.lit("").alias("title"), F.lit(" Acme Controls").alias("manufacturer"), F.lit("none").alias("product_model"), F.lit("Warning").alias("product_family")), lists)
