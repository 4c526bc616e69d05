"""Blocks to nodes and nodes to chunks, over the manuals of the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import sqltext as S
from tessera.catalog.registry import query
from tessera.functions import text as T
from tessera.operators import chunks as C
from tessera.operators import structure as P
from tessera.sources import manuals
from tessera.sources.tables import table

_SPEC = [P.SPECS[0], P.SPECS[1]]


def _odd(x: str) -> str:
    return "(" + " OR ".join([*(S.like(f"lower({x})", p) for p in (T.URL, T.PAGE_MARK, T.PHONE_WORD)), S.like(x, T.PHONE)]) + ")"


def _fits(k: int) -> str:
    return (
        f"(regexp_matches(raw, {S.quoted(_SPEC[k])}) AND len({S.words(f'name{k}')}) <= 8 AND length(value{k}) <= 120 AND lower(name{k}) NOT IN {S.listed(P.NO_SPEC)} AND NOT {_odd(f'name{k}')} AND NOT {_odd(f'value{k}')}"
        rf" AND NOT (contains(name{k}, '/') AND NOT regexp_matches(name{k}, '\d')) AND NOT {S.like(f'lower(value{k})', T.ASSET + '$')})"
    )


_PARTS = ", ".join(f"regexp_replace(regexp_extract(raw, {S.quoted(p)}, 1), '^[ :.\\-]+|[ :.\\-]+$', '', 'g') AS name{k}, trim(regexp_extract(raw, {S.quoted(p)}, 2)) AS value{k}, regexp_extract(raw, {S.quoted(p)}, 3) AS unit{k}" for k, p in enumerate(_SPEC))


def nodes_sql(source: str, doc: str = "doc") -> str:
    """Common table expressions up to n: nodes of blocks (doc, ordinal, page, text)."""
    return rf"""b AS ({source}), k0 AS (SELECT {doc}, ordinal, page, trim(text) AS raw FROM b WHERE trim(text) <> '' AND NOT (trim(text) LIKE '<!--%' AND trim(text) LIKE '%-->') AND NOT {S.like('trim(text)', P.ASSET_NAME)}),
  k1 AS (SELECT *, list_filter([trim(l) for l in string_split(raw, chr(10))], lambda l: l <> '') AS lines, {_PARTS} FROM k0),
  k2 AS (SELECT *, [[trim(c) for c in string_split(trim(l, '|'), '|')] for l in list_filter(lines, lambda l: contains(l, '|'))] AS piped, [list_filter([trim(c) for c in string_split_regex(l, '\s{{2,}}|\t')], lambda c: c <> '') for l in lines] AS spaced FROM k1),
  k3 AS (SELECT *, list_filter(CASE WHEN len(piped) > 0 THEN piped WHEN list_max([len(r) for r in spaced]) >= 2 AND len(list_distinct([len(r) for r in spaced])) <= 2 THEN spaced END, lambda r: len(r) >= 2) AS cut FROM k2),
  k4 AS (SELECT *, CASE WHEN len(lines) >= 2 AND len(cut) >= 2 THEN cut END AS rows0,
    CASE WHEN contains(raw, chr(10)) THEN 0 WHEN {_fits(0)} THEN 1 WHEN {_fits(1)} THEN 2 ELSE 0 END AS spec0 FROM k3),
  k5 AS (SELECT *, CASE WHEN len(regexp_extract_all(raw, '[A-Za-z0-9]')) >= 3 AND ((length(raw) < 120 AND raw = upper(raw)) OR {S.like('raw', P.NUMBERED)}) THEN 'section' WHEN regexp_matches(lower(raw), '^(warning|danger)\b') THEN 'warning'
    WHEN regexp_matches(lower(raw), '^caution\b') THEN 'caution' WHEN regexp_matches(lower(raw), '^(note|notice)\b') THEN 'note' WHEN regexp_matches(raw, '^\d+[.)]\s+') THEN 'procedure_step' WHEN rows0 IS NOT NULL THEN 'table' WHEN spec0 > 0 THEN 'spec' ELSE 'paragraph' END AS kind FROM k4),
  k6 AS (SELECT {doc}, ordinal, page, kind, raw, CASE WHEN kind = 'table' THEN rows0 END AS rows, CASE WHEN kind = 'spec' THEN CASE spec0 WHEN 1 THEN name0 ELSE name1 END END AS spec_name, CASE WHEN kind = 'spec' THEN CASE spec0 WHEN 1 THEN value0 ELSE value1 END END AS spec_value,
    nullif(CASE WHEN kind = 'spec' THEN CASE spec0 WHEN 1 THEN unit0 ELSE unit1 END END, '') AS spec_unit, CASE WHEN kind = 'section' THEN substr(string_split(raw, chr(10))[1], 1, 160) END AS heading FROM k5),
  k7 AS (SELECT *, CASE kind WHEN 'table' THEN array_to_string([array_to_string(r, ' | ') for r in rows], chr(10)) WHEN 'spec' THEN spec_name || ': ' || spec_value || coalesce(' ' || spec_unit, '') ELSE raw END AS text,
    last_value(heading IGNORE NULLS) OVER (PARTITION BY {doc} ORDER BY ordinal, raw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, CASE WHEN kind = 'procedure_step' THEN CAST(regexp_extract(raw, '^(\d+)', 1) AS INTEGER) END AS step FROM k6),
  n AS (SELECT {doc}, ordinal, page, kind, text, heading, section, CASE WHEN kind IN ('warning', 'caution') THEN kind END AS level, step, spec_name, spec_value, spec_unit, rows, CAST(CASE WHEN text <> '' THEN 0.9 ELSE 0.1 END AS DOUBLE) AS citability, len({S.words('text')}) AS n_tokens FROM k7)"""


_LINES = "SELECT doc_id AS doc, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ordinal, CAST(floor((generate_subscripts(l, 1) - 1) / 40) AS BIGINT) + 1 AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"WITH {nodes_sql(_LINES)} SELECT doc, ordinal, page, kind, text, section, n_tokens FROM n")
def blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.nodes(P.lines_of(table(spark, d, "documents"))).select("doc", "ordinal", "page", "kind", "text", "section", "n_tokens")


@query(f"WITH {nodes_sql(manuals.BLOCKS_SQL)} SELECT doc, ordinal, page, kind, text, heading, section, level, coalesce(step, 0) AS step, spec_name, spec_value, spec_unit, coalesce(len(rows), 0) AS n_rows, citability, n_tokens FROM n")
def manual_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = P.nodes(manuals.blocks(spark, d))
    return found.select("doc", "ordinal", "page", "kind", "text", "heading", "section", "level", F.coalesce("step", F.lit(0)).alias("step"), F.col("spec.name").alias("spec_name"), F.col("spec.value").alias("spec_value"), F.col("spec.unit").alias("spec_unit"), F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"), "citability", "n_tokens")


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
NORMALISED = f"""{nodes_sql(manuals.BLOCKS_SQL)}, o0 AS (SELECT * REPLACE (CASE WHEN kind = 'procedure_step' AND step <> 0 AND NOT starts_with({_NORMAL}, CAST(step AS STRING)) THEN CAST(step AS STRING) || '. ' || {_NORMAL} ELSE {_NORMAL} END AS text) FROM n),
  o1 AS (SELECT * REPLACE (CAST(CASE WHEN kind = 'section' THEN citability WHEN kind IN ('warning', 'caution', 'procedure_step', 'spec', 'table') THEN 0.99 ELSE 0.98 END AS DOUBLE) AS citability, CASE WHEN kind = 'section' THEN n_tokens ELSE len({S.words('text')}) END AS n_tokens,
    CASE WHEN kind = 'section' THEN substr(string_split(text, chr(10))[1], 1, 160) END AS heading), {S.keywords('text')} AS keywords FROM o0),
  o AS (SELECT * REPLACE (last_value(heading IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ordinal, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section) FROM o1)"""


@query(f"WITH {NORMALISED} SELECT doc, ordinal, kind, text, section, citability, n_tokens, array_to_string(keywords, '|') AS keywords FROM o")
def normalised_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d).select("doc", "ordinal", "kind", "text", "section", "citability", "n_tokens", F.array_join("keywords", "|").alias("keywords"))


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return P.normalised(P.nodes(manuals.blocks(spark, d)))


_LOW = S.low_information("text", "kind", "(len(keywords) > 0)")
_PROSE = rf"(regexp_matches(lower(text), '\d') OR len(keywords) > 0 OR (contains(text, '[') AND contains(text, ']')) OR {S.contains_any('lower(text)', T.UNIT_MARKS)} OR (n_tokens >= 8 AND {S.contains_any('lower(text)', T.TECHNICAL)}))"
_SIGNAL = f"(NOT {_LOW} AND (kind IN {S.listed(C.STRUCTURED)} OR (kind <> 'section' AND {_PROSE})))"
_PRIORITY = "CAST(CASE WHEN kind IN ('warning', 'caution') THEN 25 WHEN kind = 'spec' THEN 20 WHEN kind = 'procedure_step' THEN 15 WHEN kind = 'table' THEN 10 ELSE 0 END AS DOUBLE)"
USABLE = f"""{NORMALISED}, u AS (SELECT *, coalesce(section, 'Document') AS place, row_number() OVER (PARTITION BY doc, coalesce(section, 'Document') ORDER BY page, ordinal) AS position, {_SIGNAL} AS signal, {_PRIORITY} AS priority,
  CASE WHEN section IS NULL OR section = 'Document' THEN doc ELSE doc || ' | ' || section END AS label FROM o WHERE kind <> 'header_footer' AND (kind = 'section' OR NOT {_LOW}))"""


def _below(parts: str) -> str:
    return f"array_to_string(list_filter([trim(t) for t in {parts}], lambda t: t <> ''), chr(10) || chr(10))"


@query(f"""WITH {USABLE}, c0 AS (SELECT *, {_below("([label] || list(text) OVER (PARTITION BY doc, place ORDER BY position ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))")} AS context FROM u),
  c1 AS (SELECT *, CASE WHEN kind IN ('warning', 'caution') THEN 'warning_record' WHEN kind = 'procedure_step' THEN 'procedure_record' WHEN kind = 'spec' THEN 'spec_record' ELSE 'atomic_text' END AS chunk_type,
    CASE kind WHEN 'warning' THEN 'Warning: ' || text WHEN 'caution' THEN 'Caution: ' || text WHEN 'procedure_step' THEN 'Procedure step ' || CAST(step AS STRING) || ': ' || text ELSE text END AS content FROM c0 WHERE signal AND kind <> 'table'),
  c2 AS (SELECT *, CASE WHEN chunk_type IN ('atomic_text', 'procedure_record') THEN context ELSE content END AS rerank, CASE chunk_type WHEN 'spec_record' THEN 'specification record' || chr(10) || 'specification ' || spec_name WHEN 'procedure_record' THEN 'procedure step' WHEN 'warning_record' THEN 'warning notice' END AS about FROM c1)
  SELECT doc, place, ordinal, chunk_type, page, content, doc || ' | ' || place || coalesce(chr(10) || about, '') || chr(10) || rerank AS sparse, rerank, priority, array_to_string(list_slice(regexp_extract_all(text, {S.quoted(T.MENU)}), 1, 10), '|') AS menu_labels,
    array_to_string(list_slice(regexp_extract_all(text, {S.quoted(T.MEASURES)}), 1, 10), '|') AS unit_tokens,
    array_to_string(list_slice(list_sort(list_distinct(list_filter(keywords, lambda t: regexp_matches(t, '^[A-Za-z0-9]+(?:[-/.][A-Za-z0-9]+)+$') OR regexp_matches(t, '^[A-Za-z]{{2,}}\\d+[A-Za-z0-9-]*$')))), 1, 20), '|') AS identifier_tokens,
    array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), {S.quoted(T.PROTOCOLS)}))), 1, 10), '|') AS protocol_terms FROM c2""")
def atomic_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = C.atomic(_normal(spark, d))
    lists = ["menu_labels", "unit_tokens", "identifier_tokens", "protocol_terms"]
    return found.select(*(c for c in found.columns if c not in lists), *(F.array_join(c, "|").alias(c) for c in lists))


_PAIRS = "array_to_string([headers[i] || ': ' || {r}[i] for i in range(1, least(len(headers), len({r})) + 1)], '; ')"
_LINE = "CASE WHEN len(headers) > 0 AND len(headers) = len(r) THEN " + _PAIRS.replace("{r}", "r") + " ELSE array_to_string(r, ' | ') END"


@query(f"""WITH {USABLE}, t AS (SELECT doc, place, ordinal, list_filter(rows[1], lambda c: c <> '') AS headers, list_filter([list_filter(r, lambda c: c <> '') for r in list_slice(rows, 2, len(rows))], lambda r: len(r) > 0) AS rows FROM u WHERE kind = 'table'),
  g AS (SELECT *, unnest(range(1, CAST(ceil(len(rows) / 4.0) AS BIGINT) + 1)) AS part FROM t), e AS (SELECT doc, place, ordinal, headers, generate_subscripts(rows, 1) AS part, unnest(rows) AS r FROM t WHERE len(rows) <= 12 AND len(headers) >= 2)
  SELECT doc, place, ordinal, 'summary' AS role, 1 AS part, 'Table summary: ' || array_to_string(headers, ' | ') AS content, CAST(10 AS DOUBLE) AS priority FROM t WHERE len(headers) > 0
  UNION ALL SELECT doc, place, ordinal, 'row_group', part, array_to_string([{_LINE} for r in list_slice(rows, (part - 1) * 4 + 1, part * 4)], chr(10)), 10 FROM g
  UNION ALL SELECT doc, place, ordinal, 'key_value', part, {_PAIRS.replace("{r}", "r")}, 12 FROM e WHERE len(r) >= 2""")
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.table_chunks(_normal(spark, d))


_CELL_VALUE = r"(?i)^\s*(?:[±+\-]?\d|from\s+[±+\-]?\d)|\b\d+(?:\.\d+)?\s?(?:v|a|ma|w|kw|µm|μm|um|mm|cm|m|ms|s|hz|khz|mhz|fps|kg|g|n|mpa|deg|c|°c|%)\b"


@query(f"""WITH {nodes_sql(manuals.BLOCKS_SQL)}, r AS (SELECT doc, ordinal, generate_subscripts(rows, 1) - 1 AS row, unnest(rows) AS cells FROM n WHERE kind = 'table'), c AS (SELECT doc, ordinal, row, generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS text FROM r),
  h AS (SELECT c.*, a.text AS above, l.text AS leftmost FROM c LEFT JOIN c a ON a.doc = c.doc AND a.ordinal = c.ordinal AND a.row = 0 AND c.row > 0 AND a.col = c.col LEFT JOIN c l ON l.doc = c.doc AND l.ordinal = c.ordinal AND l.row = c.row AND l.col = 0 AND c.col > 0 AND c.row > 0)
  SELECT doc, ordinal, row, col AS "column", CASE WHEN row = 0 THEN 'column' WHEN col = 0 THEN 'row' ELSE 'value' END AS role, CASE WHEN row = 0 OR col = 0 THEN 'Table header: ' || text || '; Header role: ' || CASE WHEN row = 0 THEN 'column' ELSE 'row' END
    ELSE coalesce('Column headers: ' || nullif(above, '') || '; ', '') || coalesce('Row headers: ' || nullif(leftmost, '') || '; ', '') || 'Cell value: ' || text END || '; Row: ' || CAST(row AS STRING) || '; Column: ' || CAST(col AS STRING) AS content,
    CAST(CASE WHEN row = 0 OR col = 0 THEN 11 ELSE 13 END AS DOUBLE) AS priority FROM h WHERE text <> ''""")
def cell_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.cell_chunks(C.cells_of(P.nodes(manuals.blocks(spark, d)).where("kind = 'table'")))


@query(f"""WITH {USABLE}, s AS (SELECT doc, place, min(label) AS label, count(*) AS n_nodes, sum(n_tokens) AS tokens, bool_or(kind IN ('table', 'procedure_step', 'warning', 'caution')) AS structured, min(page) AS page_from, max(page) AS page_to, max(priority) AS priority,
  list(text ORDER BY position) AS texts FROM u GROUP BY doc, place) SELECT doc, place, n_nodes, page_from, page_to, {_below("([label] || texts)")} AS content, priority FROM s WHERE n_nodes >= 3 OR tokens >= 60 OR structured""")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(_normal(spark, d))


@query(f"""WITH {USABLE}, p AS (SELECT *, row_number() OVER (PARTITION BY doc, place ORDER BY position) - 1 AS rank FROM u WHERE kind = 'procedure_step' AND signal)
  SELECT doc, place, CAST(rank // 4 + 1 AS INTEGER) AS part, count(*) AS n_steps, min(page) AS page_from, max(page) AS page_to, string_agg('Step ' || CAST(coalesce(nullif(step, 0), rank % 4 + 1) AS STRING) || ': ' || text, chr(10) ORDER BY rank) AS content FROM p GROUP BY doc, place, rank // 4 HAVING count(*) >= 2""")
def step_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.step_groups(_normal(spark, d))


@query()
def section_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.windows(_normal(spark, d))


@query()
def consolidated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.consolidated(_normal(spark, d)).select("doc", "ordinal", "page", "kind", "section", "text", "n_tokens", F.array_join("keywords", "|").alias("keywords"))


@query("""SELECT doc_id, CAST(range(1, greatest(CAST(ceil(n_chars / 3000.0) AS BIGINT), 1) + 1, 2)[i] AS BIGINT) AS first_page, least(range(1, greatest(CAST(ceil(n_chars / 3000.0) AS BIGINT), 1) + 1, 2)[i] + 1, greatest(CAST(ceil(n_chars / 3000.0) AS BIGINT), 1)) AS last_page,
  least(1.0, 0.2 + n_chars / greatest(CAST(ceil(n_chars / 3000.0) AS DOUBLE), 1) / 2000) AS quality FROM (SELECT doc_id, n_chars, unnest(range(1, CAST(ceil(greatest(CAST(ceil(n_chars / 3000.0) AS BIGINT), 1) / 2.0) AS BIGINT) + 1)) AS i FROM documents)""")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.greatest(F.ceil(F.col("n_chars") / 3000), F.lit(1)).alias("pages"))
    return P.page_ranges(docs, "pages", 2).select("doc_id", "first_page", "last_page", P.parse_quality(F.col("n_chars"), F.col("pages")).alias("quality"))
