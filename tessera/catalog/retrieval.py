"""Questions and the stages of retrieval over the library, each stage on the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import sqltext as S
from tessera.catalog.registry import query
from tessera.functions import text as T
from tessera.operators import questions as Q
from tessera.operators import retrieval as R
from tessera.plans import retrieve as plan
from tessera.sources import library

_HIT = {name: S.contains_any("low", words) for name, (words, _) in Q.TYPES.items()}
_TYPE_LIST = "[" + ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, hit in _HIT.items()) + "]"
_WANTED = " || ".join([f"CASE WHEN {_HIT[name]} THEN {S.array(chunks)} ELSE CAST([] AS VARCHAR[]) END" for name, (_, chunks) in Q.TYPES.items() if chunks] + [f"CASE WHEN {S.contains_any('low', Q.TABLE_WORDS)} THEN ['table_record'] ELSE CAST([] AS VARCHAR[]) END"])
_KINDS = "CASE " + " ".join(f"WHEN {S.contains_any('low', words)} THEN '{name}'" for name, words in Q.DOCUMENT_KINDS) + " END"
_MAKER = "CASE " + " ".join(f"WHEN contains(low, '{word}') THEN '{name}'" for word, name in Q.MAKERS.items()) + " END"


def _found(pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract(query, {S.quoted(pattern)}, {group}), '')"


ANALYSIS = rf"""q AS ({library.QUESTIONS_SQL}), q0 AS (SELECT query_id, query, lower(query) AS low FROM q),
  q1 AS (SELECT *, list_sort(list_filter({_TYPE_LIST}, lambda t: t IS NOT NULL)) AS types0, list_sort(list_distinct({_WANTED})) AS preferred,
    list_sort(list_distinct(list_filter(regexp_extract_all(low, '[a-z0-9][a-z0-9\-/.]*'), lambda t: length(t) >= 2 OR regexp_matches(t, '\d') OR t IN ('x', 'y', 'z')))) AS terms, [trim(m) for m in regexp_extract_all(query, {S.quoted(T.MENU)})] AS menu,
    {_MAKER} AS manufacturer, CASE WHEN regexp_matches({_found(Q.MODEL)}, '\d') THEN {_found(Q.MODEL)} END AS product_model, {_found(Q.PART)} AS part_number, {_found(Q.ERROR)} AS error0, {_KINDS} AS document_kind, {S.contains_any('low', Q.LATEST)} AS latest_only,
    CASE WHEN {_HIT['revision_history']} THEN 'true' END AS version_signal FROM q0),
  a AS (SELECT * EXCLUDE (types0, error0), CASE WHEN len(types0) > 0 THEN types0 ELSE ['general'] END AS query_types, CASE WHEN product_model IS NULL THEN upper({_found(Q.FAMILY, 1)}) END AS product_family, CASE WHEN part_number IS NULL THEN error0 END AS error_code,
    CASE CAST(product_model IS NOT NULL AS INTEGER) + CAST(error0 IS NOT NULL AS INTEGER) + CAST(manufacturer IS NOT NULL AS INTEGER) WHEN 0 THEN 'loose' WHEN 1 THEN 'balanced' ELSE 'strict' END AS strictness, {S.variants('terms')} AS query_terms FROM q1)"""


def _analysis(spark: SparkSession, d: str) -> DataFrame:
    return Q.analysed(library.questions(spark, d))


def _once(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return plan.once(library.questions(spark, d))


@query(f"""WITH {ANALYSIS} SELECT query_id, array_to_string(query_types, '|') AS query_types, array_to_string(terms, '|') AS terms, array_to_string(query_terms, '|') AS query_terms, array_to_string(preferred, '|') AS preferred, array_to_string(menu, '|') AS menu,
  product_family, product_model, part_number, error_code, document_kind, latest_only, version_signal, strictness FROM a""")
def question_analysis(spark: SparkSession, d: str) -> DataFrame:
    found = _analysis(spark, d)
    lists = ["query_types", "terms", "query_terms", "preferred", "menu"]
    return found.select("query_id", *(F.array_join(c, "|").alias(c) for c in lists), "product_family", "product_model", "part_number", "error_code", "document_kind", "latest_only", "version_signal", "strictness")


FILTERS = """e AS (SELECT query_id, 'document_kind' AS key, [document_kind] AS vals FROM a WHERE document_kind IS NOT NULL UNION ALL SELECT query_id, 'product_models', [product_model] FROM a WHERE product_model IS NOT NULL
  UNION ALL SELECT query_id, 'product_families', [product_family] FROM a WHERE product_family IS NOT NULL UNION ALL SELECT query_id, 'manufacturer', [manufacturer] FROM a WHERE manufacturer IS NOT NULL
  UNION ALL SELECT query_id, 'part_numbers', [part_number] FROM a WHERE part_number IS NOT NULL AND part_number IS DISTINCT FROM product_model UNION ALL SELECT query_id, 'version_signal', [version_signal] FROM a WHERE version_signal IS NOT NULL
  UNION ALL SELECT query_id, 'menu_labels', menu FROM a WHERE len(menu) > 0 UNION ALL SELECT query_id, 'is_active', ['true'] FROM a)"""


@query(f"WITH {ANALYSIS}, {FILTERS} SELECT query_id, key, array_to_string(vals, '|') AS filter_values FROM e")
def question_filters(spark: SparkSession, d: str) -> DataFrame:
    return Q.filters(_analysis(spark, d)).select("query_id", "key", F.array_join("values", "|").alias("filter_values"))


def _any(types: list[str]) -> str:
    return f"list_has_any(query_types, {S.array(types)})"


_ROUTE_LIST = "[" + ", ".join(
    ["CASE WHEN len(preferred) > 0 THEN array_to_string(preferred, ',') || ';;' END"]
    + [f"CASE WHEN {_any(types)} THEN '{','.join(chunks)};{'true' if types == ['revision_history'] else ''};' END" for types, chunks in Q.ROUTES]
    + ["CASE WHEN error_code IS NOT NULL THEN ';;' || error_code END"]
) + "]"
ROUTES = f"w0 AS (SELECT query_id, list_filter({_ROUTE_LIST}, lambda r: r IS NOT NULL) AS l FROM a), w1 AS (SELECT query_id, {S.first_distinct('l')} AS l FROM w0), w AS (SELECT query_id, generate_subscripts(l, 1) - 1 AS route, unnest(l) AS name FROM w1)"


@query(f"WITH {ANALYSIS}, {ROUTES} SELECT query_id, route, name FROM w")
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.coalesce(F.array_join("chunk_types", ","), F.lit("")), F.coalesce("version_signal", F.lit("")), F.coalesce("keyword", F.lit(""))]
    return Q.routes(_analysis(spark, d)).select("query_id", "route", F.concat_ws(";", *parts).alias("name"))


_SPLIT = "list_filter(string_split({0}, '|'), lambda x: x <> '')"
CHUNKS = f"c AS (SELECT * REPLACE (CAST(priority AS DOUBLE) AS priority), {_SPLIT.format('menu')} AS menu_labels, {_SPLIT.format('identifiers')} AS identifier_tokens, {_SPLIT.format('protocols')} AS protocol_terms, {_SPLIT.format('models')} AS product_models FROM ({library.CHUNKS_SQL}))"


@query(f"""WITH {ANALYSIS}, {FILTERS}, {CHUNKS}, x AS (SELECT query_id, key, vals FROM e WHERE key IN ('version_signal', 'product_models', 'menu_labels'))
  SELECT DISTINCT x.query_id, c.chunk_id FROM c, (SELECT DISTINCT query_id FROM x) x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.query_id = x.query_id
    AND NOT CASE y.key WHEN 'version_signal' THEN list_contains(y.vals, c.version_signal) WHEN 'product_models' THEN list_has_any(y.vals, c.product_models) ELSE list_has_any(y.vals, c.menu_labels) END)""")
def filtered_chunks(spark: SparkSession, d: str) -> DataFrame:
    wanted = Q.filters(_analysis(spark, d)).where("key in ('version_signal', 'product_models', 'menu_labels')")
    rows = library.chunks(spark, d).select("chunk_id", "version_signal", "product_models", "menu_labels")
    return Q.matches(rows, wanted, "chunk_id", ["product_models", "menu_labels"])


_ABOUT = "array_to_string(product_models || [chunk_type], ' ')"
_ALL = f"title || chr(10) || title || chr(10) || section || chr(10) || content || chr(10) || content || chr(10) || array_to_string(product_models || [chunk_type] || identifier_tokens || menu_labels || protocol_terms, ' ')"
_STRUCTURED = S.listed(R.STRUCTURED)
SCOPES = f"""{ROUTES}, wn AS (SELECT DISTINCT query_id, string_split(name, ';')[1] AS types, string_split(name, ';')[2] AS version FROM w WHERE string_split(name, ';')[3] = ''),
  sc AS (SELECT 'all' AS scope, NULL AS types, '' AS version UNION ALL SELECT 'table', 'table_record', '' UNION ALL SELECT DISTINCT types || '|' || version, types, version FROM wn),
  qs AS (SELECT query_id, query, 'all' AS scope FROM a UNION ALL SELECT query_id, query, 'table' FROM a UNION ALL SELECT a.query_id, query, types || '|' || version FROM a JOIN wn ON a.query_id = wn.query_id)"""
LEXICAL = f"""p0 AS (SELECT chunk_id, chunk_type, version_signal, {S.tokens(_ALL)} AS words, {S.tokens('content')} AS ct, {S.tokens('title')} AS tt, {S.tokens('section')} AS st, {S.tokens(_ABOUT)} AS mt FROM c),
  p1 AS (SELECT *, unnest(words) AS token FROM p0),
  p2 AS (SELECT chunk_id, chunk_type, version_signal, len(words) AS length, token, count(*) AS tf, any_value(CASE WHEN list_contains(ct, token) THEN 0.035e0 ELSE 0 END + CASE WHEN list_contains(tt, token) THEN 0.03e0 ELSE 0 END + CASE WHEN list_contains(st, token) THEN 0.025e0 ELSE 0 END
    + CASE WHEN list_contains(mt, token) THEN 0.04e0 ELSE 0 END) AS bonus FROM p1 GROUP BY chunk_id, chunk_type, version_signal, len(words), token),
  p AS (SELECT p2.*, scope FROM p2 JOIN sc ON (sc.types IS NULL OR list_contains(string_split(sc.types, ','), chunk_type)) AND (sc.version = '' OR sc.version = version_signal)),
  ps AS (SELECT DISTINCT scope, chunk_id, chunk_type, length FROM p), pt AS (SELECT scope, count(*) AS n, avg(length) AS mean FROM ps GROUP BY scope), pd AS (SELECT scope, token, count(*) AS df FROM p GROUP BY scope, token),
  qt AS (SELECT query_id, scope, token, count(*) AS times FROM (SELECT query_id, scope, unnest({S.tokens('query')}) AS token FROM qs) GROUP BY ALL),
  m AS (SELECT qt.query_id, qt.scope, p.chunk_id, any_value(p.chunk_type) AS chunk_type, sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / mean)) + bonus) AS score
    FROM qt JOIN p ON p.scope = qt.scope AND p.token = qt.token JOIN pd ON pd.scope = p.scope AND pd.token = p.token JOIN pt ON pt.scope = p.scope GROUP BY qt.query_id, qt.scope, p.chunk_id),
  mf AS (SELECT query_id, scope, chunk_id, score + CASE WHEN chunk_type IN {_STRUCTURED} THEN 0.03e0 ELSE 0 END AS score FROM m
    UNION ALL SELECT z.query_id, z.scope, ps.chunk_id, 0.03e0 FROM (SELECT DISTINCT query_id, scope FROM qt) z JOIN ps ON ps.scope = z.scope WHERE ps.chunk_type IN {_STRUCTURED} AND NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = z.query_id AND m.scope = z.scope AND m.chunk_id = ps.chunk_id)),
  lx AS (SELECT r.query_id, r.scope, r.chunk_id, r.score + c.priority / 100 AS score, r.rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM mf) r JOIN c ON c.chunk_id = r.chunk_id WHERE rank <= 40)"""
HASHED = f"""hc0 AS (SELECT chunk_id, chunk_type, unnest({S.tokens('content')}) AS token FROM c), hc1 AS (SELECT chunk_id, chunk_type, @SLOT@ AS slot, count(*) AS n FROM hc0 GROUP BY ALL), hc AS (SELECT *, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY chunk_id) AS DOUBLE)) AS v FROM hc1),
  hq0 AS (SELECT query_id, unnest({S.tokens('query')}) AS token FROM a), hq1 AS (SELECT query_id, @SLOT@ AS slot, count(*) AS n FROM hq0 GROUP BY ALL), hq AS (SELECT *, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY query_id) AS DOUBLE)) AS v FROM hq1),
  hs AS (SELECT query_id, chunk_id, any_value(chunk_type) AS chunk_type, sum(hc.v * hq.v) AS score FROM hc JOIN hq ON hc.slot = hq.slot GROUP BY query_id, chunk_id),
  hd AS (SELECT r.query_id, r.chunk_id, r.score + c.priority / 100 AS score, r.rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM hs) r JOIN c ON c.chunk_id = r.chunk_id WHERE rank <= 40),
  ht AS (SELECT r.query_id, r.chunk_id, r.score + c.priority / 100 AS score, r.rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM hs WHERE chunk_type = 'table_record') r JOIN c ON c.chunk_id = r.chunk_id WHERE rank <= 40)"""


def _slot_sql() -> str:
    from tessera.catalog.texts import _SLOT

    return _SLOT.replace("17296", str((1 << 32) % 50000))


def _fusion(name: str, lists: str, limit: int) -> str:
    return (
        f"{name}0 AS ({lists}), {name}1 AS (SELECT query_id, chunk_id, sum(1.0e0 / (60 + rank)) AS fusion, max(score) AS best, min(list * 100000 + rank) AS place, count(*) AS n_lists FROM {name}0 GROUP BY query_id, chunk_id),"
        f" {name} AS (SELECT query_id, chunk_id, fusion AS score, best, n_lists, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 10) DESC, place, chunk_id) AS rank FROM {name}1) WHERE rank <= {limit})"
    )


SEARCHES = f"{ANALYSIS}, {CHUNKS}, {SCOPES}, {LEXICAL}, {HASHED.replace('@SLOT@', _slot_sql())}"
_TABLE_LISTS = "SELECT query_id, chunk_id, score, rank, 0 AS list FROM ht UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM lx WHERE scope = 'table'"
_LISTS = "SELECT query_id, chunk_id, score, rank, 0 AS list FROM hd UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM lx WHERE scope = 'all' UNION ALL SELECT query_id, chunk_id, score, rank, 2 FROM ft UNION ALL SELECT query_id, chunk_id, score, rank, 3 FROM sp"
#: Each route's two lists fused, then routes end to end.
SPECIAL = """wr AS (SELECT query_id, route, string_split(name, ';')[1] AS types, string_split(name, ';')[2] AS version FROM w WHERE string_split(name, ';')[3] = ''),
  sp0 AS (SELECT wr.query_id, wr.route, c.chunk_id, sum(hc.v * hq.v) AS score FROM wr JOIN c ON list_contains(string_split(wr.types, ','), c.chunk_type) AND (wr.version = '' OR wr.version = c.version_signal)
    JOIN hc ON hc.chunk_id = c.chunk_id JOIN hq ON hq.query_id = wr.query_id AND hq.slot = hc.slot GROUP BY ALL),
  sp1 AS (SELECT r.query_id, r.route, r.chunk_id, r.score + c.priority / 100 AS score, r.rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM sp0) r JOIN c ON c.chunk_id = r.chunk_id WHERE rank <= 40),
  sp2 AS (SELECT query_id, route, chunk_id, score, rank, 0 AS list FROM sp1 UNION ALL SELECT wr.query_id, wr.route, lx.chunk_id, lx.score, lx.rank, 1 FROM wr JOIN lx ON lx.query_id = wr.query_id AND lx.scope = wr.types || '|' || wr.version),
  sp3 AS (SELECT query_id, route, chunk_id, sum(1.0e0 / (60 + rank)) AS score, min(list * 100000 + rank) AS first FROM sp2 GROUP BY query_id, route, chunk_id),
  sp4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY round(score, 10) DESC, first, chunk_id) AS rank FROM sp3) WHERE rank <= 40),
  sp AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY route, rank) AS rank FROM sp4)"""
FUSED = f"{SEARCHES}, {_fusion('ft', _TABLE_LISTS, 40)}, {SPECIAL}, {_fusion('fu', _LISTS, 30)}"


@query(f"WITH {SEARCHES} SELECT query_id, scope, chunk_id, round(score, 6) AS score, rank FROM lx")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    analysis, same = _once(spark, d)
    every, wanted = plan.scopes(analysis)
    found = R.lexical(library.written_chunks(spark, d), wanted, every)
    return Q.for_all(found, same).select("query_id", "scope", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {SEARCHES} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hd")
def hashed_search(spark: SparkSession, d: str) -> DataFrame:
    analysis, same = _once(spark, d)
    every, wanted = plan.scopes(analysis)
    found = R.hashed(library.written_chunks(spark, d), wanted.where("scope = 'all'"), every.where("scope = 'all'"))
    return Q.for_all(found, same).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(score, 6) AS score, round(best, 6) AS best, n_lists, rank FROM fu")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    chunks, (analysis, same) = library.written_chunks(spark, d), _once(spark, d)
    found = Q.for_all(R.fused(plan.candidates(chunks, analysis)), same)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"), "n_lists", "rank")


def _within(text: str) -> str:
    return f"len(list_filter(query_terms, lambda t: contains({text}, t))) > 0"


_STRUCTURE, _NARRATIVE = _any(Q.STRUCTURE_TYPES), _any(Q.NARRATIVE_TYPES)
_RECORDS, _PROSE = S.listed(R.RECORDS), S.listed(R.PROSE)
_ADJUSTMENT = f"""(CASE WHEN {_any(['spec_lookup'])} THEN CASE WHEN chunk_type IN {_RECORDS} THEN 0.06e0 WHEN chunk_type = 'atomic_text' THEN -0.01e0 ELSE 0 END ELSE 0 END
  + CASE WHEN {_any(['how_to', 'configuration'])} THEN CASE chunk_type WHEN 'procedure_record' THEN 0.06e0 WHEN 'section_window' THEN 0.03e0 ELSE 0 END ELSE 0 END + CASE WHEN {_any(['comparison', 'compatibility'])} AND chunk_type IN {_RECORDS} THEN 0.04e0 ELSE 0 END
  + CASE WHEN {_any(['revision_history'])} AND c_version = 'true' THEN 0.05e0 ELSE 0 END + CASE WHEN len(menu_labels) > 0 AND {_within("lower(array_to_string(menu_labels, ' '))")} THEN 0.03e0 ELSE 0 END + CASE WHEN list_has_any(protocol_terms, query_terms) THEN 0.03e0 ELSE 0 END
  + CASE WHEN len(identifier_tokens) > 0 AND {_within("lower(array_to_string(identifier_tokens, ' '))")} THEN 0.02e0 ELSE 0 END + CASE WHEN len(product_models) > 0 AND {_within("lower(array_to_string(product_models, ' '))")} THEN 0.02e0 ELSE 0 END
  + CASE WHEN {_NARRATIVE} AND NOT {_STRUCTURE} THEN CASE WHEN chunk_type IN {_PROSE} THEN 0.03e0 WHEN chunk_type IN {_RECORDS} THEN -0.05e0 ELSE 0 END ELSE 0 END + CASE WHEN chunk_type = 'atomic_text' AND len({S.words('content')}) <= 3 THEN -0.04e0 ELSE 0 END)"""
TOLD = f"""{FUSED}, to0 AS (SELECT fu.query_id, fu.chunk_id, fu.score, fu.rank, c.* EXCLUDE (chunk_id, version_signal), c.version_signal AS c_version, a.query_types, a.query_terms, a.latest_only FROM fu JOIN c ON c.chunk_id = fu.chunk_id JOIN a ON a.query_id = fu.query_id),
  fs AS (SELECT * EXCLUDE (score, rank, score1), score1 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score1, 10) DESC, chunk_id) AS rank FROM (SELECT *, score + {_ADJUSTMENT} AS score1 FROM to0)),
  cs AS (SELECT * REPLACE (score + 0.05e0 * completeness AS score) FROM (SELECT *, {S.completeness('content', 'chunk_type')} AS completeness, CASE WHEN chunk_type IN ('spec_record', 'datasheet_record') THEN 'spec' WHEN chunk_type = 'table_record' THEN 'table' WHEN chunk_type = 'procedure_record' THEN 'procedure'
    WHEN chunk_type IN ('section_window', 'parent_section') THEN 'context' ELSE 'prose' END AS family FROM fs))"""


def _told(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits of the different questions, chunks, whose questions they are)."""
    chunks, (analysis, same) = library.written_chunks(spark, d), _once(spark, d)
    return plan.told(R.fused(plan.candidates(chunks, analysis)), chunks, analysis), chunks, same


@query(f"WITH {TOLD} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM fs")
def family_scores(spark: SparkSession, d: str) -> DataFrame:
    told, _, same = _told(spark, d)
    return Q.for_all(R.family_scored(told), same).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {TOLD} SELECT query_id, chunk_id, round(score, 6) AS score, round(completeness, 4) AS completeness, family, rank FROM cs")
def completeness_scores(spark: SparkSession, d: str) -> DataFrame:
    told, _, same = _told(spark, d)
    return Q.for_all(R.completed(R.family_scored(told)), same).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("completeness", 4).alias("completeness"), "family", "rank")


def _alignment(rerank: str) -> str:
    own = {c: S.variants(S.tokens(c)) for c in ("content", "title", "section")} | {"rerank": S.variants(S.tokens(rerank))}
    n = {c: f"len(list_intersect(query_terms, {t}))" for c, t in own.items()}
    return (
        f"CASE WHEN len(query_terms) = 0 THEN 0e0 ELSE {n['content']} * 0.045e0 + {n['title']} * 0.015e0 + {n['section']} * 0.025e0 + {n['rerank']} * 0.02e0 - CASE WHEN len(query_terms) >= 2 AND {n['content']} = 0 AND {n['rerank']} <= 1 THEN 0.04e0 ELSE 0 END"
        f" + CASE WHEN len(query_terms) >= 3 AND greatest({n['content']}, {n['rerank']}) >= 3 THEN 0.03e0 ELSE 0 END + CASE WHEN {_any(['spec_lookup'])} AND list_contains(query_terms, 'laser') AND chunk_type IN ('spec_record', 'warning_record')"
        f" AND len(list_intersect({S.array(R.LASER)}, list_distinct({own['content']} || {own['rerank']}))) >= 2 THEN 0.18e0 ELSE 0 END END"
    )


def _choice(k: int) -> str:
    return "CASE " + " ".join(f"WHEN {_any(entry[0])} THEN {S.array(entry[k])}" for entry in Q.FAMILIES) + f" ELSE {S.array(Q.OTHER_FAMILIES[k - 1])} END"


SELECTED = f"""{TOLD}, al AS (SELECT * EXCLUDE (score, rank, score1), score1 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score1, 10) DESC, chunk_id) AS rank FROM (SELECT *, score + {_alignment('rerank')} AS score1 FROM cs)),
  s0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, family ORDER BY rank) AS in_family, coalesce(list_position({_choice(1)}, family), 0) AS wish, list_contains({_choice(2)}, family) AS allowed FROM al),
  s1 AS (SELECT *, list_sort(list_distinct(list(CASE WHEN allowed AND wish > 0 THEN wish END) OVER (PARTITION BY query_id))) AS wishes0 FROM s0), s2 AS (SELECT *, list_filter(wishes0, lambda x: x IS NOT NULL) AS wishes FROM s1),
  s3 AS (SELECT *, CASE WHEN query_types = ['general'] AND rank <= 3 THEN 0 WHEN allowed AND wish > 0 AND wish = wishes[1] AND in_family <= 12 THEN 1 WHEN allowed AND wish > 0 AND wish = wishes[2] AND in_family <= 6 THEN 2 WHEN len(wishes) = 0 AND query_types <> ['general'] AND rank <= 12 THEN 3 END AS part FROM s2),
  sf AS (SELECT * EXCLUDE (rank, rank1, in_family, wish, allowed, wishes0, wishes, part), rank1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank1 FROM s3 WHERE part IS NOT NULL) WHERE rank1 <= 12)"""


@query(f"WITH {SELECTED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM al")
def query_alignment(spark: SparkSession, d: str) -> DataFrame:
    told, _, same = _told(spark, d)
    return Q.for_all(R.aligned(R.completed(R.family_scored(told))), same).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _selected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    told, chunks, same = _told(spark, d)
    return R.family_selected(R.aligned(R.completed(R.family_scored(told)))), chunks, same


@query(f"WITH {SELECTED} SELECT query_id, chunk_id, family, round(score, 6) AS score, rank FROM sf")
def family_selection(spark: SparkSession, d: str) -> DataFrame:
    selected, _, same = _selected(spark, d)
    return Q.for_all(selected, same).select("query_id", "chunk_id", "family", F.round("score", 6).alias("score"), "rank")


ENRICHED = f"""{SELECTED}, cx AS (SELECT doc, section, arg_min(content, chunk_id) FILTER (WHERE level = 2 AND chunk_type = 'section_window') AS context_window, arg_min(content, chunk_id) FILTER (WHERE level = 3 AND chunk_type = 'parent_section') AS parent_context FROM c WHERE level IN (2, 3) GROUP BY doc, section),
  e0 AS (SELECT sf.*, cx.context_window, cx.parent_context FROM sf LEFT JOIN cx ON cx.doc = sf.doc AND cx.section = sf.section),
  en AS (SELECT * REPLACE (rerank || CASE WHEN chunk_type = 'atomic_text' AND context_window <> rerank THEN chr(10) || chr(10) || context_window ELSE '' END
    || CASE WHEN parent_context IS NOT NULL AND (({_any(['revision_history'])} AND chunk_type <> 'spec_record' AND NOT (chunk_type = 'atomic_text' AND context_window IS NOT NULL)) OR chunk_type IN ('procedure_record', 'table_record')) THEN chr(10) || chr(10) || parent_context ELSE '' END AS rerank) FROM e0)"""
RERANKED = f"""{ENRICHED}, r0 AS (SELECT *, CAST(len(list_intersect(query_terms, {S.variants(S.tokens('rerank'))})) AS DOUBLE) / greatest(len(query_terms), 1) AS rerank_score, {_alignment('rerank')} AS alignment FROM en),
  r1 AS (SELECT *, greatest(CASE WHEN rerank_score = 0 THEN score ELSE rerank_score END + score * 0.35e0 + alignment * 7, CASE WHEN alignment >= 0.1 THEN score + alignment * 7 END) AS score1, bool_or(alignment > 0) OVER (PARTITION BY query_id) AS any_aligned FROM r0),
  rr AS (SELECT * EXCLUDE (score, rank, score1, rank1), score1 AS score, rank1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score1, 10) DESC, chunk_id) AS rank1 FROM r1 WHERE NOT (len(query_terms) >= 2 AND any_aligned) OR alignment > 0) WHERE rank1 <= 12)"""


@query(f"WITH {ENRICHED} SELECT query_id, chunk_id, rank, rerank, context_window, parent_context FROM en")
def rerank_context(spark: SparkSession, d: str) -> DataFrame:
    selected, chunks, same = _selected(spark, d)
    return Q.for_all(R.enriched(selected, chunks), same).select("query_id", "chunk_id", "rank", "rerank", "context_window", "parent_context")


@query(f"WITH {RERANKED} SELECT query_id, chunk_id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score, rank FROM rr")
def reranked_hits(spark: SparkSession, d: str) -> DataFrame:
    selected, chunks, same = _selected(spark, d)
    return Q.for_all(R.reranked(R.enriched(selected, chunks)), same).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"), "rank")


_TERMS = lambda x: f"list_sort(list_distinct(list_filter({S.tokens(x)}, lambda t: length(t) >= 3 AND t NOT IN {S.listed(T.STOPWORDS)})))"
_LISTED = lambda signal: f"SELECT doc, value FROM (SELECT doc, value, row_number() OVER (PARTITION BY doc ORDER BY min(place), min(pos)) AS r FROM (SELECT doc, chunk_id AS place, generate_subscripts({signal}, 1) AS pos, unnest({signal}) AS value FROM c) GROUP BY doc, value) WHERE r <= 200"
DOCUMENTS = f"""dv AS ({" UNION ALL ".join(_LISTED(s) for s in ("product_models", "protocol_terms", "menu_labels", "identifier_tokens"))}), dl AS (SELECT doc, array_to_string(list_sort(list(value)), ' ') AS signals FROM dv GROUP BY doc),
  dd AS (SELECT t.doc, t.title || chr(10) || t.title || chr(10) || t.doc || coalesce(chr(10) || signals, '') AS content FROM (SELECT doc, min(title) AS title FROM c GROUP BY doc) t LEFT JOIN dl ON dl.doc = t.doc),
  d0 AS (SELECT doc, unnest({S.tokens('content')}) AS token FROM dd), d1 AS (SELECT doc, @SLOT@ AS slot, count(*) AS n FROM d0 GROUP BY ALL), d2 AS (SELECT *, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc) AS DOUBLE)) AS v FROM d1),
  de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc) AS rank FROM (SELECT query_id, doc, sum(d2.v * hq.v) AS score FROM d2 JOIN hq ON hq.slot = d2.slot GROUP BY query_id, doc)),
  t0 AS (SELECT doc, token, count(*) AS tf FROM d0 GROUP BY ALL), tl AS (SELECT doc, count(*) AS length FROM d0 GROUP BY doc), tn AS (SELECT count(*) AS n, avg(length) AS mean FROM tl), td AS (SELECT token, count(*) AS df FROM t0 GROUP BY token), tq AS (SELECT query_id, token, count(*) AS times FROM hq0 GROUP BY ALL),
  dp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc) AS rank FROM (SELECT query_id, t0.doc, sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / mean))) AS score
    FROM tq JOIN t0 ON t0.token = tq.token JOIN tl ON tl.doc = t0.doc JOIN td ON td.token = t0.token, tn GROUP BY query_id, t0.doc)),
  du AS (SELECT query_id, doc, rank, 'metadata_dense' AS stage FROM de WHERE rank <= 20 UNION ALL SELECT query_id, doc, rank, 'metadata_sparse' FROM dp WHERE rank <= 20),
  ds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc) AS rank FROM (SELECT query_id, doc, sum(1.0e0 / (60 + rank)) AS score, string_agg(stage, '+' ORDER BY stage) AS stages FROM du GROUP BY query_id, doc)) WHERE rank <= 5)""".replace("@SLOT@", _slot_sql())


@query(f"WITH {SEARCHES}, {DOCUMENTS} SELECT query_id, doc, round(score, 6) AS score, stages, rank FROM ds")
def document_selection(spark: SparkSession, d: str) -> DataFrame:
    analysis, same = _once(spark, d)
    found = R.documents_chosen(library.written_chunks(spark, d), analysis.select("query_id", "query"))
    return Q.for_all(found, same).select("query_id", "doc", F.round("score", 6).alias("score"), "stages", "rank")


@query(f"""WITH {RERANKED}, {DOCUMENTS}, dj AS (SELECT query_id, string_agg(doc, '|' ORDER BY rank) AS documents FROM ds GROUP BY query_id)
  SELECT rr.query_id, rr.rank, chunk_id, round(score, 6) AS score, chunk_type, CASE WHEN regexp_matches(rr.section, '[A-Za-z0-9].*[A-Za-z0-9].*[A-Za-z0-9]') THEN context_window END AS context_window,
  CASE WHEN regexp_matches(rr.section, '[A-Za-z0-9].*[A-Za-z0-9].*[A-Za-z0-9]') THEN parent_context END AS parent_context, documents FROM rr LEFT JOIN dj ON dj.query_id = rr.query_id WHERE rr.rank <= 10""")
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    found = plan.retrieve(library.written_chunks(spark, d), library.questions(spark, d))
    return found.withColumn("score", F.round("score", 6)).withColumn("documents", F.array_join("documents", "|"))
