"""Text functions over documents, pages, questions and manuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import sqltext as S
from tessera.catalog.registry import query
from tessera.functions import text as T
from tessera.sources import library, manuals
from tessera.sources.tables import table

_M = f"m AS ({manuals.BLOCKS_SQL})"
_Q = f"q AS ({library.QUESTIONS_SQL})"


@query(f"SELECT doc_id, len({S.tokens('text')}) AS n_tokens, len(list_distinct({S.tokens('text')})) AS n_distinct FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


@query(f"""WITH {_M}, {_Q}, b AS (SELECT 'm' || CAST(doc AS STRING) || ':' || CAST(ordinal AS STRING) AS id, text FROM m UNION ALL SELECT 'q' || CAST(query_id AS STRING), query FROM q)
  SELECT id, array_to_string({S.eval_tokens('text')}, ' ') AS eval_tokens, array_to_string(list_sort(list_distinct(list_filter({S.tokens('text')}, lambda t: length(t) >= 3 AND t NOT IN {S.listed(T.STOPWORDS)}))), ' ') AS answer_terms,
  array_to_string({S.variants(S.tokens('text'))}, ' ') AS variants, lower({S.collapsed('text')}) AS folded, substr({S.collapsed('text')}, 1, 20) AS preview FROM b""")
def token_views(spark: SparkSession, d: str) -> DataFrame:
    rows = manuals.blocks(spark, d).select(F.concat(F.lit("m"), "doc", F.lit(":"), F.col("ordinal").cast("string")).alias("id"), "text")
    rows = rows.unionByName(library.questions(spark, d).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), F.col("query").alias("text")))
    text = F.col("text")
    joined = lambda c: F.array_join(c, " ")
    return rows.select("id", joined(T.eval_tokens(text)).alias("eval_tokens"), joined(T.answer_terms(text)).alias("answer_terms"), joined(T.variants(T.tokens(text))).alias("variants"), T.folded(text).alias("folded"), T.preview(text, 20).alias("preview"))


_FORMS = "flatten([[t, replace(t, '-', ''), replace(t, '/', ' '), replace(t, '.', ' '), replace(t, '-', ' ')] for t in " + S.tokens(S.collapsed("text")) + "])"


@query(f"""WITH {_M}, f AS (SELECT doc, ordinal, {S.collapsed('text')} AS compact, list_filter([{S.collapsed('v')} for v in {_FORMS}], lambda v: length(v) >= 2) AS forms FROM m),
  e AS (SELECT doc, ordinal, compact, {S.first_distinct('forms')} AS forms FROM f) SELECT doc, ordinal, CASE WHEN len(forms) > 0 THEN compact || chr(10) || chr(10) || 'Search terms: ' || array_to_string(forms, ' | ') ELSE compact END AS search_text FROM e""")
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    return manuals.blocks(spark, d).select("doc", "ordinal", T.search_text(F.col("text")).alias("search_text"))


@query(f"""WITH c AS (SELECT doc_id, {S.collapsed('text')} AS t FROM documents), h AS (SELECT doc_id, t, substr(t, 1, 6000) AS head FROM c)
  SELECT doc_id, length(CASE WHEN length(t) <= 6000 THEN t ELSE trim(CASE WHEN strpos(reverse(head), ' ') > 0 AND 6000 - strpos(reverse(head), ' ') > 4200 THEN substr(head, 1, 6000 - strpos(reverse(head), ' ')) ELSE head END) END) AS n_clipped FROM h""")
def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(T.clipped(F.col("text"))).alias("n_clipped"))


def _part(at: int) -> str:
    return f"CAST('0x' || substr(md5(token), {at}, 8) AS BIGINT)"


_SLOT = f"((({_part(1)} % 50000 * 17296 + {_part(9)}) % 50000 * 17296 + {_part(17)}) % 50000 * 17296 + {_part(25)}) % 50000"


@query(f"""WITH {_Q}, t AS (SELECT query_id, unnest({S.tokens('query')}) AS token FROM q), c AS (SELECT query_id, {_SLOT.replace('17296', str((1 << 32) % 50000))} AS slot, count(*) AS n FROM t GROUP BY 1, 2)
  SELECT query_id, slot, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY query_id) AS DOUBLE)), 6) AS value FROM c""")
def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.retrieval import hashed_vectors

    return hashed_vectors(library.questions(spark, d), "query_id", F.col("query")).select("query_id", "slot", F.round("value", 6).alias("value"))


@query(f"WITH {_M} SELECT doc, ordinal, array_to_string({S.keywords('text')}, '|') AS keywords, array_to_string(list_slice(regexp_extract_all(text, {S.quoted(T.MEASURES)}), 1, 10), '|') AS measures FROM m")
def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return manuals.blocks(spark, d).select("doc", "ordinal", F.array_join(T.keywords(text), "|").alias("keywords"), F.array_join(F.slice(T.all_matches(text, T.MEASURES), 1, 10), "|").alias("measures"))


@query(rf"""SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS n_normalized FROM pages""")
def normalized_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(T.normalized(F.col("html"))).alias("n_normalized"))


@query(rf"""WITH {_M} SELECT doc, ordinal, array_to_string({S.anchors('text')}, ' ') AS anchors, len(list_filter({S.anchors('text')}, lambda a: {S.high_signal('a')})) AS n_high,
  array_to_string(list_filter([trim(l) for l in regexp_extract_all(text, {S.quoted(T.MENU)})], lambda l: length(l) >= 3), '|') AS labels,
  array_to_string(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9 /_()-]{{1,40}})\s*:\s*([^\n;]{{1,80}})', 1), '|') AS fields, array_to_string(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9 /_()-]{{1,40}})\s*:\s*([^\n;]{{1,80}})', 2), '|') AS field_values,
  (contains(lower({S.collapsed('text')}), 'procedure step') AND regexp_matches(lower({S.collapsed('text')}), '\d+-\d+\b')) OR regexp_matches(text, '\.{{4,}}\s*\d+(?:-\d+)?\b') AS is_contents,
  {S.contains_any(f"lower({S.collapsed('text')})", T.BOILERPLATE)} AS is_boilerplate, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {S.quoted(T.MODEL)}))), '|') AS models FROM m""")
def anchor_terms(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    anchors = T.anchors(text)
    pairs = T.field_pairs(text)
    return manuals.blocks(spark, d).select(
        "doc", "ordinal", F.array_join(anchors, " ").alias("anchors"), F.size(F.filter(anchors, T.high_signal)).alias("n_high"), F.array_join(F.filter(F.transform(T.menu_labels(text), T.trimmed), lambda x: F.length(x) >= 3), "|").alias("labels"),
        F.array_join(F.transform(pairs, lambda p: p["name"]), "|").alias("fields"), F.array_join(F.transform(pairs, lambda p: p["value"]), "|").alias("field_values"), T.contents_line(text).alias("is_contents"),
        T.boilerplate(text).alias("is_boilerplate"), F.array_join(T.models(text), "|").alias("models"),
    )


@query(f"""SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN {S.low_information('line', "'paragraph'", f"(len({S.keywords('line')}) > 0)")} THEN 1 ELSE 0 END) AS BIGINT) AS n_low
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def low_information(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    low = T.low_information(F.col("line"), F.lit("paragraph"), F.size(T.keywords(F.col("line"))) > 0)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(low.cast("int")).alias("n_low"))


@query(f"SELECT doc_id, round({S.completeness('text')}, 4) AS says FROM documents")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.completeness(F.col("text")), 4).alias("says"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)/(.+)$', 1) AS bucket, regexp_extract(url, '^[a-z]+://([^/]+)/(.+)$', 2) AS name, sha256(html) AS sha,
  'tenant/sha256/' || sha256(html) || coalesce(nullif(lower(regexp_extract(regexp_extract(url, '[^/?#]*$'), '(\.[A-Za-z0-9]+)$', 1)), ''), '.bin') AS object_name,
  regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') AS safe_name FROM pages""")
def object_names(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions import names as N

    url = F.col("url")
    sha = F.sha2("html", 256)
    return table(spark, d, "pages").select("page_id", N.scheme(url).alias("scheme"), N.bucket(url).alias("bucket"), N.key(url).alias("name"), sha.alias("sha"), N.object_name(F.lit("tenant"), sha, url).alias("object_name"), N.safe_filename(url).alias("safe_name"))
