"""Statements of the control plane over chunks, documents and events: joins, siblings, tails, snapshots and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import records
from tessera.sources import library
from tessera.sources.tables import table

_C = f"c AS ({library.CHUNKS_SQL})"
_TYPES = ["atomic_text", "spec_record", "table_record", "procedure_record", "warning_record", "section_window"]
_ORDER = "CASE chunk_type WHEN 'spec_record' THEN 1 WHEN 'table_record' THEN 2 WHEN 'procedure_record' THEN 3 ELSE 4 END"


def _ranked(rows: DataFrame, keys: list[str], order: list[Column | str], limit: int, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= limit)


@query(f"""WITH {_C}, d AS (SELECT doc, min(title) AS title, count(*) AS n_chunks FROM c GROUP BY doc)
  SELECT * FROM (SELECT c.doc, d.title, coalesce(nullif(c.menu, ''), 'none') AS menu, c.chunk_id, d.n_chunks, row_number() OVER (PARTITION BY c.doc ORDER BY {_ORDER}, page_from, chunk_id) AS place FROM c JOIN d ON d.doc = c.doc
  WHERE level = 1 AND length(content) >= 40 AND chunk_type IN ('atomic_text', 'spec_record', 'table_record', 'procedure_record', 'warning_record', 'section_window')) WHERE place <= 20""")
def chunk_projection(spark: SparkSession, d: str) -> DataFrame:
    chunks = library.chunks(spark, d)
    docs = chunks.groupBy("doc").agg(F.min("title").alias("d_title"), F.count("*").alias("n_chunks"))
    kind = F.when(F.col("chunk_type") == "spec_record", 1).when(F.col("chunk_type") == "table_record", 2).when(F.col("chunk_type") == "procedure_record", 3).otherwise(4)
    wanted = chunks.where((F.col("level") == 1) & (F.length("content") >= 40) & F.col("chunk_type").isin(_TYPES)).join(docs, "doc")
    return _ranked(wanted, ["doc"], [kind, "page_from", "chunk_id"], 20).select("doc", F.col("d_title").alias("title"), F.coalesce(F.get("menu_labels", F.lit(0)), F.lit("none")).alias("menu"), "chunk_id", "n_chunks", "place")


@query(f"""WITH {_C}, w AS (SELECT DISTINCT doc, section FROM c WHERE chunk_type = 'warning_record') SELECT doc, section, chunk_id, level FROM c WHERE (doc, section) IN (SELECT doc, section FROM w) AND level IN (2, 3)""")
def section_siblings(spark: SparkSession, d: str) -> DataFrame:
    chunks = library.chunks(spark, d)
    wanted = chunks.where("chunk_type = 'warning_record'").select("doc", "section")
    return chunks.where("level in (2, 3)").join(wanted, ["doc", "section"], "left_semi").select("doc", "section", "chunk_id", "level")


@query(f"""WITH {_C}, p AS (SELECT DISTINCT doc, page_from AS page FROM c) SELECT doc, page, chunk_id, place FROM (SELECT c.doc, p.page, c.chunk_id, row_number() OVER (PARTITION BY c.doc, p.page ORDER BY c.level, c.page_from, c.chunk_type, c.chunk_id) AS place
  FROM p JOIN c ON c.doc = p.doc AND c.page_from <= p.page AND c.page_to >= p.page) WHERE place <= 10""")
def chunks_of_pages(spark: SparkSession, d: str) -> DataFrame:
    chunks = library.chunks(spark, d)
    pages = chunks.select("doc", F.col("page_from").alias("page")).distinct()
    # a chunk stands once for each of its pages, so that pages join by equality
    spread = chunks.withColumn("page", F.explode(F.sequence("page_from", "page_to")))
    return _ranked(spread.join(pages, ["doc", "page"], "left_semi"), ["doc", "page"], ["level", "page_from", "chunk_type", "chunk_id"], 10).select("doc", "page", "chunk_id", "place")


@query("SELECT d.doc_id, d.source, coalesce(p.url, 'none') AS url, p.page_id IS NOT NULL AS has_version FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id WHERE d.lang IN ('en', 'de') OR d.lang IS NULL")
def current_versions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang in ('en', 'de') or lang is null").select("doc_id", "source")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url", F.lit(True).alias("has"))
    return docs.join(pages, "doc_id", "left").select("doc_id", "source", F.coalesce("url", F.lit("none")).alias("url"), F.coalesce("has", F.lit(False)).alias("has_version"))


@query("""SELECT source, doc_id, quality, toxic, place FROM (SELECT d.source, d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, row_number() OVER (PARTITION BY d.source ORDER BY l.quality DESC NULLS LAST, d.n_chars DESC, d.doc_id) AS place
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE place <= 3""")
def metadata_records(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("source", "doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    best = _ranked(both, ["source"], [F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id"], 3)
    return best.select("source", "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "place")


@query("""SELECT doc_id, string_agg(line, ' / ' ORDER BY ordinal) AS excerpt FROM (SELECT doc_id, ordinal, line, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS place FROM
  (SELECT doc_id, generate_subscripts(l, 1) AS ordinal, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(coalesce(line, '')) <> '') WHERE place <= 3 GROUP BY doc_id""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").where(F.size(lines) > 0).select("doc_id", F.array_join(F.slice(lines, 1, 3), " / ").alias("excerpt"))


@query("""SELECT event_id, CASE WHEN k IS NULL THEN json_object('type', event_type) ELSE json_object('k', k, 'type', event_type) END AS compact FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""")
def compact_runs(spark: SparkSession, d: str) -> DataFrame:
    made = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.col("event_type").alias("type")))
    return table(spark, d, "events").select("event_id", made.alias("compact"))


@query("""SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_id > user_id * 3 AND event_type NOT IN ('click')) WHERE place <= 5""")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return records.page(table(spark, d, "events").where("event_type not in ('click')"), ["user_id"], "event_id", F.col("user_id") * 3, 5).select("user_id", "event_id", "place")


@query("""SELECT user_id, count(*) AS last_index, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (WHERE event_type = 'error') AS failures, min(ts) AS started, max(ts) AS updated FROM events GROUP BY user_id""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    return records.states(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "error").select("user_id", "last_index", "state", "failures", F.col("first_at").alias("started"), F.col("last_at").alias("updated"))


@query("""SELECT e.user_id, e.event_id, e.event_index FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_index FROM events) e""")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(order).alias("event_index"))


@query("""WITH g AS (SELECT lang, n_chars, md5(coalesce(text, '')) AS etag, count(*) AS copies, min(doc_id) AS canonical FROM documents GROUP BY 1, 2, 3) SELECT d.doc_id, g.canonical, g.copies, d.doc_id = g.canonical AS keeps FROM documents d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang AND g.n_chars = d.n_chars AND g.etag = md5(coalesce(d.text, ''))""")
def canonical_objects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("etag"))
    groups = docs.groupBy("lang", "n_chars", "etag").agg(F.count("*").alias("copies"), F.min("doc_id").alias("canonical")).withColumnRenamed("lang", "g_lang")
    both = docs.join(groups, ["n_chars", "etag"]).where(F.col("lang").eqNullSafe(F.col("g_lang")))
    return both.select("doc_id", "canonical", "copies", (F.col("doc_id") == F.col("canonical")).alias("keeps"))


@query(f"""WITH {_C}, a AS (SELECT doc, count(*) AS n_chunks, count(DISTINCT section) AS n_sections FROM c GROUP BY doc), b AS (SELECT doc, chunk_type, count(*) AS n FROM c GROUP BY doc, chunk_type), t AS (SELECT doc, string_agg(chunk_type || ':' || CAST(n AS STRING), '|' ORDER BY chunk_type) AS kinds FROM b GROUP BY doc),
  f AS (SELECT doc, string_agg(CAST(chunk_id AS STRING), '|' ORDER BY place) AS first_ids FROM (SELECT doc, chunk_id, row_number() OVER (PARTITION BY doc ORDER BY page_from, chunk_id) AS place FROM c) WHERE place <= 5 GROUP BY doc)
  SELECT a.doc, n_chunks, n_sections, kinds, first_ids FROM a JOIN t ON t.doc = a.doc JOIN f ON f.doc = a.doc""")
def document_snapshots(spark: SparkSession, d: str) -> DataFrame:
    chunks = library.chunks(spark, d)
    counts = chunks.groupBy("doc").agg(F.count("*").alias("n_chunks"), F.countDistinct("section").alias("n_sections"))
    kinds = chunks.groupBy("doc", "chunk_type").agg(F.count("*").alias("n")).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.concat("chunk_type", F.lit(":"), F.col("n").cast("string")))), "|").alias("kinds"))
    first = _ranked(chunks, ["doc"], ["page_from", "chunk_id"], 5).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), "|").alias("first_ids"))
    return counts.join(kinds, "doc").join(first, "doc")
