"""Duplicate documents planned and taken out, exports, coerced metadata, and rows that maintenance starts from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.catalog.upkeep import _METADATA
from tessera.operators import dedupe
from tessera.operators import metadata as M
from tessera.sources import exports
from tessera.sources.interim import shared_folder
from tessera.sources.tables import table

_DEFAULT = "src0"
_PLAN = f"""d AS (SELECT doc_id, sha256(text) AS digest, source, len(string_split(text, chr(10))) AS chunk_count FROM documents WHERE text IS NOT NULL), ve AS (SELECT page_id, count(*) AS n FROM pages GROUP BY page_id), ev AS (SELECT user_id, max(ts) AS at FROM events GROUP BY user_id),
  ra AS (SELECT d.digest, d.doc_id, count(*) OVER (PARTITION BY digest) AS n, first_value(d.doc_id) OVER (PARTITION BY digest ORDER BY coalesce(source = '{_DEFAULT}', false) DESC, coalesce(l.quality = 1, false) DESC, chunk_count DESC, coalesce(ve.n, 0) DESC, ev.at DESC NULLS LAST, d.doc_id DESC) AS canonical_id
    FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN ve ON ve.page_id = d.doc_id LEFT JOIN ev ON ev.user_id = d.doc_id), pl AS (SELECT digest, doc_id, canonical_id, doc_id = canonical_id AS keeps FROM ra WHERE n > 1)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """Documents with what ranks them: their source, quality, lines, pages of the same number and the last event of theirs."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("source").alias("corpus"), F.size(F.split("text", "\n")).alias("chunk_count"))
    status = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "indexed").otherwise("pending").alias("status"))
    versions = table(spark, d, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.count("*").alias("version_count"))
    seen = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("updated_at"))
    return dedupe.plan(docs.join(status, "doc_id", "left").join(versions, "doc_id", "left").join(seen, "doc_id", "left"), _DEFAULT)


@query(f"WITH {_PLAN} SELECT * FROM pl")
def dedupe_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query(f"WITH {_PLAN} SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM pl WHERE NOT keeps)")
def deduped_labels(spark: SparkSession, d: str) -> DataFrame:
    """What is left of labels once the plan's documents are gone."""
    return dedupe.applied(table(spark, d, "labels"), _plan(spark, d)).select("doc_id", "quality", "toxic")


@query("SELECT doc_id, source, lang, n_chars, length(text) AS length, md5(text) AS digest FROM documents")
def exported_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as CSV, a folder for each source, read again."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    place = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    exports.to_csv(docs, place, ["source"])
    again = exports.from_csv(spark, place, "doc_id long, lang string, n_chars long, text string, source string")
    return again.select("doc_id", "source", "lang", "n_chars", F.length("text").alias("length"), F.md5("text").alias("digest"))


_KEYS = ["product_models", "settings", "devices", "keywords", "parameters", "menu_labels", "part_numbers"]
_COERCED = " UNION ALL ".join(
    f"""SELECT doc, part, '{k}' AS field, CASE json_type(metadata, '$.{k}') WHEN 'VARCHAR' THEN list_filter([json_extract_string(metadata, '$.{k}')], lambda x: trim(x) <> '') WHEN 'ARRAY' THEN list_filter(json_extract_string(metadata, '$.{k}[*]'), lambda x: trim(x) <> '') ELSE [] END AS v FROM m"""
    for k in _KEYS
)


@query(f"WITH m AS ({_METADATA}), co AS ({_COERCED}) SELECT doc, part, field, len(v) AS n, array_to_string(v, '|') AS found FROM co")
def coerced_metadata(spark: SparkSession, d: str) -> DataFrame:
    own = _METADATA.replace("{", "{{").replace("}", "}}").replace(" FROM part", " FROM {part}")
    rows = spark.sql(own, part=table(spark, d, "part"))
    fields = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.get_json_object("metadata", f"$.{k}").alias("plain")) for k in _KEYS)))
    told = rows.select("doc", "part", "metadata", fields.alias("f"))
    # the JSON of a value, quotes of a text included
    body = F.to_json(F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>")[F.col("f.field")])
    found = told.select("doc", "part", "f.field", M.coerced_list(body).alias("v"))
    return found.select("doc", "part", "field", F.size("v").alias("n"), F.array_join("v", "|").alias("found"))


@query("SELECT d.source, d.doc_id, coalesce(p.page_id, -1) AS version_id, p.url AS artifact FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def reset_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every document with what a reset has to take away with it, if there is any (else -1 and null)."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("version_id"), F.col("url").alias("artifact"))
    docs = table(spark, d, "documents").select("source", "doc_id")
    return docs.join(pages, docs["doc_id"] == pages["version_id"], "left").select("source", "doc_id", F.coalesce("version_id", F.lit(-1)).alias("version_id"), "artifact")


@query("""WITH r AS (SELECT conv_id, count(*) AS n_rows, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM conversations GROUP BY conv_id)
  SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN '{}' ELSE '{"quality":' || l.quality || ',"toxic":' || l.toxic || '}' END AS metadata, coalesce(r.n_rows, 0) AS n_rows, coalesce(r.roles, '') AS roles
  FROM documents d SEMI JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN r ON r.conv_id = d.doc_id""")
def metadata_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a version, with their metadata and what the rows under them hold."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi")
    told = table(spark, d, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("metadata"))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"))
    both = docs.join(told, "doc_id", "left").join(rows, "doc_id", "left")
    return both.select("doc_id", "source", F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("roles", F.lit("")).alias("roles"))
