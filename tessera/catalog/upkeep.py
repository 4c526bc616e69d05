"""Nested metadata, the upkeep of an index, and the trace of a retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import retrieval as C
from tessera.catalog.registry import query
from tessera.operators import nested, upkeep
from tessera.operators import questions as Q
from tessera.operators import retrieval as R
from tessera.plans import retrieve as plan
from tessera.sources import library
from tessera.sources.interim import shared_folder, written
from tessera.sources.tables import table

#: Metadata of parts, nested and with gaps, in SQL that any engine reads.
_METADATA = """SELECT p_brand AS doc, p_partkey AS part, '{"product_models": ["PX-' || CAST(p_partkey % 40 AS STRING) || '", "PX-' || CAST(p_partkey % 7 AS STRING) || '"], "settings": {"mode": "' || p_name || '", "size": [' || CAST(p_size AS STRING)
  || ', {"unit": "mm", "none": null}]}, "devices": "' || p_type || '", "keywords": ["", "  ' || CAST(p_size % 5 AS STRING) || ' kg "], "parameters": {"x": {"y": {"z": true}}, "w": []}, "other": "left out", "menu_labels": {}}' AS metadata FROM part"""


def _flat(spark: SparkSession, d: str) -> DataFrame:
    own = _METADATA.replace("{", "{{").replace("}", "}}").replace(" FROM part", " FROM {part}")
    rows = spark.sql(own, part=table(spark, d, "part"))
    return nested.flattened(rows, ["doc", "part"], "metadata")


_TREE = f"m AS ({_METADATA}), t AS (SELECT m.doc, m.part, x.fullkey, x.path, x.key, x.id, x.atom FROM m, json_tree(m.metadata) x WHERE x.atom IS NOT NULL AND x.type <> 'NULL'), f AS (SELECT doc, part, fullkey, trim(CAST(atom AS VARCHAR), '\"') AS value FROM t)"


@query(rf"""WITH {_TREE} SELECT doc, part, regexp_replace(regexp_replace(replace(fullkey, '$.', ''), '\[(\d+)\]', '.\1', 'g'), '"', '', 'g') AS path, value FROM f WHERE value <> ''""")
def flattened_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).select("doc", "part", F.array_join("path", ".").alias("path"), "value")


_TOP = r"regexp_extract(fullkey, '^\$\.\"?([a-z_]+)', 1)"


@query(f"""WITH {_TREE}, s AS (SELECT doc, part, {_TOP} AS signal, CASE WHEN contains(fullkey, 'models[1]') OR contains(fullkey, 'size[0]') THEN 1 WHEN contains(fullkey, 'unit') THEN 2 ELSE 0 END AS place, trim(value) AS value FROM f WHERE trim(value) <> '' AND {_TOP} <> 'other'),
  u AS (SELECT doc, signal, value, min(part * 10 + place) AS seen FROM s GROUP BY doc, signal, value), k AS (SELECT *, row_number() OVER (PARTITION BY doc, signal ORDER BY seen, value) AS n FROM u)
  SELECT doc, signal, count(*) AS n_values, string_agg(value, '|' ORDER BY n) FILTER (WHERE n <= 6) AS first_values FROM k WHERE n <= 200 GROUP BY doc, signal""")
def metadata_signals(spark: SparkSession, d: str) -> DataFrame:
    found = nested.signals(_flat(spark, d), "doc", "part")
    return found.select("doc", "signal", F.size("values").cast("long").alias("n_values"), F.array_join(F.slice("values", 1, 6), "|").alias("first_values"))


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS chunk_id, p_brand AS doc, p_name AS content FROM part), b AS (SELECT doc, row_number() OVER (ORDER BY doc) AS n FROM (SELECT DISTINCT doc FROM p))
  SELECT p.chunk_id, p.doc, CASE WHEN n % 4 = 1 THEN upper(content) ELSE content END AS content FROM p JOIN b ON b.doc = p.doc WHERE n % 4 <> 2 AND NOT (n % 4 = 1 AND chunk_id % 2 = 0)""")
def indexed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Three batches: all chunks, a quarter of documents anew and another taken out, the second one twice."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("chunk_id"), F.col("p_brand").alias("doc"), F.col("p_name").alias("content"))
    numbers = rows.select("doc").distinct().sort("doc").select("doc", (F.monotonically_increasing_id() + 1).alias("n"))
    numbers = written(numbers.coalesce(1), "documents")
    index = upkeep.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.apply("all", rows)
    anew = rows.join(numbers.where("n % 4 = 1"), "doc").where("chunk_id % 2 = 1").select("chunk_id", "doc", F.upper("content").alias("content"))
    for _ in range(2):
        index.apply("changes", anew, numbers.where("n % 4 = 2"))
    index.compact("whole")
    return index.read().select("chunk_id", "doc", "content")


_STAGES = {"dense": "hd", "sparse": "(SELECT * FROM lx WHERE scope = 'all')", "table": "ft", "special": "sp", "fused": "fu", "family_scored": "fs", "query_aligned": "al", "family_selected": "sf", "reranked": "rr"}
_TRACE = " UNION ALL ".join(f"SELECT query_id, '{name}' AS stage, {k} AS n, chunk_id, rank, score FROM {source} x" for k, (name, source) in enumerate(_STAGES.items()))


@query(f"""WITH {C.RERANKED}, tr AS ({_TRACE}), co AS (SELECT query_id, stage, n, count(*) AS kept, list(chunk_id) AS ids FROM tr GROUP BY query_id, stage, n)
  SELECT t.query_id, t.stage, t.rank, t.chunk_id, round(t.score, 6) AS score, co.kept, coalesce(CASE WHEN co.n >= 5 THEN (SELECT len(b.ids) - len(list_intersect(b.ids, co.ids)) FROM co b WHERE b.query_id = t.query_id AND b.n = co.n - 1) END, 0) AS lost
  FROM tr t JOIN co ON co.query_id = t.query_id AND co.stage = t.stage WHERE t.rank <= 5""")
def retrieval_trace(spark: SparkSession, d: str) -> DataFrame:
    analysis, same = C._once(spark, d)
    found = Q.for_all(plan.trace(library.written_chunks(spark, d), analysis), same)
    return found.select("query_id", "stage", "rank", "chunk_id", F.round("score", 6).alias("score"), "kept", F.coalesce("lost", F.lit(0)).alias("lost"))
