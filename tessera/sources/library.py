"""A library of retrieval chunks and questions about it, made from the parts and suppliers of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.interim import written
from tessera.sources.tables import table

_KEY, _SIZE = "CAST(p_partkey AS STRING)", "CAST(p_size AS STRING)"
#: (chunk_id, doc, title, section, chunk_type, level, page_from, page_to, content, rerank, priority, menu, identifiers, protocols, models, version_signal),
#: lists as text parted by |; in SQL that any engine reads.
CHUNKS_SQL = f"""SELECT chunk_id, doc, title, section, chunk_type, CASE WHEN chunk_type = 'section_window' THEN 2 WHEN chunk_type = 'parent_section' THEN 3 ELSE 1 END AS level, page_from, page_to, content,
  content || ' ' || section AS rerank, CASE chunk_type WHEN 'warning_record' THEN 25.0 WHEN 'spec_record' THEN 20.0 WHEN 'procedure_record' THEN 15.0 WHEN 'table_record' THEN 10.0 ELSE 0.0 END AS priority,
  menu, identifiers, protocols, models, version_signal FROM (
  SELECT CAST(p_partkey AS BIGINT) AS chunk_id, p_brand AS doc, 'Manual ' || p_brand AS title, lower(p_type) || ' parts' AS section,
    CASE p_partkey % 8 WHEN 0 THEN 'atomic_text' WHEN 1 THEN 'spec_record' WHEN 2 THEN 'table_record' WHEN 3 THEN 'procedure_record' WHEN 4 THEN 'warning_record' WHEN 5 THEN 'section_window' WHEN 6 THEN 'atomic_text' ELSE 'parent_section' END AS chunk_type,
    CAST(floor(p_partkey / 40) AS BIGINT) + 1 AS page_from, CAST(floor(p_partkey / 40) AS BIGINT) + 1 + p_partkey % 2 AS page_to,
    CASE p_partkey % 8 WHEN 0 THEN 'The ' || p_name || ' fits every ' || lower(p_type) || ' housing, it is rated for ' || {_SIZE} || ' V' WHEN 1 THEN p_name || ' weight: ' || {_SIZE} || ' kg'
      WHEN 2 THEN 'Item: ' || p_name || '; Output: ' || {_SIZE} || ' mA; Model: PX-' || {_KEY} WHEN 3 THEN 'Procedure step 2: Set [' || p_name || '] to ' || {_SIZE} || ' mm'
      WHEN 4 THEN 'Warning: laser radiation class 2 output, switch the ' || p_name || ' off' WHEN 5 THEN 'Install the ' || p_name || ', then configure the ' || lower(p_type) || ' network. Check the output.'
      WHEN 6 THEN p_name ELSE 'Revision 2 of the ' || lower(p_type) || ' parts replaces the legacy ' || p_name || ' with a new version.' END AS content,
    CASE WHEN p_partkey % 8 = 3 THEN '[' || p_name || ']' ELSE '' END AS menu, 'PX-' || {_KEY} AS identifiers, CASE p_partkey % 5 WHEN 0 THEN 'ethernet/ip' WHEN 1 THEN 'rs-232|usb' ELSE '' END AS protocols,
    'PX-' || {_KEY} || 'A' AS models, CASE WHEN p_partkey % 4 = 3 THEN 'true' ELSE 'false' END AS version_signal FROM part) x"""
_NAME = "CASE s_suppkey % 5 WHEN 0 THEN 'cold widget' WHEN 1 THEN 'small bolt' WHEN 2 THEN 'large gear' WHEN 3 THEN 'red widget' ELSE 'hot bolt' END"
_NUMBER = "CAST(s_suppkey % 50 AS STRING)"
#: (query_id, query), in SQL that any engine reads.
QUESTIONS_SQL = f"""SELECT CAST(s_suppkey AS BIGINT) AS query_id, CASE s_suppkey % 14 WHEN 0 THEN 'how to set [' || {_NAME} || '] mm' WHEN 1 THEN {_NAME} || ' weight kg datasheet' WHEN 2 THEN 'PX-' || {_NUMBER} || 'A output mA value'
  WHEN 3 THEN 'laser radiation class of the ' || {_NAME} || ' wavelength output' WHEN 4 THEN 'warning when the ' || {_NAME} || ' is hot' WHEN 5 THEN 'compare ' || {_NAME} || ' versus PX-' || {_NUMBER} WHEN 6 THEN 'latest revision of ' || {_NAME}
  WHEN 7 THEN 'part number of the ' || {_NAME} || ' housing' WHEN 8 THEN 'ethernet/ip support of PX-' || {_NUMBER} || ' series' WHEN 9 THEN 'error E' || CAST(100 + s_suppkey % 50 AS STRING) || ' fault on ' || {_NAME}
  WHEN 10 THEN {_NAME} WHEN 11 THEN 'command timing flow for ' || {_NAME} || ' network' WHEN 12 THEN 'what ' || {_NAME} || ' fits ' || {_NUMBER} || ' V' ELSE 'benefit of economy parts' END AS query FROM supplier"""


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A chunk for every part, dealt by its id: parts are few bytes, so that one task would read them all, and say much."""
    part = table(spark, folder, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    found = spark.sql(CHUNKS_SQL.replace(" FROM part)", " FROM {part})"), part=part)
    listed = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    return found.select(*(c for c in found.columns if c not in ("menu", "identifiers", "protocols", "models")), listed("menu").alias("menu_labels"), listed("identifiers").alias("identifier_tokens"), listed("protocols").alias("protocol_terms"), listed("models").alias("product_models"))


def written_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The library as a table: its texts are made once, and what is asked of them is asked by as many tasks."""
    return written(chunks(spark, folder), "chunks")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(QUESTIONS_SQL.replace(" FROM supplier", " FROM {supplier}"), supplier=table(spark, folder, "supplier"))
