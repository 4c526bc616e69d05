"""Technical blocks: manuals of products, as tables of text blocks in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import table

_SIZE = "CAST(p_size AS STRING)"
_KEY = "CAST(p_partkey AS STRING)"
_TEXTS = [
    ("p_partkey % 4 = 0", f"upper(p_type) || ' MODEL PX-' || {_KEY}"),
    ("p_partkey % 5 <> 0", f"'Warning: disconnect the ' || p_name || ' before service, ' || {_SIZE} || ' V may remain.'"),
    ("p_partkey % 2 = 0", f"CAST(p_partkey % 9 + 1 AS STRING) || '. Set [' || p_name || '] to ' || {_SIZE} || ' mm and check the output of ' || lower(p_type)"),
    ("p_partkey % 2 = 0", f"CAST(p_partkey % 9 + 2 AS STRING) || ') Connect PX-' || {_KEY} || 'A to the controller.'"),
    ("p_partkey % 3 <> 0", f"p_name || ' weight: ' || {_SIZE} || ' kg'"),
    ("p_partkey % 3 = 1", f"'Item | Value | Unit' || chr(10) || 'Size | ' || {_SIZE} || ' | mm' || chr(10) || 'Price | ' || {_KEY} || '.5 | V' || chr(10) || 'Box | ' || p_name || ' | -'"),
    ("p_partkey % 9 = 1", f"'rate  ' || {_SIZE} || '  Hz' || chr(10) || 'gain  ' || {_KEY} || '  dB'"),
    ("p_partkey % 9 = 2", f"'Cable length  ' || {_SIZE} || ' m'"),
    ("p_partkey % 7 = 0", "p_name"),
    ("p_partkey % 3 = 0", "'The ' || p_name || ' fits the ' || lower(p_type) || ' housing and ships with a spare seal'"),
    ("p_partkey % 7 <> 0", f"'Note model PX-' || {_KEY} || ' supports EtherNet/IP and RS-232 at ' || {_SIZE} || ' mA.'"),
    ("p_partkey % 6 = 0", "'Call toll free +1 800 555 0100 for a quote'"),
    ("p_partkey % 8 = 0", "'Caution hot surface near the ' || lower(p_type)"),
    ("p_partkey % 10 = 0", "'See https://parts.example.org for drawings of this part'"),
    ("p_partkey % 11 = 0", f"'page ' || {_SIZE} || ' of 50'"),
    ("p_partkey % 13 = 0", "'figure_' || lower(p_type) || '.png'"),
]
#: Blocks of the parts of each brand: (doc, ordinal, page, text), in SQL that any engine reads.
BLOCKS_SQL = " UNION ALL ".join(
    f"SELECT p_brand AS doc, CAST(p_partkey AS BIGINT) * 16 + {k} AS ordinal, CAST(floor(p_partkey / 4) AS BIGINT) + 1 AS page, {text} AS text FROM part WHERE {where}" for k, (where, text) in enumerate(_TEXTS)
)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, ordinal, page, text) of all parts."""
    return spark.sql(BLOCKS_SQL.replace(" FROM part ", " FROM {part} "), part=table(spark, folder, "part"))
