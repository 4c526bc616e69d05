"""Nested values of unknown shape as rows, and the signals that the chunks of a document hold in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.interim import discard, written

# Keys of a chunk's metadata that describe its document.
SIGNALS = ["product_model", "product_models", "product_family", "product_families", "devices", "part_numbers", "settings", "parameters", "section_path", "keywords", "unit_tokens", "identifier_tokens", "table_column_headers", "table_row_headers", "document_topics", "menu_labels", "protocol_terms"]


def flattened(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, top, path, at, value): a row for every scalar inside the JSON texts of rows that is not null or empty.

    top is the key of the outermost object; path names objects' keys and list places from the outside in, at the places
    alone, in the order of lists and of keys by name, so that sorting by it gives the order of a text. Every level of nesting
    is one round over what is still nested. Texts that are no JSON give no rows.
    """
    spark = rows.sparkSession
    open_ = rows.select(*keys, F.lit(None).cast("string").alias("top"), F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("at"), F.to_json(F.try_parse_json(json)).alias("body"))
    open_, found = written(open_.where("body is not null"), "nested"), None
    while open_.limit(1).count():
        parsed = open_.withColumn("v", F.parse_json("body"))
        names = ", ".join(f"t.{k}" for k in keys)
        # objects and lists alike: places, and keys of objects
        inner = spark.sql(f"SELECT {names}, coalesce(t.top, x.key) AS top, concat(t.path, array(coalesce(x.key, cast(x.pos AS string)))) AS path, concat(t.at, array(x.pos)) AS at, x.value AS v FROM {{t}} t, LATERAL variant_explode(t.v) x", t=parsed)
        kind = F.schema_of_variant("v")
        typed = inner.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        level = written(typed.select(*keys, "top", "path", "at", "nested", F.to_json("v").alias("body"), F.expr("try_variant_get(v, '$', 'string')").alias("value")), "level")
        leaves = level.where("not nested and value is not null and value <> ''").select(*keys, "top", "path", "at", "value")
        found = leaves if found is None else found.unionByName(leaves)
        discard(open_)
        open_ = written(level.where("nested").select(*keys, "top", "path", "at", "body"), "nested")
    discard(open_)
    if found is None:
        return rows.select(*keys).limit(0).select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in (("top", "string"), ("path", "array<string>"), ("at", "array<int>"), ("value", "string"))))
    return found


def value_text(flat: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): keys and values of nested values in their order, as one text."""
    said = F.concat_ws(" ", F.array_join(F.filter("path", lambda p: ~p.rlike(r"^\d+$")), " "), "value")
    return flat.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("t")))), lambda x: x["t"]), " ").alias("text"))


def signals(flat: DataFrame, doc: str, order: str, most: int = 200, names: list[str] | None = None) -> DataFrame:
    """(doc, signal, values): the distinct values that a document's chunks hold under each key, as they come first in the order
    of chunks, most at most. flat: as flattened gives it, with doc and order among its keys; values are trimmed."""
    told = flat.where(F.col("top").isin(names or SIGNALS)).select(doc, order, F.col("top").alias("signal"), "at", F.trim("value").alias("value")).where("value <> ''")
    first = told.groupBy(doc, "signal", "value").agg(F.min(F.struct(order, "at")).alias("seen"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy(doc, "signal").orderBy("seen", "value"))).where(F.col("n") <= most)
    return kept.groupBy(doc, "signal").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))
