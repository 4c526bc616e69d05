"""Metadata that a model has extracted from documents: which of it the source bears out, and what a document's record holds.

Extractions are rows (doc, filename, text, field, value) or scalar columns; the model itself is not part of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# What names nothing, protocols, and words that settings have.
NO_ENTITY = ["caution", "danger", "important", "notice", "point", "reference", "warning"]
PROTOCOLS = ["ethernet/ip", "ethercat", "profinet", "modbus", "tcp/ip", "udp", "rs-232", "rs-232c", "rs-485", "usb", "io-link", "canopen", "cc-link"]
SETTING_WORDS = ["setting", "setup", "menu", "select", "configure"]


def grounded(value: Column, source: Column) -> Column:
    """Whether a value, but for case and white space, is part of the source."""
    return (T.folded(value) != "") & T.folded(source).contains(T.folded(value))


def coerced_list(value: Column) -> Column:
    """The texts of a JSON value: of a list its items that are not blank, of a text itself unless it is blank, else none.

    Items are not trimmed; numbers are as JSON writes them, true, false and null are True, False and None, nested ones JSON.
    """
    v, none = F.try_parse_json(value), F.array().cast("array<string>")
    kind = F.schema_of_variant(v)
    said = lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(F.try_variant_get(x, "$", "string"))), F.try_variant_get(x, "$", "string"), F.lit("None"))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), said)
    own = F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), items)
    return F.coalesce(F.filter(own, lambda x: F.trim(x) != ""), none)


def coerced_date(value: Column) -> Column:
    """A date from its text (yyyy-mm-dd); null, empty or no such text is null."""
    return F.try_to_date(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "yyyy-MM-dd")


def source_of(filename: Column, text: Column) -> Column:
    """What values of a document must be part of, but for case and white space."""
    return T.folded(T.source_text(filename, text))


def kept(rows: DataFrame) -> DataFrame:
    """The rows (filename, text, field, value) whose values the source bears out and the rules of their field allow.

    A column source, as source_of gives it, stands in the place of text where there is one, so that no row carries a whole document.
    """
    source = F.col("source") if "source" in rows.columns else source_of(F.col("filename"), F.col("text"))
    v, low, field = F.trim("value"), F.lower(F.trim("value")), F.col("field")
    stem = F.lower(F.regexp_replace("filename", r"\.[^.]*$", ""))
    words = F.size(T.words(v))
    against = [
        low.isin(NO_ENTITY), v.contains("|"), field.isin("companies", "devices") & (words > 6), (field == "protocol_terms") & ~low.isin(PROTOCOLS),
        (field == "product_models") & ~(v.rlike(r"\d") & v.rlike("[A-Z]{1,5}-?[A-Z0-9]")), (field == "product_families") & (F.upper(v) == "PLC"), (field == "menu_labels") & ~(v.startswith("[") & v.endswith("]")),
        (field == "devices") & ((low == F.lower("filename")) | (low == stem) | (low == F.lower(T.title_of(F.col("filename"))))), field.isin("part_numbers", "product_models") & (v.contains("_") | low.endswith(".pdf")),
        (field == "parameters") & ~low.contains("parameter"), (field == "settings") & ~T.any_of(low, SETTING_WORDS),
    ]
    bad = against[0]
    for rule in against[1:]:
        bad = bad | rule
    own = T.folded(F.col("value"))
    return rows.where(~F.coalesce(bad, F.lit(True)) & (own != "") & source.contains(own))


def listed(rows: DataFrame) -> DataFrame:
    """(doc, field, found): the values of every field in their order (seq), without those equal to an earlier one but for case."""
    clean = rows.select("doc", "field", F.struct("seq", F.trim("value").alias("value")).alias("v"))
    first = clean.groupBy("doc", "field", F.lower("v.value").alias("low")).agg(F.min("v").alias("v"))
    return first.groupBy("doc", "field").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["value"]).alias("found"))


def resolved(scalars: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc, title, manufacturer, product_model, product_family) of documents (doc, filename, text, title, manufacturer, product_model, product_family).

    The first value of a list goes before the scalar, which must be borne out by the source (manufacturer: be a name at all).
    """
    first = lists.groupBy("doc").agg(*(F.max(F.when(F.col("field") == f, F.get("found", F.lit(0)))).alias(f) for f in ("companies", "product_models", "product_families")), F.max(F.when(F.col("field") == "product_models", F.col("found"))).alias("models"))
    both = scalars.join(first, "doc", "left")
    source = T.source_text(F.col("filename"), F.col("text"))
    maker = F.trim("manufacturer")
    named = ~F.lower(maker).isin(NO_ENTITY) & ~maker.contains("|") & (F.size(T.words(maker)) <= 6) & (maker != "")
    model = F.when(~F.lower("product_model").isin(NO_ENTITY) & F.col("product_model").rlike(r"\d") & grounded(F.col("product_model"), source), F.col("product_model"))
    family = F.when(~F.array_contains(F.coalesce("models", F.array().cast("array<string>")), F.col("product_family")) & grounded(F.col("product_family"), source), F.col("product_family"))
    return both.select(
        "doc", F.trim(F.coalesce(F.nullif("title", F.lit("")), T.title_of(F.col("filename")))).alias("title"), F.coalesce("companies", F.when(named, maker), F.lit("Unknown")).alias("manufacturer"),
        F.coalesce("product_models", model).alias("product_model"), F.coalesce("product_families", family).alias("product_family"),
    )
