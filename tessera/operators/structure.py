"""Blocks of documents to nodes: their kinds, tables, specs and the heading that they stand under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# What a spec looks like, and names and values that are none.
_UNIT = rf"(?:\s+({T.UNITS}))?$"
SPECS = [rf"(?i)^([A-Za-z][A-Za-z0-9 /().,%+-]{{1,80}}?)\s*[:\-]\s*(.+?){_UNIT}", rf"(?i)^([A-Za-z][A-Za-z0-9 /().,%+-]{{1,80}}?)\s{{2,}}(.+?){_UNIT}"]
NO_SPEC = ["warning", "caution", "note", "notice"]
ASSET_NAME = r"(?i)^[A-Za-z0-9_./\\:-]+" + T.ASSET + "$"
NUMBERED = r"^\d+(?:\.\d+)*\s+[A-Z][^\n]{0,100}$"


def _clean(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit("\\_"), F.lit("_"))


def ignorable(text: Column) -> Column:
    """Blank blocks, comments and bare asset names."""
    clean = _clean(text)
    return F.coalesce((clean == "") | (clean.startswith("<!--") & clean.endswith("-->")) | clean.rlike(ASSET_NAME), F.lit(True))


def is_heading(text: Column) -> Column:
    """Short text without lower-case letters, or a numbered title; three letters or digits at least."""
    clean = _clean(text)
    signs = F.regexp_count(clean, F.lit("[A-Za-z0-9]"))
    return (signs >= 3) & (((F.length(clean) < 120) & (clean == F.upper(clean))) | clean.rlike(NUMBERED))


def with_rows(blocks: DataFrame, text: str, name: str = "rows") -> DataFrame:
    """blocks with the rows of cells of those texts that are tables, the first one its headers; else null.

    Lines with | are rows of what stands between; without any, two or more blanks or a tab part the cells, and lines may have
    two different numbers of them at most. Rows have two cells at least, and tables two rows.
    """
    # columns of their own, so that no pattern is matched twice
    out = blocks.withColumn("_lines", F.filter(F.transform(F.split(F.trim(text), "\n"), T.trimmed), lambda x: x != ""))
    piped = F.transform(F.filter("_lines", lambda x: x.contains("|")), lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), T.trimmed))
    spaced = F.transform("_lines", lambda x: F.filter(F.transform(F.split(x, r"\s{2,}|\t"), T.trimmed), lambda c: c != ""))
    out = out.withColumn("_piped", F.when(F.size("_lines") >= 2, piped)).withColumn("_spaced", F.when((F.size("_lines") >= 2) & (F.size("_piped") == 0), spaced))
    out = out.withColumn("_widths", F.array_distinct(F.transform("_spaced", F.size)))
    columns = F.when((F.array_max("_widths") >= 2) & (F.size("_widths") <= 2), F.col("_spaced"))
    out = out.withColumn("_rows", F.filter(F.when(F.size("_piped") > 0, F.col("_piped")).otherwise(columns), lambda r: F.size(r) >= 2))
    return out.withColumn(name, F.when(F.size("_rows") >= 2, F.col("_rows"))).drop("_lines", "_piped", "_spaced", "_widths", "_rows")


def with_spec(blocks: DataFrame, text: str, name: str = "spec") -> DataFrame:
    """blocks with (name, value, unit) of one-line texts `name: value unit` or `name  value unit`; null if it is none. unit may be null."""
    clean = _clean(F.col(text))
    out, each = blocks, F.lit(None).cast("struct<name:string,value:string,unit:string>")
    parts = {}
    for k, pattern in enumerate(SPECS):
        plain = F.when(~clean.contains("\n") & clean.rlike(pattern), F.regexp_replace(F.regexp_extract(clean, pattern, 1), r"^[ :.\-]+|[ :.\-]+$", ""))
        parts |= {f"_name{k}": plain, f"_value{k}": F.trim(F.regexp_extract(clean, pattern, 2)), f"_unit{k}": F.regexp_extract(clean, pattern, 3)}
    out = out.withColumns(parts)
    odd = lambda x: F.lower(x).rlike(T.URL) | F.lower(x).rlike(T.PAGE_MARK) | F.lower(x).rlike(T.PHONE_WORD) | F.col(x).rlike(T.PHONE)
    for k in reversed(range(len(SPECS))):
        n, v, u = (F.col(f"_{x}{k}") for x in ("name", "value", "unit"))
        fits = (F.size(T.words(n)) <= 8) & (F.length(v) <= 120) & ~F.lower(n).isin(NO_SPEC) & ~odd(f"_name{k}") & ~odd(f"_value{k}") & ~(n.contains("/") & ~n.rlike(r"\d")) & ~F.lower(v).rlike(T.ASSET + "$")
        each = F.when(n.isNotNull() & fits, F.struct(n.alias("name"), v.alias("value"), F.when(u != "", u).alias("unit"))).otherwise(each)
    return out.withColumn(name, each).drop(*parts)


def kind_of(text: Column, rows: Column, found: Column) -> Column:
    """The kind of a block; the first rule that fits counts."""
    clean = F.trim(text)
    low = F.lower(clean)
    return (
        F.when(is_heading(clean), "section")
        .when(low.rlike(r"^(warning|danger)\b"), "warning")
        .when(low.rlike(r"^caution\b"), "caution")
        .when(low.rlike(r"^(note|notice)\b"), "note")
        .when(clean.rlike(r"^\d+[.)]\s+"), "procedure_step")
        .when(rows.isNotNull(), "table")
        .when(found.isNotNull(), "spec")
        .otherwise("paragraph")
    )


def _table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def _spec_text(found: Column) -> Column:
    return F.concat(found["name"], F.lit(": "), found["value"], F.coalesce(F.concat(F.lit(" "), found["unit"]), F.lit("")))


def nodes(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, ordinal, page, kind, text, heading, section, level, step, spec, rows, citability, n_tokens) of blocks (doc, ordinal, page, text).

    text is a table's or spec's plain form, else the block's own; section is the last heading at or before a block, null
    before any. Null and ignorable blocks go; equal ordinals of a document stand in the order of their texts.
    """
    kept = blocks.where(F.col("text").isNotNull() & ~ignorable(F.col("text"))).select(doc, "ordinal", "page", F.trim("text").alias("raw"))
    read = with_spec(with_rows(kept, "raw"), "raw")
    # a list of one row: filters on a kind look at the column, and do not match all patterns anew
    read = read.select(doc, "ordinal", "page", "raw", F.inline(F.array(F.struct(kind_of(F.col("raw"), F.col("rows"), F.col("spec")).alias("kind"), "rows", "spec"))))
    for kind, column in (("table", "rows"), ("spec", "spec")):
        read = read.withColumn(column, F.when(F.col("kind") == kind, F.col(column)))
    text = F.when(F.col("kind") == "table", _table_text(F.col("rows"))).when(F.col("kind") == "spec", _spec_text(F.col("spec"))).otherwise(_clean(F.col("raw")))
    read = read.withColumn("text", text).withColumn("heading", F.when(F.col("kind") == "section", F.substring(F.substring_index("raw", "\n", 1), 1, 160)))
    before = Window.partitionBy(doc).orderBy("ordinal", "raw").rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumn("section", F.last("heading", ignorenulls=True).over(before))
    step = F.when(F.col("kind") == "procedure_step", F.regexp_extract("raw", r"^(\d+)", 1).cast("int"))
    level = F.when(F.col("kind") == "warning", "warning").when(F.col("kind") == "caution", "caution")
    return read.select(
        doc, "ordinal", "page", "kind", "text", "heading", "section", level.alias("level"), step.alias("step"), "spec", "rows",
        F.when(F.col("text") != "", 0.9).otherwise(0.1).alias("citability"), F.size(T.words(F.col("text"))).alias("n_tokens"),
    )


def normalised(found: DataFrame, doc: str = "doc") -> DataFrame:
    """nodes with normalised texts, keywords, and citability by kind; sections keep theirs and the count of their words.

    A step whose text does not begin with its number gets it in front.
    """
    text = T.normalized(F.col("text"))
    number = F.col("step").cast("string")
    text = F.when((F.col("kind") == "procedure_step") & (F.col("step") != 0) & ~text.startswith(number), F.concat(number, F.lit(". "), text)).otherwise(text)
    out = found.withColumn("text", text).withColumn("keywords", T.keywords(F.col("text")))
    plain = F.col("kind") != "section"
    cited = F.when(F.col("kind").isin("warning", "caution", "procedure_step", "spec", "table"), 0.99).when(F.col("kind") == "header_footer", 0.05).otherwise(0.98)
    out = out.withColumn("citability", F.when(plain, cited).otherwise(F.col("citability"))).withColumn("n_tokens", F.when(plain, F.size(T.words(F.col("text")))).otherwise(F.col("n_tokens")))
    heading = F.when(F.col("kind") == "section", F.substring(F.substring_index("text", "\n", 1), 1, 160))
    before = Window.partitionBy(doc).orderBy("ordinal", "text").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(before))


def lines_of(docs: DataFrame, page_lines: int = 40) -> DataFrame:
    """Documents as blocks, a line each: (doc, ordinal, page, text). A page has page_lines lines. Null texts give none."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return lines.select("doc", F.col("ordinal").cast("long").alias("ordinal"), (F.floor(F.col("ordinal") / page_lines) + 1).cast("long").alias("page"), "text")


def paragraphs_of(pages: DataFrame) -> DataFrame:
    """Pages of text (doc, page, text) as blocks parted by blank lines: (doc, ordinal, page, text); ordinals run within a page."""
    parts = pages.select("doc", "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("ordinal", "text"))
    return parts.select("doc", F.col("ordinal").cast("long").alias("ordinal"), "page", F.trim("text").alias("text")).where("text <> ''")


def parse_quality(chars: Column, pages: Column) -> Column:
    """Quality of a plain parse: more text a page is better, up to 1."""
    return F.least(F.lit(1.0), 0.2 + chars / F.greatest(pages, F.lit(1)) / 2000)


def page_ranges(documents: DataFrame, pages: str, size: int) -> DataFrame:
    """Each document's pages 1..n in ranges: (columns, first_page, last_page)."""
    starts = documents.where(F.col(pages) >= 1).withColumn("first_page", F.explode(F.sequence(F.lit(1).cast("long"), F.col(pages).cast("long"), F.lit(size).cast("long"))))
    return starts.withColumn("last_page", F.least(F.col("first_page") + size - 1, F.col(pages).cast("long")))


def dense_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse cells (keys, row, column, seq, text) as one row of texts for each table row: the last cell of a place counts, gaps are ''."""
    last = cells.groupBy(*keys, "row", "column").agg(F.max_by(F.trim("text"), "seq").alias("text"))
    width = last.groupBy(*keys).agg((F.max("column") + 1).alias("width"))
    rows = last.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("at")).join(width, keys)
    grid = F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), lambda c: F.coalesce(F.col("at")[c], F.lit("")))
    return rows.select(*keys, "row", grid.alias("cells"))


def matched_pages(blocks: DataFrame, pages: DataFrame, keys: list[str], prefix: int = 240, least: int = 24) -> DataFrame:
    """(keys, ordinal, page): the only page of a document that holds a block's text; if none or several do, the only one that
    holds the first prefix letters and digits of it, least at least. Blocks without such a page are left out."""
    flat = lambda c: F.lower(T.collapsed(F.col(c)))
    compact = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")
    left = blocks.select(*keys, "ordinal", flat("text").alias("b"), F.substring(compact("text"), 1, prefix).alias("bc"))
    right = pages.select(*keys, "page", flat("text").alias("p"), compact("text").alias("pc"))
    met = left.join(right, keys).groupBy(*keys, "ordinal").agg(*(F.collect_set(F.when(hit, F.col("page"))).alias(name) for name, hit in (("whole", F.col("p").contains(F.col("b")) & (F.col("b") != "")), ("part", F.col("pc").contains(F.col("bc")) & (F.length("bc") >= least)))))
    page = F.when(F.size("whole") == 1, F.col("whole")[0]).when(F.size("part") == 1, F.col("part")[0])
    return met.select(*keys, "ordinal", page.alias("page")).where("page is not null")
