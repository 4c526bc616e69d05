"""Health of a document's parse and chunks: what is measured, and what a check finds wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.evaluation import quality

# Chunk types of structured records, and ceilings of the checks.
STRUCTURED = ["spec_record", "datasheet_record", "table_record", "procedure_record", "warning_record"]
MOST_MEAN, MOST_PAGE, MOST_SHORT, MOST_LOW, MOST_STRUCTURED_LOW = 40, 150, 0.45, 0.35, 0.15


def _ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole (whole numbers) to so many places, halves up: exact, where rounding a double depends on how it is stored."""
    scale = 10**places
    return F.floor((2 * scale * part + whole) / (2 * whole)) / scale


def _density(rows: DataFrame, page: str, name: str) -> DataFrame:
    """(doc, <name>_pages, first and last, mean and most rows a page) by page first, so that a long document is added up in parts."""
    pages = rows.groupBy("doc", F.col(page).alias("page")).agg(F.count("*").alias("n"))
    return pages.groupBy("doc").agg(
        F.count("*").alias(f"{name}_pages"), F.min("page").alias(f"first_{name}_page"), F.max("page").alias(f"last_{name}_page"), _ratio(F.sum("n"), F.count("*"), 2).alias(f"mean_{name}s"), F.max("n").alias(f"most_{name}s")
    )


def measures(documents: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each of documents (doc, page_count) from nodes (doc, page, kind, text, n_tokens) and chunks (doc, page_from,
    chunk_type, content): pages and density of both, shares of short and repeated texts, of low information, mean signal.

    Counts and shares of a document without nodes or chunks are 0, its pages null; a null page_count is 0.
    """
    prose = F.col("kind").isin("paragraph", "note")
    said = F.lower(F.trim("text"))
    texts = nodes.groupBy("doc", said.alias("said")).agg(F.count("*").alias("n"), F.count_if(prose).alias("prose"), F.count_if(prose & (F.col("n_tokens") <= 3)).alias("short"))
    share = lambda part, whole: _ratio(F.sum(part), F.greatest(F.sum(whole), F.lit(1)), 4)
    full = F.when(F.col("said") != "", F.col("n")).otherwise(0)
    more = F.when(F.col("said") != "", F.col("n") - 1).otherwise(0)
    ratios = texts.groupBy("doc").agg(share(F.col("short"), F.col("prose")).alias("short_ratio"), share(more, full).alias("repeat_ratio"))
    flags = quality(F.col("content"), F.col("chunk_type"))
    told = chunks.select("doc", F.col("chunk_type").isin(STRUCTURED).alias("structured"), *(flags[c].alias(c) for c in ("low_information", "structured_low", "signal")))
    held = told.groupBy("doc").agg(
        F.count("*").alias("n_chunks"), F.count_if("structured").alias("n_structured"), _ratio(F.count_if("low_information"), F.count("*"), 4).alias("low_ratio"),
        _ratio(F.count_if("structured_low"), F.greatest(F.count_if("structured"), F.lit(1)), 4).alias("structured_low_ratio"), _ratio(F.sum(F.round(100 * F.col("signal")).cast("long")), 100 * F.count("*"), 4).alias("signal_mean"),
    )
    out = documents.select("doc", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"))
    for part in (_density(nodes, "page", "node"), _density(chunks, "page_from", "chunk"), ratios, held):
        out = out.join(part, "doc", "left")
    places = ("first_node_page", "last_node_page", "first_chunk_page", "last_chunk_page")
    return out.select("doc", "page_count", *(F.col(c) if c in places else F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c not in ("doc", "page_count")))


def findings(measured: DataFrame) -> DataFrame:
    """(doc, check_name, status, error) of three checks of each document: where its nodes come from, how it is cut up, what its chunks say."""
    c = F.col
    many = c("page_count") > 1
    outside = (c("node_pages") > 0) & ((c("first_node_page") < 1) | (c("last_node_page") > c("page_count")))
    first = lambda *rules: F.coalesce(*(F.when(fits, text) for fits, text in rules), F.lit(None).cast("string"))
    errors = {
        "page_provenance": first((many & (c("node_pages") <= 1), "nodes stand on a single page"), (outside, "nodes stand outside the pages of the source")),
        "fragmentation": first(
            (many & (c("chunk_pages") <= 1), "chunks stand on a single page"), ((c("mean_chunks") > MOST_MEAN) | (c("most_chunks") > MOST_PAGE), "too many chunks a page"), (many & (c("short_ratio") > MOST_SHORT), "too many short texts")
        ),
        "chunk_quality": first((c("low_ratio") > MOST_LOW, "too many chunks say little"), ((c("n_structured") > 0) & (c("structured_low_ratio") > MOST_STRUCTURED_LOW), "too many structured chunks say little")),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("check_name"), error.alias("error")) for name, error in errors.items())))
    return measured.select("doc", rows.alias("r")).select("doc", "r.check_name", F.when(F.col("r.error").isNull(), "pass").otherwise("fail").alias("status"), "r.error")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(doc, grp, n): chunks of a document in all, by level and by type."""
    sets = chunks.groupingSets([["doc"], ["doc", "level"], ["doc", "chunk_type"]], "doc", "level", "chunk_type")
    group = F.when(F.grouping("level") == 0, F.concat(F.lit("level "), F.col("level").cast("string"))).when(F.grouping("chunk_type") == 0, F.concat(F.lit("type "), F.col("chunk_type"))).otherwise("all")
    return sets.agg(group.alias("grp"), F.count("*").alias("n")).select("doc", "grp", "n")


def chunk_type_of(kind: Column) -> Column:
    """The type of the chunks that a node's kind gives."""
    return F.when(kind == "spec", "spec_record").when(kind == "table", "table_record").when(kind == "procedure_step", "procedure_record").when(kind.isin("warning", "caution"), "warning_record").otherwise("atomic_text")
