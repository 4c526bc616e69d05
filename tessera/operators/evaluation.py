"""Benchmark questions from chunks, their checks, and how results of a search are scored and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Phrases of questions about the document itself, limits and gates.
BOUND = ["this document", "this manual", "the manual", "this datasheet", "the datasheet", "this section", "where does", "what does", "which step in", "what procedure in", "what warning does"]
META_STARTS = ["what specification", "what value", "where does", "what does", "which step in", "what procedure", "what warning", "in "]
META_PARTS = ["is listed for", "does the table say about", "refers to", "mentions", "discuss"]
RECORDS = ["spec_record", "datasheet_record", "table_record"]
IGNORED = T.EVAL_STOPWORDS + T.GENERIC_ANCHORS + ["new", "series"]
GATES = {"pass_rate": 0.70, "validity": 0.95, "atomic": 0.60, "structured": 0.75}


def _named(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def queryworthy(anchors: Column) -> Column:
    """Whether a chunk (chunk_type, content) can be asked about: 40 characters, an anchor, no table of contents or boilerplate, and
    something concrete by its kind."""
    content, kind = F.trim("content"), F.col("chunk_type")
    strong = F.size(F.filter(anchors, T.high_signal)) >= 1
    tokens = T.eval_tokens(content)
    measured = F.exists(tokens, lambda t: t.rlike(r"\b\d+(?:\.\d+)?(?:v|a|ma|w|kw|mm|cm|m|ms|s|hz|khz|mhz|fps|kg|g|n|mpa|°c|c|%)\b"))
    acting = F.exists(tokens, lambda t: t.isin(T.TECHNICAL_VERBS))
    fields = F.size(T.field_pairs(content)) > 0
    labelled = F.exists(T.menu_labels(content), lambda m: F.length(F.trim(m)) >= 3)
    concrete = F.when(kind.isin(RECORDS), fields | measured | strong).when(kind == "procedure_record", acting & strong).when(kind == "warning_record", strong).otherwise((fields | measured | labelled | acting) & strong)
    return (F.length(content) >= 40) & ~T.contents_line(content) & ~T.boilerplate(content) & (F.size(anchors) >= 1) & concrete


def questions_of(chunks: DataFrame, limit: int = 3) -> DataFrame:
    """(chunk_id, n, query, method, and the chunk's columns): limit questions at most about every chunk that can be asked about.

    Questions name the chunk's first model, else its title, and its first anchors; a menu label goes first.
    """
    read = chunks.withColumn("anchors", T.anchors(F.trim("content"))).where(queryworthy(F.col("anchors")))
    label = F.get(F.filter(F.transform(T.menu_labels(F.trim("content")), T.trimmed), lambda m: F.length(m) >= 3), F.lit(0))
    told = F.when(label.isNotNull() & ~F.array_contains("anchors", label), F.slice(F.concat(F.array(label), "anchors"), 1, 6)).otherwise(F.col("anchors"))
    read = read.withColumn("words", told).withColumn("about", F.coalesce(F.get("product_models", F.lit(0)), F.nullif(F.trim("title"), F.lit("")), F.lit("this document")))
    read = read.withColumn("p", F.get("words", F.lit(0))).withColumn("s", F.coalesce(F.get("words", F.lit(1)), "p")).withColumn("t", F.coalesce(F.get("words", F.lit(2)), "s"))
    a, p, s, t = (F.col(c) for c in ("about", "p", "s", "t"))
    two, three = s != p, ~((t == p) | (t == s))
    one = lambda q, m, fits=None: F.struct(q.alias("query"), F.lit(m).alias("method")) if fits is None else F.when(fits, F.struct(q.alias("query"), F.lit(m).alias("method")))
    spec = F.array(one(_named(a, p, s), "spec_primary_multi", two), one(_named(a, p, s, t), "spec_context_multi", three), one(_named(p, s, "for", a), "spec_value"), one(_named(a, p, s), "spec_multi", two))
    table = F.array(one(_named(a, p, s), "table_primary_multi", two), one(_named(p, s, t, a), "table_context_multi", three), one(_named(a, p), "table_primary"))
    procedure = F.array(one(_named("how to", p, a), "procedure_howto"), one(_named(p, s, "steps", a), "procedure_step", two), one(_named(p, "procedure", a), "procedure_describe"))
    warning = F.array(one(_named(a, "warning", p), "warning_primary"), one(_named(a, "caution", p, s), "warning_caution", two))
    other = F.array(one(_named(a, p, s), "general_multi", F.size("words") >= 2), one(_named(a, p), "general_primary"))
    kind = F.col("chunk_type")
    each = F.when(kind.isin("spec_record", "datasheet_record"), spec).when(kind == "table_record", table).when(kind == "procedure_record", procedure).when(kind == "warning_record", warning).otherwise(other)
    asked = read.select("*", F.posexplode(F.slice(F.array_compact(each), 1, limit)).alias("n", "q"))
    return asked.select(*chunks.columns, "anchors", (F.col("n") + 1).alias("n"), "q.query", "q.method")


def specificity(query: Column, terms: Column) -> Column:
    """How much a question names: numbers, technical terms, expected terms and length count."""
    tokens = T.eval_tokens(query)
    add = lambda fits, n: F.when(fits, n).otherwise(0)
    return (
        add(F.exists(tokens, lambda t: t.rlike(r"\d")), 2) + add(F.exists(tokens, lambda t: t.isin(T.TECHNICAL_TERMS)), 2) + add(F.size(terms) >= 2, 2) + add(F.exists(terms, T.specific), 2) + add(F.length(query) >= 28, 1)
    )


def _counted(values: Column, fits: Column) -> Column:
    return F.size(F.filter(values, lambda v: F.array_contains(fits, v)))


def affinity() -> Column:
    """How close a question's terms are to its source: those in the content, those that are anchors, and those that say much."""
    model = F.coalesce(F.get("product_models", F.lit(0)), F.lit(""))
    known = T.eval_tokens(F.concat_ws(" ", "content", "section", "title", model))
    asked = F.array_distinct(F.filter(T.eval_tokens(F.col("query")), lambda t: ~t.isin(IGNORED)))
    terms = F.filter(asked, lambda t: F.array_contains(known, t) | T.high_signal(t))
    return _counted(terms, T.eval_tokens(F.col("content"))) + _counted(terms, F.col("anchors")) + F.size(F.filter(terms, T.high_signal))


def content_overlap() -> Column:
    asked = F.filter(T.eval_tokens(F.col("query")), lambda t: ~t.isin(IGNORED))
    return _counted(asked, T.eval_tokens(F.col("content")))


def verdict(cases: DataFrame) -> DataFrame:
    """cases with affinity, specificity and quality: validated, or the first reason against them."""
    low, kind = T.folded(F.col("query")), F.col("chunk_type")
    starts = F.lit(False)
    for start in META_STARTS:
        starts = starts | low.startswith(start)
    atomic, record = kind == "atomic_text", kind.isin(RECORDS)
    scored = cases.withColumn("specificity", specificity(F.col("query"), F.slice("anchors", 1, 4))).withColumn("affinity", affinity()).withColumn("shared", content_overlap())
    weak = (F.col("affinity") < F.when(record, 4).otherwise(3)) | (record & (F.col("shared") < 2))
    quality = (
        F.when(F.size("anchors") == 0, "no_specific_anchor")
        .when(T.any_of(low, BOUND), "document_bound_query")
        .when(starts | T.any_of(low, META_PARTS), "meta_query")
        .when(atomic & (F.size("anchors") < 2), "atomic_requires_two_anchors")
        .when(atomic & ~F.exists("anchors", T.high_signal), "atomic_requires_high_signal_anchor")
        .when(F.col("specificity") < 5, "low_specificity")
        .when(weak, "weak_source_affinity")
        .otherwise("validated")
    )
    return scored.withColumn("quality", quality)


def in_evidence(term: Column, evidence: Column, tokens: Column) -> Column:
    """Whether a term is in an evidence text (folded; tokens: its tokens): as it is, or by its tokens; of one with /, all parts."""
    own = T.eval_tokens(term)
    parts = F.filter(F.split(F.element_at(own, 1), "/"), lambda p: (p != "") & ~p.isin(T.EVAL_STOPWORDS))
    slashed = (F.size(parts) > 0) & F.forall(parts, lambda p: F.array_contains(tokens, p))
    single = F.when(F.element_at(own, 1).contains("/"), slashed).otherwise(F.array_contains(tokens, F.element_at(own, 1)))
    several = F.forall(F.filter(own, lambda t: ~t.isin(T.EVAL_STOPWORDS)), lambda t: F.array_contains(tokens, t))
    clean = T.folded(term)
    return (clean != "") & (evidence.contains(clean) | F.when(F.size(own) == 0, False).when(F.size(own) == 1, single).otherwise(several))


def judged(cases: DataFrame, hits: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """(case_id, passed, rank, reason, failure, candidate_recall) of every case (case_id, query, chunk_id, doc, section, chunk_type,
    terms) from the first top hits (case_id, rank, chunk_id).

    A hit passes as the case's own chunk, by enough expected terms in the same section or document, or by two of them and two
    terms of the question in the same document. Cases without hits fail as missed.
    """
    found = hits.where(F.col("rank") <= top).join(chunks.select("chunk_id", *(F.col(c).alias(f"h_{c}") for c in ("doc", "section", "chunk_type", "content", "title")), F.get("product_models", F.lit(0)).alias("h_model")), "chunk_id")
    met = found.withColumnRenamed("chunk_id", "h_chunk").join(cases, "case_id")
    met = met.withColumn("told", F.concat_ws(" ", "h_content", "h_title", "h_section", "h_model", "h_chunk_type"))
    met = met.withColumn("evidence", T.folded(F.col("told"))).withColumn("held", F.array_distinct(T.eval_tokens(F.col("told"))))
    has = lambda t: in_evidence(t, F.col("evidence"), F.col("held"))
    asked = F.array_distinct(F.filter(T.eval_tokens(F.col("query")), lambda t: ~t.isin(IGNORED)))
    met = met.withColumn("overlap", F.size(F.filter("terms", has))).withColumn("asked", F.size(F.filter(asked, has)))
    same = F.col("h_doc") == F.col("doc")
    enough = F.col("overlap") >= F.greatest(F.lit(2), F.least(F.lit(3), F.size("terms")))
    reason = F.when(F.col("h_chunk") == F.col("chunk_id"), "exact_chunk").when(same & (F.col("h_section") == F.col("section")) & enough, "same_section_term_overlap").when(same & enough, "same_document_term_overlap")
    reason = reason.when(same & (F.col("overlap") >= 2) & (F.col("asked") >= 2), "same_document_answerable_evidence")
    met = met.withColumn("reason", reason).withColumn("same", same)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("rank", "reason")))
    summed = met.groupBy("case_id").agg(first.alias("hit"), F.max("same").alias("same"), F.max(F.col("h_chunk_type") == F.col("chunk_type")).alias("kind"), F.max("overlap").alias("overlap"))
    out = cases.select("case_id", "chunk_type", "doc").join(summed, "case_id", "left")
    failure = F.when(F.col("hit").isNotNull(), F.lit(None).cast("string")).when(F.col("same"), "ranking_or_context_loss").when(F.col("kind") & (F.col("overlap") >= 1), "wrong_document_or_filter_loss").otherwise("candidate_miss")
    passed = F.col("hit").isNotNull()
    return out.select("case_id", "doc", "chunk_type", passed.alias("passed"), F.coalesce("hit.rank", F.lit(0)).alias("rank"), F.coalesce("hit.reason", F.lit("no_match")).alias("reason"), failure.alias("failure"), (passed | F.coalesce("same", F.lit(False))).alias("candidate_recall"))


def summary(results: DataFrame) -> DataFrame:
    """Counts and rates of judged results, in all (grp all), by chunk_type and by doc."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    within = lambda k: rate(F.col("passed") & (F.col("rank") <= k))
    sets = results.groupingSets([[], ["chunk_type"], ["doc"]], "chunk_type", "doc")
    group = F.when(F.grouping("chunk_type") == 0, F.concat(F.lit("type "), F.col("chunk_type"))).when(F.grouping("doc") == 0, F.concat(F.lit("doc "), F.col("doc"))).otherwise("all")
    counted = sets.agg(
        group.alias("grp"), F.count("*").alias("total"), F.count_if("passed").alias("passes"), within(1).alias("pass_at_1"), within(3).alias("pass_at_3"), within(5).alias("pass_at_5"),
        F.round(F.coalesce(F.avg(F.when(F.col("passed"), F.col("rank"))), F.lit(0.0)), 6).alias("mean_rank"), rate(F.col("candidate_recall")).alias("recall"),
        *(F.count_if(F.col("failure") == f).alias(f) for f in ("ranking_or_context_loss", "wrong_document_or_filter_loss", "candidate_miss")),
    )
    return counted.drop("chunk_type", "doc")


def gates(runs: DataFrame) -> DataFrame:
    """One row for runs (chunk_type, total, passed, validity): overall rates weighted by questions, and whether all gates are met."""
    rate = lambda passed, total: F.when(total > 0, passed / total).otherwise(0.0)
    kinds = runs.groupBy("chunk_type").agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"), F.sum(F.col("validity") * F.col("total")).alias("valid"))
    structured = F.min(F.when(F.col("chunk_type").isin("spec_record", "table_record", "procedure_record") & (F.col("total") > 0), F.col("passed") / F.col("total")))
    atomic = F.coalesce(F.sum(F.when(F.col("chunk_type") == "atomic_text", F.col("passed"))) / F.greatest(F.sum(F.when(F.col("chunk_type") == "atomic_text", F.col("total"))), F.lit(1)), F.lit(0.0))
    one = kinds.agg(F.sum("total").alias("total"), F.sum("passed").alias("passes"), F.round(rate(F.sum("passed"), F.sum("total")), 4).alias("pass_rate"), F.round(rate(F.sum("valid"), F.sum("total")), 4).alias("validity"), atomic.alias("atomic_rate"), F.coalesce(structured, F.lit(0.0)).alias("structured_rate"))
    ready = (F.col("pass_rate") >= GATES["pass_rate"]) & (F.col("validity") >= GATES["validity"]) & (F.col("atomic_rate") >= GATES["atomic"]) & (F.col("structured_rate") >= GATES["structured"])
    return one.withColumn("ready", ready).withColumn("atomic_rate", F.round("atomic_rate", 6)).withColumn("structured_rate", F.round("structured_rate", 6))


def quality(text: Column, chunk_type: Column) -> dict[str, Column]:
    """Flags of a content: its tokens, values, unwanted parts, whether it says little, and a score of its technical signal."""
    clean, low = F.trim(text), F.lower(F.trim(text))
    tokens = T.tokens(clean)
    n, lettered, digits = F.size(tokens), F.size(F.filter(tokens, lambda t: t.rlike("[a-z]"))), F.size(F.filter(tokens, lambda t: t.rlike(r"\d")))
    value = low.rlike(T.VALUE.split("|", 1)[1])
    url, page, contact, asset = low.rlike(T.URL), low.rlike(T.PAGE_MARK), low.rlike(T.PHONE_WORD) | clean.rlike(T.PHONE), low.rlike(r"\.(?:gif|jpg|jpeg|png|svg|tif|tiff|bmp)\b")
    sentence = clean.rlike("[.:;]") | (n >= 8)
    little = (clean != "") & (url | page | contact | asset | ((n <= 2) & ~value) | ((lettered <= 1) & ~value & ~sentence) | ((n > 0) & (digits >= lettered) & ~value))
    add = lambda fits, v: F.when(fits, v).otherwise(0.0)
    structured = chunk_type.isin("spec_record", "datasheet_record", "table_record", "procedure_record", "warning_record")
    score = add(n >= 5, 0.3) + add(value, 0.4) + add(F.exists(tokens, lambda t: t.rlike(r"\d") & t.rlike("[a-z]")), 0.2) + add(structured, 0.15) - add(clean.rlike(T.PHONE) | url, 0.4) - add(page, 0.3)
    return {"n_tokens": n, "has_value": value, "url_like": url, "page_marker": page, "contact_like": contact, "asset_like": asset, "low_information": little, "structured_low": structured & little, "signal": F.when(n > 0, F.round(score, 4)).otherwise(0.0)}


def parse_checks(nodes: DataFrame) -> DataFrame:
    """One row for each document (doc): pages, their density, short nodes and repeated texts: what a parse is judged by."""
    pages = nodes.groupBy("doc", "page").agg(F.count("*").alias("n"))
    density = pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.round(F.avg("n"), 6).alias("mean_density"), F.max("n").alias("most_density"))
    texts = nodes.groupBy("doc", "text").agg(F.count("*").alias("n"), F.sum((F.col("n_tokens") <= 3).cast("int")).alias("short"), F.sum((F.col("kind") == "section").cast("int")).alias("sections"))
    ratios = texts.groupBy("doc").agg(F.sum("n").alias("n_nodes"), F.round(F.sum("short") / F.sum("n"), 6).alias("short_ratio"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("repeat_ratio"), F.sum("sections").alias("n_sections"))
    both = density.join(ratios, "doc")
    broken = (F.col("mean_density") > 40) | (F.col("most_density") > 150) | (F.col("short_ratio") > 0.45)
    return both.withColumn("status", F.when(broken, "fail").otherwise("pass"))


def shuffled(cases: DataFrame, key: str, seed: int) -> DataFrame:
    """cases with a place (from 1) in an order that seed decides alone, the same wherever it runs."""
    return cases.withColumn("place", F.row_number().over(Window.orderBy(F.sha1(F.concat_ws(":", F.lit(seed), F.col(key))), key)))


def answers_scored(answers: DataFrame) -> DataFrame:
    """answers (case_id, answer, terms, retrieved, citations) with passed and the sorted failures of each: no answer, no expected term
    in it, no citation, or the case's chunk not retrieved. Null answers are empty."""
    text = F.coalesce("answer", F.lit(""))
    has = lambda t: in_evidence(t, T.folded(text), F.array_distinct(T.eval_tokens(text)))
    reasons = {
        "empty_answer": F.trim(text) == "", "missing_terms": ~F.exists("terms", has), "no_citations": F.coalesce("citations", F.lit(0)) < 1, "retrieval_miss": ~F.coalesce("retrieved", F.lit(False)),
    }
    failures = F.array_sort(F.array_compact(F.array(*(F.when(bad, name) for name, bad in reasons.items()))))
    return answers.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def end_to_end(scored: DataFrame) -> DataFrame:
    """One row of counts and percentages of scored answers."""
    share = lambda fits: F.round(100 * F.coalesce(F.avg(fits.cast("double")), F.lit(0.0)), 2)
    return scored.agg(F.count("*").alias("total"), F.count_if("passed").alias("passes"), share(F.col("passed")).alias("pass_rate"), share(~F.array_contains("failures", "empty_answer")).alias("answered_rate"), share(F.coalesce("retrieved", F.lit(False))).alias("retrieved_rate"))


def selections_scored(cases: DataFrame, chosen: DataFrame, top: int = 5) -> DataFrame:
    """(case_id, attempted, passed, rank, failure): whether a case's document is among the first top documents chosen for it."""
    own = chosen.withColumnRenamed("doc", "_doc").withColumnRenamed("rank", "_rank")
    met = cases.join(own, "case_id", "left").groupBy("case_id").agg(F.count("_doc").alias("n"), F.coalesce(F.min(F.when((F.col("_doc") == F.col("doc")) & (F.col("_rank") <= top), F.col("_rank"))), F.lit(0)).alias("rank"))
    failure = F.when(F.col("n") == 0, "metadata_selection_not_recorded").when(F.col("rank") == 0, "metadata_document_miss")
    return met.select("case_id", (F.col("n") > 0).alias("attempted"), (F.col("rank") > 0).alias("passed"), "rank", failure.alias("failure"))
