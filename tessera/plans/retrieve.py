"""Retrieval of a whole table of questions over chunks, from scores to context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import questions as Q
from tessera.operators import retrieval as R
from tessera.operators import scopes as S
from tessera.sources.interim import written


def _routes(analysis: DataFrame) -> DataFrame:
    """(query_id, route, scope, chunk_types, version_signal) of the special routes that ask for kinds of chunks."""
    name = F.concat_ws("|", F.array_join("chunk_types", ","), F.coalesce("version_signal", F.lit("")))
    return Q.routes(analysis).where("keyword is null").select("query_id", "route", name.alias("scope"), "chunk_types", "version_signal")


def once(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analysis of the different questions, (asked, query_id) of all): what a question gets depends on its text alone."""
    different, same = Q.asked_once(questions.select("query_id", "query"), ["query"])
    return written(Q.analysed(different), "questions"), written(same, "same")


def scopes(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((scope, chunk_types, version_signal), (query_id, scope, query)): all chunks, tables, and the chunk types of each special route."""
    plain = analysis.sparkSession.createDataFrame([("all", None, None), ("table", ["table_record"], None)], "scope string, chunk_types array<string>, version_signal string")
    named = _routes(analysis)
    every = plain.unionByName(named.select("scope", "chunk_types", "version_signal").distinct())
    asked = analysis.select("query_id", "query")
    wanted = asked.withColumn("scope", F.explode(F.array(F.lit("all"), F.lit("table")))).select("query_id", "scope", "query")
    wanted = wanted.unionByName(named.select("query_id", "scope").join(asked, "query_id").select("query_id", "scope", "query"))
    return written(every, "scopes"), written(wanted, "asked")


def special(analysis: DataFrame, vectors: DataFrame, words: DataFrame, limit: int = 40) -> DataFrame:
    """(query_id, chunk_id, score, best, rank): each special route's vectors and words fused, one route after the other.

    vectors, words: hits with the scopes of routes. Ranks go on counting from route to route; a chunk of several routes comes
    several times. A route for an error code has no list of its own where chunks hold no keywords, as codes are words.
    """
    named = written(_routes(analysis).select("query_id", "route", "scope"), "routes")
    placed = lambda hits: hits.join(named, ["query_id", "scope"])
    return S.run_on(S.fused_within([placed(vectors), placed(words)], limit, ["query_id", "route"], "chunk_id"), ["route"]).drop("route")


def candidates(chunks: DataFrame, analysis: DataFrame, limit: int = 40) -> list[DataFrame]:
    """Hits of the four searches: hashed vectors, words, tables, and each question's special routes, in that order."""
    every, wanted = scopes(analysis)
    vectors, words = (written(search(chunks, wanted, every, limit), "hits") for search in (R.hashed, R.lexical))
    of = lambda hits, scope: hits.where(F.col("scope") == scope)
    routed = special(analysis, *(hits.where("scope not in ('all', 'table')") for hits in (vectors, words)), limit)
    return [of(vectors, "all"), of(words, "all"), R.fused([of(vectors, "table"), of(words, "table")], limit), routed]


def told(pool: DataFrame, chunks: DataFrame, analysis: DataFrame) -> DataFrame:
    """Hits with the columns of their chunk and what is known of their question."""
    known = analysis.select("query_id", "query_types", "query_terms", "latest_only")
    pool = written(pool, "pool")
    return pool.select("query_id", "chunk_id", "score", "rank").join(chunks, "chunk_id").join(known, "query_id")


def retrieve(chunks: DataFrame, questions: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id, score, chunk_type, context_window, parent_context, documents): the whole plan.

    documents are those that the question's metadata search names; they do not narrow the search where scores are equal across
    documents, as here. Chunks' and questions' columns: see retrieval and questions.
    """
    analysis, same = once(questions)
    pool = told(R.fused(candidates(chunks, analysis)), chunks, analysis)
    chosen = R.family_selected(R.aligned(R.completed(R.family_scored(pool))))
    final = R.assembled(R.deduplicated(R.reranked(R.enriched(chosen, chunks))), chunks, limit)
    documents = R.documents_chosen(chunks, analysis.select("query_id", "query")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"].cast("string")).alias("documents"))
    found = final.join(documents, "query_id", "left").select("query_id", "rank", "chunk_id", "score", "chunk_type", "context_window", "parent_context", "documents")
    return Q.for_all(found, same)


def trace(chunks: DataFrame, analysis: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, stage, rank, chunk_id, score, kept, lost): the first hits of every stage of a retrieval.

    kept is how many hits a stage has; lost, from the stages after fusion on, how many of the stage before are not among
    them. Each stage is made once, a table, and the next one reads it.
    """
    lists = [written(hits.select("query_id", "chunk_id", "score", "rank"), "hits") for hits in candidates(chunks, analysis)]
    stages = dict(zip(("dense", "sparse", "table", "special"), lists, strict=True))
    stages["fused"] = written(R.fused(lists), "fused")
    stages["family_scored"] = written(R.family_scored(told(stages["fused"], chunks, analysis)), "scored")
    stages["query_aligned"] = written(R.aligned(R.completed(stages["family_scored"])), "aligned")
    stages["family_selected"] = written(R.family_selected(stages["query_aligned"]), "selected")
    stages["reranked"] = written(R.reranked(R.enriched(stages["family_selected"], chunks)), "reranked")
    every = None
    for k, (name, hits) in enumerate(stages.items()):
        own = hits.select("query_id", F.lit(name).alias("stage"), F.lit(k).alias("n"), "chunk_id", "rank", "score")
        every = own if every is None else every.unionByName(own)
    kept = every.groupBy("query_id", "n").agg(F.count("*").alias("kept"))
    after = every.select("query_id", "chunk_id", (F.col("n") - 1).alias("n"), F.lit(True).alias("stays"))
    gone = every.where("n >= 4").join(after, ["query_id", "chunk_id", "n"], "left").groupBy("query_id", (F.col("n") + 1).alias("n")).agg(F.count_if(F.col("stays").isNull()).alias("lost"))
    return every.where(F.col("rank") <= top).join(kept, ["query_id", "n"]).join(gone, ["query_id", "n"], "left").drop("n")
