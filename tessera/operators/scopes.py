"""Searches within scopes: what a set of filters leaves of a table, scored by the statistics of just those rows.

Filters are arrays of (key, values). A row fits a filter whose values hold its value, or one of its values; empty filters fit
all rows, filters on keys that rows lack fit none. Equal sets of filters are one scope, whoever asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as R

FILTERS = "array<struct<key:string,values:array<string>>>"


def canonical(filters: Column) -> Column:
    """Filters in one order, without empty ones and repeated values."""
    plain = F.transform(filters, lambda f: F.struct(f["key"].alias("key"), F.array_sort(F.array_distinct(f["values"])).alias("values")))
    return F.array_sort(F.filter(plain, lambda f: F.size(f["values"]) > 0))


def with_filters(filters: Column, more: Column) -> Column:
    """Filters with others put in the place of those with the same keys."""
    keys = F.transform(more, lambda f: f["key"])
    return F.concat(F.filter(filters, lambda f: ~F.array_contains(keys, f["key"])), more)


def one_filter(key: str, values: Column) -> Column:
    return F.array(F.struct(F.lit(key).alias("key"), values.alias("values")))


def scope_of(filters: Column) -> Column:
    """The name of a scope: a hash of its canonical filters."""
    return F.xxhash64(canonical(filters))


def held(columns: dict[str, str], lists: list[str]) -> Column:
    """What a row holds, by key: columns says which column a key is found in, lists which of them are lists."""
    values = lambda c: F.transform(F.col(c), lambda v: v.cast("string")) if c in lists else F.array(F.col(c).cast("string"))
    return F.create_map(*(x for key, c in columns.items() for x in (F.lit(key), F.array_compact(F.coalesce(values(c), F.array().cast("array<string>"))))))


def members(rows: DataFrame, scopes: DataFrame, key: str, columns: dict[str, str], lists: list[str]) -> DataFrame:
    """(scope, key) of the rows that fit all filters of a scope (scope, filters).

    Of each scope the filter that fewest rows fit, by an index of facets, fetches rows; only these are held against the
    others. A scope without filters has every row.
    """
    known = rows.select(key, held(columns, lists).alias("held"))
    facts = known.select(key, F.explode("held").alias("facet", "found")).select(key, "facet", F.explode(F.array_distinct("found")).alias("value"))
    wanted = scopes.select("scope", canonical(F.col("filters")).alias("filters")).dropDuplicates(["scope"])
    each = wanted.select("scope", F.inline("filters")).select("scope", F.col("key").alias("facet"), F.explode("values").alias("value"))
    sizes = facts.groupBy("facet", "value").agg(F.count("*").alias("n"))
    costs = each.join(sizes, ["facet", "value"], "left").groupBy("scope", "facet").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = costs.groupBy("scope").agg(F.min(F.struct("n", "facet"))["facet"].alias("facet"))
    fetched = each.join(rarest, ["scope", "facet"]).join(facts, ["facet", "value"]).select("scope", key).distinct()
    rest = wanted.join(rarest, "scope").select("scope", F.filter("filters", lambda f: f["key"] != F.col("facet")).alias("rest"))
    fits = F.forall("rest", lambda f: F.coalesce(F.arrays_overlap(F.col("held")[f["key"]], f["values"]), F.lit(False)))
    some = fetched.join(rest, "scope").join(known, key).where(fits).select("scope", key)
    free = wanted.where(F.size("filters") == 0).select("scope")
    return some.unionByName(free.join(rows.select(key), F.lit(True)).select("scope", key))


def asked_tokens(asked: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, scope, token, times) of questions in their scopes."""
    return asked.select("query_id", "scope", F.explode(tokens).alias("token")).groupBy("query_id", "scope", "token").agg(F.count("*").alias("times"))


def weighed_within(found: DataFrame, sizes: DataFrame, within: DataFrame, tokens: DataFrame, key: str, *more: str) -> DataFrame:
    """(scope, token, key, w, bonus, more): BM25 weights of postings (key, length, token, tf, bonus, more) by the counts of each scope.

    sizes: (key, length) of all rows; found needs no more than the words that are asked for. Postings of asked words alone meet
    the members of scopes.
    """
    pairs = tokens.select("scope", "token").distinct()
    total = within.join(sizes, key).groupBy("scope").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    near = found.join(pairs.select("token").distinct(), "token", "left_semi")
    words = near.join(within, key).join(pairs, ["scope", "token"])
    df = words.groupBy("scope", "token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("length") / F.col("mean")))
    return words.join(df, ["scope", "token"]).join(total, "scope").select("scope", "token", key, weight.alias("w"), "bonus", *more)


def bm25_within(found: DataFrame, within: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(query_id, scope, key, score): BM25 and bonuses of postings (key, length, token, tf, bonus) by the counts of each scope."""
    weighed = weighed_within(found, found.select(key, "length").distinct(), within, tokens, key)
    return weighed.join(tokens, ["scope", "token"]).groupBy("query_id", "scope", key).agg(F.sum(F.col("w") * F.col("times") + F.col("bonus")).alias("score"))


def hashed_within(vectors: DataFrame, within: DataFrame, asked: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """(query_id, scope, key, score): cosines of vectors (key, slot, value) and asked (query_id, slot, value) in each question's scopes (query_id, scope)."""
    slots = named.join(asked.withColumnRenamed("value", "asked"), "query_id")
    near = vectors.join(slots.select("slot").distinct(), "slot", "left_semi")
    met = near.join(within, key).join(slots, ["scope", "slot"])
    return met.groupBy("query_id", "scope", key).agg(F.sum(F.col("value") * F.col("asked")).alias("score"))


def top(hits: DataFrame, limit: int, key: str, by: tuple[str, ...] = ("query_id", "scope")) -> DataFrame:
    """The best limit hits of each group with their rank; ties of scores, to ten places, go to the smaller key."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 10).desc(), key)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fused_within(lists: list[DataFrame], limit: int, by: list[str], key: str, k: int = R.FUSION) -> DataFrame:
    """(by, key, score, best, rank): reciprocal rank fusion in each group; best is the largest score in any list."""
    every = None
    for i, hits in enumerate(lists):
        own = hits.select(*by, key, "score", "rank", F.lit(i).alias("list"))
        every = own if every is None else every.unionByName(own)
    summed = every.groupBy(*by, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.max("score").alias("best"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.round("score", 10).desc(), "first", key)
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("first")


def run_on(hits: DataFrame, order: list[str]) -> DataFrame:
    """Lists of one question end to end: ranks go on counting from list to list."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "rank")))
