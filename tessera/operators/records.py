"""Relational operators of the control plane: duplicates, canonical rows, counts, intervals, tails and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(digest, copies, canonical_id, last_id) of texts that several documents hold; the smallest id is canonical, null texts are no copies."""
    named = docs.where(F.col("text").isNotNull()).select(F.md5("text").alias("digest"), "doc_id")
    groups = named.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("canonical_id"), F.max("doc_id").alias("last_id"))
    return groups.where("copies > 1")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def tail(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key, place 1 the last."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def counted(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """left with the number of right's rows of each key: aggregated first, so that only counts join."""
    return left.join(right.groupBy(*on).agg(F.count("*").alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def overlapping(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, pairs) of intervals of one key that overlap: a running count of open intervals instead of a self join. Closed at both ends; null keys are one key."""
    opened = rows.select(key, F.col(start).alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step"))
    closed = rows.select(key, F.col(end).alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step"))
    before = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    open_now = opened.unionByName(closed).withColumn("open", F.coalesce(F.sum("step").over(before), F.lit(0)))
    return open_now.where("kind = 1").groupBy(key).agg(F.sum("open").alias("pairs"))


def neighbours(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Each row's text with those before and after it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("before", F.lag(text).over(w)).withColumn("after", F.lead(text).over(w))


def grouped(rows: DataFrame, keys: list[str], order: str, text: str, size: int) -> DataFrame:
    """Runs of size rows of a key as one row: (keys, part, n, first, last, content)."""
    w = Window.partitionBy(*keys).orderBy(order)
    parts = rows.withColumn("_place", F.row_number().over(w) - 1).withColumn("part", F.floor(F.col("_place") / size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return parts.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), joined.alias("content"))


def page(rows: DataFrame, keys: list[str], order: str, after: Column, n: int) -> DataFrame:
    """The n rows of each key that follow after by order, place 1 the first: a page by keyset, without counting what it skips."""
    place = Window.partitionBy(*keys).orderBy(order)
    return rows.where(F.col(order) > after).withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def states(events: DataFrame, key: str, order: list[str], kind: str, failure: str) -> DataFrame:
    """(key, last_index, state, failures, first_at, last_at): a run's log folded into its state, that of its last event by order.

    Sums and maxima only, so a hot run is added up where its events are.
    """
    return events.groupBy(key).agg(
        F.count("*").alias("last_index"), F.max_by(kind, F.struct(*order)).alias("state"), F.count_if(F.col(kind) == failure).alias("failures"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")
    )


def one(rows: DataFrame) -> dict | None:
    """The first row as a dict, or None if there is none: a single task reads until it has found one."""
    found = rows.limit(1).collect()
    return found[0].asDict() if found else None
