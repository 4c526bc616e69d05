"""Best matches of many questions without meeting all their words' postings: common words are only looked up for rows that may still win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.interim import written

#: What scores that rank alike may differ by: sums in another order, and rounding to six places.
TOLERANCE = 2e-6


def alike(rows: DataFrame, key: str, by: list[str], limit: int) -> DataFrame:
    """The first limit rows of each group that is equal in all columns by, with the group's smallest key as alike.

    A search that knows rows by these columns alone and gives ties to smaller keys finds none of the others among its best
    limit rows, and its best limit groups, ties to their smallest keys, hold all of these.
    """
    so_far = Window.partitionBy(F.xxhash64(*by), *by).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"alike": F.first(key).over(so_far), "_n": F.row_number().over(so_far)}).where(F.col("_n") <= limit).drop("_n")


def best_matches(weighed: DataFrame, tokens: DataFrame, key: str, limit: int, slack: float = 0.0, first: int = 2) -> DataFrame:
    """(query_id, scope, key, score): among them, with their whole scores, each question's best limit rows of its scope.

    weighed: (scope, token, key, w, bonus), a row's weight for a token; tokens: (query_id, scope, token, times). A score is
    the sum of w * times + bonus; slack is what a caller may still add to it. Weights must not be negative.

    1. The rarest words of a question, until their postings hold first * limit rows, are scored: the limit-th best of those
    partial scores is a threshold that no winner stays below. 2. Words are ordered by the most that they can add; those whose
    sum cannot reach the threshold are left out, as a winner has one of the others. 3. Rows of the others that may still
    reach it look up what the left out words add. Questions with too few rows in the first step leave nothing out.
    """
    weighed = written(weighed.select("scope", "token", key, "w", "bonus"), "weights")
    known = weighed.groupBy("scope", "token").agg(F.count("*").alias("df"), F.max("w").alias("most_w"), F.max("bonus").alias("most_bonus"))
    asked = tokens.join(known, ["scope", "token"]).select("query_id", "scope", "token", "times", "df", (F.col("times") * F.col("most_w") + F.col("most_bonus")).alias("most"))
    question = ["query_id", "scope"]
    rare = Window.partitionBy(*question).orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    asked = written(asked.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))), "asked")
    add = F.sum(F.col("w") * F.col("times") + F.col("bonus"))
    some = asked.where(F.col("before") < first * limit).join(weighed, ["scope", "token"]).groupBy(*question, key).agg(add.alias("part"))
    placed = some.withColumn("r", F.row_number().over(Window.partitionBy(*question).orderBy(F.desc("part")))).where(F.col("r") <= limit)
    least = placed.groupBy(*question).agg(F.count("*").alias("n"), F.min("part").alias("least")).where(F.col("n") >= limit).drop("n")
    up = Window.partitionBy(*question).orderBy("most", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = asked.join(least, question, "left").withColumn("left_out", F.coalesce(F.sum("most").over(up) + slack < F.col("least") - TOLERANCE, F.lit(False)))
    told = written(told.select(*question, "token", "times", "most", "least", "left_out"), "words")
    room = told.groupBy(*question).agg(F.sum(F.when(F.col("left_out"), F.col("most")).otherwise(0.0)).alias("room"), F.max("least").alias("least"))
    parts = told.where("not left_out").join(weighed, ["scope", "token"]).groupBy(*question, key).agg(add.alias("part"))
    able = parts.join(room, question).where(F.col("least").isNull() | (F.col("part") + F.col("room") + slack >= F.col("least") - TOLERANCE))
    able = written(able.select(*question, key, "part"), "able")
    rest = able.select(*question, key).join(told.where("left_out").select(*question, "token", "times"), question)
    more = rest.join(weighed, ["scope", "token", key]).groupBy(*question, key).agg(add.alias("more"))
    return able.join(more, [*question, key], "left").select(*question, key, (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))


def best_of_split(weighed: DataFrame, tokens: DataFrame, key: str, limit: int, slack: float, few: int = 32) -> DataFrame:
    """(query_id, scope, key, score): among them, with their whole scores, each question's best limit rows, ties to the smaller key.

    weighed and tokens: see best_matches; weighed also has own, what a row adds to its score once, slack at most. Rows with a
    word that only few rows of a scope hold are scored whole for each question that has it. What common words come to is worked
    out once for all questions that have the same of them, over rows that are alike in them: a row without a rare word is
    among the best only if it is among the best limit rows by common words, as rare words take nothing away.
    """
    weighed = written(weighed.select("scope", "token", key, "w", "bonus", "own"), "weights")
    question, held = ["query_id", "scope"], weighed.groupBy("scope", "token").agg(F.count("*").alias("df"))
    told = written(tokens.join(held, ["scope", "token"]).select(*question, "token", "times", (F.col("df") > few).alias("common")), "asked")
    pairs = told.where("not common").join(weighed.select("scope", "token", key), ["scope", "token"]).select(*question, key).distinct()
    pairs = written(pairs, "pairs")
    add = F.sum(F.col("w") * F.col("times") + F.col("bonus")) + F.max("own")
    whole = pairs.join(told, question).join(weighed, ["scope", "token", key]).groupBy(*question, key).agg(add.alias("score"))
    common = told.where("common")
    listed = common.groupBy(*question).agg(F.array_sort(F.collect_list(F.struct("token", "times"))).alias("asks"))
    first = written(listed.groupBy("scope", "asks").agg(F.min("query_id").alias("asked")), "different")
    same = listed.join(first, ["scope", "asks"]).select("scope", "asked", "query_id")
    says = weighed.join(common.select("scope", "token").distinct(), ["scope", "token"], "left_semi").groupBy("scope", key, "own").agg(F.array_sort(F.collect_list(F.struct("token", "w", "bonus"))).alias("says"))
    members = written(alike(says, key, ["scope", "own", "says"], limit), "alike")
    groups = members.where(F.col("alike") == F.col(key))
    met = best_matches(groups.select("scope", key, F.inline("says")), first.select(F.col("asked").alias("query_id"), "scope", F.inline("asks")), key, limit, slack)
    order = Window.partitionBy(*question).orderBy(F.round("score", 10).desc(), key)
    top = lambda hits: hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
    met = top(met.join(groups.select("scope", key, "own"), ["scope", key]).select(*question, key, (F.col("score") + F.col("own")).alias("score")))
    met = top(met.withColumnRenamed(key, "alike").join(members.select("scope", "alike", key), ["scope", "alike"]).select(*question, key, "score"))
    met = met.withColumnRenamed("query_id", "asked").join(same, ["scope", "asked"]).select(*question, key, "score")
    return whole.select(*question, key, "score").unionByName(met.join(pairs, [*question, key], "left_anti"))
