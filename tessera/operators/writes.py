"""Statements that write, as new states of a table: the result of each is the whole table after it.

A table on disk is replaced by writing the new state beside it; see stored. Keys that are null are equal to no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(current: DataFrame, new: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """current with rows of new: where a key is there already, update says what becomes of its columns (columns of the row as it
    is, and of the new one as new_<name>), or nothing does if update is None; else the row is added. new has each key once."""
    other = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_new"))
    rest = [c for c in current.columns if c not in keys]
    both = current.withColumn("_old", F.lit(True)).join(other, keys, "full_outer")
    have = lambda c: F.col(f"new_{c}") if c in new.columns else F.lit(None)
    value = lambda c: F.when(F.col("_old").isNull(), have(c)).when(F.col("_new").isNull() | F.lit(update is None), F.col(c)).otherwise((update or {}).get(c, F.col(c)))
    return both.select(*keys, *(value(c).alias(c) for c in rest))


def appended(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of new whose keys it lacks, each key once: the one that sorts first."""
    fresh = new.join(current.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*(c for c in current.columns if c not in keys))).alias("_r")).select(*keys, "_r.*")
    return current.unionByName(fresh.select(*current.columns))


def replaced(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current without the rows of any key in new, and with all rows of new: doing it twice changes nothing."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*current.columns))


def deleted(current: DataFrame, gone: DataFrame, keys: dict[str, str]) -> DataFrame:
    """current without the rows whose keys (column: column of gone) are in gone."""
    names = gone.select(*(F.col(g).alias(c) for c, g in keys.items())).distinct()
    return current.join(names, list(keys), "left_anti")


def cascaded(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The rows of every table that go when rows of root go, by links (parent, its column, child, its column) in order."""
    out = {root: tables[root].join(gone.select(key).distinct(), key, "left_semi")}
    for parent, column, child, other in links:
        names = out[parent].select(F.col(column).alias(other)).distinct()
        found = tables[child].join(names, other, "left_semi")
        out[child] = found if child not in out else out[child].unionByName(found).distinct()
    return out


def updated(current: DataFrame, changes: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """current with columns set in the rows that changes names; its columns are there as new_<name>."""
    other = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys), F.lit(True).alias("_new"))
    both = current.join(other, keys, "left")
    return both.select(*(F.when(F.col("_new"), columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def merged_json(old: Column, new: Column) -> Column:
    """Two flat JSON objects as one, values of new before those of old; keys in order."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    left = F.map_filter(read(old), lambda k, _: ~F.array_contains(F.map_keys(read(new)), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(left, read(new))))))


def stored(state: DataFrame, path: str, version: int) -> str:
    """Writes a state as a version of its own under path, whole or not at all, and gives its place."""
    place = f"{path}/version={version}"
    state.write.mode("overwrite").parquet(place)
    return place
