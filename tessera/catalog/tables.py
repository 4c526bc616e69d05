"""Statements that write, as the state of a table after them, over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import writes as W
from tessera.sources.tables import table

_NEW = "SELECT s_suppkey AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier"


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    current = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    s = table(spark, d, "supplier")
    new = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return current, new.unionByName(new.withColumn("c_custkey", F.col("c_custkey") + 1_000_000))


@query(f"""WITH n AS ({_NEW}) SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(nullif(n.c_name, ''), c.c_name) AS c_name, coalesce(c.c_acctbal, n.c_acctbal) AS c_acctbal FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    current, new = _changes(spark, d)
    return W.upserted(current, new, ["c_custkey"], {"c_name": F.coalesce(F.nullif("new_c_name", F.lit("")), "c_name")})


@query(f"WITH n AS ({_NEW}) SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey, min(c_name), min(c_acctbal) FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY c_custkey")
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    return W.appended(*_changes(spark, d), ["c_custkey"])


@query(f"WITH n AS ({_NEW}) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n")
def replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    return W.replaced(*_changes(spark, d), ["c_custkey"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return W.deleted(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), gone, {"o_custkey": "c_custkey"})


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT 1 AS x FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
  SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: table(spark, d, t) for t in ("customer", "orders", "lineitem")}
    links = [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
    found = W.cascaded(tables, links, "customer", tables["customer"].where("c_mktsegment = 'BUILDING'"), "c_custkey")
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT event_id, event_type, value * 2 AS value FROM events WHERE value IS NOT NULL AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 3) UNION ALL
  SELECT event_id, event_type, value FROM events WHERE NOT (value IS NOT NULL AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 3))""")
def updated_rows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    busy = events.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")
    out = W.updated(events, busy, ["user_id"], {"value": F.col("value") * 2})
    return out.select("event_id", "event_type", "value")


@query("""WITH g AS (SELECT source, n_chars, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1), w AS (SELECT doc_id, count(*) AS n_labels FROM labels GROUP BY 1)
  SELECT d.doc_id, g.first_id, g.copies, coalesce(w.n_labels, 0) AS n_labels, coalesce(p.n_pages, 0) AS n_pages FROM documents d JOIN g ON g.source = d.source AND g.n_chars = d.n_chars LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN (SELECT page_id AS doc_id, count(*) AS n_pages FROM pages GROUP BY 1) p ON p.doc_id = d.doc_id""")
def duplicate_details(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    groups = docs.groupBy("source", "n_chars").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    counts = lambda name, key, out: table(spark, d, name).groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias(out))
    told = docs.join(groups, ["source", "n_chars"]).join(counts("labels", "doc_id", "n_labels"), "doc_id", "left").join(counts("pages", "page_id", "n_pages"), "doc_id", "left")
    return told.select("doc_id", "first_id", "copies", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))
