"""Registered queries of the document engine, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import checks, copies, layout, nodes, registry, replies, retrieval, scoped, statements, tables, texts, upkeep  # noqa: F401  (they register their queries)
from tessera.catalog import sqltext as S
from tessera.catalog.registry import query
from tessera.operators import records, search
from tessera.sources.tables import table
from tessera.streaming.runs import windowed

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
FLAGSHIP = "hybrid_retrieval"

_TOK = S.tokens("text")
_BM25 = f"""q AS (SELECT item_id, token, count(*) AS qn FROM (SELECT item_id, unnest({_TOK}) AS token FROM benchmark) GROUP BY item_id, token),
  w AS (SELECT * FROM (SELECT doc_id, {_TOK} AS words FROM documents) WHERE len(words) > 0), n AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
  tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS token FROM w) GROUP BY doc_id, dl, token),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  s AS (SELECT q.item_id, tf.doc_id, sum(q.qn * ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / n.mean))) AS score
    FROM q JOIN tf ON q.token = tf.token JOIN df ON df.token = q.token, n GROUP BY q.item_id, tf.doc_id),
  bm AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 40)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM bm")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), table(spark, d, "benchmark")).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q
  JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 4) AS score, rank FROM t WHERE rank <= 40""")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    found = search.dense(vectors, vectors.where("vec_id % 100 = 0"))
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query("SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def dimension_audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS canonical_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return records.duplicate_groups(table(spark, d, "documents"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1")
def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    return records.latest(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), F.desc("doc_id")]).select("source", "doc_id", "n_chars")


@query("SELECT c.c_custkey, c.c_name, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c")
def correlated_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.counted(table(spark, d, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"], "n_orders")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def unreferenced(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'")
    customers = table(spark, d, "customer")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def referenced(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    orders = table(spark, d, "orders")
    return orders.join(returned, orders["o_orderkey"] == returned["l_orderkey"], "left_semi").select("o_orderkey", "o_orderstatus")


@query("""SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_returnflag) AS n_flags, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey
  HAVING count(*) >= 3 AND count(DISTINCT l_returnflag) = 1""")
def full_matches(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_returnflag").alias("n_flags"), F.max("l_shipdate").alias("last_ship"))
    return groups.where("n_lines >= 3 and n_flags = 1")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    both = orders.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority")
    return both.agg(F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "n")


@query("""SELECT event_type, count(*) AS n, count(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_k, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k
  FROM events GROUP BY event_type""")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"))


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    return records.tail(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "place")


@query("SELECT user_id, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    last = events.groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.count("*").alias("n"), F.max("ts").alias("seen"))
    return last.join(F.broadcast(now), F.col("seen") < F.col("now") - F.expr("interval 10 minutes")).select("user_id", "last_id", "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return windowed(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT conv_id, turn, role, lag(text) OVER w AS before, text, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context(spark: SparkSession, d: str) -> DataFrame:
    return records.neighbours(table(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "role", "before", "text", "after")


@query("""SELECT conv_id, part, count(*) AS n, min(turn) AS first, max(turn) AS last, string_agg(text, chr(10) ORDER BY turn, text) AS content FROM
  (SELECT conv_id, turn, text, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 4) AS BIGINT) AS part FROM conversations) GROUP BY conv_id, part""")
def row_groups(spark: SparkSession, d: str) -> DataFrame:
    return records.grouped(table(spark, d, "conversations"), ["conv_id"], "turn", "text", 4)


@query("""SELECT a.o_custkey, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
  AND a.o_orderdate <= b.o_orderdate + INTERVAL 90 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 90 DAY GROUP BY a.o_custkey""")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("b"))
    return records.overlapping(spans, "o_custkey", "a", "b").where("pairs > 0")


@query("SELECT doc_id, unnest(generate_series(1, greatest(CAST(ceil(n_chars / 3000.0) AS BIGINT), 1))) AS page FROM documents")
def page_series(spark: SparkSession, d: str) -> DataFrame:
    last = F.greatest(F.ceil(F.col("n_chars") / 3000), F.lit(1)).cast("long")
    return table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("page"))


@query("""SELECT d.lang, count(*) AS total, CAST(sum(l.quality) AS BIGINT) AS passed, round(avg(l.quality), 6) AS pass_rate, CAST(sum(l.toxic) AS BIGINT) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("total"), F.sum("quality").alias("passed"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.sum("toxic").alias("toxic"))


@query("""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<p')) AS n_paragraphs FROM pages""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title"), count("<a ").alias("n_links"), count("<p").alias("n_paragraphs"))
