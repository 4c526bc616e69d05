"""The operators over their whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, collocations, decontam, jaccard, langid, licenses, packing, repeats, secrets, shards, tokencount, trie, urls
from tessera.llm._common import load


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), slack=13)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").alias("n_near"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(load(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"), licenses.default_templates(spark))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"), urls.default_rules(spark))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(load(spark, sf_dir, "documents"))
    return secrets.digest(found)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(load(spark, sf_dir, "conversations"))


_ALL = (
    op1_best_fit_packing,
    op2_token_counts,
    op3_ngram_jaccard_join,
    op4_benchmark_decontamination,
    op5_sharding,
    op6_license_scans,
    op7_language_id,
    op8_url_filters,
    op9_secret_scans,
    op10_nearest_neighbours,
    op11_substring_dedup,
    op12_collocation_mining,
    op13_conversation_trie,
)
QUERIES = {f.__name__: f for f in _ALL}

_RULES = ", ".join(f"('{verdict}', '{host}', '/{path}', '{host}/{path}')" for verdict, host, path in urls.CONTRACT_RULES)
_PATTERNS = " OR ".join(f"regexp_matches(host || path, '{pattern}')" for _, _, pattern in urls.DEFAULT_PATTERNS)
ORACLE_SQL: dict[str, str] = {
    "op8_url_filters": f"""WITH u AS (SELECT page_id, contains(coalesce(url, ''), '://') AS ok, substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3) AS rest FROM pages),
  p AS (SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
  r(verdict, rhost, rpath, rule) AS (VALUES {_RULES}),
  f AS (SELECT p.host, p.path, r.rule, r.verdict, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.rule) DESC, r.rule) AS k
    FROM (SELECT DISTINCT host, path FROM p) p, r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
  SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN {_PATTERNS.replace("host", "p.host").replace("path", "p.path")} THEN 'block' ELSE 'allow' END) AS verdict
  FROM p LEFT JOIN f ON f.host = p.host AND f.path = p.path AND f.k = 1""",
    # windows of 20 words, the first of each stays
    "op11_substring_dedup": """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
  p AS (SELECT r, unnest(range(1, len(words) - 18)) AS s FROM d WHERE len(words) >= 20), k AS (SELECT p.r, s, array_to_string(words[s:s + 19], ' ') AS said FROM p JOIN d ON d.r = p.r),
  o AS (SELECT r, s, row_number() OVER (PARTITION BY said ORDER BY r, s) AS n FROM k), h AS (SELECT DISTINCT r, s + i AS spot FROM o, range(20) t(i) WHERE n > 1),
  g AS (SELECT r, list(spot) AS hit FROM h GROUP BY r), f AS (SELECT d.doc_id, words, coalesce(hit, []) AS hit FROM d LEFT JOIN g ON g.r = d.r),
  y AS (SELECT doc_id, len(words) AS n_words, len(hit) AS n_removed, CASE WHEN len(hit) = 0 THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(hit, i)) END AS kept FROM f)
  SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y""",
    # phrases up to four words, counted one by one
    "op12_collocation_mining": """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
  t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
  e AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
  f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM e) GROUP BY lang, k, phrase HAVING count(*) >= 30),
  c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
  q AS MATERIALIZED (SELECT lang, phrase, k, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM c, range(1, 4) x(j) WHERE j < k),
  u AS (SELECT q.*, l.a AS l, r.a AS r, (2000000 * CAST(q.a AS HUGEINT)) // (l.a + r.a) AS score FROM q JOIN f l ON l.lang = q.lang AND l.phrase = lp JOIN f r ON r.lang = q.lang AND r.phrase = rp),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS n FROM u) WHERE n = 1),
  s AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) x(m), range(1, 4) y(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
  v AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN s ON s.lang = b.lang AND s.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
  SELECT v.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM v JOIN t ON t.lang = v.lang WHERE rank <= 2000""",
}
