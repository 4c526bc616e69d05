"""URL filters: rules indexed by their rarest literal token; only fetched rules run regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a rule table up to which it is sent to every executor; beyond, both sides are shuffled by token.
BROADCAST_RULES = 20_000
RULE_SCHEMA = "rule string, verdict string, literal string, pattern string, fixed boolean, priority int"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, _ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 of an expression's lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(_ascii_lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def _escaped(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def host_rule(verdict: str, host: str, path: str = "") -> tuple:
    """A rule for a host and all its subdomains whose paths start with /path; it is written host/path."""
    host = host.lower()
    whole = path[: path.rfind("/") + 1]  # the last path part may go on in a URL: it is no whole token
    return (f"{host}/{path}", verdict, f"{host}/{whole}", f"^(?:[^/]*\\.)?{_escaped(f'{host}/{path}')}", True, len(f"{host}/{path}"))


def pattern_rule(verdict: str, literal: str, pattern: str) -> tuple:
    """A regular expression over host and path. Every match must hold literal's words as whole runs of letters and digits."""
    return (pattern, verdict, literal, pattern, False, 0)


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row.

    Host rules come first, the longest winning, then (at one length) the rule that sorts first; a URL that none fits gets the
    verdict of the pattern rules (block before allow, rule then null), else default. A URL without :// , and a null one, has
    an empty host and path and gets default unless a pattern fits. Rows may repeat and keys may be null; other columns are
    not looked at. Rules whose literal has no token are tried on every URL.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    rows = rows.select("_key", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("_rows"))
    tokens = urls.select("host", "path", "_rows", F.explode(F.concat(tokens_of(F.concat_ws("/", "host", "path")), F.array(F.lit("")))).alias("token"))
    listed = rules.select("*", tokens_of(F.col("literal")).alias("_all"))
    listed = listed.withColumn("_all", F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(F.lit(""))))
    wanted = listed.select(F.explode("_all").alias("token")).distinct()
    if (small := rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES):
        wanted = F.broadcast(wanted)
    # a token's weight is the number of rows with it; a token that no row has is the rarest
    weight = wanted.join(tokens.join(wanted, "token").groupBy("token").agg(F.sum("_rows").alias("_n")), "token", "left").select("token", F.coalesce("_n", F.lit(0)).alias("_n"))
    index = listed.select("rule", "verdict", "pattern", "fixed", "priority", F.explode("_all").alias("token")).join(weight, "token").groupBy("rule", "verdict", "pattern", "fixed", "priority").agg(F.min(F.struct("_n", "token")).getField("token").alias("token"))
    if small:
        index = F.broadcast(index)
    fits = tokens.join(index, "token").where(F.expr("regexp(concat(host, path), pattern)"))
    place = F.struct((-F.col("fixed").cast("int")).alias("f"), (-F.col("priority")).alias("p"), (F.col("verdict") != "block").alias("v"), "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.min(place).alias("_best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(
        F.col("_key").alias(key), "host", "path", F.when(F.col("_best.f") == -1, F.col("_best.rule")).alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


#: Hosts of unwanted pages; each pattern's words index it.
DEFAULT_PATTERNS = [
    ("block", "spam farm", r"^[^/]*\bspam-farm\."),
    ("block", "cheap pills", r"^[^/]*\bcheap-pills\."),
    ("block", "ads track", r"^[^/]*\bads-track\."),
    ("block", "casino", r"^[^/]*\bcasino\b"),
    ("block", "viagra", r"\bviagra\b"),
    ("block", "porn", r"^[^/]*\bporn\b"),
]
#: The rules of the contract.
CONTRACT_RULES = [("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/")]


def default_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, [host_rule(*r) for r in CONTRACT_RULES] + [pattern_rule(*r) for r in DEFAULT_PATTERNS])
