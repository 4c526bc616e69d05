"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import text_or_empty, written

#: kind, pattern, group that must be long enough, its least length; fixed values of the contract, then rules of our own.
BASE_RULES = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
]
RULES = BASE_RULES + MORE_RULES
RULES_VERSION = "1"
SPANS = "array<struct<start:int,kind:int,finish:int>>"
LEDGER_SCHEMA = f"sha string, rule_version string, spans {SPANS}"


#: Items folded together before what they give joins the rest, and code points in a piece of a text.
RUN, PIECE = 256, 256


def _run(items: Column, kind: str, step: Callable[[Column, Column], Column], finish: Callable[[Column, Column], Column]) -> Column:
    """finish(at, found) of a running sum at and a growing array found (of type kind) that step folds items into.

    Items go through it in runs of RUN, so that each copies short arrays alone: time is in proportion to the items.
    """

    def over(bound: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(bound) / RUN).cast("int"))

        def run(acc: Column, k: Column) -> Column:
            return F.aggregate(
                F.slice(bound, k * RUN + 1, F.lit(RUN)), F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("found")), step,
                lambda r: F.struct(r["at"].alias("at"), F.concat(acc["lists"], F.array(r["found"])).alias("lists")),
            )

        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("lists"))
        return F.aggregate(starts, empty, run, lambda acc: finish(acc["at"], F.flatten(acc["lists"])))

    # an array of one binds items, which would be made anew for each run otherwise
    return F.get(F.transform(F.array(items), over), F.lit(0))


def _spans(text: Column, kind: int, rule: tuple[str, str, int, int]) -> Column:
    """All leftmost non-overlapping matches of a rule as (start, kind, finish), code points, finish exclusive.

    Each step of one anchored scan takes the text before a match and the match; positions are running sums of their
    lengths. The scan takes time in proportion to the text.
    """
    _, pattern, group, least = rule
    scan = F.lit(rf"\G([\s\S]*?)({pattern})")
    parts = F.arrays_zip(*(F.regexp_extract_all(text, scan, F.lit(i)) for i in (1, 2, 2 + group)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        finish = start + F.length(x["1"])
        more = F.concat(acc["found"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), finish.alias("finish"))))
        return F.struct(finish.alias("at"), F.when(F.length(x["2"]) >= least, more).otherwise(acc["found"]).alias("found"))

    found = _run(parts, SPANS, step, lambda _, found: found)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULES_VERSION, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(every row with its spans, the ledger with what was scanned now).

    A blob is a distinct text, addressed by its SHA-256. Only blobs that the ledger lacks for this rule_version are scanned,
    once however many rows (paths) hold them; findings then join back to all rows. Returned rows: key, sha, spans (start,
    kind, finish), sorted. A null text is the empty blob; null and repeated keys keep their rows; an empty table gives empty
    results; other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    paths = written(rows.select("_key", F.sha2(F.col("_text"), 256).alias("sha")), "paths")
    blobs = paths.groupBy("sha").agg(F.min("_key").alias("_first"))
    if ledger is not None:
        ledger = ledger.dropDuplicates(["sha", "rule_version"])
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("sha"), "sha", "left_anti")
    addressed = rows.withColumn("sha", F.sha2(F.col("_text"), 256))
    # one row of each unseen blob: that with the least key; the texts stream past the narrow side
    unseen = addressed.join(blobs.hint("shuffle_hash"), (addressed["sha"] == blobs["sha"]) & addressed["_key"].eqNullSafe(blobs["_first"])).select(addressed["sha"].alias("sha"), "_text")
    kinds = [_spans(F.col("_text"), i, r) for i, r in enumerate(RULES)]
    found = unseen.select("sha", F.array_sort(F.concat(*kinds)).alias("spans"))
    fresh = written(found.groupBy("sha").agg(F.first("spans").alias("spans")).select("sha", F.lit(rule_version).alias("rule_version"), "spans"), "ledger")
    known = fresh if ledger is None else fresh.unionByName(ledger)
    hits = known.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("sha", "spans")
    joined = paths.join(hits, "sha", "left")
    return joined.select(F.col("_key").alias(key), "sha", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), known


def scan_history(versions: DataFrame, place: str, rule_version: str = RULES_VERSION, text: str = "text", path: str = "path", version: str = "version") -> DataFrame:
    """(path, version, sha, spans) of every historical version of every path, over a ledger that is kept at place.

    The ledger there, if there is one, tells which blobs these rules have seen; only the others are scanned, and what is
    found is added to it. A run that dies before that leaves the ledger as it was; one that is repeated adds nothing.
    """
    spark = versions.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(place) if there else None
    told = versions.select(F.struct(F.col(path).alias("path"), F.col(version).alias("version")).alias("_at"), F.col(text).alias("text"))
    found, known = scan(told, ledger, rule_version, "text", "_at")
    fresh = known if ledger is None else known.join(ledger.select("sha", "rule_version").distinct(), ["sha", "rule_version"], "left_anti")
    fresh.select("sha", "rule_version", "spans").write.mode("append").parquet(place)
    return found.select(F.col("_at.path").alias(path), F.col("_at.version").alias(version), "sha", "spans")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(r[0]) for r in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["finish"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """text with every stretch that spans cover (sorted by start) replaced by mask, overlapping ones together; null if either is.

    What stays is put together from pieces of the text, as finding a place in a long text takes time with its distance.
    """
    gap = lambda start, end: F.struct(start.alias("start"), end.alias("finish"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["found"], F.array(gap(acc["at"], s["start"])))
        return F.struct(F.greatest(acc["at"], s["finish"]).alias("at"), F.when(apart, more).otherwise(acc["found"]).alias("found"))

    gaps = _run(spans, "array<struct<start:int,finish:int>>", step, lambda at, found: F.concat(found, F.array(gap(at, F.greatest(at, F.length(text))))))
    pieces = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{PIECE}}}"), F.lit(0))

    def kept(pieces: Column, g: Column) -> Column:
        first, last = (F.floor(c / PIECE).cast("int") for c in (g["start"], g["finish"]))
        return F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), g["start"] - first * PIECE + 1, g["finish"] - g["start"])

    whole = F.transform(F.array(F.struct(pieces.alias("pieces"), gaps.alias("gaps"))), lambda b: F.array_join(F.transform(b["gaps"], lambda g: kept(b["pieces"], g)), mask))
    return F.when(text.isNotNull() & spans.isNotNull(), F.get(whole, F.lit(0)))
