"""Benchmark decontamination over a distributed positional inverted index of training tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import LOWER_ASCII, bit_filter, bytes_of, class_table, discard, passes, resident, text_slices, word_hashes, words_of, written

#: Distinct terms that a task counts before it hands the counts on.
HELD_TERMS = 100_000
_WORD = class_table(words=bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, the text it is in, offsets of the texts' words)."""
    raw, off = bytes_of(texts)
    low = LOWER_ASCII[raw]
    starts, ends, owner = words_of(low, off, _WORD)
    return word_hashes(low, starts, ends).view(np.int64), owner, np.searchsorted(owner, np.arange(len(texts) + 1))


def item_windows(items: DataFrame, window: int, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(items: item_id as text, words; windows: item_id, words' hashes as one key, start, size and position and term of each word)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                terms, _, off = _terms(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(terms))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["item_id", "words"])

    body = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = written(body.mapInArrow(split, "item_id string, words array<long>").where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "words")), "items")
    starts = words.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("start"))
    return words, starts.select("item", "start", F.posexplode(F.slice("words", F.col("start") + 1, window)).alias("place", "term"))


class Index:
    """Words per row and, for the wanted terms, postings (term, row, position) of the training texts.

    Postings are kept for the terms that searches start from: the depth rarest of each window, by their counts over all rows.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, key: str, text: str, item: str, window: int, depth: int, near: bool = False):
        self.window, self.depth = window, depth
        self.rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_a", F.xxhash64("_key", "text")).withColumn("_b", F.xxhash64("text", F.lit(1), "_key"))
        self.items, words = item_windows(items, window, item)
        words = written(words, "windows")
        self.sizes, counts = self._count(words.select("term").distinct())
        weighed = words.join(counts, "term").groupBy("item", "start").agg(F.count("*").alias("present"), F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("terms"))
        lengths = words.groupBy("item", "start").agg(F.count("*").alias("size"))
        # a window with a word that no row has cannot occur
        chosen = weighed.join(lengths, ["item", "start"]).where("present = size").select("item", "start", "size", F.slice("terms", 1, depth).alias("terms"))
        self.searches = written(chosen, "searches")
        wanted = self.searches.select(F.explode("terms.term").alias("term"))
        if near:
            # the rarest different words of each window, whether or not rows have all its words
            rare = F.slice(F.array_sort(F.array_distinct(F.transform("terms", lambda t: F.struct(t["n"].alias("n"), t["term"].alias("term"))))), 1, depth)
            told = weighed.join(lengths, ["item", "start"]).select("item", "start", "size", rare.alias("terms"))
            self.near = written(told.where("size(terms) > 1"), "near")
            wanted = wanted.unionByName(self.near.select(F.explode("terms.term").alias("term")))
        self.postings = self._post(wanted.distinct())

    def _count(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        bits = self.rows.sparkSession.sparkContext.broadcast(bit_filter(terms, "term"))
        kind = dict(self.rows.dtypes)["_key"]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resident()
            held: dict[int, int] = {}
            schema = None

            def spill(like: pa.Schema) -> pa.RecordBatch:
                n = len(held)
                out = [pa.nulls(n, like.field(0).type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(held.keys()), pa.int64()), pa.array(list(held.values()), pa.int64())]
                held.clear()
                return pa.RecordBatch.from_arrays(out, names=names)

            names = ["_key", "_a", "_b", "n_words", "term", "n"]
            for batch in batches:
                schema = batch.schema
                for part in text_slices(batch):
                    found, _, off = _terms(part.column(1))
                    none = pa.nulls(part.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(off)), none, none], names=names)
                    distinct, times = np.unique(found[passes(bits.value, found)], return_counts=True)
                    for t, k in zip(distinct.tolist(), times.tolist(), strict=True):
                        held[t] = held.get(t, 0) + k
                if len(held) > HELD_TERMS:
                    yield spill(schema)
            if held:
                yield spill(schema)

        both = written(self.rows.mapInArrow(count, f"_key {kind}, _a long, _b long, n_words long, term long, n long"), "counts")
        counts = both.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")
        return both.where("term is null").select("_key", "_a", "_b", "n_words"), counts

    def _post(self, terms: DataFrame) -> DataFrame:
        bits = self.rows.sparkSession.sparkContext.broadcast(bit_filter(terms, "term"))

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resident()
            for batch in batches:
                for part in text_slices(batch):
                    found, owner, off = _terms(part.column(0))
                    at = np.flatnonzero(passes(bits.value, found))
                    rows = pa.array(owner[at])
                    yield pa.RecordBatch.from_arrays([pa.array(found[at]), part.column(1).take(rows), part.column(2).take(rows), pa.array((at - off[owner[at]]).astype(np.int32))], names=["term", "_a", "_b", "pos"])

        posted = self.rows.select("text", "_a", "_b").mapInArrow(post, "term long, _a long, _b long, pos int")
        return written(posted.join(terms, "term", "left_semi"), "postings")

    def candidates(self) -> DataFrame:
        """(row, item, shift): the item's words would start at word shift of the row. Lists of the rarest terms come first."""
        s = self.searches.select("item", "start", "terms")
        t = lambda k: F.get("terms", F.lit(k))
        first = s.withColumn("term", t(0)["term"])
        found = self.postings.join(first, "term").select("_a", "_b", "item", "terms", F.col("start"), (F.col("pos") - F.col("start") - t(0)["place"]).alias("shift"))
        for k in range(1, self.depth):
            more = found.where(F.size("terms") > k).withColumn("term", t(k)["term"]).withColumn("pos", F.col("shift") + F.col("start") + t(k)["place"])
            # a list entry of this term at its own place in the phrase, else the phrase is not there
            kept = more.join(self.postings, ["term", "_a", "_b", "pos"], "left_semi")
            found = kept.select("_a", "_b", "item", "terms", "start", "shift").unionByName(found.where(F.size("terms") <= k))
        return found.select("_a", "_b", "item", "shift").distinct()

    def phrases(self) -> DataFrame:
        """Exact matches, verified word by word: (_a, _b, n_hit, items), items the sorted ids of items with a window there."""
        window = self.window
        aligned = self.candidates().join(self.items, "item").groupBy("_a", "_b").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("found"))
        texts = self.rows.select("_a", "_b", "text").join(aligned.hint("shuffle_hash"), ["_a", "_b"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resident()
            for batch in batches:
                for part in text_slices(batch):
                    terms, _, off = _terms(part.column(part.schema.get_field_index("text")))
                    hits, ids = [], []
                    for i, found in enumerate(part.column(part.schema.get_field_index("found")).to_pylist()):
                        own = terms[off[i] : off[i + 1]]
                        hit, names = np.zeros(len(own), bool), set()
                        for x in found:
                            words = np.array(x["words"], np.int64)
                            size = min(window, len(words))
                            lo, hi = max(0, -x["shift"]), min(len(words), len(own) - x["shift"])
                            if hi - lo < size:
                                continue
                            same = np.concatenate([[False], words[lo:hi] == own[lo + x["shift"] : hi + x["shift"]], [False]])
                            step = np.flatnonzero(same[1:] != same[:-1])
                            for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True):
                                if b - a >= size:
                                    hit[lo + x["shift"] + a : lo + x["shift"] + b] = True
                                    names.add(x["item_id"])
                        hits.append(int(hit.sum()))
                        ids.append(sorted(names))
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("_a")), part.column(part.schema.get_field_index("_b")), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string()))], names=["_a", "_b", "n_hit", "items"])

        return texts.mapInArrow(verify, "_a long, _b long, n_hit long, items array<string>").where("n_hit > 0").dropDuplicates(["_a", "_b"])

    def proximity(self, slack: int) -> DataFrame:
        """(_a, _b, near): the sorted ids of items with a window whose rarest words, depth of them, stand together in the row.

        Each of the others must stand within size + slack words of one and the same place of the rarest one, in any order.
        """
        term = lambda k: F.get("terms", F.lit(k))["term"]
        windows = self.near.select("item", "size", *(term(k).alias(f"t{k}") for k in range(self.depth))).distinct()
        cell = self.window + slack
        found = self.postings.withColumnRenamed("term", "t0").join(windows, "t0").withColumn("reach", F.col("size") + slack)
        for k in range(1, self.depth):
            other = self.postings.select("_a", "_b", F.col("term").alias(f"t{k}"), F.col("pos").alias("other"), F.floor(F.col("pos") / cell).alias("cell"))
            # a place is looked for in its own cell and those beside it
            spread = found.where(F.col(f"t{k}").isNotNull()).withColumn("cell", F.explode(F.array(*(F.floor(F.col("pos") / cell) + d for d in (-1, 0, 1)))))
            on = [spread[c] == other[c] for c in ("_a", "_b", f"t{k}", "cell")] + [F.abs(spread["pos"] - other["other"]) < spread["reach"]]
            kept = spread.join(other, on, "left_semi").drop("cell").distinct()
            found = kept.unionByName(found.where(F.col(f"t{k}").isNull()))
        return found.select("_a", "_b", "item").distinct().join(self.items.select("item", "item_id"), "item").groupBy("_a", "_b").agg(F.array_sort(F.collect_set("item_id")).alias("near"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = 13, depth: int = 3, slack: int | None = None) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated[, near]) for every row of docs.

    A window is window consecutive words of an item, or all of a shorter item. Words inside any occurrence of a window are
    hit; contaminated: some are, and they make at least a twentieth of the row's words. Null texts have no words and no hits;
    items without words never match; a null item id reads as the empty string; null and repeated keys keep their rows, equal
    rows the same result. Empty tables give empty or unhit rows. Other columns are not looked at. Texts are taken in slices of
    whole texts: a worker's memory follows the longest text.

    With slack, near has the ids of items of which a window is near in the row: its rarest words by the counts of docs, depth
    of them and two at least, each within the window's words + slack of the rarest one, whatever stands between and in any
    order. Items with exact matches of several different words are among them. Ties of counts go to the smaller hash.
    """
    index = Index(docs, items, key, text, item, window, depth, slack is not None)
    out = index.sizes.join(index.phrases(), ["_a", "_b"], "left")
    if slack is not None:
        out = out.join(index.proximity(slack), ["_a", "_b"], "left")
    hit = F.coalesce("n_hit", F.lit(0))
    none = F.array().cast("array<string>")
    found = F.coalesce("items", none)
    near = [] if slack is None else [F.coalesce("near", none).alias("near")]
    return out.select(F.col("_key").alias(key), "n_words", hit.cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), *near)
