"""Repeated passages of whole documents: recurring phrases in sharded Aho-Corasick automata that documents stream through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import bit_filter, bytes_of, class_table, discard, mix64, passes, resident, text_slices, word_hashes, words_of, written

#: Phrases of one automaton, about; each takes some 350 bytes of a worker.
PER_SHARD = 150_000
#: Words that stream through one automaton in one task, about.
PER_TASK = 4_000_000
#: Windows that a task holds to compare them with each other.
HELD = 1_000_000
#: Bits of a word's letter in the automata's alphabet, and words of a phrase at most: together they fit a long.
BITS, LONGEST = 6, 10
_WORD = class_table(separators=b" \t\n\x0b\x0c\r")
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_SCHEMA = "none boolean, _key {kind}, f1 long, f2 long, start int, stop int, h1 long, h2 long"


class Slice:
    """Words of a run of texts, the phrases that begin at each of them, and the one phrase that stands for each window.

    Of the phrases inside a window the one with the lowest scrambled code stands for it, the last one of equals, so that
    equal windows choose equal phrases wherever they are.
    """

    def __init__(self, texts: pa.Array, window: int):
        raw, off = bytes_of(texts)
        starts, ends, self.owner = words_of(raw, off, _WORD)
        self.words = word_hashes(raw, starts, ends)
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.sizes = np.diff(self.first)
        self.window, self.phrase = window, phrase_of(window)
        self.letters = (self.words >> np.uint64(64 - BITS)).astype(np.uint8)
        n = max(0, len(self.words) - self.phrase + 1)
        self.codes = np.zeros(n, np.uint64)
        for k in range(self.phrase):
            self.codes = (self.codes << np.uint64(BITS)) | self.letters[k : k + n].astype(np.uint64)
        m = max(0, len(self.words) - window + 1)
        keys = mix64(self.codes)
        best, chosen = keys[:m].copy(), np.zeros(m, np.int64)
        for k in range(1, window - self.phrase + 1):
            better = keys[k : k + m] <= best
            best[better], chosen[better] = keys[k : k + m][better], k
        self.starts = np.flatnonzero(self.owner[:m] == self.owner[window - 1 : window - 1 + m])
        self.chosen = self.starts + chosen[self.starts]

    def hashes(self, starts: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the windows that begin at starts."""
        out = []
        for odd in _ODD:
            total, factor = np.zeros(len(starts), np.uint64), 1
            for k in range(self.window):
                factor = factor * int(odd) % (1 << 64)
                total += self.words[starts + k] * np.uint64(factor)
            out.append(mix64(total))
        return out


def phrase_of(window: int) -> int:
    """Words of a phrase: half a window, so that one of about six phrases is chosen."""
    return max(1, min(LONGEST, window // 2))


def automaton(codes: np.ndarray, phrase: int) -> object:
    """The Aho-Corasick automaton of phrases given by their codes, a letter for each word."""
    import ahocorasick

    shifts = np.arange(phrase - 1, -1, -1, dtype=np.uint64) * np.uint64(BITS)
    letters = ((codes[:, None] >> shifts) & np.uint64(2**BITS - 1)).astype(np.uint8) + np.uint8(48)
    text = letters.tobytes().decode("ascii")
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for at in range(0, len(text), phrase):
        out.add_word(text[at : at + phrase], 1)
    out.make_automaton()
    return out


def occurrences(found: object, s: Slice) -> np.ndarray:
    """Flags of the words of a slice at which a phrase of the automaton begins, within one text."""
    out = np.zeros(len(s.words), bool)
    if len(s.words):
        text = (s.letters + np.uint8(48)).tobytes().decode("ascii")
        ends = np.fromiter((end for end, _ in found.iter(text)), np.int64)
        begins = ends - (s.phrase - 1)
        out[begins[s.owner[begins] == s.owner[ends]]] = True
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _phrases(body: DataFrame, window: int) -> DataFrame:
    """(key, n, f1, f2) of every row, and beside them (code, n, f1, f2) of each text's chosen phrases: n is how often, 2 for more."""
    kind = dict(body.dtypes)["_key"]
    names = ["_key", "n", "f1", "f2", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            for part in text_slices(batch):
                s = Slice(part.column(3), window)
                yield pa.RecordBatch.from_arrays([part.column(0), _longs(s.sizes), part.column(1), part.column(2), pa.nulls(part.num_rows, pa.int64())], names=names)
                at = np.unique(s.chosen)
                pairs = np.stack([s.owner[at].astype(np.uint64), s.codes[at]], axis=1)
                pairs, times = np.unique(pairs, axis=0, return_counts=True)
                of = pa.array(pairs[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(times), part.schema.field(0).type), _longs(np.minimum(times, 2)), part.column(1).take(of), part.column(2).take(of), _longs(pairs[:, 1])], names=names)

    return body.mapInArrow(run, f"_key {kind}, n long, f1 long, f2 long, code long")


def _sharded(recurring: DataFrame) -> tuple[DataFrame, int]:
    """(code, shard): phrases of one text, the first that has them, share a shard, but for texts with very many of them."""
    owners = recurring.groupBy("owner").agg(F.count("*").alias("m"))
    shards = 1 + owners.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] // PER_SHARD
    large = owners.where(F.col("m") > PER_SHARD // 4).select("owner", F.ceil(F.col("m") * 4 / PER_SHARD).cast("long").alias("cuts"))
    cut = F.pmod(F.col("code"), F.coalesce(F.col("cuts"), F.lit(1)))
    return recurring.join(large, "owner", "left").select("code", F.pmod(F.xxhash64("owner", cut), F.lit(shards)).cast("int").alias("shard")), shards


class _Group:
    """The texts of one shard and task: finds windows with a recurring phrase and tells first ones from repeated ones."""

    def __init__(self, alone: bool, window: int, key: pa.DataType):
        self.alone, self.window, self.key = alone, window, key
        self.codes: list[np.ndarray] = []
        self.found: object = None
        self.last: tuple[int, int] | None = None
        self.held: list[tuple] = []
        self.n, self.flushed = 0, False

    def take(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """part: columns none, _key, f1, f2, text, in the order of texts; rows of one text follow each other."""
        if self.found is None:
            self.found = automaton(np.unique(np.concatenate(self.codes)), phrase_of(self.window)) if self.codes else False
            self.codes = []
        if self.found is False:
            return
        names = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
        fresh = [x != y for x, y in zip(names, [self.last, *names], strict=False)]
        self.last = names[-1]
        part = part.filter(pa.array(fresh))
        for some in text_slices(part):
            s = Slice(some.column(4), self.window)
            here = occurrences(self.found, s)
            starts = s.starts[here[s.chosen]]
            if len(starts):
                of = s.owner[starts]
                self.held.append((some.select([0, 1, 2, 3]), of, starts - s.first[of], *s.hashes(starts)))
                self.n += len(starts)
            if self.n > HELD:
                yield from self.flush(False)

    def flush(self, ended: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        base = np.cumsum([0, *(x[0].num_rows for x in self.held)])
        rows = pa.Table.from_batches([x[0] for x in self.held]).combine_chunks().to_batches()[0]
        of = np.concatenate([x[1] + b for x, b in zip(self.held, base, strict=False)])
        start, h1, h2 = (np.concatenate([x[k] for x in self.held]) for k in (2, 3, 4))
        self.held, self.n = [], 0
        order = np.lexsort((h2, h1))  # stable: of equal windows the first comes first
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        again = np.zeros(len(of), bool)
        again[order[1:][same]] = True
        yield from runs(rows, of[again], start[again], self.window, self.key)
        if not (ended and self.alone and not self.flushed):
            at = np.flatnonzero(~again)
            at = at[np.lexsort((h2[at], h1[at]))]
            own = rows.take(pa.array(of[at]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(start[at].astype(np.int32)), pa.nulls(len(at), pa.int32()), _longs(h1[at]), _longs(h2[at])], names=_NAMES)
        self.flushed = True


_NAMES = ["none", "_key", "f1", "f2", "start", "stop", "h1", "h2"]


def runs(rows: pa.RecordBatch, of: np.ndarray, start: np.ndarray, window: int, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Spans of words that windows cover: of, start in order; rows that overlap or touch become one."""
    if not len(of):
        return
    cut = np.flatnonzero((of[1:] != of[:-1]) | (start[1:] > start[:-1] + window)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(of)]]) - 1
    own = rows.take(pa.array(of[begin]))
    none = pa.nulls(len(begin), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(begin), pa.bool_()), pa.nulls(len(begin), key), own.column(2), own.column(3), pa.array(start[begin].astype(np.int32)), pa.array((start[end] + window).astype(np.int32)), none, none], names=_NAMES)


def _matched(body: DataFrame, patterns: DataFrame, routes: DataFrame, window: int) -> DataFrame:
    """Texts through the automata of the shards that they have phrases of.

    Rows with a stop are spans that repeat something earlier; the others are windows that are the first ones of their task.
    """
    kind = dict(body.dtypes)["_key"]
    loads = routes.groupBy("shard").agg(F.ceil(F.sum("n") / PER_TASK).cast("int").alias("tasks"))
    # a shard has a few long texts or many short ones; its phrases go to each of its tasks
    bits = body.sparkSession.sparkContext.broadcast(bit_filter(routes, "f1"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(1).to_numpy())))

    texts = body.mapInArrow(routed, f"_key {kind}, f1 long, f2 long, text string").drop("_key")
    firsts = routes.join(loads, "shard").withColumn("task", F.pmod(F.xxhash64("f1"), F.col("tasks")).cast("int"))
    docs = texts.join(firsts, ["f1", "f2"]).select("shard", "task", "tasks", F.lit(1).alias("what"), "none", "_key", "f1", "f2", "text")
    every = patterns.join(loads, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    codes = every.select("shard", "task", "tasks", F.lit(0).alias("what"), F.lit(False).alias("none"), F.lit(None).cast(kind).alias("_key"), F.col("code").alias("f1"), F.lit(0).cast("long").alias("f2"), F.lit(None).cast("string").alias("text"))
    both = codes.unionByName(docs).repartition("shard", "task").sortWithinPartitions("shard", "task", "what", "none", "_key", "f1", "f2")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        now, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, task, tasks, what = (batch.column(k).to_numpy() for k in range(4))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (task[1:] != task[:-1]) | (what[1:] != what[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if (shard[a], task[a]) != now:
                    if group is not None:
                        yield from group.flush(True)
                    now, group = (shard[a], task[a]), _Group(bool(tasks[a] == 1), window, batch.schema.field(5).type)
                part = batch.slice(a, b - a)
                if what[a] == 0:
                    group.codes.append(part.column(6).to_numpy().view(np.uint64).copy())
                else:
                    yield from group.take(part.select([4, 5, 6, 7, 8]))
        if group is not None:
            yield from group.flush(True)

    return both.mapInArrow(stream, _SCHEMA.format(kind=kind))


def _later(windows: DataFrame, window: int) -> DataFrame:
    """Spans of the windows that another task has found earlier."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = np.concatenate([[(h1[0], h2[0]) == before], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
            before = (h1[-1], h2[-1])
            yield batch.select([2, 3, 4]).filter(pa.array(same))

    ordered = windows.select("h1", "h2", "f1", "f2", "start", "none", "_key").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "none", "_key", "f1", "f2", "start")
    return ordered.mapInArrow(stream, "f1 long, f2 long, start int").withColumn("stop", F.col("start") + window)


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_words(text: str | None, spans: list[tuple[int, int]]) -> bytes:
    """The words outside spans, joined by one space."""
    words = (text or "").encode().split()
    at, parts = 0, []
    for a, b in spans:
        parts += words[at:a]
        at = b
    return b" ".join(parts + words[at:])


def _kept(body: DataFrame, spans: DataFrame) -> DataFrame:
    """(f1, f2, n_removed, spans, kept_sha256) of every different text."""
    bits = body.sparkSession.sparkContext.broadcast(bit_filter(spans, "f1"))
    schema = "f1 long, f2 long, n_removed long, spans array<struct<start:int,stop:int>>, kept_sha256 string"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def rows(f1: pa.Array, f2: pa.Array, texts: pa.Array, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        sums = [hashlib.sha256(kept_words(t, s)).hexdigest() for t, s in zip(texts.to_pylist(), found, strict=True)]
        lists = pa.array([[{"start": a, "stop": b} for a, b in s] for s in found], kind)
        return pa.RecordBatch.from_arrays([f1, f2, pa.array([sum(b - a for a, b in s) for s in found], pa.int64()), lists, pa.array(sums, pa.string())], names=["f1", "f2", "n_removed", "spans", "kept_sha256"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(~passes(bits.value, batch.column(0).to_numpy())))
            yield rows(some.column(0), some.column(1), some.column(2), [[]] * some.num_rows)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(0).to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch.column(0), batch.column(1), batch.column(2), [_union(x) for x in batch.column(3).to_pylist()])

    texts = body.select("f1", "f2", "text")
    listed = spans.groupBy("f1", "f2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    dirty = texts.mapInArrow(rest, "f1 long, f2 long, text string").join(listed, ["f1", "f2"], "left").select("f1", "f2", "text", "spans")
    every = texts.mapInArrow(clean, schema).unionByName(dirty.mapInArrow(cut, schema))
    return every.groupBy("f1", "f2").agg(*(F.any_value(c).alias(c) for c in ("n_removed", "spans", "kept_sha256")))


def _named(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """(key, n_words, n_removed, spans, kept_sha256) for every row: the words to remove so that each passage stays once.

    A window is so many consecutive words of one text. Words of a window whose words also begin earlier (smaller key, or the
    same text before) are removed; windows are judged on the input. spans are the places of the removed words, from 0, ends
    exclusive; kept_sha256 is the hash of the other words joined by one space.

    Phrases of half a window that stand for windows are counted over all texts; those that recur are compiled into
    automata, sharded by the first text that has them, and every text streams through the automata of its shards. The
    windows that hold an occurrence are compared by 128-bit hashes, first within tasks, then the first ones of tasks.

    Null and empty texts have no words. Texts shorter than a window lose nothing. Of equal rows one counts as the first;
    rows with one key and other texts follow each other in the order of their hashes. Null keys come last. Repeated rows
    keep their rows; an empty table gives an empty table; other columns are not looked at. The words of one text are held
    together, a worker's memory follows the longest one.
    """
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = own.select("_key", *(x.alias(n) for x, n in zip(_named(F.col("text")), ("f1", "f2"), strict=True)), "text")
    both = written(_phrases(body, window), "phrases")
    rows = both.where("code is null").groupBy("_key", "n", "f1", "f2").agg(F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key")).alias("least")
    classes = written(both.where("code is null").groupBy("f1", "f2", "n").agg(least).select("f1", "f2", "n", "least.*"), "classes")
    phrases = both.where("code is not null")
    counted = phrases.groupBy("code").agg(F.min("f1").alias("owner"), F.max("f1").alias("other"), F.max("n").alias("most"))
    recurring = written(counted.where("owner < other or most > 1").select("code", "owner"), "recurring")
    shards, _ = _sharded(recurring)
    patterns = written(shards, "patterns")
    routes = written(phrases.join(patterns, "code").select("f1", "f2", "shard").distinct().join(classes, ["f1", "f2"]), "routes")
    found = written(_matched(body, patterns, routes, window), "found")
    spans = written(found.where("stop is not null").select("f1", "f2", "start", "stop").unionByName(_later(found.where("stop is null"), window)), "spans")
    results = written(_kept(body, spans), "kept")
    discard(recurring, patterns, routes, found, spans)
    every = rows.join(results, ["f1", "f2"]).join(classes.select("f1", "f2", F.col("_key").alias("least")), ["f1", "f2"])
    every = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    whole = ~(F.col("_key").eqNullSafe(F.col("least")) & (F.col("copy") == 1)) & (F.col("n") >= window)
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("stop")))
    return every.select(
        F.col("_key").alias(key),
        F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, all_of).otherwise(F.col("spans")).alias("spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
