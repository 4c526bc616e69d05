"""Exact n-gram Jaccard join of whole texts by prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import LOWER_ASCII, bit_filter, bytes_of, class_table, components, discard, mix64, passes, resident, text_slices, word_hashes, words_of, written

#: Frequent tokens that go last in every order; a hint of fixed size, the result does not depend on it.
FREQUENT = 1 << 17
#: Tokens are counted in all texts; those in more than twice so many may be frequent.
COUNTED = 8
#: Tokens that a task counts together, and the ranges of tokens (a power of two) by which the counts of all tasks are added up.
HELD_TOKENS = 500_000
PARTS = 1 << 12
#: Members of a bucket up to which one group compares them; larger ones are dealt in pairs of blocks of this size.
BLOCK = 2_000
#: Sets that a task remembers, to hand on each only once.
REMEMBERED = 100_000
#: Texts with a frequent token above which its bucket is dealt to several tasks.
HOT = 4_000
#: Cells of a text's sketch; texts with more shingles than SKETCHED have none.
CELLS, SKETCHED = 256, 10_000
_WORD = class_table(separators=b" \t\n\x0b\x0c\r")
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_ORDER = [np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2F9BE6CC3D1A7B05, 0x60BEE2BEE120FC15)]


class Sets:
    """Distinct shingles of the texts of one slice: tokens sorted within each text, and where each text's begin."""

    def __init__(self, texts: pa.Array, n: int):
        raw, off = bytes_of(texts)
        low = LOWER_ASCII[raw]
        starts, ends, owner = words_of(low, off, _WORD)
        words = word_hashes(low, starts, ends)
        many = len(texts)
        first = np.searchsorted(owner, np.arange(many + 1))
        sizes = np.diff(first)
        tokens = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            tokens += words[k : k + len(tokens)] * _PLACE[k % len(_PLACE)] * np.uint64(2 * (k // len(_PLACE)) + 1)
        whole = np.flatnonzero(owner[: len(tokens)] == owner[n - 1 :]) if len(tokens) else np.zeros(0, np.int64)
        tokens, of = mix64(tokens[whole]), owner[whole]
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short):
            extra = np.array([np.bitwise_xor.reduce(mix64(words[first[i] : first[i + 1]] + _PLACE[0] * np.arange(1, sizes[i] + 1, dtype=np.uint64))) + np.uint64(sizes[i]) for i in short.tolist()], np.uint64)
            tokens, of = np.concatenate([tokens, mix64(extra)]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            tokens, of = tokens[order], of[order]
        order = _by_text(tokens, of)
        tokens, of = tokens[order], of[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
        self.tokens, self.of = tokens[keep], of[keep]
        self.first = np.searchsorted(self.of, np.arange(many + 1))
        self.sizes = np.diff(self.first)
        self.filled = np.flatnonzero(self.sizes)
        self.name = [self._sum(mix64(self.tokens ^ _ORDER[k])) for k in (2, 3)]

    def _sum(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.uint64)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(values, self.first[self.filled])
        return mix64(out + self.sizes.astype(np.uint64))

    def only(self, texts: np.ndarray) -> Sets:
        """The sets of some texts, numbered anew."""
        out = object.__new__(Sets)
        mark = np.full(len(self.sizes), -1, np.int64)
        mark[texts] = np.arange(len(texts))
        of = mark[self.of]
        out.tokens, out.of = self.tokens[of >= 0], of[of >= 0]
        out.sizes = self.sizes[texts]
        out.first = np.concatenate([[0], np.cumsum(out.sizes)])
        out.name = [x[texts] for x in self.name]
        return out

    def lowest_pair(self, order: int) -> np.ndarray:
        """A hash of each text's two first tokens in a hashed order."""
        values = mix64(self.tokens ^ _ORDER[order])
        out = np.zeros(len(self.sizes), np.uint64)
        if len(self.filled):
            at = self.first[self.filled]
            one = np.minimum.reduceat(values, at)
            rest = np.where(values == np.repeat(one, self.sizes[self.filled]), np.uint64(2**64 - 1), values)
            out[self.filled] = mix64(one + mix64(np.minimum.reduceat(rest, at)))
        return out ^ np.uint64(order)

    def prefix(self, order: int, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into tokens, place in the order) of the tokens of each text one of which any linked text must share."""
        names, ranks = frequent
        key = mix64(self.tokens ^ _ORDER[order]) >> np.uint64(1)
        if len(names):
            at = np.minimum(np.searchsorted(names, self.tokens), len(names) - 1)
            common = names[at] == self.tokens
            key[common] = np.uint64(1 << 63) + ranks[at[common]]
        ordered = _by_text(key, self.of)
        place = np.arange(len(ordered)) - self.first[self.of]
        length = self.sizes - -(-self.sizes * percent // 100) + 1
        keep = place < length[self.of]
        return ordered[keep], place[keep]


def _by_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The order of values within each text: one sort by value, then a counting sort by text."""
    order = np.argsort(values)
    small = of.astype(np.uint16) if not len(of) or of[-1] < 1 << 16 else of
    return order[np.argsort(small[order], kind="stable")]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


class _Once:
    """Which sets come up for the first time, so that copies within a task are handed on once."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), bool)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for i, x in enumerate(names.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _shared(a: pa.Array, b: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Which of rows have a common value in their two lists of 32-bit tokens."""

    def keyed(lists: pa.Array) -> np.ndarray:
        own = lists.take(pa.array(rows))
        raw, off = bytes_of(own)
        return np.repeat(np.arange(len(rows), dtype=np.uint64), np.diff(off) // 4) << np.uint64(32) | np.frombuffer(raw.tobytes(), np.uint32).astype(np.uint64)

    out = np.zeros(len(rows), bool)
    left = keyed(a)
    out[(left[np.isin(left, keyed(b), kind="sort")] >> np.uint64(32)).astype(np.int64)] = True
    return out


def _room(a: pa.Array, b: pa.Array, percent: int) -> np.ndarray:
    """Which rows could be links by their sketches: two texts share no more tokens of a cell than the one with fewer there has."""
    out = np.ones(len(a), bool)
    both = np.flatnonzero((np.diff(_ends(a)) == CELLS) & (np.diff(_ends(b)) == CELLS))
    if len(both):
        x, y = (np.frombuffer(bytes_of(v.take(pa.array(both)))[0].tobytes(), np.uint8).reshape(-1, CELLS) for v in (a, b))
        most = np.minimum(x, y).sum(1, dtype=np.int64)
        out[both] = 100 * most >= percent * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64) - most)
    return out


def _ends(values: pa.Array) -> np.ndarray:
    return bytes_of(values)[1]


class Join:
    """The links between the texts of docs whose shingle sets have a Jaccard similarity of at least percent / 100."""

    def __init__(self, docs: DataFrame, key: str, text: str, n: int, percent: int):
        self.n, self.percent = n, percent
        self.spark = docs.sparkSession
        self.body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        self._describe()

    def _over(self, make: Callable[[Sets, pa.RecordBatch, _Once], Iterator[pa.RecordBatch]], schema: str, keyed: bool = False) -> DataFrame:
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resident()
            once = _Once()
            for batch in batches:
                for part in text_slices(batch):
                    yield from make(Sets(part.column(part.schema.get_field_index("text")), n), part, once)

        return (self.body if keyed else self.body.select("text")).mapInArrow(run, schema)

    def _describe(self) -> None:
        """Every row's set size, 128-bit name and group keys; the frequent tokens of the corpus.

        A token's count is the number of texts that have it, equal sets of one task once: as many rows as it may have in buckets.
        """
        kind = dict(self.body.dtypes)["_key"]
        n, few = self.n, 2 * COUNTED
        names = ["_key", "n", "f1", "f2", "k0", "k1", "k2"]
        shift = np.uint64(64 - PARTS.bit_length() + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resident()
            once, held, kept, like = _Once(), 0, [], None

            def counts() -> pa.RecordBatch:
                tokens, times = np.unique(np.concatenate(kept), return_counts=True)
                kept.clear()
                edge = np.searchsorted(tokens, np.arange(PARTS, dtype=np.uint64) << shift)
                part = np.flatnonzero(np.diff(edge, append=len(tokens)))
                cut = np.append(edge[part], len(tokens))
                packed = (pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((cut * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (tokens, times.astype(np.uint32)))
                return pa.RecordBatch.from_arrays([pa.nulls(len(part), like), *[pa.nulls(len(part), pa.int64())] * 6, pa.array(part.astype(np.int32)), *packed], names=[*names, "part", "tokens", "times"])

            for batch in batches:
                like = batch.schema.field(0).type
                for part in text_slices(batch):
                    s = Sets(part.column(1), n)
                    none = pa.nulls(part.num_rows, pa.binary())
                    anywhere = ((s.name[0] + np.arange(part.num_rows, dtype=np.uint64)) % np.uint64(PARTS)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), _longs(s.sizes), *map(_longs, s.name), *(_longs(s.lowest_pair(k)) for k in range(3)), pa.array(anywhere), none, none], names=[*names, "part", "tokens", "times"])
                    kept.append(s.tokens[once(s.name[0])[s.of]])
                    held += len(kept[-1])
                    if held > HELD_TOKENS:
                        yield counts()
                        held = 0
            if kept:
                yield counts()

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resident()
            tokens, times, like = np.zeros(0, np.uint64), np.zeros(0, np.int64), None

            def frequent(tokens: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
                many = times > few
                none = pa.nulls(int(many.sum()), pa.int64())
                return pa.RecordBatch.from_arrays([pa.nulls(len(none), like), *[none] * 6, _longs(tokens[many]), _longs(times[many])], names=[*names, "token", "times"])

            for batch in batches:
                like = batch.schema.field(0).type
                packed = batch.column(8).is_valid()
                rows, batch = batch.filter(pc.invert(packed)), batch.filter(packed)
                none = pa.nulls(rows.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns[:7], none, none], names=[*names, "token", "times"])
                for some in text_slices(batch, "tokens", 8 * HELD_TOKENS):
                    tokens = np.concatenate([tokens, np.frombuffer(bytes_of(some.column(8))[0].tobytes(), np.uint64)])
                    times = np.concatenate([times, np.frombuffer(bytes_of(some.column(9))[0].tobytes(), np.uint32)])
                    order = np.argsort(tokens)
                    tokens, times = tokens[order], times[order]
                    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
                    tokens, times = tokens[first], np.add.reduceat(times, first)
                    # the last range may go on
                    done = int(np.searchsorted(tokens, tokens[-1] >> shift << shift))
                    yield frequent(tokens[:done], times[:done])
                    tokens, times = tokens[done:], times[done:]
            if len(tokens):
                yield frequent(tokens, times)

        described = f"_key {kind}, n long, f1 long, f2 long, k0 long, k1 long, k2 long"
        dealt = self.body.mapInArrow(run, f"{described}, part int, tokens binary, times binary").repartition("part").sortWithinPartitions("part")
        both = written(dealt.mapInArrow(added, f"{described}, token long, times long"), "sets")
        self.rows = both.where("token is null").select("_key", "n", "f1", "f2")
        self.classes = written(both.where("token is null and n > 0").groupBy("f1", "f2", "n", "k0", "k1", "k2").agg(F.min("_key").alias("least")), "classes")
        top = both.where("token is not null").select("token", "times").orderBy(F.desc("times"), "token").limit(FREQUENT).toPandas()
        tokens = top["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        # the most frequent one is the last of all
        self.frequent = self.spark.sparkContext.broadcast((tokens[order], (len(tokens) - 1 - order).astype(np.uint64)))
        self.times = self.spark.sparkContext.broadcast(top["times"].to_numpy(np.int64)[order])
        self.tables = [both, self.classes]

    def near_groups(self) -> DataFrame:
        """Pairs (a, b) from texts to one text each of those with the same two lowest tokens under some hashed order."""
        keys = self.classes.select("f1", "n", F.explode(F.array("k0", "k1", "k2")).alias("k"))
        centres = keys.groupBy("k").agg(F.min("f1").alias("c"), F.count("*").alias("m")).where("m > 1").select("k", "c")
        return keys.join(centres, "k").where("f1 <> c").select(F.least("f1", "c").alias("a"), F.greatest("f1", "c").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b: first halves of names) that are links, as whole names: (a1, a2, b1, b2)."""
        bits = self.spark.sparkContext.broadcast(bit_filter(pairs.select(F.explode(F.array("a", "b")).alias("f")), "f"))
        percent = self.percent

        def keep(s: Sets, _: pa.RecordBatch, once: _Once) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(passes(bits.value, s.name[0]) & (s.sizes > 0))
            at = at[once(s.name[0][at])]
            sets = pa.array([s.tokens[s.first[i] : s.first[i + 1]].tobytes() for i in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([_longs(s.name[0][at]), _longs(s.name[1][at]), sets], names=["f1", "f2", "body"])

        # equal names have equal bodies: any one of them stands for all
        sets = written(self._over(keep, "f1 long, f2 long, body binary").groupBy("f1", "f2").agg(F.max("body").alias("body")), "bodies")
        left = pairs.join(sets.select(F.col("f1").alias("a"), F.col("f2").alias("a2"), F.col("body").alias("abody")), "a")
        both = left.join(sets.select(F.col("f1").alias("b"), F.col("f2").alias("b2"), F.col("body").alias("bbody")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("abody", "bbody"))
                ok = []
                for x, y in zip(a, b, strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield batch.select(["a", "a2", "b", "b2"]).filter(pa.array(ok, pa.bool_()))

        found = both.mapInArrow(check, "a long, a2 long, b long, b2 long")
        links = written(found.select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2"), "links")
        discard(pairs, sets)
        return links

    def buckets(self) -> DataFrame:
        """(token, f1, n, place) for tokens that begin at least two texts in the first order, or that many texts have."""
        frequent, times, percent = self.frequent, self.times, self.percent

        def emit(s: Sets, _: pa.RecordBatch, once: _Once) -> Iterator[pa.RecordBatch]:
            s = s.only(np.flatnonzero(once(s.name[0])))
            at, place = s.prefix(0, frequent.value, percent)
            of, tokens = s.of[at], s.tokens[at]
            # a bucket of very many texts is dealt to several tasks
            part = np.zeros(len(at), np.int32)
            if len(frequent.value[0]):
                slot = np.minimum(np.searchsorted(frequent.value[0], tokens), len(frequent.value[0]) - 1)
                hot = np.flatnonzero((frequent.value[0][slot] == tokens) & (times.value[slot] > HOT))
                part[hot] = 1 + (s.name[0][of[hot]] % (times.value[slot[hot]] // HOT + 1).astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_longs(tokens), _longs(s.name[0][of]), pa.array(s.sizes[of].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(part)], names=["token", "f1", "n", "place", "part"])

        def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.RecordBatch | None = None  # the last row so far, not yet given
            shared = False  # whether its token has come before
            for batch in batches:
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                if not batch.num_rows:
                    continue
                token, f1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (f1[1:] != f1[:-1])])  # copies fall away
                batch, token = batch.filter(pa.array(fresh)), token[fresh]
                same = np.concatenate([[shared], token[1:] == token[:-1]]) | (batch.column(4).to_numpy() > 0)
                keep = same | np.concatenate([same[1:], [False]])
                keep[-1] = False
                held, shared = batch.slice(batch.num_rows - 1), bool(same[-1])
                yield batch.filter(pa.array(keep))
            if held is not None and shared:
                yield held

        schema = "token long, f1 long, n int, place int, part int"
        prefixes = self._over(emit, schema).repartition(F.col("token"), F.col("part")).sortWithinPartitions("token", "part", "n", "f1", "place")
        return written(prefixes.mapInArrow(several, schema).drop("part"), "buckets")

    def centred(self, buckets: DataFrame) -> DataFrame:
        """Pairs (a, b) from the texts of a bucket to the one with the fewest rarer tokens before the bucket's token.

        Edits of a text that is copied often make rare tokens, so that one is the text itself or nearly so. As many pairs
        as rows of buckets at most.
        """
        centres = buckets.groupBy("token").agg(F.min(F.struct("place", "n", "f1")).alias("c"))
        most = F.least(F.col("n") - F.col("place"), F.col("c.n") - F.col("c.place")) * (100 + self.percent)
        near = buckets.join(centres, "token").where((F.col("f1") != F.col("c.f1")) & (most >= self.percent * (F.col("n") + F.col("c.n"))))
        return near.select(F.least("f1", "c.f1").alias("a"), F.greatest("f1", "c.f1").alias("b")).distinct()

    def candidates(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b) not yet in one component that share a bucket and could be long enough; labels: (f1, label)."""
        percent = self.percent
        sized = buckets.groupBy("token").agg(F.count("*").alias("m"))
        large = sized.where(F.col("m") > BLOCK).select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        marked = buckets.join(labels, "f1", "left").withColumn("label", F.coalesce("label", "f1"))
        dealt = marked.join(large, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        dealt = dealt.select("token", "cell", "n", "f1", "place", "label", F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block")).alias("block"))

        def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old: list[np.ndarray] | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                new = [batch.column(k).to_numpy() for k in range(7)]
                done = 0 if old is None else len(old[0])
                cols = new if old is None else [np.concatenate(x) for x in zip(old, new, strict=True)]
                token, cell, n, f1, place, label, block = cols
                group = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (cell[1:] != cell[:-1]))])
                rank = group * np.int64(1 << 32) + n
                least = np.searchsorted(rank, group * np.int64(1 << 32) + -(-n.astype(np.int64) * percent // 100))
                last = np.arange(done, len(n))
                counts = last - least[last]
                ends = np.cumsum(counts)
                at = 0
                while at < len(last):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, side="right")))
                    j = np.repeat(last[at:to], counts[at:to])
                    i = np.arange(len(j)) - np.repeat(ends[at:to] - counts[at:to] - (ends[at - 1] if at else 0), counts[at:to]) + np.repeat(least[last[at:to]], counts[at:to])
                    # for the first token that two texts share: it and all that comes after it must reach the overlap asked for
                    most = np.minimum(n[i] - place[i], n[j] - place[j])
                    ok = (label[i] != label[j]) & (most * (100 + percent) >= percent * (n[i].astype(np.int64) + n[j])) & ((block[i] < 0) | (block[i] != block[j]))
                    i, j = i[ok], j[ok]
                    if len(i):
                        ab = np.unique(np.stack([np.minimum(f1[i], f1[j]), np.maximum(f1[i], f1[j])], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])
                    at = to
                back = np.flatnonzero((group == group[-1]) & (100 * n.astype(np.int64) >= percent * n[-1]))
                old = [x[back] for x in cols]

        ordered = dealt.repartition(F.col("token"), F.col("cell")).sortWithinPartitions("token", "cell", "n", "f1")
        return ordered.mapInArrow(pair, "a long, b long").distinct()

    def intersected(self, pairs: DataFrame, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
        """The pairs that share a beginning token under each further order, too, and whose sketches leave room for a link."""
        pairs = written(pairs, "candidates")
        bits = self.spark.sparkContext.broadcast(bit_filter(pairs.select(F.explode(F.array("a", "b")).alias("f")), "f"))
        frequent, percent = self.frequent, self.percent
        columns = [*(f"p{k}" for k in orders), "cells"]

        def begin(s: Sets, _: pa.RecordBatch, once: _Once) -> Iterator[pa.RecordBatch]:
            mine = np.flatnonzero(passes(bits.value, s.name[0]) & (s.sizes > 0))
            mine = mine[once(s.name[0][mine])]
            s = s.only(mine)
            cols = [_longs(s.name[0])]
            for order in orders:
                at, _place = s.prefix(order, frequent.value, percent)
                short, edge = (s.tokens[at] >> np.uint64(32)).astype(np.uint32), np.searchsorted(s.of[at], np.arange(len(s.sizes) + 1))
                cols.append(pa.array([short[edge[i] : edge[i + 1]].tobytes() for i in range(len(mine))], pa.binary()))
            cells = np.bincount(s.of * CELLS + (s.tokens % np.uint64(CELLS)).astype(np.int64), minlength=len(mine) * CELLS).reshape(-1, CELLS)
            small = (s.sizes <= SKETCHED) & (cells.max(axis=1, initial=0) < 256)
            cells = cells.astype(np.uint8)
            cols.append(pa.array([cells[i].tobytes() if small[i] else b"" for i in range(len(mine))], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["f1", *columns])

        begins = written(self._over(begin, "f1 long, " + ", ".join(f"{c} binary" for c in columns)).dropDuplicates(["f1", *columns]), "begins")
        both = pairs
        for side in ("a", "b"):
            both = both.join(begins.select(F.col("f1").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                side = lambda c: [batch.column(batch.schema.get_field_index(f"{x}_{c}")) for x in "ab"]  # noqa: E731, B023
                rows = np.arange(batch.num_rows)
                for k in orders:
                    rows = rows[_shared(*side(f"p{k}"), rows)]
                rows = rows[_room(*side("cells"), percent)[rows]]
                yield batch.select(["a", "b"]).take(pa.array(rows))

        kept = written(both.mapInArrow(share, "a long, b long").distinct(), "pairs")
        discard(pairs, begins)
        return kept


def _node(one: str, two: str) -> Column:
    return F.concat_ws(":", F.col(one).cast("string"), F.col(two).cast("string"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id) for every row: component_id is the smallest key that links lead to.

    Sets are the distinct shingles of n words, or the whole of a shorter text; texts with 100 * shared >= percent * union are
    linked, and each pair of different texts that is not already known to be in one component is found and verified over
    whole sets. Steps: equal sets become one class; classes with the same lowest tokens, and those of one prefix bucket
    under a global order with frequent tokens last, are tried against one of them each, which closes large groups of near
    copies without their pairs; then the buckets give every other pair, which must also share a beginning token under two
    more orders.

    Texts without words (null ones, too) have size 0 and link to nothing: their component is their own key. Repeated rows
    keep their rows. A null key is never the smallest unless a component has no other. Empty tables give empty tables; other
    columns are not looked at.
    """
    join = Join(docs, key, text, n, percent)
    buckets = join.buckets()
    first = join.verified(join.intersected(join.near_groups().unionByName(join.centred(buckets)).distinct()))
    nodes = lambda links: links.select(_node("a1", "a2").alias("a"), _node("b1", "b2").alias("b"))
    early = written(components(nodes(first)), "early")
    labels = early.select(F.split("node", ":")[0].cast("long").alias("f1"), F.xxhash64("component").alias("label"))
    second = join.verified(join.intersected(join.candidates(buckets, labels)))
    discard(buckets)
    # what the first round has joined stays joined: its stars stand for its links
    known = early.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    groups = components(nodes(second).unionByName(known))
    discard(first, second, early)
    named = join.classes.select("f1", "f2", "least").withColumn("node", _node("f1", "f2")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("f1", "f2", "component_id")
    out = join.rows.join(ids, ["f1", "f2"], "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_key")).alias("component_id"))
