"""Collocations by hierarchical pair naming: adjacent ids of frequent phrases get the id of their pair, from a global join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import LOWER_ASCII, bytes_of, class_table, discard, mix64, resident, text_slices, word_hashes, words_of, written

#: Words of a chunk, about: what a task holds at once, and what shares a dictionary.
CHUNK_WORDS = 1_000_000
_ENDS = b".,;:!?\n\x0b\x0c\r"
_WORD, _END = class_table(separators=b" \t" + _ENDS), class_table(words=_ENDS)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CODEC = "zstd"
#: Pairs that chunks send to one bucket, about: what a task adds up at once.
BUCKET_PAIRS = 1_000_000
_ANSWER = ["left", "right", "a", "id", "chunk", "bucket", "n", "places", "ids"]


def _packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype(np.int32).tobytes(), codec=_CODEC, asbytes=True)


def _unpacked(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, 4 * n, codec=_CODEC, asbytes=True), np.int32)


class _Chunk:
    """Words of texts as codes from 1 of a dictionary of its own, 0 where a piece ends."""

    def __init__(self):
        self.codes: list[np.ndarray] = []
        self.names: dict[int, int] = {}
        self.words: list[tuple[str, str]] = []
        self.n = 0

    def take(self, texts: pa.Array, langs: list[str]) -> None:
        raw, off = bytes_of(texts)
        low = LOWER_ASCII[raw]
        starts, ends, owner = words_of(low, off, _WORD)
        if not len(starts):
            return
        tongues, of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        marks = np.array([hash(("lang", x)) & (2**64 - 1) for x in tongues.tolist()], np.uint64)
        named = word_hashes(low, starts, ends) + marks[of[owner]] * _SPREAD
        local, distinct = pd.factorize(named)
        first = np.empty(len(distinct), np.int64)
        first[local[::-1]] = np.arange(len(local))[::-1]
        whole, codes = low.tobytes(), np.empty(len(distinct), np.int32)
        for k, (name, i) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            code = self.names.get(name)
            if code is None:
                code = self.names[name] = len(self.words) + 1
                self.words.append((langs[owner[i]], whole[starts[i] : ends[i]].decode()))
            codes[k] = code
        ends_before = np.cumsum(_END[low])
        piece = ends_before[starts]
        # a break after the last word keeps slices apart
        breaks = np.concatenate([(owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1]), [True]])
        at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(breaks[:-1])])
        out = np.zeros(at[-1] + 2, np.int32)
        out[at] = codes[local]
        self.codes.append(out)
        self.n += len(starts)


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of texts (n, codes) and, beside them, their dictionaries (code, lang, word, times)."""
    names = ["chunk", "n", "codes", "code", "lang", "word", "times"]

    def rows(chunk: _Chunk, number: int) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(chunk.codes)
        many = len(chunk.words)
        same = lambda n: pa.array(np.full(n, number, np.int64))
        yield pa.RecordBatch.from_arrays([same(1), pa.array([len(codes)], pa.int64()), pa.array([_packed(codes)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names=names)
        times = np.bincount(codes, minlength=many + 1)[1:]
        for a in range(0, many, 50_000):
            part = chunk.words[a : a + 50_000]
            m = len(part)
            lang, word = (pa.array([x[k] for x in part], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([same(m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(np.arange(a + 1, a + m + 1, dtype=np.int32)), lang, word, pa.array(times[a : a + m])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for part in text_slices(batch):
                chunk.take(part.column(1), part.column(0).to_pylist())
                if chunk.n >= CHUNK_WORDS:
                    yield from rows(chunk, number)
                    number, chunk = number + 1, _Chunk()
        if chunk.n:
            yield from rows(chunk, number)

    return docs.mapInArrow(run, "chunk long, n long, codes binary, code int, lang string, word string, times long")


def _adjacent(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of adjacent codes, the number of the pair there; left and right code of each pair, how often it comes)."""
    at = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
    pairs, local, times = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True, return_counts=True)
    return at, local, pairs >> 32, pairs & (2**32 - 1), times


def _read(batch: pa.RecordBatch, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, codes and ids (of code 0, 1, ...) of the chunk in row k."""
    chunk, n, codes, ids = (batch.column(c)[k].as_py() for c in range(4))
    return chunk, _unpacked(codes, n), np.frombuffer(ids, np.int64)


def _buckets(left: np.ndarray, right: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): pairs by bucket, then by ids; bucket b has order[edges[b] : edges[b + 1]]. Both sides of a shuffle agree on it."""
    of = (mix64(mix64(left) + right.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((right, left, of))
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def _squeezed(left: np.ndarray, right: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs in order of left: steps of left, right and times, each in as few bytes as the largest needs."""
    parts = [np.diff(left, prepend=0), right, times]
    small = [x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64) for x in parts]
    return bytes(x.itemsize for x in small) + pa.compress(b"".join(x.tobytes() for x in small), codec=_CODEC, asbytes=True)


def _unsqueezed(body: bytes, n: int) -> list[np.ndarray]:
    widths = list(body[:3])
    raw, out, at = pa.decompress(body[3:], n * sum(widths), codec=_CODEC, asbytes=True), [], 0
    for width in widths:
        out.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64))
        at += n * width
    return [np.cumsum(out[0]), *out[1:]]


def _counted(named: DataFrame, least: int, last: bool) -> DataFrame:
    """Pairs of adjacent ids that occur at least so often: (left, right, a, id); beside them, unless last, where chunks have them.

    A chunk sends each bucket of pairs what it has of it, packed; a bucket adds up, names what is frequent, and answers each
    chunk with the places of those pairs in what it sent (chunk, bucket, n, places, ids). A pair has one row of a chunk at
    most; there are never more rows than pairs.
    """
    buckets = 1 + (named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET_PAIRS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, codes, ids = _read(batch, k)
                _, _, left, right, times = _adjacent(codes)
                left, right = ids[left], ids[right]
                order, edges = _buckets(left, right, buckets)
                some = np.flatnonzero(np.diff(edges))
                for at in range(0, len(some), 512):
                    part = some[at : at + 512]
                    own = [order[edges[b] : edges[b + 1]] for b in part.tolist()]
                    bodies = pa.array([_squeezed(left[x], right[x], times[x]) for x in own], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), chunk)), pa.array([len(x) for x in own], pa.int32()), bodies], names=["bucket", "chunk", "n", "body"])

    def answer(bucket: int, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        sent = [_unsqueezed(body, n) for _, n, body in rows]
        left, right, times = (np.concatenate([x[k] for x in sent]) for k in range(3))
        order = np.lexsort((right, left))
        first = np.flatnonzero(np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])]))
        total = np.add.reduceat(times[order], first)
        often = total >= least
        name = np.where(often, np.cumsum(often) * buckets - bucket, 0)
        at = order[first[often]]
        none = lambda kind: pa.nulls(len(at), kind)
        yield pa.RecordBatch.from_arrays([pa.array(left[at]), pa.array(right[at]), pa.array(total[often]), pa.array(name[often]), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary())], names=_ANSWER)
        if last:
            return
        ids = np.empty(len(order), np.int64)
        ids[order] = np.repeat(name, np.diff(np.append(first, len(order))))
        begin = 0
        for chunk, n, _ in rows:
            own = ids[begin : begin + n]
            begin += n
            places = np.flatnonzero(own)
            if len(places):
                none = lambda: pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none(), none(), none(), none(), pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([len(places)], pa.int32()), pa.array([_packed(places)], pa.binary()), pa.array([own[places].tobytes()], pa.binary())], names=_ANSWER)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        now, rows = None, []
        for batch in batches:
            for bucket, chunk, n, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now:
                    if rows:
                        yield from answer(now, rows)
                    now, rows = bucket, []
                rows.append((chunk, n, body))
        if rows:
            yield from answer(now, rows)

    sent = named.mapInArrow(send, "bucket int, chunk long, n int, body binary").repartition("bucket").sortWithinPartitions("bucket")
    return written(sent.mapInArrow(gather, "left long, right long, a long, id long, chunk long, bucket int, n int, places binary, ids binary"), "counted")


def _renamed(named: DataFrame, counted: DataFrame) -> DataFrame:
    """Chunks of the adjacent pairs that buckets have named, in place of what they were made of."""
    buckets = 1 + (named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET_PAIRS)
    none = lambda kind: F.lit(None).cast(kind)
    answers = counted.where("chunk is not null").select("chunk", F.lit(0).alias("what"), "bucket", F.col("n").cast("long").alias("n"), F.col("places").alias("codes"), "ids")
    every = answers.unionByName(named.select("chunk", F.lit(1).alias("what"), none("int").alias("bucket"), "n", "codes", "ids"))

    def row(chunk: int, codes: np.ndarray, ids: np.ndarray, told: list[tuple]) -> pa.RecordBatch:
        at, local, left, right, _ = _adjacent(codes)
        order, edges = _buckets(ids[left], ids[right], buckets)
        pair = np.concatenate([order[edges[b] + _unpacked(places, n)] for b, n, places, _ in told])
        known = np.concatenate([np.frombuffer(x, np.int64) for *_, x in told])
        table = np.zeros(len(order), np.int32)
        table[pair] = np.arange(1, len(pair) + 1)
        out = np.zeros(len(codes), np.int32)
        out[at] = table[local]
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(out)], pa.int64()), pa.array([_packed(out)], pa.binary()), pa.array([np.concatenate([[0], known]).tobytes()], pa.binary())], names=["chunk", "n", "codes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        now, told = None, []
        for batch in batches:
            for chunk, what, bucket, n, codes, ids in zip(*(batch.column(k) for k in range(6)), strict=True):
                if chunk.as_py() != now:
                    now, told = chunk.as_py(), []
                if what.as_py() == 0:
                    told.append((bucket.as_py(), n.as_py(), codes.as_py(), ids.as_py()))
                elif told:
                    yield row(now, _unpacked(codes.as_py(), n.as_py()), np.frombuffer(ids.as_py(), np.int64), told)

    ordered = every.repartition("chunk").sortWithinPartitions("chunk", "what")
    return ordered.mapInArrow(run, "chunk long, n long, codes binary, ids binary")


def _named(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks (chunk, n, codes, ids) of those codes that have ids (chunk, code, id)."""
    none = lambda kind: F.lit(None).cast(kind)
    told = ids.select("chunk", F.lit(0).alias("what"), "code", "id", none("long").alias("n"), none("binary").alias("codes"))
    every = told.unionByName(chunks.select("chunk", F.lit(1).alias("what"), none("int").alias("code"), none("long").alias("id"), "n", "codes"))

    def row(chunk: int, codes: np.ndarray, code: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
        table = np.zeros(max(int(codes.max(initial=0)), int(code.max())) + 1, np.int32)
        table[code] = np.arange(1, len(code) + 1)
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(codes)], pa.int64()), pa.array([_packed(table[codes])], pa.binary()), pa.array([np.concatenate([[0], id_]).tobytes()], pa.binary())], names=["chunk", "n", "codes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        now, code, id_ = None, [], []
        for batch in batches:
            chunk, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (what[1:] != what[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)], strict=True):
                if a == b:
                    continue
                if chunk[a] != now:
                    now, code, id_ = chunk[a], [], []
                part = batch.slice(a, b - a)
                if what[a] == 0:
                    code.append(part.column(2).to_numpy())
                    id_.append(part.column(3).to_numpy())
                elif code:
                    yield row(int(now), _unpacked(part.column(5)[0].as_py(), part.column(4)[0].as_py()), np.concatenate(code), np.concatenate(id_))

    ordered = every.repartition("chunk").sortWithinPartitions("chunk", "what")
    return ordered.mapInArrow(run, "chunk long, n long, codes binary, ids binary")


def _frequent(dictionaries: DataFrame, names: list[str], least: int) -> DataFrame:
    """(id, names, a) of what occurs at least so often in all chunks together; ids run from 1 without gaps."""
    counted = dictionaries.groupBy(*names).agg(F.sum("times").alias("a")).where(F.col("a") >= least)
    made = written(counted.select(F.monotonically_increasing_id().alias("_row"), *names, "a"), "frequent")
    part, place = F.expr("shiftright(_row, 33)").alias("_part"), F.expr("_row & ((1L << 33) - 1)")
    # one row for each partition of the table
    sizes = made.groupBy(part).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before = [(r["_part"], sum(x["n"] for x in sizes[:i])) for i, r in enumerate(sizes)]
    offsets = made.sparkSession.createDataFrame(before, "_part long, _before long")
    return made.withColumn("_part", part).join(F.broadcast(offsets), "_part").select((F.col("_before") + place + 1).alias("id"), *names, "a")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)) beyond 64 bits."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(8,0)"), wide(l) + wide(r))


def _grams(pairs: DataFrame, below: DataFrame, words: int) -> DataFrame:
    """Phrases of so many words from their pairs: heads and tails hold how often their first and last 1, 2, ... words occur."""
    left = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "heads")
    right = below.select(F.col("id").alias("right"), F.col("final").alias("last"), "tails")
    both = pairs.join(left, "left").join(right, "right")
    cut = lambda k: F.struct(_score(F.col("a"), F.col("heads")[k - 1], F.col("tails")[words - k - 1]).alias("score"), F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"), F.col("tails")[words - k - 1].alias("r"))
    cuts = F.array_min(F.array(*(cut(k) for k in range(1, words))))
    return both.select(
        "id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), F.col("last").alias("final"), "a", cuts.alias("cut"), F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails")
    )


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 4, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to longest words that hold together best, top of each language.

    a, l, r: occurrences of a phrase and of both sides of its lowest-scoring cut within pieces of texts, n: words of the
    language; score is floor(2000000 * a / (l + r)). Phrases that occur fewer than least times are none, nor are those inside a
    longer one that occurs at least percent / 100 times as often.

    Texts become chunks of word codes. Words that occur often get global ids; adjacent ids that make a frequent pair get the
    pair's id, and so on: an id of k words points to the two ids of k - 1 words that it is made of. Heads, tails and what a
    phrase is part of come from joins along these pointers, as whatever a longer phrase holds occurs at least as often.

    Null texts are empty; a null language is und. Texts without words give nothing, an empty table gives an empty table;
    repeated rows count as often as they come; other columns are not looked at. A chunk ends with a text, so a worker's memory
    follows the longest text. Ranks have no ties: phrases of one language differ.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    body = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = written(_chunks(body), "chunks")
    dictionary = both.where("code is not null")
    totals = dictionary.groupBy("lang").agg(F.sum("times").alias("n"))
    frequent = _frequent(dictionary, ["lang", "word"], least)
    level = frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("final"), F.array("a").alias("heads"), F.array("a").alias("tails"))
    known = dictionary.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "code", "id")
    named = written(_named(both.where("codes is not null"), known), "named")
    found = []
    for words in range(2, longest + 1):
        counted = _counted(named, least, words == longest)
        frequent = counted.where("left is not null").select("id", "left", "right", "a")
        level = written(_grams(frequent, level, words), "grams")
        if found:
            above = frequent.select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
            found[-1] = found[-1].join(above, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(28,0)") < percent * F.col("a").cast("decimal(28,0)")))
        found.append(level.select("id", "lang", "phrase", "a", "cut"))
        if words < longest:
            paired = written(_renamed(named, counted), "named")
            discard(named)
            named = paired
    discard(named)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    every = found[0].select("lang", "phrase", "a", "cut")
    for more in found[1:]:
        every = every.unionByName(more.select("lang", "phrase", "a", "cut"))
    ranked = every.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
