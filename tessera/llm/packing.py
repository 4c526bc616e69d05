"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import LOWER_ASCII, bytes_of, gapless_rank, resident, text_slices, words_of, written
from tessera.llm._words import WordMemory

END_ID = 1


class Encoder:
    """Token ids of whole texts, many texts at once.

    The tokenizer file splits texts at white space, then into letters, digits and other marks, before it merges anything.
    So texts are cut at spaces and line ends, and plain stretches (ASCII and the letters of Latin-1, no apostrophe and no <)
    between letters and the rest too; each distinct part is encoded once and remembered. Letters need no normalisation
    there but lower case. Any other stretch goes to the tokenizer whole.
    """

    SPACE, LETTER, OTHER, WHOLE = range(4)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        with open(path) as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]
        self.memory = WordMemory(self._parts)
        self.kind = np.full(256, self.OTHER, np.int8)
        self.kind[[32, 10]] = self.SPACE
        self.kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = self.LETTER
        self.plain_second = np.zeros(256, bool)
        self.plain_second[128:192] = True
        self.plain_second[[0x97, 0xB7]] = False  # the signs for times and divided by
        self.odd = np.zeros(256, bool)
        self.odd[[ord("'"), ord("<"), *range(128, 256)]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parts(self, words: list[bytes], kinds: np.ndarray) -> list[np.ndarray]:
        out = []
        for word, kind in zip(words, kinds.tolist(), strict=True):
            if kind == self.LETTER:
                text = word.decode() if word.isascii() else "".join([self.sign[b] for b in word])
                out.append(np.array([t.id for t in self.bpe.tokenize(text)], np.uint32))
            else:
                out.append(self._whole(word.decode()))
        return out

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; n + 1 offsets of the texts' ids)."""
        if not self.by_word:
            whole = raw.tobytes()
            ids = [self._whole(whole[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        kind = self.kind[raw]
        pair = np.zeros(len(raw), bool)  # the second bytes of Latin-1 letters
        if len(raw):
            pair[1:] = (raw[:-1] == 0xC3) & self.plain_second[raw[1:]]
        odd = self.odd[raw] & ~pair
        odd[:-1] &= ~pair[1:]
        starts, ends, _ = words_of(raw, off, self.kind != self.SPACE)
        low = LOWER_ASCII[raw]
        low[pair & (raw <= 0x9E)] += 0x20
        if odd.any():
            seen = np.concatenate([[0], np.cumsum(odd)])
            whole = np.flatnonzero(seen[ends] > seen[starts])
            step = np.zeros(len(raw) + 1, np.int8)
            step[starts[whole]] += 1
            step[ends[whole]] -= 1
            inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            kind = np.where(inside, self.WHOLE, kind).astype(np.int8)
            low = np.where(inside, raw, low)
        cut = np.ones(len(raw), bool)
        if len(raw):
            cut[1:] = kind[1:] != kind[:-1]
            cut[off[:-1][off[:-1] < len(raw)]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(raw))
        real = kind[first] != self.SPACE
        first, last = first[real], last[real]
        rows = self.memory.rows(low, first, last, kind[first])
        ids, sizes = self.memory.joined(rows), self.memory.sizes(rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.searchsorted(first, off, side="left")]


def encoder(path: str) -> Encoder:
    return resident(f"ids {path}", lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): every text's ids, then end_id, cut only where longer than capacity."""
    tail = np.array([] if end_id is None else [end_id], "<u4")
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(body.dtypes)["_key"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                found, at = encode(*bytes_of(part.column(1)))
                for i in range(part.num_rows):
                    whole = np.concatenate([found[at[i] : at[i + 1]], tail]).astype("<u4")
                    for k in range(0, max(1, len(whole)), capacity):
                        own = whole[k : k + capacity]
                        row.append(i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["_key", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    out = body.mapInArrow(cut, f"_key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("_key", key)


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where pieces go, from the number of pieces of each length alone.

    Lengths go from the largest. Above one third of the capacity at most two pieces share a sequence, and each takes the
    fullest sequence with room for it: a greedy matching of large pieces. The smaller ones then fill the gaps that fit
    tightest. Sequences that look alike are kept as one range, so the work follows the number of lengths, at most capacity,
    and not that of pieces. Rows: pieces of length with ranks first..first + count - 1 go per_bin to each sequence from
    sequence on, at offset.
    """
    alike: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (first, number)
    rooms: list[int] = []
    opened = 0
    runs = []

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in alike:
                bisect.insort(rooms, room)
            alike.setdefault(room, []).append((first, number))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = alike[room].pop()
                if not alike[room]:
                    del alike[room]
                    rooms.pop(at)
            else:
                room = capacity
                first, number = opened, -(-left // (capacity // length))
                opened += number
            each = room // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number:
                if left:
                    runs.append((length, rank, left, left, first + full, capacity - room))
                    put(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                put(room, first + full, number - full)
    return pd.DataFrame(runs, columns=["length", "first", "count", "per_bin", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False, per_bucket: int = 4_000) -> DataFrame:
    """Packs every text into sequences of at most capacity ids: pieces' columns, then sequence_id and offset.

    Texts are tokenised once into a written table. The driver sees only how many pieces each length has (capacity rows at
    most) and plans runs of like sequences; pieces find theirs by their rank within their length. A null or empty text
    is its end id alone (without an end id: a piece of no ids, in a sequence by itself). Null and repeated keys keep their
    rows. An empty table gives an empty table; other columns are not looked at.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, key, text, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    starts = spark.sparkContext.broadcast({c: runs[c].to_numpy(np.int64) for c in runs.columns})
    sequences = int((runs["sequence"] + -(-runs["count"] // runs["per_bin"])).max()) if len(runs) else 0
    ranked = gapless_rank(cut, ["length"], [key, "piece", "ids_crc32", "start"], "_rank", sum(counts.values()), per_bucket)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = starts.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(p["length"]):
            return pd.DataFrame({"sequence_id": sequences + rank, "offset": 0 * rank})
        # runs are sorted by (length, first): the last one at or before (length, rank)
        low = np.searchsorted(p["length"], length, side="left")
        high = np.searchsorted(p["length"], length, side="right")
        while (high - low > 1).any():
            mid = (low + high) // 2
            go = (high - low > 1) & (p["first"][np.minimum(mid, len(p["first"]) - 1)] <= rank)
            low, high = np.where(go, mid, low), np.where(go | (high - low <= 1), high, mid)
        low = np.minimum(low, len(p["first"]) - 1)
        inside = rank - p["first"][low]
        sequence = p["sequence"][low] + inside // p["per_bin"][low]
        offset = p["offset"][low] + inside % p["per_bin"][low] * length
        none = length == 0
        return pd.DataFrame({"sequence_id": np.where(none, sequences + rank, sequence), "offset": np.where(none, 0, offset)})

    return ranked.withColumn("_at", place("length", "_rank")).select(key, "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"), *(["ids"] if with_ids else []))
