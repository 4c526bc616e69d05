"""Token counts with a whole-token shortcut for piece-based byte-pair models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import bytes_of, class_table, resident, text_slices, words_of
from tessera.llm._words import WordMemory

SPACE = "▁"
NOT_SPACE = class_table(separators=b" ")
_RUN = re.compile(" +[^ ]*")


class Proof(NamedTuple):
    """What was proven of a vocabulary: whether pre-tokens can be encoded alone, and which are one token then (1), or none (0)."""

    splits: bool
    alone: dict[str, int]


def prove(path: str) -> Proof:
    """Made once, on the driver, from the vocabulary file alone.

    No piece has a space sign after another character, so no merge crosses from a word to the space before the next one, and
    pre-tokens (spaces, then a word) can be encoded alone. Every vocabulary string that then comes out as exactly itself
    counts 1 without merging.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [(i, p) for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for _, p in plain) and model.encode("a") != model.encode(" a") and model.encode("a  b ") != model.encode("a b")
    words = [(i, p[1:].replace(SPACE, " ")) for i, p in plain if p.startswith(SPACE) and len(p) > 1]
    alone = {w: 1 for (i, w), ids in zip(words, model.encode([w for _, w in words], num_threads=1), strict=True) if ids == [i]}
    alone[""] = len(model.encode("a ")) - len(model.encode("a"))  # one space sign at the end of a text
    return Proof(splits, alone)


class Counter:
    """Counts tokens as the model's own library does: pre-tokens proven to be one token directly, merging only the rest."""

    def __init__(self, path: str, proof: Proof):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.splits, self.alone = proof
        self.memory = WordMemory(self._rest)

    def _rest(self, words: list[bytes], _: np.ndarray) -> list[np.ndarray]:
        """For every word the number of its tokens, as the one value that the memory keeps."""
        texts = [w.decode() for w in words]
        sizes = [self.alone.get(t, 0) for t in texts]
        rest = [i for i, n in enumerate(sizes) if not n]
        for i, ids in zip(rest, self.model.encode([texts[i] for i in rest], num_threads=1), strict=True):
            sizes[i] = len(ids)
        return list(np.array(sizes, np.uint32)[:, None])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not self.splits:
            return np.array([len(x) for x in self.model.encode(texts.to_pylist(), num_threads=1)], np.int64)
        raw, off = bytes_of(texts)
        starts, ends, owner = words_of(raw, off, NOT_SPACE)
        rows = self.memory.rows(raw, starts, ends)
        out = np.bincount(owner, self.memory.joined(rows), len(texts)).astype(np.int64)
        # texts with spaces beside other spaces or at an end, or with the sign itself: their pre-tokens hold spaces
        space = np.flatnonzero(raw == 32)
        odd = space[np.isin(space, off[:-1]) | np.isin(space + 1, off[1:])]
        odd = np.concatenate([odd, space[:-1][np.diff(space) == 1], np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))])
        for i in np.unique(np.searchsorted(off, odd, side="right") - 1).tolist():
            parts = self.pretokens(texts[i].as_py())
            out[i] = sum(self.alone.get(p) or len(self.model.encode(p)) for p in parts)
        return out

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """Each pre-token without its first space, which the library puts before any text."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return [x[1:] for x in _RUN.findall(" " + text)]


def counter(path: str, proof: Proof) -> Counter:
    return resident(f"counts {path}", lambda: Counter(path, proof))


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row, of the whole text, one pass and no shuffle.

    A null or empty text has 0 bytes and 0 tokens; null and repeated keys keep their rows; other columns are not looked at.
    model_path must be readable on every executor. Texts are taken in slices of whole texts: a worker's memory follows the
    longest text.
    """
    proof = docs.sparkSession.sparkContext.broadcast(prove(model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_path, proof.value)
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(tokens(part.column(1)), pa.int64())], names=["_key", "n_bytes", "n_tokens"])

    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = dict(body.dtypes)["_key"]
    counted = body.mapInArrow(count, f"_key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
