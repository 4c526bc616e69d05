"""A bounded memory of words and the token ids that they encode to, for whole slices of texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from tessera.llm._common import word_hashes


class WordMemory:
    """Token ids of words by 64-bit hashes of their bytes (two remembered words with one hash: under 1e-7 in all).

    Beyond limit words or most ids it forgets words that came up once only, then all: some 60 MB at most, beside what one
    slice needs.
    """

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], list[np.ndarray]], limit: int = 300_000, most: int = 4_000_000):
        self.encode, self.limit, self.most = encode, limit, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.hits = np.zeros(1024, np.int32)
        self.start = np.zeros(1025, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.n = 0

    def rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
        """The memory's row of each word raw[start:end]; kinds (small integers) tell apart equal bytes that encode otherwise."""
        hashes = word_hashes(raw, starts, ends)
        if kinds is not None:
            hashes = hashes ^ (kinds.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        codes, distinct = pd.factorize(hashes)
        if self.n + len(distinct) > self.limit or self.start[self.n] > self.most:
            self._forget(len(distinct))
        keys = distinct.tolist()
        found = list(map(self.place.get, keys))
        at = np.array([-1 if x is None else x for x in found], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            whole, first = raw.tobytes(), first[new]
            words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            at[new] = self._add([keys[i] for i in new.tolist()], self.encode(words, kinds[first] if kinds is not None else first))
        self.hits[at] += 1
        return at[codes]

    def _add(self, keys: list[int], ids: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in ids], np.int64)
        rows = np.arange(self.n, self.n + len(ids))
        while len(self.hits) < self.n + len(ids):
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
            self.start = np.concatenate([self.start, np.zeros(len(self.start) - 1, np.int64)])
        end = self.start[self.n] + sizes.sum()
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if end > self.start[self.n]:
            self.ids[self.start[self.n] : end] = np.concatenate(ids)
        self.start[self.n + 1 : self.n + len(ids) + 1] = self.start[self.n] + np.cumsum(sizes)
        self.hits[rows] = 0
        self.n += len(ids)
        self.place.update(zip(keys, rows.tolist(), strict=True))
        return rows

    def _forget(self, wanted: int) -> None:
        often = self.hits[: self.n] > 1
        if often.sum() + wanted > self.limit * 0.7 or self.start[self.n] > self.most:
            return self._clear()
        old, keys = np.flatnonzero(often), np.empty(self.n, np.uint64)
        keys[np.fromiter(self.place.values(), np.int64, len(self.place))] = np.fromiter(self.place.keys(), np.uint64, len(self.place))
        kept = [self.ids[self.start[i] : self.start[i + 1]] for i in old.tolist()]
        names = keys[old].tolist()
        self._clear()
        self._add(names, kept)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.start[rows + 1] - self.start[rows]

    def joined(self, rows: np.ndarray) -> np.ndarray:
        """The ids of all words in rows, one after another."""
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.start[rows] - (ends - sizes), sizes)]
