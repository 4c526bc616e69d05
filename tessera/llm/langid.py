"""Language identification as a mixture of languages, inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tessera.llm._common import LOWER_ASCII, bytes_of, resident, text_slices, word_hashes, words_of

#: Slots that n-grams of all lengths are hashed into; a model is so many numbers a language, whatever it learned from.
SLOTS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: Languages that a model may hold; more is an error, not a cut.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Text bytes looked at together: n-gram arrays are some fifty times as large.
SLICE = 250_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


class Model(NamedTuple):
    languages: list[str]
    #: log probability of every slot, a row for each language
    logs: np.ndarray


def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of all n-grams, the word each belongs to, the text each word belongs to).

    A word is a run of letters (ASCII in lower case, or bytes of other characters); its n-grams are those of its bytes
    with a blank on either side.
    """
    low = LOWER_ASCII[raw]
    # a blank before every text, so that none runs into the next
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    spaced = np.full(len(low) + len(off), 32, np.uint8)
    owner = np.zeros(len(spaced), np.int64)
    to = np.arange(len(low)) + text + 1
    letter = _LETTER[low]
    spaced[to] = np.where(letter, low, 32)
    owner[to] = text
    inside = spaced != 32
    first = inside & ~np.concatenate([[False], inside[:-1]])
    word = np.cumsum(first) - 1
    slots, words = [], []
    code = np.zeros(len(spaced), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        # grams of n bytes that start at a blank before a word or in it, with no blank but at the ends
        code = code[: len(spaced) - n + 1] * np.uint64(257) + spaced[n - 1 :].astype(np.uint64) + np.uint64(1)
        if n not in GRAMS:
            continue
        size = len(code)
        ok = inside[:size].copy() if n == 1 else np.ones(size, bool)
        for k in range(1, n - 1):
            ok &= inside[k : k + size]
        if n == 2:
            ok = inside[:size] | inside[1 : 1 + size]
        at = np.flatnonzero(ok)
        mixed = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        slots.append((mixed >> np.uint64(64 - 15)).astype(np.int32))
        words.append(word[at + (1 if n > 1 else 0)] if n != 2 else np.where(inside[at], word[at], word[at + 1]))
    return np.concatenate(slots), np.concatenate(words), owner[np.flatnonzero(first)]


def _distinct(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(slots of the n-grams of the distinct words, the distinct word of each, the distinct word and the text of every word, how many distinct words).

    Words repeat, so their n-grams are taken once a slice. Words are told apart by 64-bit hashes.
    """
    low = LOWER_ASCII[raw]
    starts, ends, owner = words_of(low, off, _LETTER)
    codes, hashes = pd.factorize(word_hashes(low, starts, ends))
    first = np.empty(len(hashes), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    sizes = (ends - starts)[first]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.arange(bounds[-1]) + np.repeat(starts[first] - bounds[:-1], sizes)
    slots, words, _ = _features(low[at], bounds)
    return slots, words, codes, owner, len(hashes)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """n-gram counts of all labelled texts, as smoothed log probabilities. Rows with a null language or text are passed over."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                slots, words, codes, owner, n = _distinct(*bytes_of(part.column(1)))
                names, code = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
                of = code[owner]
                for k, name in enumerate(names.tolist()):
                    times = np.bincount(codes[of == k], minlength=n)
                    total[name] = total.get(name, 0) + np.bincount(slots, times[words], SLOTS).astype(np.int64)
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "slot", "n"])

    summed = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("counts"))
    found = sorted(summed.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(found), SLOTS))
    for row, r in zip(counts, found, strict=True):
        row[[x["slot"] for x in r["counts"]]] = [x["n"] for x in r["counts"]]
    return Model([r["lang"] for r in found], np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SLOTS)).astype(np.float32))


def mixtures(model: Model, raw: np.ndarray, off: np.ndarray, rounds: int = 8, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(for each text its languages' proportions, which are 0 outside the chosen set; whether it has words).

    A text is a bag of words, each drawn from one language with that language's proportion. Expectation-maximisation over all
    languages ranks them; then sets of the first ones are fitted, each with one language more, and the set with the largest
    log likelihood less penalty * (languages - 1) * log(words) is chosen, the smaller one in a tie. A text's sets grow up to
    all languages, or until no proportions of any languages could be likely enough to make up for the penalty.
    """
    slots, words, codes, owner, distinct = _distinct(raw, off)
    n, langs, count = len(off) - 1, len(model.languages), len(owner)
    out = np.zeros((n, langs))
    counts = np.bincount(owner, minlength=n)
    if not langs or not count:
        return out, counts > 0
    logs = np.stack([np.bincount(words, row[slots], distinct) for row in model.logs], axis=1)
    grams = np.maximum(np.bincount(words, minlength=distinct), 1)
    logs /= np.sqrt(grams)[:, None]  # a word's n-grams overlap: they say less than so many independent ones
    # a row for each language, so that sums over languages add whole rows; likelihoods are relative to each word's best language
    odds = np.ascontiguousarray(np.exp(logs - logs.max(axis=1)[:, None]).T)[:, codes]
    filled = np.flatnonzero(counts)
    sizes = counts[filled]
    cost = penalty * np.log(sizes + 1.0)

    def fit(odds: np.ndarray, share: np.ndarray, sizes: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(proportions, a column for each text, after so many rounds; log likelihood of each text; that of each word's mixture)."""
        starts = np.cumsum(sizes) - sizes
        for k in range(times + 1):
            joint = odds * np.repeat(share, sizes, axis=1)
            total = np.maximum(joint.sum(axis=0), 1e-300)
            if k < times:
                joint /= total
                share = np.add.reduceat(joint, starts, axis=1) / sizes
        return share, np.add.reduceat(np.log(total), starts), total

    whole, score, total = fit(odds, np.full((langs, len(filled)), 1 / langs), sizes, rounds)
    # the log likelihood is concave: its slopes bound what any proportions can reach
    slopes = np.add.reduceat(odds / total, np.cumsum(sizes) - sizes, axis=1) / sizes
    bound = score + sizes * np.log(np.maximum(slopes.max(axis=0), 1.0))
    order = np.argsort(-whole, axis=0, kind="stable")
    best = np.full(len(filled), -np.inf)
    open_ = np.arange(len(filled))
    for k in range(1, langs + 1):
        mask = np.zeros(len(filled), bool)
        mask[open_] = True
        named = order[:k, open_]
        share = np.maximum(np.take_along_axis(whole[:, open_], named, 0), 1e-6)
        share /= share.sum(axis=0)
        part = odds[np.repeat(named, sizes[open_], axis=1), np.flatnonzero(np.repeat(mask, sizes))]
        share, score, _ = fit(part, share, sizes[open_], 0 if k == 1 else 3)
        score -= (k - 1) * cost[open_]
        better = score > best[open_]
        at = open_[better]
        best[at] = score[better]
        out[filled[at]] = 0
        out[filled[at][None], named[:, better]] = share[:, better]
        open_ = open_[best[open_] < (bound - k * cost)[open_]]
        if not len(open_):
            break
    return out, counts > 0


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (all, if not given) with lang_pred, score (its proportion, 0 to 1) and lang_mix (proportions).

    One pass in Arrow batches, no shuffle. A null text, a text without a letter, and any text under a model without languages is `und` with score 0. Ties go to the
    language that sorts first. Repeated rows stay. Columns named as the new ones are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "lang_mix")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # names of our own, so that no column of the table is in the way
    body = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = StructType(body.schema.fields[:-1]).add("lang_pred", "string").add("score", "double").add("lang_mix", ArrayType(DoubleType()))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        own = shared.value
        many, names = len(own.languages), pa.array([*own.languages, UNKNOWN], pa.string())
        for batch in batches:
            for part in text_slices(batch, limit=max(100_000, SLICE * 8 // max(8, many))):
                texts = part.column(part.num_columns - 1)
                shares, has = mixtures(own, *bytes_of(texts))
                told = has & bool(many)
                told[told] = [any(map(str.isalpha, t)) for t in texts.filter(pa.array(told)).to_pylist()]
                best = shares.argmax(axis=1) if many else np.zeros(len(told), np.int64)
                score = np.where(told, np.minimum(shares.max(axis=1, initial=0.0), 1.0), 0.0)
                mix = pa.ListArray.from_arrays(pa.array(np.arange(len(told) + 1, dtype=np.int32) * many), pa.array(np.where(told[:, None], shares, 0.0).ravel()))
                found = [names.take(pa.array(np.where(told, best, many))), pa.array(score), mix]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=schema.names)

    out = body.mapInArrow(infer, schema)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(kept)), "lang_pred", "score", "lang_mix")


def held_out(key: Column) -> Column:
    """Rows that a model must not learn from: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))

