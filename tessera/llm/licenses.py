"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment of the candidates."""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import LOWER_ASCII, bit_filter, bytes_of, mix64, passes, resident, text_slices, word_hashes, words_of, written
from tessera.llm.decontam import _WORD

#: Public notices and texts of common licenses, by name.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT/line": "Released under the MIT License.",
    "MIT/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "name string, text string")


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, its text, offsets of the texts' words, first code point and code point after the last, in its text)."""
    raw, off = bytes_of(texts)
    low = LOWER_ASCII[raw]
    starts, ends, owner = words_of(low, off, _WORD)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = points[off[owner]]
    return word_hashes(low, starts, ends).view(np.int64), owner, np.searchsorted(owner, np.arange(len(texts) + 1)), points[starts] - base, points[ends] - base


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].view(np.uint64)
    return mix64(total).view(np.int64)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every window consecutive grams, the last one of ties; all places, if there are fewer grams."""
    if len(grams) <= window:
        return np.arange(len(grams))
    seen = sliding_window_view(grams[::-1], window)
    return np.unique(len(grams) - 1 - (np.arange(len(seen)) + seen.argmin(1)))


def align(template: np.ndarray, words: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """(matched words, first and last matched word) of the best alignment of the whole template with a stretch of words.

    A match counts 2, a word changed, left out or put in -1; words before and after are free. Template word i stands at
    words[i + low] to words[i + low + width - 1], so time and memory grow with len(template) * width.
    """
    m, n = len(template), len(words)
    never, band = -(1 << 24), np.arange(width)
    at = low + band
    score = np.empty((m + 1, width), np.int32)
    score[0] = np.where((at >= 0) & (at <= n), 0, never)
    for i in range(1, m + 1):
        at = at + 1
        step = np.where(words[np.clip(at - 1, 0, n - 1)] == template[i - 1], 2, -1)
        best = np.where(at >= 1, score[i - 1] + step, never)
        best[:-1] = np.maximum(best[:-1], score[i - 1, 1:] - 1)
        out = (at < 0) | (at > n)
        best[out] = never
        best = np.maximum.accumulate(best + band) - band
        best[out] = never
        best[at == 0] = -i  # the text begins inside the template
        score[i] = best
    # the text may also end inside the template
    ends = [(int(score[m].max()), m, int(score[m].argmax()))]
    ends += [(int(score[i, n - low - i]) - (m - i), i, n - low - i) for i in range(max(0, n - low - width + 1), min(m, n - low + 1))]
    value, i, b = max(ends)
    if value <= never // 2:  # the band does not meet the text
        return 0, -1, -1
    matched, first, last = 0, -1, -1
    while i > 0 and i + low + b > 0:
        p = i + low + b
        same = words[p - 1] == template[i - 1]
        if score[i, b] == score[i - 1, b] + (2 if same else -1):
            if same:
                matched, first = matched + 1, p - 1
                last = max(last, p - 1)
            i -= 1
        elif b + 1 < width and score[i, b] == score[i - 1, b + 1] - 1:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return matched, first, last


def segment(template: np.ndarray, words: np.ndarray, low: int, width: int) -> tuple[int, int, int, int, int]:
    """(matched words, first and last template word, first and last word) of the best stretch of both inside a band as in align."""
    m, n = len(template), len(words)
    band = np.arange(width)
    at = low + band
    score = np.zeros((m + 1, width), np.int32)
    for i in range(1, m + 1):
        at = at + 1
        step = np.where(words[np.clip(at - 1, 0, n - 1)] == template[i - 1], 2, -1)
        best = score[i - 1] + step
        best[:-1] = np.maximum(best[:-1], score[i - 1, 1:] - 1)
        best = np.maximum(np.maximum.accumulate(best + band) - band, 0)
        best[(at < 1) | (at > n)] = 0
        score[i] = best
    i, b = (int(x) for x in np.unravel_index(score.argmax(), score.shape))
    matched, top, last, first, begin = 0, i - 1, i + low + b - 1, 0, 0
    while score[i, b] > 0:
        p = i + low + b
        same = words[p - 1] == template[i - 1]
        if score[i, b] == score[i - 1, b] + (2 if same else -1):
            if same:
                matched, first, begin = matched + 1, i - 1, p - 1
            i -= 1
        elif b + 1 < width and score[i, b] == score[i - 1, b + 1] - 1:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return matched, first, top, begin, last


#: How far a segment may drift: what puts more words in, or leaves more out, begins another one.
NARROW = 3


def segments(template: np.ndarray, words: np.ndarray, low: int, width: int, least: int, begin: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """The best segment of a band, then those of the template before and after it, as long as least words match."""
    if len(template) < least:
        return
    found = segment(template, words, low + begin, width)
    if found[0] < least:
        return
    matched, first, top, a, b = found
    yield matched, first + begin, top + begin, a, b
    yield from segments(template[:first], words, low, width, least, begin)
    yield from segments(template[top + 1 :], words, low, width, least, begin + top + 1)


#: Template words that two segments of one chain may both have claimed; they count once.
OVERLAP = 8


def chained(segments: list[tuple[int, int, int, int, int]], m: int) -> tuple[int, list[int]]:
    """(matched words, numbers of segments) of the best chain of segments in the order of both template and text.

    Whatever stands between two segments is left out. Segments come in the order of their first word.
    """
    best: list[tuple[int, int]] = [(0, -1)] * (m + OVERLAP + 2)  # by template word: the best chain that ends before it
    back, total, held = [-1] * len(segments), [0] * len(segments), []
    waiting: list[tuple[int, int]] = []
    for k, (matched, first, _, begin, _) in enumerate(segments):
        # chains become open to segments that begin after them in the text
        while waiting and waiting[0][0] < begin:
            _, j = heapq.heappop(waiting)
            x = segments[j][2] + 1
            while x < len(best) and best[x][0] < total[j]:
                best[x] = (total[j], j)
                x += 1
        gain, back[k] = max((best[min(first + o, len(best) - 1)][0] - o, best[min(first + o, len(best) - 1)][1]) for o in range(OVERLAP + 1))
        total[k] = matched + max(gain, 0)
        back[k] = back[k] if gain > 0 else -1
        heapq.heappush(waiting, (segments[k][4], k))
        held.append(total[k])
    k = max(range(len(segments)), key=held.__getitem__)
    value, chain = total[k], []
    while k >= 0:
        chain.append(k)
        k = back[k]
    return value, chain[::-1]


def budget(m: int, coverage: float) -> int:
    """Places of a template of m words that may be edited: words lost beyond it leave less than the coverage."""
    return m - math.ceil(coverage * m - 1e-9)


def _matches(template: np.ndarray, words: np.ndarray, shifts: list[int], coverage: float, size: int) -> Iterator[tuple[int, int, int]]:
    """Places of the template in the words: around shifts (places where it would begin), and across what was put in between."""
    m, shifts = len(template), sorted(shifts)
    # every edited place breaks size runs of size words at most
    if len(words) >= size and m - size + 1 - size * budget(m, coverage) > np.isin(_grams(template, size), _grams(words, size)).sum():
        return
    drift = max(1, m // 5)
    k, missed = 0, []
    while k < len(shifts):
        low, at = shifts[k], k
        while k < len(shifts) and shifts[k] <= low + drift:
            if shifts[k] >= 0 and np.array_equal(words[shifts[k] : shifts[k] + m], template):
                yield m, shifts[k], shifts[k] + m - 1
            k += 1
        found = align(template, words, low - drift, 3 * drift + 1)
        if found[0] > 0 and found[0] >= coverage * m:
            yield found
        else:
            missed += shifts[at:k]
    rest, k = set(), 0
    while len(missed) > 1 and k < len(missed):
        low = missed[k]
        while k < len(missed) and missed[k] <= low + NARROW:
            k += 1
        rest |= set(segments(template, words, low - NARROW, 3 * NARROW + 1, min(size, 2)))
    rest = sorted(rest, key=lambda x: x[3:])
    while len(rest) > 1:
        value, chain = chained(rest, m)
        if value < coverage * m:
            return
        yield value, rest[chain[0]][3], rest[chain[-1]][4]
        rest = [x for k, x in enumerate(rest) if k not in set(chain)]


def print_of(m: int, gram: int, window: int, coverage: float) -> tuple[int, int]:
    """(size, window) of the fingerprints of a template of m words.

    With as many places edited as its coverage allows, some run of its words stays whole that is as long as size + window - 1.
    """
    lost = budget(m, coverage)
    run = -(-(m - lost) // (lost + 1))
    size = min(gram, run)
    return size, min(window, run - size + 1)


def index(templates: DataFrame, gram: int, window: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(templates: id, name, words, size of its grams; inverted index of their winnowed fingerprints: term, id, place, size)."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, _, off, _, _ = _words(part.column(1))
                out = {"name": [], "words": [], "size": [], "prints": []}
                for i, name in enumerate(part.column(0).to_pylist()):
                    own = words[off[i] : off[i + 1]]
                    size, span = print_of(len(own), gram, window, coverage) if len(own) else (0, 1)
                    grams = _grams(own, size) if size else own
                    out["name"].append(name)
                    out["words"].append(own.tolist())
                    out["size"].append(size)
                    out["prints"].append([{"term": int(grams[p]), "place": p, "size": size} for p in winnow(grams, span).tolist()])
                prints = pa.list_(pa.struct({"term": pa.int64(), "place": pa.int32(), "size": pa.int32()}))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema({"name": pa.string(), "words": pa.list_(pa.int64()), "size": pa.int32(), "prints": prints}))

    body = templates.select(F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    made = body.mapInArrow(fingerprint, "name string, words array<long>, size int, prints array<struct<term:long,place:int,size:int>>")
    made = written(made.where(F.size("words") > 0).withColumn("id", F.xxhash64("name", "words")), "templates")
    return made.select("id", "name", "words", "size"), made.select("id", F.inline("prints"))


def scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", gram: int = 3, window: int = 2, coverage: float = 0.8) -> DataFrame:
    """(key, name, n_matched, n_template, coverage, start, end): where texts hold a template (name, text).

    Words are runs of ASCII letters, in either case, digits and characters beyond ASCII. A place must match at least the
    given share of the template's words; start and end (exclusive) are code points of the first and last matched word. Of
    overlapping matches in a text the one with the larger coverage stays, then with more words, then by name and place.

    Fingerprints are runs of up to gram words, winnowed as far as each template's length allows: a text that differs from
    the template in no more places than the coverage leaves (words changed or left out, or any number of words put in at
    one place) keeps a fingerprint. Runs of words around fingerprints are aligned in bands, and the stretches that bands find
    are chained over what was put in between, however long. A text with more edited places may be found or not.

    Texts and templates that are null or without words match nothing; a null name reads as the empty string;
    equal templates count once; repeated rows and rows with a null key each have their matches; empty tables give no rows.
    Other columns are not looked at.
    """
    kept, prints = index(templates, gram, window, coverage)
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # at most gram of them
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(prints.select("term").distinct(), "term"))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_a", F.xxhash64("_key", "text")).withColumn("_b", F.xxhash64("text", F.lit(1), "_key"))
    kind = dict(rows.dtypes)["_key"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            for part in text_slices(batch):
                words, owner, _, _, _ = _words(part.column(1))
                first = np.searchsorted(owner, np.arange(part.num_rows))
                terms, places = [], []
                for size in sizes:
                    grams = _grams(words, size)
                    at = np.flatnonzero(passes(bits.value, grams))
                    at = at[owner[at] == owner[at + size - 1]]
                    terms.append(grams[at])
                    places.append(at)
                if not places or not sum(map(len, places)):
                    continue
                term, at = np.concatenate(terms), np.concatenate(places)
                order = np.argsort(at, kind="stable")
                term, at = term[order], at[order]
                texts, counts = np.unique(owner[at], return_counts=True)
                hits = pa.StructArray.from_arrays([pa.array(term), pa.array((at - first[owner[at]]).astype(np.int32))], names=["term", "pos"])
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                chosen = part.take(pa.array(texts))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.ListArray.from_arrays(ends, hits)], names=["_key", "text", "_a", "_b", "hits"])

    probed = written(rows.mapInArrow(probe, f"_key {kind}, text string, _a long, _b long, hits array<struct<term:long,pos:int>>"), "probed")
    # Spark sends the index or the templates to all tasks only while their files are small
    anchors = probed.select("_a", "_b", F.inline("hits")).join(prints, "term").select("_a", "_b", "id", (F.col("pos") - F.col("place")).alias("shift"))
    places = anchors.groupBy("_a", "_b", "id").agg(F.collect_set("shift").alias("shifts")).join(kept, "id")
    candidates = places.groupBy("_a", "_b").agg(F.collect_list(F.struct("name", "words", "size", "shifts")).alias("found"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            for part in text_slices(batch):
                words, _, off, begins, ends = _words(part.column(1))
                out, owners = {x: [] for x in ("name", "n_matched", "n_template", "start", "end")}, []
                for i, found in enumerate(part.column(2).to_pylist()):
                    own, spans = words[off[i] : off[i + 1]], []
                    for x in found:
                        template = np.array(x["words"], np.int64)
                        spans += [(-n / len(template), -n, x["name"], a, b, len(template)) for n, a, b in _matches(template, own, x["shifts"], coverage, x["size"])]
                    taken: list[tuple[int, int]] = []
                    for _, n, name, a, b, size in sorted(set(spans)):
                        k = bisect.bisect(taken, (a, b))
                        if (k and taken[k - 1][1] >= a) or (k < len(taken) and taken[k][0] <= b):
                            continue
                        taken.insert(k, (a, b))
                        owners.append(i)
                        for column, value in zip(out.values(), (name, -n, size, int(begins[off[i] + a]), int(ends[off[i] + b])), strict=True):
                            column.append(value)
                longs = [pa.array(out[x], pa.int64()) for x in ("n_matched", "n_template", "start", "end")]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners, pa.int64())), pa.array(out["name"], pa.string()), *longs], names=["_key", "name", "n_matched", "n_template", "start", "end"])

    texts = probed.select("_key", "text", "_a", "_b").join(candidates, ["_a", "_b"]).select("_key", "text", "found")
    found = texts.mapInArrow(verify, f"_key {kind}, name string, n_matched long, n_template long, start long, end long")
    return found.select(F.col("_key").alias(key), "name", "n_matched", "n_template", (F.col("n_matched") / F.col("n_template")).alias("coverage"), "start", "end")
