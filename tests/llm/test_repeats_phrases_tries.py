"""Repeated passages, collocations and conversation tries against plain programs, and what was mended beside them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ann, collocations, licenses, repeats, shards, trie

DOCS = "doc_id long, text string, lang string, spans int, n int, code string, chunk long"
TALK = "conv_id long, turn long, role string, text string, d long, c int"


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def kept_of(rows, window):
    """(n_words, n_removed, kept words) of rows in the order of doc_id (null last), then the hash of their texts; seen windows are removed."""
    seen, out = set(), []
    for doc, text in rows:
        words = (text or "").encode().split()
        hit = [False] * len(words)
        for s in range(len(words) - window + 1):
            name = tuple(words[s : s + window])
            if name in seen:
                hit[s : s + window] = [True] * window
            seen.add(name)
        out.append((doc, len(words), sum(hit), hashlib.sha256(b" ".join(w for w, h in zip(words, hit, strict=True) if not h)).hexdigest()))
    return out


def passages():
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 400, n))
    shared, other = prose(40), prose(25)
    near = shared.split()
    near[20] = "changed"
    return [None, "", " \t\n", "one two", shared, shared, prose(30) + " " + shared + " " + prose(9), "x " * 90, other + "\n" + other, " ".join(near) + "  " + other, shared.replace(" ", "\x0b "), "ü é " * 30, prose(60), "Unlike " + shared[3:], "x " * 90]


@pytest.mark.parametrize(("window", "held"), [(20, 1_000_000), (20, 5), (7, 40), (1, 30)])
def test_repeated_passages(spark, monkeypatch, window, held):
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "PER_TASK", 50)
    monkeypatch.setattr(repeats, "PER_SHARD", 20)
    rows = [(i * 3, t) for i, t in enumerate(passages())] + [(None, passages()[4]), (12, passages()[4])]
    table = spark.createDataFrame([(a, b, "en", 1, 2, "c", 3) for a, b in rows], DOCS)
    found = repeats.repeated_passages(table, window=window).collect()
    want = kept_of(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), window)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == Counter(want)
    for r in found:
        assert r.n_removed == sum(s.stop - s.start for s in r.spans)


def test_repeated_passages_of_no_documents(spark):
    assert repeats.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.n_removed for r in repeats.repeated_passages(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [0]


def test_automata_find_every_occurrence():
    import pyarrow as pa

    s = repeats.Slice(pa.array(["a b c d e f", None, "b c d", "x a b c d e"]), 4)
    wanted = np.unique(s.codes[[1]])
    assert np.flatnonzero(repeats.occurrences(repeats.automaton(wanted, s.phrase), s)).tolist() == np.flatnonzero(s.codes == wanted[0]).tolist()


def phrases_of(rows, least, longest, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in many.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= percent * many[p[i : i + k]]}
        best = []
        for p, a in many.items():
            if p not in inside:
                s, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 4, 2000), (2, 3, 7), (5, 2, 2000)])
def test_collocations(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 60)
    monkeypatch.setattr(collocations, "BUCKET_PAIRS", 40)
    rng = np.random.default_rng(4)
    words = "the of pump valve Press heat ÄÖ flow's \xa0unit".split(" ")
    rows = [(["en", "de", None, "und"][i % 4], "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", " ", "\t", ". ", "\n", " , "])) for _ in range(int(rng.integers(0, 60))))) for i in range(60)]
    rows += [("en", None), ("en", ""), ("fr", " .,; "), ("en", "a a a a a a a a. A a"), ("en", "a a a a a a a a. A a")]
    table = spark.createDataFrame([(1, t, lang, 1, 2, "c", 3) for lang, t in rows], DOCS)
    found = collocations.collocations(table, least=least, longest=longest, top=top).collect()
    assert sorted(tuple(r) for r in found) == phrases_of(rows, least, longest, 80, top)


def test_collocations_of_no_documents(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en", 1, 2, "c", 3)], DOCS)).count() == 0


def nodes_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        whole[c] = [t[1:] for t in sorted(own.get(base, []))[:h]] + [t[1:] for t in sorted(turns)[h:]]
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children.update(p[:-1] for p in members if p)
    for p, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p)))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize("shard_rows", [100_000, 60, 3, 0])
def test_tries(spark, shard_rows):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(t) if t else None, str(rng.choice(["user", "bot"])), f"t {rng.integers(0, 2)}") for c in rng.integers(-30, 60, 40) for t in range(int(rng.integers(0, 6)))]
    rows += [(7, None if i % 9 == 0 else i % 50, "u", f"t {i % 3}") for i in range(150)] + [(c, i, "u", "x y") for c in (40, 41, 9000) for i in range(30)]
    rows += [(None, 1, "a", "b"), (3, 1, None, None), (3, 1, None, None), (3, 1, "", "")]
    table = spark.createDataFrame([(*r, 5, 6) for r in rows], TALK).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a conversation stands in several ranges
    try:
        found = Counter(tuple(r) for r in trie.prefix_trie(table, shard_rows).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert found == nodes_of(rows)


def test_tries_of_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 2)], TALK)).count() == 0


def test_louds_bits_tell_parents_back():
    level = np.array([1, 1, 2, 2, 2, 3])
    names = np.arange(1, 7, dtype=np.int64)
    parents = np.array([0, 0, 1, 1, 2, 5])
    found = trie.Louds(level, np.stack([names, names]), np.stack([parents, parents]))
    assert found.bits.sum() == 6 and len(found.bits) == 13
    place = {int(x): k + 1 for k, x in enumerate(found.labels)} | {0: 0}
    assert [int(x) for x in found.parent()] == [place[int(parents[x - 1])] for x in found.labels]
    assert found.rolled_up(np.ones(7, np.int64))[0] == 7
    assert spark_free_counts(found) == [2, 2, 1, 0, 0, 1, 0]


def spark_free_counts(found):
    """Degrees of nodes read from the bits alone."""
    return [len(x) for x in "".join(map(str, found.bits)).split("0")[:-1]]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_null_key_moves_no_other_key(spark, kind):
    keys = [(2**60 + i if kind == "long" else f"k{i}", "x") for i in range(500)]
    place = lambda rows: {r.doc_id: r.shard for r in shards.shard(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect() if r.doc_id is not None}
    assert place(keys) == place([(None, "x"), *keys])


@pytest.mark.parametrize("scale", [1e60, 1e-60, 1e200])
def test_neighbours_of_very_large_and_small_vectors(spark, scale):
    x = np.random.default_rng(0).normal(size=(400, 8))
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x * scale)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(table).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, rows in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [v for _, v, _ in sorted(rows)] == np.argsort(d)[:10].tolist()
        assert np.allclose([s / scale for *_, s in sorted(rows)], np.sort(d)[:10])


def test_licenses_with_text_put_in_and_edits_within_the_coverage(spark):
    mit = re.findall("[a-z0-9]+", licenses.TEMPLATES["MIT/text"].lower())
    rng = np.random.default_rng(0)
    cases = {0: mit[:80] + [f"z{i}" for i in range(81)] + mit[80:], 1: mit[:50] + ["q"] * 300 + mit[50:110] + ["r"] * 500 + mit[110:]}
    for k in range(10):
        edited = list(mit)
        for i in rng.choice(len(mit), licenses.budget(len(mit), 0.8), replace=False):
            edited[i] = f"e{i}"
        cases[10 + k] = ["a"] * k + edited + ["b"] * k
    line = licenses.TEMPLATES["MIT/line"].split()
    for i in range(len(line)):
        cases[30 + i] = [*line[:i], "other", *line[i + 1 :]]
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in cases.items()], "doc_id long, text string")
    found = {(r.doc_id, r.name): r.coverage for r in licenses.scan(table, licenses.default_templates(spark)).collect()}
    assert found[(0, "MIT/text")] == 1 and found[(1, "MIT/text")] == 1
    assert all(found.get((k, "MIT/text"), 0) >= 0.8 for k in range(10, 20))
    assert all((30 + i, "MIT/line") in found for i in range(len(line)))


def test_fingerprints_hold_against_the_edits_that_a_coverage_leaves():
    for m in range(1, 200):
        size, span = licenses.print_of(m, 3, 2, 0.8)
        lost = licenses.budget(m, 0.8)
        assert -(-(m - lost) // (lost + 1)) >= size + span - 1 and size >= 1 and span >= 1


def test_unpacked_pairs_are_the_packed_ones():
    left = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 50))
    right, times = np.arange(50) + (1 << 33), np.ones(50, np.int64)
    got = collocations._unsqueezed(collocations._squeezed(left, right, times), 50)
    assert all((a == b).all() for a, b in zip(got, (left, right, times), strict=True))
