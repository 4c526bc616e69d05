"""Searches that score alike chunks and equal questions once, against plain programs."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.operators import questions, retrieval, topk

TEXTS = ["red bolt", "red bolt bolt", "blue gear 5 V", "red gear", "Item: bolt; Output: 5 mA", "nothing of it"]
KINDS = ["atomic_text", "spec_record", "table_record"]
CHUNKS = [(i, KINDS[i % 3], "true" if i % 4 == 0 else "false", TEXTS[i % 6] + (f" PX-{i}" if i % 5 == 0 else "")) for i in range(240)]
ASKED = [(1, "red bolt"), (2, "gear 5 red"), (3, "bolt bolt PX-35"), (4, "unheard of")]
SCOPES = {"all": (None, None), "some": (["spec_record", "table_record"], None), "new": (["atomic_text"], "true")}


def _library(spark):
    rows = spark.createDataFrame(CHUNKS, "chunk_id long, chunk_type string, version_signal string, content string")
    none = F.array().cast("array<string>")
    lists = {c: none for c in ("product_models", "identifier_tokens", "menu_labels", "protocol_terms")}
    rows = rows.withColumns({"title": F.lit("Manual"), "section": F.lit("parts"), "priority": F.lit(0.0), **lists})
    scopes = spark.createDataFrame([(k, *v) for k, v in SCOPES.items()], "scope string, chunk_types array<string>, version_signal string")
    return rows, spark.createDataFrame([(q, s, t) for q, t in ASKED for s in SCOPES], "query_id long, scope string, query string"), scopes


def _best(scores, limit):
    return sorted(scores, key=lambda k: (-round(scores[k], 10), k))[:limit]


def _within(scope):
    kinds, version = SCOPES[scope]
    return [c for c in CHUNKS if (kinds is None or c[1] in kinds) and version in (None, c[2])]


def _words(text):
    return [w.strip(":;").lower() for w in text.split()]


def _found(hits):
    out = defaultdict(dict)
    for r in hits.collect():
        out[r.query_id, r.scope][r["rank"]] = r.chunk_id
    return {k: [v[n] for n in sorted(v)] for k, v in out.items()}


def test_hashed_hits_are_those_of_all_pairs(spark):
    got = _found(retrieval.hashed(*_library(spark), limit=7))
    for q, text in ASKED:
        asked = Counter(_words(text))
        for scope in SCOPES:
            scores = {}
            for i, _, _, content in _within(scope):
                own = Counter(_words(content))
                dot = sum(n * own[w] for w, n in asked.items())
                if dot:
                    scores[i] = dot / math.sqrt(sum(n * n for n in asked.values())) / math.sqrt(sum(n * n for n in own.values()))
            assert got.get((q, scope), []) == _best(scores, 7)


def test_lexical_hits_are_those_of_all_pairs(spark):
    got = _found(retrieval.lexical(*_library(spark), limit=7))
    for scope in SCOPES:
        texts = {i: (kind, ["manual", "manual", "parts", *_words(content) * 2, kind], set(_words(content))) for i, kind, _, content in _within(scope)}
        mean, df = sum(len(words) for _, words, _ in texts.values()) / len(texts), Counter(w for _, words, _ in texts.values() for w in set(words))
        for q, text in ASKED:
            scores = {}
            for i, (kind, words, held) in texts.items():
                score, met = 0.0, False
                for w, n in Counter(_words(text)).items():
                    if tf := words.count(w):
                        idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                        score, met = score + n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean)) + 0.035 * (w in held), True
                if met or kind in retrieval.STRUCTURED:
                    scores[i] = score + 0.03 * (kind in retrieval.STRUCTURED)
            assert got.get((q, scope), []) == _best(scores, 7)


def test_alike_rows_are_told_by_the_first_of_them(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3, [k % 2]) for k in range(1, 25)], "key long, kind int, says array<int>")
    got = sorted((r.alike, r.key) for r in topk.alike(rows, "key", ["kind", "says"], 2).collect())
    assert got == sorted((a, b) for a in range(1, 7) for b in (a, a + 6))


def test_equal_questions_are_asked_once(spark):
    asked = spark.createDataFrame([(5, "a"), (3, "a"), (9, None), (7, None), (4, "b")], "query_id int, query string")
    different, same = questions.asked_once(asked, ["query"])
    assert sorted((r.query_id, r.query or "") for r in different.collect()) == [(3, "a"), (4, "b"), (7, "")]
    hits = spark.createDataFrame([(3, 1), (7, 2)], "query_id int, chunk_id int")
    assert sorted(map(tuple, questions.for_all(hits, same).collect())) == [(3, 1), (5, 1), (7, 2), (9, 2)]


def test_best_rows_by_rare_and_common_words_are_those_of_all_pairs(spark):
    own = lambda k: 0.03 * (k % 3 == 0)
    # word t > 5 is row t's own; the others are held by many alike rows
    weighed = [(s, t, k, 1.0 + (k * 7 + t * 13 + s) % 4 / 4, 0.1 * (k % 2), own(k)) for s in (0, 1) for k in range(120) for t in [*range(6), 100 + k] if t > 5 or (k + t) % (t + 2) == 0]
    tokens = [(q, q % 2, t, 1 + q % 2) for q in range(40) for t in [(q // 2) % 3, 3 + (q // 2) % 2, 100 + q]]
    table = spark.createDataFrame(weighed, "scope int, token int, key int, w double, bonus double, own double")
    asked = spark.createDataFrame(tokens, "query_id int, scope int, token int, times int")
    whole, by_word = defaultdict(float), defaultdict(list)
    for s, t, k, w, b, _ in weighed:
        by_word[s, t].append((k, w, b))
    for q, s, t, n in tokens:
        for k, w, b in by_word[s, t]:
            whole[q, s, k] += w * n + b
    for limit, few in ((1, 5), (5, 5), (5, 0), (500, 5), (5, 1000)):
        got = {(r.query_id, r.scope, r.key): r.score for r in topk.best_of_split(table, asked, "key", limit, 0.03, few).collect()}
        for q in range(40):
            scores = {k[2]: v + own(k[2]) for k, v in whole.items() if k[0] == q}
            mine = {k[2]: v for k, v in got.items() if k[0] == q}
            best = _best(scores, limit)
            assert _best(mine, limit) == best and all(abs(scores[k] - mine[k]) < 1e-9 for k in best)


def _shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_equal_filters_meet_rows_once(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", ["x"] if i % 5 else []) for i in range(400)], "id int, kind string, tags array<string>")
    sets = [[("kind", ["a"])], [("kind", ["a", "b", "a"]), ("tags", ["x", "y"])], [("kind", [])], [("missing", ["a"])]]
    wanted = spark.createDataFrame([(q, k, v) for q in range(400) for k, v in sets[q % 4]], "query_id int, key string, values array<string>")
    before = _shuffled(spark)
    got = {(r.query_id, r.id) for r in questions.matches(rows, wanted, "id", ["tags"]).collect()}
    assert got == {(q, i) for q in range(400) for i in range(400) if (q % 4 == 0 and i % 2) or (q % 4 == 1 and i % 5)}
    assert _shuffled(spark) - before < 40_000 < len(got)


def test_words_that_nobody_asks_for_leave_before_they_are_counted(spark):
    rows = spark.createDataFrame([(i, [f"w{i}_{k}" for k in range(500)] + ["asked"] * (i % 2)) for i in range(60)] + [(99, [])], "id int, tokens array<string>")
    asked = spark.createDataFrame([(1, "asked")], "query_id int, query string")
    before = _shuffled(spark)
    assert {r.id for r in retrieval.bm25(rows, asked, "id").collect()} == set(range(1, 60, 2))
    assert _shuffled(spark) - before < 10_000
    chunks, _, _ = _library(spark)
    found = retrieval.postings(chunks, spark.createDataFrame([("bolt",)], "token string")).collect()
    assert {r.token for r in found} == {"bolt"} and {r.length for r in found if r.chunk_id == 6} == {8}
