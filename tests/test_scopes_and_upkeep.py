"""Scopes, best matches without all postings, page parts, index upkeep and answers, against plain programs."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers, layout, nested, replies, retrieval, scopes, structure, topk, upkeep


def test_scopes_hold_what_all_their_filters_fit(spark):
    rows = [(1, "a", ["x", "y"]), (2, "a", []), (3, "b", ["x"]), (4, None, None)]
    table = spark.createDataFrame(rows, "id int, corpus string, tags array<string>")
    wanted = {1: [("corpus", ["a"])], 2: [("corpus", ["a", "b"]), ("tags", ["x", "z"])], 3: [], 4: [("missing", ["a"])], 5: [("tags", [])]}
    asked = spark.createDataFrame([(k, v) for k, v in wanted.items()], f"scope int, filters {scopes.FILTERS}")
    got = defaultdict(set)
    for r in scopes.members(table, asked, "id", {"corpus": "corpus", "tags": "tags"}, ["tags"]).collect():
        got[r.scope].add(r.id)
    assert got == {1: {1, 2}, 2: {1, 3}, 3: {1, 2, 3, 4}, 5: {1, 2, 3, 4}}


def test_best_matches_are_those_of_all_pairs(spark):
    weighed = [(s, t, k, ((k * 7 + t * 13 + s) % 11) / 3 + 0.01, 0.1 * (k % 2)) for s in (0, 1) for t in range(8) for k in range(60) if (k * (t + 3)) % (9 - t) == 0]
    tokens = [(q, q % 2, t, 1 + (q + t) % 2) for q in range(6) for t in range(8) if (q + t) % 3]
    table = spark.createDataFrame(weighed, "scope int, token int, key int, w double, bonus double")
    asked = spark.createDataFrame(tokens, "query_id int, scope int, token int, times int")
    whole = defaultdict(float)
    for q, s, t, n in tokens:
        for s2, t2, k, w, b in weighed:
            if (s, t) == (s2, t2):
                whole[q, s, k] += w * n + b
    for limit in (1, 5, 500):
        got = {(r.query_id, r.scope, r.key): r.score for r in topk.best_matches(table, asked, "key", limit).collect()}
        assert all(abs(whole[k] - v) < 1e-9 for k, v in got.items())
        for q in range(6):
            best = sorted((k for k in whole if k[0] == q), key=lambda k: -whole[k])[:limit]
            assert set(best) <= set(got)


def test_an_index_sees_a_batch_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    table = lambda rows: spark.createDataFrame(rows, "chunk_id int, doc string")
    index = upkeep.Index(spark, f"file://{tmp_path}/index")
    read = lambda: sorted((r.chunk_id, r.doc) for r in index.read().collect())
    assert index.apply("first", table([(1, "a"), (2, "a"), (3, "b"), (4, None)]))
    with monkeypatch.context() as m:
        m.setattr(upkeep.Index, "_publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            index.apply("second", table([(5, "a")]), table([(0, "b")]))
    assert read() == sorted([(1, "a"), (2, "a"), (3, "b"), (4, None)], key=lambda x: x[0])
    assert index.apply("second", table([(5, "a")]), table([(0, "b")])) and not index.apply("second", table([(6, "a")]))
    assert read() == [(4, None), (5, "a")] or read() == [(5, "a"), (4, None)]
    index.compact("whole")
    assert index.batches() == ["whole"] and {r[0] for r in read()} == {4, 5}


def test_nested_values_come_in_their_order(spark):
    rows = [(1, json.dumps({"keywords": ["b", {"x": [1, None, ""]}], "other": {}})), (2, "no json"), (3, None)]
    flat = nested.flattened(spark.createDataFrame(rows, "id int, body string"), ["id"], "body")
    assert sorted((r.id, ".".join(r.path), r.value) for r in flat.collect()) == [(1, "keywords.0", "b"), (1, "keywords.1.x.0", "1")]
    assert [r.text for r in nested.value_text(flat, ["id"]).collect()] == ["keywords b keywords x 1"]


def test_payloads_and_summaries(spark):
    hits = spark.createDataFrame([(1, i, i, 0.01, "d", i % 2, "t", "s", 1, 2, "pump pressure valve", "atomic_text", None) for i in range(1, 5)], "query_id int, chunk_id int, rank int, score double, doc string, version_id int, title string, section string, page_from int, page_to int, content string, chunk_type string, context_window string")
    said = spark.createDataFrame([(1, json.dumps({"answer": "pump pressure", "confidence": 0.9, "warnings": "w", "citations": []})), (2, "no json")], "query_id int, payload string")
    plain = replies.regular(said, hits)
    assert {r.query_id: (r.confidence, r.warnings, r.cited) for r in plain.collect()} == {1: ("high", ["w"], []), 2: ("medium", [], [])}
    done = {r.query_id: r for r in replies.validated(plain, hits).collect()}
    assert done[1].warnings == ["w", replies.RECONSTRUCTED, replies.VERSIONS, replies.WEAK] and done[1].cited == ["1"] and done[1].insufficient
    assert done[2].answer == "" and not done[2].warnings
    parts = spark.createDataFrame([(1, i, i, "t", [i % 3], f"s{i}") for i in range(1, 15)], "query_id int, place int, chunk_id int, title string, pages array<int>, summary string")
    assert [(r.chunk_ids, r.summary) for r in replies.merged_summaries(parts).orderBy("place").collect()][0] == ([str(i) for i in range(1, 10)], " ".join(f"s{i}" for i in range(1, 10)))


def test_faults_of_verdicts_pages_and_versions(spark):
    hits = spark.createDataFrame([(1, 10, "v1"), (1, 11, "v2")], "query_id int, chunk_id int, version_id string")
    judged = spark.createDataFrame([(1, 10, "relevant", 2), (1, 10, "not_relevant", 1), (1, 11, "maybe", 3), (1, 99, "relevant", 4)], "query_id int, chunk_id int, verdict string, place int")
    assert [(r.missing, r.invalid) for r in answers.verdict_faults(hits, judged).collect()] == [([11], [99])]
    versions = spark.createDataFrame([("v1", 5), ("v3", 5)], "id string, source_document_id int")
    documents = spark.createDataFrame([(5, "T")], "id int, title string")
    assert [(r.id, r.title) for r in retrieval.versions_of(hits, versions, documents).collect()] == [("v1", "T")]
    pages = spark.createDataFrame([("d", 1, " a b \n \n\n c"), ("d", 2, None)], "doc string, page int, text string")
    assert [r.text for r in structure.paragraphs_of(pages).collect()] == ["a b", "c"]
    page = spark.range(1).select(layout.page_of(F.lit(2), F.lit(5), F.lit(8)).alias("a"), layout.page_of(F.lit(6), F.lit(5), F.lit(8)).alias("b")).first()
    assert (page.a, page.b) == (6, 6)
