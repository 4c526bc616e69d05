"""Checks of parses and chunks, duplicates planned and taken out, CSV there and back, coerced metadata."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import dedupe, health, metadata, records
from tessera.sources import exports


def test_findings_name_what_is_wrong(spark):
    nodes = [("good", 1, "paragraph", "The pump runs at 5 V here.", 7), ("good", 2, "paragraph", "The valve opens at once when told.", 7), ("one", 1, "paragraph", "All of it on one page.", 6), ("far", 9, "paragraph", "Too far out.", 3)]
    nodes += [("cut", p, "paragraph", f"w {p}", 2) for p in (1, 2)] + [("full", p, "note", f"Note number {p} about the valve", 6) for p in (1, 2)]
    chunks = [(d, p, "atomic_text", "The pump runs at 5 V here, always.") for d, p, *_ in nodes] + [("full", 1, "atomic_text", f"The pump number {i} runs at 5 V.") for i in range(151)]
    chunks += [("little", 1, "spec_record", "page 3 of 9"), ("little", 2, "atomic_text", "The pump runs at 5 V."), ("little", 2, "atomic_text", "The pump runs at 6 V here.")]
    docs = spark.createDataFrame([(d, 1 if d == "far" else 2) for d in ("good", "one", "far", "cut", "full", "little", "none")] + [("null", None)], "doc string, page_count long")
    measured = health.measures(docs, spark.createDataFrame(nodes, "doc string, page long, kind string, text string, n_tokens long"), spark.createDataFrame(chunks, "doc string, page_from long, chunk_type string, content string"))
    rows = {r.doc: r for r in measured.collect()}
    assert (rows["full"].chunk_pages, rows["full"].mean_chunks, rows["full"].most_chunks) == (2, 76.5, 152) and rows["none"].n_chunks == 0 and rows["none"].first_node_page is None
    assert (rows["little"].low_ratio, rows["little"].structured_low_ratio, rows["cut"].short_ratio) == (0.3333, 1.0, 1.0)
    failed = {(r.doc, r.check_name): r.error for r in health.findings(measured).collect() if r.status == "fail"}
    assert failed == {
        ("one", "page_provenance"): "nodes stand on a single page", ("one", "fragmentation"): "chunks stand on a single page", ("far", "page_provenance"): "nodes stand outside the pages of the source", ("cut", "fragmentation"): "too many short texts",
        ("full", "fragmentation"): "too many chunks a page", ("little", "page_provenance"): "nodes stand on a single page", ("little", "chunk_quality"): "too many structured chunks say little",
        ("none", "page_provenance"): "nodes stand on a single page", ("none", "fragmentation"): "chunks stand on a single page",
    }


def test_each_key_of_a_canonical_document_decides(spark):
    at = datetime.datetime
    base = ("x", "pending", 1, 1, at(2020, 1, 1))
    better = [("own", *base[1:]), ("x", "indexed", *base[2:]), ("x", "pending", 2, *base[3:]), (*base[:3], 2, base[4]), (*base[:4], at(2021, 1, 1)), base]
    rows = []
    for k, b in enumerate(better):
        # the better one has the smaller id but in the last group, where only ids differ
        pair = [base, b] if b is base else [b, base]
        rows += [(2 * k + i, f"g{k}", *r) for i, r in enumerate(pair)]
    rows += [(100, None, *base), (101, None, *base), (102, "alone", *base), (103, "g0", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, digest string, corpus string, status string, chunk_count long, version_count long, updated_at timestamp")
    plan = dedupe.plan(docs, "own")
    assert {r.digest: r.canonical_id for r in plan.collect()} == {"g0": 0, "g1": 2, "g2": 4, "g3": 6, "g4": 8, "g5": 11}
    left = dedupe.applied(docs, plan)
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 4, 6, 8, 11, 100, 101, 102] and dedupe.applied(left, plan).count() == 9


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ['a "b", c', "x\ny\r\nz\rw", " spaced ", "", None, "é\U0001f600", '"', "\\", 'a\\"b', ",", "\t", "null", "#x"]
    rows = spark.createDataFrame([(i, t, f"k{i % 2}") for i, t in enumerate(texts)], "i long, t string, k string")
    for name, by in (("plain", None), ("parted", ["k"])):
        exports.to_csv(rows, f"{tmp_path}/{name}", by, most=2)
        assert [(r.i, r.t, r.k) for r in exports.from_csv(spark, f"{tmp_path}/{name}", rows.schema).sort("i").collect()] == [tuple(r) for r in rows.collect()]


def test_values_of_any_shape_become_lists_and_dates(spark):
    cases = {'"a"': ["a"], '"  "': [], '["x", " ", " y ", 3, true, null, {"k": 1}]': ["x", " y ", "3", "True", "None", '{"k":1}'], "{}": [], "5": [], "null": [], "[]": [], "no json": [], None: []}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r[0]: r[1] for r in rows.select("v", metadata.coerced_list(F.col("v"))).collect()} == cases
    dates = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("",), (None,), ("May",)], "v string").select(metadata.coerced_date(F.col("v"))).collect()
    assert [r[0] for r in dates] == [datetime.date(2024, 2, 29), None, None, None, None]


def test_one_row_or_none(spark):
    rows = spark.createDataFrame([(1, "a")], "i int, t string")
    assert records.one(rows) == {"i": 1, "t": "a"} and records.one(rows.where("i = 2")) is None
