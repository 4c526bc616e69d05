import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions import text as T
from tessera.operators import answers, chunks, evaluation, questions, records, retrieval, search, structure, writes
from tessera.streaming.runs import consume, ingest, windowed


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int")


def test_fusion_adds_up_every_list_and_keeps_the_best_score(spark):
    one, two = hits(spark, [(1, 10, 0.5, 1), (1, 11, 0.4, 2)]), hits(spark, [(1, 10, 0.9, 1), (1, 12, 0.3, 2)])
    got = [(r.chunk_id, r["rank"], r.best, r.n_lists) for r in retrieval.fused([one, two]).orderBy("rank").collect()]
    assert got == [(10, 1, 0.9, 2), (11, 2, 0.4, 1), (12, 3, 0.3, 1)]


def test_bm25_leaves_out_documents_without_a_query_word(spark):
    docs = spark.createDataFrame([(1, "pump pressure valve"), (2, "nothing of the kind"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "Pump pressure")], "item_id long, text string")
    assert [r.doc_id for r in search.bm25(docs, asked).collect()] == [1]


KINDS = {
    "SAFETY NOTES": "section", "1.2 Getting started": "section", "AB": "paragraph", "Warning: hot": "warning", "DANGER!": "section", "danger of fire": "warning", "caution wet": "caution", "Note this": "note", "3) turn it": "procedure_step",
    "a | b\nc | d": "table", "x  1\ny  2": "table", "Voltage: 24 V": "spec", "phone: 12": "paragraph", "see/also: x": "paragraph", "A sentence of prose here.": "paragraph", "Cable  12 mm": "spec", "photo: a.png": "paragraph",
}


def test_kinds_of_blocks(spark):
    rows = [(1, i, 1, t) for i, t in enumerate(KINDS)] + [(1, 99, 1, None), (1, 98, 1, " "), (1, 97, 1, "<!-- x -->"), (1, 96, 1, "img/a.PNG")]
    found = {r.ordinal: r for r in structure.nodes(spark.createDataFrame(rows, "doc long, ordinal long, page long, text string")).collect()}
    assert {list(KINDS)[i]: r.kind for i, r in found.items()} == KINDS
    assert tuple(found[11].spec) == ("Voltage", "24", "V") and found[9].rows == [["a", "b"], ["c", "d"]] and found[8].step == 3 and found[8].section == "DANGER!"


def test_text_functions(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(T.tokens, "A-1/b.c d_e, F") == ["a-1/b.c", "d_e", "f"]
    assert one(T.normalized, " a\u00a0 b\t\n\n\n\nc ") == "a b \n\nc"
    assert one(T.search_text, "x-1  a") == "x-1 a\n\nSearch terms: x-1 | x1 | x 1" and one(T.search_text, " ") == ""
    assert one(T.keywords, "SR-100 at 24 V, error E12, [Menu]") == sorted({"SR-100", "sr-100", "SR100", "sr 100", "24 V", "24 v", "E12", "e12", "[Menu]"})
    assert one(lambda c: T.clipped(c, 10), "aaaaaaa bbbb cc") == "aaaaaaa bb" and one(lambda c: T.clipped(c, 10), "aaaaaaaa bbbb") == "aaaaaaaa"
    assert one(lambda c: T.first_seen(F.split(c, ",")), " a,A,b,,B ,c") == ["a", "b", "c"]
    assert one(T.series_of, "PX-A120B") == "PX-A1" and one(T.without_thoughts, "<think>no\n</think> yes") == "yes"
    assert one(T.title_of, "a_b.v2.pdf") == "a b.v2" and one(T.has_value, "it is 5kg") and not one(T.has_value, "five")
    assert one(lambda c: T.completeness(c), "Pump") < 0 < one(lambda c: T.completeness(c), "The pump runs at 24 V in this mode.") and one(lambda c: T.completeness(c), None) == one(lambda c: T.completeness(c), "")


def test_names(spark):
    import uuid

    row = spark.createDataFrame([("a", 7, "s3://b/k/x.PDF")], "a string, b int, u string")
    got = row.select(N.deterministic_uuid(F.col("a"), F.col("b")).alias("id"), N.bucket(F.col("u")).alias("bucket"), N.key(F.col("u")).alias("key"), N.object_name(F.lit("t"), F.lit("sha"), F.col("u")).alias("name"), N.display_name(F.lit("a_b-c")).alias("shown")).first()
    assert got.id == str(uuid.uuid5(uuid.UUID(N.NAMESPACE), "a::7"))
    assert (got.bucket, got.key, got.name, got.shown) == ("b", "k/x.PDF", "t/sha256/sha.pdf", "A B C")
    with pytest.raises(Exception, match="no such address"):
        row.select(N.checked(F.col("a"))).collect()


def nodes(spark, rng, n):
    kinds = ["paragraph", "note", "spec", "section"]
    rows = []
    for i in range(n):
        kind = kinds[int(rng.choice(4, p=[0.6, 0.2, 0.15, 0.05]))]
        size = int(rng.choice([2, 5, 9, 14, 15, 40, 230], p=[0.2, 0.2, 0.2, 0.15, 0.1, 0.1, 0.05]))
        rows.append((i % 2, i, i // 9, kind, " ".join(f"w{i}" for _ in range(size)), None, size, [f"k{i}"], 0.9))
    schema = "doc long, ordinal long, page long, kind string, text string, section string, n_tokens int, keywords array<string>, citability double"
    extra = {"heading": "string", "level": "string", "step": "int", "spec": "struct<name:string>", "rows": "array<array<string>>"}
    return rows, spark.createDataFrame(rows, schema).withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})


def test_consolidation_is_that_of_a_left_fold(spark):
    rows, table = nodes(spark, np.random.default_rng(5), 300)
    want = []
    for doc in (0, 1):
        held = None
        for r in (r for r in rows if r[0] == doc):
            new = [r[0], r[1], r[2], r[3], r[4], r[6], list(r[7])]
            fits = held and held[3] in ("paragraph", "note") and r[3] in ("paragraph", "note") and held[2] == r[2] and held[5] <= 14 and r[6] <= 14 and held[5] + r[6] <= 48
            if fits:
                text = f"{held[4]} {r[4]}"
                held = [*held[:4], text, len(text.split()), sorted({*held[6], *r[7]})]
            else:
                want += [held] * (held is not None)
                held = new
        want.append(held)
    got = chunks.consolidated(table).select("doc", "ordinal", "page", "kind", "text", "n_tokens", "keywords").collect()
    assert sorted(map(list, got)) == sorted(want) and len(want) < len(rows)


def test_windows_are_those_of_the_greedy_walk(spark):
    rows, table = nodes(spark, np.random.default_rng(6), 200)
    want = []
    for doc in (0, 1):
        own, start, part = [r for r in rows if r[0] == doc], 0, 0
        while start < len(own):
            end, total = start, 0
            while end < len(own) and (end == start or total + own[end][6] <= 220):
                total, end = total + own[end][6], end + 1
            part += 1
            want.append((doc, part, end - start, "\n\n".join([str(doc), *(r[4] for r in own[start:end])])))
            if end >= len(own):
                break
            start = max(start + 2, end - 1)
    got = [(r.doc, r.part, r.n_nodes, r.content) for r in chunks.windows(table).collect()]
    assert sorted(got) == sorted(want)


def test_cells_name_the_headers_that_they_stand_under(spark):
    cells = [(1, 1, 0, 0, 1, 2, "Size", True, False), (1, 1, 0, 2, 1, 1, "Unit", True, False), (1, 1, 1, 0, 2, 1, "Box", False, True), (1, 1, 1, 1, 1, 1, "12", False, False), (1, 1, 2, 2, 1, 1, "mm", False, False), (1, 1, 3, 0, 1, 1, "Lid", False, False), (1, 1, 3, 1, 1, 1, "3 kg", False, False), (1, 1, 3, 2, 1, 1, " ", False, False)]
    table = spark.createDataFrame(cells, "doc long, ordinal long, row int, column int, row_span int, col_span int, text string, column_header boolean, row_header boolean")
    got = {(r.row, r.column): r.content for r in chunks.cell_chunks(table, spark.createDataFrame([(1, 1, 1, "Group")], "doc long, ordinal long, row int, label string")).collect()}
    assert got[(1, 1)] == "Column headers: Size; Row headers: Group > Box; Cell value: 12; Row: 1; Column: 1"
    assert got[(2, 2)] == "Column headers: Unit; Row headers: Box; Cell value: mm; Row: 2; Column: 2"
    assert got[(3, 1)] == "Column headers: Size; Row headers: Lid; Cell value: 3 kg; Row: 3; Column: 1" and (3, 2) not in got


def test_grid_and_pages(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, "a"), (1, 0, 0, 2, " b "), (1, 0, 2, 1, "c"), (1, 1, 1, 1, "d")], "t int, row int, column int, seq int, text string")
    assert sorted((r.row, r.cells) for r in structure.dense_grid(cells, ["t"]).collect()) == [(0, ["b", "", "c"]), (1, ["", "d", ""])]
    pages = spark.createDataFrame([(1, 1, "The pump is on. More text."), (1, 2, "The valve-is open; keep it so, and close it later"), (1, 3, "The pump is on.")], "doc int, page int, text string")
    blocks = spark.createDataFrame([(1, 1, "more  TEXT"), (1, 2, "the pump is on."), (1, 3, "The valve is open, keep it so and"), (1, 4, "")], "doc int, ordinal int, text string")
    assert {r.ordinal: r.page for r in structure.matched_pages(blocks, pages, ["doc"]).collect()} == {1: 1, 3: 2}


def test_question_types_and_filters(spark):
    rows = [(1, "How to configure the SR-100 timing"), (2, None), (3, "keyence AX-1000 datasheet E12"), (4, "OP-12345 part number"), (5, "AB series manual")]
    found = questions.analysed(spark.createDataFrame(rows, "query_id int, query string"))
    got = {r.query_id: r for r in found.collect()}
    assert got[1].query_types == ["configuration", "how_to", "operational_flow"] and got[1].product_model == "SR-100" and got[2].query_types == ["general"]
    assert (got[3].strictness, got[3].document_kind, got[3].error_code, got[4].part_number, got[5].product_family) == ("strict", "datasheet", "E12", "OP-12345", "AB")
    given = found.withColumn("given", F.create_map(F.lit("source_document_id"), F.array(F.lit("d1"))))
    assert {(r.key, *r["values"]) for r in questions.filters(given, "given").where("query_id = 3").collect()} == {("source_document_id", "d1"), ("is_active", "true")}
    docs = spark.createDataFrame([(1, "A", ["A1"]), (2, "B", ["A"]), (3, None, None)], "id int, product_model string, product_models array<string>")
    wanted = spark.createDataFrame([(1, "product_model", ["A"]), (2, "product_models", ["A1", "A"]), (3, "missing", ["A"]), (4, "product_model", [])], "query_id int, key string, values array<string>")
    got = questions.matches(docs, wanted, "id", ["product_models"], {"product_model": "product_models"})
    assert {(r.query_id, r.id) for r in got.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_a_model_takes_the_place_of_verdicts_by_terms(spark):
    rows = [(1, "pump pressure", 10, "atomic_text", "pump pressure valve", 1), (1, "pump pressure", 11, "atomic_text", "pump", 2), (1, "pump pressure", 12, "table_record", "nothing", 3)]
    table = spark.createDataFrame(rows, "query_id int, query string, chunk_id int, chunk_type string, content string, rank int").withColumns({"context_window": F.lit(None).cast("string"), "identifier_tokens": F.array().cast("array<string>")})
    said = spark.createDataFrame([(1, 10, " Not_Relevant"), (1, 11, "maybe"), (1, 99, "relevant"), (1, None, "relevant")], "query_id int, chunk_id int, verdict string")
    merged = answers.merged_verdicts(answers.relevance(table), said)
    assert {r.chunk_id: (r.verdict, r.source) for r in merged.collect()} == {10: ("not_relevant", "model"), 11: ("relevant", "terms"), 12: ("not_relevant", "terms")}
    assert [r.chunk_id for r in answers.prioritised(merged).collect()] == [11]


def test_reranking_and_deduplication(spark):
    rows = [(1, 5, 0.5, 1, "v1"), (1, 5, 0.7, 2, "v2"), (1, 6, 0.6, 3, "v1")]
    table = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int, version_id string")
    count = lambda latest: sorted((r.chunk_id, r.score) for r in retrieval.deduplicated(table.withColumn("latest_only", F.lit(latest))).collect())
    assert count(False) == [(5, 0.7), (6, 0.6)] and count(True) == [(5, 0.5), (5, 0.7), (6, 0.6)]


def test_states_after_writing(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", '{"x": "1", "y": "2"}'), (2, "b", None)], "k int, v string, j string")
    new = spark.createDataFrame([(2, "c", '{"y": "3"}'), (3, "d", None)], "k int, v string, j string")
    plain = lambda df: sorted(map(tuple, df.select("k", "v").collect()))
    assert plain(writes.upserted(old, new, ["k"], {"v": F.col("new_v")})) == [(1, "a"), (2, "c"), (3, "d")] and plain(writes.upserted(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    once = writes.replaced(old, new, ["k"])
    assert plain(once) == plain(writes.replaced(once, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert spark.range(1).select(writes.merged_json(F.lit('{"x": "1", "y": "2"}'), F.lit('{"y": "3"}'))).first()[0] == '{"x":"1","y":"3"}'
    for _ in range(2):
        place = writes.stored(once, str(tmp_path), 1)
    assert spark.read.parquet(place).count() == 3


def test_cases_are_shuffled_by_their_seed_alone(spark):
    cases = spark.range(20).withColumnRenamed("id", "case_id")
    order = lambda df, seed: [r.case_id for r in evaluation.shuffled(df, "case_id", seed).orderBy("place").collect()]
    assert order(cases, 1) == order(cases.repartition(7), 1) != order(cases, 2)


def test_overlaps_and_groups(spark):
    spans = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 5, 9), ("a", 3, 10, 12), ("b", 4, 0, 1)], "k string, i int, s int, e int")
    assert {r.k: r.pairs for r in records.overlapping(spans, "k", "s", "e").collect()} == {"a": 1, "b": 0}
    turns = spark.createDataFrame([(1, t, f"t{t}") for t in range(5)], "c int, turn int, text string")
    assert [(r.part, r.n) for r in records.grouped(turns, ["c"], "turn", "text", 2).orderBy("part").collect()] == [(0, 2), (1, 2), (2, 1)]


def test_stream_appends_each_event_once(spark, tmp_path):
    events = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    events.where("id < 150").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", "ts timestamp, event_type string, value double")
    events.where("id >= 150").write.mode("append").parquet(f"{tmp_path}/in")
    ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", "ts timestamp, event_type string, value double")
    got = {r.start: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.start: r.n for r in windowed(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_dense_search_keeps_the_smallest_of_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8))
    x[rng.permutation(700)[:300]] = x[0]
    x[rng.permutation(700)[:100]] = x[1] + rng.normal(size=(100, 8)) * 1e-5
    ids = rng.permutation(700)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    odd = [(5000, None), (5100, [1.0] * 3), (5200, [0.0] * 8), (5300, [None] * 8)]
    table = spark.createDataFrame(odd + rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = table.where("vec_id % 100 = 0")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in search.dense(table, asked).collect()}
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    for q in range(0, 700, 100):
        score = unit @ unit[ids == q][0]
        order = [k for k in np.lexsort((ids, -np.round(score, 6))) if ids[k] != q][:40]
        assert [got[(q, r)] for r in range(1, 41)] == [(ids[k], round(float(score[k]), 9)) for k in order]
    assert len(got) == 7 * 40


def test_rounding_to_six_places_is_that_of_spark(spark):
    score = np.array([0.1234565, 0.1234575, -0.1234565, 0.0000005, -0.0000004, 1.0000000000000002, 0.9999995, 0.12345649999999999, *np.random.default_rng(1).uniform(-1, 1, 500), *(np.arange(500) / 1e6 + 5e-7)])
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate(score)], "i int, s double").select("i", F.round("s", 6).alias("s")).orderBy("i").collect()
    assert [round(r.s * 1e6) for r in rows] == search._millionths(score).tolist()


def test_jobs_are_worked_on_once_and_failures_stand_alone(spark, tmp_path):
    put = lambda n, rows: spark.createDataFrame(rows, "job_id string, payload string").write.json(f"{tmp_path}/queue/{n}")
    work = lambda batch: batch.withColumn("error", F.when(F.col("payload") == "bad", "no such document"))
    run = lambda: consume(spark, f"{tmp_path}/queue", f"{tmp_path}/statuses", f"{tmp_path}/next", f"{tmp_path}/state", work)
    put(1, [("a", "x"), ("b", "bad"), ("a", "x"), (None, "y")])
    run()
    run()
    put(2, [("c", "z")])
    run()
    assert sorted((r.job_id, r.status, r.error) for r in spark.read.parquet(f"{tmp_path}/statuses").collect()) == [("a", "done", None), ("b", "failed", "no such document"), ("c", "done", None)]
    assert sorted(r.job_id for r in spark.read.json(f"{tmp_path}/next").collect()) == ["a", "c"]


def test_answers_and_selections_are_scored(spark):
    said = spark.createDataFrame([(1, "Set it to 24 V", ["24 v", "set"], True, 2), (2, "", ["x"], False, 0), (3, "no idea", ["24 v"], True, 1)], "case_id int, answer string, terms array<string>, retrieved boolean, citations int")
    got = {r.case_id: (r.passed, r.failures) for r in evaluation.answers_scored(said).collect()}
    assert got == {1: (True, []), 2: (False, ["empty_answer", "missing_terms", "no_citations", "retrieval_miss"]), 3: (False, ["missing_terms"])}
    chosen = spark.createDataFrame([(1, "d1", 1), (1, "d2", 2), (2, "d9", 1)], "case_id int, doc string, rank int")
    cases = spark.createDataFrame([(1, "d2"), (2, "d1"), (3, "d1")], "case_id int, doc string")
    got = {r.case_id: (r.attempted, r.passed, r["rank"], r.failure) for r in evaluation.selections_scored(cases, chosen).collect()}
    assert got == {1: (True, True, 2, None), 2: (True, False, 0, "metadata_document_miss"), 3: (False, False, 0, "metadata_selection_not_recorded")}
    assert evaluation.end_to_end(evaluation.answers_scored(said)).first().asDict() == {"total": 3, "passes": 1, "pass_rate": 33.33, "answered_rate": 66.67, "retrieved_rate": 66.67}
