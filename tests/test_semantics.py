"""Cases of single operators with data of our own."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import hashing, text
from attestra.operators import catalog, evidence, intervals, layout, retrieval, tree, verify
from attestra.sources import batches
from attestra.streaming import events


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("said", "numbers"), [
    ("width 3,14 m", ["3.14"]), ("12 345,5 rubles", ["12345.5"]), ("1 234 567 and 12 34", ["1234567", "12", "34"]), ("1.234 or 1,234", ["1.234", "1,234"]), ("+5 and -5", ["5", "-5"]),
    ("1’000’000.25", ["1000000.25"]), ("no digits", []), ("10–20 mm", ["10", "20"]), ("07 07", ["07"]), ("2.50kg", ["2.50"]),
])
def test_numeric_literals(spark, said, numbers):
    assert one(spark, text.numeric_literals, said) == numbers


def test_subjects(spark):
    rows = [("Длина", "Длина трубы", True), ("Длина", "Длинами", False), ("", "x", False), ("a b", "a b", False), ("x y z", "x y", True)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(text.word_prefix(F.col("a"), F.col("b")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)
    assert one(spark, text.subject, " [Ёлка\t и  ель]. ") == "елка и ель"
    assert [one(spark, text.textual_subject, v) for v in ("до 5", "5 mm", "Труба", "***")] == [False, False, True, False]


def test_uuid5_and_canonical_json(spark):
    import uuid

    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for name in ("a", "имя", "x" * 500, ""):
        assert one(spark, lambda c: hashing.uuid5(space, c), name) == str(uuid.uuid5(uuid.UUID(space), name))
    got = spark.range(1).select(hashing.canonical_json(("b", F.lit(1)), ("a", F.lit("é"))).alias("j")).first().j
    assert got == '{"a":"é","b":1}'


def test_interval_invariants(spark):
    rng = random.Random(3)
    rows = [(k, s, s + rng.randint(1, 30), 200) for k in range(8) for s in (rng.randint(0, 160) for _ in range(9))]
    df = spark.createDataFrame(rows, "k int, start long, end long, n long")
    covered = {k: {p for kk, s, e, _ in rows if kk == k for p in range(s, e)} for k in range(8)}
    merged = intervals.merge_intervals(df, ["k"])
    assert {k: {p for r in merged.collect() if r.k == k for p in range(r.start, r.end)} for k in range(8)} == covered
    assert sorted(map(tuple, intervals.merge_intervals(merged, ["k"]).collect())) == sorted(map(tuple, merged.collect()))
    left = intervals.complement(df, ["k"], "n").collect()
    assert {k: {p for r in left if r.k == k for p in range(r.start, r.end)} for k in range(8)} == {k: set(range(200)) - covered[k] for k in range(8)}
    counts = {r.k: r for r in intervals.coverage(df, ["k"], "n").collect()}
    for k in range(8):
        depth = [sum(s <= p < e for kk, s, e, _ in rows if kk == k) for p in range(200)]
        assert (counts[k].unowned, counts[k].owned_once, counts[k].owned_twice) == (depth.count(0), depth.count(1), sum(d > 1 for d in depth))
    b = df.select("k", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    pairs = intervals.overlap_join(df.select("k", "start", "end"), b, ["k"], 16).collect()
    want = sorted((k, s, e, s2, e2) for k, s, e, _ in rows for k2, s2, e2, _ in rows if k == k2 and s < e2 and s2 < e)
    assert sorted(map(tuple, pairs)) == want


def test_rrf_missing_channel_repeat_and_ties(spark):
    rows = [(1, "dense", 10, 1), (1, "dense", 10, 4), (1, "lexical", 11, 1), (1, "lexical", 10, 2), (1, "dense", 12, 1)]
    got = [(r.chunk_id, r["rank"]) for r in retrieval.rrf_fuse(spark.createDataFrame(rows, "query_id int, channel string, chunk_id long, rank int")).orderBy("rank").collect()]
    assert got == [(10, 1), (11, 2), (12, 3)]


def test_policy_order(spark):
    verdicts = spark.createDataFrame([(1, "supported", "none", "SUPPORTED"), (2, "unsupported", "x", "UNSUPPORTED"), (3, "partially_supported", "missing_condition", "MISSING_CONDITION"), (4, "partially_supported", "other", "OTHER")], "pack_id int, verdict string, issue_type string, reason_code string")
    critics = spark.createDataFrame([(p, "yes", 0, 0) for p in range(1, 5)] + [(5, "no", 0, 0)], "pack_id int, question_match string, missing_parts int, global_issues int")
    rows = verify.critic_policy(verdicts, critics)
    assert {r.pack_id: r.action for r in rows.collect()} == {1: "render", 2: "refuse", 3: "repair", 4: "refuse", 5: "refuse"}
    done = {r.pack_id: (r.status, r.action, r.reason) for r in verify.decide(rows.withColumns({"repairs": F.lit(1), "variants": F.lit(0)})).collect()}
    assert done[3] == ("partially_confirmed", "refuse", "REPAIR_EXHAUSTED") and done[1] == ("confirmed", "render", "SUPPORTED")


def test_headings_and_parents(spark):
    lines = ["Раздел I Общее", "Глава 1 Начало", "1. Первое", "1.1. Второе", "3.7) Чужое", "а) буква", "Примечание. Важно", "Приложение № 2", "2. Снова", "2. Повтор", "просто текст"]
    df = tree.classify_headings(spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(lines)], "doc_id long, line long, text string"))
    assert [(r.kind, r.number) for r in df.orderBy("line").collect()] == [
        ("section", "I"), ("chapter", "1"), ("clause", "1"), ("subclause", "1.1"), ("subclause", "3.7"), ("letter", "а"), ("footnote", None), ("appendix", "2"), ("clause", "2"), ("clause", "2"), ("paragraph", None),
    ]
    got = {r.line: (r.parent, r.warning) for r in tree.assign_parents(df).collect()}
    assert got[2] == (1, None) and got[3] == (2, None) and got[4] == (3, None) and got[5] == (2, "UNRESOLVED_NUMBER_PARENT") and got[6] == (5, None)
    assert got[8] == (0, None) and got[9] == (8, None) and got[10] == (8, "REPEATED_NUMBER_IN_SCOPE") and got[11] == (10, None)


def test_chunks_concatenate_and_keep_the_budget(spark):
    rng = random.Random(1)
    texts = [(k, "".join(rng.choice(["word ", "long", ". ", "\n\n", "é", "á"]) for _ in range(rng.randint(0, 300)))) for k in range(20)] + [(90, None), (91, "")]
    got = tree.chunk_body(spark.createDataFrame(texts, "node_id long, text string"), 12).collect()
    for k, t in texts:
        parts = sorted((r.ordinal, r.text) for r in got if r.node_id == k)
        assert "".join(p for _, p in parts) == (t or "") and all(len(p.split()) <= 12 for _, p in parts)
        assert not any(p.startswith("́") for _, p in parts)


def test_two_columns_read_left_first(spark):
    rows = [(1, 1, f"l{k}", 50.0, 100.0 + 20 * k, 280.0, 110.0 + 20 * k, k) for k in range(4)] + [(1, 1, f"r{k}", 320.0, 100.0 + 20 * k, 560.0, 110.0 + 20 * k, 10 + k) for k in range(4)] + [(1, 1, "wide", 50.0, 300.0, 560.0, 310.0, 20), (1, 1, "after", 50.0, 330.0, 280.0, 340.0, 21)]
    df = spark.createDataFrame(rows, "doc_id int, page int, block_id string, x0 double, y0 double, x1 double, y1 double, line int")
    assert [r.block_id for r in layout.reading_order(df).orderBy("position").collect()] == ["l0", "l1", "l2", "l3", "r0", "r1", "r2", "r3", "wide", "after"]


def test_greedy_batches_and_packs(spark):
    rows = [(1, k, t, 10) for k, t in enumerate([5, 5, 5, 99, 1, 1, 1, 1])]
    got = [r.batch for r in batches.greedy_batches(spark.createDataFrame(rows, "g long, k long, tokens long, bytes long"), "g", "k", 3, 10, 1000).orderBy("k").collect()]
    assert got == [0, 0, 1, None, 1, 1, 2, 2]
    cand = spark.createDataFrame([(1, 1, 2, 60), (1, 2, 2, 60), (1, 3, 1, 40)], "query_id long, rank int, units int, tokens int")
    assert [r.taken for r in evidence.pack_evidence(cand, 3, 100).orderBy("rank").collect()] == [True, False, True]


def test_index_batches_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "batch_id long, k long, v string")
    write = lambda d: {r.batch_id: r.outcome for r in batches.write_index_batches(d, f"{tmp_path}/ledger", f"{tmp_path}/out", "k", "v").collect()}
    assert write(df) == {1: "written", 2: "written"}
    assert write(df) == {1: "replay", 2: "replay"}
    assert write(df.where("batch_id = 1").withColumn("v", F.lit("z"))) == {1: "conflict"}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_outcomes_of_batches_stay_off_the_driver(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "batch_id long, k int, v string")
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("a row for each batch came to the driver"))
    got = batches.write_index_batches(df, f"{tmp_path}/ledger", f"{tmp_path}/out", "k", "v")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "written"), (2, 1, "written")]


def test_originals_and_artifacts(spark, tmp_path):
    import hashlib
    import json

    files = {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"%PDF-1.7 y", "c.pdf": b"plain"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    reg = [(n, len(d), hashlib.sha256(d).hexdigest() if n != "b.pdf" else "0") for n, d in files.items()] + [("d.pdf", 1, "")]
    got = batches.scan_originals(spark, f"{tmp_path}/*.pdf", spark.createDataFrame(reg, "key string, size long, sha256 string")).collect()
    assert {r.key: r.verdict for r in got} == {"a.pdf": "ok", "b.pdf": "sha256", "c.pdf": "not_pdf", "d.pdf": "missing"}
    (tmp_path / "art").mkdir()
    digest = hashlib.sha256(b'[{"block_id":"b","pdf_page":1,"text":"t","bbox":[0.0,0.0,1.0,1.0]}]').hexdigest()
    (tmp_path / "art/z.json").write_text(json.dumps({"doc_id": "e", "pages": [], "blocks": [], "nodes": []}))  # without a digest
    (tmp_path / "art/x.json").write_text(json.dumps({"doc_id": "d", "digest": digest, "pages": [{"pdf_page": 1, "width": 600, "height": 800}], "blocks": [{"block_id": "b", "pdf_page": 1, "text": "t", "bbox": [0, 0, 1, 1]}], "nodes": []}))
    (tmp_path / "art/y.json").write_text("not json")
    parts = batches.scan_artifacts(spark, f"{tmp_path}/art/*.json")
    assert parts["blocks"].count() == 1 and parts["pages"].first().width == 600 and parts["rejected"].count() == 2


def test_commands_replay_and_leases(spark):
    rows = [(1, "p", "k", "h", 1), (2, "p", "k", "h", 2), (3, "p", "k", "x", 3), (4, "q", "k", "x", 4)]
    got = catalog.idempotent_commands(spark.createDataFrame(rows, "request_id int, principal string, key string, hash string, at int")).collect()
    assert {r.request_id: r.outcome for r in got} == {1: "accepted", 2: "replay", 3: "conflict", 4: "accepted"}


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for a in range(6):
        kinds = ["created", "started", "progress", "progress", rng.choice(["completed", "failed"]), "progress"]
        rows += [(a * 100 + k, a, k + 1, kind, 1_700_000_000 + a * 60 + k) for k, kind in enumerate(kinds)]
    schema = "event_id long, aggregate_id long, sequence long, kind string, at long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).withColumns({"event_type": F.col("kind"), "value": F.col("sequence").cast("double")})
    src = f"{tmp_path}/log"
    for k in range(6):
        df.where(f"sequence = {k + 1}").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: events.event_log_source(spark, src, df.schema, 2)
    state = events.run_available(events.job_state(stream()), "states", f"{tmp_path}/c1", "update")
    last = state.groupBy("aggregate_id").agg(F.max_by(F.struct("status", "applied", "rejected"), "sequence").alias("s")).collect()
    want = {r.aggregate_id: (r.status, r.applied, r.rejected) for r in events.job_state(df).collect()}
    assert {r.aggregate_id: tuple(r.s) for r in last} == want
    twice = events.run_available(events.dedupe_events(stream().unionByName(stream())).select("event_id"), "once", f"{tmp_path}/c2")
    assert sorted(r.event_id for r in twice.collect()) == sorted(r[0] for r in rows)
    metrics = events.run_available(events.stage_metrics(stream(), "1 minute"), "metrics", f"{tmp_path}/c3", "complete").collect()
    assert sorted(map(tuple, metrics)) == sorted(map(tuple, events.stage_metrics(df, "1 minute").collect()))


def test_grids_open_at_first_edges_and_snap(spark):
    edges = spark.createDataFrame([("t", x) for x in (0.0, 0.4, 0.8, 1.2, 5.0)], "k string, x double")
    assert [r.bounds for r in layout.grid_edges(edges, "k", "x").collect()] == [[0.0, 0.8, 5.0]]
    boxes = [(1, 1, 0.0, 0.0, 10.0, 5.0), (1, 2, 10.3, 0.2, 20.0, 5.1), (1, 3, 0.1, 5.0, 20.1, 9.0)]
    got = layout.grid_from_boxes(spark.createDataFrame(boxes, "table_id long, box_id long, x0 double, y0 double, x1 double, y1 double")).orderBy("box_id").collect()
    assert [(r.row, r.col, r.row_span, r.col_span) for r in got] == [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 2)]


def test_boilerplate_rounds_half_to_even_and_compares_normal_forms(spark):
    # 2.5 and 1.6 per cent of the width are one place (2), 3.5 is another (4)
    rows = [(1, p, f"b{p}", t, x, 10.0, x + 50, 20.0) for p, t, x in ((1, "Caf\u00e9 p 1", 15.0), (2, "Cafe\u0301  p 22", 9.6), (3, "Caf\u00e9\u00a0p 3", 15.0), (4, "Caf\u00e9 p 4", 21.0), (5, "body", 15.0))]
    df = spark.createDataFrame(rows, "doc_id int, page int, block_id string, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.block_id for r in layout.boilerplate(df).collect()} == {"b1", "b2", "b3"}
    assert layout.boilerplate(df, owned=spark.createDataFrame([("b1",)], "block_id string")).collect() == []


def test_wrapped_rows(spark):
    def rows(cells):
        df = spark.createDataFrame([(1, k, *c) for k, c in enumerate(cells)], "table_id long, cell_id long, row int, col int, row_span int, col_span int, y0 double, y1 double, text string, header boolean")
        return {r.cell_id: r.row for r in layout.coalesce_wrapped(df).collect()}

    label, low = (0, 0, 1, 1, 0.0, 30.0, "length of pipe", False), (1, 1, 1, 1, 10.0, 16.0, "3,5", False)
    assert rows([label, low, (2, 0, 1, 1, 40.0, 50.0, "next", False)]) == {0: 0, 1: 0, 2: 1}
    assert rows([label, low, (2, 2, 1, 1, 18.0, 24.0, "−7", False), (1, 3, 1, 1, 10.0, 16.0, " ", False)]) == {0: 0, 1: 0, 2: 0}  # one after the other; blanks go
    for other in ((1, 0, 1, 1, 10.0, 16.0, "3", False), (1, 1, 1, 1, 28.0, 40.0, "3", False), (1, 1, 1, 1, 10.0, 16.0, "3 m", False), (1, 1, 2, 1, 10.0, 16.0, "3", False), (1, 1, 1, 1, 10.0, 16.0, "3", True), (1, 1, 1, 1, None, None, "3", False)):
        assert rows([label, other]) == {0: 0, 1: 1}
    assert rows([(0, 0, 1, 1, 0.0, 30.0, "12", False), low]) == {0: 0, 1: 1}  # no label


def test_model_hooks(spark):
    def model(questions, texts):
        if sum(map(len, texts)) > 6:
            raise retrieval.TokenOverflow
        return [float(len(t)) for t in texts]

    df = spark.createDataFrame([(k, "q", "x" * (k % 4)) for k in range(9)] + [(20, "q", None), (21, None, "x")], "k int, q string, t string").coalesce(1)
    got = {r.k: r.s for r in df.select("k", retrieval.rerank_score(F.col("q"), F.col("t"), model, 4).alias("s")).collect()}
    import math

    assert got[20] is None and got[21] is None and all(got[k] == pytest.approx(1 / (1 + math.exp(-(k % 4)))) for k in range(9))
    with pytest.raises(Exception, match="TokenOverflow"):
        spark.createDataFrame([("q", "x" * 9)], "q string, t string").select(retrieval.rerank_score(F.col("q"), F.col("t"), model)).collect()
    vectors = {r.k: r.v for r in df.select("k", retrieval.embed(F.col("t"), lambda ts: [[len(t), 1] for t in ts], 3).alias("v")).collect()}
    assert vectors[20] is None and all(vectors[k] == [k % 4, 1.0] for k in range(9))


def test_subjects_fold_case(spark):
    assert one(spark, text.subject, "STRASSE") == one(spark, text.subject, " straße.") == "strasse" and one(spark, text.subject, "ΛΟΓΟΣ") == one(spark, text.subject, "λογος")


def test_retirements_by_strength(spark):
    docs = spark.createDataFrame([(k, False, k == 5) for k in range(1, 6)], "doc_id long, archived boolean, revoked boolean")
    commands = spark.createDataFrame([(2, "deactivate"), (3, "deactivate"), (3, "archive"), (4, "revoke"), (4, "archive"), (9, "revoke"), (2, "deactivate")], "doc_id long, command string")
    pointers = spark.createDataFrame([(k, 10 + k) for k in range(1, 6)], "doc_id long, publication_id long")
    got = {r.doc_id: (r.outcome, r.searchable, r.publication_id) for r in catalog.apply_retirements(docs, pointers, commands).collect()}
    assert got == {1: ("kept", True, 11), 2: ("deactivated", False, None), 3: ("archived", False, 13), 4: ("revoked", False, 14), 5: ("revoked", False, 15)}


def test_replayed_publications_and_late_events(spark):
    rows = [(1, 10, 100, 1, None), (1, 11, 101, 2, 10), (1, 10, 100, 3, None), (1, 12, 102, 4, 10), (1, 12, 103, 5, 11)]
    got = catalog.apply_publications(spark.createDataFrame(rows, "doc_id long, version_id long, operation_id long, order int, expected long"))
    assert sorted((r.operation_id, r.outcome, r.current) for r in got.collect()) == [(100, "applied", 12), (100, "replay", 12), (101, "applied", 12), (102, "conflict", 12), (103, "applied", 12)]
    log = [(1, 1, "created"), (1, 2, "completed"), (1, 3, "started"), (1, 3, "started"), (1, 4, "completed"), (1, 5, "progress"), (2, 1, "odd")]
    states = {r.aggregate_id: tuple(r)[1:] for r in events.job_state(spark.createDataFrame(log, "aggregate_id long, sequence long, kind string")).collect()}
    assert states == {1: ("completed", 5, 3, 3), 2: ("new", 1, 0, 1)}


def test_citation_groups_with_spans_several_headers_and_scopes(spark):
    cells = [
        ("h0", 0, 0, 1, 1, "Pipe", "header", 1), ("h1", 0, 1, 1, 2, "Load", "header", 2), ("h2", 1, 1, 1, 1, "dry", "header", 3), ("u2", 1, 2, 1, 1, "kN", "unit", 4),
        ("s", 2, 0, 2, 1, "steel", "data", 5), ("a", 2, 1, 1, 1, "5", "data", 6), ("b", 2, 2, 1, 1, "7", "data", 7), ("c", 3, 1, 1, 2, "9", "data", 8), ("e", 3, 3, 1, 1, " ", "data", 9), ("h3", 4, 1, 1, 1, "later", "header", 10),
    ]
    df = spark.createDataFrame([(1, e, r, c, rs, cs, t, role, p, ["doc", "part", "table"]) for e, r, c, rs, cs, t, role, p in cells], "pack_id int, evidence_id string, row int, col int, row_span int, col_span int, excerpt string, role string, position int, path array<string>")
    scopes = spark.createDataFrame([(1, "top", 0, ["doc"]), (1, "near", 11, ["doc", "part"]), (1, "own", 12, ["doc", "part", "table"]), (1, "other", 13, ["doc", "x"]), (2, "far", 0, ["doc", "part"])], "pack_id int, evidence_id string, position int, path array<string>")
    got = {r.trigger: r.required for r in verify.citation_groups(df, scopes).collect()}
    assert got == {"s": ["h0", "near"], "a": ["h1", "h2", "s", "near"], "b": ["h1", "u2", "s", "near"], "c": ["h1", "h2", "u2", "s", "near"]}
    assert {r.trigger: r.required for r in verify.citation_groups(df).collect()}["b"] == ["h1", "u2", "s"]


def test_normal_text_maps_back_to_its_source(spark):
    from attestra.operators import lines

    rows = [(1, "  Cafe\u0301 \n\t is  open "), (2, None), (3, " \n "), (4, "plain"), (5, "\u00e9\u0323x")]
    got = {r.node_id: r for r in lines.normalise_text(spark.createDataFrame(rows, "node_id long, text string")).collect()}
    assert [got[k].text for k in range(1, 6)] == ["Caf\u00e9 is open", "", "", "plain", "\u1eb9\u0301x"] and got[2].segments == [] == got[3].segments
    for k, source in rows:
        at = 0
        for s in got[k].segments:
            assert s.start == at and s.end > s.start
            at = s.end
            if s.kind == "exact":
                assert source[s.source_start : s.source_end] == got[k].text[s.start : s.end]
        assert at == len(got[k].text)
    assert [(s.kind, s.source_start, s.source_end) for s in got[1].segments] == [("exact", 2, 5), ("normalized_group", 5, 7), ("normalized_group", 7, 11), ("exact", 11, 13), ("normalized_group", 13, 15), ("exact", 15, 19)]


def pieces(spark, text, budget, atomic=None, count="code points"):
    df = spark.createDataFrame([(1, text, atomic)], "node_id long, text string, atomic array<struct<start:int,end:int>>")
    return [(r.text, r.fault is not None) for r in tree.chunk_body(df, budget, count).orderBy("ordinal").collect()]


def test_where_texts_are_cut(spark):
    cut = lambda *a: [t for t, fault in pieces(spark, *a) if not fault]
    assert cut("one two\nthree; four five", 14) == ["one two\n", "three; ", "four five"]
    assert cut("a\n\nb c d e", 6) == ["a\n\n", "b c d ", "e"]
    assert cut("можно, если очень", 13) == ["можно, ", "если очень"]  # not left behind: если
    assert cut("так при условии того", 17) == ["так ", "при условии того"]
    assert cut("если очень", 6) == ["если ", "очень"]
    assert cut("abcde   ", 8) == ["abcde   "] and cut("abcde fg  ", 8) == ["abcde ", "fg  "]
    family, hand = "\U0001f469\u200d\U0001f467", "\U0001f44d\U0001f3fd"
    assert cut("x" + family + hand, 3) == ["x", family, hand] and cut("e\u0301e\u0301", 3) == ["e\u0301"] * 2
    assert pieces(spark, "ab" + "c" * 5 + "d", 4, [(2, 7)]) == [("ab", False), ("ccccc", True), ("d", False)]  # atomic, over the budget
    assert pieces(spark, "abcd" + " " * 9, 6)[-1][1]  # a blank chunk


def by_hand(text, budget, count):
    """The rule read aloud: the longest run of parts that fits, back to its best end, or before an introducer."""
    import re

    parts = re.findall(r"\S*[^\S\n]*\n(?:[ \t]*\n)?|\S+[^\S\n]*|[^\S\n]+", text)
    parts = [x for p in parts for x in (list(p) if count(p) > budget else [p])]
    rank = [1 if p.endswith("\n") else 2 if re.search(r"[.!?;]\s+$", p) else 3 if p[-1].isspace() else 4 for p in parts]
    out = []
    while parts:
        n = len(parts)
        while sum(map(count, parts[:n])) > budget:
            n -= 1
        if n < len(parts):
            n = max(k + 1 for k in range(n) if rank[k] == min(rank[:n]))
            if n > 1 and parts[n - 1].strip().lower() in ("не", "если"):
                n -= 1
        out.append("".join(parts[:n]))
        parts, rank = parts[n:], rank[n:]
    return out


def test_chunks_against_the_rule_by_hand(spark):
    rng = random.Random(2)
    bits = ["word", " ", " ", ". ", "\n", "; ", "не ", "Если ", "wider", "\n\n", "\t", "longestword"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "node_id long, text string")
    for name, count in (("words", lambda p: int(bool(p.strip()))), ("code points", len)):
        for budget in (4, 11):
            got = {}
            for r in tree.chunk_body(df, budget, name).orderBy("node_id", "ordinal").collect():
                assert texts[r.node_id][r.start : r.end] == r.text
                got.setdefault(r.node_id, []).append(r.text)
            for k, t in enumerate(texts):
                assert got.get(k, []) == (by_hand(t, budget, count) if t.strip() else []), (name, budget, t)


def test_chunks_keep_atomic_ranges(spark):
    df = spark.createDataFrame([(1, "aa bb cc", [(1, 7)]), (2, "aa bb", None), (3, "  ", None)], "node_id long, text string, atomic array<struct<start:int,end:int>>")
    got = sorted((r.node_id, r.ordinal, r.text) for r in tree.chunk_body(df, 3, "code points").collect())
    assert got == [(1, 0, "aa bb cc"), (2, 0, "aa "), (2, 1, "bb")]


def closures(spark, units, groups, options=None, most=10):
    u = spark.createDataFrame([(1, i, x, k) for k, (i, x) in enumerate(units)], "pack_id int, evidence_id string, excerpt string, position int")
    g = spark.createDataFrame([(1, *x) for x in groups], "pack_id int, trigger string, required array<string>, subjects array<string>")
    o = options and spark.createDataFrame([(1, *x) for x in options], "pack_id int, row int, values array<string>, complete array<string>")
    return {r.start: r.ids for r in verify.citation_closures(u, g, o or None, most).collect()}


def test_closures_grow_through_numbers_only(spark):
    units = [("h", "Head"), ("n1", "1"), ("x", "word"), ("y", "far"), ("s", "Part"), ("n2", "m²"), ("loop", "3")]
    groups = [("n1", ["h", "x", "n2", "gone"], ["s"]), ("x", ["y"], []), ("n2", ["s"], ["s"]), ("loop", ["n1", "loop"], []), ("h", ["y"], [])]
    got = closures(spark, units, groups)
    assert got == {"n1": ["s", "n1", "n2", "h", "x"], "n2": ["s", "n2"], "loop": ["s", "n1", "n2", "loop", "h", "x"]}  # y is behind a word
    rows = closures(spark, units, groups, [(1, ["n2"], ["s", "n2"]), (2, ["n2"], ["y", "n2"]), (3, ["x"], ["x", "n2"])])
    assert rows == got | {"row 2": ["s", "n2", "y"]}  # row 1 is n2's own, row 3 has no value with a number


def test_long_closures_are_dropped_whole(spark):
    units = [(f"n{k}", str(k)) for k in range(14)] + [(f"w{k}", "w") for k in range(12)]
    got = closures(spark, units, [("n0", [f"w{k}" for k in range(10)], []), ("n1", [f"w{k}" for k in range(9)], []), *[(f"n{k}", [f"n{k + 1}"], []) for k in range(2, 13)]])
    assert "n0" not in got and len(got["n1"]) == 10  # the trigger counts
    assert sorted(got) == sorted(["n1", *[f"n{k}" for k in range(4, 13)]])


def test_variants_that_a_question_selects(spark):
    rows = [(1, 0, "Приём"), (1, 1, "Лимит приёма"), (1, 2, "лимит ПРИЕМА воды"), (1, 3, "Общий лимит приема соли"), (1, 4, "Лимит"), (1, 5, "x лимит приема воды y")]
    options = spark.createDataFrame([(p, k, k + 10, t, [f"s{k}"], [f"v{k}"], [f"s{k}", f"v{k}", f"h{k}"]) for p, k, t in rows], "pack_id int, option int, row int, subject string, subjects array<string>, values array<string>, complete array<string>")
    groups = verify.variant_groups(options)
    assert [(r.base, r.members) for r in groups.collect()] == [(1, [1, 2, 3, 5])]

    def lacks(question, cited, most=12):
        q, c = spark.createDataFrame([(1, question)], "pack_id int, question string"), spark.createDataFrame([(1, cited)], "pack_id int, evidence_ids array<string>")
        return [(r.number, r.row, r.missing) for r in verify.missing_variants(q, c, options, groups, most).orderBy("number").collect()]

    assert lacks("Какой общий лимит соли?", ["v1"]) == [(1, 13, ["s3", "v3"])]  # its own words: общий, соли
    assert lacks("Что такое «лимит приема»?", ["v1", "s1"]) == [(1, 11, ["h1"])]
    assert [r for _, r, _ in lacks("Какой?", ["v2"])] == [11, 12, 13, 15] and [r for _, r, _ in lacks("Какой?", ["v2"], 2)] == [11, 12]
    assert lacks("Какой?", ["v4"]) == []  # no member's value is cited
    assert lacks("общий соли", ["s3", "v3", "h3"]) == []


def test_header_bands_contexts_and_faults(spark):
    def grid(table, *rows):
        return [(table, r, c, t, 1, 1) for r, row in enumerate(rows) for c, t in enumerate(row) if t is not None]

    cells = grid(1, ["Form 2024 edition", "Size, мм"], ["Part", "Width"], ["a", "12"], ["b", "до 13"], ["Part", "Size, мм"], ["c", "5"])
    cells += grid(2, ["1", "2"], ["3", "4"])  # no header
    cells += grid(3, ["Name", "Sign"], ["", ""], ["x", "y"])  # no value: the empty row ends the header
    cells += grid(4, ["Name", "No"], ["a", "1"], ["Name", "Other"])  # a band without a value below is data
    cells += [(5, 0, 0, "Head", 1, 1), (5, 0, 1, "No", 1, 1), (5, 1, 0, "tall", 2, 1), (5, 1, 1, "1", 1, 1), (5, 2, 1, "2", 1, 1), (5, 3, 0, "Group", 1, 2), (5, 4, 0, "b", 1, 1), (5, 4, 1, "3", 1, 1), (5, 5, 0, "End", 1, 2)]
    df = spark.createDataFrame(cells, "table_id int, row int, col int, text string, row_span int, col_span int")
    assert {r.table_id: (r.header_rows, r.later_rows, r.rows) for r in layout.header_rows(df).collect()} == {1: (2, 1, 6), 2: (0, 0, 2), 3: (1, 0, 3), 4: (1, 0, 3), 5: (1, 0, 6)}
    context = {(r.table_id, r.row): (r.headers, r.units, r.scope, r.section) for r in layout.row_context(df).collect()}
    top = ["Form 2024 edition", "Size, мм", "Part", "Width"]
    assert context[1, 2] == (top, ["Size, мм"], [], None) and context[1, 5] == (["Part", "Size, мм"], ["Size, мм"], [], None) and context[2, 0] == ([], [], [], None)
    assert context[5, 2] == (["Head", "No"], [], ["tall"], None) and context[5, 4] == (["Head", "No"], [], [], "Group") and (5, 3) not in context
    chunks = {(r.table_id, r.row): (r.chunk, r.fault) for r in layout.chunk_table_rows(df).collect()}
    assert chunks[2, 0] == chunks[2, 1] == (None, layout.NO_HEADER) and chunks[3, 1] == (None, layout.NO_TEXT)
    assert chunks[5, 4] == ("Group\nHead | No\nb | 3", None) and chunks[5, None] == (None, layout.NOT_COVERED)
    assert chunks[1, 5] == ("Part | Size, мм\nSize, мм\nc | 5", None) and (1, None) not in chunks


def test_prefixes_within_a_budget_and_descriptors(spark):
    rows = [("one two three", 2, "words", "one two "), ("  one two", 1, "words", "  one "), ("abc defgh", 6, "code points", "abc de"), ("e\u0301e\u0301", 3, "code points", "e\u0301"), ("\U0001f469\u200d\U0001f467x", 2, "code points", ""), ("", 3, "words", "")]
    for text, budget, count, want in rows:
        assert one(spark, lambda c, b=budget, k=count: tree.fitting_prefix(c, b, k), text) == want
    nodes = spark.createDataFrame([(1, 10, None, 0, "document", ""), (1, 11, 10, 1, "section", " "), (1, 12, 11, 2, "clause", "first text"), (2, 20, None, 0, "document", None), (3, 30, None, 0, "document", "own words here"), (3, 31, 30, 1, "section", "")], "doc_id int, node_id int, parent_id int, ordinal int, kind string, text string")
    from attestra.operators import lines

    chunks = spark.createDataFrame([(1, 12, 0, "first text"), (2, 20, 1, "later"), (2, 20, 0, "table row")], "doc_id int, node_id int, ordinal int, text string")
    got = lines.routing_descriptors(tree.tree_paths(nodes), nodes, ("document", "section"), 2, chunks=chunks)
    assert sorted(map(tuple, got.collect())) == [(1, 10, 12, "first text", None), (1, 11, 12, "first text", None), (2, 20, 20, "table row", None), (3, 30, 30, "own words ", None)]
    assert [r.fault for r in lines.routing_descriptors(tree.tree_paths(nodes), nodes, ("document",), 0).collect()] == [lines.INTRO_TOO_LONG] * 2


def test_packs_and_closures_beyond_their_limits(spark):
    cand = spark.createDataFrame([(1, 1, 1, 50), (1, 2, 1, 500), (2, 1, 1, 101), (2, 2, 9, 1)], "query_id long, rank int, units int, tokens int")
    assert sorted((r.query_id, r.rank, r.taken, r.fault) for r in evidence.pack_evidence(cand, 3, 100).collect()) == [(1, 1, True, None), (1, 2, False, None), (2, 1, False, evidence.TOO_LARGE), (2, 2, False, evidence.TOO_LARGE)]
    spans = spark.createDataFrame([(k, 1, k, k + 1) for k in range(12)], "node_id long, block_key long, start long, end long")
    refs = spark.createDataFrame([(k, 1, k + 1, k + 2) for k in range(11)] + [(3, 1, 0, 2), (8, 1, 7, 8)], "node_id long, block_key long, start_b long, end_b long")
    seeds = spark.createDataFrame([("a", 9), ("b", 0), ("c", 8), ("c", 11)], "query_id string, node_id long")
    got = sorted(map(tuple, evidence.anchor_closure(seeds, spans, refs, 5, 6).collect()), key=repr)
    assert got == sorted([("a", 9, 0, None), ("a", 10, 1, None), ("a", 11, 2, None), ("b", None, None, evidence.LIMIT), ("c", 8, 0, None), ("c", 11, 0, None), ("c", 7, 1, None), ("c", 9, 1, None), ("c", 10, 2, None)], key=repr)
    assert [r.fault for r in evidence.anchor_closure(seeds.where("query_id = 'c'"), spans, refs, 5, 4).collect()] == [evidence.LIMIT]


def test_hits_on_rows_take_what_stands_for_them(spark):
    cells = [(1, 0, 0, "Part", 1), (1, 0, 1, "No", 1), (1, 1, 0, "Pipe", 1), (1, 1, 1, "1", 2), (1, 2, 0, "Pipe wide", 1), (1, 3, 0, "Valve", 1), (1, 3, 1, "3", 1), (1, 4, 0, "Pipe", 1), (1, 4, 1, " ", 1)]
    df = spark.createDataFrame(cells, "table_id int, row int, col int, text string, row_span int")
    hits = spark.createDataFrame([("h", 1, 2), ("g", 1, 4)], "hit_id string, table_id int, row int")
    got = {}
    for r in evidence.expand_rows(hits, df).collect():
        got.setdefault(r.hit_id, {})[r.row, r.col] = r.relation
    head = {(0, 0): "header", (0, 1): "header"}
    assert got == {"h": head | {(2, 0): "hit", (1, 0): "table", (1, 1): "table"}, "g": head | {(4, 0): "hit"}}


def test_wrapped_rows_of_many_tables_go_through_tasks_in_order(spark):
    label, low, blank = (0, 0, 1, 1, 0.0, 30.0, "length", False), (1, 1, 1, 1, 10.0, 16.0, "3,5", False), (1, 2, 1, 1, 10.0, 16.0, " ", False)
    df = spark.createDataFrame([(t, 10 * t + k, *c) for t in range(50) for k, c in enumerate((low, blank, label) if t % 3 else (label, (*low[:4], 28.0, 40.0, *low[6:]), blank))], "table_id long, cell_id long, row int, col int, row_span int, col_span int, y0 double, y1 double, text string, header boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # rows and tables are cut by batches
    try:
        out = layout.coalesce_wrapped(df)
        got = sorted((r.cell_id, r.row) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(x for t in range(50) for x in ([(10 * t, 0), (10 * t + 2, 0)] if t % 3 else [(10 * t, 0), (10 * t + 1, 1), (10 * t + 2, 1)]))
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # a call for each table took most of the time


def test_a_closure_is_one_row_between_rounds(spark, monkeypatch):
    sizes = []
    kept = verify.staged
    monkeypatch.setattr(verify, "staged", lambda df: sizes.append((out := kept(df)).count()) or out)
    units = [(f"h{k}", "head") for k in range(8)] + [(f"n{k}", str(k)) for k in range(10)]
    got = closures(spark, units, [(f"n{k}", [f"h{j}" for j in range(8)], []) for k in range(10)])
    assert len(got) == 10 and sum(sizes) <= 40  # 90 ids in the ten closures


def test_hits_reach_cells_that_span_into_their_rows(spark):
    cells = [(1, 0, 0, "Part", 1), (1, 0, 1, "No", 1), (1, 1, 0, "Pipe", 1), (1, 1, 1, "1", 3), (1, 2, 0, "Pipe wide", 1)]
    df = spark.createDataFrame(cells, "table_id int, row int, col int, text string, row_span int")
    hits = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 1, 9), ("d", 2, 1), ("a", 1, 1)], "hit_id string, table_id int, row int")
    got = {}
    for r in evidence.expand_rows(hits, df).collect():
        got.setdefault(r.hit_id, {})[r.row, r.col] = r.relation
    head = {(0, 0): "header", (0, 1): "header"}
    assert got == {"a": head | {(1, 0): "hit", (1, 1): "hit", (2, 0): "hit"}, "b": head | {(1, 1): "scope"}, "c": head}
