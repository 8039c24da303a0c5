import hashlib
import random

from attestra.llm import fingerprints as fp


def shingles(t):
    ws = t.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def corpus(n=120):
    rng = random.Random(8)
    rows = [(i * 3, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 9, 40, 300, 900])))) for i in range(n)]
    return rows + [(7, None), (8, ""), (9, "é" * 501), (1_000_000, "one two"), (30, "same id"), (None, "no id"), (rows[5][0] + 1, rows[5][1]), (11, " \t\n"), (12, "word " * 20_000)]


def ordered(rows, h):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, h[r])
    return sorted(rows, key=key, reverse=True)


def test_edits_likeness_and_order(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 7)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    h = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    line = ordered(rows, h)
    want, near = {}, {}
    for (i, t), (_, after) in zip(line, line[1:] + line[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] = jac(shingles(t), shingles(edited)), jac(shingles(t), shingles(after))
    got = fp.fingerprints(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == set(want)
    off = [abs(r.near_edited - want[(r.doc_id, r.n_chars, r.edited_sha256)][0]) for r in got]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.05
    assert sum(abs(r.near_next - want[(r.doc_id, r.n_chars, r.edited_sha256)][1]) for r in got) / len(got) < 0.05
    prints = {}
    for r in got:
        assert r.fingerprint == "" or len(r.fingerprint) == fp.BINS * fp.BITS // 4
        prints[r.doc_id] = r.fingerprint
    assert prints[15] == prints[16]


def test_buckets_split_null_ids_repeated_ids_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 50)
    rows = [(None, f"t{k}") for k in range(700)] + [(5, f"u{k}") for k in range(700)] + [(9, "same")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) h")
    sizes = fp.with_buckets(df).groupBy("doc_id", "bucket").count().collect()
    for i in (None, 5, 9):
        own = [r["count"] for r in sizes if r.doc_id == i]
        assert sum(own) == 700 and max(own) < 400
    nexts = fp.with_next(df, "text").collect()
    line = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in df.collect()), reverse=True)
    assert sorted((r.text, r.next_text) for r in nexts) == sorted((a[3], b[3]) for a, b in zip(line, line[1:] + line[:1]))


def test_copies_one_row_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 3)], "doc_id long, text string, h int")
    assert [r.near_next for r in fp.fingerprints(df).collect()] == [1.0] * 3
    assert fp.fingerprints(df.limit(1)).count() == 1 and fp.fingerprints(df.limit(0)).collect() == []
