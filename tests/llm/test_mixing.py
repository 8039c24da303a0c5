from collections import defaultdict

import pytest

from attestra.llm import mixing


def water(sizes, weights, share=1.5, cap=2.0):
    total, full = sum(sizes.values()) * share, set()
    while True:
        free = [s for s in sizes if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / (sum(weights[s] for s in free) or 1)
        over = {s for s in free if level * weights[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= over


def documents(n=600):
    return [(i, " ".join(["w"] * (1 + i * 7 % 90)), ["b", "a", None, "Z", "é"][i % 5 if i % 3 else 0], 1) for i in range(n)] + [(7, None, "a", 1), (7, "", "a", 1), (None, "x y", "b", 1)] + [(9, "same row", "b", 1)] * 9


SCHEMA = "doc_id long, text string, source string, copies int"


def test_targets_and_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CHUNK", 7)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = documents()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    size, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = water(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in size:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - goal[s]) <= 90
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_rounding_keeps_expectation():
    size, part = [3, 5, 2, 9, 1], [0.3, 0.3, 0.7, 0.5, 0.2]
    sums = [0.0] * 5
    for seed in range(4000):
        out = mixing.pivotal(part, size, [(i, 0) for i in range(5)], seed)
        assert sum(a * b for a, b in zip(out, size)) == pytest.approx(sum(a * b for a, b in zip(part, size)))
        assert sum(0 < p < 1 for p in out) <= 1
        sums = [a + b for a, b in zip(sums, out)]
    assert all(abs(a / 4000 - b) < 0.04 for a, b in zip(sums, part))


def test_large_ids_beside_null_ones_and_clashing_names(spark):
    rows = [(2**60 + 1, "a b c d e", "s", 1, "k", 7), (None, "f g", "s", 2, "k", 7), *((2**60 + 2 * k, "x y z", "s", 3, "k", 7) for k in range(1, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, _key string, h int")
    got = mixing.mix(df).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    out = [tuple(r) for r in mixing.mixed(df).collect()]
    assert mixing.mixed(df).columns == df.columns and set(out) <= set(rows)
    assert sorted(map(repr, out)) == sorted(repr(x) for r in got for x in rows if x[0] == r.doc_id for _ in range(r.copies))


def test_mixed_rows_and_empty_table(spark):
    rows = documents(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = sum(r.copies for r in mixing.mix(docs).collect())
    assert out.count() == want
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_equal_rows_are_rounded_as_one(spark, monkeypatch):
    rows = [(1, "a b c", "s", 0)] * 5000 + [(k, "x " * (k % 9 + 1), "s", 0) for k in range(2, 300)] + [(1, "a b c", "t", 0)] * 3
    seen = []
    made = mixing._mixed_units
    monkeypatch.setattr(mixing, "_mixed_units", lambda *a, **b: seen.append(made(*a, **b)) or seen[-1])
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and seen[0].count() == 300
    equal = [r.copies for r in got if r.doc_id == 1 and r.source == "s"]
    assert len(equal) == 5000 and max(equal) - min(equal) <= 1 and max(equal) <= 2
    for s in "st":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9 and all(r.taken <= 2 * r["size"] for r in own)
