import math

import numpy as np
import pytest

from attestra.llm import ann


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        far = sorted((math.dist(np.array(v, np.float64), np.array(x, np.float64)), i) for i, x in rows if i != q)[:k]
        out[q] = far
    return out


def test_recall_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1)
    monkeypatch.setattr(ann, "LEAST_SHARD", 500)
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(1600, 16)) + rng.integers(0, 3, (1600, 1))).astype(np.float32))]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]  # one very common vector
    bad = [(100, None), (200, [0.0] * 16), (300, [float("nan")] * 16), (400, [None] + [1.0] * 15), (None, [1.0] * 16), (500, [float("inf")] + [1.0] * 15), (600, [])]
    rows = [r for r in rows if r[0] not in {b[0] for b in bad}]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, rank int").repartition(4)
    queries = df.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding")
    got = {}
    for r in ann.search(ann.build_index(df, 10), queries, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
        exact = dict(rows)
        assert all(f[1] == pytest.approx(math.dist(np.array(exact[q], np.float64), np.array(exact[f[2]], np.float64)), abs=1e-12) for f in found)
    assert hits >= 0.97 * 10 * len(want)
    assert [f[2] for f in got[0]] == [2000 + i for i in range(10)]


def test_scores_are_of_the_vectors_as_given(spark):
    near = [(k, [1.0 + k * 1e-9, 2.0]) for k in range(20)]
    df = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    got = ann.search(ann.build_index(df, 10), df.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 11))
    assert all(r.score == math.dist(near[0][1], near[r.vec_id][1]) > 0 for r in got)


def test_few_rows_repeated_ids_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0, 1.0])], schema)
    queries = df.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(tuple(r) for r in ann.search(ann.build_index(df, 10), queries).collect())
    assert got == [(0, 1, 3, 0.0), (0, 1, 3, 0.5), (0, 2, 3, 0.0), (0, 2, 3, 0.5)]
    none = df.limit(0)
    assert ann.search(ann.build_index(none, 10), queries).collect() == []
    assert ann.search(ann.build_index(df, 10), queries.limit(0)).collect() == []


@pytest.mark.parametrize(("offset", "scale"), [(0, 1), (1e3, 1), (1e4, 1), (0, 1e20), (3e7, 1e-3)])
def test_recall_of_vectors_with_a_common_offset_or_of_great_size(spark, offset, scale):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 16)) * scale + offset
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ann.search(ann.build_index(df, 10), queries, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, [r for r in rows if r[0] % 40 == 0], 10)
    assert sum(len(got[q] & {i for _, i in near}) for q, near in want.items()) >= 0.95 * 10 * len(want)
