import random
import zlib
from collections import Counter, defaultdict

from attestra.llm import sharding


def greedy(sizes, capacity):
    n, at = 1, 0
    for s in sizes:
        if at + s > capacity:
            n, at = n + 1, 0
        at += s
    return n


def smallest(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)


def run(spark, rows, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, size string")
    return sharding.contiguous_shards(df, shards).collect()


def test_capacity_is_the_brute_force_minimum_and_groups_stay_together(spark):
    rng = random.Random(5)
    texts = ["x" * rng.choice([1, 3, 10, 40, 200]) + str(i) for i in range(300)] + ["same"] * 40 + ["", None, None, "é" * 20]
    rows = [(i if i % 50 else None, t, 1, "clash") for i, t in enumerate(texts)]
    got = run(spark, rows, 8)
    assert len(got) == len(rows)
    by_h = spark.createDataFrame([(t,) for t in set(texts)], "text string").selectExpr("text", "xxhash64(text) h").collect()
    count = Counter(texts)
    size = lambda t: len((t or "").encode()) + 1
    ordered = [size(r.text) * count[r.text] for r in sorted(by_h, key=lambda r: r.h)]
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load.values()) == smallest(ordered, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((size(t), zlib.crc32((t or "").encode())) for t in texts)


def test_search_with_few_bins_agrees_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 3)
    for seed in range(6):
        rng = random.Random(seed)
        sizes = [rng.choice([1, 2, 5, 60, 300 if seed % 2 else 7]) for _ in range(60)]
        sums, at = [], 0
        for s in sizes:
            sums.append((at := at + s,))
        ends = sharding.minimax_ends(spark.createDataFrame(sums, "cum long"), at, max(sizes), 5)
        assert ends[-1] == at
        assert max(b - a for a, b in zip([0, *ends], ends)) == smallest(sizes, 5)


def test_empty_table_and_fewer_groups_than_shards(spark):
    assert run(spark, [], 8) == []
    assert len({r.shard for r in run(spark, [(1, "a", 0, ""), (1, "a", 0, ""), (2, "bb", 0, "")], 8)}) <= 2
