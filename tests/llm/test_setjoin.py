import random
from fractions import Fraction

import numpy as np
import pytest

from attestra.llm import setjoin
from attestra.llm.components import components


def sets_of(text, width):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute(rows, width, j):
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and Fraction(len(sets[x] & sets[y]), len(sets[x] | sets[y])) >= j:
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cc", "d1", "e,", "f", "g", "hh"]) + str(rng.randint(0, 30))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 30, 60, 150, 400]))] for _ in range(40)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(ws) or 1)
            ws[k : k + 1] = rng.choice([[], [word()], [word(), word()]])
        if rng.random() < 0.2:
            ws = passage + ws
        rows.append((1000 - i, rng.choice([" ", "\n", "\t "]).join(ws)))
    hub = [word() for _ in range(90)]
    for i in range(60):  # copies of one text, each changed in another place: only the text itself is near them all
        ws = list(hub)
        ws[i] = word() + "x"
        rows.append((2000 + i, " ".join(ws)))
    return rows + [(3000, " ".join(hub)), (5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (10, "é"), (11, "É"), (12, "w " * 3000)]


@pytest.mark.parametrize(("width", "p"), [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, width, p):
    rows = corpus(p)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = setjoin.near_groups(df, width, (p, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, width, Fraction(p, 100))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 97, 300, 1500]:
        for p in (60, 80, 90, 95):
            a = np.unique(setjoin.mix(rng.integers(1, 1 << 62, n).astype(np.uint64)))
            for _ in range(4):
                drop = rng.integers(0, max(1, n // 3))
                add = rng.integers(0, max(1, n // 3))
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], setjoin.mix(rng.integers(1, 1 << 62, add).astype(np.uint64))]))
                same, both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if same < both and 100 * same >= p * both:
                    assert len(np.intersect1d(setjoin.signatures(a, p, 100), setjoin.signatures(b, p, 100)))


def test_repeated_ids_empty_table_and_what_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text + " end"), (2, "quite another text here now"), (None, text), (4, text), (4, text), (7, None), (8, ""), (9, "quite another text here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in setjoin.near_groups(df).collect()}
    assert got == {(1, 36): 1, (1, 37): 1, (2, 1): 2, (None, 36): 1, (4, 36): 1, (7, 0): 7, (8, 0): 8, (9, 1): 2}
    stays = setjoin.one_of_each_group(df).collect()
    assert sorted(r.doc_id for r in stays) == [1, 2, 7, 8]
    assert setjoin.near_groups(df.limit(0)).collect() == [] and setjoin.one_of_each_group(df.limit(0)).collect() == []


def test_one_stays_of_each_group_where_ids_are_null_or_repeated(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    stays = lambda rows: sorted(map(tuple, setjoin.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    apart = [(None, text("a")), (None, text("b")), (6, text("c")), (6, text("d"))]  # no ids, or one id for two texts
    assert stays(apart) == sorted(apart, key=str)
    assert stays([(None, text("a")), (3, text("a") + " end"), (5, text("a") + " end")]) == [(3, text("a") + " end")]
    assert len(stays([(None, text("a")), (None, text("a") + " end"), (None, ""), (None, None), (7, "")])) == 4


def test_what_stays_keeps_columns_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "mine", 7), (2, text + " end", "mine", 8), (3, None, "mine", 9)], "doc_id long, text string, _key string, turn int")
    out = setjoin.one_of_each_group(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, text, "mine", 7), (3, None, "mine", 9)]


def test_bounds_of_sketches_are_bounds(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(setjoin.mix(rng.integers(1, 1 << 62, n).astype(np.uint64))) for n in (1, 5, 40, 300, 2000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], setjoin.mix(rng.integers(1, 1 << 62, 1 + len(s) // 12).astype(np.uint64))])) for s in sets]
    pairs = [(x, y) for x in range(len(sets)) for y in range(x)]
    table = spark.createDataFrame([(k, bytearray(setjoin.sketch(s))) for k, s in enumerate(sets)], "node long, sketch binary")
    got = {(r.a, r.b): r.level for r in setjoin.with_levels(spark.createDataFrame(pairs, "a long, b long"), table, 80, 100).collect()}
    for x, y in pairs:
        j = Fraction(len(np.intersect1d(sets[x], sets[y])), len(np.union1d(sets[x], sets[y])))
        assert got[x, y] >= (2 if j >= Fraction(4, 5) else 1 if j >= Fraction(3, 5) else 0)
    assert sum(v == 0 for v in got.values()) > len(pairs) // 2


def test_copies_changed_in_ways_of_their_own_are_no_candidates(spark, monkeypatch):
    """All are near one text, and some linked with it, but no two of the others can be linked: few pairs are compared."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 161):
        ws = list(base)
        for k in rng.sample(range(7), 1 if i <= 40 else 4):
            ws[20 * k + 8 + rng.randrange(5)] = f"x{i}y{k}"
        rows.append((i, " ".join(ws)))
    counted, apart = [], setjoin.apart

    def counting(*a):
        pairs = apart(*a)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(setjoin, "apart", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = setjoin.near_groups(df, 5, (80, 100)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect())) == brute(rows, 5, Fraction(4, 5))
    assert counted[0] < len(rows)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(50)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {got[0]} and len({got[100 + i] for i in range(50)} | {got[500]}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
