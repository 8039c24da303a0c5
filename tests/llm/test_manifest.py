import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attestra.llm import manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level):
    """The top of a list of digests, and for each the list of (children, place) on its way."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for way, k in zip(ways, at, strict=True):
            way.append((runs[k // 8], k % 8))
        level, at = [h(*r) for r in runs], [k // 8 for k in at]
    return level[0], ways


def brute(rows, bad):
    """(doc_id, leaf, subroot, root, proof, folded, verified) for rows (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        tampered = (*r[:4], r[4] and r[4].translate(LOWER)) if bad(r[0]) else r
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(tampered)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {x: climb([y[2] for y in sorted(trees[x])]) for x in order}
    root, above = climb([tops[x][0] for x in order])
    out = []
    for x, top in zip(order, above, strict=True):
        for (known, i, own, folded), way in zip(sorted(trees[x]), tops[x][1], strict=True):
            proof = []
            for kids, k in [*way, *top]:
                proof += kids[:k] + kids[k + 1 :]
                folded = h(*kids[:k], folded, *kids[k + 1 :])
            out.append((i if known else None, own, tops[x][0], root, h(*proof), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int")
    out = manifest.manifest(df, F.col("doc_id") % 3 == 0)
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def third(doc_id):
    return doc_id is not None and doc_id % 3 == 0


def make(n, langs, rng):
    return [(rng.choice([i, i, i, -i]), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(["Text", "text", "", None, "ÄB" * 9])) for i in range(n)]


@pytest.mark.parametrize(("n", "langs", "fan"), [(700, ["de"] * 30 + ["fr", None, "", "日", "a b", "😀", "z", "x", "y", "w"], 8**4), (200, ["only"], 64), (150, [f"l{k}" for k in range(80)], 8)])
def test_against_brute_force(spark, monkeypatch, n, langs, fan):
    monkeypatch.setattr(manifest, "BLOCK", fan)
    monkeypatch.setattr(manifest, "ROWS_PER_PART", 40)
    rows = make(n, langs, random.Random(n))
    rows += [(None, None, None, None, None), (None, None, None, None, None), *[rows[0]] * 12, (5, "s", "lone", 1, "A lone leaf")]
    got = run(spark, rows)
    assert got == brute(rows, third)
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark):
    row = (3, "s", "en", 4, "Text")
    assert run(spark, [row]) == brute([row], third)
    (got,) = run(spark, [(1, "s", "en", 4, "Text")])
    assert got[1] == got[2] == got[3] == got[5] and got[4] == h() and got[6]
    assert run(spark, []) == []
    pair = [(1, "s", "en", 4, "Text"), (3, "s", "de", 4, "Text")]
    assert run(spark, pair) == brute(pair, third)


def test_query_marks_every_third_digest_sum(spark):
    import zlib

    out = manifest.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or text[r.doc_id].translate(LOWER) == text[r.doc_id]) for r in out)
