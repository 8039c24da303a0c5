import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attestra.llm import middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rng, n):
    bits = ["a", "Bc", "é", "日本", "😀", "\x1c", "\x85", " ", " ", "\n", "\t ", "\x0b", "\x0c\r", "<", "<P", ">", "S>", "M>"]
    return [None, "", " ", "x", " x ", "\n\n", "<P>", "a<M> b", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 90))) for _ in range(n))]


def test_against_brute_force_and_back(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, -1, *range(10**6)]), t) for t in texts(rng, 500)]
    rows += [(k, "wort " * 30_000 + "é" * 5000 + " end  ") for k in range(12)] + [(77, "no blank" * 4000), *[(3, "the same row twice")] * 2]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, form string, cut int")
    for arguments in ((42, 50, 80), (7, 100, 50)):
        out = middle.fill_in_middle(df, "doc_id", "text", *arguments).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
        got = sorted((tuple(r)[:6] for r in out), key=repr)
        assert got == sorted((brute(i, t, *arguments) for i, t in rows), key=repr)
        assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)
    assert middle.fill_in_middle(df.limit(0)).collect() == []


def test_trees_find_every_cut(monkeypatch):
    rng = random.Random(3)
    for block in (1, 3, 8, 1024):
        monkeypatch.setattr(middle, "BLOCK", block)
        some = [t for t in texts(rng, 60) if t is not None] + ["ab " * 700]
        trees = middle.Trees(pa.array(["x", *some])[1:])
        tokens = [TOKEN.findall(t) for t in some]
        assert trees.units.tolist() == [len(x) for x in tokens]
        for share in (0, 0.3, 0.9, 1):
            k = np.array([round(len(x) * share) for x in tokens])
            assert trees.cut(k).tolist() == [len("".join(x[:n])) for x, n in zip(tokens, k, strict=True)]
