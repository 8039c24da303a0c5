import hashlib
import random
from collections import defaultdict

import pytest

from attestra.llm import lines

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UP, LOW))


def brute(rows, chars, docs):
    """(doc_id, text, n_lines, n_dropped) of every row."""
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [len(key(x)) >= chars and len(holders[key(x)]) >= docs and i != max(d for d in holders[key(x)] if d is not None) for x in own]
        out.append((i, "\n".join(x for x, g in zip(own, gone, strict=True) if not g), len(own), sum(gone)))
    return sorted(out, key=repr)


def run(spark, rows, chars=20, docs=3):
    df = spark.createDataFrame([(i, t, "x", 1, [1]) for i, t in rows], "doc_id long, text string, k1 string, copies int, dropped array<int>")
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(df, min_chars=chars, min_docs=docs).collect()), key=repr)


def test_against_brute_force_with_odd_rows(spark):
    rng = random.Random(2)
    pool = ["", " ", "short", "a" * 20, " A" + "a" * 19 + "\r", "Ä" * 20, "ä" * 20, "\x0b" + "b" * 20 + "\t", "b" * 19, "İ" + "c" * 19, "i" + "c" * 19, "\x85" + "d" * 20, "d" * 20, " " + "d" * 20]
    rows = [(rng.choice([*range(30), None]), "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for _ in range(60)]
    rows += [(5, None), (None, None), (6, ""), (7, "\n"), (8, "x" * 20 + "\n\n"), *[(9, "a" * 20 + "\n" + "k" * 30)] * 40, (50, "y\n" * 5000 + "a" * 20 + "\n" * 3)]
    assert run(spark, rows) == brute(rows, 20, 3)
    assert run(spark, rows, 5, 2) == brute(rows, 5, 2)
    assert run(spark, []) == []


@pytest.mark.parametrize("heavy", [1, 4, 10_000])
def test_broadcast_and_joined_keys_agree(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    rng = random.Random(heavy)
    rows = [(i, "\n".join(["common line of every document"] * (i % 3) + [f"line number {rng.randint(0, 40)} of some pages" for _ in range(5)])) for i in range(80)]
    rows += [(999, "a line that only one document repeats\n" * 300)] * 3
    assert run(spark, rows) == brute(rows, 20, 3)


def test_the_largest_document_keeps_every_repeat(spark):
    line = "the same twenty characters"
    got = run(spark, [(1, f"{line}\n{line}"), (3, f"{line}\nown\n {line} "), (2, line)])
    assert got == [(1, "", 2, 2), (2, "", 1, 1), (3, f"{line}\nown\n {line} ", 3, 0)]
    assert run(spark, [(1, line), (1, line), (2, line)]) == [(1, line, 1, 0), (1, line, 1, 0), (2, line, 1, 0)]
    assert run(spark, [(None, line), (None, f"{line}\n"), (1, line), (2, line)])[2:] == [(None, "", 1, 1), (None, "", 2, 1)]


def test_query_digests_the_text(spark):
    r = lines.op11_line_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    assert len(r.kept_sha256) == 64 and r.kept_sha256 != hashlib.sha256(b"").hexdigest()
