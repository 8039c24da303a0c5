import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from attestra.llm import suffix_tree as st


def corpus(n=500):
    rng = random.Random(2)
    after = {f"w{i}": [f"w{rng.randint(0, 40)}" for _ in range(3)] for i in range(41)}
    rows = []
    for i in range(n):
        w, ws = f"w{rng.randint(0, 40)}", []
        for _ in range(rng.randint(0, 60)):
            ws.append(w if rng.random() > 0.03 else f"Rare{i}{rng.randint(0, 9)}")
            w = rng.choice(after[w])
        rows.append((i, " ".join(ws).replace(" ", "\t", 1)))
    return rows + [(1000, None), (1001, ""), (1002, "unseen words only"), (3, "a second text of this id"), (5, "twice"), (5, "twice"), (None, "w1 w2"), (1003, "w1 W2 " * 5000)]


END = b""


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


class Brute:
    """The tree by its definition: contexts as tuples of words."""

    def __init__(self, texts):
        self.n = [Counter() for _ in range(st.DEPTH + 1)]
        for t in texts:
            ws = tokens(t)
            for d in range(st.DEPTH + 1):
                self.n[d].update(tuple(ws[i - d : i + 1]) for i in range(d, len(ws)))
        self.total, self.distinct = sum(self.n[0].values()), len(self.n[0])
        self.kept = {}
        for d in range(1, st.DEPTH + 1):
            nexts = defaultdict(dict)
            for gram, n in self.n[d].items():
                if n >= st.LEAST:
                    nexts[gram[:-1]][gram[-1]] = n
            for context, found in nexts.items():
                c = self.n[d - 1][context]
                rest = max(1e-12, 1 - sum((n - st.DISCOUNT) / c for n in found.values()))
                own = {w: (n - st.DISCOUNT) / c + rest * self.p(context[1:], w) for w, n in found.items()}
                better = sum(n * math.log(own[w] / self.p(context[1:], w)) for w, n in found.items()) + (c - sum(found.values())) * math.log(rest)
                if better >= st.DIVERGENCE * c:
                    self.kept[context] = (own, rest)

    def p(self, context, word):
        if not context:
            return (self.n[0][(word,)] + 1) / (self.total + self.distinct + 1)
        if context not in self.kept:
            return self.p(context[1:], word)
        own, rest = self.kept[context]
        return own[word] if word in own else rest * self.p(context[1:], word)

    def score(self, text):
        ws = tokens(text)
        return sum(math.log10(self.p(tuple(ws[max(0, i - st.DEPTH) : i]), w)) for i, w in enumerate(ws))


def test_score_is_that_of_the_tree_by_its_definition(spark):
    rows = [(i, t) for i, t in corpus() if i is not None] + [(2000 + i, "q1 q2 q3 q4 q5") for i in range(6)]
    brute = Brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    assert {len(c) for c in brute.kept} == {1, 2, 3}
    for context in random.Random(1).sample(sorted(brute.kept), 20):  # a distribution: all known words, and one unseen word
        assert sum(brute.p(context, w) for (w,) in brute.n[0]) + brute.p(context, b"never seen") == pytest.approx(1, abs=1e-9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in st.score_texts(df).collect())
    want = sorted((i, len(tokens(t)), brute.score(t)) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_base_score_counts_and_gain(spark):
    rows = corpus()
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for (_, t), o in zip(rows, out) if not o for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, o, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 6)) for (i, t), o in zip(rows, out))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    got = st.score_texts(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert len(held) > 30
    better = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert better > 0.5  # three followers of equal chance against 41 words


def test_no_training_rows_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = st.score_texts(df).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert st.score_texts(df.limit(0)).collect() == []


def test_rare_contexts_of_a_large_corpus_are_kept_and_found(spark, monkeypatch):
    texts = ["q1 q2 q3 q4 q5"] * 7 + [" ".join(f"f{i}" for i in range(k, k + 200)) for k in range(0, 2000, 200)]
    docs = spark.createDataFrame([(next(i for i in range(20 * k, 20 * k + 20) if zlib.crc32(str(i).encode()) % 7 != 2), t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = {r.doc_id: r.score for r in st.score_texts(docs).collect()}
    for hot in ((0, 0), (3, 0), (0, 3), (3, 40)):  # as if the corpus were so large
        monkeypatch.setattr(st, "HOT_WORDS", hot[0])
        monkeypatch.setattr(st, "HOT_SEQUENCES", hot[1])
        got = {r.doc_id: (r.score, r.base_score) for r in st.score_texts(docs).collect()}
        assert {i: s for i, (s, _) in got.items()} == pytest.approx(want)
        assert sum(s > b + 2 for s, b in got.values()) == 7


def test_what_tasks_do_not_hold_is_looked_up_in_lots(spark, monkeypatch):
    texts = ["q1 q2 q3 q4 q5"] * 7 + [" ".join(f"f{i}" for i in range(k, k + 100)) for k in range(0, 400, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.score for r in st.score_texts(docs).collect()}
    monkeypatch.setattr(st, "HOT_WORDS", 0)
    monkeypatch.setattr(st, "HOT_SEQUENCES", 0)
    lots, staged = {}, st.staged

    def watched(df):
        out = staged(df)
        for name in out.columns:
            if name.startswith("keys"):
                lots[name] = [k for r in out.select(name).collect() for k in r[0]]
        return out

    monkeypatch.setattr(st, "staged", watched)
    assert {r.doc_id: r.score for r in st.score_texts(docs).collect()} == pytest.approx(want)
    every = sum(map(len, lots.values()))
    assert every > 400 and max(map(len, lots.values())) < every / 3
    assert len({frozenset(k % 8 for k in keys) for keys in lots.values()}) == 8
