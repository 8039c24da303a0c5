import random

import numpy as np

from attestra.llm import toxicity

WORDS = [f"word{i}" for i in range(300)]


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) if bad else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "scum!!", "zorgle", "ZORGLE,", "flimp"]))
        docs.append((i, " ".join(ws), "x"))
        if rng.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_finds_mined_and_listed_words_on_rows_held_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    truth = {i: any(w in t.lower() for w in ("idiot", "scum", "zorgle", "flimp")) for i, t, _ in docs}
    held = [i for i in truth if got[i].held_out]
    assert 60 < len(held) < 200
    wrong = sum(truth[i] != bool(got[i].predicted) for i in held)
    assert wrong <= 0.04 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_mines_stems_of_inflected_words(spark):
    rng = random.Random(9)
    rows = [(i, " ".join([rng.choice(WORDS) for _ in range(30)] + (["Grumpf" + rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(2)] if i % 6 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 6 == 0) for r in got)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    import zlib

    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.toxicity(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect() for x in (labels, other))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows_no_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None), (None, ""), (2, "you idiot, you stupid moron"), (2, "fine " * 50_000), (3, "a calm text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(df.limit(0), labels).collect() == []
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.toxicity(df, odd).collect()) == 5
    assert toxicity.clean(df, odd).columns == df.columns


def test_correlated_voters_are_trusted_less():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    v = np.stack([np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.1) for _ in range(4)], 1).astype(float)
    v[:, 3] = np.where(rng.random(4000) < 0.95, v[:, 2], v[:, 3])  # almost a copy
    model = toxicity.Model([], [])
    pats, at = np.unique(v, axis=0, return_inverse=True)
    counts = np.zeros((len(pats), 3))
    at = at.ravel()
    np.add.at(counts, (at, np.where(np.arange(4000) < 1500, 1 + y, 0)), 1)
    toxicity.fit_label_model(model, pats, counts)
    assert model.trust[2] < 0.75 and model.trust[3] < 0.75 and model.trust[0] > 0.85
    assert abs(model.hit[1][0] - 0.7) < 0.1 and abs(model.hit[0][0] - 0.1) < 0.05


def test_votes_and_vectors_of_a_batch_are_those_of_each_row():
    import numpy as np
    import pandas as pd

    terms = ["a", "b", "c", "d"]
    model = toxicity.Model(terms, [frozenset({0, 1}), frozenset({2}), frozenset()])
    rows = [([0, 2], [1, 3], 0, 1, 50), ([], [], 2, 0, 0), ([1], [1], 0, 0, 1000), ([0, 1, 2, 3], [1, 1, 1, 1], 1, 1, 4)]
    f = pd.DataFrame(rows, columns=["terms", "counts", "bangs", "shouts", "words"])
    for r, votes, x in zip(rows, model.votes(f).tolist(), model.vectors(f), strict=True):
        t, c, bangs, shouts, words = r
        total = sum(c)
        assert votes == [int(bool(v & set(t))) for v in model.voters] + [int(bangs > 0), int(shouts > 0), int(max(c, default=0) > 1), int(100 * total >= words > 0 and total > 0)]
        want = [np.log1p(dict(zip(t, c)).get(k, 0)) for k in range(4)] + [1, np.log1p(total), np.log1p(len(t)), min(1, 100 * total / max(words, 1)), np.log1p(bangs), np.log1p(shouts), total > 0]
        assert np.allclose(x, want)
    assert model.votes(f[:0]).shape == (0, 7) and model.vectors(f[:0]).shape == (0, 11)


def test_clean_rows_keep_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a calm text", 9, "mine"), (2, None, 8, "mine")], "doc_id long, text string, score int, _score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.clean(docs, labels)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a calm text", 9, "mine"), (2, None, 8, "mine")]


def test_label_model_equals_a_row_by_row_version():
    import math

    rng = random.Random(7)
    k, rows = 4, []
    for _ in range(400):
        toxic = rng.random() < 0.3
        v = [int(rng.random() < p) for p in ((0.8, 0.6, 0.5, 0.4) if toxic else (0.05, 0.1, 0.1, 0.3))]
        v[1] = v[0] if rng.random() < 0.5 else v[1]  # two voters that agree beyond the class
        rows.append((tuple(v), rng.choice([None, None, int(toxic)])))
    patterns = sorted({v for v, _ in rows})
    counts = np.array([[sum(v == p and known == s for v, known in rows) for s in (None, 0, 1)] for p in patterns], float)
    model = toxicity.Model([], [])
    toxicity.fit_label_model(model, np.array(patterns, float), counts, rounds=5)

    known = [s for _, s in rows if s is not None]
    prior = sum(known) / len(known)
    hit = [[(sum(v[j] for v, s in rows if s == c) + 0.5) / (known.count(c) + 1) for j in range(k)] for c in (0, 1)]
    trust = [1.0] * k
    for _ in range(5):
        mass = []
        for v, s in rows:
            odds = math.log(prior / (1 - prior)) + sum(t * math.log(hit[1][j] / hit[0][j] if x else (1 - hit[1][j]) / (1 - hit[0][j])) for j, (x, t) in enumerate(zip(v, trust)))
            q = 1 / (1 + math.exp(-odds)) if s is None else s
            mass.append((1 - q, q))
        total = [sum(m[c] for m in mass) for c in (0, 1)]
        prior = min(total[1] / sum(total), 0.5)
        hit = [[(sum(m[c] * v[j] for m, (v, _) in zip(mass, rows)) + 0.5) / (total[c] + 1) for j in range(k)] for c in (0, 1)]
        shared = [[0.0] * k for _ in range(k)]
        for c in (0, 1):
            for i in range(k):
                for j in range(k):
                    if i != j:
                        cov = sum(m[c] * (v[i] - hit[c][i]) * (v[j] - hit[c][j]) for m, (v, _) in zip(mass, rows)) / max(total[c], 1)
                        shared[i][j] += cov / math.sqrt(hit[c][i] * (1 - hit[c][i]) * hit[c][j] * (1 - hit[c][j])) / 2
        trust = [1 / (1 + sum(min(1.0, max(0.0, x)) for x in r)) for r in shared]
    assert abs(model.prior - prior) < 1e-9 and np.allclose(model.hit, hit) and np.allclose(model.trust, trust)
    assert trust[0] < 0.85 and trust[3] > 0.9
