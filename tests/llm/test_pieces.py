import random

import numpy as np
import pytest
import sentencepiece

from attestra.llm import pieces

PATH = pieces.default_model()
ODD = ["", " ", "  two  spaces ", "line\nbreaks\n\n end\n", "tab\tand\rcr", "▁literal▁", "<s></s><unk><0x0A>", "é ß ñ ü œ", "日本語テキスト", "😀👩‍👩‍👧 ①ﬁ", "\x00\x01", "a" * 700, " " * 40 + "x", "the same the same the same", "é combining"]


def texts(n=200):
    rng = random.Random(3)
    return ODD + [" ".join("".join(rng.choice(["th", "er", "on", "é", "ing", "Q", "7", "."]) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_no_dropout_is_the_plain_segmentation():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coder = pieces.Encoder(PATH, 0.0, 1)
    plain = [t for t in texts() if "▁" not in t]
    for t, ids in zip(plain, coder.encode(plain)):
        assert ids.tolist() == model.encode(t), t


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_is_lossless_and_both_ways_of_merging_agree(dropout, monkeypatch):
    fast = pieces.Encoder(PATH, dropout, 7)
    got = fast.encode(texts())
    assert [fast.decode(i) for i in got] == texts()
    monkeypatch.setattr(pieces, "LENGTHS", ())
    slow = pieces.Encoder(PATH, dropout, 7)
    assert all(np.array_equal(a, b) for a, b in zip(got, slow.encode(texts())))


def test_segmentations_vary_and_repeat():
    same = [" ".join(["understanding"] * 400)]
    a, b, c = (pieces.Encoder(PATH, 0.3, s).encode(same)[0].tolist() for s in (1, 1, 2))
    assert a == b and a != c
    coder = pieces.Encoder(PATH, 0.3, 1)
    ids = coder.encode(same)[0]
    cuts, at = [[]], 0
    for i in ids.tolist():  # one list for each occurrence
        cuts[-1].append(i)
        at += len(coder.v.bytes[i])
        if at % len(" understanding") == 0:
            cuts.append([])
    assert len(cuts) == 401 and len({tuple(x) for x in cuts[:-1]}) > 40  # no set number of ways to cut a word
    other = coder.encode(["another text: " + same[0]])[0].tolist()
    assert other[-len(ids) :] != ids.tolist()


def test_states_that_are_forgotten_change_nothing(monkeypatch):
    want = [x.tolist() for x in pieces.Encoder(PATH, 0.2, 3).encode(texts())]
    monkeypatch.setattr(pieces, "STATES", 50)
    coder = pieces.Encoder(PATH, 0.2, 3)
    assert [coder.encode([t])[0].tolist() for t in texts()] == want
    assert coder.encode([]) == [] and [x.tolist() for x in coder.encode(["", ""])] == [[], []]


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(30))] + [(5, None, "x"), (None, "a b", "x"), (5, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = pieces.encode(df).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert [r.n_tokens for r in got if r.ids is None] == [0]
    assert pieces.encode(df.limit(0)).collect() == []
