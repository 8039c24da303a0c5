import random

import numpy as np
import pyarrow as pa

from attestra.llm import words


def test_words_are_those_of_split_and_hash_alike():
    rng = random.Random(4)
    bits = ["a", "B", "é", "É", "日", "\x1c", " ", "\n", "\t ", "\x0b", "\x0c\r", "zz", "0", " ", "😀"]
    texts = [None, "", " ", "a", "A ", " a", "ab ba aab aba baa", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)), "long " * 40_000]
    got = [words.hashes(some) for _, some in words.slices(pa.array(texts)[1:])]
    h, n = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
    want = [(t or "").encode().lower().split() for t in texts[1:]]
    assert n.tolist() == [len(w) for w in want]
    by_word = {}
    for w, x in zip((w for ws in want for w in ws), h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word) > 500
    for none in (pa.array([], pa.string()), pa.array([None, None], pa.string())):
        assert words.hashes(none)[1].tolist() == [0] * len(none)
