"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding.

Segmentation is the merge agenda of a BPE vocabulary: the best-scored adjacent pair that forms a piece is merged,
leftmost first among equals, until none is left. With dropout, a candidate merge (start, middle and end in its word)
is skipped when its hash falls below the rate. The hash is keyed by seed, text and the word's place in it, so every
occurrence of a word is cut on its own, and any rerun cuts it alike. No merge crosses from a letter to a space, so words
are independent.

What the agenda does with a word depends only on which candidates are skipped as they come up. Each worker keeps these
decisions as a bounded graph: a state knows its next candidate, and which state follows if it is merged or skipped. The
occurrences of a slice of texts walk the graph together, each with hashes of its own, and states that none has reached
before are computed together, as matrices with a column for each symbol. Very long words go through the same agenda one
by one. Characters outside the vocabulary, line breaks and literal U+2581 become byte pieces.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

U = np.uint64
MASK = (1 << 64) - 1
K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Words of up to so many characters walk a graph, one for each length; longer ones are merged alone.
LENGTHS = (4, 6, 8, 10, 13, 17, 24)
STATES = 250_000  # of all graphs of a worker; beyond that it starts anew
SLOT_BITS = 20
SLICE_CHARS = 400_000
WORD = re.compile(r" *[^ \n]+| +|\n")
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mixed(x: int) -> int:
    x &= MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = model.vocab_size()
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not kinds[i]}
        self.cost = np.array([-model.get_score(i) for i in range(n)], np.float32)
        byte_of = {i: int(model.id_to_piece(i)[3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in byte_of.items()}
        self.bytes = [bytes([byte_of[i]]) if i in byte_of else b"" if kinds[i] else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.char = np.arange(0x110000, dtype=np.int32) + n  # a character outside the vocabulary: n plus its code
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.char[ord(piece)] = i
        self.char[ord(" ")] = self.ids[SPACE]
        self.pairs = {self.ids[p[:k]] * n + self.ids[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.codes = np.array(sorted(self.pairs), np.int64)
        self.merged = np.array([self.pairs[c] for c in self.codes.tolist()], np.int32)

        slot = self.slot(self.codes)
        self.first, self.crowded = np.zeros(1 << SLOT_BITS, np.int32), np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.first[slot] = np.arange(len(slot))

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(U) * U(K[0]) >> U(64 - SLOT_BITS)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs form, or -1."""
        n = self.n
        code = np.where((left >= 0) & (right >= 0) & (left < n) & (right < n), left.astype(np.int64) * n + right, -1)
        slot = self.slot(code)
        at = self.first[slot]
        fits = self.codes[at] == code
        more = self.crowded[slot] & ~fits
        if more.any():
            at[more] = np.minimum(np.searchsorted(self.codes, code[more]), len(self.codes) - 1)
            fits = self.codes[at] == code
        return np.where(fits, self.merged[at], -1)

    def packed(self, ids: np.ndarray) -> bytes:
        """int32 ids, with characters outside the vocabulary as byte pieces."""
        if (ids < self.n).all():
            return ids.astype(np.int32).tobytes()
        out: list[int] = []
        for i in ids.tolist():
            out += [i] if i < self.n else [self.byte_id[b] for b in chr(i - self.n).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def agenda(v: Vocabulary, word: str, key: int, below: int) -> bytes:
    """One word by a heap of candidate merges."""
    sym = v.char[codes_of(word)].tolist()
    n = len(sym)
    start, end, left, right, heap = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1], []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (to := v.pairs.get(sym[i] * v.n + sym[j] if max(sym[i], sym[j]) < v.n else -1)) is not None:
            if mixed(key + start[i] * K[0] + start[j] * K[1] + end[j] * K[2]) >= below:
                heapq.heappush(heap, (float(v.cost[to]), start[i], end[j], i, j, to))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, s, e, i, j, to = heapq.heappop(heap)
        if sym[i] < 0 or sym[j] < 0 or start[i] != s or end[j] != e or right[i] != j:
            continue
        sym[i], end[i], right[i], sym[j] = to, end[j], right[j], -1
        if right[i] >= 0:
            left[right[i]] = i
        offer(left[i], i)
        offer(i, right[i])
    return v.packed(np.array([s for s in sym if s >= 0], np.int64))


def hashed(x: np.ndarray) -> np.ndarray:
    """mixed(), by element."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Graph:
    """States of the agenda for words of at most `n` characters, a column for each character.

    A symbol stands at its first character. Of a state: its symbols (-1: none), where the next and the one before stand,
    the cost of merging each with the next (infinite: no piece, or skipped), the salt of its next candidate, the states
    after merging (0) and after skipping it (1), or, where no candidate is left, the place and number of its ids in `pool`.
    """

    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n, self.used, self.filled = v, n, 0, 0
        self.sym, self.next, self.last = np.empty((1024, n + 1), np.int32), np.empty((1024, n + 1), np.uint8), np.empty((1024, n + 1), np.uint8)
        self.cost, self.best, self.salt = np.empty((1024, n), np.float32), np.empty(1024, np.int8), np.empty(1024, U)
        self.after, self.done, self.at, self.size = np.empty((1024, 2), np.int32), np.empty(1024, bool), np.empty(1024, np.int64), np.empty(1024, np.int32)
        self.pool = np.empty(4096, np.int32)

    def add(self, sym: np.ndarray, next_: np.ndarray, last: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """New states."""
        a, b = self.used, self.used + len(sym)
        self.used = b
        if b > len(self.salt):
            for name in ("sym", "next", "last", "cost", "best", "salt", "after", "done", "at", "size"):
                old = getattr(self, name)
                wider = np.empty((max(b, 3 * len(old) // 2), *old.shape[1:]), old.dtype)
                wider[:a] = old[:a]
                setattr(self, name, wider)
        row = np.arange(len(sym))
        best = cost.argmin(1)
        done = cost[row, best] == np.inf
        mid = next_[row, best]
        self.sym[a:b], self.next[a:b], self.last[a:b], self.cost[a:b], self.best[a:b], self.done[a:b], self.after[a:b] = sym, next_, last, cost, best, done, -1
        self.salt[a:b] = best.astype(U) * U(K[0]) + mid.astype(U) * U(K[1]) + next_[row, mid].astype(U) * U(K[2])
        if done.any():
            ends = sym[done]
            has = ends >= 0
            size, ids = has.sum(1), ends[has]
            if len(ids) and ids.max() >= self.v.n:
                cut = [np.frombuffer(self.v.packed(x), np.int32) for x in np.split(ids, np.cumsum(size)[:-1])]
                size, ids = np.array([len(x) for x in cut]), np.concatenate(cut)
            self.at[a:b][done] = self.filled + np.cumsum(size) - size
            self.size[a:b][done] = size
            if self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.filled], np.empty(max(len(self.pool) // 2, len(ids)), np.int32)])
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
        return np.arange(a, b)

    def costs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        to = self.v.join(left, right)
        return np.where(to >= 0, self.v.cost[to], np.float32(np.inf))

    def roots(self, words: list[str]) -> np.ndarray:
        """First states of new words."""
        n, long = self.n, np.fromiter(map(len, words), np.int64, len(words))
        sym = np.full((len(words), n + 1), -1, np.int32)
        sym[np.arange(n + 1) < long[:, None]] = self.v.char[codes_of("".join(words))]
        place = np.broadcast_to(np.arange(n + 1, dtype=np.uint8), sym.shape)
        return self.add(sym, np.minimum(place + np.uint8(1), long[:, None]).astype(np.uint8), np.maximum(place, 1) - np.uint8(1), self.costs(sym[:, :n], sym[:, 1:]))

    def grow(self, states: np.ndarray, skips: np.ndarray) -> None:
        """Computes what follows `states` if their candidate is skipped or merged."""
        sym, next_, last, cost, k = self.sym[states], self.next[states], self.last[states], self.cost[states], self.best[states]
        cost[np.arange(len(states)), k] = np.inf
        m = np.nonzero(~skips)[0]
        k = k[m]
        mid = next_[m, k]
        end = next_[m, mid]
        to = self.v.join(sym[m, k], sym[m, mid])
        sym[m, k], sym[m, mid], next_[m, k], last[m, end] = to, -1, end, k
        inside = mid < self.n
        cost[m[inside], mid[inside]] = np.inf
        cost[m, k] = self.costs(to, sym[m, end])
        some = k > 0
        m, k, to = m[some], k[some], to[some]
        before = last[m, k]
        cost[m, before] = self.costs(sym[m, before], to)
        self.after[states, skips.astype(np.int8)] = self.add(sym, next_, last, cost)

    def walk(self, state: np.ndarray, key: np.ndarray, below: int) -> np.ndarray:
        """The last state of each occurrence, from the first state of its word."""
        out, live = np.empty(len(state), np.int64), np.arange(len(state))
        while len(live):
            done = self.done[state]
            if done.any():
                out[live[done]] = state[done]
                live, state, key = live[~done], state[~done], key[~done]
            skips = hashed(key + self.salt[state]) < U(below)
            step = state * 2 + skips
            to = self.after.ravel()[step]
            new = np.nonzero(to < 0)[0]
            if len(new):
                step, mark = step[new], -2 - np.arange(len(new), dtype=np.int32)
                self.after.ravel()[step] = mark
                one = step[self.after.ravel()[step] == mark]  # each step once
                self.grow(one >> 1, (one & 1).astype(bool))
                to[new] = self.after.ravel()[step]
            state = to.astype(np.int64)
        return out


class Encoder:
    def __init__(self, path: str, dropout: float, seed: int):
        self.v, self.below, self.seed = vocabulary(path), int(dropout * 2**64) if dropout < 1 else MASK, seed
        self.forget()

    def forget(self) -> None:
        self.graphs = [Graph(self.v, n) for n in LENGTHS]
        self.memo: dict[str, int] = {}  # a word's first state times 8 plus its graph, or -2 for one to be merged alone

    def learn(self, words: set[str]) -> None:
        by_length: list[list[str]] = [[] for _ in range(len(LENGTHS) + 1)]
        for w in words:
            by_length[bisect_left(LENGTHS, len(w))].append(w)
        for size, (graph, own) in enumerate(zip(self.graphs, by_length)):
            for at in range(0, len(own), 50_000):
                some = own[at : at + 50_000]
                self.memo.update(zip(some, (graph.roots(some) * 8 + size).tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if sum(g.used for g in self.graphs) > STATES:
            self.forget()
        cut = [WORD.findall(" " + t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        words = [w for ws in cut for w in ws]
        first = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), self.seed & MASK) for t in texts), U, len(texts))
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = hashed(np.repeat(first, sizes) + place.astype(U) * U(K[0]))
        self.learn(set(words).difference(self.memo))
        known = np.fromiter(map(self.memo.get, words, repeat(-2)), np.int64, len(words))

        start, size, pools, filled = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for k, graph in enumerate(self.graphs):
            own = np.nonzero((known >= 0) & (known & 7 == k))[0]
            if len(own):
                last = graph.walk(known[own] >> 3, key[own], self.below)
                start[own], size[own] = graph.at[last] + filled, graph.size[last]
            pools.append(graph.pool[: graph.filled])
            filled += graph.filled
        for i in np.nonzero(known == -2)[0].tolist():
            ids = np.frombuffer(agenda(self.v, words[i], int(key[i]), self.below), np.int32)
            pools.append(ids)
            start[i], size[i] = filled, len(ids)
            filled += len(ids)
        ends = np.cumsum(size)
        ids = np.concatenate([*pools, np.empty(0, np.int32)])[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(sizes)][:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """One row per row of `df`: doc_id, n_tokens, ids and lossless (the ids decode to the very text).

    A null text has null ids and 0 tokens, and lossless is true; an empty text has no ids. Words of any length and
    whole texts are encoded; memory is bounded by STATES, a slice of texts and the longest text. Nothing is
    shuffled. Rows with equal texts get equal ids. Other columns are not read. With dropout 0 the result is the
    vocabulary's plain segmentation.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, dropout, seed)  # of one task: an idle worker holds no graphs
        for b in batches:
            at = 0
            while at < len(b):
                texts, chars = [], 0
                while at + len(texts) < len(b) and chars < SLICE_CHARS:
                    texts.append(b["text"][at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                ids = coder.encode([t or "" for t in texts])
                fine = [t is None or coder.decode(i) == t for t, i in zip(texts, ids, strict=True)]
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(texts)), pa.array(sizes, pa.int64()), lists, pa.array(fine)], ["doc_id", "n_tokens", "ids", "lossless"])
                at += len(texts)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
