"""Scoring texts with a probabilistic suffix tree over words.

The root is the add-one distribution of single tokens. A node is a context of one to DEPTH preceding words. It is kept
when it occurs LEAST times and a divergence test passes: the log likelihood that its own next-word distribution gains
over its parent's, per occurrence, reaches DIVERGENCE. A node stores the next words seen LEAST times in it; their counts
are discounted and the rest of the mass goes to the parent's distribution, so every node's distribution sums to one. A
token is scored in the longest kept suffix of its context.

Counts cover all training documents, and nothing is left out for being rare in a large corpus: the tree is in tables,
keyed by 64-bit hashes of word sequences, and grows with the corpus. A text's gain over the root is a sum over its word
sequences: each adds what it stores as a next word, over what its parent gives, and the mass that it leaves as a
context. So a text needs one look-up for each of its sequences. Tasks hold the frequent ones and a filter of fixed size
that tells most sequences without entry; the others are listed with the text and found by joins, a lot of hashes at a
time, so that only a lot's share of them is on the way between tasks. These only decide where an entry is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import words
from attestra.llm.filters import Filter
from attestra.plans.staging import spent, staged

U = np.uint64
LEAST = 3  # occurrences of contexts and stored next words
DIVERGENCE = 0.01  # nats
DISCOUNT = 0.75
DEPTH = 3
HOT_WORDS, HOT_SEQUENCES = 1_000_000, 2_000_000  # so many of the most frequent are looked up in tasks, at most
FOLDS, HELD = 7, 2
POSITIONS = 4_000_000  # that a task counts together
LOTS = 8  # of hashes, by their low bits; what tasks do not hold is looked up one lot after another
STEP = U(0x9E3779B97F4A7C15)  # odd; the hash of a sequence is that of all but its last word * STEP + that of the last
END = U(0x51A7E5EE0DD5EED5)  # stands for the hash of the end token


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


def positions(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place in its text from 1, and text of each token: the words of each text, then the end."""
    parts = [words.hashes(some) for _, some in words.slices(texts)] or [(np.empty(0, U), np.empty(0, np.int64))]
    word, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = sizes + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full(len(text), END)
    out[place < sizes[text]] = word
    return out, place, text


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, size = [], 0

    def give() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate([np.empty(0, U), *found]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    for b in batches:
        for k in range(0, len(b), 500):
            found.append(positions(b["text"].slice(k, 500))[0])
            size += len(found[-1])
            if size > POSITIONS:
                yield give()
                found, size = [], 0
    yield give()


class Sparse:
    """Sorted int64 codes with values each."""

    def __init__(self, codes: np.ndarray, *values: np.ndarray):
        codes, first = np.unique(codes, return_index=True)
        self.codes, self.values = np.append(codes, np.int64(2**62)), tuple(np.append(v[first], 0.0) for v in values)

    @cached_property
    def slots(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Made where it is used: for the high bits of a mixed code, where one such code is and whether there are more."""
        bits = max(10, len(self.codes).bit_length() + 1)
        slot = (self.codes.view(U) * STEP >> U(64 - bits)).astype(np.int64)
        first = np.zeros(1 << bits, np.int32)
        first[slot] = np.arange(len(slot))
        return bits, first, np.bincount(slot, minlength=1 << bits) > 1

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code is, and whether it is there."""
        bits, first, crowded = self.slots
        slot = (codes.view(U) * STEP >> U(64 - bits)).astype(np.int64)
        at = first[slot]
        ok = self.codes[at] == codes
        more = np.nonzero(crowded[slot] & ~ok)[0]
        if len(more):
            at[more] = np.minimum(np.searchsorted(self.codes[:-1], codes[more]), len(self.codes) - 1)
            ok[more] = self.codes[at[more]] == codes[more]
        return at, ok & (at < len(self.codes) - 1)


def longer(key: np.ndarray, run: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `size` words up to each position, from those of one word less, and whether there are so many."""
    out = np.zeros(len(word), U)
    out[1:] = key[:-1] * STEP + word[1:]
    return out, run >= size


def frequent(table: DataFrame, most: int, least: int) -> int:
    """The least n, `least` at least, that no more than `most` rows of `table` reach."""
    by_n = table.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("rows"))
    above = Window.orderBy(F.col("n").desc())  # a row for each count that occurs
    fits = by_n.withColumn("upto", F.sum("rows").over(above)).where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return least if fits is None and by_n.isEmpty() else (fits or 2**62)


@dataclass
class Tree:
    """Frequent words with their log10 root probabilities, and frequent sequences by their hash.

    hot has the sum of log10 of the mass that a sequence leaves as a context, and of what it adds as a next word to its
    parent's probability and that mass.
    """

    root: Sparse
    unit: float  # log10 of the denominator of the root
    hot: Sparse | None = None


def _counter(filter_of, depth: int):
    """Counts of (context of `depth` words, next); leaves out what has a part that occurs less than LEAST times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = filter_of.value
        found, size = [], 0

        def give() -> pa.RecordBatch:
            context, word = (np.concatenate([np.empty(0, U), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
            _, first, n = np.unique(context * STEP + word, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(context[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array(n.astype(np.int64))], ["context", "next", "n"])

        for b in batches:
            for k in range(0, len(b), 500):
                word, place, _ = positions(b["text"].slice(k, 500))
                key = word
                for d in range(2, depth + 1):
                    key, _ = longer(key, place, word, d)
                often = known.may_have(key)
                here = np.nonzero((place[1:] > depth) & often[:-1] & often[1:])[0] + 1
                found.append((key[here - 1], word[here]))
                size += len(here)
                if size > POSITIONS:
                    yield give()
                    found, size = [], 0
        yield give()

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of a context with its next word, and that of its parent with it."""
    for b in batches:
        context, parent, word = (b[c].to_numpy(zero_copy_only=False).view(U) for c in ("context", "parent", "next"))
        both = [pa.array((x * STEP + word).view(np.int64)) for x in (context, parent)]
        yield pa.RecordBatch.from_arrays([*b.columns, *both], [*b.schema.names, "key", "parent_key"])


def _tested(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept contexts (key, mass), and `grams` with value (log10 over the root's) and delta (0: in no kept context).

    grams: context, next, n, c (of the context), root and under (log10 of the root's and the parent's over the root's).
    """
    share = (F.col("n") - DISCOUNT) / F.col("c")
    rest = grams.groupBy("context").agg(F.greatest(F.lit(1e-12), 1 - F.sum(share)).alias("rest"))
    own = F.log10(share + F.col("rest") * F.pow(F.lit(10.0), F.col("root") + F.col("under"))) - F.col("root")
    grams = staged(grams.join(rest, "context").withColumn("own", own))
    better = F.sum(F.col("n") * (F.col("own") - F.col("under"))) + (F.first("c") - F.sum("n")) * F.log10(F.first("rest"))
    kept = grams.groupBy("context").agg((better * math.log(10) >= DIVERGENCE * F.first("c")).alias("kept"), F.log10(F.first("rest")).alias("mass"))
    kept = staged(kept.where("kept").select(F.col("context").alias("key"), "mass"))
    first = grams
    grams = grams.join(kept.withColumnRenamed("key", "context"), "context", "left")
    value, delta = F.when(F.col("mass").isNull(), F.col("under")).otherwise(F.col("own")), F.coalesce(F.col("own") - F.col("under") - F.col("mass"), F.lit(0.0))
    grams = staged(grams.select("key", "parent_key", "next", "n", "root", value.alias("value"), delta.alias("delta")))
    spent(first)
    return kept, grams


def grow(docs: DataFrame) -> tuple[Tree, DataFrame, DataFrame, int, tuple[DataFrame, ...]]:
    """The frequent part, all sequences (key, n, mass, delta, hot), the tokens (key, n, hot), their total in `docs` (text),
    and the tables to delete in the end."""
    spark = docs.sparkSession
    table = staged(docs.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unit = math.log10(total + distinct + 1)
    hot_word = frequent(table, HOT_WORDS, 1)
    often = table.where(F.col("n") >= hot_word).toArrow()
    tree = Tree(Sparse(often["key"].to_numpy(), np.log10(often["n"].to_numpy() + 1.0) - unit), unit)
    del often
    zero = F.lit(0.0)
    before = table.where(F.col("n") >= LEAST).select("key", F.lit(0).cast("long").alias("parent_key"), F.col("key").alias("next"), "n", (F.log10(F.col("n") + 1) - unit).alias("root"), zero.alias("value"), zero.alias("delta"))
    sequences, parts = [], []
    for depth in range(1, DEPTH + 1):
        sent = spark.sparkContext.broadcast(Filter(before))
        nexts = docs.mapInArrow(_counter(sent, depth), "context long, next long, n long").groupBy("context", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        contexts = before.where(F.col("next") != int(END.view(np.int64))).select(F.col("key").alias("context"), F.col("parent_key").alias("parent"), F.col("n").alias("c"))
        grams = nexts.join(contexts, "context").mapInArrow(_keyed, "context long, next long, n long, parent long, c long, key long, parent_key long")
        kept, grams = _tested(grams.join(before.select(F.col("key").alias("parent_key"), "root", F.col("value").alias("under")), "parent_key"))
        sequences.append(before.join(kept, "key", "left").select("key", "n", F.coalesce("mass", zero).alias("mass"), "delta", F.lit(depth).alias("size")))
        before = grams
        parts += [kept, grams]
    sequences = reduce(DataFrame.unionByName, [*sequences, before.select("key", "n", zero.alias("mass"), "delta", F.lit(DEPTH + 1).alias("size"))])
    whole = staged(sequences)
    spent(*parts)
    sequences = whole.withColumn("hot", F.col("n") >= frequent(whole.where("mass + delta <> 0"), HOT_SEQUENCES, LEAST))
    held = sequences.where("hot and mass + delta <> 0").select("key", (F.col("mass") + F.col("delta")).alias("value")).toArrow()
    tree.hot = Sparse(held["key"].to_numpy(), held["value"].to_numpy())
    del held
    pa.default_memory_pool().release_unused()  # the driver's memory is small
    return tree, sequences, table.withColumn("hot", F.col("n") >= hot_word), total, (table, whole)


NAMES = ["doc_id", "n_tokens", "n_known", "base", "gain", *[f"keys_{lot}" for lot in range(LOTS)]]
SCORED = "doc_id long, n_tokens long, n_known long, base double, gain double" + "".join(f", {c} array<long>" for c in NAMES[5:])


def _score(sent_):
    """Sums by what tasks hold, and the keys of each text that may have an entry elsewhere, by lot, as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, cold = sent_.value
        root = tree.root
        value = tree.hot.values[0]
        for b in batches:
            for k in range(0, len(b), 500):
                word, place, text = positions(b["text"].slice(k, 500))
                docs = len(b["text"].slice(k, 500))
                gain, asked, key = np.zeros(docs), [], word
                for size in range(1, DEPTH + 2):
                    if size > 1:
                        key, _ = longer(key, place, word, size)
                    here = np.nonzero(place >= size)[0]
                    found = key[here]
                    at, ok = tree.hot.find(found.view(np.int64))
                    gain += np.bincount(text[here[ok]], value[at[ok]], docs)
                    missing = ~ok
                    if size == 1:  # a word below LEAST has no entry in `hot`, but a root probability
                        at, ok = root.find(found.view(np.int64))
                        base = np.bincount(text, np.where(ok, root.values[0][at], -tree.unit), docs)
                        known = np.bincount(text[ok], minlength=docs)
                        missing |= ~ok
                    more = np.nonzero(missing & cold.may_have(found))[0]
                    asked.append((text[here[more]], found[more]))
                doc, keys = (np.concatenate(x) for x in zip(*asked, strict=True))
                lot = (keys & U(LOTS - 1)).astype(np.int64)
                place = lot * docs + doc
                keys = keys[np.argsort(place, kind="stable")].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=LOTS * docs))])
                cuts = [ends[lot * docs : (lot + 1) * docs + 1] for lot in range(LOTS)]
                lists = [pa.ListArray.from_arrays(pa.array(c - c[0], pa.int32()), pa.array(keys[c[0] : c[-1]])) for c in cuts]
                numbers = [pa.array(x) for x in (np.bincount(text, minlength=docs), known, base, gain)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(k, docs), *numbers, *lists], NAMES)

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from rows that are not held out. Scores are sums of log10 probabilities; an unseen word takes the root's
    share of one unseen word. Null and empty texts are one end token. Rows with equal id and text are scored alike and
    all returned; equal ids with other texts are rows of their own. Without training rows every token is unseen. An
    empty table gives no rows. Other columns are not read.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    tree, sequences, table, total, tables = grow(docs.where(~held_out(F.col("doc_id"))).select("text"))
    cold = sequences.where("not hot and mass + delta <> 0")
    rare = table.where("not hot").select("key", F.lit(1).alias("known"), (F.log10(F.col("n") + 1)).alias("base"), F.lit(0.0).alias("value"))
    entries = rare.unionByName(cold.select("key", F.lit(0).alias("known"), F.lit(0.0).alias("base"), (F.col("mass") + F.col("delta")).alias("value")))
    sent = df.sparkSession.sparkContext.broadcast((tree, Filter(entries)))
    parts = staged(docs.mapInArrow(_score(sent), SCORED).withColumn("row", F.monotonically_increasing_id()))
    lots = []
    for lot in range(LOTS):  # the shuffle files of a lot go before the next one's are written
        there = entries.where(F.col("key").bitwiseAND(LOTS - 1) == lot).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("known", "base", "value")])
        asked = parts.select("row", F.explode(f"keys_{lot}").alias("key")).join(there, "key")
        lots.append(staged(asked.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("value").alias("value"))))
    more = reduce(DataFrame.unionByName, lots).groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("value").alias("more_gain"))
    more, numbers = staged(more), staged(parts.drop(*NAMES[5:]))
    spent(*tables, *lots, parts)
    parts = numbers
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    base = plus("base", "more_base")
    return parts.join(more, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + plus("gain", "more_gain")).alias("score"),
    )


def op6_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
