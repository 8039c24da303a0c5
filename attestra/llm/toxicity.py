"""Toxicity by weak supervision.

Many voters look at a document: lexicons by theme, lexicons mined from labelled rows, and patterns of layout. A
generative label model (a latent class with one hit rate for each voter and class) is fitted by expectation
maximisation to the counts of vote patterns over all documents that may be learned from; a voter that agrees with
others beyond what the class explains is discounted by those correlations. A linear classifier is then trained on the
model's posterior labels and scores every document. Text goes through Aho-Corasick once, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.plans.staging import staged

#: At most so many labelled rows, those of least hashed id, are looked at for mining and for training the classifier.
SAMPLE = 20_000
MINED = 48
SUPPORT = 0.02
STEMS = (4, 5)
MINED_VOTERS = 4
#: A known label counts as one more voter that is right so often.
LABEL_ACCURACY = 0.95
FOLDS = 5
LEXICONS = {
    "wits": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "cretin", "dummkopf", "blödmann", "imbécile", "débile", "estúpido", "tonto"),
    "worth": ("loser", "losers", "worthless", "pathetic", "useless", "versager", "wertlos", "minable", "inútil", "fracasado"),
    "disgust": ("scum", "trash", "filth", "filthy", "vermin", "disgusting", "abschaum", "ekelhaft", "ordure", "dégoûtant", "basura", "asqueroso"),
    "mockery": ("clown", "clowns", "fool", "fools", "buffoon", "laughingstock", "trottel", "bouffon", "payaso"),
    "threat": ("shut up", "get lost", "drop dead", "go away", "nobody likes you", "i hate you", "halt die klappe", "ferme la", "cállate"),
}
PATTERNS = ("bang", "shout", "repeated", "dense")
SHOUT = re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{4,})+\b")
FEATURES = "terms array<int>, counts array<int>, bangs int, shouts int, words int"


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows never learned from: crc32 of the id as text divisible by `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def scan(texts: Iterator, terms: list[str]) -> Iterator[tuple]:
    """terms, counts, bangs, shouts and words of each text.

    A term counts where no letter or digit touches it; one that ends in * may go on at its right.
    """
    machine, of = ahocorasick.Automaton(), {}
    for k, t in enumerate(terms):
        of.setdefault(t.rstrip("*"), []).append((k, t.endswith("*")))
    for t, own in of.items():
        machine.add_word(t, (len(t), own))
    machine.make_automaton()
    for text in texts:
        text, found = text or "", {}
        low = text.lower()
        for end, (n, own) in machine.iter(low):
            if end - n < 0 or not low[end - n].isalnum():
                closed = end + 1 == len(low) or not low[end + 1].isalnum()
                for k, stem in own:
                    if closed or stem:
                        found[k] = found.get(k, 0) + 1
        keys = sorted(found)
        yield keys, [found[k] for k in keys], text.count("!!"), len(SHOUT.findall(text)), text.count(" ") + text.count("\n") + 1


def features(text: Column, terms: list[str]) -> Column:
    @F.pandas_udf(FEATURES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(list(scan(texts, terms)), columns=["terms", "counts", "bangs", "shouts", "words"])

    return of(text)


@dataclass
class Model:
    terms: list[str]
    voters: list[frozenset[int]]
    prior: float = 0.1
    hit: np.ndarray | None = None  # of voters, for clean and toxic documents
    trust: np.ndarray | None = None  # of voters, after correlations
    weights: np.ndarray | None = None

    def flat(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of all hits of rows with FEATURES."""
        row = np.repeat(np.arange(len(f)), [len(t) for t in f["terms"]])
        both = [np.concatenate([np.empty(0, np.int64), *f[c]]).astype(np.int64) for c in ("terms", "counts")]
        return row, *both

    def votes(self, f: pd.DataFrame) -> np.ndarray:
        row, term, count = self.flat(f)
        own = np.array([[t in v for v in self.voters] for t in range(len(self.terms))], dtype=np.int64).reshape(len(self.terms), len(self.voters))
        out = np.zeros((len(f), len(self.voters) + len(PATTERNS)), np.int64)
        np.add.at(out[:, : len(self.voters)], row, own[term])
        total, most, words = np.bincount(row, count, len(f)), np.zeros(len(f)), f["words"].to_numpy()
        np.maximum.at(most, row, count)
        out[:, len(self.voters) :] = np.stack([f["bangs"] > 0, f["shouts"] > 0, most > 1, (100 * total >= words) & (words > 0) & (total > 0)], axis=1)
        return np.minimum(out, 1)

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        clean, toxic = self.hit
        each = v * np.log(toxic / clean) + (1 - v) * np.log((1 - toxic) / (1 - clean))
        return np.log(self.prior / (1 - self.prior)) + each @ self.trust

    def vectors(self, f: pd.DataFrame) -> np.ndarray:
        """What the classifier sees of each row."""
        row, term, count = self.flat(f)
        x = np.zeros((len(f), len(self.terms) + 7))
        x[row, term] = np.log1p(count)
        total, words = np.bincount(row, count, len(f)), np.maximum(f["words"].to_numpy(), 1)
        x[:, -7:] = np.stack([np.ones(len(f)), np.log1p(total), np.log1p(np.bincount(row, minlength=len(f))), np.minimum(1.0, 100 * total / words), np.log1p(f["bangs"].to_numpy()), np.log1p(f["shouts"].to_numpy()), total > 0], axis=1)
        return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_label_model(model: Model, votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> None:
    """votes: distinct patterns by voter; counts: of unlabelled, clean and toxic rows with the pattern."""
    k = votes.shape[1]
    known = counts[:, 1:].sum(0)
    model.trust = np.ones(k)
    if known.min() > 0:
        model.prior = float(np.clip(known[1] / known.sum(), 0.001, 0.5))
        model.hit = np.stack([(counts[:, c] @ votes + 0.5) / (counts[:, c].sum() + 1) for c in (1, 2)])
    else:
        model.hit = np.stack([np.full(k, 0.02), np.full(k, 0.4)])
    for _ in range(rounds):
        q = sigmoid(model.log_odds(votes))
        mass = np.stack([counts[:, 0] * (1 - q) + counts[:, 1], counts[:, 0] * q + counts[:, 2]])
        if mass.sum() == 0:
            return
        model.prior = float(np.clip(mass[1].sum() / mass.sum(), 1e-4, 0.5))
        model.hit = np.stack([np.clip((m @ votes + 0.5) / (m.sum() + 1), 1e-4, 1 - 1e-4) for m in mass])
        shared = np.zeros((k, k))
        for m, rate in zip(mass, model.hit, strict=True):
            off = votes - rate
            spread = np.sqrt(rate * (1 - rate))
            shared += (off * m[:, None]).T @ off / max(m.sum(), 1) / np.outer(spread, spread) / 2
        np.fill_diagonal(shared, 0)
        model.trust = 1 / (1 + np.clip(shared, 0, 1).sum(1))


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (q - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def known_labels(labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id and toxic of at most SAMPLE labelled rows; repeated ids count once, toxic if any says so."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), folds))
    one = usable.groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("known"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)


def _stems(n: int) -> Column:
    return F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))


def mine(docs: DataFrame, known: DataFrame) -> list[str]:
    """Words and stems (written stem*) far likelier in toxic than in clean labelled texts, best first; each in a share
    SUPPORT of the toxic ones at least. Stems find inflected and compound words of languages without a lexicon."""
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["_id"]).select("known", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("words"))
    bad, n = (rows.agg(F.coalesce(F.sum("known"), F.lit(0)), F.count("*")).first())
    if not 0 < bad < n:
        return []
    terms = F.array_distinct(F.concat("words", *[_stems(n) for n in STEMS]))
    by_word = rows.select("known", F.explode(terms).alias("word")).groupBy("word").agg(F.sum("known").alias("bad"), F.count("*").alias("n"))
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1))
    z = ratio / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    strong = by_word.where((F.length("word") > 2) & (F.col("bad") >= F.greatest(F.lit(3), F.lit(SUPPORT * bad))) & (ratio > 2)).orderBy(z.desc(), F.length("word").desc(), "word").limit(100 * MINED)
    chosen: list[str] = []
    for r in strong.collect():  # one of each family of a word and its stems
        own = r.word.rstrip("*")
        if not any(own.startswith(c.rstrip("*")) or c.startswith(own) for c in chosen):
            chosen.append(r.word)
    return chosen[:MINED]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the staged features of every row of `docs` (doc_id, held_out and FEATURES)."""
    known = staged(known_labels(labels))
    mined = mine(docs, known)
    terms = list(dict.fromkeys([*(t for ts in LEXICONS.values() for t in ts), *mined]))
    at = {t: k for k, t in enumerate(terms)}
    voters = [frozenset(at[t] for t in ts) for ts in LEXICONS.values()] + [frozenset(at[t] for t in mined[k::MINED_VOTERS]) for k in range(MINED_VOTERS)]
    model = Model(terms, voters)
    table = staged(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), features(F.col("text"), terms).alias("f")))
    rows = table.where("not held_out").join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "f", "known")

    @F.pandas_udf("array<int>")
    def vote(f: pd.DataFrame) -> pd.Series:
        return pd.Series(list(model.votes(f)))

    voted = rows.withColumn("votes", vote("f"))
    # As many rows at most as there are vote patterns: two to the number of voters.
    table_of = voted.groupBy("votes").agg(F.count_if(F.col("known").isNull()).alias("u"), F.count_if(F.col("known") == 0).alias("c"), F.count_if(F.col("known") == 1).alias("t")).toPandas()
    k = len(voters) + len(PATTERNS)
    votes = np.array(table_of["votes"].tolist(), dtype=float).reshape(-1, k)
    fit_label_model(model, votes, table_of[["u", "c", "t"]].to_numpy(float))

    seen = rows.orderBy(F.col("known").isNull(), F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("f.*", "known").toPandas()
    if len(seen):
        odds = model.log_odds(model.votes(seen).astype(float))
        odds += np.where(seen["known"].isna(), 0, np.where(seen["known"] > 0, 1, -1)) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
        model.weights = fit_linear(model.vectors(seen), sigmoid(odds))
    else:
        model.weights = np.zeros(len(terms) + 7)
    return model, table


def score(f: Column, model: Model) -> Column:
    """The classifier's probability that a text is toxic, from its struct of features."""

    @F.pandas_udf("double")
    def of(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(sigmoid(model.vectors(rows) @ model.weights), dtype="float64")

    return of(f)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    Learns from labels and texts of rows that are not held out. Null and empty texts are scored as texts without
    hits. Rows with equal ids are scored each for its own text. Labels without id or value are left out. Without
    labels of both kinds the lexicons and patterns alone decide. Empty tables give no rows. Only doc_id and text of
    `docs` and doc_id and toxic of `labels` are read.
    """
    model, table = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return table.withColumn("score", score(F.col("f"), model)).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model does not predict to be toxic, with all their columns. Text is read twice."""
    model, _ = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    rows = docs.select(F.struct("*").alias("row"), score(features(docs["text"], model.terms), model).alias("score"))
    return rows.where("score < 0.5").select("row.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
