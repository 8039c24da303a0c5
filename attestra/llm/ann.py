"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node, with the few least ids that any answer can need, so copies do not crowd a graph. Nodes are
dealt to shards by hash. Shards grow with the square root of the number of nodes, and so does their number. A task
builds a shard's graph and stores it as flat neighbour arrays, a row for each node. Every query goes to every shard once:
a task loads a graph and streams the queries through it. Each search gives the shard's nearest, and the results of the
shards are merged by exact distance. Graphs hold single precision, of a shard's vectors less their mean and divided by the
largest component that is left, so that neither an offset that all share nor their size costs precision; distances are
taken of the given vectors, in double.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.plans.staging import in_groups, staged

SHARD = 24  # nodes of a shard on average, times the square root of all; LEAST_SHARD at least
LEAST_SHARD = 4096
BLOCK = 500_000  # queries that stream through a graph in one task
LINKS = 12  # of a node in an upper layer; twice as many in the lowest
BUILD_EF = 64
SEARCH_EF = 96


class Graph:
    """Vectors and, for each layer, a matrix of neighbours (-1: none)."""

    def __init__(self, x: np.ndarray, links: int = LINKS):
        largest = lambda y: float(np.abs(y).max(initial=0)) or 1.0
        self.size = largest(x)
        x = x.astype(np.float64) / self.size
        self.mean = x.mean(0) if len(x) else 0.0
        x -= self.mean
        self.spread = largest(x)
        x /= self.spread
        self.x, self.norm = x.astype(np.float32), np.einsum("ij,ij->i", x, x).astype(np.float32)
        self.links, self.layers, self.used, self.entry = links, [], [], -1
        self.stamp, self.now = np.zeros(len(x), np.int64), 0

    def away(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances, up to the query's own norm."""
        return self.norm[nodes] - 2 * (self.x[nodes] @ q)

    def layer(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest found from `start` in a layer, nearest first."""
        self.now += 1
        stamp, now, table, used = self.stamp, self.now, self.layers[level], self.used[level]
        stamp[[n for _, n in start]] = now
        todo, best = list(start), [(-d, n) for d, n in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = table[node, : used[node]]
            near = near[stamp[near] != now]
            if not len(near):
                continue
            stamp[near] = now
            for e, n in zip(self.away(q, near).tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-e, n))
                    heapq.heappush(todo, (e, n))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, n))
                    heapq.heappush(todo, (e, n))
        return sorted((-d, n) for d, n in best)

    def diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes, nearest first, those that are nearer to the base than to any one chosen; the rest fill up."""
        nodes = np.array([n for _, n in found])
        x = self.x[nodes]
        apart = self.norm[nodes][None, :] - 2 * (x @ x.T) + self.norm[nodes][:, None]
        chosen: list[int] = []
        base = [d for d, _ in found]
        for k in range(len(nodes)):
            if len(chosen) >= most:
                break
            if not chosen or base[k] < apart[k, chosen].min():
                chosen.append(k)
        left = [k for k in range(len(nodes)) if k not in set(chosen)]
        return nodes[chosen + left[: most - len(chosen)]].tolist()

    def link(self, level: int, a: int, b: int) -> None:
        table, used, most = self.layers[level], self.used[level], self.links * (2 if level == 0 else 1)
        if used[a] < most:
            table[a, used[a]] = b
            used[a] += 1
            return
        near = np.append(table[a, :most], b)
        d = self.away(self.x[a], near) + self.norm[a]
        order = np.argsort(d, kind="stable")
        kept = self.diverse(list(zip(d[order].tolist(), near[order].tolist(), strict=True)), most)
        table[a, : len(kept)] = kept
        used[a] = len(kept)

    def add(self, node: int, height: int) -> None:
        n, q = len(self.x), self.x[node]
        top = len(self.layers) - 1
        while len(self.layers) <= height:
            self.layers.append(np.full((n, self.links * (1 if self.layers else 2)), -1, np.int32))
            self.used.append(np.zeros(n, np.int32))
        if self.entry >= 0:
            at = [(float(self.away(q, np.array([self.entry]))[0]), self.entry)]
            for level in range(top, height, -1):
                at = self.layer(q, at, 1, level)
            for level in range(min(top, height), -1, -1):
                at = self.layer(q, at, BUILD_EF, level)
                for other in self.diverse([(d + float(self.norm[node]), m) for d, m in at], self.links):
                    self.link(level, node, other)
                    self.link(level, other, node)
        if self.entry < 0 or height > top:
            self.entry = node

    def build(self) -> Graph:
        rng = np.random.default_rng(len(self.x))
        heights = np.floor(-np.log(1 - rng.random(len(self.x))) / math.log(self.links)).astype(int)
        for node, height in enumerate(heights.tolist()):
            self.add(node, min(height, 12))
        return self

    def flat(self) -> list[np.ndarray]:
        """For each node: its height, then the neighbours of its layers from the lowest up, padded with -1."""
        has = [u > 0 for u in self.used]
        return [np.concatenate([t[i] for level, t in enumerate(self.layers) if level == 0 or has[level][i] or i == self.entry]).astype(np.int32) for i in range(len(self.x))]

    @classmethod
    def of(cls, x: np.ndarray, flat: list[np.ndarray], links: int = LINKS) -> Graph:
        g, n = cls(x, links), len(x)
        heights = [len(f) // links - 2 for f in flat]
        for level in range(max(heights, default=0) + 1):
            width, at = (2 * links, 0) if level == 0 else (links, (level + 1) * links)
            table = np.full((n, width), -1, np.int32)
            for i, f in enumerate(flat):
                if heights[i] >= level:
                    table[i] = f[at : at + width]
            g.layers.append(table)
            g.used.append((table >= 0).sum(1).astype(np.int32))
        g.entry = int(np.argmax(heights)) if n else -1
        return g

    def near(self, q: np.ndarray, k: int, ef: int = SEARCH_EF) -> np.ndarray:
        """Nodes among which to look for the k nearest by exact distance: the ef nearest found, or all of a small graph."""
        if len(self.x) <= 2 * max(ef, k):
            return np.arange(len(self.x))
        q = ((q / self.size - self.mean) / self.spread).astype(np.float32)
        at = [(float(self.away(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.layers) - 1, 0, -1):
            at = self.layer(q, at, 1, level)
        return np.array([n for _, n in self.layer(q, at, max(ef, k), 0)])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A matrix of a column of lists of one length."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graphs of a task's shard, one for each dimension."""
    rows = list(batches)
    if not sum(map(len, rows)):
        return
    rows = pa.Table.from_batches(rows).sort_by([("dim", "ascending"), ("order", "ascending")])
    dims = rows["dim"].to_numpy()
    for dim in np.unique(dims):
        own = rows.slice(int(np.searchsorted(dims, dim)), int((dims == dim).sum()))
        flat = Graph(_vectors(own["embedding"])).build().flat()
        ends = np.concatenate([[0], np.cumsum([len(f) for f in flat])])
        links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
        out = own.drop_columns(["order"]).append_column("node", pa.array(np.arange(len(own), dtype=np.int32))).append_column("links", links)
        yield from out.combine_chunks().to_batches(2_000)


def _search(k: int):
    """Of rows sorted by shard, those of the index before queries: the nearest that each query has in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, graph = None, [], None
        for b in batches:
            where = np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("dim", "shard", "block", "query")])
            cuts = np.concatenate([[0], np.nonzero((where[:, 1:] != where[:, :-1]).any(0))[0] + 1, [len(b)]]) if len(b) else [0]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                part, here = b.slice(at, end - at), tuple(where[:3, at].tolist())
                if here != shard:
                    shard, held, graph = here, [], None
                if not where[3, at]:
                    held.append(part)
                    continue
                if graph is None and held:
                    index = pa.Table.from_batches(held)
                    exact, ids = _vectors(index["embedding"]).astype(np.float64), index["ids"].to_pylist()
                    graph, held = Graph.of(exact, [np.asarray(x, np.int32) for x in index["links"].to_numpy()]), []
                if graph is None:
                    continue
                out = []
                asked = _vectors(pa.chunked_array([part["embedding"]])).astype(np.float64)
                for query, number, v in zip(part["query_id"].to_pylist(), part["number"].to_pylist(), asked, strict=True):
                    got = graph.near(v, k + 1)
                    far = np.sqrt(((exact[got] - v) ** 2).sum(1))
                    best = np.argsort(far, kind="stable")
                    best = best[far[best] <= far[best[min(k, len(best) - 1)]]]  # the k + 1 nearest and their equals
                    got, far = got[best], far[best]
                    hits = sorted((d, i) for d, n in zip(far.tolist(), got.tolist(), strict=True) for i in ids[n] if i != query)[:k]
                    out += [(query, number, i, d) for d, i in hits]
                if out:
                    query, number, i, d = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (query, number, i)), pa.array(d, pa.float64())], ["query_id", "number", "vec_id", "score"])

    return run


def vectors(df: DataFrame, column: str) -> Column:
    """The vectors of a column, as single or double numbers as they are given."""
    single = df.schema[column].dataType.elementType == T.FloatType()
    return df[column].cast("array<float>" if single else "array<double>")


def usable(vector: Column) -> Column:
    """Not null or all zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def build_index(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The graphs of all usable vectors of `df`, a row for each distinct vector: dim, shard, embedding, ids, node and links.

    ids are the vector's k + 1 least ids, an id as often as it is repeated (k times at most): an answer to k nearest
    can hold no others. Every vector is in a graph; vectors of other dimensions are in other shards.
    """
    rows = df.select(df[id_col].cast("long").alias("vec_id"), vectors(df, vector_col).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    nodes = first.groupBy("embedding").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("times"))))).alias("ids"))
    nodes = staged(nodes.withColumn("order", F.xxhash64("embedding")))
    many = nodes.count()
    shards = in_groups(many, max(LEAST_SHARD, round(SHARD * many**0.5)))
    kind = nodes.schema["embedding"].dataType.simpleString()
    nodes = nodes.select(F.size("embedding").alias("dim"), F.pmod("order", F.lit(shards)).cast("int").alias("shard"), "order", "embedding", "ids")
    built = nodes.repartitionById(shards, "shard").mapInArrow(_build, f"dim int, shard int, embedding {kind}, ids array<long>, node int, links array<int>")
    return staged(built)


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each usable row of `queries` (query_id, embedding).

    Score is the Euclidean distance in double precision. Rows with the query's own id are no candidates; ties go to
    the least vec_id. Equal query ids with different vectors are searched each for itself. Queries of a dimension that
    the index lacks, and an empty index or query table, give no rows.
    """
    # A number for each query that any recomputation gives again.
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), vectors(queries, "embedding").alias("embedding"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("embedding"))).distinct().withColumn("number", F.xxhash64("query_id", "embedding"))
    asked = staged(asked.withColumn("dim", F.size("embedding")))
    blocks = in_groups(asked.count(), BLOCK)
    shards = index.agg(F.coalesce(F.max("shard") + 1, F.lit(1))).first()[0]
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    left = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("query"), "node", doubles, "ids", "links", none("long", "query_id"), none("long", "number"))
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod("number", F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("query"), none("int", "node"), doubles, none("array<long>", "ids"), none("array<int>", "links"), "query_id", "number")
    rows = left.unionByName(right).repartitionById(shards * blocks, (F.col("shard") * blocks + F.col("block")).cast("int"))
    found = rows.sortWithinPartitions("dim", "shard", "block", "query", "node").mapInArrow(_search(k), "query_id long, number long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    queries = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(build_index(rows, 10), queries, 10)
