"""Exact Jaccard similarity join of shingle sets by universe partition.

Sets of sizes x and y with Jaccard at least J differ in at most D = (1-J)/(1+J) * (x+y) shingles. Sizes fall into
bands so that linked sets are in one band or in neighbours; the universe of hashes is dealt into segments whose number
follows from the band's D. By the pigeonhole principle two linked sets agree on enough segments, each of which is
worth one unit if it must be equal and two if one shingle may be missing (its one-deletion neighbourhood is indexed
too). A cost model picks, by band, how many segments of which kind. Where all are exact there are spare ones, twice as
many as one share of the units: each set leaves out that share of its smallest segments, and of the rest as many of
those that most nodes have, as unrelated texts share these. The least common segment that two linked sets agree on
always stays in both.

Equal sets are one node. Nodes that share a key are candidates. Counts of a set's shingles by bin (see `sketch`) bound
what two sets can share, and candidates within that bound are verified on their whole sets. Per key the node with most
shared keys is the pivot: every other node is verified against it and components are drawn. A link that is then still
missing joins two nodes of one pivot in different components; those are found by what the nodes differ by from their
pivot (see `apart`) and verified too. No link is lost, as any linked pair shares a key and so a pivot, and a group of n
near copies costs about n pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import words
from attestra.llm.components import components
from attestra.llm.filters import Filter
from attestra.llm.words import mix
from attestra.plans.staging import spent, staged

U = np.uint64
#: Keys that a segment is worth in the cost model which is empty, holds a single shingle, or lies in a common passage,
#: and the share of segments that does.
FALSE_COST, SINGLE_COST, COMMON_COST, COMMON = 50, 5, 8, 0.2
#: Low bits of a key that tell its band.
BAND_BITS = 10


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted 64-bit hashes of its distinct `width`-word shingles; of all words as one where there are fewer."""
    for _, some in words.slices(texts):
        h, n = words.hashes(some)
        size = np.where(n > 0, np.maximum(1, n - width + 1), 0)
        start = np.arange(size.sum()) + np.repeat(np.cumsum(n) - n - np.cumsum(size) + size, size)
        has, out = np.repeat(n, size), np.zeros(len(start), U)
        for j in range(width):
            there = np.nonzero(has > j)[0]
            out[there] = mix(out[there] * U(0x9E3779B97F4A7C15) + h[start[there] + j])
        yield from map(np.unique, np.split(out, np.cumsum(size)[:-1]))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a = mix(s ^ U(0xA5A5A5A5)).sum(dtype=U) + U(len(s))
        b = np.bitwise_xor.reduce(mix(s + U(0x1234567)), initial=U(0))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@lru_cache(maxsize=64)
def bands(p: int, q: int, limit: int = 1 << 31) -> tuple[int, ...]:
    """Least sizes of the bands: a set's partners of Jaccard p/q or more are in its band or in a neighbour."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * q // p + 1)
    return tuple(out)


@lru_cache(maxsize=4096)
def scheme(band: int, p: int, q: int) -> tuple[int, int, int] | None:
    """(one-deletion segments, exact segments, share of spare ones) for pairs of this band and of this and the next one.

    Of the exact segments two shares are spare: one for the smallest segments and one for the commonest.
    """
    x = bands(p, q)[band + 1] - 1
    units = (q - p) * (x + x * q // p) // (q + p) + 1
    if units == 1:
        return None  # only equal sets are linked

    def cost(deleting: int, exact: int, spare: int) -> float:
        m = deleting + exact
        each = x / m
        empty, single = m * exp(-each), m * each * exp(-each)
        false = FALSE_COST * max(0, empty - spare) + SINGLE_COST * max(0, single - max(0, spare - empty))
        return exact - spare + deleting * (1 + each) + false + COMMON_COST * max(0, COMMON * m - spare)

    options = [(0, units + 2 * e, e) for e in {units // k + 1 for k in (8, 4, 2)}]
    options += [(d, max(0, units - 2 * d), 0) for d in range(1, min(1000, (units + 1) // 2) + 1)]
    return min(options, key=lambda o: cost(*o))


def signatures(s: np.ndarray, p: int, q: int) -> np.ndarray:
    """Keys of a set: two sets of Jaccard p/q or more that are not equal share at least one, or one more than the
    band's share of spare segments where it has some. The low bits of a key are its band."""
    if not len(s):
        return np.empty(0, U)
    own = int(np.searchsorted(bands(p, q), len(s), "right")) - 1
    content, out = mix(s ^ U(0x5851F42D4C957F2D)), []
    for band in (own, own - 1):
        plan = scheme(band, p, q) if band >= 0 else None
        if plan is None:
            continue
        deleting, exact, spare = plan
        m = deleting + exact
        seg = ((s >> U(32)) * U(m) >> U(32)).astype(np.int64)
        low = np.bincount(seg, (content & U(0xFFFFFFFF)).astype(float), m).astype(U)  # sums below 2 ** 53 are exact
        total = low + (np.bincount(seg, (content >> U(32)).astype(float), m).astype(U) << U(32))
        where = mix(np.arange(m, dtype=U) + U(band << 32))
        size = np.bincount(seg, minlength=m)
        upto = np.cumsum(np.bincount(size))
        least = int(np.searchsorted(upto, spare, "right")) if spare else 0  # segments below this size are left out
        own_keys = [mix(total + where)[size >= least]]
        if deleting:
            rest = seg < deleting
            own_keys.append(mix(total[seg[rest]] - content[rest] + where[seg[rest]]))
        out += [k >> U(BAND_BITS) << U(BAND_BITS) | U(band) for k in own_keys]
    return np.unique(np.concatenate(out)) if out else np.empty(0, U)


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's hashes by their high bits, four bits a bin, at least as many bins as hashes; empty if one is too large."""
    bits = max(4, (len(s) - 1).bit_length())
    n = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (n[0::2] | n[1::2] << 4).astype(np.uint8).tobytes() if n.max() < 16 else b""


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in shingle_sets(b["text"], width):
                rows.append((len(s), *digest(s)))
            n, node, check = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], *(pa.array(x, pa.int64()) for x in (n, node, check))], ["doc_id", "h", "n_shingles", "node", "digest"])

    return run


def _keys(width: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, nodes, size = [np.empty(0, U)], [np.empty(0, np.int64)], 0
            for h, s in zip(b["h"].to_pylist(), shingle_sets(b["text"], width), strict=True):
                if h in seen:  # equal texts of a task give their keys once
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(h)
                keys.append(signatures(s, p, q))
                nodes.append(np.full(len(keys[-1]), digest(s)[0], np.int64))
                size += len(keys[-1])
                if size > 200_000:
                    yield _pairs(keys, nodes)
                    keys, nodes, size = [np.empty(0, U)], [np.empty(0, np.int64)], 0
            yield _pairs(keys, nodes)

    return run


def _pairs(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node, those whose key has more than one node, once each. Holds one row over."""
    last, given = None, False
    for b in batches:
        k, v = b["key"].to_numpy(zero_copy_only=False), b["node"].to_numpy(zero_copy_only=False)
        if last is not None:
            k, v = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], v])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        k, v, first = k[new], v[new], given
        if not len(k):
            continue
        as_before = np.zeros(len(k), bool)
        as_before[1:] = k[1:] == k[:-1]
        keep = as_before.copy()
        keep[:-1] |= as_before[1:]
        last, given = (k[-1], v[-1]), bool(keep[-1]) or (first and len(k) == 1)
        if first:
            keep[0] = False  # it was given with the batch before
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(v[keep])], ["key", "node"])


def _sets(width: int, wanted):
    """Sets and sketches of texts whose hash may be wanted; equal texts of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = wanted.value
        for b in batches:
            h, first = np.unique(b["h"].to_numpy(zero_copy_only=False), return_index=True)
            rows = first[known.may_have(h.view(U))]
            for at in range(0, len(rows), 500):
                sets = shingle_sets(b["text"].take(pa.array(rows[at : at + 500])), width)
                node, bins, items = zip(*[(digest(s)[0], sketch(s), s.tobytes()) for s in sets], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(bins, pa.binary()), pa.array(items, pa.binary())], ["node", "sketch", "items"])

    return run


def commonest_left_out(shared: DataFrame, p: int, q: int) -> DataFrame:
    """`shared` (key, node) without the keys of each node and band that most nodes have, as many as are spare.

    A key that only one node is left with goes too. Linked nodes agree on more keys than are spare, so the least common
    of these, by one order of all keys, is among the spare ones of neither.
    """
    spare: dict[int, int] = {}
    for band in range(len(bands(p, q)) - 1):
        deleting, exact, extra = scheme(band, p, q) or (0, 0, 0)
        at = band % (1 << BAND_BITS)
        spare[at] = min(spare.get(at, extra), 0 if deleting else extra)
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1).cast("int")
    often = shared.groupBy("key").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("often"), "key"))
    left = shared.join(often, "key").withColumn("band", band).withColumn("place", place)
    left = staged(left.where(F.col("place") > F.element_at(F.array(*[F.lit(spare[k]) for k in sorted(spare)]), F.col("band") + 1)).select("key", "node"))
    more = left.groupBy("key").agg(F.count("*").alias("often")).where("often > 1").select("key")
    out = staged(left.join(more, "key", "left_semi"))
    spent(left)
    return out


def _counts(sketches: pa.Array, width: int) -> np.ndarray:
    """A row of counts for each of `sketches`, all of `width` bytes."""
    packed = np.frombuffer(sketches.buffers()[2], np.uint8, len(sketches) * width, int(sketches.buffers()[1].size and np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset])).reshape(-1, width)
    out = np.empty((len(packed), 2 * width), np.uint16)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _levels(p: int, q: int):
    """Adds `level`: 2 if the sketches x and y leave room for Jaccard p/q, 1 for one of twice that distance, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b["x"], b["y"]
            wide = np.stack([pc.binary_length(v).to_numpy(zero_copy_only=False) for v in (x, y)])
            level = np.full(len(b), 2, np.int32)
            for u, v in np.unique(wide[:, (wide > 0).all(0)], axis=1).T.tolist():
                every = np.nonzero((wide[0] == u) & (wide[1] == v))[0]
                step = max(1, 2_000_000 // max(u, v))
                for at in range(0, len(every), step):
                    rows = every[at : at + step]
                    c, d = _counts(x.take(pa.array(rows)), u), _counts(y.take(pa.array(rows)), v)
                    while c.shape[1] > d.shape[1]:
                        c = c[:, 0::2] + c[:, 1::2]
                    while d.shape[1] > c.shape[1]:
                        d = d[:, 0::2] + d[:, 1::2]
                    both = c.sum(1, dtype=np.int64) + d.sum(1, dtype=np.int64)
                    same = np.minimum(c, d).sum(1, dtype=np.int64)
                    level[rows] = (q * same >= p * (both - same)).astype(np.int32) + (q * same >= (2 * p - q) * (both - same))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c not in ("x", "y")), pa.array(level)], [*(c for c in b.schema.names if c not in ("x", "y")), "level"])

    return run


def with_levels(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """`pairs` (a, b and others) with `level`, see `_levels`."""
    left, right = (sketches.select(F.col("node").alias(n), F.col("sketch").alias(i)) for n, i in (("a", "x"), ("b", "y")))
    columns = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.join(left, "a").join(right, "b").select("a", "b", *columns, "x", "y").mapInArrow(_levels(p, q), f"a long, b long, {''.join(f'{c} long, ' for c in columns)}level int")


def _verify(p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(x) + len(y)
                same = both - len(np.union1d(x, y)) if both else 0
                keep.append(same > 0 and q * same >= p * (both - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(mask), b["b"].filter(mask)], ["a", "b"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Those of `pairs` (a, b: nodes) whose sets have Jaccard p/q or more."""
    left, right = (sets.select(F.col("node").alias(n), F.col("items").alias(i)) for n, i in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verify(p, q), "a long, b long")


def _listed(p: int, q: int):
    """For pivots a and nodes b: the items that only one of the two has, with those marked that `apart` joins.

    Items that the pivot lacks come first, then those that the node lacks, each by hash: one order for all of a pivot.
    `lead` marks the first, as many as the node must compare for any partner. A node is `near` if it differs from the
    pivot by up to twice as much as from a partner. All items are given of near nodes and of whatever can be a partner
    of one, only the marked ones of nodes farther off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                b = batch.slice(at, 200)
                items, number, leading, nodes = [np.empty(0, U)], [], [], []
                for x, y, inside in zip(b["x"], b["y"], pc.equal(b["root_a"], b["root_b"]).to_pylist(), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                    own, gone = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                    n_a, n_b, size = len(x), len(y), len(own) + len(gone)
                    most = (n_b + n_b * q // p) * (q - p) // (q + p)  # differences allowed to any partner of the node
                    nearest = (-(-n_b * p // q) + n_a) * (q - p) // (q + p) + 1  # of a node outside to the pivot, at least
                    widest = n_b * q // p
                    farthest = 2 * ((widest + widest * q // p) * (q - p) // (q + p)) + most  # of a partner of a near node
                    lead = max(0, size + (most - nearest - size) // 2 + 1 if inside else min(size, most + 1))
                    items.append(np.concatenate([own, gone])[: (size if size <= farthest else lead) if lead else 0])
                    number.append(len(items[-1]))
                    leading.append(lead)
                    nodes.append((n_b, size, most, nearest if inside else size - most))
                number = np.array(number)
                row = np.repeat(np.arange(len(b)), number)
                place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                n, d, most, least = np.array(nodes, np.int32).reshape(-1, 4).T[:, row]
                at_row = pa.array(row)
                columns = [b["a"].take(at_row), pa.array(np.concatenate(items).view(np.int64)), b["b"].take(at_row), b["root_b"].take(at_row)]
                marks = [pa.array(place < np.array(leading)[row]), pa.array(d <= 2 * most)]
                numbers = [pa.array(v.astype(np.int32)) for v in (n, d, d - place, most, least)]
                yield pa.RecordBatch.from_arrays([*columns, *marks, *numbers], LISTED_NAMES)

    return run


#: least: what a partner of the node differs by from the pivot, at least
LISTED = "a long, item long, node long, root long, lead boolean, near boolean, n int, d int, left int, most int, least int"
LISTED_NAMES = [c.split()[0] for c in LISTED.split(", ")]


def fitting(listed: DataFrame) -> DataFrame:
    """`listed` without what cannot be shared, and `own`: how many of its items a node can share (null: not all are given).

    An item that only nodes of one component have is shared with no other. A near node goes if it is left with fewer
    items than it has to share with any partner.
    """
    same = Window.partitionBy("a", "item")
    rows = staged(listed.withColumns({"r0": F.min("root").over(same), "r1": F.max("root").over(same)}).where("r0 <> r1").drop("r0", "r1"))
    nodes = rows.groupBy("a", "node").agg(F.count("*").alias("own"), *[F.first(c).alias(c) for c in ("near", "d", "most", "least")])
    nodes = nodes.where("not near or 2 * own >= d + least - most").select("a", "node", F.when(F.col("near"), F.col("own")).alias("own"))
    out = staged(rows.where("lead").join(nodes, ["a", "node"]))
    spent(rows)
    return out


def with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """`pairs` (a, b) with root_a and root_b; a node without links is its own root."""
    place = lambda node, root: roots.select(F.col("node").alias(node), F.col("root").alias(root))
    rows = pairs.join(place("a", "root_a"), "a", "left").join(place("b", "root_b"), "b", "left")
    return rows.withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")})


def apart(stars: DataFrame, edges: DataFrame, sets: DataFrame, roots: DataFrame, p: int, q: int) -> DataFrame:
    """Candidates among the nodes of a pivot that lie in different components: pairs a and b, without the pivot's own.

    With A and B what two nodes differ by from the pivot, they differ from each other by |A| + |B| - 2 |A & B|, so a
    link of nodes in different components needs a common item of A and B, and the more, the farther they are. That
    is a join of small sets with prefix filtering: what the pivot lacks comes first, and a node lists as many as it must
    for any partner. A node outside the pivot's component lists at most D + 1 items; one inside needs to share more than
    half of its own with a node outside, so it lists less than half, mostly items that nobody else has. Positions in the
    lists, and the number of a node's items that are not its component's alone, bound what two nodes can still share;
    `fitting` leaves out nodes by the latter first, as copies changed each in its own way have little in common.

    Jaccard distance is a metric: a node linked with the pivot is linked with none that is more than twice as far from
    the pivot (level 0), so linked nodes list nothing where all nodes outside are so far. stars: a, b and level, null
    for nodes that were connected with the pivot before they were compared with it.
    """
    rows = with_roots(stars.join(edges.select("a", "b", F.lit(True).alias("linked")), ["a", "b"], "left"), roots)
    close = F.max(F.when(F.col("linked").isNull() & (F.col("root_a") != F.col("root_b")), F.col("level")))
    kept = rows.join(rows.groupBy("a").agg(close.alias("close")), "a").where("linked is null or close > 0")
    mixed = kept.groupBy("a").agg(F.min("root_b").alias("r0"), F.max("root_b").alias("r1")).where("r0 <> r1").select("a")
    rows = staged(kept.join(mixed, "a", "left_semi").select("a", "b", "root_a", "root_b"))
    left, right = (sets.select(F.col("node").alias(n), F.col("items").alias(i)) for n, i in (("a", "x"), ("b", "y")))
    listed = fitting(rows.join(left, "a").join(right, "b").mapInArrow(_listed(p, q), LISTED))
    other = listed.select("a", "item", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "n", "d", "left", "own")])
    # At their first common item, what is left of either must hold all that the two have to share.
    shared = F.ceil((F.col("d") + F.col("other_d") - F.floor((F.col("n") + F.col("other_n")) * (q - p) / (q + p))) / 2)
    near = (F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root")) & (shared <= F.least("left", "other_left", "own", "other_own"))
    pairs = listed.join(other.withColumnsRenamed({"a": "_a", "item": "_item"}), (F.col("a") == F.col("_a")) & (F.col("item") == F.col("_item")) & near)
    return pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def near_groups(df: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id, node (equal for equal sets), h (hash of the text), root.

    root is the same within a component and only there, and null for rows without words. Rows are linked when the Jaccard similarity of their shingle sets is `similarity` or more; component_id is the
    least doc_id reachable by links. Rows without words or text have n_shingles 0 and are linked with nothing. Rows
    with equal ids are nodes of their own; null ids are allowed and never the least one unless all are null. Sets are
    compared by 64-bit shingle hashes. An empty table gives no rows. Other columns are not read.
    """
    p, q = similarity
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    members = staged(hashed.mapInArrow(_members(width), "doc_id long, h long, n_shingles long, node long, digest long"))
    keys = hashed.select("h", "text").mapInArrow(_keys(width, p, q), "key long, node long")
    every = staged(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long"))
    shared = commonest_left_out(every, p, q)
    spent(every)

    nodes = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    weight = shared.groupBy("node").agg(F.count("*").alias("weight"))
    some = df.sparkSession.sparkContext.broadcast(Filter(members.where("n_shingles > 0").join(weight, "node", "left_semi").select("h"), "h"))
    sets = hashed.select("h", "text").mapInArrow(_sets(width, some), "node long, sketch binary, items binary")
    sets = staged(sets.join(weight, "node", "left_semi").dropDuplicates(["node"]))

    pivot = shared.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot"))
    stars = shared.join(pivot, "key").where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys"))
    stars = staged(stars)
    spent(shared)
    # First each node against its commonest pivot, then against those that it is not connected with already.
    first = stars.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a")).select("a", "b")
    levels = staged(with_levels(first, sets, p, q))
    edges = staged(linked(levels.where("level = 2").select("a", "b"), sets, p, q))
    roots = staged(components(edges))
    other = with_roots(stars.join(levels, ["a", "b"], "left_anti"), roots).where("root_a <> root_b").select("a", "b")
    other = staged(with_levels(other, sets, p, q))
    edges = edges.unionByName(staged(linked(other.where("level = 2").select("a", "b"), sets, p, q)))
    roots = staged(components(edges))
    stars = stars.select("a", "b").join(levels.unionByName(other), ["a", "b"], "left")

    more = staged(linked(apart(stars, edges, sets, roots, p, q), sets, p, q))
    if not more.isEmpty():
        roots = staged(components(edges.unionByName(more)))
    spent(sets)

    whole = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = whole.join(least, "root").select("node", "component_id", "root")
    return members.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node", "h",
        F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"),
    )


def one_of_each_group(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each linked group, of the least id in it.

    A null id is the least only where all ids of a group are null. Rows without words are in no group and stay, but
    for repeats of one id and text, of which one stays.
    """
    groups = near_groups(docs, width, similarity)
    alone = F.col("n_shingles") == 0
    own = [F.when(alone, F.col(c)).alias(f"own_{c}") for c in ("doc_id", "h")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    one = groups.groupBy("root", alone.alias("alone"), *own).agg(least.alias("first"))
    keep = one.select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    keyed = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("key"))
    kept = keyed.join(keep, (F.col("key") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("key", "id").orderBy("key"))
    return kept.withColumn("turn", turn).where("turn = 1").select("row.*")


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs, 3, (90, 100)).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 2], ' ')) AS s FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d
LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
