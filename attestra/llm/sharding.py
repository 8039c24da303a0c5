"""Minimax contiguous partition of atomic groups into shards.

Groups of equal texts are ordered by their text hash. The smallest feasible shard capacity is found by binary search,
each candidate checked greedily; the order is then cut where the greedy pass over that capacity stops.

The running sums of group sizes stay in a table. The search sees them through a fixed number of bins: a bin's least
and greatest running sum and its count. That bounds every greedy jump from both sides; only bins that a jump of an
undecided capacity can reach are split further, until each jump is exact. A round is one aggregation with at most
`shards * BINS` result rows, whatever the number of groups, and the rounds are as the logarithm of the bytes.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.plans.staging import in_groups, staged

BINS = 512
ROWS_PER_BUCKET = 20_000


class Sums:
    """What is known of the ordered running sums: exact members, and open intervals that hold unknown ones."""

    def __init__(self, total: int):
        self.total, self.known, self.blind = total, [0], []

    def learn(self, windows, bins) -> None:
        """bins: (least, greatest, count) of every non-empty bin of `windows`, closed intervals (a, b)."""
        inside = lambda x: any(a <= x <= b for a, b in windows)
        self.blind = sorted([u for u in self.blind if not inside(u[0] + 1)] + [(lo, hi) for lo, hi, n in bins if n > 2])
        self.known = sorted({*self.known, *(x for lo, hi, _ in bins for x in (lo, hi))})

    def floor(self, t: int) -> tuple[int, int]:
        """Bounds of the greatest member that is at most t; equal bounds are exact."""
        low = self.known[bisect_right(self.known, t) - 1]
        k = bisect_right(self.blind, (t, -1)) - 1  # the last interval beginning below t
        return (low, t) if k >= 0 and self.blind[k][0] < t < self.blind[k][1] else (low, low)

    def path(self, capacity: int, shards: int, optimist: bool) -> list[int]:
        ends, at = [], 0
        for _ in range(shards):
            at = self.floor(at + capacity)[optimist]
            ends.append(at)
        return ends

    def feasible(self, capacity: int, shards: int, optimist: bool) -> bool:
        return self.path(capacity, shards, optimist)[-1] >= self.total


def least(lo: int, hi: int, ok) -> int:
    """The least capacity in (lo, hi] that is ok; hi is."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def minimax_ends(sums: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Running sums at which the shards end, for the smallest feasible capacity. `sums`: column `cum`, increasing."""
    seen = Sums(total)
    lo, hi = max(-(-total // shards), largest) - 1, total
    windows = [(1, total)]
    while windows:
        bin_of: Column = F.lit(None).cast("long")
        for k, (a, b) in enumerate(windows):
            width = max(1, -(-(b - a + 1) // BINS))
            bin_of = F.when(F.col("cum").between(a, b), F.expr(f"(cum - {a}L) div {width}L") + k * BINS).otherwise(bin_of)
        got = sums.withColumn("bin", bin_of).where("bin is not null").groupBy("bin").agg(F.min("cum"), F.max("cum"), F.count("*")).collect()
        seen.learn(windows, [tuple(r)[1:] for r in got])
        hi = least(lo, hi, lambda c: seen.feasible(c, shards, False))
        lo = least(lo, hi, lambda c: seen.feasible(c, shards, True)) - 1
        reach = list(zip([0, *seen.path(lo + 1, shards, False)], [0, *seen.path(hi, shards, True)], strict=True))[:-1]
        reach = [(a + lo + 1, b + hi) for a, b in reach]  # where the jumps of the capacities still undecided may aim
        windows = []
        for a, b in reach:
            if own := [u for u in seen.blind if u[0] < b and a < u[1] and u[1] - u[0] > 1]:
                x, y = own[0][0] + 1, own[-1][1] - 1
                if windows and x <= windows[-1][1]:
                    windows[-1] = (windows[-1][0], max(y, windows[-1][1]))
                else:
                    windows.append((x, y))
    return seen.path(hi, shards, False)


def contiguous_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, size, text_crc32, shard and slot.

    Size is the text's UTF-8 bytes plus 1. Rows of equal text stay together, so no shard exceeds the even share by
    more than the largest group; the capacity is the smallest possible for the order by text hash. slot counts the
    shard's rows from 0 without gaps. Null texts are one group of size 1 a row, with crc 0; empty texts are another.
    Null and repeated ids are ordinary rows. An empty table gives no rows. Other columns of `df` are not read.
    """
    text = df[text_col]
    slim = staged(df.select(
        df[id_col].alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"),
    ))
    bits = in_groups(slim.count(), ROWS_PER_BUCKET).bit_length()
    groups = slim.groupBy("h").agg(F.sum("size").alias("size")).withColumn("bucket", F.shiftright("h", 64 - bits))
    groups = staged(groups)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over 2 ** bits rows
    offsets = groups.groupBy("bucket").agg(F.sum("size").alias("own")).select("bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    running = Window.partitionBy("bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    sums = staged(groups.withColumn("run", F.sum("size").over(running)).join(offsets, "bucket").select("h", (F.col("run") + F.col("offset")).alias("cum")))

    total, largest = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ends = minimax_ends(sums, total, largest, shards) if total else []
    cuts = [r.h for r in sums.where(F.col("cum").isin(sorted({e for e in ends if 0 < e < total}))).select("h").collect()]
    shard = sum(((F.col("h") > F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int")

    # Slots: counts of small hashed buckets give each bucket's first slot; a hot text spreads over all buckets.
    salt = F.pmod(F.xxhash64("doc_id", "h"), F.lit(2**bits))
    placed = slim.withColumns({"shard": shard, "salt": salt})
    ahead = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "salt").count().select("shard", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "h"))
    return placed.withColumn("rank", rank).join(first, ["shard", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contiguous_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
