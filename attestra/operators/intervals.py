"""Half-open intervals: overlap, union, coverage, complement and slicing.

Keys come first in every window and join, so work is partitioned by the text that owns the intervals. Joins on overlap
also carry a bucket of the position, so that a long text with many intervals is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_overlap(df: DataFrame, keys: list[str], order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds `overlaps`: the range begins before the end of the one before it, in order of start and end."""
    w = Window.partitionBy(*keys).orderBy(start, end, *order)
    return df.withColumn("overlaps", F.coalesce(F.col(start) < F.lag(end).over(w), F.lit(False)))


def map_contiguity(df: DataFrame, keys: list[str], length: str, start: str = "start", end: str = "end") -> DataFrame:
    """Per owner: does its map begin at 0, have no gaps or overlaps, and end at the text's length?"""
    w = Window.partitionBy(*keys).orderBy(start, end)
    steps = df.withColumn("_broken", F.col(start) != F.lag(end, 1, 0).over(w))
    return steps.groupBy(*keys).agg((~F.bool_or("_broken") & (F.max(end) == F.max(length))).alias("contiguous"), F.count_if(F.col("_broken")).alias("breaks"))


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds `island`, the number of the union interval that a row belongs to; touching ranges are one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    return new.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", *more: Column) -> DataFrame:
    """The union of the intervals of each key, with further aggregates of each piece."""
    return islands(df, keys, start, end).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), *more).drop("island")


def coverage(df: DataFrame, keys: list[str], length: str, start: str = "start", end: str = "end") -> DataFrame:
    """Per owner, how many positions no interval, one and several intervals cover: a sweep over interval ends."""
    ends = df.select(*keys, F.col(length).alias("_n"), F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    level = ends.groupBy(*keys, "_n", "e.at").agg(F.sum("e.step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    level = level.withColumns({"depth": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "wide": F.lead("at").over(w) - F.col("at"), "_first": F.first("at").over(w), })
    return level.groupBy(*keys).agg(
        (F.max("_n") - F.coalesce(F.sum(F.when(F.col("depth") > 0, F.col("wide"))), F.lit(0))).alias("unowned"),
        F.coalesce(F.sum(F.when(F.col("depth") == 1, F.col("wide"))), F.lit(0)).alias("owned_once"),
        F.coalesce(F.sum(F.when(F.col("depth") > 1, F.col("wide"))), F.lit(0)).alias("owned_twice"),
    )


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """Pairs of intervals (a: start, end; b: start_b, end_b) of a key that share a position.

    Both sides are listed under each bucket of `width` positions that they touch; a pair is reported in the bucket of
    its first common position only.
    """
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    left = a.withColumn("_bucket", buckets("start", "end"))
    right = b.withColumn("_bucket", buckets("start_b", "end_b"))
    both = left.join(right, [*keys, "_bucket"]).where("start < end_b and start_b < end")
    return both.where(F.floor(F.greatest("start", "start_b") / width) == F.col("_bucket")).drop("_bucket")


def not_contained(spans: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that lie inside no owned span of the same key: the fast equal case first, then containment."""
    same = owned.select(*keys, F.col("start_b").alias("start"), F.col("end_b").alias("end")).distinct()
    left = spans.join(same, [*keys, "start", "end"], "left_anti")
    inside = [left[k] == owned[k] for k in keys] + [left["start"] >= owned["start_b"], left["end"] <= owned["end_b"]]
    return left.join(owned, inside, "left_anti")


def complement(df: DataFrame, keys: list[str], length: str, start: str = "start", end: str = "end") -> DataFrame:
    """What the intervals of each key leave of [0, length): fragments in order."""
    merged = merge_intervals(df, keys, start, end, F.max(length).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(start)
    gaps = merged.withColumns({"_before": F.lag(end, 1, 0).over(w), "_last": F.lead(start).over(w).isNull()})
    pieces = F.array(F.struct(F.col("_before").alias("start"), F.col(start).alias("end")), F.struct(F.col(end).alias("start"), F.when(F.col("_last"), F.col("_n")).otherwise(F.col(end)).alias("end")))
    return gaps.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.start", "p.end").where("start < end")


def slice_owner(ranges: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical ranges mapped to source positions through the segments they touch.

    segments: seg_start, seg_end, source_start and mapping. An exact segment shifts; any other kind is atomic, and a
    range that would cut one is reported with `cut` true and no source position.
    """
    right = segments.withColumnsRenamed({"seg_start": "start_b", "seg_end": "end_b"})
    hit = overlap_join(ranges, right, keys)
    lo, hi = F.greatest("start", "start_b"), F.least("end", "end_b")
    cut = (F.col("mapping") != "exact") & ((lo > F.col("start_b")) | (hi < F.col("end_b")))
    at = F.when(~cut, F.col("source_start") + lo - F.col("start_b"))
    return hit.select(*keys, "start", "end", lo.alias("piece_start"), hi.alias("piece_end"), cut.alias("cut"), at.alias("source_from"), (at + hi - lo).alias("source_to"))


def runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive values of a key: first and last of each."""
    rows = df.select(*keys, value).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return rows.withColumn("_run", F.col(value) - rank).groupBy(*keys, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_run")
