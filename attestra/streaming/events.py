"""Event logs: durations, gaps, replay, duplicates, states and change feeds, in batch and as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.plans.staging import shared_dir
from attestra.streaming.ordered import ChangeFeed, StagePairs, in_order

TERMINAL = ("completed", "failed", "cancelled", "refused")
#: Which states an event may follow; a terminal state takes no more events.
NEXT = {"created": ("new",), "started": ("created", "running"), "progress": ("running",), "completed": ("running",), "failed": ("created", "running")}
STATE_OF = {"created": "created", "started": "running", "progress": "running", "completed": "completed", "failed": "failed"}


def event_log_source(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """An append-only log of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Per aggregate: number of gaps in its sequence, first and last number, and whether it is whole from 1."""
    w = Window.partitionBy("aggregate_id").orderBy("sequence")
    rows = events.withColumn("_gap", F.col("sequence") - F.lag("sequence", 1, 0).over(w) > 1)
    return rows.groupBy("aggregate_id").agg(F.count_if("_gap").alias("gaps"), F.min("sequence").alias("first"), F.max("sequence").alias("last")).withColumn("whole", F.col("gaps") == 0)


def replay(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after each cursor (aggregate_id, after) in sequence, up to the first gap or terminal event.

    `status` of every row tells whether the history is whole (`ok`) or has a gap after the cursor (`expired`).
    """
    rows = events.join(cursors, "aggregate_id").where(F.col("sequence") > F.col("after"))
    w = Window.partitionBy("aggregate_id").orderBy("sequence")
    rows = rows.withColumns({"_step": F.col("sequence") - F.coalesce(F.lag("sequence").over(w), F.col("after")), "_done": F.lag(F.col("event_type").isin(*TERMINAL), 1, False).over(w)})
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_broken": F.max(F.when(F.col("_step") != 1, 1).otherwise(0)).over(seen), "_over": F.max(F.col("_done").cast("int")).over(seen)})
    gap = F.max(F.when((F.col("_broken") == 1) & (F.col("_over") == 0), 1).otherwise(0)).over(Window.partitionBy("aggregate_id"))
    rows = rows.withColumn("status", F.when(gap == 1, "expired").otherwise("ok"))
    return rows.where("_broken = 0 and _over = 0").select("aggregate_id", "sequence", "event_type", "status")


def dedupe_events(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """At-least-once delivery without the repeats: one row for each event id, in a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def stage_duration(events: DataFrame, begin: str, end: str, within: int | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Milliseconds from an aggregate's `begin` event to its next `end` event, each end used once, with the start's time.

    An end more than `within` seconds after its start does not count; None: however late. A stream gives each pair once,
    when its end has come and all rows before it, and forgets a start when the watermark is `within` seconds past it.
    """
    if events.isStreaming:
        pairs = in_order(events, "aggregate_id", StagePairs(begin, end, within), watermark)
        return pairs.select("aggregate_id", "sequence", F.timestamp_micros("began").alias("ts"), "millis")
    w = Window.partitionBy("aggregate_id").orderBy("sequence")
    marks = events.where(F.col("event_type").isin(begin, end)).withColumns({"_next": F.lead("event_type").over(w), "_at": F.lead("ts").over(w)})
    took = F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    pairs = marks.where((F.col("event_type") == begin) & (F.col("_next") == end) & (F.lit(True) if within is None else took <= within * 1_000_000))
    return pairs.select("aggregate_id", "sequence", "ts", F.greatest(F.floor(took / 1000), F.lit(0)).alias("millis"))


def stage_metrics(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Counts and value sums of each event type by window of event time; in a stream, late rows end at the watermark."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def stage_latency(pairs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Runs of a stage (rows of `stage_duration`) by the window of event time in which they began: how many, their mean
    and longest milliseconds. A stream of pairs gives the windows in complete mode."""
    out = pairs.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("runs"), F.round(F.avg("millis"), 3).alias("mean_millis"), F.max("millis").alias("most_millis"))
    return out.select(F.col("w.start").alias("start"), "runs", "mean_millis", "most_millis")


def catalogue_changes(events: DataFrame, kinds: tuple[str, ...], watermark: str = "10 minutes") -> DataFrame:
    """The change feed (event_id, aggregate_id, sequence, event_type, epoch): events of the named kinds, with an epoch that
    counts them for each aggregate. A stream gives each once, as soon as all rows before it have come."""
    if events.isStreaming:
        return in_order(events, "aggregate_id", ChangeFeed(kinds), watermark).select("event_id", "aggregate_id", "sequence", "event_type", "epoch")
    w = Window.partitionBy("aggregate_id").orderBy("sequence")
    rows = events.where(F.col("event_type").isin(*kinds)).withColumn("epoch", F.row_number().over(w).cast("long"))
    return rows.select("event_id", "aggregate_id", "sequence", "event_type", "epoch")


def fold(state: tuple, rows: list[tuple[int, str]]) -> tuple:
    """(status, sequence, applied, rejected) after events (sequence, kind) in order."""
    status, last, applied, rejected = state
    for sequence, kind in rows:
        if sequence <= last or status in TERMINAL or status not in NEXT.get(kind, ()):
            rejected += 1
        else:
            status, applied = STATE_OF[kind], applied + 1
        last = max(last, sequence)
    return status, last, applied, rejected


STATE = "aggregate_id long, status string, sequence long, applied long, rejected long"


def job_state(events: DataFrame) -> DataFrame:
    """State of every aggregate after its events (aggregate_id, sequence, kind): terminal states absorb, what does not
    fit or comes late is rejected and counted. A stream emits the new state of each aggregate that a batch touches."""
    if not events.isStreaming:
        items = F.array_sort(F.collect_list(F.struct(F.col("sequence").cast("long").alias("sequence"), "kind")))
        folded = events.groupBy(F.col("aggregate_id").cast("long").alias("aggregate_id")).agg(items.alias("xs"))
        zero = F.struct(F.lit("new").alias("status"), *[F.lit(0).cast("long").alias(c) for c in ("sequence", "applied", "rejected")])

        def one(s, x):
            follows, after = F.lit(False), s["status"]
            for kind, states in NEXT.items():
                here = x["kind"] == kind
                follows, after = follows | (here & s["status"].isin(*states)), F.when(here, STATE_OF[kind]).otherwise(after)
            fits = F.coalesce(follows & (x["sequence"] > s["sequence"]) & ~s["status"].isin(*TERMINAL), F.lit(False))
            count = lambda c, yes: (s[c] + yes.cast("long")).alias(c)
            return F.struct(F.when(fits, after).otherwise(s["status"]).alias("status"), F.greatest(s["sequence"], x["sequence"]).alias("sequence"), count("applied", fits), count("rejected", ~fits))

        return folded.select("aggregate_id", F.aggregate("xs", zero, one).alias("s")).select("aggregate_id", "s.*")

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ("new", 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("sequence")
        state = fold(state, list(zip(rows["sequence"].tolist(), rows["kind"], strict=True)))
        held.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["aggregate_id", "status", "sequence", "applied", "rejected"])

    return events.select("aggregate_id", "sequence", "kind").groupBy("aggregate_id").applyInPandasWithState(step, STATE, "status string, sequence long, applied long, rejected long", "update", "NoTimeout")


def landed(stream: DataFrame, path: str | None = None) -> DataFrame:
    """What a stream has in its source, written once to the shared folder and read again: file sink, append mode. With the
    `path` of an earlier run it goes on from there, and gives the rows of both."""
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/attestra-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has and gives the rows that it emitted (memory sink: for tests)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def late(col: Column, now: Column) -> Column:
    return col.isNotNull() & (col <= now)
