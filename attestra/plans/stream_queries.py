"""Queries that run stateful streams over files, and their batch forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.plans import fixtures as fx
from attestra.plans.book import query
from attestra.plans.staging import shared_dir, spent, staged
from attestra.sources import batches as bt
from attestra.streaming import events as ev
from attestra.streaming import jobs, publications

PARTS = 4


def arriving(rows: DataFrame, jitter: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream that `make` makes gives of rows with ts that come in the order of time, up to `jitter` seconds late.

    Rows come as PARTS sets of files, and the stream goes on from its checkpoint after each. A batch takes a whole set,
    however many files it has: rows of one set are further apart than a watermark allows, so a set cut in two would lose
    those of its second half.
    """
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/attestra-{uuid.uuid4().hex}"
    rows = staged(rows)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    seen = at + F.pmod(F.xxhash64("sequence", "ts"), F.lit(jitter * 1_000_000))
    part = F.least(F.floor((seen - F.lit(first)) * PARTS / F.lit(max(1, (last or 0) - (first or 0)))), F.lit(PARTS - 1))
    for k in range(PARTS):
        rows.where(part == k).write.parquet(f"{path}/in/{k}")
        out = ev.landed(make(spark.readStream.schema(rows.schema).parquet(f"{path}/in/*")), f"{path}/out")
    spent(rows)
    return out


def job_log(spark, sf):
    """Twelve events of a user are a job's log."""
    k = F.col("event_id")
    n = F.col("sequence") - 1
    log = fx.log(spark, sf).select(
        "event_id", "ts", (F.col("aggregate_id") * 1000 + F.floor(n / 12)).alias("aggregate_id"), (n % 12 + 1).alias("sequence"),
        F.when((n % 12 == 0) | (k % 6 == 0), "acquired").when(k % 6 == 1, "heartbeat").when(k % 6 == 2, "started").when(k % 6 == 3, "progress").when(k % 12 == 4, "finished")
        .when(k % 36 == 10, "completed").when(k % 36 == 22, "cancelled").when(k % 12 == 10, "failed").otherwise("progress").alias("kind"),
    )
    so_far = Window.partitionBy("aggregate_id").orderBy("sequence")
    epoch = F.least(F.count(F.when(F.col("kind") == "acquired", 1)).over(so_far), F.col("event_id") % 7 + 1)
    stage = F.when(k % 5 < 2, "queued").otherwise("parsing")
    return log.select("aggregate_id", "sequence", "ts", "kind", epoch.alias("epoch"), stage.alias("stage"), (k % 4).alias("processed"), F.when(k % 3 > 0, F.lit(9)).alias("total"), (F.lit(40_000) + 40_000 * (k % 5)).alias("seconds"), (k % 8 != 2).alias("retryable"))


JOB_LOG = """jobs AS (SELECT *, least(count(*) FILTER (WHERE kind = 'acquired') OVER (PARTITION BY aggregate_id ORDER BY sequence), event_id % 7 + 1) AS epoch, CASE WHEN event_id % 5 < 2 THEN 'queued' ELSE 'parsing' END AS stage,
    event_id % 4 AS processed, CASE WHEN event_id % 3 > 0 THEN 9 ELSE -1 END AS total, (40000 + 40000 * (event_id % 5)) * 1000000 AS micros, event_id % 8 <> 2 AS retryable, epoch_us(ts) AS tm
  FROM (SELECT event_id, ts, aggregate_id * 1000 + (sequence - 1) // 12 AS aggregate_id, (sequence - 1) % 12 + 1 AS sequence, CASE WHEN (sequence - 1) % 12 = 0 OR event_id % 6 = 0 THEN 'acquired' WHEN event_id % 6 = 1 THEN 'heartbeat' WHEN event_id % 6 = 2 THEN 'started' WHEN event_id % 6 = 3 THEN 'progress' WHEN event_id % 12 = 4 THEN 'finished'
    WHEN event_id % 36 = 10 THEN 'completed' WHEN event_id % 36 = 22 THEN 'cancelled' WHEN event_id % 12 = 10 THEN 'failed' ELSE 'progress' END AS kind FROM log))"""
JOB_STATES = f"""
WITH RECURSIVE {JOB_LOG},
r AS (SELECT DISTINCT aggregate_id, CAST(0 AS BIGINT) AS k, 'queued' AS status, '' AS stage, CAST(0 AS BIGINT) AS attempt, CAST(0 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS processed, CAST(-1 AS BIGINT) AS total, false AS working, CAST(-1 AS BIGINT) AS lease_until, CAST(-1 AS BIGINT) AS available_at, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS rejected, '' AS error FROM jobs
  UNION ALL SELECT aggregate_id, k, CASE WHEN spent THEN 'failed' WHEN NOT does THEN status WHEN kind = 'acquired' THEN 'running' WHEN kind = 'cancelled' THEN 'cancelled' WHEN kind = 'completed' THEN 'completed' WHEN kind = 'failed' THEN CASE WHEN retryable AND attempt < 3 THEN 'retry_wait' ELSE 'failed' END ELSE status END,
    CASE WHEN begun THEN 'queued' WHEN does AND kind = 'started' THEN s2 ELSE stage END, attempt + CASE WHEN begun THEN 1 ELSE 0 END, epoch + CASE WHEN begun THEN 1 ELSE 0 END,
    CASE WHEN begun THEN 0 WHEN does AND kind IN ('started', 'progress', 'finished') THEN p2 ELSE processed END, CASE WHEN begun THEN -1 WHEN does AND kind IN ('started', 'progress', 'finished') THEN t2 ELSE total END,
    CASE WHEN begun OR (does AND kind = 'started') THEN true WHEN does AND kind = 'finished' THEN false ELSE working END, CASE WHEN begun OR (does AND kind = 'heartbeat') THEN tm + micros WHEN does AND kind IN ('failed', 'cancelled') THEN -1 ELSE lease_until END,
    CASE WHEN does AND kind = 'failed' THEN tm + micros ELSE available_at END, applied + CASE WHEN does THEN 1 ELSE 0 END, rejected + CASE WHEN said <> '' THEN 1 ELSE 0 END, CASE WHEN said <> '' THEN said WHEN spent THEN 'DEPENDENCY_UNAVAILABLE' WHEN begun THEN '' ELSE error END
  FROM (SELECT *, does AND kind = 'acquired' AND attempt >= 3 AS spent, does AND kind = 'acquired' AND attempt < 3 AS begun FROM (
    SELECT *, said = '' AND NOT (CASE kind WHEN 'cancelled' THEN closed WHEN 'started' THEN stage = s2 AND working WHEN 'progress' THEN p2 = processed AND t2 = total WHEN 'finished' THEN NOT working ELSE false END) AS does FROM (
    SELECT r.*, j.kind, j.tm, j.micros, j.retryable, j.stage AS s2, j.processed AS p2, j.total AS t2, r.status IN ('completed', 'failed', 'cancelled') AS closed,
      CASE WHEN j.kind = 'cancelled' THEN '' WHEN j.kind = 'acquired' THEN CASE WHEN r.status IN ('completed', 'failed', 'cancelled') THEN 'already_terminal' WHEN r.lease_until > j.tm THEN 'already_running' WHEN r.available_at > j.tm THEN 'not_available' ELSE '' END
        WHEN j.epoch <> r.epoch THEN 'STALE_INGESTION' WHEN r.status = 'cancelled' THEN 'CANCEL_REQUESTED' WHEN r.status <> 'running' THEN 'INGESTION_NOT_RUNNING' WHEN r.lease_until <= j.tm THEN 'LEASE_EXPIRED'
        WHEN j.kind IN ('progress', 'finished') THEN CASE WHEN r.stage <> j.stage THEN 'STAGE_NOT_STARTED' WHEN NOT r.working THEN CASE WHEN j.kind = 'progress' THEN 'STAGE_ALREADY_COMPLETED' ELSE '' END WHEN j.processed < r.processed THEN 'PROGRESS_REGRESSION' ELSE '' END ELSE '' END AS said
    FROM (SELECT * REPLACE (k + 1 AS k) FROM r) r JOIN jobs j ON j.aggregate_id = r.aggregate_id AND j.sequence = r.k))))
SELECT aggregate_id, status, stage, attempt, epoch, processed, total, lease_until, applied, rejected, error, status = 'running' AND lease_until // 1000 < (SELECT max(tm) FROM jobs) // 1000 - 86400000 AS expired FROM r QUALIFY k = max(k) OVER (PARTITION BY aggregate_id)"""


@query("r1_job_log", JOB_STATES)
def job_states(spark, sf):
    return jobs.job_log(job_log(spark, sf), "1 day")


@query("r1_job_log_stream", JOB_STATES)
def job_states_stream(spark, sf):
    """The log comes up to twelve hours out of order; leases end by timeouts."""
    return jobs.latest(arriving(job_log(spark, sf), 43_200, lambda s: jobs.job_log(s, "1 day")))


@query("r4_dedupe_events_stream", "SELECT event_id, user_id, event_type FROM events")
def dedupe_events_stream(spark, sf):
    """Every fiftieth event is delivered twice, up to twelve hours apart."""
    rows = fx.log(spark, sf).select("event_id", F.col("aggregate_id").alias("user_id"), "event_type", "sequence", F.col("ts").cast("timestamp").alias("ts"))
    again = rows.where("event_id % 50 = 0").withColumn("sequence", -F.col("sequence"))
    return arriving(rows.unionByName(again), 43_200, lambda s: ev.dedupe_events(s, "1 day").select("event_id", "user_id", "event_type"))


@query("r9_stage_metrics_stream", """
SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def stage_metrics_stream(spark, sf):
    """The windows that the watermark has passed when the source ends."""
    rows = fx.log(spark, sf).select("sequence", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return arriving(rows, 43_200, lambda s: ev.stage_metrics(s, "1 hour", "1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r9_stage_duration_stream", """
SELECT aggregate_id, sequence, greatest((epoch_us(nt) - epoch_us(ts)) // 1000, 0) AS millis FROM (SELECT *, lead(event_type) OVER w AS nk, lead(ts) OVER w AS nt FROM log WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence))
WHERE event_type = 'view' AND nk = 'purchase' AND nt - ts <= INTERVAL 12 HOUR""")
def stage_duration_stream(spark, sf):
    log = fx.log(spark, sf).select("aggregate_id", "sequence", "ts", "event_type")
    return arriving(log, 43_200, lambda s: ev.stage_duration(s, "view", "purchase", 43_200, "1 day").drop("ts"))


@query("r10_catalogue_changes_stream", """
SELECT event_id, aggregate_id, event_type, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence) AS epoch FROM log WHERE event_type IN ('purchase', 'signup')""")
def catalogue_changes_stream(spark, sf):
    log = fx.log(spark, sf).select("aggregate_id", "sequence", "ts", "event_id", "event_type")
    return arriving(log, 43_200, lambda s: ev.catalogue_changes(s, ("purchase", "signup"), "1 day").drop("sequence"))


YEAR = 365 * 86_400


def requests(spark, sf):
    """A request to publish each version; a quarter of them come again up to 401 days later, some with another generation."""
    v, flags = fx.versions(spark, sf), fx.documents(spark, sf).select("doc_id", "archived", "revoked")
    k = F.col("version_id")
    good = F.when((k % 6 != 0) & (k % 7 != 0), k)
    before = Window.partitionBy("doc_id").orderBy("created_at", "version_id").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.when(k % 6 == 0, F.lit(-2)).otherwise(F.coalesce(F.last(good, ignorenulls=True).over(before), F.lit(-1)))
    rows = v.select("doc_id", "version_id", F.col("created_at").cast("timestamp").alias("ts"), expected.alias("expected"), (k % 7 != 0).alias("ready"), (F.col("legal_status") == "active").alias("active"), k.alias("generation_id"), F.lit(0).alias("again"))
    twice = rows.where(k % 4 == 1).withColumns({"ts": F.col("ts") + F.make_dt_interval(days=(k % 3 * 200 + 1).cast("int")), "generation_id": k + F.when(k % 8 == 5, 1).otherwise(0), "again": F.lit(1)})
    order = Window.partitionBy("doc_id").orderBy("ts", "version_id", "again")
    out = rows.unionByName(twice).withColumns({"sequence": F.row_number().over(order).cast("long"), "operation_id": k}).join(flags, "doc_id")
    return out.select("doc_id", "sequence", "ts", *publications.names(publications.ROW))


EFFECTS = """
WITH RECURSIVE v AS (SELECT doc_id, version_id, CAST(created_at AS TIMESTAMP) AS ts, legal_status = 'active' AS active, CASE WHEN version_id % 6 = 0 THEN -2 ELSE coalesce(last_value(CASE WHEN version_id % 6 <> 0 AND version_id % 7 <> 0 THEN version_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY created_at, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS expected FROM versions),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, version_id, again) AS k FROM (SELECT *, version_id AS generation_id, 0 AS again FROM v UNION ALL SELECT doc_id, version_id, ts + INTERVAL 1 DAY * (version_id % 3 * 200 + 1), active, expected, version_id + CASE WHEN version_id % 8 = 5 THEN 1 ELSE 0 END, 1 FROM v WHERE version_id % 4 = 1) JOIN (SELECT doc_id, archived, revoked FROM catalog) USING (doc_id)),
r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS operation_id, '' AS outcome, CAST(-1 AS BIGINT) AS publication, CAST(-1 AS BIGINT) AS version, CAST(-1 AS BIGINT) AS publication_id, CAST(-1 AS BIGINT) AS retired, CAST(-1 AS BIGINT) AS superseded, false AS searchable, CAST(0 AS BIGINT) AS revision, CAST([] AS STRUCT(o BIGINT, t TIMESTAMP, g BIGINT)[]) AS done FROM q
  UNION ALL SELECT doc_id, k, version_id, said, CASE WHEN said = 'applied' THEN version_id ELSE publication END, CASE WHEN said = 'applied' THEN version_id ELSE version END, CASE WHEN said IN ('applied', 'replay') THEN version_id ELSE -1 END, CASE WHEN said = 'applied' THEN publication ELSE -1 END, CASE WHEN said = 'applied' AND version <> version_id THEN version ELSE -1 END,
    said = 'applied' AND active AND NOT archived, revision + CASE WHEN said = 'applied' THEN 1 ELSE 0 END, CASE WHEN said = 'applied' THEN list_append(done, {'o': version_id, 't': ts, 'g': generation_id}) ELSE done END
  FROM (SELECT *, CASE WHEN len(known) > 0 THEN CASE WHEN known[-1].g = generation_id THEN 'replay' ELSE 'IDEMPOTENCY_CONFLICT' END WHEN expected <> publication THEN 'VERSION_CONFLICT' WHEN revoked THEN 'SOURCE_REVOKED' WHEN version_id % 7 = 0 THEN 'GENERATION_NOT_READY' ELSE 'applied' END AS said
    FROM (SELECT r.doc_id, q.k, r.publication, r.version, r.revision, r.done, q.version_id, q.generation_id, q.expected, q.active, q.archived, q.revoked, q.ts, list_filter(r.done, lambda d: d.o = q.version_id AND q.ts - d.t <= INTERVAL 365 DAY) AS known FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k + 1)))
SELECT doc_id, k AS sequence, operation_id, outcome, publication_id, retired, superseded, searchable, revision FROM r WHERE k > 0"""


@query("l2_publication_effects", EFFECTS)
def publication_effects(spark, sf):
    return publications.publication_effects(requests(spark, sf), YEAR)


@query("l2_publication_effects_stream", EFFECTS)
def publication_effects_stream(spark, sf):
    """Requests come up to thirty days out of order; operations are forgotten by timeouts."""
    return arriving(requests(spark, sf), 30 * 86_400, lambda s: publications.publication_effects(s, YEAR, "40 days"))


@query("s6_index_sink_stream", """
SELECT c.doc_id AS batch_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(len(words)) AS BIGINT) AS total, CASE WHEN c.doc_id % 3 = 0 THEN 1 ELSE 0 END AS replays, CASE WHEN c.doc_id % 3 = 1 THEN 1 ELSE 0 END AS conflicts FROM chunks c GROUP BY 1, 4, 5""")
def index_sink_stream(spark, sf):
    """The chunks of a document are a batch. A stream writes them; then a third come again as they were, and a third
    otherwise, and the stream goes on from its checkpoint."""
    path = f"{shared_dir(spark)}/attestra-{uuid.uuid4().hex}"
    rows = fx.chunks(spark, sf).select(F.col("doc_id").alias("batch_id"), "ordinal", F.size("words").alias("n"))
    again = rows.where("batch_id % 3 < 2").withColumn("n", F.col("n") + (F.col("batch_id") % 3).cast("int"))
    sink = bt.index_sink(f"{path}/ledger", f"{path}/rows", "ordinal", "n")
    for k, some in enumerate((rows, again)):
        some.repartition("batch_id").write.parquet(f"{path}/in/{k}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in/*")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    data = bt.committed(spark, f"{path}/ledger", f"{path}/rows").groupBy("batch_id").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    seen = spark.read.schema(bt.LEDGER).parquet(f"{path}/ledger").groupBy("batch_id").agg(*[F.count_if(F.col("outcome") == x).cast("int").alias(c) for x, c in (("replay", "replays"), ("conflict", "conflicts"))])
    return data.join(seen, "batch_id")
