"""Stateful streams against their batch forms: shuffled files, gaps, late rows, replays and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.sources import batches
from attestra.streaming import events, jobs, ordered, publications

JOB = "aggregate_id long, sequence long, at double, kind string, epoch long, stage string, processed long, total long, seconds long, retryable boolean"


def job_rows(rng, keys, n):
    out = []
    for a in range(keys):
        at, epoch = 1_700_000_000.0 + a, 0
        for k in range(1, n + 1):
            at += rng.choice([1, 5, 30, 90])
            kind = rng.choice(["acquired", "acquired", "heartbeat", "started", "started", "progress", "progress", "progress", "finished", "failed", "odd"] + ["completed", "cancelled"] * (k > n - 3))
            epoch = epoch + 1 if kind == "acquired" and rng.random() < 0.6 else epoch
            out.append((a, k, at, kind, rng.choice([epoch, epoch, epoch, 1, None]), rng.choice(["queued", "parsing", None]), rng.choice([0, 1, 2, 5, None]), rng.choice([10, 10, None]), rng.choice([20, 60, 200]), rng.random() < 0.8))
    return out


def files(spark, df, path, parts):
    """Rows dealt to `parts` files, which are read in the order of their names; some rows are in two."""
    twice = df.where(f"pmod(hash({df.columns[0]}, sequence), 7) = 0").withColumn("again", F.lit(1))
    rows = df.withColumn("again", F.lit(0)).unionByName(twice)
    for k in range(parts):
        rows.where(F.pmod(F.xxhash64(df.columns[0], "sequence", "again"), F.lit(parts)) == k).drop("again").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return f"{path}/in"


def through(spark, make, source, schema, path):
    """What a stream gives of the files of `source` that it has not seen, with those given before."""
    q = make(events.event_log_source(spark, source, schema, 3)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


@pytest.mark.parametrize("seed", [1])
def test_job_states_of_a_stream_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    df = spark.createDataFrame(job_rows(rng, 12, 25), JOB).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).drop("at")
    df = df.where("not (aggregate_id = 3 and sequence = 7)").repartition(4)  # lost for good
    last = spark.createDataFrame([(999, 1, 1_700_100_000.0, "acquired", None, None, None, None, 60, True)], JOB).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).drop("at")
    make = lambda s: jobs.job_log(s, "2 hours")
    source = files(spark, df, tmp_path, 4)
    first = jobs.latest(through(spark, make, source, df.schema, tmp_path))
    whole = first.join(jobs.job_log(df, "2 hours").where("aggregate_id <> 3"), "aggregate_id", "left_semi")
    same(whole.drop("expired"), jobs.job_log(df, "2 hours").where("aggregate_id <> 3").drop("expired"))
    last.coalesce(1).write.mode("append").parquet(source)  # after a restart; the watermark passes all leases and the gap
    got = jobs.latest(through(spark, make, source, df.schema, tmp_path))
    want = jobs.job_log(df.unionByName(last), "2 hours")
    same(got, want)
    assert {r.status for r in want.collect()} > {"running", "failed"} and want.where("expired").count() > 1
    assert want.where("rejected > 0").count() > 5 and want.where("attempt > 1").count() > 5


def test_rules_of_jobs(spark):
    t = 1_700_000_000.0
    rows = [
        (1, 1, t, "started", 1, "parsing", 0, 9, 0, False), (1, 2, t + 1, "acquired", None, None, None, None, 60, None), (1, 3, t + 2, "started", 1, "parsing", 0, 9, 0, False),
        (1, 4, t + 3, "progress", 1, "parsing", 5, 9, 0, False), (1, 5, t + 4, "progress", 1, "parsing", 4, 9, 0, False), (1, 6, t + 5, "finished", 1, "parsing", 9, 9, 0, False),
        (1, 7, t + 6, "acquired", None, None, None, None, 60, None), (1, 8, t + 7, "failed", 1, None, None, None, 100, True), (1, 9, t + 8, "acquired", None, None, None, None, 60, None),
        (1, 10, t + 108, "acquired", None, None, None, None, 60, None), (1, 11, t + 109, "heartbeat", 1, None, None, None, 60, None), (1, 12, t + 170, "progress", 2, "queued", 1, None, 0, None),
        (2, 1, t, "acquired", None, None, None, None, 10, None), (2, 2, t + 1, "cancelled", None, None, None, None, 0, None), (2, 3, t + 2, "progress", 1, "queued", 1, None, 0, None),
    ]
    df = spark.createDataFrame(rows, JOB).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = {r.aggregate_id: (r.status, r.stage, r.attempt, r.epoch, r.applied, r.rejected, r.error, r.expired) for r in jobs.job_log(df, "1 second").collect()}
    assert got == {1: ("running", "queued", 2, 2, 6, 6, "LEASE_EXPIRED", True), 2: ("cancelled", "queued", 1, 1, 2, 1, "CANCEL_REQUESTED", False)}
    before = {r.aggregate_id: (r.status, r.stage, r.processed, r.attempt, r.error) for r in jobs.job_log(df.where("sequence <= 9")).collect()}
    assert before[1] == ("retry_wait", "parsing", 9, 1, "not_available")


def test_change_feed_and_stage_pairs_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(a * 1000 + k, a, k, 1_700_000_000 + a + 40 * k + rng.randint(0, 30), rng.choice(["view", "view", "purchase", "signup", "click"])) for a in range(9) for k in range(1, 41)]
    df = spark.createDataFrame(rows, "event_id long, aggregate_id long, sequence long, at long, event_type string").withColumn("ts", F.timestamp_seconds("at"))
    early, late = df.where("sequence <= 20"), df.where("sequence > 20")
    for name, make in (("feed", lambda s: events.catalogue_changes(s, ("purchase", "signup"), "2 hours")), ("pairs", lambda s: events.stage_duration(s, "view", "purchase", 60, "2 hours"))):
        path = tmp_path / name
        source = files(spark, early, path, 3)
        through(spark, make, source, df.schema, path)
        files(spark, late, path, 3)
        got = through(spark, make, source, df.schema, path)
        assert got.count() > 20
        same(got.withColumn("ts", F.col("ts").cast("string")) if "ts" in got.columns else got, make(df).withColumn("ts", F.col("ts").cast("string")) if name == "pairs" else make(df))
        if name == "pairs":
            assert got.count() < events.stage_duration(df, "view", "purchase").count()
            same(events.stage_latency(got), events.stage_latency(make(df)))


REQUEST = "doc_id long, sequence long, at long, operation_id long, version_id long, generation_id long, expected long, ready boolean, active boolean, archived boolean, revoked boolean"


def test_publications_of_a_stream_equal_the_batch(spark, tmp_path):
    rng, rows = random.Random(9), []
    for d in range(12):
        current, at, seen = None, 1_700_000_000 + d, []
        for k in range(1, 25):
            at += rng.choice([10, 300, 4000])
            if seen and rng.random() < 0.3:
                r = rng.choice(seen)
                rows.append((d, k, at, *r[:1], r[1] + (rng.random() < 0.2), *r[2:]))
                continue
            r = (d * 100 + k, rng.randint(1, 4), k, current if rng.random() < 0.8 else 5, rng.random() < 0.9, rng.random() < 0.8, d == 3, d == 4 and k > 12)
            rows.append((d, k, at, *r))
            if r[3] == current and r[4] and not r[7]:
                current, seen = r[0], [*seen, r]
    df = spark.createDataFrame(rows, REQUEST).withColumn("ts", F.timestamp_seconds("at"))
    make = lambda s: publications.publication_effects(s, 5000, "1 day")
    got = through(spark, make, files(spark, df, tmp_path, 4), df.schema, tmp_path)
    same(got, make(df))
    assert {r.outcome for r in got.select("outcome").distinct().collect()} == {"applied", "replay", "IDEMPOTENCY_CONFLICT", "VERSION_CONFLICT", "SOURCE_REVOKED", "GENERATION_NOT_READY"}
    forgotten = got.where("outcome = 'replay'").count() < publications.publication_effects(df).where("outcome = 'replay'").count()
    assert forgotten
    one = {r.operation_id: (r.outcome, r.publication_id, r.retired, r.superseded, r.searchable, r.revision) for r in publications.publication_effects(spark.createDataFrame([
        (1, 1, 1, 10, 7, 1, None, True, True, False, False), (1, 2, 2, 11, 8, 2, 10, True, False, False, False), (1, 3, 3, 12, 8, 3, 11, True, True, False, False), (1, 4, 4, 13, 9, 3, 10, True, True, False, False),
    ], REQUEST).withColumn("ts", F.timestamp_seconds("at"))).collect()}
    assert one == {10: ("applied", 10, -1, -1, True, 1), 11: ("applied", 11, 10, 7, False, 2), 12: ("applied", 12, 11, -1, True, 3), 13: ("VERSION_CONFLICT", -1, -1, -1, False, 3)}


def test_a_sink_killed_between_data_and_ledger_has_each_batch_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(b, k, f"{b}-{k}") for b in range(40) for k in range(3)], "batch_id long, k long, v string")
    ledger, out = f"{tmp_path}/ledger", f"{tmp_path}/out"
    sink, killed = batches.index_sink(ledger, out, "k", "v"), []

    def kills(rows, number):
        with monkeypatch.context() as m:
            if number == 1 and not killed:
                m.setattr(batches, "spent", lambda *a: None)
                write = type(rows.write).parquet

                def parquet(self, path, *a, **b):
                    if path.startswith(f"{ledger}/"):
                        killed.append(path)
                        raise RuntimeError("killed")
                    return write(self, path, *a, **b)

                m.setattr(type(rows.write), "parquet", parquet)
            sink(rows, number)

    def run():
        stream = events.event_log_source(spark, f"{tmp_path}/in", df.schema, 100)
        q = stream.writeStream.foreachBatch(kills).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()

    df.where("batch_id < 20").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    df.where("batch_id >= 15").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="killed"):
        run()
    assert killed and batches.committed(spark, ledger, out).count() == 60
    run()
    same(batches.committed(spark, ledger, out), df)
    assert spark.read.parquet(out).count() == 120
    got = spark.read.schema(batches.LEDGER).parquet(ledger).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"written": 40, "replay": 5}


def test_sets_of_many_files_are_not_cut(spark):
    from attestra.plans import stream_queries

    year = 365 * 86_400
    rows = [(d, k, 1_600_000_000 + (k * 50 + d) * 86_400, 100 * d + k, 100 * d + k - 1 if k > 1 else None) for d in range(24) for k in range(1, 26)]
    df = spark.createDataFrame(rows, "doc_id long, sequence long, s long, operation_id long, expected long").select("*", F.timestamp_seconds("s").alias("ts")).drop("s")
    df = df.withColumns({"version_id": F.col("operation_id"), "generation_id": F.col("operation_id"), "ready": F.lit(True), "active": F.lit(True), "archived": F.lit(False), "revoked": F.lit(False)})
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")  # some 150 files a set
    try:
        got = stream_queries.arriving(df, 30 * 86_400, lambda s: publications.publication_effects(s, year, "40 days"))
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    same(got, publications.publication_effects(df, year))


def test_keys_of_a_stream_share_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 8)
    year = 365 * 86_400
    df = spark.range(3000).selectExpr("id as doc_id", "1 + id % 2 as sequence", "timestamp_seconds(1600000000 + id) as ts", "id as operation_id", "id as version_id", "id as generation_id", "-1L as expected", "true as ready", "true as active", "false as archived", "false as revoked")
    rows = df.unionByName(df.withColumn("sequence", 3 - F.col("sequence")))
    rows.write.parquet(f"{tmp_path}/in")
    q = publications.publication_effects(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), year, "1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/out"), publications.publication_effects(rows, year))
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) == 8  # one for each key before
