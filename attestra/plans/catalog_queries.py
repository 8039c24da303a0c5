"""Queries of the catalogue, lifecycle and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import catalog as ct
from attestra.plans import fixtures as fx
from attestra.plans.book import query
from attestra.streaming import events as ev

NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def now():
    return F.expr("timestamp'1998-06-01 00:00:00'")


HISTORY = """history AS (SELECT *, lead(published_at) OVER (PARTITION BY doc_id ORDER BY published_at, publication_id) AS retired_at FROM publications)"""
ELIGIBLE = """eligible AS (SELECT d.doc_id, d.title, h.publication_id, h.version_id FROM catalog d JOIN history h ON h.doc_id = d.doc_id AND h.retired_at IS NULL JOIN versions v ON v.version_id = h.version_id
  WHERE NOT archived AND NOT revoked AND legal_status = 'active' AND publication_status = 'published' AND parse_status = 'ready' AND index_status = 'ready')"""


def eligible_rows(spark, sf):
    return ct.eligible(fx.documents(spark, sf), fx.publications(spark, sf), fx.versions(spark, sf))


@query("w12_publication_history", f"WITH {HISTORY} SELECT publication_id, doc_id, published_at, retired_at FROM history")
def publication_history(spark, sf):
    return ct.publication_history(fx.publications(spark, sf)).select("publication_id", "doc_id", "published_at", "retired_at")


@query("p2_eligible", f"WITH {HISTORY}, {ELIGIBLE} SELECT * FROM eligible")
def eligible(spark, sf):
    return eligible_rows(spark, sf)


@query("a2_library_profile", f"""
WITH {HISTORY}, {ELIGIBLE} SELECT (SELECT count(*) FROM catalog) AS documents, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM eligible) AS eligible, (SELECT max(published_at) FROM publications) AS last_published""")
def library_profile(spark, sf):
    return ct.library_profile(fx.documents(spark, sf), fx.versions(spark, sf), fx.publications(spark, sf))


@query("a8_selection_hash", f"""
WITH {HISTORY}, {ELIGIBLE} SELECT doc_id % 8 AS part, count(*) AS items, sha256(string_agg(doc_id || ':' || publication_id || ':' || version_id, ',' ORDER BY doc_id)) AS hash FROM eligible GROUP BY 1""")
def selection_hash(spark, sf):
    return ct.selection_hash(eligible_rows(spark, sf).withColumn("part", F.col("doc_id") % 8))


@query("l1_capture_snapshot", f"""
WITH {HISTORY}, {ELIGIBLE} SELECT 7 AS epoch, doc_id, version_id, sha256(doc_id || ':' || publication_id || ':' || version_id) AS item_hash FROM eligible""")
def capture_snapshot(spark, sf):
    return eligible_rows(spark, sf).select(F.lit(7).alias("epoch"), "doc_id", "version_id", F.sha2(F.concat_ws(":", "doc_id", "publication_id", "version_id"), 256).alias("item_hash"))


@query("p16_title_search", "SELECT doc_id, title FROM catalog WHERE contains(lower(title), '000012')")
def title_search(spark, sf):
    return ct.title_search(fx.documents(spark, sf), "000012").select("doc_id", "title")


@query("t5_keyset_page", """
SELECT version_id, created_at FROM versions WHERE created_at < TIMESTAMP '1997-01-01' OR (created_at = TIMESTAMP '1997-01-01' AND version_id < 1000) ORDER BY created_at DESC, version_id DESC LIMIT 26""")
def keyset_page(spark, sf):
    import datetime

    return ct.keyset_page(fx.versions(spark, sf).select("version_id", "created_at"), ["created_at", "version_id"], (datetime.datetime(1997, 1, 1), 1000), 25).select("version_id", "created_at")


@query("n2_generation_timeline", """
SELECT doc_id, version_id, created_at, kind, parse_status, index_status FROM (
  SELECT doc_id, version_id, created_at, 'parse' AS kind, parse_status, NULL AS index_status FROM versions UNION ALL SELECT doc_id, version_id, created_at, 'index', NULL, index_status FROM versions)""")
def generation_timeline(spark, sf):
    v = fx.versions(spark, sf)
    return ct.generation_timeline(v.select("doc_id", "version_id", "created_at", "parse_status"), v.select("doc_id", "version_id", "created_at", "index_status"))


@query("l4_document_list", """
SELECT d.doc_id, d.title, CASE WHEN archived THEN 'archived' WHEN p.doc_id IS NOT NULL THEN 'active' WHEN coalesce(v.failed, false) THEN 'failed' ELSE 'staging' END AS state, coalesce(v.versions, 0) AS versions, v.latest
FROM catalog d LEFT JOIN (SELECT doc_id, count(*) AS versions, last(version_id ORDER BY created_at, version_id) AS latest, bool_or(parse_status = 'failed') AS failed FROM versions GROUP BY 1) v USING (doc_id)
LEFT JOIN (SELECT DISTINCT doc_id FROM publications) p ON p.doc_id = d.doc_id""")
def document_list(spark, sf):
    return ct.document_list(fx.documents(spark, sf), fx.publications(spark, sf), fx.versions(spark, sf))


@query("j14_lateral_latest", """
SELECT doc_id, version_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, version_id DESC) AS r FROM versions) WHERE r = 1""")
def lateral_latest(spark, sf):
    return ct.latest_per(fx.versions(spark, sf).select("doc_id", "version_id", "created_at"), "doc_id", F.col("created_at").desc(), F.col("version_id").desc())


@query("w13_distinct_on", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS r FROM events) WHERE r = 1""")
def distinct_on(spark, sf):
    rows = fx.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return ct.distinct_on(rows, "user_id", F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2), F.col("event_id"))


REPORT = f"""latest AS (SELECT doc_id, max(tm) AS latest FROM (SELECT doc_id, created_at AS tm FROM versions UNION ALL SELECT doc_id, published_at FROM publications) GROUP BY 1),
busy AS (SELECT doc_id, count(*) AS active FROM versions WHERE index_status = 'staging' AND version_id % 3 = 0 GROUP BY 1),
report AS (SELECT d.doc_id, l.latest, l.latest + INTERVAL 90 DAY AS eligible_after, coalesce(b.active, 0) AS active,
  list_filter([CASE WHEN NOT archived AND NOT revoked THEN 'DOCUMENT_NOT_ARCHIVED' END, CASE WHEN b.active > 0 THEN 'PROTECTED_REFERENCES' END, CASE WHEN l.latest + INTERVAL 90 DAY > {NOW} THEN 'RETENTION_ACTIVE' END], lambda x: x IS NOT NULL) AS blockers
  FROM catalog d LEFT JOIN latest l USING (doc_id) LEFT JOIN busy b ON b.doc_id = d.doc_id)"""


def report_rows(spark, sf):
    v, p = fx.versions(spark, sf), fx.publications(spark, sf)
    activity = [v.select("doc_id", F.col("created_at").alias("at")), p.select("doc_id", F.col("published_at").alias("at"))]
    return ct.purge_report(fx.documents(spark, sf), activity, v.where("index_status = 'staging' and version_id % 3 = 0"), 90, now())


@query("a5_purge_report", f"WITH {REPORT} SELECT *, len(blockers) = 0 AS allowed FROM report")
def purge_report(spark, sf):
    return report_rows(spark, sf)


@query("l12_accept_purge", f"""
WITH {REPORT} SELECT doc_id, CASE WHEN len(blockers) > 0 THEN 'blocked' WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'accepted' END AS outcome FROM report""")
def accept_purge(spark, sf):
    mark = lambda c: F.sha2(F.concat_ws("|", "doc_id", c, F.array_join("blockers", ",")), 256)
    rows = report_rows(spark, sf).withColumn("now_print", mark(F.lit("v1"))).withColumn("plan_print", F.when(F.col("doc_id") % 4 == 0, mark(F.lit("v0"))).otherwise(F.col("now_print")))
    return rows.select("doc_id", F.when(~F.col("allowed"), "blocked").when(F.col("now_print") != F.col("plan_print"), "stale").otherwise("accepted").alias("outcome"))


def purge_objects(spark, sf):
    return fx.versions(spark, sf).select(F.col("doc_id").alias("plan_id"), "doc_id", F.col("version_id").alias("object_id"), F.when(F.col("version_id") % 12 == 0, "pending").otherwise("deleted").alias("state"), (F.col("version_id") % 10).alias("attempts"))


@query("a6_purge_status", "SELECT doc_id AS plan_id, count(*) AS objects, count(*) FILTER (WHERE version_id % 12 <> 0) AS deleted FROM versions GROUP BY 1")
def purge_status(spark, sf):
    return ct.purge_status(purge_objects(spark, sf))


@query("n3_purge_manifest", """
SELECT version_id AS object_id, doc_id, CASE WHEN version_id % 2 = 0 THEN 'source' WHEN version_id % 3 = 0 THEN 'artifact' ELSE 'stored' END AS kind FROM versions""")
def purge_manifest(spark, sf):
    o = fx.versions(spark, sf).select(F.col("version_id").alias("object_id"), "doc_id")
    return ct.purge_manifest([("source", o.where("object_id % 2 = 0")), ("artifact", o.where("object_id % 3 = 0")), ("stored", o)]).select("object_id", "doc_id", "kind")


@query("j10_unreferenced_objects", """
SELECT p_partkey AS object_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def unreferenced_objects(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    refs = [lines.where(c).select(F.col("l_partkey").alias("object_id")) for c in ("l_returnflag = 'R'", "l_quantity > 48")]
    return ct.unreferenced_objects(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("object_id")), refs)


@query("l7_finalise_purge", """
SELECT d.doc_id AS plan_id, d.doc_id, (SELECT count(*) FROM versions v WHERE v.doc_id = d.doc_id) AS versions, (SELECT count(*) FROM publications p WHERE p.doc_id = d.doc_id) AS publications
FROM catalog d WHERE archived AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.doc_id = d.doc_id AND v.version_id % 12 = 0)""")
def finalise_purge(spark, sf):
    plans = fx.documents(spark, sf).where("archived").select(F.col("doc_id").alias("plan_id"), "doc_id")
    return ct.finalise_purge(plans, purge_objects(spark, sf), {"versions": fx.versions(spark, sf), "publications": fx.publications(spark, sf)})


@query("l13_purge_due", """
SELECT version_id AS object_id, CASE WHEN version_id % 10 >= 8 THEN 'plan_failed' ELSE 'due' END AS outcome FROM versions WHERE version_id % 12 = 0""")
def purge_due(spark, sf):
    return purge_objects(spark, sf).where("state = 'pending'").select("object_id", F.when(F.col("attempts") >= 8, "plan_failed").otherwise("due").alias("outcome"))


@query("a3_generation_complete", """
SELECT d.doc_id, coalesce(c.n, 0) AS chunks, d.expected, CASE WHEN c.n IS NULL THEN d.expected = 0 ELSE c.n = d.expected AND lo = 0 AND hi = c.n - 1 AND c.u = c.n END AS complete FROM (
  SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 3 ELSE (len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) + 39) // 40 END AS BIGINT) AS expected FROM documents) d
LEFT JOIN (SELECT doc_id, count(*) AS n, min(ordinal) AS lo, max(ordinal) AS hi, count(DISTINCT ordinal) AS u FROM chunks GROUP BY 1) c USING (doc_id)""")
def generation_complete(spark, sf):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    expected = fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(3).cast("long")).otherwise(F.floor((words + 39) / 40)).alias("expected"))
    return ct.generation_complete(fx.chunks(spark, sf).select("doc_id", "ordinal"), expected)


@query("a4_quality_report", """
SELECT doc_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warnings, list_sort(list(DISTINCT code)) AS codes,
  CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS status FROM (
  SELECT doc_id, CASE WHEN length(text) < 20 THEN 'critical' WHEN length(text) > 200 THEN 'warning' ELSE 'info' END AS severity, 'CODE_' || CAST(length(text) % 4 AS VARCHAR) AS code FROM blocks) GROUP BY 1""")
def quality_report(spark, sf):
    n = F.length("text")
    rows = fx.blocks(spark, sf).select("doc_id", F.when(n < 20, "critical").when(n > 200, "warning").otherwise("info").alias("severity"), F.concat(F.lit("CODE_"), (n % 4).cast("string")).alias("code"))
    return ct.quality_report(rows)


@query("a13_admission_usage", """
SELECT reserved, running, reserved + running AS used, reserved + running < 9000 AS fits FROM (SELECT count(*) FILTER (WHERE event_type IN ('signup', 'view')) AS reserved, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS running FROM events)""")
def admission_usage(spark, sf):
    e = fx.table(spark, sf, "events")
    state = F.when(F.col("event_type") == "signup", "reserved").when(F.col("event_type") == "view", "stored").otherwise("attached")
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "purchase", "running").otherwise("done")
    return ct.admission_usage(e.select(state.alias("state")), e.select(status.alias("status")), 9000)


@query("a7_debug_summary", """
WITH p AS (SELECT user_id AS run_id, event_id // 2 AS call_id, event_id % 2 AS kind, CASE WHEN event_id % 50 = 0 THEN 'pending' WHEN user_id % 9 = 0 THEN 'expired' ELSE 'stored' END AS state FROM events),
w AS (SELECT run_id, bool_and(k = 2) AS paired FROM (SELECT run_id, call_id, count(DISTINCT kind) AS k FROM p GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT run_id, count(*) AS parts, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'expired') AS expired, count(*) FILTER (WHERE state = 'stored') AS stored FROM p GROUP BY 1)
SELECT run_id, parts, stored, pending, paired, CASE WHEN expired = parts THEN 'expired' WHEN stored = 0 THEN CASE WHEN pending > 0 THEN 'pending' ELSE 'unavailable' END WHEN stored = parts AND paired THEN 'available' ELSE 'partial' END AS state FROM c JOIN w USING (run_id)""")
def debug_summary(spark, sf):
    k = F.col("event_id")
    state = F.when(k % 50 == 0, "pending").when(F.col("user_id") % 9 == 0, "expired").otherwise("stored")
    return ct.debug_summary(fx.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.floor(k / 2).alias("call_id"), (k % 2).alias("kind"), state.alias("state")))


@query("l5_expire_private", f"""
SELECT event_id AS run_id, gone AS expired, sha256(props) AS text_hash, length(props) AS text_length, CASE WHEN NOT gone THEN props END AS text FROM (
  SELECT *, event_type IN ('purchase', 'error') AND event_id % 7 < 4 AS gone FROM events)""")
def expire_private(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("props").alias("text"), F.col("event_type").isin("purchase", "error").alias("terminal"), F.when(F.col("event_id") % 7 < 4, now()).otherwise(now() + F.make_dt_interval(F.lit(1))).alias("expires_at"),
    )
    return ct.expire_private(rows, now()).select("run_id", "expired", "text_hash", "text_length", "text")


@query("l9_run_summary", """
SELECT l_orderkey AS run_id, left(p_name, 12) AS excerpt, l_returnflag AS status, epoch(l_shipdate) - epoch(o_orderdate) AS seconds FROM items JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE row = 1""")
def run_summary(spark, sf):
    first = fx.table(spark, sf, "lineitem")
    first = ct.latest_per(first, "l_orderkey", *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    rows = first.join(fx.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(fx.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("run_id"), F.col("p_name").alias("question"), F.col("l_returnflag").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("l_shipdate").alias("finished_at"))
    return ct.run_summary(rows, 12).withColumn("seconds", F.col("seconds").cast("double"))


def runs(spark, sf):
    k = F.col("o_orderkey")
    at = F.col("o_orderdate")
    return fx.table(spark, sf, "orders").select(
        k.alias("run_id"), F.when(k % 3 == 0, "running").when(k % 3 == 1, "created").otherwise("completed").alias("status"), (k % 7 == 0).alias("cancelled"), F.when(k % 5 != 0, at).alias("lease_until"),
        (at + F.make_dt_interval(F.lit(300))).alias("deadline_at"), (k % 4).cast("int").alias("epoch"), (k % 6).cast("int").alias("recoveries"), F.lit(3).alias("max_recoveries"),
    )


@query("r5_lease_expiry", f"""
SELECT o_orderkey AS run_id, CASE WHEN k % 7 = 0 THEN 'cancelled' WHEN tm + INTERVAL 300 DAY <= {NOW} THEN 'deadline_exceeded' WHEN k % 8 = 0 THEN 'source_revoked' WHEN k % 4 > 0 AND k % 6 >= 3 THEN 'internal_error' ELSE 'resume' END AS outcome
FROM (SELECT *, o_orderkey AS k, o_orderdate AS tm FROM orders) WHERE k % 3 IN (0, 1) AND (k % 5 = 0 OR tm <= {NOW} OR (k % 7 <> 0 AND tm + INTERVAL 300 DAY <= {NOW}))""")
def lease_expiry(spark, sf):
    revoked = fx.table(spark, sf, "orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("run_id"))
    return ct.lease_expiry(runs(spark, sf), revoked, now())


@query("r6_retry_schedule", """
SELECT o_orderkey, CASE WHEN again THEN 'retry_wait' ELSE 'failed' END AS status, CASE WHEN again THEN CAST(least(300, 2 * pow(2, least(o_orderkey % 12, 30))) AS BIGINT) END AS delay_seconds FROM (
  SELECT *, o_orderkey % 2 = 0 AND o_orderkey % 12 + 1 < 9 AND o_orderkey % 5 <> 0 AS again FROM orders)""")
def retry_schedule(spark, sf):
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select("o_orderkey", (k % 2 == 0).alias("retryable"), (k % 12 + 1).cast("int").alias("attempt"), F.lit(9).alias("max_attempts"), F.when(k % 5 == 0, "PDF_INVALID").otherwise("TIMEOUT").alias("error_code"))
    return ct.retry_schedule(rows).select("o_orderkey", "status", "delay_seconds")


@query("r7_redispatch", f"""
SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 7 <> 0 AND o_orderdate <= {NOW} AND (o_orderkey % 5 = 0 OR o_orderdate + INTERVAL 10 DAY <= {NOW})
  AND (o_orderkey % 2 = 0 OR o_orderdate + INTERVAL 60 SECOND <= {NOW}) AND o_orderkey % 11 <> 0""")
def redispatch(spark, sf):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    o = fx.table(spark, sf, "orders")
    jobs = o.select(k.alias("job_id"), F.when(k % 3 == 0, "queued").when(k % 3 == 1, "retry_wait").otherwise("done").alias("status"), (k % 7 == 0).alias("cancelled"), at.alias("available_at"), F.when(k % 5 != 0, at + F.make_dt_interval(F.lit(10))).alias("lease_until"), F.when(k % 2 != 0, at).alias("last_dispatch_at"))
    box = o.select(k.alias("job_id"), F.when(k % 11 != 0, at).alias("published_at"))
    return ct.redispatch(jobs, box, now()).select("job_id")


def outbox(spark, sf):
    k, at = F.col("event_id"), F.col("ts")
    topic = F.when(k % 4 == 0, "ingestion.jobs.v1").when(k % 4 == 1, "ingestion.events.v1").when(k % 4 == 2, "run.events").otherwise(F.when(k % 3 == 0, "other").otherwise("knowledge.events"))
    ids = F.concat(F.lit('"schema_version":1,"event_id":"'), k.cast("string"), F.lit('"'))
    own = lambda name: F.concat(F.lit(f'"{name}":"'), F.when(k % 17 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string")), F.lit('"'))
    wrap = lambda *xs: F.concat(F.lit("{"), F.concat_ws(",", *xs), F.lit("}"))
    payload = F.when(k % 4 == 0, wrap(ids, own("job_id"))).when(k % 4 == 1, wrap(ids, own("job_id"), F.lit('"sequence":3'))).when(k % 4 == 2, wrap(ids, own("run_id"), F.lit('"sequence":3'))).otherwise(wrap(own("document_id")))
    kind = F.when(k % 4 == 0, F.when(k % 5 == 0, "other").otherwise("ingestion.dispatch")).when(k % 4 == 3, "document.archived").otherwise("x")
    return fx.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("aggregate_id"), topic.alias("topic"), kind.alias("event_type"), payload.alias("payload"), at.alias("available_at"),
        F.when(k % 3 == 0, at).alias("published_at"), F.when(k % 10 == 0, at).alias("claim_until"), (k % 9).cast("int").alias("attempts"), F.when(k % 23 == 0, "E").alias("last_error"),
    )


@query("s7_outbox_route", """
SELECT event_id, CASE WHEN k % 4 = 3 AND k % 3 = 0 THEN 'OUTBOX_INVALID_TOPIC' WHEN k % 17 = 0 OR (k % 4 = 0 AND k % 5 = 0) THEN 'OUTBOX_INVALID_PAYLOAD' END AS error,
  CASE WHEN (k % 4 = 3 AND k % 3 = 0) OR k % 17 = 0 OR (k % 4 = 0 AND k % 5 = 0) THEN NULL WHEN k % 4 = 0 THEN 'jobs' WHEN k % 4 = 1 THEN 'ingestion.events.v1:' || user_id WHEN k % 4 = 2 THEN 'run.events:' || user_id ELSE 'knowledge' END AS stream
FROM (SELECT *, event_id AS k FROM events)""")
def outbox_route(spark, sf):
    return ct.outbox_route(outbox(spark, sf)).select("event_id", "error", "stream")


@query("r8_outbox_ready", "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 9 < 8 AND event_id % 23 <> 0 AND ts <= TIMESTAMP '2024-02-01' AND (event_id % 10 <> 0 OR ts <= TIMESTAMP '2024-02-01')")
def outbox_ready(spark, sf):
    return ct.outbox_ready(outbox(spark, sf).withColumnRenamed("last_error", "error"), F.expr("timestamp'2024-02-01 00:00:00'")).select("event_id")


@query("a14_attention_required", """
SELECT CASE k % 4 WHEN 0 THEN 'ingestion.jobs.v1' WHEN 1 THEN 'ingestion.events.v1' WHEN 2 THEN 'run.events' ELSE CASE WHEN k % 3 = 0 THEN 'other' ELSE 'knowledge.events' END END AS topic, bool_or(k % 3 <> 0 AND (k % 23 = 0 OR k % 9 >= 8)) AS attention FROM (SELECT event_id AS k FROM events) GROUP BY 1""")
def attention_required(spark, sf):
    return ct.attention_required(outbox(spark, sf).withColumnRenamed("last_error", "error"))


@query("r11_idempotent_commands", """
SELECT event_id AS request_id, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN event_type = first(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, event_id % 20 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def idempotent_commands(spark, sf):
    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("principal"), (F.col("event_id") % 20).alias("key"), F.col("event_type").alias("hash"), F.col("ts").alias("at"))
    return ct.idempotent_commands(rows).select("request_id", "outcome")


@query("w10_stage_duration", """
SELECT aggregate_id, sequence, greatest((epoch_us(nt) - epoch_us(ts)) // 1000, 0) AS millis FROM (SELECT *, lead(event_type) OVER w AS nk, lead(ts) OVER w AS nt FROM log WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence)) WHERE event_type = 'view' AND nk = 'purchase'""")
def stage_duration(spark, sf):
    return ev.stage_duration(fx.log(spark, sf), "view", "purchase").drop("ts")


GAPPED = "gapped AS (SELECT * FROM log WHERE event_id % 97 <> 0)"


@query("w11_sequence_gaps", f"""
WITH {GAPPED} SELECT aggregate_id, count(*) FILTER (WHERE sequence - before > 1) AS gaps, min(sequence) AS first, max(sequence) AS last, count(*) FILTER (WHERE sequence - before > 1) = 0 AS whole FROM (
  SELECT *, lag(sequence, 1, 0) OVER (PARTITION BY aggregate_id ORDER BY sequence) AS before FROM gapped) GROUP BY 1""")
def sequence_gaps(spark, sf):
    return ev.sequence_gaps(fx.log(spark, sf).where("event_id % 97 <> 0"))


@query("r3_replay", f"""
WITH {GAPPED}, a AS (SELECT *, sequence - coalesce(lag(sequence) OVER w, aggregate_id % 5) AS step FROM gapped WHERE sequence > aggregate_id % 5 WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence)),
b AS (SELECT *, max(CASE WHEN step <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY aggregate_id ORDER BY sequence) AS broken FROM a)
SELECT aggregate_id, sequence, event_type, CASE WHEN max(broken) OVER (PARTITION BY aggregate_id) = 1 THEN 'expired' ELSE 'ok' END AS status FROM b QUALIFY broken = 0""")
def replay(spark, sf):
    rows = fx.log(spark, sf).where("event_id % 97 <> 0")
    return ev.replay(rows, fx.log(spark, sf).select("aggregate_id", (F.col("aggregate_id") % 5).alias("after")).distinct())


@query("r4_dedupe_events", "SELECT event_id, user_id, event_type FROM events")
def dedupe_events(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ev.dedupe_events(rows.unionByName(rows.where("event_id % 50 = 0")))


@query("r9_stage_metrics", """
SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stage_metrics(spark, sf):
    return ev.stage_metrics(fx.table(spark, sf, "events"))


@query("r9_stage_latency", """
SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS runs, round(avg(millis), 3) AS mean_millis, max(millis) AS most_millis FROM (
  SELECT ts, greatest((epoch_us(nt) - epoch_us(ts)) // 1000, 0) AS millis FROM (SELECT *, lead(event_type) OVER w AS nk, lead(ts) OVER w AS nt FROM log WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence)) WHERE event_type = 'view' AND nk = 'purchase') GROUP BY 1""")
def stage_latency(spark, sf):
    return ev.stage_latency(ev.stage_duration(fx.log(spark, sf), "view", "purchase"))


@query("r10_catalogue_changes", """
SELECT event_id, aggregate_id, event_type, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence) AS epoch FROM log WHERE event_type IN ('purchase', 'signup')""")
def catalogue_changes(spark, sf):
    return ev.catalogue_changes(fx.log(spark, sf), ("purchase", "signup")).select("event_id", "aggregate_id", "event_type", "epoch")


KIND = {"signup": "created", "view": "started", "click": "progress", "purchase": "completed", "error": "failed"}


def kinds(rows):
    kind = F.lit("progress")
    for k, v in KIND.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return rows.withColumn("kind", kind)


#: States of aggregates by recursion over their events.
STATES = """
WITH RECURSIVE e AS (SELECT {agg} AS aggregate_id, row_number() OVER (PARTITION BY {agg} ORDER BY sequence) AS k, sequence, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS kind FROM log),
m AS (SELECT * FROM (VALUES ('created', 'new', 'created'), ('started', 'created', 'running'), ('started', 'running', 'running'), ('progress', 'running', 'running'), ('completed', 'running', 'completed'), ('failed', 'created', 'failed'), ('failed', 'running', 'failed')) AS t(kind, before, after)),
r AS (SELECT aggregate_id, CAST(0 AS BIGINT) AS k, 'new' AS status, CAST(0 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS rejected FROM e WHERE k = 1
  UNION ALL SELECT e.aggregate_id, e.k, coalesce(m.after, r.status), e.sequence, r.applied + CASE WHEN m.after IS NULL THEN 0 ELSE 1 END, r.rejected + CASE WHEN m.after IS NULL THEN 1 ELSE 0 END FROM r JOIN e ON e.aggregate_id = r.aggregate_id AND e.k = r.k + 1 LEFT JOIN m ON m.kind = e.kind AND m.before = r.status)
SELECT aggregate_id, max_by(status, k) AS status, max(sequence) AS sequence, max(applied) AS applied, max(rejected) AS rejected FROM r GROUP BY 1"""


@query("r1_job_state", STATES.format(agg="aggregate_id"))
def job_state(spark, sf):
    return ev.job_state(kinds(fx.log(spark, sf)))


@query("l3_apply_retirements", """
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'revoked' WHEN doc_id % 6 = 0 THEN 'archived' WHEN doc_id % 5 = 0 THEN 'deactivated' ELSE 'kept' END AS outcome, NOT (doc_id % 11 = 0 OR doc_id % 6 = 0 OR doc_id % 5 = 0) AS searchable,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 11 <> 0 AND doc_id % 6 <> 0 THEN NULL ELSE publication_id END AS publication_id FROM (SELECT d.doc_id, max(p.publication_id) AS publication_id FROM catalog d LEFT JOIN publications p USING (doc_id) GROUP BY 1)""")
def apply_retirements(spark, sf):
    d = fx.documents(spark, sf)
    pointer = fx.publications(spark, sf).groupBy("doc_id").agg(F.max("publication_id").alias("publication_id"))
    commands = d.where("doc_id % 5 = 0").select("doc_id", F.lit("deactivate").alias("command")).unionByName(d.where("doc_id % 66 = 0").select("doc_id", F.lit("archive").alias("command")))
    return ct.apply_retirements(d, pointer, commands)


@query("s8_event_log_source", "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids, max(event_id) AS last FROM events GROUP BY 1")
def event_log_source(spark, sf):
    kind = fx.table(spark, sf, "events").schema
    stream = ev.event_log_source(spark, f"{sf}/event[s].parquet", kind, 4)  # a pattern, as a stream reads no single file by its name
    return ev.landed(stream.select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.max("event_id").alias("last"))
