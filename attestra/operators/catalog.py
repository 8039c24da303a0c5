"""Catalogue and lifecycle: what is eligible, current, listed, pinned, kept and purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.hashing import uuid5


def latest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first by `order`; tasks keep one row a key before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


distinct_on = latest_per


def publication_history(pubs: DataFrame) -> DataFrame:
    """Adds retired_at, the time of the document's next publication; the one without is current."""
    w = Window.partitionBy("doc_id").orderBy("published_at", "publication_id")
    return pubs.withColumn("retired_at", F.lead("published_at").over(w))


def eligible(docs: DataFrame, pubs: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents that a search may use: current publication of an active, published version with both generations
    ready, neither archived nor revoked."""
    current = publication_history(pubs).where("retired_at is null").select("doc_id", "version_id", "publication_id")
    fine = versions.where("legal_status = 'active' and publication_status = 'published' and parse_status = 'ready' and index_status = 'ready'").select("version_id")
    return docs.where("not archived and not revoked").select("doc_id", "title").join(current, "doc_id").join(fine, "version_id", "left_semi").select("doc_id", "title", "publication_id", "version_id")


def library_profile(docs: DataFrame, versions: DataFrame, pubs: DataFrame) -> DataFrame:
    """One row: numbers of documents, versions and eligible documents, and the last publication time."""
    one = docs.agg(F.count("*").alias("documents")).crossJoin(versions.agg(F.count("*").alias("versions")))
    return one.crossJoin(eligible(docs, pubs, versions).agg(F.count("*").alias("eligible"))).crossJoin(pubs.agg(F.max("published_at").alias("last_published")))


def selection_hash(items: DataFrame) -> DataFrame:
    """sha256 of the pinned `doc:publication:version` strings in document order, by group of documents (column part).

    Each part is one row of the result; its text is built in one task, so parts bound the size.
    """
    item = F.concat_ws(":", "doc_id", "publication_id", "version_id")
    listed = items.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("xs"))
    return listed.select("part", F.size("xs").cast("long").alias("items"), F.sha2(F.array_join(F.transform("xs", lambda x: x["item"]), ","), 256).alias("hash"))


def title_search(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.contains(F.lower("title"), F.lit(text.lower())))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The page after a cursor in descending order, with one more row that tells whether another page follows."""
    if after is not None:
        kind = {f.name: f.dataType for f in df.schema.fields}
        df = df.where(F.struct(*order) < F.struct(*[F.lit(a).cast(kind[c]).alias(c) for c, a in zip(order, after, strict=True)]))
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit + 1)


def generation_timeline(parses: DataFrame, indexes: DataFrame) -> DataFrame:
    """Parse and index generations of documents in one list."""
    return parses.withColumn("kind", F.lit("parse")).unionByName(indexes.withColumn("kind", F.lit("index")), allowMissingColumns=True)


def document_list(docs: DataFrame, pubs: DataFrame, versions: DataFrame) -> DataFrame:
    """Each document with its listing state, number of versions and latest version."""
    of = versions.groupBy("doc_id").agg(F.count("*").alias("versions"), F.max_by("version_id", F.struct("created_at", "version_id")).alias("latest"), F.bool_or(F.col("parse_status") == "failed").alias("failed"))
    live = pubs.select("doc_id").distinct().withColumn("published", F.lit(True))
    rows = docs.join(of, "doc_id", "left").join(live, "doc_id", "left")
    state = F.when(F.col("archived"), "archived").when(F.col("published"), "active").when(F.coalesce("failed", F.lit(False)), "failed").otherwise("staging")
    return rows.select("doc_id", "title", state.alias("state"), F.coalesce("versions", F.lit(0)).alias("versions"), "latest")


def purge_report(docs: DataFrame, activity: list[DataFrame], active: DataFrame, retention_days: int, now: Column) -> DataFrame:
    """Per document: latest activity, the time from which it may be purged, and what blocks it.

    activity: frames of doc_id and at. active: doc_id of work in progress.
    """
    union = activity[0]
    for a in activity[1:]:
        union = union.unionByName(a)
    latest = union.groupBy("doc_id").agg(F.max("at").alias("latest"))
    busy = active.groupBy("doc_id").agg(F.count("*").alias("active"))
    rows = docs.join(latest, "doc_id", "left").join(busy, "doc_id", "left").withColumn("active", F.coalesce("active", F.lit(0)))
    rows = rows.withColumn("eligible_after", F.col("latest") + F.make_dt_interval(F.lit(retention_days)))
    blockers = F.array_compact(F.array(
        F.when(~F.col("archived") & ~F.col("revoked"), "DOCUMENT_NOT_ARCHIVED"), F.when(F.col("active") > 0, "PROTECTED_REFERENCES"), F.when(F.col("eligible_after") > now, "RETENTION_ACTIVE"),
    ))
    return rows.select("doc_id", "latest", "eligible_after", "active", blockers.alias("blockers"), (F.size(blockers) == 0).alias("allowed"))


def purge_status(objects: DataFrame) -> DataFrame:
    return objects.groupBy("plan_id").agg(F.count("*").alias("objects"), F.count_if(F.col("state") == "deleted").alias("deleted"))


def purge_manifest(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Objects of several sources, one row for each, of the source that is named first."""
    rows = None
    for priority, (kind, df) in enumerate(sources):
        part = df.select("object_id", "doc_id").withColumns({"kind": F.lit(kind), "priority": F.lit(priority)})
        rows = part if rows is None else rows.unionByName(part)
    return latest_per(rows, "object_id", F.col("priority"), F.col("doc_id")).drop("priority")


def unreferenced_objects(objects: DataFrame, references: list[DataFrame]) -> DataFrame:
    for r in references:
        objects = objects.join(r.select("object_id"), "object_id", "left_anti")
    return objects


def finalise_purge(plans: DataFrame, objects: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Documents whose objects are all deleted, with the rows of each table that go with them."""
    open_ = objects.where("state <> 'deleted'").select("plan_id").distinct()
    done = plans.join(open_, "plan_id", "left_anti").select("plan_id", "doc_id")
    for name, df in tables.items():
        count = df.groupBy("doc_id").agg(F.count("*").alias(name))
        done = done.join(count, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return done


def generation_complete(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Per generation: counts against expectation, and chunk numbers 0, 1, … of every node."""
    node = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("ordinal").alias("different"))
    fine = (F.col("chunks") == F.col("expected")) & (F.col("lo") == 0) & (F.col("hi") == F.col("chunks") - 1) & (F.col("different") == F.col("chunks"))
    return expected.join(node, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "expected", F.coalesce(fine, F.col("expected") == 0).alias("complete"))


def quality_report(diagnostics: DataFrame, most: int = 100) -> DataFrame:
    """Per document: critical and warning counts, status, and its distinct codes, sorted."""
    critical = F.count_if(F.col("severity") == "critical")
    rows = diagnostics.groupBy("doc_id").agg(critical.alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.slice(F.array_sort(F.collect_set("code")), 1, most).alias("codes"))
    return rows.withColumn("status", F.when(F.col("critical") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed"))


def admission_usage(intents: DataFrame, jobs: DataFrame, capacity: int) -> DataFrame:
    """Slots in use by live reservations and live jobs, and whether one more fits."""
    live = intents.where("state in ('reserved', 'stored')").agg(F.count("*").alias("reserved"))
    busy = jobs.where("status in ('queued', 'running', 'retry_wait')").agg(F.count("*").alias("running"))
    return live.crossJoin(busy).withColumns({"used": F.col("reserved") + F.col("running"), "fits": F.col("reserved") + F.col("running") < capacity})


def debug_summary(parts: DataFrame) -> DataFrame:
    """Per run: one state from its parts (kind request or response, state); every request needs its response."""
    pair = parts.groupBy("run_id", "call_id").agg((F.count_distinct("kind") == 2).alias("paired"))
    whole = pair.groupBy("run_id").agg(F.bool_and("paired").alias("paired"))
    count = parts.groupBy("run_id").agg(F.count("*").alias("parts"), F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "expired").alias("expired"), F.count_if(F.col("state") == "stored").alias("stored"))
    c = F.col
    state = F.when(c("expired") == c("parts"), "expired").when(c("stored") == 0, F.when(c("pending") > 0, "pending").otherwise("unavailable")).when((c("stored") == c("parts")) & c("paired"), "available").otherwise("partial")
    return count.join(whole, "run_id").select("run_id", "parts", "stored", "pending", "paired", state.alias("state"))


def expire_private(runs: DataFrame, now: Column) -> DataFrame:
    """Terminal runs past their expiry lose the private text; its hash and length stay."""
    gone = F.col("terminal") & (F.col("expires_at") <= now)
    return runs.withColumns({"expired": gone, "text_hash": F.sha2("text", 256), "text_length": F.length("text").cast("long"), "text": F.when(~gone, F.col("text"))})


def run_summary(runs: DataFrame, excerpt: int = 40) -> DataFrame:
    return runs.select("run_id", F.left("question", F.lit(excerpt)).alias("excerpt"), "status", (F.unix_timestamp("finished_at") - F.unix_timestamp("created_at")).alias("seconds"))


def lease_expiry(runs: DataFrame, revoked: DataFrame, now: Column) -> DataFrame:
    """What becomes of unfinished runs whose lease or deadline has passed, by the first rule that fits."""
    late = runs.where(F.col("status").isin("created", "running", "cancelling") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now) | (~F.col("cancelled") & (F.col("deadline_at") <= now))))
    bad = revoked.select("run_id").distinct().withColumn("_revoked", F.lit(True))
    c = F.col
    outcome = F.when(c("cancelled"), "cancelled").when(c("deadline_at") <= now, "deadline_exceeded").when(c("_revoked"), "source_revoked").when((c("epoch") > 0) & (c("recoveries") >= c("max_recoveries")), "internal_error").otherwise("resume")
    return late.join(bad, "run_id", "left").select("run_id", outcome.alias("outcome"))


#: Errors that another attempt cannot mend.
FINAL_ERRORS = ("PDF_INVALID", "EXTRACTION_QUALITY_FAILED", "GENERATION_INVALID", "TOKEN_LIMIT_EXCEEDED", "VERSION_CONFLICT", "SOURCE_REVOKED", "SIZE_LIMIT_EXCEEDED")


def retry_schedule(failures: DataFrame, base: int = 2, cap: int = 300) -> DataFrame:
    """Retry or fail by error and attempt, and the delay: doubling from `base` seconds up to `cap`."""
    again = F.col("retryable") & (F.col("attempt") < F.col("max_attempts")) & ~F.col("error_code").isin(*FINAL_ERRORS)
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("attempt") - 1, F.lit(30)))).cast("long")
    return failures.withColumns({"status": F.when(again, "retry_wait").otherwise("failed"), "delay_seconds": F.when(again, delay)})


def redispatch(jobs: DataFrame, outbox: DataFrame, now: Column, quiet_seconds: int = 60) -> DataFrame:
    """Live jobs that are due, not leased, not dispatched lately, and without an unpublished command."""
    quiet = F.col("last_dispatch_at").isNull() | (F.col("last_dispatch_at") <= now - F.make_dt_interval(secs=F.lit(quiet_seconds)))
    due = jobs.where(F.col("status").isin("queued", "running", "retry_wait") & ~F.col("cancelled") & (F.col("available_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)) & quiet)
    return due.join(outbox.where("published_at is null").select("job_id"), "job_id", "left_anti")


def outbox_ready(outbox: DataFrame, now: Column, most: int = 8) -> DataFrame:
    return outbox.where(F.col("published_at").isNull() & (F.col("available_at") <= now) & (F.col("claim_until").isNull() | (F.col("claim_until") <= now)) & (F.col("attempts") < most) & F.col("error").isNull())


def attention_required(outbox: DataFrame, most: int = 8) -> DataFrame:
    return outbox.groupBy("topic").agg(F.bool_or(F.col("published_at").isNull() & (F.col("error").isNotNull() | (F.col("attempts") >= most))).alias("attention"))


def idempotent_commands(requests: DataFrame) -> DataFrame:
    """Requests of a principal and key: the first is accepted, the same again is a replay, another one a conflict."""
    w = Window.partitionBy("principal", "key").orderBy("at", "request_id")
    first = F.first("hash").over(w)
    outcome = F.when(F.row_number().over(w) == 1, "accepted").when(F.col("hash") == first, "replay").otherwise("conflict")
    return requests.withColumn("outcome", outcome)


def outbox_route(outbox: DataFrame) -> DataFrame:
    """Adds stream, fields and error to outbox rows (event_id, aggregate_id, topic, event_type, payload JSON).

    A topic must be known, the payload must have exactly the topic's keys, and its ids must equal the row's.
    """
    key = lambda k: F.get_json_object("payload", f"$.{k}")
    closed = lambda *ks: F.array_sort(F.json_object_keys("payload")) == F.array(*[F.lit(k) for k in sorted(ks)])
    ident = (key("event_id") == F.col("event_id").cast("string")) & (key("schema_version") == "1")
    owner = lambda k: key(k) == F.col("aggregate_id").cast("string")
    topic = F.col("topic")
    fine = (
        F.when(topic == "ingestion.jobs.v1", closed("schema_version", "event_id", "job_id") & ident & owner("job_id") & (F.col("event_type") == "ingestion.dispatch"))
        .when(topic == "ingestion.events.v1", closed("schema_version", "event_id", "job_id", "sequence") & ident & owner("job_id") & (key("sequence").cast("long") >= 1))
        .when(topic == "run.events", closed("schema_version", "event_id", "run_id", "sequence") & ident & owner("run_id") & (key("sequence").cast("long") >= 1))
        .when(topic == "knowledge.events", closed("document_id") & owner("document_id") & F.col("event_type").isin("document.archived", "document.security_revoked"))
    )
    known = topic.isin("ingestion.jobs.v1", "ingestion.events.v1", "run.events", "knowledge.events")
    error = F.when(~known, "OUTBOX_INVALID_TOPIC").when(~F.coalesce(fine, F.lit(False)), "OUTBOX_INVALID_PAYLOAD")
    stream = F.when(topic == "ingestion.jobs.v1", F.lit("jobs")).when(topic == "knowledge.events", F.lit("knowledge")).otherwise(F.concat_ws(":", topic, F.col("aggregate_id")))
    return outbox.withColumn("error", error).withColumn("stream", F.when(F.col("error").isNull(), stream))


def apply_publications(requests: DataFrame) -> DataFrame:
    """Outcome of publish requests (doc_id, version_id, operation_id, order, expected) against each document's pointer,
    and the version that is current after all of them.

    A request is applied if the current version is the expected one, else it is a conflict; an operation that was
    applied before is a replay. Each request depends on those before it, so a document's requests, which are few, are
    folded in order as one array.
    """
    items = F.array_sort(F.collect_list(F.struct("order", "operation_id", "version_id", "expected")))
    zero = F.struct(F.lit(None).cast("long").alias("current"), F.array().cast("array<bigint>").alias("done"), F.array().cast("array<struct<operation_id:bigint,outcome:string>>").alias("out"))

    def step(s, x):
        again = F.array_contains(s["done"], x["operation_id"])
        applied = ~again & x["expected"].eqNullSafe(s["current"])
        outcome = F.when(again, "replay").when(applied, "applied").otherwise("conflict")
        return F.struct(
            F.when(applied, x["version_id"]).otherwise(s["current"]).alias("current"), F.when(applied, F.array_append(s["done"], x["operation_id"])).otherwise(s["done"]).alias("done"),
            F.array_append(s["out"], F.struct(x["operation_id"].alias("operation_id"), outcome.alias("outcome"))).alias("out"),
        )

    longs = [F.col(c).cast("long").alias(c) for c in ("doc_id", "order", "operation_id", "version_id", "expected")]
    folded = requests.select(*longs).groupBy("doc_id").agg(items.alias("xs")).select("doc_id", F.aggregate("xs", zero, step).alias("s"))
    return folded.select("doc_id", F.inline("s.out"), "s.current").select("doc_id", "operation_id", "outcome", "current")


def apply_retirements(documents: DataFrame, pointers: DataFrame, commands: DataFrame) -> DataFrame:
    """State of each document (doc_id, archived, revoked) after retirement commands (doc_id, command: revoke, archive or
    deactivate): its outcome, whether it may be searched, and the publication that stays current.

    A revocation outranks archiving, and both outrank deactivation, which alone clears the pointer (doc_id,
    publication_id). Commands for unknown documents change nothing; repeated ones count once.
    """
    said = lambda name: F.coalesce(F.bool_or(F.col("command") == name), F.lit(False)).alias(f"said_{name}")
    asked = commands.groupBy("doc_id").agg(said("revoke"), said("archive"), said("deactivate"))
    rows = documents.select("doc_id", "archived", "revoked").join(asked, "doc_id", "left").join(pointers.select("doc_id", "publication_id"), "doc_id", "left")
    either = lambda state, name: F.coalesce(F.col(state), F.lit(False)) | F.coalesce(F.col(f"said_{name}"), F.lit(False))
    outcome = F.when(either("revoked", "revoke"), "revoked").when(either("archived", "archive"), "archived").when(F.coalesce("said_deactivate", F.lit(False)), "deactivated").otherwise("kept")
    rows = rows.withColumn("outcome", outcome)
    return rows.select("doc_id", "outcome", (F.col("outcome") == "kept").alias("searchable"), F.when(F.col("outcome") != "deactivated", F.col("publication_id")).alias("publication_id"))


#: What a user reads of a failed job; other codes read as INTERNAL_ERROR.
MESSAGES = {
    "PDF_INVALID": "The file could not be read.", "EXTRACTION_QUALITY_FAILED": "The text could not be extracted reliably.", "TOKEN_LIMIT_EXCEEDED": "A part of the document is too long.",
    "DEPENDENCY_UNAVAILABLE": "A service is not available.", "SIZE_LIMIT_EXCEEDED": "The document is too large.", "INTERNAL_ERROR": "The document could not be processed.",
}
CHUNK_STAGES = ("chunking", "embedding", "indexing", "ready_to_publish", "publishing")
REVOKED = "SOURCE_REVOKED"
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def job_view(jobs: DataFrame, documents: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Jobs (job_id, version_id, doc_id, status, stage, attempt, processed, total, error, retryable, last_sequence) as their
    owner may see them.

    Gives their state with max_attempts; progress (processed, total and its unit by stage), null before any stage; and of
    an error its code, a public message, whether a retry may help and an id that the same error of the same job always
    has. Jobs of revoked documents (doc_id, revoked) show nothing but that code.
    """
    rows = jobs.join(documents.select("doc_id", "revoked"), "doc_id")
    known, code = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), F.nullif("error", F.lit(""))
    code = F.when(code.isNotNull(), F.when(F.map_contains_key(known, code), code).otherwise("INTERNAL_ERROR"))
    open_ = ~F.coalesce("revoked", F.lit(False))
    given = {c: F.col(c) for c in ("version_id", "status", "stage", "attempt", "processed", "total")} | {
        "max_attempts": F.lit(most_attempts), "unit": F.when(F.col("stage").isNotNull(), F.when(F.col("stage").isin(*CHUNK_STAGES), "chunks").otherwise("pages")),
        "message": F.try_element_at(known, code), "retryable": F.when(code.isNotNull(), F.coalesce("retryable", F.lit(False))),
        "request_id": uuid5(URL_NAMESPACE, F.concat(F.lit("ingestion-job:"), F.col("job_id").cast("string"), F.lit(":"), F.col("last_sequence").cast("string"), F.lit(":"), code)),
    }
    return rows.select("job_id", *[F.when(open_, c).alias(name) for name, c in given.items()], F.when(open_, code).otherwise(REVOKED).alias("error"))


def document_detail(documents: DataFrame, versions: DataFrame, publications: DataFrame, after: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Documents (doc_id, title, revoked) with their current publication and a page of their versions, newest first:
    versions (version_id and created_at) and next, the last of the page if there are more.

    `after` (doc_id, created_at, version_id) has the place from which the page of a document goes on. Revoked documents
    have a fault and nothing else.
    """
    page = versions.select("doc_id", "version_id", "created_at")
    if after is not None:
        since = after.select("doc_id", F.col("created_at").alias("_at"), F.col("version_id").alias("_id"))
        page = page.join(since, "doc_id", "left").where(F.col("_at").isNull() | (F.struct("created_at", "version_id") < F.struct("_at", "_id")))
    newest = Window.partitionBy("doc_id").orderBy(F.col("created_at").desc(), F.col("version_id").desc())
    page = page.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit + 1)
    one = F.struct("version_id", "created_at")
    whole = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("v")))).alias("vs"), F.max("place").alias("most"))
    whole = whole.select("doc_id", F.transform(F.slice("vs", 1, limit), lambda x: x["v"]).alias("versions"), F.when(F.col("most") > limit, F.try_element_at("vs", F.lit(limit))["v"]).alias("next"))
    last = publications.groupBy("doc_id").agg(F.max_by("publication_id", F.struct("published_at", "publication_id")).alias("publication"))
    rows = documents.select("doc_id", "title", "revoked").join(whole, "doc_id", "left").join(last, "doc_id", "left")
    open_ = ~F.coalesce("revoked", F.lit(False))
    none = F.array().cast(whole.schema["versions"].dataType)
    given = {"title": F.col("title"), "publication": F.col("publication"), "versions": F.coalesce("versions", none), "next": F.col("next")}
    return rows.select("doc_id", *[F.when(open_, c).alias(name) for name, c in given.items()], F.when(~open_, REVOKED).alias("fault"))


def version_detail(versions: DataFrame, generations: DataFrame, publications: DataFrame, documents: DataFrame, most: int = 100) -> DataFrame:
    """Versions (version_id, doc_id) with the publication that made them current, if they are, the newest `most` of their
    generations (generation_id, kind, status, created_at) and the page count of the latest parse that is ready.

    generations: version_id, generation_id, kind (parse or index), status, created_at, pages. Versions of revoked
    documents have a fault and nothing else.
    """
    newest = Window.partitionBy("version_id").orderBy(F.col("created_at").desc(), F.col("generation_id").desc())
    rows = generations.withColumn("place", F.row_number().over(newest))
    ready = (F.col("kind") == "parse") & (F.col("status") == "ready")
    listed = F.collect_list(F.when(F.col("place") <= most, F.struct("place", F.struct("generation_id", "kind", "status", "created_at").alias("g"))))
    of = rows.groupBy("version_id").agg(F.transform(F.array_sort(listed), lambda x: x["g"]).alias("generations"), F.min_by("pages", F.when(ready, F.col("place"))).alias("pages"))
    current = publications.groupBy("doc_id").agg(F.max_by(F.struct("publication_id", "version_id"), F.struct("published_at", "publication_id")).alias("p"))
    current = current.select(F.col("p.version_id").alias("version_id"), F.col("p.publication_id").alias("publication"))
    out = versions.select("version_id", "doc_id").join(of, "version_id", "left").join(current, "version_id", "left").join(documents.select("doc_id", "revoked"), "doc_id")
    open_ = ~F.coalesce("revoked", F.lit(False))
    given = {"publication": F.col("publication"), "pages": F.col("pages"), "generations": F.coalesce("generations", F.array().cast(of.schema["generations"].dataType))}
    return out.select("version_id", "doc_id", *[F.when(open_, c).alias(name) for name, c in given.items()], F.when(~open_, REVOKED).alias("fault"))
