"""Publication requests of documents with all their effects, in batch and as a stream that remembers operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.streaming.ordered import InOrder, in_order, names

NONE = -1
ROW = "operation_id long, version_id long, generation_id long, expected long, ready boolean, active boolean, archived boolean, revoked boolean"
EFFECTS = "operation_id long, outcome string, publication_id long, retired long, superseded long, searchable boolean, revision long"


def _clean(requests: DataFrame) -> DataFrame:
    long = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE).cast("long"))
    rest = {"ready": True, "active": True, "archived": False, "revoked": False}
    return requests.withColumns({c: long(c) for c in ("operation_id", "version_id", "generation_id", "expected")} | {c: F.coalesce(F.col(c), F.lit(v)) for c, v in rest.items()})


class Publications(InOrder):
    """Effects of each request. The state is the publication, its version, the revision, the time of the oldest applied
    operation that is kept, and these by their ids, until the watermark is `remember` seconds past them."""

    ROW, OUT = ROW, f"doc_id long, sequence long, {EFFECTS}"

    def __init__(self, remember: int):
        self.micros = remember * 1_000_000

    def zero(self):
        return NONE, NONE, 0, None, {}

    def take(self, state, row):
        (publication, version, revision, oldest, done), (sequence, at, operation, new, generation, expected, ready, active, archived, revoked) = state, row
        give = lambda outcome, of=NONE, retired=NONE, superseded=NONE, seen=False, number=revision: [(sequence, operation, outcome, of, retired, superseded, seen, number)]
        known = done.get(str(operation))
        if known is not None and at - known[0] <= self.micros:
            return state, give("replay", operation) if known[1:] == [new, generation, expected] else give("IDEMPOTENCY_CONFLICT")
        if expected != publication:
            return state, give("VERSION_CONFLICT")
        if revoked:
            return state, give("SOURCE_REVOKED")
        if not ready:
            return state, give("GENERATION_NOT_READY")
        done[str(operation)] = [at, new, generation, expected]
        oldest = at if oldest is None else min(at, oldest)
        return (operation, new, revision + 1, oldest, done), give("applied", operation, publication, version if version != new else NONE, active and not archived, revision + 1)

    def alarm(self, state):
        return (state[3] + self.micros) // 1000 + 1 if state[3] is not None else None

    def rung(self, state, now):
        kept = {operation: x for operation, x in state[4].items() if (x[0] + self.micros) // 1000 >= now}
        return (*state[:3], min((x[0] for x in kept.values()), default=None), kept), []


def _step(micros: int):
    def step(s: Column, x: Column) -> Column:
        none = F.lit(NONE).cast("long")
        known = F.try_element_at(F.filter(s["done"], lambda d: (d["operation_id"] == x["operation_id"]) & (x["at"] - d["at"] <= micros)), F.lit(-1))
        again = (known["version_id"] == x["version_id"]) & (known["generation_id"] == x["generation_id"]) & (known["expected"] == x["expected"])
        outcome = (
            F.when(known.isNotNull(), F.when(again, "replay").otherwise("IDEMPOTENCY_CONFLICT")).when(x["expected"] != s["publication"], "VERSION_CONFLICT")
            .when(x["revoked"], "SOURCE_REVOKED").when(~x["ready"], "GENERATION_NOT_READY").otherwise("applied")
        )
        yes = outcome == "applied"
        revision = s["revision"] + yes.cast("long")
        effect = F.struct(
            x["sequence"].alias("sequence"), x["operation_id"].alias("operation_id"), outcome.alias("outcome"), F.when(yes | (outcome == "replay"), x["operation_id"]).otherwise(none).alias("publication_id"),
            F.when(yes, s["publication"]).otherwise(none).alias("retired"), F.when(yes & (s["version"] != x["version_id"]), s["version"]).otherwise(none).alias("superseded"),
            (yes & x["active"] & ~x["archived"]).alias("searchable"), revision.alias("revision"),
        )
        mark = F.struct(*[x[c].alias(c) for c in ("operation_id", "at", "version_id", "generation_id", "expected")])
        return F.struct(
            F.when(yes, x["operation_id"]).otherwise(s["publication"]).alias("publication"), F.when(yes, x["version_id"]).otherwise(s["version"]).alias("version"), revision.alias("revision"),
            F.when(yes, F.array_append(s["done"], mark)).otherwise(s["done"]).alias("done"), F.array_append(s["out"], effect).alias("out"),
        )

    return step


def publication_effects(requests: DataFrame, remember: int = 30 * 86400, watermark: str = "10 minutes") -> DataFrame:
    """What requests (doc_id, sequence, ts and those of ROW) to publish a version of a document do, in order: operation_id,
    outcome, publication_id (that of the operation, also for replays), the publication retired, the version superseded,
    whether the version may be searched now, and the document's revision, which counts the applied ones.

    The current publication must be the expected one; -1 and null stand for none. An operation that was applied up to
    `remember` seconds before is a replay, or a conflict if it asks for another thing. In a stream rows are given as soon
    as all before them have come; in batch a document's requests, which are few, are folded as one array.
    """
    rows = _clean(requests)
    if rows.isStreaming:
        return in_order(rows, "doc_id", Publications(remember), watermark).select("doc_id", "sequence", *names(EFFECTS))
    rows = rows.withColumns({"sequence": F.col("sequence").cast("long"), "at": F.unix_micros(F.col("ts").cast("timestamp"))})
    items = F.array_sort(F.collect_set(F.struct("sequence", "at", *names(ROW))))
    held = "array<struct<operation_id:bigint,at:bigint,version_id:bigint,generation_id:bigint,expected:bigint>>"
    given = f"array<struct<sequence:bigint,{EFFECTS.replace(', ', ',').replace(' long', ':bigint').replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    longs = [F.lit(v).cast("long").alias(c) for c, v in (("publication", NONE), ("version", NONE), ("revision", 0))]
    zero = F.struct(*longs, F.array().cast(held).alias("done"), F.array().cast(given).alias("out"))
    folded = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(items.alias("xs")).select("doc_id", F.aggregate("xs", zero, _step(remember * 1_000_000), lambda s: s["out"]).alias("out"))
    return folded.select("doc_id", F.inline("out"))
