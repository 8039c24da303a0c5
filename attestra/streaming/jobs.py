"""Jobs under leases: the state of each after its log of commands, in batch and as a stream whose timeouts end leases.

A log row is (aggregate_id, sequence, ts, kind, epoch, stage, processed, total, seconds, retryable). An `acquired` row
opens a lease of `seconds` with the next epoch; writes must name that epoch and come before the lease ends. `failed`
rows wait `seconds` for a retry. Rows that change nothing count neither as applied nor as rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.streaming.ordered import InOrder, in_order

ENDED = ("completed", "failed", "cancelled")
MAX_ATTEMPTS = 3
NONE = -1  # of numbers

STATE = "status string, stage string, attempt long, epoch long, processed long, total long, working boolean, lease_until long, available_at long, applied long, rejected long, error string"
ZERO = ("queued", "", 0, 0, 0, NONE, False, NONE, NONE, 0, 0, "")
ROW = "kind string, epoch long, stage string, processed long, total long, seconds long, retryable boolean"
GIVEN = ("status", "stage", "attempt", "epoch", "processed", "total", "lease_until", "applied", "rejected", "error")


def _clean(log: DataFrame) -> DataFrame:
    whole = lambda c, rest: F.coalesce(F.col(c).cast("long"), F.lit(rest).cast("long"))
    return log.withColumns({
        "epoch": whole("epoch", NONE), "stage": F.coalesce("stage", F.lit("")), "processed": whole("processed", 0), "total": whole("total", NONE),
        "seconds": whole("seconds", 0), "retryable": F.coalesce("retryable", F.lit(False)),
    })


class Jobs(InOrder):
    """One row for each job that a batch touches, and one when its lease has ended."""

    ROW, ZERO = ROW, ZERO
    OUT = "aggregate_id long, status string, stage string, attempt long, epoch long, processed long, total long, lease_until long, applied long, rejected long, error string, expired boolean"

    def take(self, state, row):
        s = dict(zip((c.split()[0] for c in STATE.split(", ")), state, strict=True))
        _, at, kind, epoch, stage, processed, total, seconds, retryable = row
        said, new, micros = "", {}, seconds * 1_000_000
        if kind in ("acquired", "cancelled") and s["status"] in ENDED:
            said = "already_terminal" if kind == "acquired" else ""
        elif kind == "cancelled":
            new = {"status": "cancelled", "lease_until": NONE}
        elif kind == "acquired":
            if s["lease_until"] > at:
                said = "already_running"
            elif s["available_at"] > at:
                said = "not_available"
            elif s["attempt"] >= MAX_ATTEMPTS:
                new = {"status": "failed", "error": "DEPENDENCY_UNAVAILABLE"}
            else:
                new = {"status": "running", "epoch": s["epoch"] + 1, "attempt": s["attempt"] + 1, "lease_until": at + micros, "stage": "queued", "working": True, "processed": 0, "total": NONE, "error": ""}
        elif epoch != s["epoch"]:
            said = "STALE_INGESTION"
        elif s["status"] != "running":
            said = "CANCEL_REQUESTED" if s["status"] == "cancelled" else "INGESTION_NOT_RUNNING"
        elif s["lease_until"] <= at:
            said = "LEASE_EXPIRED"
        elif kind == "heartbeat":
            new = {"lease_until": at + micros}
        elif kind == "started":
            new = {} if s["stage"] == stage and s["working"] else {"stage": stage, "working": True, "processed": processed, "total": total}
        elif kind in ("progress", "finished"):
            if s["stage"] != stage:
                said = "STAGE_NOT_STARTED"
            elif not s["working"]:
                said = "STAGE_ALREADY_COMPLETED" if kind == "progress" else ""
            elif processed < s["processed"]:
                said = "PROGRESS_REGRESSION"
            elif kind == "finished" or (processed, total) != (s["processed"], s["total"]):
                new = {"processed": processed, "total": total, "working": kind == "progress"}
        elif kind == "failed":
            again = retryable and s["attempt"] < MAX_ATTEMPTS
            new = {"status": "retry_wait" if again else "failed", "available_at": at + micros, "lease_until": NONE}
        elif kind == "completed":
            new = {"status": "completed"}
        else:
            said = "INVALID_STAGE_EVENT"
        s |= new | ({"error": said} if said else {})
        s["applied"] += bool(new)
        s["rejected"] += bool(said)
        return tuple(s.values()), []

    def _row(self, state, expired):
        s = dict(zip((c.split()[0] for c in STATE.split(", ")), state, strict=True))
        return (*(s[c] for c in GIVEN), expired)

    def touched(self, state):
        return [self._row(state, False)]

    def alarm(self, state):
        return state[7] // 1000 + 1 if state[0] == "running" else None

    def rung(self, state, now):
        return state, [self._row(state, True)]


def _step(s: Column, x: Column) -> Column:
    """The rules of `Jobs.take` as one column expression."""
    kind, at, micros = x["kind"], x["at"], x["seconds"] * 1_000_000
    fresh, cancel = kind == "acquired", kind == "cancelled"
    ended, stage, work = s["status"].isin(*ENDED), kind.isin("progress", "finished"), s["working"]
    said = (
        F.when(fresh, F.when(ended, "already_terminal").when(s["lease_until"] > at, "already_running").when(s["available_at"] > at, "not_available"))
        .when(cancel, None).when(x["epoch"] != s["epoch"], "STALE_INGESTION")
        .when(s["status"] != "running", F.when(s["status"] == "cancelled", "CANCEL_REQUESTED").otherwise("INGESTION_NOT_RUNNING"))
        .when(s["lease_until"] <= at, "LEASE_EXPIRED")
        .when(stage, F.when(s["stage"] != x["stage"], "STAGE_NOT_STARTED").when(~work, F.when(kind == "progress", "STAGE_ALREADY_COMPLETED")).when(x["processed"] < s["processed"], "PROGRESS_REGRESSION"))
        .when(~F.coalesce(kind, F.lit("")).isin("heartbeat", "started", "failed", "completed"), "INVALID_STAGE_EVENT")
    )
    same = (s["processed"] == x["processed"]) & (s["total"] == x["total"])
    idle = (cancel & ended) | ((kind == "started") & (s["stage"] == x["stage"]) & work) | (stage & ~work) | ((kind == "progress") & same)
    does = F.struct(said.alias("said"), (said.isNull() & ~F.coalesce(idle, F.lit(False))).alias("does"))

    def after(d):
        yes = d["does"]
        on = lambda k: yes & F.coalesce(k, F.lit(False))
        spent = on(fresh & (s["attempt"] >= MAX_ATTEMPTS))
        begun, retry = on(fresh) & ~spent, on((kind == "failed") & x["retryable"] & (s["attempt"] < MAX_ATTEMPTS))
        none, zero = F.lit(NONE).cast("long"), F.lit(0).cast("long")
        started, moved = on(kind == "started"), on(stage)
        return F.struct(
            F.when(begun, "running").when(retry, "retry_wait").when(spent | on(kind == "failed"), "failed").when(on(cancel), "cancelled").when(on(kind == "completed"), "completed").otherwise(s["status"]).alias("status"),
            F.when(begun, "queued").when(started, x["stage"]).otherwise(s["stage"]).alias("stage"),
            (s["attempt"] + begun.cast("long")).alias("attempt"), (s["epoch"] + begun.cast("long")).alias("epoch"),
            F.when(begun, zero).when(started | moved, x["processed"]).otherwise(s["processed"]).alias("processed"), F.when(begun, none).when(started | moved, x["total"]).otherwise(s["total"]).alias("total"),
            F.when(begun | started, True).when(moved, kind == "progress").otherwise(s["working"]).alias("working"),
            F.when(begun | on(kind == "heartbeat"), at + micros).when(on(cancel | (kind == "failed")), none).otherwise(s["lease_until"]).alias("lease_until"),
            F.when(on(kind == "failed"), at + micros).otherwise(s["available_at"]).alias("available_at"),
            (s["applied"] + yes.cast("long")).alias("applied"), (s["rejected"] + d["said"].isNotNull().cast("long")).alias("rejected"),
            F.when(d["said"].isNotNull(), d["said"]).when(spent, "DEPENDENCY_UNAVAILABLE").when(begun, "").otherwise(s["error"]).alias("error"),
        )

    return F.element_at(F.transform(F.array(does), after), 1)


def job_log(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """States (aggregate_id, status, stage, attempt, epoch, processed, total, lease_until, applied, rejected, error,
    expired) of jobs after their log; error: why the last refused row was refused, or the job ended.

    Rows count in the order of their sequence, each once. In batch there is a row for each job, and a lease has expired
    if it ended before the latest ts of the log less the watermark. A stream gives a row for each job whenever a batch
    changes it, and one with `expired` when the watermark passes its lease: `latest` picks the last of each.
    """
    log = _clean(log)
    if log.isStreaming:
        return in_order(log, "aggregate_id", Jobs(), watermark)
    rows = log.withColumns({"sequence": F.col("sequence").cast("long"), "at": F.unix_micros(F.col("ts").cast("timestamp"))})
    items = F.array_sort(F.collect_set(F.struct("sequence", "at", *[c.split()[0] for c in ROW.split(", ")])))
    zero = F.struct(*[F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(ZERO, STATE.split(", "), strict=True)])
    states = rows.groupBy(F.col("aggregate_id").cast("long").alias("aggregate_id")).agg(items.alias("xs")).select("aggregate_id", F.aggregate("xs", zero, _step).alias("s"))
    now = log.agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL {watermark}")).alias("now"))  # one row
    late = (F.col("s.status") == "running") & (F.floor(F.col("s.lease_until") / 1000) < F.floor(F.col("now") / 1000))
    return states.crossJoin(F.broadcast(now)).select("aggregate_id", *[f"s.{c}" for c in GIVEN], late.alias("expired"))


def latest(states: DataFrame) -> DataFrame:
    """The last of the rows that a stream of `job_log` gave of each job: the one after most of its log, then the expired."""
    rest = [c for c in states.columns if c != "aggregate_id"]
    newest = F.max_by(F.struct(*rest), F.struct((F.col("applied") + F.col("rejected")).alias("rows"), "expired"))
    return states.groupBy("aggregate_id").agg(newest.alias("s")).select("aggregate_id", "s.*")
