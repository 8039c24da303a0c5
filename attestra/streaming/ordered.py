"""Stateful streams that take each key's rows in the order of their sequence, with event-time timeouts.

A row waits until the one before it has come. Rows that came before, or that are repeated, are dropped; a gap is given
up when the watermark passes a row behind it, as the missing rows would be late by then. So a stream gives what the
batch form gives over the same rows, whatever their order of arrival, restarts and replays, as long as no row is later
than the watermark allows.

Keys are dealt to BUCKETS, and a call takes the rows of a bucket: a call for each key, and one for each of its values in
the state, take longer than the work. The state of a bucket is one text in RocksDB, which a batch that has rows for it
writes anew: what its keys hold, and their waiting rows. It is called again when the first of its alarms is due.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Fixed, as checkpoints are dealt by it: a million keys are some 500 a bucket. A call costs some 10 ms, whatever is in it.
BUCKETS = 1 << 11


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class InOrder:
    """Rows (sequence, at, and those of ROW), at in microseconds; a state of a key, which is `zero` at first and made of
    what JSON has, so keys of a dict are texts."""

    ROW, OUT, ZERO = "", "", ()

    def zero(self) -> tuple:
        return self.ZERO

    def take(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The state after a row, and rows to give."""
        raise NotImplementedError

    def touched(self, state: tuple) -> list[tuple]:
        """Rows to give of a key whose state a batch has changed."""
        return []

    def alarm(self, state: tuple) -> int | None:
        """Milliseconds of event time at which `rung` is called unless the state changes before."""
        return None

    def rung(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        return state, []

    def follow(self, kept: list, now: int) -> list[tuple]:
        """Takes the waiting rows of a key that are due at the watermark `now`, and its alarm, and gives rows. `kept` has
        the sequence of the last row, the state, the waiting rows in any order and the alarm that has rung."""
        last, state, held, rang = kept
        began, out, wait = last, [], []
        held = sorted({row[0]: row for row in held if row[0] > last}.values(), key=lambda row: row[0])
        ripe = max((row[0] for row in held if row[1] // 1000 < now), default=0)
        for k, row in enumerate(held):
            if row[0] > last + 1 and row[0] > ripe:
                wait = held[k:]
                break
            state, more = self.take(state, row)
            last = row[0]
            out += more
        if last > began:
            out += self.touched(state)
        at = self.alarm(state)
        if at is not None and at <= now and (last > began or at != rang):
            rang = at
            state, more = self.rung(state, now)
            out += more
        kept[:] = last, state, wait, rang
        return out

    def due(self, kept: list) -> int | None:
        """Milliseconds at which `follow` has something to do without new rows."""
        _, state, held, rang = kept
        at, wait = self.alarm(state), min((row[1] // 1000 + 1 for row in held), default=None)
        at = None if at == rang else at
        return wait if at is None else at if wait is None else min(at, wait)


def _call(key: tuple, batches: Iterator[pd.DataFrame], held, processor: InOrder) -> Iterator[pd.DataFrame]:
    """A batch's rows of the keys of a bucket, or its timeout."""
    now, out = max(held.getCurrentWatermarkMs(), 0), []
    keys = {k: [last, tuple(state), [tuple(row) for row in wait], rang] for k, last, state, wait, rang in json.loads(held.get[0])} if held.exists else {}
    columns, new = names(f"sequence long, at long, {processor.ROW}"), {}
    for pdf in batches:
        for k, *row in zip(pdf["key"].tolist(), *(pdf[c].tolist() for c in columns), strict=True):
            new.setdefault(k, []).append(tuple(row))
    for k, rows in new.items():
        keys.setdefault(k, [0, processor.zero(), [], None])[2].extend(rows)
    first = None
    for k, kept in keys.items():
        at = processor.due(kept) if k not in new else now
        if at is not None and at <= now:
            number = None if k is None else int(k)
            out += [(number, *row) for row in processor.follow(kept, now)]
            at = processor.due(kept)
        first = at if first is None else first if at is None else min(first, at)
    held.update((json.dumps([[k, *kept] for k, kept in keys.items()], separators=(",", ":")),))
    if first is not None:  # it is called when the watermark is past that time
        held.setTimeoutTimestamp(max(first - 1, now, 1))
    if out:
        yield pd.DataFrame(out, columns=names(processor.OUT))


def in_order(stream: DataFrame, key: str, processor: InOrder, watermark: str) -> DataFrame:
    """Rows that `processor` gives for a stream with `key`, sequence, ts and the columns of its rows."""
    stream.sparkSession.conf.set(*PROVIDER)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    number = F.col(key).cast("long")
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64(number), F.lit(BUCKETS)), "key": number.cast("string"), "sequence": F.col("sequence").cast("long"), "at": F.unix_micros("ts")})
    rows = rows.where("sequence is not null").select("bucket", "key", "sequence", "at", "ts", *names(processor.ROW))
    return rows.groupBy("bucket").applyInPandasWithState(functools.partial(_call, processor=processor), processor.OUT, "keys string", "append", "EventTimeTimeout")


class ChangeFeed(InOrder):
    """Events of the named kinds with an epoch that counts them for each aggregate."""

    ROW, ZERO = "event_id long, event_type string", (0,)
    OUT = "aggregate_id long, event_id long, sequence long, event_type string, epoch long"

    def __init__(self, kinds: tuple[str, ...]):
        self.kinds = kinds

    def take(self, state, row):
        (epoch,), (sequence, _, event_id, kind) = state, row
        return ((epoch + 1,), [(event_id, sequence, kind, epoch + 1)]) if kind in self.kinds else (state, [])


class StagePairs(InOrder):
    """Starts of a stage with the milliseconds to their ends. An open start is forgotten `within` seconds after it, or
    kept until the next mark where that is None."""

    ROW, ZERO = "event_type string", (0, 0)
    OUT = "aggregate_id long, sequence long, began long, millis long"

    def __init__(self, begin: str, end: str, within: int | None):
        self.begin, self.end, self.micros = begin, end, within and within * 1_000_000

    def take(self, state, row):
        (opened, began), (sequence, at, kind) = state, row
        if kind == self.begin:
            return (sequence, at), []
        if kind != self.end or not opened:
            return state, []
        return (0, 0), [(opened, began, max((at - began) // 1000, 0))] * (not self.micros or at - began <= self.micros)

    def alarm(self, state):
        opened, began = state
        return (began + self.micros) // 1000 + 1 if opened and self.micros else None

    def rung(self, state, now):
        return (0, 0), []
