"""Streaming operators with state of their own: echoes, multipart messages, inbox states.

Rows are decided in event time. They wait until the watermark has passed them, so rows that arrive in any
order within the delay give what the batch form gives. A row older than the watermark comes too late to be
decided; it goes to a side output instead of being lost. Every key's state ends by itself: when nothing that
may still arrive can depend on it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passbook.functions.text import strip

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Before any time that a timestamp can hold.
NEVER = -(1 << 63) + 1

ACCEPTED, LATE = "accepted", "late"
COMPLETE, INCOMPLETE = "complete", "incomplete"

#: Microseconds of a block of waiting rows, and how many rows are gathered before they are put into their blocks.
BLOCK, KEEP_ROWS = 3_600_000_000, 200_000


def with_state(spark: SparkSession) -> None:
    """Arbitrary state needs the embedded store; a provider that the session names is kept if it is one."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


def timed(stream: DataFrame, delay: str, ticks: DataFrame | None = None, not_after: Column | None = None) -> DataFrame:
    """The stream with a watermark on ``ts``, and ``t`` in microseconds in its place.

    ``ticks`` is a stream of times alone (``ts``): they move the watermark on where no more rows come, so
    that what still waits is decided. ``not_after`` (the time of the batch, say) bounds how far a row
    moves the watermark, so that one with a wrong time ahead does not make all others late. Rows without a
    time cannot be placed and are left out.
    """
    rows = stream.withColumns({"ts": F.col("ts").cast("timestamp"), "_tick": F.lit(False)})
    rows = rows.withColumn("_mark", F.least("ts", not_after) if not_after is not None else F.col("ts"))
    if ticks is not None:
        when = F.col("ts").cast("timestamp")
        rows = rows.unionByName(ticks.select(when.alias("ts"), when.alias("_mark"), F.lit(True).alias("_tick")), allowMissingColumns=True)
    # rows behind the watermark must reach the operator, so the time goes on as a plain number
    marked = rows.withWatermark("_mark", delay).withColumn("t", F.unix_micros("ts"))
    # a test that names the watermark's column stays behind it, so ticks are seen by it before they go
    kept = marked.where(~F.col("_tick") | (F.unix_micros("_mark") < NEVER)).where("t is not null")
    return kept.drop("_tick", "_mark", "ts")


class Deadline:
    """One event-time timer per key: the next moment at which its state has to be looked at."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def at(self, ms: int | None, fired: bool = False) -> None:
        """Sets the timer, or takes it away for None; ``fired`` if the one before has just run out."""
        old = self.due.get()
        if old is not None and old[0] == ms and not fired:
            return
        if old is not None and not fired:
            self.handle.deleteTimer(old[0])
        if ms is None:
            self.due.clear()
        else:
            self.handle.registerTimer(ms)
            self.due.update((ms,))


# ---- echoes -----------------------------------------------------------------------------------


class Echoes(StatefulProcessor):
    """Per key, a row within the hold time of the last accepted one is dropped; dropped rows extend nothing."""

    schema = "key string, t long, row_id string, kind string"

    def __init__(self, hold_ms: int):
        self.hold = hold_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # times in order, each with its smallest id, by blocks of time: the store is asked per block, not per row
        self.waiting = handle.getMapState("waiting", "block long", "times array<long>, ids array<string>")
        self.last = handle.getValueState("last", "t long")
        self.deadline = Deadline(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bound = timerValues.getCurrentWatermarkInMs() * 1000
        blocks, some, n = {k[0] for k in self.waiting.keys()}, [], 0
        for batch in rows:
            late = batch[batch["t"] < bound]
            if len(late):
                yield late.assign(kind=LATE)[["key", "t", "row_id", "kind"]]
            some.append(batch.loc[batch["t"] >= bound, ["t", "row_id"]])
            n += len(some[-1])
            if n >= KEEP_ROWS:
                self._keep(some, blocks)
                some, n = [], 0
        if n:
            self._keep(some, blocks)
        yield from self._decide(key[0], bound, blocks, False)

    def _keep(self, some: list[pd.DataFrame], blocks: set[int]) -> None:
        """Adds rows to the blocks of their times."""

        def first(rows: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.concat(rows).sort_values(["t", "row_id"]).drop_duplicates("t")

        rows = first(some)
        for block, part in rows.groupby(rows["t"] // BLOCK):
            if block in blocks:
                times, ids = self.waiting.getValue((block,))
                part = first([part, pd.DataFrame({"t": times, "row_id": ids})])
            self.waiting.updateValue((block,), (part["t"].tolist(), part["row_id"].tolist()))
            blocks.add(block)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._decide(key[0], timerValues.getCurrentWatermarkInMs() * 1000, {k[0] for k in self.waiting.keys()}, True)

    def _decide(self, key: str, bound: int, blocks: set[int], fired: bool) -> Iterator[pd.DataFrame]:
        """Decides what the watermark has passed, and sets the timer for what is left."""
        now = self.last.get()
        last, taken, left = (now[0] if now is not None else None), [], None
        for block in sorted(blocks):
            times, ids = self.waiting.getValue((block,))
            end = bisect_left(times, bound)
            i = 0 if last is None else bisect_left(times, last + self.hold)
            while i < end:
                last = times[i]
                taken.append((key, last, ids[i], ACCEPTED))
                i = max(i + 1, bisect_left(times, last + self.hold))
            if end < len(times):
                left = times[end]
                if end:
                    self.waiting.updateValue((block,), (list(times[end:]), list(ids[end:])))
                break
            self.waiting.removeKey((block,))
        if last is not None and last + self.hold <= bound and left is None:
            self.last.clear()
            last = None
        elif taken:
            self.last.update((last,))
        if left is not None:
            self.deadline.at(left // 1000 + 1, fired)
        else:
            self.deadline.at(-(-(last + self.hold) // 1000) if last is not None else None, fired)
        if taken:
            yield pd.DataFrame(taken, columns=["key", "t", "row_id", "kind"])


def accepted(
    stream: DataFrame, key: Column, row_id: str, hold_ms: int, delay: str, ticks: DataFrame | None = None, not_after: Column | None = None
) -> DataFrame:
    """(key, t, row_id, kind): accepted rows of a stream, and those that come too late to be decided."""
    with_state(stream.sparkSession)
    rows = timed(stream.select(key.alias("key"), "ts", F.col(row_id).cast("string").alias("row_id")), delay, ticks, not_after)
    return rows.groupBy("key").transformWithStateInPandas(Echoes(hold_ms), Echoes.schema, "Append", "EventTime")


# ---- multipart messages -----------------------------------------------------------------------


class Parts(StatefulProcessor):
    """Joins the parts of a message: when all are there, or when the watermark has passed those that are.

    What is known of a message is one value, read and written once an epoch: its parts (at most 255) and,
    once it is complete, the time of its newest part. The timer is set when the message is first seen; if
    newer parts have come by the time it runs out, it is set again.
    """

    schema = "broadcast_id long, sender string, body string, t long, parts int, kind string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "parts array<struct<part_no: int, body: string, t: long>>, done long")

    def _row(self, key, parts: list[tuple[int, str | None, int]], kind: str) -> Row:
        parts = sorted(parts, key=lambda p: p[0])
        text = "".join(body or "" for _, body, _ in parts)
        return Row(broadcast_id=key[0], sender=key[1], body=text, t=parts[-1][2], parts=len(parts), kind=kind)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bound = timerValues.getCurrentWatermarkInMs() * 1000
        late, fresh, total = [], {}, None
        for row in rows:
            if row.t < bound:
                late.append((row.part_no, row.body, row.t))
            else:
                fresh[row.part_no] = (row.body, row.t)
                total = row.part_count
        for part in late:
            yield self._row(key, [part], LATE)
        before = self.known.get() if fresh else None
        if not fresh or (before is not None and before[1] is not None):
            return  # parts sent again are no new message
        held = {number: (body, t) for number, body, t in (before[0] if before is not None else ())} | fresh
        newest = max(t for _, t in held.values())
        parts = [(number, body, t) for number, (body, t) in held.items()]
        if total is not None and len(parts) >= total:
            yield self._row(key, parts, COMPLETE)
            self.known.update(([], newest))
        else:
            self.known.update((parts, None))
        if before is None:
            self.handle.registerTimer(newest // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        parts, done = self.known.get()
        due = max([done, *(t for _, _, t in parts)] if done is not None else [t for _, _, t in parts]) // 1000 + 1
        if due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        if parts:
            yield self._row(key, [tuple(p) for p in parts], INCOMPLETE)
        self.known.clear()


def joined_parts(stream: DataFrame, delay: str, ticks: DataFrame | None = None) -> DataFrame:
    """(broadcast_id, sender, body, t, parts, kind) of a stream of parts.

    Parts are (broadcast_id, sender, part_no, part_count, body, ts); a null count means that only the
    watermark can tell that all are there.
    """
    with_state(stream.sparkSession)
    columns = ("broadcast_id", "sender", F.col("part_no").cast("int").alias("part_no"), F.col("part_count").cast("int").alias("part_count"), "body", "ts")
    rows = timed(stream.select(*columns), delay, ticks)
    return rows.groupBy("broadcast_id", "sender").transformWithState(Parts(), Parts.schema, "Append", "EventTime")


# ---- inbox ------------------------------------------------------------------------------------


class InboxStates(StatefulProcessor):
    """The state of each batch. Closed ones leave; one that stays in processing for too long fails by a timer."""

    schema = "id string, status string, t long, seq long, reason string"

    def __init__(self, closing: tuple[str, ...], limit_ms: int, remember_ms: int, clock: str):
        self.closing, self.limit, self.remember, self.event = set(closing), limit_ms, remember_ms, clock == "event"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "status string, t long, seq long")
        # the store forgets by itself only by the cluster's clock; by event time a timer does it
        self.closed = handle.getValueState("closed", "t long, seq long", None if self.event else self.remember)
        self.deadline = Deadline(handle)

    def _row(self, key, status: str, t: int, seq: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], status, t, seq, reason)], columns=[c.split()[0] for c in self.schema.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = max((s[-2:] for s in (self.now.get(), self.closed.get()) if s is not None), default=None)
        best = None
        for batch in rows:
            for status, t, seq in zip(batch["status"], batch["t"], batch["seq"], strict=True):
                if best is None or (t, seq) > best[:2]:
                    best = (int(t), int(seq), status)
        if best is None or (known is not None and best[:2] <= tuple(known)):
            return
        t, seq, status = best
        since = t // 1000 if self.event else timerValues.getCurrentProcessingTimeInMs()
        if status in self.closing:
            self.now.clear()
            self.closed.update((t, seq))  # older changes must not open it again
            self.deadline.at(since + self.remember if self.event else None)
        else:
            self.closed.clear()
            self.now.update((status, t, seq))
            self.deadline.at(since + self.limit if status == "processing" else None)
        yield self._row(key, status, t, seq, "changed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.now.get()
        self.deadline.at(None, True)
        self.closed.clear()
        if now is not None and now[0] == "processing":
            self.now.update(("failed", now[1], now[2]))
            yield self._row(key, "failed", now[1], now[2], "stale")


def inbox_states(
    changes: DataFrame,
    closing: tuple[str, ...] = ("completed", "discarded"),
    limit_minutes: float = 30,
    remember_minutes: float = 24 * 60,
    clock: str = "processing",
    delay: str = "10 minutes",
    ticks: DataFrame | None = None,
) -> DataFrame:
    """(id, status, t, seq, reason) for every change of a batch's state, from changes (id, status, ts, seq).

    Of changes in any order the one with the latest (ts, seq) counts. A closed batch leaves the state; for
    ``remember_minutes`` older changes still find it closed. A batch that stays in ``processing`` for
    ``limit_minutes`` is given as failed: by the cluster's clock also when no more rows come, with
    ``clock="event"`` when the watermark says so, which can be replayed.
    """
    if clock not in ("processing", "event"):
        raise ValueError("the clock is processing or event")
    with_state(changes.sparkSession)
    states = InboxStates(tuple(closing), int(limit_minutes * 60_000), int(remember_minutes * 60_000), clock)
    rows = changes.select("id", "status", "ts", F.col("seq").cast("long").alias("seq"))
    if clock == "event":
        return timed(rows, delay, ticks).groupBy("id").transformWithStateInPandas(states, InboxStates.schema, "Update", "EventTime")
    rows = rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).where("t is not null").drop("ts")
    return rows.groupBy("id").transformWithStateInPandas(states, InboxStates.schema, "Update", "ProcessingTime")


# ---- keys -------------------------------------------------------------------------------------


def body_key() -> Column:
    """Messages are equal when their trimmed bodies are."""
    return F.md5(strip(F.col("body")))


def path_key() -> Column:
    """Share batches are equal when their lists of paths are."""
    return F.md5(F.array_join("paths", "|"))
