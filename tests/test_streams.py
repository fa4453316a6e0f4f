"""Streams with state: several epochs in any order, late rows, restarts and timers, against the batch rules."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from passbook.operators import echo
from passbook.streaming import jobs, stateful

BASE = datetime(2026, 9, 1)
SMS = "sms_id string, body string, ts timestamp"
PART = "broadcast_id long, sender string, part_no int, part_count int, body string, ts timestamp"
CHANGE = "id string, status string, ts timestamp, seq long"


def later(ms):
    return BASE + timedelta(milliseconds=ms)


@pytest.fixture
def feed(spark, tmp_path):
    """Puts rows into a stream's folder, an epoch at a time."""
    spark.conf.set("spark.sql.shuffle.partitions", 2)

    class Feed:
        out, ticks = str(tmp_path / "out"), str(tmp_path / "ticks")

        def put(self, rows, schema):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def stream(self, schema):
            return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

        def clock(self):
            return jobs.read_ticks(spark, self.ticks)

        def kind(self, operator, *kinds):
            return jobs.read_kind(spark, f"{self.out}/rows", operator.schema, *kinds)

    yield Feed()
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_echoes_over_epochs_equal_batch(spark, feed):
    """Rows come in any order within the delay, each epoch from a restart; ties on one time keep the smaller id."""
    rng, rows, t = random.Random(5), [], 0
    for i in range(240):
        t += rng.choice([0, 1, 300, 900, 1500, 2500])
        rows.append((f"{i:03d}", rng.choice(["a", "a", " a ", "b"]), later(t)))
    shuffled = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.randrange(100)), r[0]))
    run = lambda: jobs.stream_echo(feed.stream(SMS), feed.out, delay="10 minutes", ticks=feed.clock()).awaitTermination()
    for part in (shuffled[:100], shuffled[100:]):
        feed.put(part, SMS)
        run()
    jobs.tick(spark, feed.ticks, later(t) + timedelta(hours=1))
    run()
    feed.put([("late", "a", BASE)], SMS)
    run()
    batch = echo.drop_echoes(spark.createDataFrame(rows, SMS))
    assert {r.row_id for r in feed.kind(stateful.Echoes, "accepted").collect()} == {r.sms_id for r in batch.collect()}
    assert [r.row_id for r in feed.kind(stateful.Echoes, "late").collect()] == ["late"]


def test_an_earlier_row_in_a_later_epoch_and_a_row_with_a_wrong_time(spark, feed):
    """Both of two messages 100 s apart stay when the earlier one comes second, whatever a third one's clock says."""
    bound = F.lit(later(200_000)).cast("timestamp")
    run = lambda: jobs.stream_echo(feed.stream(SMS), feed.out, ticks=feed.clock(), not_after=bound).awaitTermination()
    feed.put([("2", "a", later(100_000)), ("ahead", "b", later(10**11))], SMS)
    run()
    feed.put([("1", "a", later(0)), ("3", "a", later(101_999))], SMS)
    run()
    jobs.tick(spark, feed.ticks)
    run()
    assert {r.row_id for r in feed.kind(stateful.Echoes, "accepted").collect()} == {"1", "2", "ahead"}


def test_parts_over_epochs(spark, feed):
    run = lambda: jobs.stream_parts(feed.stream(PART), feed.out, ticks=feed.clock()).awaitTermination()
    feed.put([(1, "S", 2, 3, "c", later(20)), (2, "S", 0, 2, "x", later(0)), (3, "S", 1, None, "q", later(5))], PART)
    run()
    feed.put([(1, "S", 0, 3, "a", later(0)), (1, "S", 1, 3, "b", later(10)), (3, "S", 0, None, "p", later(9)), (1, "T", 0, 1, "other sender", later(1))], PART)
    run()
    whole = {(r.broadcast_id, r.sender): (r.body, r.parts) for r in feed.kind(stateful.Parts, "complete").collect()}
    assert whole == {(1, "S"): ("abc", 3), (1, "T"): ("other sender", 1)}
    feed.put([(1, "S", 1, 3, "b", later(10))], PART)  # sent again: no new message
    run()
    jobs.tick(spark, feed.ticks, later(3_600_000))
    run()
    feed.put([(2, "S", 1, 2, "y", later(30))], PART)
    run()
    rows = {(r.broadcast_id, r.body, r.parts, r.kind) for r in feed.kind(stateful.Parts, "complete", "incomplete", "late").collect()}
    assert rows == {(1, "abc", 3, "complete"), (1, "other sender", 1, "complete"), (2, "x", 1, "incomplete"), (3, "pq", 2, "incomplete"), (2, "y", 1, "late")}
    ends = {r.broadcast_id: r.t for r in feed.kind(stateful.Parts, "complete", "incomplete").where("sender = 'S'").collect()}
    micros = lambda ms: int(later(ms).timestamp() - datetime(1970, 1, 1).timestamp()) * 1_000_000 + ms % 1000 * 1000
    assert ends == {1: micros(20), 2: micros(0), 3: micros(5)}


def test_inbox_by_event_time(spark, feed):
    options = {"clock": "event", "limit_minutes": 30, "remember_minutes": 60, "drain": True}
    run = lambda: jobs.stream_inbox(feed.stream(CHANGE), feed.out, ticks=feed.clock(), **options).awaitTermination()
    feed.put([("a", "processing", later(0), 1), ("b", "readyForReview", later(5), 2), ("b", "processing", later(0), 1), ("c", "discarded", later(9), 2)], CHANGE)
    run()
    feed.put([("c", "readyForReview", later(8), 1), ("d", "processing", later(10), 1)], CHANGE)
    run()
    feed.put([("d", "readyForReview", later(20), 2)], CHANGE)
    run()
    jobs.tick(spark, feed.ticks, later(50 * 60_000))
    run()
    last = {r.id: (r.status, r.reason) for r in jobs.read_inbox(spark, feed.out).collect()}
    assert last == {"a": ("failed", "stale"), "b": ("readyForReview", "changed"), "c": ("discarded", "changed"), "d": ("readyForReview", "changed")}


def test_inbox_by_the_clock(spark, feed):
    """A batch that hangs is given as failed without new rows, and closed batches leave the state."""
    feed.put([("a", "processing", later(0), 1), ("b", "completed", later(0), 1), ("c", "discarded", later(0), 1)], CHANGE)
    query = jobs.stream_inbox(feed.stream(CHANGE), feed.out, limit_minutes=0.08, remember_minutes=0.03)
    end = time.time() + 60
    done = False
    while not done and time.time() < end and query.isActive:
        time.sleep(0.5)
        progress = query.lastProgress
        rows = [(r.id, r.status, r.reason) for r in spark.read.parquet(f"{feed.out}/rows").collect()] if progress else []
        done = ("a", "failed", "stale") in rows and progress["stateOperators"][0]["numRowsTotal"] <= 1
    query.stop()
    assert done


class _Store:
    """A state store that counts what it is asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):
        return self

    def _count(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._count(self.value)

    def update(self, value):
        self.value = self._count(value)

    def clear(self):
        self.value = self._count()

    def registerTimer(self, ms):
        self._count(self.timers.append(ms))

    def getCurrentWatermarkInMs(self):
        return self.now


def test_parts_ask_the_store_little_and_wait_for_the_newest(spark):
    store, parts = _Store(), stateful.Parts()
    parts.init(store)

    def epoch(now, *rows):
        store.now, store.calls = now, 0
        return [tuple(r)[2:] for r in parts.handleInputRows((1, "S"), iter([Row(part_no=n, part_count=3, body=b, t=t) for n, b, t in rows]), store)]

    def fire(now):
        store.now = now
        return [tuple(r)[2:] for r in parts.handleExpiredTimer((1, "S"), store, None)]

    assert epoch(0, (1, "b", 5_000)) == [] and store.calls <= 3
    assert epoch(0, (0, "a", 20_000)) == [] and store.calls <= 3
    assert store.timers == [6]
    assert fire(10) == [] and store.timers == [6, 21]  # a newer part came after the timer was set
    assert epoch(10, (2, "x", 9_000)) == [("x", 9_000, 1, stateful.LATE)]
    assert fire(30) == [("ab", 5_000, 2, stateful.INCOMPLETE)] and store.value is None
    assert epoch(30, (2, "c", 40_000), (1, "b", 40_001), (0, "a", 40_002)) == [("abc", 40_000, 3, stateful.COMPLETE)]
    assert epoch(30, (0, "a", 41_000)) == [] and store.value == ([], 40_002)  # sent again
    assert fire(50) == [] and store.value is None


class _Blocks(_Store):
    """A store with a map, counted too."""

    def __init__(self):
        super().__init__()
        self.held = {}

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return _Store()

    def keys(self):
        return self._count(list(self.held))

    def getValue(self, key):
        return self._count(self.held[key])

    def updateValue(self, key, value):
        self.held[key] = self._count(value)

    def removeKey(self, key):
        self._count(self.held.pop(key))

    def deleteTimer(self, ms):
        self._count()


def test_echoes_ask_the_store_by_block(spark):
    store, echoes = _Blocks(), stateful.Echoes(1_000)
    echoes.init(store)
    rows = pd.DataFrame({"key": "k", "t": [i * 300_000 for i in range(10_000)], "row_id": [f"b{i}" for i in range(10_000)]})
    again = rows.assign(row_id=rows["row_id"].str.replace("b", "a"))

    def epoch(now, *batches):
        store.now, store.calls = now, 0
        return [tuple(r) for d in echoes.handleInputRows(("k",), iter(batches), store) for r in d.itertuples(index=False)]

    assert epoch(0, rows, again) == [] and store.calls <= 8
    taken = epoch(1_500_100, rows.iloc[-1:])
    assert taken == [("k", i * 300_000, f"a{i}", stateful.ACCEPTED) for i in range(0, 5_001, 4)] and store.calls <= 12
    assert store.held[(0,)][0][0] == 5_001 * 300_000 and store.timers[-1] == 5_001 * 300 + 1
    assert epoch(1_500_100, rows.iloc[:1]) == [("k", 0, "b0", stateful.LATE)]
