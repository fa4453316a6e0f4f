"""What is stored comes back: inbox documents, changes of the ledger."""

import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passbook.operators import inbox
from passbook.schema import CANDIDATE, LEDGER
from passbook.session import scratch_path
from passbook.sources import ledger_table, messages, pending


def test_large_batch_is_one_batch(spark):
    """A batch above the document limit: one header, all rows, original places."""
    rows = spark.range(30).select(
        F.lit("b").alias("batch_id"),
        F.col("id").alias("pos"),
        F.concat(F.lit("c"), "id").alias("id"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in CANDIDATE.fields if f.name not in ("batch_id", "pos", "id")],
    )
    batches = spark.createDataFrame(
        [("b", ["p"], datetime(2026, 1, 1), "readyForReview", "x")], "id string, paths array<string>, created_at timestamp_ntz, status string, source string"
    )
    path = scratch_path(spark, "pending")
    pending.write_pending(pending.documents(batches, rows, limit=10), path)
    assert pending.read_pending(spark, path).count() > 1
    headers, found = pending.read_batches(spark, path)
    assert inbox.active(headers).count() == 1
    assert sorted((r.pos, r.id) for r in found.collect()) == [(i, f"c{i}") for i in range(30)]


def test_limit_of_messages(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("sms_id"), F.timestamp_seconds("id").alias("ts"))
    assert messages.recent_sms(df, None).count() == 3000
    assert messages.recent_sms(df, 7).count() == 7
    with pytest.raises(ValueError):
        messages.recent_sms(df, 0)


def row(id_, month, amount):
    when = datetime(2026, month, 3)
    return (id_, "expense", amount, "INR", "t", None, None, when, None, "manual", when, when)


def stored(spark, path):
    return sorted((r.id, r.date.month, r.amount) for r in ledger_table.read_ledger(spark, path).collect())


def test_changes_are_stored(spark):
    path = scratch_path(spark, "ledger")
    frame = lambda *rows: spark.createDataFrame(list(rows), LEDGER)
    ledger_table.append(frame(row("a", 1, 1), row("b", 1, 2), row("c", 2, 3), row("d", 3, 4)), path, exists=False)
    ledger_table.append(frame(row("e", 3, 5)), path)
    with pytest.raises(ValueError):
        ledger_table.append(frame(row("e", 4, 5)), path)
    ledger_table.replace_rows(spark, path, frame(row("c", 4, 30), row("zz", 1, 9), row("a", 1, 10)))
    assert stored(spark, path) == [("a", 1, 10), ("b", 1, 2), ("c", 4, 30), ("d", 3, 4), ("e", 3, 5)]
    with pytest.raises(ValueError, match="twice"):
        ledger_table.replace_rows(spark, path, frame(row("a", 1, 5), row("a", 1, 6)))
    ledger_table.delete_rows(spark, path, spark.createDataFrame([("b",), ("d",), ("e",), ("none",)], "id string"))
    assert stored(spark, path) == [("a", 1, 10), ("c", 4, 30)]
    ledger_table.append(frame(), path)
    assert len(stored(spark, path)) == 2


def test_batches_are_shuffled_once_and_written_small(spark):
    """Batches below and above the limit, one without rows: all come back; without large ones rows are dealt by batch alone."""
    rows = spark.range(60).select(
        F.concat(F.lit("b"), (F.col("id") % 10 % 3).cast("string")).alias("batch_id"),
        F.col("id").alias("pos"),
        F.concat(F.lit("c"), "id").alias("id"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in CANDIDATE.fields if f.name not in ("batch_id", "pos", "id")],
    )
    batches = spark.createDataFrame(
        [(f"b{i}", ["p"], datetime(2026, 1, 1), "readyForReview", "x") for i in range(4)],
        "id string, paths array<string>, created_at timestamp_ntz, status string, source string",
    )
    want = sorted((r.batch_id, r.pos, r.id) for r in rows.collect())
    for limit in (20, 100):
        path = scratch_path(spark, "pending")
        docs = pending.documents(batches, rows, limit=limit)
        pending.write_pending(docs, path)
        headers, found = pending.read_batches(spark, path)
        assert sorted((r.batch_id, r.pos, r.id) for r in found.collect()) == want
        assert sorted(r.id for r in headers.collect()) == ["b0", "b1", "b2", "b3"]
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", docs._jdf.queryExecution().executedPlan().toString())
        assert any("part#" in d for d in dealt) == (limit == 20)
    files = list(Path(path).glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
