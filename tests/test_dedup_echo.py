"""Duplicates and echoes, also with a few keys that hold most rows, against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from passbook.operators import dedup, echo, inbox
from passbook.operators.skew import salted_left_join
from passbook.schema import LEDGER

DAY = datetime(2026, 9, 8)
ROWS = "batch_id string, pos long, id string, date timestamp_ntz, amount long, title string, merchant string, type string"


def test_duplicate_cases(spark):
    ledger = spark.createDataFrame(
        [("l", "expense", 42000, "INR", "x", "Swiggy", None, DAY, None, "manual", DAY, DAY)], LEDGER
    )
    rows = [
        ("b", 0, "1", DAY, 42000, None, " SWIGGY ", "expense"),
        ("b", 1, "2", DAY, 28000, None, "Uber  Ride", "expense"),
        ("b", 2, "3", DAY, 28000, None, "uber ride", "expense"),
        ("c", 0, "4", DAY, 28000, None, "uber ride", "expense"),
    ]
    out = {r.id: r.duplicate_source for r in dedup.detect_duplicates(spark.createDataFrame(rows, ROWS), ledger).collect()}
    assert out == {"1": "existingDb", "2": None, "3": "intraBatch", "4": None}


def test_hot_fingerprint_gives_the_same_result(spark):
    rng = random.Random(7)
    rows = [
        ("b", i, str(i), DAY, 100 if rng.random() < 0.5 else rng.randrange(60), "t", "m", "expense") for i in range(800)
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.id: r.is_duplicate for r in dedup.detect_duplicates(df, None, min_hot=2).collect()}
    seen, want = set(), {}
    for r in rows:
        want[r[2]] = r[4] in seen
        seen.add(r[4])
    assert got == want
    # Deciding twice changes nothing.
    again = dedup.detect_duplicates(dedup.detect_duplicates(df, None).drop("fp"), None)
    assert {r.id: r.is_duplicate for r in again.collect()} == want


def test_rows_without_hot_fingerprints_are_shuffled_once(spark):
    rng = random.Random(5)
    names = ["m", " M ", "n", None]
    rows = [(rng.choice("abc"), i, str(i), DAY, rng.randrange(40), "t", rng.choice(names), "expense") for i in range(600)]
    df = spark.createDataFrame(rows, ROWS)
    ledger = spark.createDataFrame(
        [(f"l{i}", "expense", i, "INR", "x", "M", None, DAY, None, "manual", DAY, DAY) for i in range(0, 40, 3)], LEDGER
    )
    pending = df.where("amount % 5 = 0 and batch_id = 'a'")
    for decide in (
        lambda hot: dedup.detect_duplicates(df, ledger, min_hot=hot),
        lambda hot: dedup.rows_to_stage(df, ledger, pending, min_hot=hot),
    ):
        cold, hot = (decide(n).select("id", "fp", "duplicate_source", "is_duplicate") for n in (1000, 2))
        assert cold.count() and sorted(map(repr, cold.collect())) == sorted(map(repr, hot.collect()))
    plan = dedup.detect_duplicates(df, ledger)._jdf.queryExecution().optimizedPlan().toString()
    # The rows are read once; each of the frames that a hot fingerprint asks for reads them again.
    assert plan.count("fingerprints") + plan.count("Relation [") == 1 and "Window" in plan


def test_review_totals_take_ids_or_a_test(spark):
    rows = [(str(i), DAY if i % 2 else None, i, 0.9, 0.9, 0.9, 0.9, i % 3 == 0) for i in range(20)]
    kinds = "id string, date timestamp_ntz, amount long, confidence double, amount_confidence double, merchant_confidence double, date_confidence double, is_duplicate boolean"
    df = spark.createDataFrame(rows, kinds).withColumn("warnings", F.array().cast("array<string>"))
    test = F.col("date").isNotNull() & (F.col("amount") > 5)
    assert inbox.review_totals(df, test).collect() == inbox.review_totals(df, df.where(test)).collect()


def test_salted_join_equals_plain_join(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = left.join(right, "k", "left").select("id", "k", "v")
    salted = salted_left_join(left, right, ["k"], min_rows=2).select("id", "k", "v")
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_echo_chain_against_brute_force(spark):
    rng, base = random.Random(3), datetime(2026, 9, 1)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 300, 900, 1500, 2500, 4000])
        rows.append((f"{i:05d}", "hot" if rng.random() < 0.7 else f"b{rng.randrange(3)}", base + timedelta(milliseconds=t)))
    want, last = set(), {}
    for i, body, ts in rows:
        if body not in last or ts - last[body] >= timedelta(seconds=2):
            want.add(i)
            last[body] = ts
    df = spark.createDataFrame(rows, "sms_id string, body string, ts timestamp_ntz")
    for block_ms in (2_000, 10_000, 600_000):
        got = {r.sms_id for r in echo.drop_echoes(df, block_ms=block_ms).collect()}
        assert got == want, block_ms
