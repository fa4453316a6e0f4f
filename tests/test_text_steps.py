"""Text steps of tokens and lines: shortcuts for texts that cannot match change no result, and nothing is worked out twice."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passbook.functions import boxes, categories, lines as ln, tokens as t
from passbook.functions.messages import message_date, minor_from_text
from passbook.functions.text import no_blanks, strip
from passbook.operators import skew

AS_OF = datetime(2026, 9, 30, 12)
TEXTS = [
    # text, repaired, date kind, minor amount of the token, has a line date
    ("R 250", "₹250", None, 25000, False),
    ("-rs.1,200.50", "- ₹1,200.50", None, 120050, False),
    ("₹  99", "₹99", None, 9900, False),
    ("+ ₹5", "+ ₹5", None, 500, False),
    ("+₹5", "+ ₹5", None, 500, False),
    ("z450", "₹450", None, 45000, False),
    ("Shop AB", "Shop AB", None, None, False),
    ("₹12é", "₹12é", None, None, False),
    ("today", "today", "date", None, True),
    ("yesterday at 9:30 pm", "yesterday at 9:30 pm", "datetime", None, True),
    ("at 9:30", "at 9:30", "time", None, False),
    ("3 days ago", "3 days ago", "datetime", None, True),
    ("12 September", "12 September", "date", None, True),
    ("sept 4", "sept 4", "date", None, True),
    ("2026-09-12", "2026-09-12", "date", None, False),
    ("12/09/2026", "12/09/2026", "date", None, True),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(x[0],) for x in TEXTS], "text string")
    text, none = F.col("text"), F.lit(None).cast("double")
    got = df.select(
        "text",
        t.repair_symbol(text).alias("repaired"),
        t.date_kind(text).alias("kind"),
        t.classify_amount(text, t.date_kind(text), none, none, none, none, none)["minor"].alias("minor"),
        ln.line_date(text, AS_OF).isNotNull().alias("dated"),
        ln.has_date(text).alias("has_date"),
    )
    return {r["text"]: r for r in got.collect()}


@pytest.mark.parametrize("text, repaired, kind, minor, dated", TEXTS)
def test_readings(read, text, repaired, kind, minor, dated):
    r = read[text]
    assert (r["repaired"], r["kind"], r["minor"], r["dated"], r["has_date"]) == (repaired, kind, minor, dated, dated)


def test_reason_of_an_amount_is_worked_out_once(spark):
    text, none = F.col("text"), F.lit(None).cast("double")
    tested = t.classify_amount(text, t.date_kind(text), none, none, none, none, none)
    plan = spark.createDataFrame([("a",)], "text string").select(tested)._jdf.queryExecution().optimizedPlan().toString()
    # The plan's text names the one use twice, as an argument and as what is bound.
    assert plan.count("bank_account_suffix") == 2


def test_join_without_hot_keys_is_plain(spark):
    left = spark.range(1000).selectExpr("id % 100 as k", "id")
    right = spark.range(100).selectExpr("id as k", "id * 2 as v")
    joined = skew.salted_left_join(left, right, ["k"], spread=["id"])
    assert "_salt" not in joined._jdf.queryExecution().analyzed().toString()
    hot = skew.salted_left_join(left, right, ["k"], spread=["id"], min_rows=5)
    assert "_salt" in hot._jdf.queryExecution().analyzed().toString()
    assert sorted(joined.collect()) == sorted(hot.collect())


def test_texts_that_are_no_numbers_are_not_cast(spark):
    text = F.col("text")
    readings = [ln.line_date(text, AS_OF), ln.has_date(text), t.detect_date(text, AS_OF), message_date(text), minor_from_text(text)]
    plan = spark.createDataFrame([("a",)], "text string").select(*readings)._jdf.queryExecution().analyzed().toString()
    # What a pattern found is tested before the cast: a cast of an empty text fails, which costs several times the pattern.
    assert "try_cast(" in plan and not re.search(r"try_cast\((?:regexp_extract|concat)", plan)
    df = spark.createDataFrame([(x,) for x in ("12 September", "7.5", "7.", "1,234.5", "7 5", "7a", "12.5 x")], "text string")
    assert [r["m"] for r in df.select(minor_from_text(text).alias("m")).collect()] == [None, 750, 700, 123450, None, None, 125]


def test_blanks_of_any_kind_are_stripped(spark):
    blanks = " \t\n\x0b\f\r         　﻿"
    df = spark.createDataFrame([(f"{blanks}A{blanks}b​{blanks}",)], "text string")
    row = df.select(strip(F.col("text")).alias("s"), no_blanks(F.col("text")).alias("n")).first()
    assert (row["s"], row["n"]) == (f"A{blanks}b​", "ab​")


@pytest.mark.parametrize("raw, box", [
    ("[10,20,5,6]", (10, 20, 15, 26)), ("[1,2,3,4]", (1, 2, 3, 4)), (" [ [1,2], [5,9] ]", (1, 2, 5, 9)), ("[1,2,3", None), ("", None), ("[[]]", None),
])
def test_boxes_are_read_by_their_form(spark, raw, box):
    found = boxes.normalise_box(F.col("raw"))
    df = spark.createDataFrame([(raw,)], "raw string").select(found.alias("b"))
    b = df.first()["b"]
    assert (b and (b["min_x"], b["min_y"], b["max_x"], b["max_y"])) == box


def test_keywords_are_looked_up_without_a_split(spark):
    """No pattern is compiled for each row, and the first keyword in rule order decides, whatever the text's order."""
    rows = ["uber after zomato", "zomato & uber", "nothing here", "", None, "UBERX", "café_uber uber", "  uber"]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    found = df.select(categories.matched_keyword(F.lit("expense"), categories.rule_tokens(F.lower("text"))).alias("k"))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    listed = list(dict.fromkeys(k for line in categories.EXPENSE_KEYWORDS.values() for k in line))

    def first(x):
        words = None if x is None else re.split("[^a-z0-9_]+", x.lower())
        return words and next((k for k in listed if (k in x.lower() if categories.is_phrase(k) else k in words)), None)

    assert [r["k"] for r in found.collect()] == [first(x) for x in rows]


def test_lines_that_hold_no_amount_are_not_read(spark, monkeypatch):
    """The tests before the readings change no result, and let neither a date nor a bare amount through."""
    rng = random.Random(11)
    parts = ["₹", "rs", "Rs.", "INR", "r", "z", "F", "7", "12", "450", "1,200", ".50", "+", "-", " ", "  ", "\u200b", "\ufeff", "\u00a0", "\n", "September", "Shop", "？", "¥", "*", "3 days ago"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 6))),) for _ in range(1500)]
    df = spark.createDataFrame(rows, "text string")

    def read():
        text = F.col("text")
        return df.select(text, ln.line_amount(text).alias("a"), ln.line_amount(text, True).alias("b"), ln.split_line(text).alias("s"))

    found = read().collect()
    for name, every in (("MAY_AMOUNT", r"\d"), ("MAY_SEVEN", r"\d"), ("MAY_SPLIT", r"\d\s*$")):
        monkeypatch.setattr(ln, name, every)
    assert found == read().collect() and any(r["s"] for r in found)
    monkeypatch.undo()
    assert not re.search(ln.MAY_AMOUNT, "12 September") and not re.search(ln.MAY_SPLIT, "₹1,234.50")
    assert re.search(ln.MAY_AMOUNT, "z450") and re.search(ln.MAY_SPLIT, "Shop 45 ")
