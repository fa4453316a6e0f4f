"""Quick looks at a text say what all rules say."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from passbook.functions import lines as ln
from passbook.functions import tokens as t
from passbook.operators import lines

TEXTS = [
    "₹5", "₹ 1,234.50", "+₹12", "- ₹ 7,00,000", "₹0", "₹0.00", "₹12.345", "₹1,2,3", "+ ₹5", "-₹1234", "₹99999999999999999999", "₹5\u0085", " ₹5 ",
    "₹ 5", "₹5 ", "Shop", "", None, "12 September", "2024", "10:30", "r 5", "Rs.5", "z 50", "7500", "0123", "买 5", "-123", "XX1234", "Order ID: abcdef",
    "Shop AB ₹12.50", "Shop AB ₹ 0", "Total ₹500", "rs ₹5", "Subtotal due ₹5", "Coins ₹5", "yesterday ₹5", "Shop  ₹5", "R ₹5", "A ₹5", "Shop ₹1,2", "Shop\t₹5",
]


def test_read_amount_says_what_all_rules_say(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    x = F.col("x")
    for place in ([F.lit(None).cast("double")] * 5, [F.lit(v) for v in (10.0, 20.0, 50.0, 900.0, 1600.0)]):
        for seven in (False, True):
            whole = t.classify_amount(x, t.date_kind(x), *place, seven)
            want = F.struct(whole["is_amount"], whole["minor"], whole["has_currency"])
            for r in df.select("x", t.read_amount(x, *place, seven).alias("got"), want.alias("want")).collect():
                assert tuple(r.got) == tuple(r.want), r


def test_named_and_signed_lines(spark):
    rows = {
        "₹ 1,234.50": (123450, False, None),
        "+₹12": (1200, True, None),
        "₹0": (None, None, None),
        "Shop AB ₹12.50": (1250, False, "Shop AB"),
        "Total ₹500": (None, None, None),
        "Coins ₹5": (None, None, None),
        "Shop  ₹5": (500, False, "Shop"),
        "A ₹5": (500, False, None),
        "yesterday ₹5": (500, False, None),
    }
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    got = df.select("x", ln.line_amount(F.col("x")).alias("a"), ln.split_line(F.col("x"))["name"].alias("name")).collect()
    for r in got:
        assert (r.a and r.a.minor, r.a and r.a.is_income, r.name) == rows[r.x], r


def test_lines_of_other_layouts_are_not_read(spark):
    page = [("a", 1, "Paid to"), ("a", 2, "Shop"), ("a", 3, "₹ 5.00"), ("a", 4, "Paid to"), ("a", 5, "Shop"), ("a", 6, "₹ 7.00")]
    page += [("b", 1, "Shop AB ₹5.00"), ("b", 2, "Shop CD ₹6.00")]
    box = [f"cast(null as double) as {c}" for c in ("left", "top", "right", "bottom")]
    df = spark.createDataFrame(page, "image_id string, line_no long, text string").selectExpr("*", *box, "900d as width", "1600d as height")
    read = lines.of_layouts(df, ["timeline"], datetime(2026, 9, 30, 12))
    assert {r.image_id for r in read.collect()} == {"a"}
    assert sorted(r.minor for r in lines.timeline_rows(read).collect()) == [500, 700]
