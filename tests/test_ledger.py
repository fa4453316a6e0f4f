"""Golden ledger cases: filters, sorts, metrics, comparison, edges, table writes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passbook.functions.money import fixed_text, format_minor
from passbook.operators import analytics
from passbook.plans.filters import SORT_MODES, FilterSpec, apply_filter, sorted_history
from passbook.plans.period import Period
from passbook.schema import LEDGER
from passbook.sources import ledger_table

NOW = datetime(2026, 9, 11, 14, 30)


def row(i, amount, kind="expense", date=NOW, title="T", merchant=None, category=None, note=None, source="manual"):
    return (i, kind, amount, "INR", title, merchant, category, date, note, source, date, date)


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [
        row("tx-1", 42000, title="Swiggy Dinner", merchant="Swiggy Instamart", category="food", note="Ordered biryani with friends"),
        row("tx-2", 18000, title="Uber to Office", merchant="Uber India", category="transport", date=datetime(2026, 9, 10, 10), source="screenshot"),
        row("tx-3", 5000000, "income", title="Monthly Salary", merchant="Google India", category="salary", date=datetime(2026, 9, 10, 10), note="September payroll"),
        row("tx-4", 250000, title="Electronics Shopping", merchant="Amazon", category="shopping", date=datetime(2026, 9, 4, 12), source="screenshot"),
        row("tx-5", 1500000, "income", title="Freelance Design", merchant="Upwork", category="freelance", date=datetime(2026, 8, 15, 18)),
    ]
    return spark.createDataFrame(rows, LEDGER).cache()


def ids(df):
    return {r.id for r in df.select("id").collect()}


@pytest.mark.parametrize(
    "spec,want",
    [
        (FilterSpec(date_preset="today"), {"tx-1"}),
        (FilterSpec(date_preset="yesterday"), {"tx-2", "tx-3"}),
        (FilterSpec(date_preset="last_month"), {"tx-5"}),
        (FilterSpec(amount_preset="under_500"), {"tx-1", "tx-2"}),
        (FilterSpec(amount_preset="1000_5000"), {"tx-4"}),
        (FilterSpec(amount_preset="custom", min_amount=50000, max_amount=300000), {"tx-4"}),
        (FilterSpec(type="expense", date_preset="this_month", amount_preset="under_500"), {"tx-1", "tx-2"}),
        (FilterSpec(query="SWIGGY"), {"tx-1"}),
        (FilterSpec(query="  Swiggy  "), {"tx-1"}),
        (FilterSpec(query="payroll"), {"tx-3"}),
        (FilterSpec(category_id="FOOD"), {"tx-1"}),
        (FilterSpec(source="screenshot"), {"tx-2", "tx-4"}),
    ],
)
def test_filters(ledger, spec, want):
    assert ids(apply_filter(ledger, spec, NOW)) == want


def test_sorts(ledger):
    first = {m: sorted_history(ledger, m).first().id for m in SORT_MODES}
    assert first == {"newest": "tx-1", "oldest": "tx-5", "highest": "tx-3", "lowest": "tx-2", "a_to_z": "tx-4", "z_to_a": "tx-2"}


def test_metrics_and_empty(spark):
    rows = [
        row("tx-1", 10000000, "income", datetime(2026, 9, 5)),
        row("tx-2", 3000000, date=datetime(2026, 9, 10), category="food"),
        row("tx-3", 1000000, date=datetime(2026, 9, 12), category="transport"),
        row("tx-4", 5000000, date=datetime(2026, 8, 20)),
    ]
    p = Period.resolve("this_month", NOW)
    m = analytics.metrics(spark.createDataFrame(rows, LEDGER), p).first()
    assert (m.total_income, m.total_expense, m.net, m.income_count, m.expense_count, m.avg_expense) == (10000000, 4000000, 6000000, 1, 2, 2000000)
    assert analytics.largest_expense(spark.createDataFrame(rows, LEDGER), p).first().id == "tx-2"
    empty = spark.createDataFrame([], LEDGER)
    e = analytics.metrics(empty, p).first()
    assert (e.total_income, e.total_expense, e.avg_expense, e.largest_expense) == (0, 0, 0, 0)
    assert analytics.category_breakdown(empty, p).count() == 0
    c = analytics.comparison(empty, p).first()
    assert c.comparison_text == "No previous period data" and not c.has_previous
    assert analytics.insights(empty, p).count() == 0


@pytest.mark.parametrize(
    "now,before,percent,text",
    [
        (100000, None, None, "₹1000 more than last month"),
        (120000, 100000, 20.0, "20.0% higher than last month"),
        (50000, 100000, -50.0, "50.0% lower than last month"),
        (100500, 100000, 0.5, "Roughly unchanged vs last month"),
    ],
)
def test_comparison(spark, now, before, percent, text):
    rows = [row("a", now, date=datetime(2026, 9, 5))]
    rows += [row("b", before, date=datetime(2026, 8, 5))] if before else []
    c = analytics.comparison(spark.createDataFrame(rows, LEDGER), Period.resolve("this_month", NOW)).first()
    assert c.comparison_text == text
    assert c.percent_change == (None if percent is None else pytest.approx(percent))


def test_month_edges(spark):
    rows = [
        row("a", 10000, date=datetime(2026, 9, 1)),
        row("b", 20000, date=datetime(2026, 9, 30, 23, 59, 59)),
        row("c", 40000, date=datetime(2026, 10, 1)),
        row("d", 80000, date=datetime(2026, 8, 31, 23, 59, 59)),
    ]
    df = spark.createDataFrame(rows, LEDGER)
    p = Period.resolve("this_month", NOW)
    m = analytics.metrics(df, p).first()
    assert (m.total_expense, m.expense_count) == (30000, 2)
    shares = {r.category_id: r.percentage for r in analytics.category_breakdown(df, p).collect()}
    assert shares == {"other": 100.0}
    # Buckets never hold more than the period, categories hold all of it.
    assert analytics.trend(df, p).agg(F.sum("expense")).first()[0] == 30000


def test_texts(spark):
    df = spark.createDataFrame([(12345678, 12.25), (5, 1.005)], "m long, d double")
    got = df.select(format_minor(F.col("m")).alias("f"), fixed_text(F.col("d"), 1).alias("one"), fixed_text(F.col("d"), 2).alias("two")).collect()
    assert [tuple(r) for r in got] == [("₹1,23,456.78", "12.3", "12.25"), ("₹0.05", "1.0", "1.00")]


def test_table_writes(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one, two = row("a", 100), row("b", 200, date=datetime(2026, 8, 1))
    ledger_table.append(spark.createDataFrame([one, two], LEDGER), path, exists=False)
    with pytest.raises(ValueError):
        ledger_table.append(spark.createDataFrame([one], LEDGER), path)
    ledger_table.append(spark.createDataFrame([], LEDGER), path)
    stored = ledger_table.read_ledger(spark, path)
    assert ids(stored) == {"a", "b"}
    assert ids(ledger_table.read_ledger(spark, path, datetime(2026, 9, 1))) == {"a"}
    changed = ledger_table.replace(stored, spark.createDataFrame([row("a", 50000), row("zz", 1)], LEDGER))
    assert {(r.id, r.amount) for r in changed.collect()} == {("a", 50000), ("b", 200)}
    assert ids(ledger_table.delete(stored, spark.createDataFrame([("a",)], "id string"))) == {"b"}
    ledger_table.clear(spark, path)
    assert ledger_table.read_ledger(spark, path).count() == 0
