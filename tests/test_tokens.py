"""Token goldens: amounts, dates, regions, seven layouts, order independence."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from layouts import EXPECTED, TOKEN_SCHEMA, layout_rows, token
from passbook import catalog
from passbook.catalog.registry import Tables
from passbook.functions import lines as line_rules
from passbook.functions import tokens as rules
from passbook.operators import regions, skew, spatial, tokens

AS_OF = datetime(2026, 9, 20, 12)
ACCEPTED = {"₹3,700.97": 370097, "R40": 4000, "R2,500": 250000, "+1,000": 100000, "5,000": 500000, "349": 34900, "75,000": 500000,
            "7205": 20500, "₹75": 7500, "₹750": 75000, "₹200.90": 20090, "₹5,000": 500000}
REJECTED = ["16:48", "08:56?", "8:30 AM", "7September", "04 Sept", "2September2026at2:35pm", "8 hours ago", "ODO7SNACKS", "KRISHNA STORE",
            "Search transactions", "name@bank", "004415604898", "2026"]


def test_amount_texts(spark):
    df = spark.createDataFrame([(x,) for x in [*ACCEPTED, *REJECTED]], "x string")
    place = [F.lit(v) for v in (399.0, 420.0, 500.0, 462.0, 1024.0)]
    out = df.select("x", rules.classify_amount(F.col("x"), rules.date_kind(F.col("x")), *place, True).alias("a")).collect()
    assert {r.x: r.a.minor for r in out if r.a.is_amount} == ACCEPTED
    out = df.select("x", rules.classify_amount(F.col("x"), rules.date_kind(F.col("x")), *place).alias("a")).collect()
    plain = {r.x: r.a.minor for r in out if r.a.is_amount}
    assert (plain["75,000"], plain["7205"]) == (7500000, 720500)
    line = df.select("x", line_rules.line_amount(F.col("x")).alias("a")).where("x = '75,000'").first().a
    assert line.minor == 7500000


def test_single_digit_at_the_left_is_no_amount(spark):
    place = [F.lit(v) for v in (10.0, 20.0, 500.0, 462.0, 1024.0)]
    a = spark.range(1).select(rules.classify_amount(F.lit("7"), F.lit(None), *place).alias("a")).first().a
    assert not a.is_amount and a.reason == "single_digit_left_aligned"


def test_dates(spark):
    want = {
        "18 Sep 2026": datetime(2026, 9, 18),
        "18-09-2026": datetime(2026, 9, 18),
        "2026-09-18": datetime(2026, 9, 18),
        "September 3, 2026": datetime(2026, 9, 3),
        "18 Sep, 2:30 PM": datetime(2026, 9, 18, 14, 30),
        "1Aug": datetime(2026, 8, 1),
        "12 Maruti": None,
    }
    df = spark.createDataFrame([(x,) for x in want], "x string")
    d = rules.detect_date(F.col("x"), AS_OF)
    rows = df.select("x", d.alias("d"), rules.date_kind(F.col("x")).alias("k")).collect()
    assert {r.x: (r.d.date if r.d else None) for r in rows} == want
    assert all((r.d.kind if r.d else None) == r.k for r in rows)


def test_line_dates_and_amounts(spark):
    want = {
        "8 hours ago": datetime(2026, 9, 20, 4),
        "2 days ago": datetime(2026, 9, 18),
        "7 September": datetime(2026, 9, 7),
        "25 Dec": datetime(2025, 12, 25),
        "07/09/2026": datetime(2026, 9, 7),
        "2 September 2026 at 2:35 pm": datetime(2026, 9, 2, 14, 35),
        "Swiggy": None,
    }
    df = spark.createDataFrame([(x,) for x in want], "x string")
    rows = df.select("x", line_rules.line_date(F.col("x"), AS_OF).alias("d"), line_rules.has_date(F.col("x")).alias("h")).collect()
    assert {r.x: (r.d.date if r.d else None) for r in rows} == want
    assert all((r.d is not None) == r.h for r in rows)
    pieces = [(["₹", "5", ",", "000"], 500000), (["+", "₹", "8,000"], 800000), (["no"], None)]
    got = spark.createDataFrame([(p,) for p, _ in pieces], "p array<string>").select(line_rules.join_tokens(F.col("p")).alias("a")).collect()
    assert [r.a.minor if r.a else None for r in got] == [w for _, w in pieces]


def test_overlap_and_consolidation(spark):
    rows = [token("i", 0, "₹5,000", 100, 100, 200, 130, 0.9), token("i", 1, "R5,000", 102, 101, 203, 131, 0.8), token("i", 2, "Shop", 10, 100, 80, 130)]
    df = spark.createDataFrame(rows, TOKEN_SCHEMA)
    pairs = regions.overlap_pairs(df).collect()
    assert [(p.a_token_no, p.b_token_no) for p in pairs] == [(0, 1)]
    out = {r.text: r.candidates_count for r in regions.consolidate(df).collect()}
    assert out == {"₹5,000": 2, "Shop": 1}


def test_seven_layouts_by_roles(spark):
    df = spark.createDataFrame(layout_rows(), TOKEN_SCHEMA)
    out = spatial.spatial_candidates(df).orderBy("image_id", "pos").collect()
    got = {}
    for r in out:
        got.setdefault(r.image_id, []).append((r.amount_minor_units, r.merchant_text, r.transaction_type))
    assert {k: [(a, t) for a, _, t in v] for k, v in got.items()} == {k: [(a, t) for a, _, t in v] for k, v in EXPECTED.items()}
    named = [(g[1], w[1]) for k in EXPECTED for g, w in zip(got[k], EXPECTED[k]) if w[1] is not ...]
    assert sum(g == w for g, w in named) >= len(named) - 1


def test_list_and_receipts_in_any_row_order(spark):
    rows = layout_rows()
    results = []
    for order in (rows, rows[::-1]):
        out = tokens.token_candidates(spark.createDataFrame(order, TOKEN_SCHEMA))
        results.append({(r.image_id, r.amount_minor_units, r.merchant_text, r.date_text) for r in out.collect()})
    assert results[0] == results[1]
    assert ("receipt1", 7000, "Shiva", "18 September 2026, 3:15 PM") in results[0]
    assert ("list", 18500, "Uber India Systems", "17 Sep 2026") in results[0]


def test_neighbours_across_stripes(spark):
    rows = [token("i", n, "₹1" if n % 7 == 0 else "x", 0, 97 * n, 50, 97 * n + 20) for n in range(60)]
    df = spark.createDataFrame(rows, TOKEN_SCHEMA)
    anchor = F.col("text") == "₹1"
    out = tokens.neighbours(df, anchor, F.struct("cy", "token_no"), [F.col("cy"), F.col("token_no")]).collect()
    for r in out:
        assert (r.above.token_no if r.above else None) == r.token_no // 7 * 7
        below = -(-r.token_no // 7) * 7
        assert (r.below.token_no if r.below else None) == (below if below < 60 else None)


@pytest.mark.parametrize("min_hot,counted", [(100_000, False), (20, False), (20, True)])
def test_neighbours_with_and_without_stripes(spark, min_hot, counted):
    """Images below and above the limit, rows without a place, and an image without amounts."""
    rows = [("hot", n, (n * 37 % 61) * 53.0, n % 9 == 0) for n in range(61)] + [("cold", n, n * 400.0, n == 2) for n in range(5)]
    rows += [("bare", n, n * 10.0, False) for n in range(3)]
    rows += [(i, 100 + n, None, n == 1) for i in ("hot", "cold") for n in range(3)]
    df = spark.createDataFrame(rows, "image_id string, token_no long, cy double, a boolean")
    counts = df.groupBy("image_id").agg(F.count("*").alias("n")) if counted else None
    order = [F.col("cy"), F.col("token_no")]
    out = tokens.neighbours(df, F.col("a"), F.struct("cy", "token_no"), order, counts, min_hot)
    assert out.columns == [*df.columns, "above", "below"]
    got = {(r.image_id, r.token_no): (r.above and r.above.token_no, r.below and r.below.token_no) for r in out.collect()}
    want = {}
    for i, no, cy, _ in rows:
        of = [(c or 0.0, m) for j, m, c, a in rows if j == i and a and (c is None) == (cy is None)]
        here = (cy or 0.0, no)
        up, down = max([x for x in of if x <= here], default=None), min([x for x in of if x >= here], default=None)
        want[i, no] = (up and up[1], down and down[1])
    assert got == want


def test_neighbours_take_one_shuffle_and_one_sort(spark):
    df = spark.createDataFrame([token("i", n, "₹1" if n % 7 == 0 else "x", 0, 97 * n, 50, 97 * n + 20) for n in range(60)], TOKEN_SCHEMA)
    out = tokens.neighbours(df, F.col("text") == "₹1", F.struct("cy", "token_no"), [F.col("cy"), F.col("token_no")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hashpartitioning"), plan.count("Sort ["), plan.count("Join")) == (1, 1, 0)


def test_nearest_amount_plan_and_odd_orders(spark, tmp_path):
    """Order lines are neither written nor read thrice; a long order and lines without a key give what SQL gives."""
    at = "timestamp '2026-03-04 00:00:00'"
    lines_of = [(1, 1, 10.5), (1, 2, 7.25), (1, 3, 3.0), (None, 1, 5.0), (None, 2, 6.0), (3, 1, 0.0), *((9, n, 1.0 * n) for n in range(1, 40))]
    con = connect(str(tmp_path))
    con.execute("create table l (k bigint, n integer, p double)")
    con.executemany("insert into l values (?, ?, ?)", lines_of)
    con.execute(f"""copy (select k as l_orderkey, n as l_linenumber, p as l_extendedprice, n::bigint as l_partkey, 3::bigint as l_suppkey,
                    {at} as l_shipdate from l) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.execute(f"""copy (select distinct k as o_orderkey, 20.4::double as o_totalprice, 5::bigint as o_custkey, {at} as o_orderdate
                    from l where k is not null) to '{tmp_path}/orders.parquet' (format parquet)""")
    found = catalog.queries()["join_nearest_amount"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("Exchange hashpartitioning")) == (2, 2)
    assert compare(found, connect(str(tmp_path)), catalog.oracle_sql()["join_nearest_amount"]) is None


def test_tokens_at_once_are_the_tokens(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.tokens_at_once.dtypes == t.tokens.dtypes
    assert t.tokens.exceptAll(t.tokens_at_once).isEmpty() and t.tokens_at_once.exceptAll(t.tokens).isEmpty()
    most = t.tokens_most.groupBy("image_id").agg(F.sum("n").alias("most"))
    held = t.tokens.groupBy("image_id").agg(F.count("*").alias("n"))
    assert held.join(most, "image_id", "left").where("most is null or most < n").isEmpty()


def test_hot_buckets(spark):
    counts = spark.createDataFrame([(f"k{i}", 3) for i in range(50)] + [("big", 30), ("big", 30)], "k string, n int")
    many = skew.in_hot_buckets(counts, ["k"], 40)
    found = {r.k for r in counts.where(many).collect()}
    assert "big" in found and len(found) < 10
    assert skew.in_hot_buckets(counts, ["k"], 1000) is None


@pytest.mark.parametrize("lenient,kind", [(False, None), (True, "date")])
def test_lenient_months(spark, lenient, kind):
    assert spark.range(1).select(rules.date_kind(F.lit("12 Maruti"), lenient).alias("k")).first().k == kind


def test_regions_take_one_shuffle_and_keep_columns(spark):
    """Pieces that reach over Arrow batches are numbered as one; rows are not joined back."""
    rows = [("a", i, 0.0 + i // 3 * 50, 10.0 * (i % 3), 30.0 + i // 3 * 50, 10.0 * (i % 3) + 9.0, f"t{i}") for i in range(12)]
    rows += [("b", i, 0.5 * i, 0.0, 40.0 + 0.5 * i, 10.0, f"u{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "image_id string, token_no long, min_x double, min_y double, max_x double, max_y double, text string")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        found = regions.clusters(df)
        got = {(r.image_id, r.token_no): (r.text, r.row_no, r.column_no, r.group_no) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == 21 and all(got[k][0] == ("t" if k[0] == "a" else "u") + str(k[1]) for k in got)
    assert len({v[1:] for k, v in got.items() if k[0] == "a"}) == 12
    assert {v[1:] for k, v in got.items() if k[0] == "b"} == {(1, 1, 0)}
    assert regions.clusters(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
