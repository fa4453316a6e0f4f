"""Screens to staged candidates: dates, shape, fallback to lines, duplicates."""

from datetime import datetime, timedelta

from passbook.operators import screenshots
from passbook.operators.tokens import W_NO_DATE, fill_dates
from passbook.schema import CANDIDATE, LEDGER
from pyspark.sql import functions as F

AS_OF = datetime(2026, 9, 30, 12)
TOKENS = (
    "image_id string, token_no long, text string, text_normalized string, confidence double, score double, "
    "min_x double, min_y double, max_x double, max_y double, cx double, cy double, width double, height double"
)


def token(image, no, text, x, y, w=150.0, h=30.0):
    return (image, no, text, text, 0.9, 0.9, x, y, x + w, y + h, x + w / 2, y + h / 2, 900.0, 1600.0)


def screen(image, rows, first=300.0):
    out = []
    for n, (name, amount, date) in enumerate(rows):
        y = first + 90 * n
        out += [token(image, 10 * n + k, text, x, y + dy) for k, (text, x, dy) in enumerate(((name, 50.0, 0), (amount, 700.0, 0), (date, 50.0, 36))) if text]
    return out


def test_text_dates(spark):
    texts = {
        "3August": datetime(2026, 8, 3),
        "1 September 2026": datetime(2026, 9, 1),
        " 04 Sept ": datetime(2026, 9, 4),
        "7 December": datetime(2025, 12, 7),
        "2 days ago": datetime(2026, 9, 28),
        "2026-08-09": datetime(2026, 8, 9),
        "20260809": datetime(2026, 8, 9),
        "2026-08-09T10:30:00": datetime(2026, 8, 9, 10, 30),
        "2 September 2026 at 2:35 pm": datetime(2026, 9, 2, 14, 35),
        "soon": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.d for r in df.select("t", screenshots.text_date(F.col("t"), AS_OF).alias("d")).collect()}
    assert found == texts


def test_candidates_of_screens(spark):
    """Missing dates come from the rows around; screens without rows are reported."""
    df = spark.createDataFrame(
        screen("a", [("Hemant Store", "₹20", None), ("Blinkit", "₹415", "1August"), ("Zomato", "₹99", None), ("Uber", "₹120", "3August"), ("Ola", "₹70", None)])
        + screen("b", [("Metro", "₹10", None)])
        + [token("none", 1, "Nothing here", 50.0, 300.0)],
        TOKENS,
    )
    rows = screenshots.materialise(screenshots.screen_candidates(df, AS_OF), "rows")
    assert rows.columns == CANDIDATE.fieldNames()
    found = {(r.source_reference, r.title): r for r in rows.collect()}
    august = lambda d: datetime(2026, 8, d)
    assert {k: v.date for k, v in found.items()} == {
        ("a", "Hemant Store"): august(1), ("a", "Blinkit"): august(1), ("a", "Zomato"): august(1), ("a", "Uber"): august(3), ("a", "Ola"): august(3),
        ("b", "Metro"): AS_OF,
    }
    assert found["a", "Zomato"].warnings == [] and found["a", "Zomato"].note is None
    assert found["b", "Metro"].warnings == [W_NO_DATE] and found["b", "Metro"].note == W_NO_DATE
    uber = found["a", "Uber"]
    assert (uber.amount, uber.type, uber.category_id, uber.source, uber.id) == (12000, "expense", "transport", "screenshot", "tx_local_a_62")
    report = {r.image_id: (r.rows, r.successful, r.error) for r in screenshots.screen_report(df, rows).collect()}
    assert report == {"a": (5, True, None), "b": (1, True, None), "none": (0, False, screenshots.NOTHING_FOUND)}


def test_staging_against_ledger_batch_and_inbox(spark):
    df = spark.createDataFrame(
        screen("a", [("Blinkit", "₹415", "1 August"), ("Uber", "₹120", "3 August")]) + screen("b", [("Uber", "₹120", None), ("Ola", "₹70", "3 August")]), TOKENS
    )
    screens = spark.createDataFrame([("a", "batch", 0), ("b", "batch", 1)], "image_id string, batch_id string, screen_no int")
    ledger = spark.createDataFrame(
        [("l", "expense", 41500, "INR", "x", " BLINKIT ", None, datetime(2026, 8, 1, 9), None, "manual", AS_OF, AS_OF)], LEDGER
    )
    waiting = spark.createDataFrame([(datetime(2026, 8, 3), 7000, "ola", None, "expense")], "date timestamp_ntz, amount long, title string, merchant string, type string")
    staged = screenshots.stage_screens(df, ledger, AS_OF, pending=waiting, screens=screens)
    found = {(r.source_reference, r.title): (r.batch_id, r.duplicate_source) for r in staged.collect()}
    assert found == {
        ("a", "Blinkit"): ("batch", "existingDb"), ("a", "Uber"): ("batch", None), ("b", "Uber"): ("batch", "intraBatch"), ("b", "Ola"): ("batch", "intraBatch"),
    }


def test_dates_are_carried_over_the_edges_of_stripes(spark):
    """A tall image equals the plain rule, row by row."""
    days = [None if n % 7 else AS_OF + timedelta(days=n) for n in range(400)]
    days[:30] = [None] * 30
    rows = [("tall", n, float(n * 40), d, [W_NO_DATE] if d is None else []) for n, d in enumerate(days)]
    df = spark.createDataFrame(rows, "image_id string, pos long, cy double, date timestamp_ntz, warnings array<string>")
    found = {r.pos: r.date for r in fill_dates(df, AS_OF).collect()}
    last, want = None, {}
    for n, d in enumerate(days):
        last = d or last
        want[n] = last or next(x for x in days[n:] if x)
    assert found == want
