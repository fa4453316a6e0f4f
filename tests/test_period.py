"""Period resolution: all kinds and the period before each; no Spark needed."""

from datetime import datetime, timedelta

import pytest

from passbook.plans.period import Period

AS_OF = datetime(2026, 9, 16, 14, 30)
MS = timedelta(milliseconds=1)


@pytest.mark.parametrize(
    "kind,start,end,prev_start,prev_end",
    [
        ("today", datetime(2026, 9, 16), datetime(2026, 9, 17) - MS, datetime(2026, 9, 15), datetime(2026, 9, 16) - MS),
        ("this_week", datetime(2026, 9, 14), datetime(2026, 9, 21) - MS, datetime(2026, 9, 7), datetime(2026, 9, 14) - MS),
        ("this_month", datetime(2026, 9, 1), datetime(2026, 10, 1) - MS, datetime(2026, 8, 1), datetime(2026, 9, 1) - MS),
        ("last_month", datetime(2026, 8, 1), datetime(2026, 9, 1) - MS, datetime(2026, 7, 1), datetime(2026, 8, 1) - MS),
        ("last_3_months", datetime(2026, 7, 1), datetime(2026, 10, 1) - MS, datetime(2026, 4, 1), datetime(2026, 7, 1) - MS),
        ("this_year", datetime(2026, 1, 1), datetime(2027, 1, 1) - MS, datetime(2025, 1, 1), datetime(2026, 1, 1) - MS),
    ],
)
def test_kinds(kind, start, end, prev_start, prev_end):
    p = Period.resolve(kind, AS_OF)
    assert (p.start, p.end) == (start, end)
    assert (p.previous().start, p.previous().end) == (prev_start, prev_end)


def test_custom_previous_has_equal_length_and_ends_a_millisecond_before():
    p = Period.resolve("custom", AS_OF, datetime(2026, 9, 3, 6), datetime(2026, 9, 10, 18))
    q = p.previous()
    assert q.end == p.start - MS and q.end - q.start == p.end - p.start


def test_january_goes_back_over_the_year():
    p = Period.resolve("last_month", datetime(2026, 1, 5))
    assert p.start == datetime(2025, 12, 1) and p.previous().start == datetime(2025, 11, 1)


def test_bucket_counts():
    counts = {k: len(Period.resolve(k, AS_OF).buckets()) for k in ("today", "this_week", "this_month", "last_3_months", "this_year")}
    assert counts == {"today": 6, "this_week": 7, "this_month": 4, "last_3_months": 3, "this_year": 12}
    long = Period.resolve("custom", AS_OF, datetime(2026, 9, 1, 6), datetime(2026, 9, 20))
    assert len(long.buckets()) == 4 and long.buckets()[0].end == datetime(2026, 9, 6, 5, 59, 59)
    assert [b.label for b in Period.resolve("this_month", AS_OF).buckets()][-1] == "W4 (22-30)"


def test_elapsed_days():
    p = Period.resolve("this_month", AS_OF)
    assert p.elapsed_days(datetime(2026, 9, 15, 12)) == 15
    assert p.elapsed_days(datetime(2026, 11, 1)) == 30
