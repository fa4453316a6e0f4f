"""History filters and sort orders: a specification folded into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from passbook.functions.categories import category_name
from passbook.functions.times import at
from passbook.plans.period import Period, end_of_day, midnight

# Amount presets as (min, max, min closed, max closed) in minor units.
AMOUNT_PRESETS = {
    "all": (None, None, True, True),
    "under_500": (None, 50_000, True, False),
    "500_1000": (50_000, 100_000, True, True),
    "1000_5000": (100_000, 500_000, True, True),
    "above_5000": (500_000, None, False, True),
}
DATE_PRESETS = ("all", "today", "yesterday", "this_week", "this_month", "last_month", "custom")
SORT_MODES = ("newest", "oldest", "highest", "lowest", "a_to_z", "z_to_a")


def in_period(period: Period, column: str = "date") -> Column:
    return F.col(column).between(at(period.start), at(period.end))


def text_matches(query: str) -> Column:
    """Lower-case substring over title, merchant, note, category name and category id."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    fields = [
        F.col("title"),
        F.col("merchant"),
        F.col("note"),
        category_name(F.col("type"), F.col("category_id")),
        F.col("category_id"),
    ]
    hits = [F.coalesce(F.lower(f).contains(needle), F.lit(False)) for f in fields]
    return reduce(lambda a, b: a | b, hits)


def title_or_merchant_matches(query: str, kind: str | None = None) -> Column:
    """Case-insensitive substring on title or merchant, with an optional type."""
    safe = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.col("title").ilike(f"%{safe}%") | F.col("merchant").ilike(f"%{safe}%")
    return found if kind is None else found & (F.col("type") == kind)


def amount_in(preset: str, low: int | None = None, high: int | None = None) -> Column:
    if preset == "custom":
        bounds = (low, high, True, True)
    else:
        bounds = AMOUNT_PRESETS[preset]
    low, high, low_closed, high_closed = bounds
    amount, tests = F.col("amount"), []
    if low is not None:
        tests.append(amount >= low if low_closed else amount > low)
    if high is not None:
        tests.append(amount <= high if high_closed else amount < high)
    return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True)


def date_in(
    preset: str, as_of: datetime, start: datetime | None = None, end: datetime | None = None
) -> Column:
    """Bounds are worked out here, so the scan sees two literals."""
    if preset == "all":
        return F.lit(True)
    if preset == "custom":
        tests = []
        if start is not None:
            tests.append(F.col("date") >= at(midnight(start)))
        if end is not None:
            tests.append(F.col("date") <= at(end_of_day(end)))
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    if preset == "yesterday":
        return in_period(Period.resolve("today", as_of - timedelta(days=1)))
    return in_period(Period.resolve(preset, as_of))


@dataclass(frozen=True)
class FilterSpec:
    """Everything a history view can be narrowed by; all parts are joined by AND."""

    query: str = ""
    type: str | None = None
    category_id: str | None = None
    source: str | None = None
    amount_preset: str = "all"
    min_amount: int | None = None
    max_amount: int | None = None
    date_preset: str = "all"
    start: datetime | None = None
    end: datetime | None = None
    sort: str = "newest"

    def condition(self, as_of: datetime) -> Column:
        tests = [
            date_in(self.date_preset, as_of, self.start, self.end),
            amount_in(self.amount_preset, self.min_amount, self.max_amount),
        ]
        if self.type is not None:
            tests.append(F.col("type") == self.type)
        if self.category_id:
            tests.append(F.lower("category_id") == self.category_id.lower())
        if self.source is not None:
            tests.append(F.col("source") == self.source)
        tests.append(text_matches(self.query))
        return reduce(lambda a, b: a & b, tests)


def apply_filter(df: DataFrame, spec: FilterSpec, as_of: datetime) -> DataFrame:
    return df.where(spec.condition(as_of))


def sort_columns(mode: str) -> list[Column]:
    """Sort keys of a mode; every order ends in ``id`` so that results repeat."""
    keys = {
        "newest": [F.desc("date"), F.desc("created_at")],
        "oldest": [F.asc("date"), F.asc("created_at")],
        "highest": [F.desc("amount")],
        "lowest": [F.asc("amount")],
        "a_to_z": [F.lower("title").asc()],
        "z_to_a": [F.lower("title").desc()],
    }
    return keys[mode] + [F.asc("id")]


def sorted_history(df: DataFrame, mode: str = "newest") -> DataFrame:
    return df.orderBy(*sort_columns(mode))
