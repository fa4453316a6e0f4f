"""Reporting periods, resolved on the driver so that bounds reach the scan as literals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

KINDS = (
    "today",
    "this_week",
    "this_month",
    "last_month",
    "last_3_months",
    "this_year",
    "custom",
)

# The word for the previous period in comparison texts.
PREVIOUS_WORD = {
    "today": "yesterday",
    "this_week": "last week",
    "this_month": "last month",
    "last_month": "previous month",
    "last_3_months": "previous 3 months",
    "this_year": "last year",
    "custom": "previous period",
}

_MILLI = timedelta(milliseconds=1)
_DAY = timedelta(days=1)
_MONTH_NAMES = [
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
]
_DAY_NAMES = [
    "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun",
]


def midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def end_of_day(moment: datetime) -> datetime:
    """Last millisecond of the day."""
    return midnight(moment) + _DAY - _MILLI


def month_start(moment: datetime, shift: int = 0) -> datetime:
    months = moment.year * 12 + moment.month - 1 + shift
    return datetime(months // 12, months % 12 + 1, 1)


def month_end(moment: datetime, shift: int = 0) -> datetime:
    return month_start(moment, shift + 1) - _MILLI


@dataclass(frozen=True)
class Bucket:
    pos: int
    label: str
    start: datetime
    end: datetime


@dataclass(frozen=True)
class Period:
    """A closed interval ``[start, end]`` of one of the known kinds."""

    kind: str
    start: datetime
    end: datetime

    @staticmethod
    def resolve(
        kind: str,
        as_of: datetime,
        custom_start: datetime | None = None,
        custom_end: datetime | None = None,
    ) -> Period:
        if kind == "today":
            bounds = midnight(as_of), end_of_day(as_of)
        elif kind == "this_week":
            monday = midnight(as_of) - as_of.weekday() * _DAY
            bounds = monday, end_of_day(monday + 6 * _DAY)
        elif kind == "this_month":
            bounds = month_start(as_of), month_end(as_of)
        elif kind == "last_month":
            bounds = month_start(as_of, -1), month_end(as_of, -1)
        elif kind == "last_3_months":
            bounds = month_start(as_of, -2), month_end(as_of)
        elif kind == "this_year":
            bounds = datetime(as_of.year, 1, 1), datetime(as_of.year + 1, 1, 1) - _MILLI
        elif kind == "custom":
            bounds = custom_start or month_start(as_of), custom_end or end_of_day(as_of)
        else:
            raise ValueError(f"unknown period kind: {kind}")
        return Period(kind, *bounds)

    def previous(self) -> Period:
        """The period of the same kind right before this one."""
        if self.kind == "today":
            bounds = midnight(self.start) - _DAY, midnight(self.start) - _MILLI
        elif self.kind == "this_week":
            bounds = self.start - 7 * _DAY, self.end - 7 * _DAY
        elif self.kind in ("this_month", "last_month"):
            bounds = month_start(self.start, -1), month_end(self.start, -1)
        elif self.kind == "last_3_months":
            bounds = month_start(self.start, -3), month_end(self.start, -1)
        elif self.kind == "this_year":
            bounds = datetime(self.start.year - 1, 1, 1), datetime(self.start.year, 1, 1) - _MILLI
        else:
            end = self.start - _MILLI
            bounds = end - (self.end - self.start), end
        return Period(self.kind, *bounds)

    @property
    def previous_word(self) -> str:
        return PREVIOUS_WORD[self.kind]

    @property
    def span_days(self) -> int:
        """Whole days between the bounds, truncated."""
        return (self.end - self.start) // _DAY

    def elapsed_days(self, as_of: datetime) -> int:
        """Days of the period seen at ``as_of``; the whole period when it lies outside."""
        if self.start <= as_of <= self.end:
            return max(1, (as_of - self.start) // _DAY + 1)
        return max(1, self.span_days + 1)

    def buckets(self) -> list[Bucket]:
        """Chart buckets of the period, in order."""
        day0 = midnight(self.start)
        if self.kind == "today":
            step = timedelta(hours=4)
            cuts = [(f"{4 * i:02d}:00", day0 + i * step, day0 + (i + 1) * step - _MILLI) for i in range(6)]
        elif self.kind == "this_week":
            cuts = [(_DAY_NAMES[i], day0 + i * _DAY, end_of_day(day0 + i * _DAY)) for i in range(7)]
        elif self.kind in ("this_month", "last_month"):
            last = self.end.day
            first_of = month_start(self.start)
            cuts = [
                (f"W{i + 1} ({a}-{b})", first_of + (a - 1) * _DAY, end_of_day(first_of + (b - 1) * _DAY))
                for i, (a, b) in enumerate([(1, 7), (8, 14), (15, 21), (22, last)])
            ]
        elif self.kind in ("last_3_months", "this_year"):
            count = 3 if self.kind == "last_3_months" else 12
            first_of = month_start(self.start) if count == 3 else datetime(self.start.year, 1, 1)
            cuts = [
                (_MONTH_NAMES[month_start(first_of, i).month - 1], month_start(first_of, i), month_end(first_of, i))
                for i in range(count)
            ]
        else:
            cuts = self._custom_cuts()
        return [Bucket(i, *cut) for i, cut in enumerate(cuts)]

    def _custom_cuts(self) -> list[tuple[str, datetime, datetime]]:
        days = self.span_days + 1
        if days <= 10:
            starts = [midnight(self.start + i * _DAY) for i in range(days)]
            return [(self._day_label(s), s, end_of_day(s)) for s in starts]
        # Four parts that keep the period's own time of day and stop one second short of the next.
        width = -(-days // 4) * _DAY
        starts = [self.start + i * width for i in range(4)]
        return [(self._day_label(s), s, min(s + width - timedelta(seconds=1), self.end)) for s in starts]

    @staticmethod
    def _day_label(moment: datetime) -> str:
        return f"{moment.day} {_MONTH_NAMES[moment.month - 1]}"
