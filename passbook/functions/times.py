"""Wall-clock literals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def at(moment: datetime) -> Column:
    """A literal without a zone, whatever the zone of the session; it folds before planning."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
