"""Period keys and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_friday(d) -> Column:
    """Friday on or after the day."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def quarter_end(d) -> Column:
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


_PERIODS = {
    "D": lambda d: F.to_date(d),
    "W": week_friday,
    "W-FRI": week_friday,
    "M": lambda d: F.last_day(d),
    "ME": lambda d: F.last_day(d),
    "Q": quarter_end,
    "Y": lambda d: F.date_sub(F.add_months(F.trunc(d, "year"), 12), 1),
}

PERIODS_PER_YEAR = {"D": 252, "W": 52, "W-FRI": 52, "M": 12, "ME": 12, "Q": 4, "Y": 1}


def period_key(d, freq: str) -> Column:
    """Last day of the period ``freq`` that holds the day."""
    try:
        return _PERIODS[freq](F.col(d) if isinstance(d, str) else d)
    except KeyError:
        raise ValueError(f"unknown frequency {freq!r}; known: {sorted(_PERIODS)}") from None


def visible_from(period_end, lag_days: int = 45) -> Column:
    """First day on which a statement for the period may be used."""
    return F.date_add(period_end, lag_days)


def season_flags(d, prefix: str = "m") -> list[Column]:
    """Twelve 0/1 month-of-year columns."""
    return [(F.month(d) == k).cast("int").alias(f"{prefix}{k:02d}") for k in range(1, 13)]
