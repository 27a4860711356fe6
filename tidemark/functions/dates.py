"""Date expressions: tolerant parsing, integer keys, month arithmetic, decay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions.text import col_, trim_ws, trim_ws_sql

#: Fixed value: the export's date format ("04 Feb 2025").
EXPORT_DATE_PATTERN = "d MMM yyyy"
#: Fixed value: days per month used by the month arithmetic of the scorer.
DAYS_PER_MONTH = 30.44


def parse_export_date_sql(c: str) -> str:
    return f"try_to_date({trim_ws_sql(c)}, {sx.lit(EXPORT_DATE_PATTERN)})"


def parse_export_date(c: str | Column) -> Column:
    """'4 Feb 2025' / '04 feb 2025' → date; anything else → null (never raises)."""
    if isinstance(c, str):
        return F.expr(parse_export_date_sql(c))
    return F.try_to_date(trim_ws(c), EXPORT_DATE_PATTERN)


def date_key_sql(c: str) -> str:
    return f"CAST(date_format(CAST({sx.ref(c)} AS DATE), 'yyyyMMdd') AS INT)"


def date_key(c: str | Column) -> Column:
    """Integer YYYYMMDD key of a date or timestamp (null stays null)."""
    if isinstance(c, str):
        return F.expr(date_key_sql(c))
    return F.date_format(c.cast("date"), "yyyyMMdd").cast("int")


def as_date_lit(day: dt.date | str) -> Column:
    return F.lit(str(day)).cast("date")


def months_since_sql(c: str, today: dt.date | str) -> str:
    start = f"unix_micros(CAST({sx.ref(c)} AS TIMESTAMP))"
    end = f"unix_micros(CAST(CAST({sx.lit(str(today))} AS DATE) AS TIMESTAMP))"
    return f"(floor(({end} - {start}) / 86400000000) / {sx.lit(DAYS_PER_MONTH)})"


def warmth_sql(months: str, points: int, tau_months: float) -> str:
    value = f"bround({sx.lit(float(points))} * exp((-({months})) / {sx.lit(float(tau_months))}), 0)"
    return f"CASE WHEN ({months}) IS NOT NULL AND ({months}) >= 0 THEN CAST({value} AS INT) END"


def months_since(c: str | Column, today: dt.date | str) -> Column:
    """Whole days from a moment to midnight of ``today``, divided by 30.44.

    Days are floored (a time later than midnight today counts as -1 day), as
    the scorer's timestamp difference does.
    """
    start = F.unix_micros(col_(c).cast("timestamp"))
    end = F.unix_micros(as_date_lit(today).cast("timestamp"))
    days = F.floor((end - start) / F.lit(86_400_000_000))
    return days / F.lit(DAYS_PER_MONTH)


def warmth(months: Column, points: int, tau_months: float) -> Column:
    """``round(points·e^(−m/τ))`` with half-even rounding; null for unknown or future."""
    value = F.bround(F.lit(float(points)) * F.exp(-months / F.lit(float(tau_months))), 0)
    return F.when(months.isNotNull() & (months >= 0), value.cast("int"))


def as_naive_utc(c: str | Column, source_tz: str | None = None) -> Column:
    """A timestamp as naive UTC wall time (the session runs in UTC).

    ``source_tz`` names the zone of a naive input; aware inputs (TIMESTAMP)
    are already instants and only need the UTC session zone.
    """
    x = col_(c).cast("timestamp")
    return F.to_utc_timestamp(x, source_tz) if source_tz else x
