"""Display renderings as column expressions (dash for missing values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col_, trim_ws

#: Fixed value: the placeholder shown for a missing value.
DASH = "—"
ARROW = " → "


def dash(c: str | Column) -> Column:
    """Trimmed text, or a dash for null/blank."""
    t = trim_ws(col_(c).cast("string"))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(DASH)).otherwise(t)


def change_text(previous: str | Column, current: str | Column) -> Column:
    """'old → new' when the value moved, the value alone when it did not."""
    p, c = dash(previous), dash(current)
    return F.when(p == c, c).otherwise(F.concat(p, F.lit(ARROW), c))


def format_ts(c: str | Column) -> Column:
    return F.coalesce(F.date_format(col_(c), "yyyy-MM-dd HH:mm"), F.lit(DASH))


def format_day(c: str | Column) -> Column:
    return F.coalesce(F.date_format(col_(c), "yyyy-MM-dd"), F.lit(DASH))


def format_duration(seconds: str | Column) -> Column:
    """'1m 04s' / '9s' / dash."""
    s = F.floor(col_(seconds).cast("double")).cast("long")
    m, r = F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60))
    return (
        F.when(s.isNull(), F.lit(DASH))
        .when(m > 0, F.format_string("%dm %02ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def display_url(c: str | Column) -> Column:
    """Percent-decode for display; '+' is kept literally and bad escapes leave
    the value unchanged; blank gives ''."""
    x = col_(c)
    decoded = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(decoded, x))


def format_tags(tags: str | Column) -> Column:
    t = col_(tags)
    return F.when(F.coalesce(F.size(t), F.lit(0)) > 0, F.concat_ws(", ", t)).otherwise(F.lit(DASH))
