"""Filters, accent-blind search, ranking views and CSV export of a shortlist."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.render import DASH, display_url, format_day, format_tags
from tidemark.functions.text import contains_folded


def filter_tags(df: DataFrame, tags: list[str], include_untagged: bool = True,
                col: str = "tags") -> DataFrame:
    t = F.col(col)
    untagged = F.coalesce(F.size(t), F.lit(0)) == 0
    if tags:
        sel = F.array(*[F.lit(x) for x in tags])
        return df.filter(F.coalesce(F.arrays_overlap(t, sel), F.lit(False))
                         | (untagged & F.lit(include_untagged)))
    return df if include_untagged else df.filter(~untagged)


def search_people(df: DataFrame, needle: str) -> DataFrame:
    """Literal accent-blind substring over 'full name + space + position'."""
    if not needle.strip():
        return df
    return df.filter(contains_folded("concat(coalesce(full_name, ''), ' ', coalesce(position, ''))", needle))


def search_company(df: DataFrame, needle: str, col: str = "company") -> DataFrame:
    if not needle.strip():
        return df
    return df.filter(contains_folded(col, needle))


def date_range(df: DataFrame, lo: dt.date | str | None = None, hi: dt.date | str | None = None,
               col: str = "connected_on") -> DataFrame:
    """Inclusive range; bounds default to the data's own min/max (scalar
    subqueries); rows with no date drop out either way."""
    c = F.col(col)
    lo_c = F.lit(str(lo)).cast("date") if lo else df.agg(F.min(c)).scalar()
    hi_c = F.lit(str(hi)).cast("date") if hi else df.agg(F.max(c)).scalar()
    return df.filter(c.between(lo_c, hi_c))


def shortlist(scored: DataFrame) -> DataFrame:
    """Display projection of a ranked table (dash for missing values)."""
    return scored.select(
        F.col("full_name").alias("name"),
        F.coalesce("company", F.lit(DASH)).alias("company"),
        F.coalesce("position", F.lit(DASH)).alias("position"),
        format_tags("tags").alias("tags"),
        format_day("connected_on").alias("connected"),
        "score",
        F.col("score_reason").alias("why"),
        display_url("connection_id").alias("profile"),
    )


def export_csv(view: DataFrame, path: str) -> None:
    """Write a shortlist as CSV with a header (tags already flattened)."""
    view.write.mode("overwrite").option("header", True).csv(path)
