"""Gold dimensions: employer, calendar, and the enriched current-entity view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions.dates import date_key_sql
from tidemark.operators.silver import UNKNOWN_LABEL


def dim_company(silver: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per employer key: latest spelling, first/last seen, counts.

    The latest-spelling election (newest export first, then alphabetical) is a
    ``min_by`` inside the same aggregate, so the whole dimension is one
    partial aggregation plus a left join with the current counts — the
    ``(unknown)`` bucket, typically the biggest key, is pre-aggregated per
    map task instead of landing whole in one window partition.
    """
    s = silver.where("is_identifiable")
    agg = s.groupBy("company_key").agg(*[F.expr(e) for e in (
        "min_by(company_label, named_struct('t', -unix_micros(snapshot_ts), 'l', company_label))"
        " AS company_name",
        "min(company_normalised) AS company_normalised",
        "min(snapshot_ts) AS first_seen_snapshot_ts",
        "max(snapshot_ts) AS last_seen_snapshot_ts",
        "min(connected_on) AS first_connected_on",
        "max(connected_on) AS last_connected_on",
        "count(DISTINCT connection_id) AS connections_ever",
    )])
    return _with_current_count(agg, dim)


def company_links(silver: DataFrame) -> DataFrame:
    """One row per (employer, entity) of identified rows: first and last time,
    spelling at the last time (alphabetical on ties), date bounds. Links of
    several sets of exports merge (:func:`merge_links`)."""
    return silver.where("is_identifiable").groupBy("company_key", "connection_id").agg(*[F.expr(e) for e in (
        "min_by(company_label, named_struct('t', -unix_micros(snapshot_ts), 'l', company_label)) AS last_label",
        "min(company_normalised) AS company_normalised",
        "min(snapshot_ts) AS first_seen_ts", "max(snapshot_ts) AS last_seen_ts",
        "min(connected_on) AS first_connected_on", "max(connected_on) AS last_connected_on")])


def merge_links(links: DataFrame) -> DataFrame:
    """Stacked links as one row per (employer, entity); merging a set twice
    changes nothing."""
    return links.groupBy("company_key", "connection_id").agg(*[F.expr(e) for e in (
        "min_by(last_label, named_struct('t', -unix_micros(last_seen_ts), 'l', last_label)) AS last_label",
        "min(company_normalised) AS company_normalised",
        "min(first_seen_ts) AS first_seen_ts", "max(last_seen_ts) AS last_seen_ts",
        "min(first_connected_on) AS first_connected_on", "max(last_connected_on) AS last_connected_on")])


def company_of_links(links: DataFrame, dim: DataFrame) -> DataFrame:
    """:func:`dim_company` from merged links instead of all of Silver."""
    agg = links.groupBy("company_key").agg(*[F.expr(e) for e in (
        "min_by(last_label, named_struct('t', -unix_micros(last_seen_ts), 'l', last_label)) AS company_name",
        "min(company_normalised) AS company_normalised",
        "min(first_seen_ts) AS first_seen_snapshot_ts", "max(last_seen_ts) AS last_seen_snapshot_ts",
        "min(first_connected_on) AS first_connected_on", "max(last_connected_on) AS last_connected_on",
        "count(1) AS connections_ever")])
    return _with_current_count(agg, dim)


def _with_current_count(companies: DataFrame, dim: DataFrame) -> DataFrame:
    cur = (
        dim.where("valid_to IS NULL")
        .groupBy("company_key")
        .agg(F.expr("count(1) AS current_connection_count"))
    )
    return companies.join(cur, "company_key", "left").selectExpr(
        "company_key", "company_name", "company_normalised",
        f"company_name = {sx.lit(UNKNOWN_LABEL)} AS is_unknown_company",
        "first_seen_snapshot_ts", "last_seen_snapshot_ts", "first_connected_on",
        "last_connected_on", "connections_ever",
        "coalesce(current_connection_count, 0) AS current_connection_count",
    )


def dim_date(silver: DataFrame, today: dt.date | str) -> DataFrame:
    """Calendar days from the oldest event date to the newest export, inclusive.

    The spine is at most one row per calendar day, so generating it from a
    single bounds row is bounded by the date range, not by the data.
    """
    t = f"CAST({sx.lit(str(today))} AS DATE)"
    bounds = silver.agg(
        F.expr(f"coalesce(min(connected_on), {t}) AS start_date"),
        F.expr(f"greatest(coalesce(max(connected_on), {t}), coalesce(max(snapshot_date), {t})) AS end_date"),
    )
    days = bounds.selectExpr("explode(sequence(start_date, end_date, INTERVAL 1 DAY)) AS date_day")
    iso_dow = "CAST(weekday(date_day) + 1 AS INT)"
    return days.selectExpr(
        f"{date_key_sql('date_day')} AS date_key",
        "date_day",
        "year(date_day) AS calendar_year",
        "quarter(date_day) AS calendar_quarter",
        "month(date_day) AS calendar_month",
        "date_format(date_day, 'MMMM') AS month_name",
        "date_format(date_day, 'yyyy-MM') AS year_month",
        "dayofmonth(date_day) AS day_of_month",
        f"{iso_dow} AS iso_day_of_week",
        "date_format(date_day, 'EEEE') AS day_name",
        "weekofyear(date_day) AS iso_week",
        "trunc(date_day, 'month') AS month_start_date",
        "last_day(date_day) AS month_end_date",
        f"{iso_dow} >= 6 AS is_weekend",
    )


def current_entities(dim: DataFrame, company: DataFrame, entity: str = "connection_id") -> DataFrame:
    """Open versions enriched with the employer dimension and a moved flag.

    The version count is a window over the entity (at most one row per
    export), so no separate aggregate + join is needed.
    """
    e = sx.ref(entity)
    versions = dim.withColumn("_versions", F.expr(f"count(1) OVER (PARTITION BY {e})"))
    cur = versions.where("valid_to IS NULL")
    comp = company.selectExpr(
        "company_key", "company_name", "current_connection_count AS company_connection_count")
    return cur.join(comp, "company_key", "left").selectExpr(
        e, "full_name", "first_name", "last_name", "email_address", "company",
        "company_key", "company_name", "company_connection_count", "`position`",
        "connected_on", "valid_from",
        "_versions > 1 AS has_previous_version",
        "valid_to IS NULL AS is_current",
    )
