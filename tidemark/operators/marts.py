"""Marts: growth/churn per export, tidy distributions and the read-side
helpers over them (top-N, counts, headline, long form, running totals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.operators.silver import UNKNOWN_LABEL


def _count_if(cond) -> F.Column:
    return F.count(F.when(cond, F.lit(1))).cast("int")


def _count_if_sql(cond: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS INT)"


def pct_sql(part: str, whole: str, digits: int = 2) -> str:
    """SQL text of :func:`pct` over column names (or SQL text)."""
    p, w = sx.ref(part), sx.ref(whole)
    return f"round(100.0D * {p} / CASE WHEN {w} != 0 THEN {w} END, {digits})"


def pct(part, whole, digits: int = 2) -> F.Column:
    """round(100·part/whole, digits) in double arithmetic; null when whole is 0."""
    whole = F.col(whole) if isinstance(whole, str) else whole
    part = F.col(part) if isinstance(part, str) else part
    return F.round(F.lit(100.0) * part / F.when(whole != 0, whole), digits)


def network_stats(fact_flow: DataFrame, silver: DataFrame) -> DataFrame:
    """One row per export: size, new, lost, net, employers, email coverage and
    Silver-level coverage counts.

    ONE partial aggregation keyed by the export, over the union of the fact
    rows and the Silver rows (each branch fills its own metrics). Losses are
    counted where they are visible — on the previous export's rows, as "not
    present at the next export" — and moved to the export they belong to with
    a lag over the aggregated table (one row per export). Exports without
    identified rows have no fact rows and no stats row, as in the reference.
    """
    facts = fact_flow.selectExpr(
        "snapshot_ts", "TRUE AS _is_fact", "snapshot_date_key", "snapshot_sequence",
        "previous_snapshot_ts", "company_key", "company_label", "has_email",
        "is_new_since_previous_snapshot", "is_lost_at_next",
        "CAST(NULL AS BOOLEAN) AS is_identifiable",
        "CAST(NULL AS STRING) AS company", "CAST(NULL AS STRING) AS `position`",
    )
    rows = silver.selectExpr(
        "snapshot_ts", "FALSE AS _is_fact", "CAST(NULL AS INT) AS snapshot_date_key",
        "CAST(NULL AS INT) AS snapshot_sequence", "CAST(NULL AS TIMESTAMP) AS previous_snapshot_ts",
        "CAST(NULL AS STRING) AS company_key", "CAST(NULL AS STRING) AS company_label",
        "CAST(NULL AS BOOLEAN) AS has_email",
        "CAST(NULL AS BOOLEAN) AS is_new_since_previous_snapshot",
        "CAST(NULL AS BOOLEAN) AS is_lost_at_next",
        "is_identifiable", "company", "`position`",
    )
    per = facts.unionByName(rows).groupBy("snapshot_ts").agg(*[F.expr(e) for e in (
        "min(snapshot_date_key) AS snapshot_date_key",
        "min(snapshot_sequence) AS snapshot_sequence",
        "min(previous_snapshot_ts) AS previous_snapshot_ts",
        f"{_count_if_sql('_is_fact')} AS total_connections",
        f"CAST(count(DISTINCT CASE WHEN _is_fact AND company_label != {sx.lit(UNKNOWN_LABEL)} "
        "THEN company_key END) AS INT) AS distinct_companies",
        f"{_count_if_sql('_is_fact AND has_email')} AS connections_with_email",
        f"{_count_if_sql('_is_fact AND is_new_since_previous_snapshot')} AS new_connections",
        f"{_count_if_sql('_is_fact AND is_lost_at_next')} AS _lost_at_next",
        f"{_count_if_sql('NOT _is_fact AND NOT is_identifiable')} AS restricted_profile_rows",
        f"{_count_if_sql('NOT _is_fact AND company IS NULL')} AS connections_without_company",
        f"{_count_if_sql('NOT _is_fact AND `position` IS NULL')} AS connections_without_position",
    )]).where("total_connections > 0")
    lost = "CAST(coalesce(lag(_lost_at_next) OVER (ORDER BY snapshot_ts), 0) AS INT)"
    return per.selectExpr("*", f"{lost} AS lost_connections").selectExpr(
        "snapshot_ts", "snapshot_date_key", "snapshot_sequence", "previous_snapshot_ts",
        "total_connections", "new_connections", "lost_connections",
        "CAST(new_connections - lost_connections AS INT) AS net_change",
        "distinct_companies", "connections_with_email",
        f"{pct_sql('connections_with_email', 'total_connections')} AS email_coverage_pct",
        "restricted_profile_rows", "connections_without_company", "connections_without_position",
    )


# --- distributions ------------------------------------------------------------
COMPANY, POSITION, YEAR_MONTH = "company", "position", "connected_year_month"


def company_labels(fact: DataFrame) -> DataFrame:
    """Display spelling per (export, employer key): the variant most rows carry,
    alphabetical on ties — two partial aggregations, no window."""
    by_label = fact.groupBy("snapshot_ts", "company_key", "company_label").agg(
        F.count(F.lit(1)).alias("_n")
    )
    vote = F.struct((-F.col("_n")).alias("n"), F.col("company_label").alias("l"))
    return by_label.groupBy("snapshot_ts", "company_key").agg(
        F.min_by("company_label", vote).alias("company_label"),
        F.sum("_n").alias("connection_count"),
    )


def _by_union(fact: DataFrame) -> DataFrame:
    """Three aggregations over the fact, one per dimension, unioned."""
    companies = company_labels(fact).select(
        "snapshot_ts", F.lit(COMPANY).alias("dimension_type"),
        F.col("company_label").alias("dimension_value"), "connection_count",
    )
    positions = fact.groupBy(
        "snapshot_ts", F.coalesce("position", F.lit(UNKNOWN_LABEL)).alias("dimension_value")
    ).agg(F.count(F.lit(1)).alias("connection_count")).select(
        "snapshot_ts", F.lit(POSITION).alias("dimension_type"), "dimension_value",
        "connection_count",
    )
    months = fact.groupBy(
        "snapshot_ts", F.date_format("connected_on", "yyyy-MM").alias("dimension_value")
    ).agg(F.count(F.lit(1)).alias("connection_count")).select(
        "snapshot_ts", F.lit(YEAR_MONTH).alias("dimension_type"), "dimension_value",
        "connection_count",
    )
    return companies.unionByName(positions).unionByName(months)


def _by_grouping_sets(fact: DataFrame) -> DataFrame:
    """All three dimensions in ONE aggregation pass (GROUPING SETS): the fact
    is read and shuffled once; only the small company-label table gets a
    second (label election) aggregation."""
    base = fact.selectExpr(
        "snapshot_ts", "company_key", "company_label",
        f"coalesce(`position`, {sx.lit(UNKNOWN_LABEL)}) AS pos",
        "date_format(connected_on, 'yyyy-MM') AS ym",
    )
    keys = ["snapshot_ts", "company_key", "company_label", "pos", "ym"]
    sets = [["snapshot_ts", "company_key", "company_label"], ["snapshot_ts", "pos"],
            ["snapshot_ts", "ym"]]
    g = base.groupingSets(sets, *keys).agg(F.expr("count(1) AS _n"), F.expr("grouping_id() AS _gid"))
    # grouping_id bits follow ``keys``; a set bit means "not grouped by"
    gid = {COMPANY: 0b00011, POSITION: 0b01101, YEAR_MONTH: 0b01110}
    companies = g.where(f"_gid = {gid[COMPANY]}").groupBy("snapshot_ts", "company_key").agg(
        F.expr("min_by(company_label, named_struct('n', -_n, 'l', company_label)) AS dimension_value"),
        F.expr("sum(_n) AS connection_count"),
    ).selectExpr("snapshot_ts", f"{sx.lit(COMPANY)} AS dimension_type", "dimension_value",
                 "connection_count")
    positions = g.where(f"_gid = {gid[POSITION]}").selectExpr(
        "snapshot_ts", f"{sx.lit(POSITION)} AS dimension_type", "pos AS dimension_value",
        "_n AS connection_count")
    months = g.where(f"_gid = {gid[YEAR_MONTH]}").selectExpr(
        "snapshot_ts", f"{sx.lit(YEAR_MONTH)} AS dimension_type", "ym AS dimension_value",
        "_n AS connection_count")
    return companies.unionByName(positions).unionByName(months)


def breakdown(fact: DataFrame, method: str = "grouping_sets") -> DataFrame:
    """Tidy (export, dimension, value) counts with rank and share of the export.

    ``method='union'`` aggregates each dimension separately; ``'grouping_sets'``
    does all of them in one pass.
    """
    return with_rank_and_share(_by_union(fact) if method == "union" else _by_grouping_sets(fact))


#: Characters of a value that split the values of one count into windows.
RANK_PREFIX = 3


def with_rank_and_share(counts: DataFrame) -> DataFrame:
    """Rank (count descending, value ascending, null last) and share of every
    value in its (export, dimension), without one window over all its values.

    A value's rank is the number of values of higher counts, plus those of its
    count with a smaller prefix, plus its place among those of its count and
    prefix. The first two come from aggregated tables: the histogram of counts
    (n distinct counts need n²/2 connections, so it stays short) and one row
    per (count, prefix). Joins are null-safe on the prefix of a null value.
    """
    group = "snapshot_ts, dimension_type"
    rows = counts.selectExpr("*", f"substring(dimension_value, 1, {RANK_PREFIX}) AS _prefix")
    sizes = rows.groupBy("snapshot_ts", "dimension_type", "connection_count", "_prefix").agg(
        F.expr("count(1) AS _n"))
    above = sizes.groupBy("snapshot_ts", "dimension_type", "connection_count").agg(F.expr("sum(_n) AS _k")).selectExpr(
        "snapshot_ts AS a_ts", "dimension_type AS a_type", "connection_count AS a_count",
        f"coalesce(sum(_k) OVER (PARTITION BY {group} ORDER BY connection_count DESC "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _above",
        f"sum(_k * connection_count) OVER (PARTITION BY {group}) AS _total")
    before = sizes.selectExpr(
        "snapshot_ts AS b_ts", "dimension_type AS b_type", "connection_count AS b_count", "_prefix AS b_prefix",
        f"coalesce(sum(_n) OVER (PARTITION BY {group}, connection_count ORDER BY _prefix ASC NULLS LAST "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    place = (f"row_number() OVER (PARTITION BY {group}, connection_count, _prefix "
             "ORDER BY dimension_value ASC NULLS LAST)")
    return (
        rows.selectExpr("*", f"{place} AS _place")
        .join(above, F.expr("snapshot_ts = a_ts AND dimension_type = a_type AND connection_count = a_count"))
        .join(before, F.expr("snapshot_ts = b_ts AND dimension_type = b_type AND connection_count = b_count "
                             "AND _prefix <=> b_prefix"))
        .selectExpr("snapshot_ts", "dimension_type", "dimension_value", "connection_count",
                    "CAST(_above + _before + _place AS BIGINT) AS rank_within_dimension",
                    f"{pct_sql('connection_count', '_total')} AS share_pct")
    )


def breakdown_at(silver: DataFrame, at: Column) -> DataFrame:
    """The breakdown of one export: its identified rows are selected before
    anything is counted, so nothing of the other exports is read or ranked."""
    return breakdown(silver.where("is_identifiable").where(F.col("snapshot_ts") == at))


def top_values(latest: DataFrame, dimension: str, n: int = 15) -> DataFrame:
    """Top-N values of one dimension of the newest export's breakdown, unknown excluded."""
    found = latest.filter((F.col("dimension_type") == dimension) & (F.col("dimension_value") != UNKNOWN_LABEL))
    return found.orderBy("rank_within_dimension").limit(n).select(
        "dimension_value", "connection_count", "share_pct"
    )


def value_counts(latest: DataFrame) -> DataFrame:
    """Distinct values per dimension of the newest export's breakdown, unknown excluded."""
    return latest.filter(F.col("dimension_value") != UNKNOWN_LABEL).groupBy("dimension_type").agg(
        F.count(F.lit(1)).alias("distinct_values"))


def undisclosed(latest: DataFrame) -> DataFrame:
    """Size of each dimension's ``(unknown)`` bucket in the newest export's breakdown."""
    return latest.filter(F.col("dimension_value") == UNKNOWN_LABEL).select(
        "dimension_type", "connection_count"
    )


def connected_over_time(latest: DataFrame) -> DataFrame:
    """Connections by month of the newest export, numbered in time order (one row per month)."""
    return latest.filter(F.col("dimension_type") == YEAR_MONTH).select(
        F.col("dimension_value").alias("year_month"), "connection_count").withColumn(
        "month_number", F.expr("row_number() over (order by year_month asc nulls last)")
    ).orderBy("month_number")


def cumulative(monthly: DataFrame) -> DataFrame:
    """Running total over months (input: one row per month — a tiny table)."""
    w = Window.orderBy(F.asc_nulls_last("year_month")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return monthly.select(
        "year_month", "connection_count",
        F.sum("connection_count").over(w).alias("cumulative_connections"),
    )


def headline(stats: DataFrame) -> DataFrame:
    """The newest export's row plus the number of exports, in one aggregate."""
    cols = ("snapshot_ts", "total_connections", "net_change", "distinct_companies",
            "new_connections", "lost_connections", "restricted_profile_rows")
    latest = F.max_by(F.struct(*cols), "snapshot_ts")
    out = stats.agg(latest.alias("_l"), F.count(F.lit(1)).alias("snapshots_ingested"))
    return out.select(
        *[F.col(f"_l.{c}").alias(c) for c in cols if c != "net_change"],
        F.when(F.col("snapshots_ingested") > 1, F.col("_l.net_change")).alias("delta_since_previous"),
        "snapshots_ingested",
    )


def churn_long(stats: DataFrame) -> DataFrame:
    """Joined and left per export in long form, losses negated."""
    wide = stats.select(
        "snapshot_ts",
        F.col("new_connections").cast("int").alias("Joined"),
        (-F.col("lost_connections")).cast("int").alias("Left"),
    )
    return wide.unpivot("snapshot_ts", ["Joined", "Left"], "change_type", "connections")
