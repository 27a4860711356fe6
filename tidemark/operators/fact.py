"""Gold fact: one row per identified entity per export, with flow flags.

Self-joins of the reference model (first appearance, presence at the previous
export, presence at the next one) are rewritten as ONE window pass over the
entity: Silver makes (entity, export) unique, so an entity's rows are at most
one per export and the window groups are bounded by the number of exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions.keys import surrogate_key_sql

FACT_COLUMNS = (
    "connection_snapshot_key", "connection_id", "snapshot_ts", "snapshot_date",
    "snapshot_date_key", "snapshot_sequence", "previous_snapshot_ts", "company_key",
    "company_label", "position", "connected_on", "connected_on_date_key", "has_email",
    "file_hash", "is_first_appearance", "is_new_since_previous_snapshot",
    "days_connected_at_snapshot",
)


def snapshot_sequence(rows: DataFrame, ts_col: str = "snapshot_ts") -> DataFrame:
    """Distinct exports numbered in time order, with the previous and next one.

    The global window is safe: its input is one row per export.
    """
    ts = sx.ref(ts_col)
    w = f"OVER (ORDER BY {ts})"
    return rows.select(ts_col).distinct().selectExpr(
        ts,
        f"CAST(row_number() {w} AS INT) AS snapshot_sequence",
        f"lag({ts}) {w} AS previous_snapshot_ts",
        f"lead({ts}) {w} AS next_snapshot_ts",
    )


def fact_with_flow(silver: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Fact rows plus ``next_snapshot_ts`` / ``is_lost_at_next`` for churn.

    ``times`` may give the exports' timestamps from a cheaper source than
    Silver (``silver.export_times``)."""
    s = silver.where("is_identifiable").select(
        "connection_id", "company_key", "company_label", "position", "connected_on",
        "connected_on_date_key", "snapshot_ts", "snapshot_date", "snapshot_date_key",
        "has_email", "file_hash",
    )
    seq = snapshot_sequence(s if times is None else times)
    w = "OVER (PARTITION BY connection_id ORDER BY snapshot_ts)"
    return s.join(seq, "snapshot_ts").selectExpr(
        f"{surrogate_key_sql('connection_id', 'snapshot_ts')} AS connection_snapshot_key",
        "connection_id", "snapshot_ts", "snapshot_date", "snapshot_date_key",
        "snapshot_sequence", "previous_snapshot_ts", "company_key", "company_label",
        "`position`", "connected_on", "connected_on_date_key", "has_email", "file_hash",
        f"lag(snapshot_ts) {w} IS NULL AS is_first_appearance",
        "previous_snapshot_ts IS NOT NULL AND NOT coalesce("
        f"lag(snapshot_ts) {w} = previous_snapshot_ts, FALSE) AS is_new_since_previous_snapshot",
        "CAST(datediff(snapshot_date, connected_on) AS INT) AS days_connected_at_snapshot",
        "next_snapshot_ts",
        "next_snapshot_ts IS NOT NULL AND NOT coalesce("
        f"lead(snapshot_ts) {w} = next_snapshot_ts, FALSE) AS is_lost_at_next",
    )


def build_fact(silver: DataFrame, times: DataFrame | None = None) -> DataFrame:
    return fact_with_flow(silver, times).select(*FACT_COLUMNS)


def first_appearance(silver: DataFrame) -> DataFrame:
    """First export each entity appeared in (partial aggregation, skew-safe)."""
    return (
        silver.filter(F.col("is_identifiable"))
        .groupBy("connection_id")
        .agg(F.min("snapshot_ts").alias("first_seen_snapshot_ts"))
    )


def lost_entities(fact_flow: DataFrame) -> DataFrame:
    """Entities present in the previous export and absent from this one."""
    return fact_flow.filter("is_lost_at_next").select(
        F.col("next_snapshot_ts").alias("snapshot_ts"),
        "connection_id",
        F.col("snapshot_ts").alias("last_seen_snapshot_ts"),
    )
