"""Silver: clean, deduplicate and type raw export rows (one row per entity per
export, plus every unidentifiable row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions.dates import date_key_sql, parse_export_date_sql
from tidemark.functions.keys import surrogate_key_sql
from tidemark.functions.text import nullif_blank_sql, normalise_company_sql, trim_ws_sql

#: Fixed value: label given to a missing employer.
UNKNOWN_LABEL = "(unknown)"

SILVER_COLUMNS = (
    "connection_id", "first_name", "last_name", "full_name", "email_address", "company",
    "company_label", "company_normalised", "company_key", "position", "position_normalised",
    "connected_on", "connected_on_raw", "connected_on_date_key", "snapshot_ts", "snapshot_date",
    "snapshot_date_key", "file_hash", "source_object", "source_row_number", "ingested_at",
    "is_identifiable", "has_email",
)
_CLEAN_COLUMNS = (
    "connection_id", "first_name", "last_name", "email_address", "company", "position",
    "connected_on", "connected_on_raw", "snapshot_ts", "file_hash", "source_object",
    "source_row_number", "ingested_at",
)


def clean(bronze: DataFrame) -> DataFrame:
    """Trim every text column to null-if-blank and parse the export date."""
    return bronze.selectExpr(
        f"{nullif_blank_sql('url')} AS connection_id",
        *[f"{nullif_blank_sql(c)} AS `{c}`"
          for c in ("first_name", "last_name", "email_address", "company", "position")],
        f"{parse_export_date_sql('connected_on')} AS connected_on",
        f"{nullif_blank_sql('connected_on')} AS connected_on_raw",
        "CAST(snapshot_ts AS TIMESTAMP) AS snapshot_ts",
        "file_hash",
        "source_object",
        "CAST(source_row_number AS BIGINT) AS source_row_number",
        "CAST(ingested_at AS TIMESTAMP) AS ingested_at",
    )


def dedup(cleaned: DataFrame) -> DataFrame:
    """Keep the first row (by source row number) of each (export, entity).

    ``row_number() = 1`` plans as a group limit on both sides of the shuffle:
    an entity copied millions of times in one export leaves each map task once.
    Rows without an identity must all be kept; instead of sharing one null
    key (one hot task) each gets its own salted key — its file and row
    position — so they spread over every reducer and pass through as groups
    of one. No union, so the upstream scan runs once.
    """
    key = ("coalesce(concat('i:', connection_id), concat('n:', coalesce(file_hash, ''), ':', "
           "CAST(source_row_number AS STRING)))")
    place = f"row_number() OVER (PARTITION BY snapshot_ts, {key} ORDER BY source_row_number, source_object)"
    return cleaned.selectExpr("*", f"{place} AS _place").where("_place = 1").select(*_CLEAN_COLUMNS)


def export_times(cleaned: DataFrame) -> DataFrame:
    """(snapshot_ts) of the exports with an identified row: the same list as
    from deduplicated rows, without the dedup."""
    return cleaned.where("connection_id IS NOT NULL").select("snapshot_ts")


def derive(deduped: DataFrame) -> DataFrame:
    """Names, employer label/key, date keys and flags."""
    label = f"coalesce(company, {sx.lit(UNKNOWN_LABEL)})"
    full = trim_ws_sql("concat_ws(' ', first_name, last_name)")
    normalised = normalise_company_sql(label)
    return deduped.selectExpr(
        "connection_id", "first_name", "last_name",
        f"CASE WHEN {full} != '' THEN {full} END AS full_name",
        "email_address", "company",
        f"{label} AS company_label",
        f"{normalised} AS company_normalised",
        f"{surrogate_key_sql(normalised)} AS company_key",
        "`position`",
        "lower(`position`) AS position_normalised",
        "connected_on", "connected_on_raw",
        f"{date_key_sql('connected_on')} AS connected_on_date_key",
        "snapshot_ts",
        "CAST(snapshot_ts AS DATE) AS snapshot_date",
        f"{date_key_sql('snapshot_ts')} AS snapshot_date_key",
        "file_hash", "source_object", "source_row_number", "ingested_at",
        "connection_id IS NOT NULL AS is_identifiable",
        "email_address IS NOT NULL AS has_email",
    )


def build_silver(bronze: DataFrame) -> DataFrame:
    return derive(dedup(clean(bronze)))


def identifiable(silver: DataFrame) -> DataFrame:
    return silver.filter(F.col("is_identifiable"))
