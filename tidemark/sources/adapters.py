"""Adapters: build Bronze-shaped snapshot exports from the driver tables.

The driver tables hold no contact network, so a deterministic projection of
``events`` (one export per day, one entity per user) and of ``orders`` (one
export per quarter, one entity per customer) stands in for the export files.
Both adapters are pure projections plus one numbering pass, so their cost
grows linearly with the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import sqltext as sx
from tidemark.functions.keys import build_object_key_sql
from tidemark.operators.rownum import row_number_in_groups

# ---------------------------------------------------------------------------
# Fixed values shared with the SQL oracle: employer and job-title
# vocabularies (spelling variants, blanks, the unknown label and diacritics
# included on purpose), the landing prefix and the day origin.
# ---------------------------------------------------------------------------
COMPANIES: tuple[str | None, ...] = (
    "Acme Bank", "acme  bank", "Globex", "Initech", "Umbrella", "Ngân hàng TMCP Ví Dụ",
    "Stark", "Contoso", "", "(unknown)", None,
)
TITLES: tuple[str | None, ...] = (
    "Data Engineer", "Head of Data", "Technical Recruiter",
    "Senior Analytics Engineer, Tech Lead", "Business Intelligence Analyst",
    "Backend Developer", "Engineering Manager", "Sales Director", "Graphic Designer",
    "Junior Data Analyst", "Chief Data Officer", "Founder & CEO", "Data Scientist",
    "Network Engineer", "Talent Acquisition Partner", "", None,
)
LANDING_PREFIX = "raw/connections"
#: The adapter's profile URLs (the data-quality URL check takes the pattern).
ADAPTER_URL_REGEX = r"^https://example\.com/in/[^\s]+$"
DAY_ORIGIN = "2024-01-01"
CONNECTED_ORIGIN = "2020-01-01"
# --- end of fixed values -----------------------------------------------------

BRONZE_TEXT_COLUMNS = (
    "first_name", "last_name", "url", "email_address", "company", "position", "connected_on",
)


def _pick(values: tuple[str | None, ...], index: str) -> str:
    """SQL text: the ``index``-th (0-based) entry of a fixed vocabulary."""
    return f"element_at({sx.str_array(values)}, CAST(({index}) + 1 AS INT))"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bronze_meta(df: DataFrame) -> DataFrame:
    file_hash = "md5(CAST(snapshot_ts AS STRING))"
    return df.selectExpr(
        *BRONZE_TEXT_COLUMNS, "snapshot_ts",
        f"{file_hash} AS file_hash",
        f"{build_object_key_sql(LANDING_PREFIX, 'snapshot_ts', file_hash)} AS source_object",
        "source_row_number",
        "snapshot_ts + INTERVAL 1 HOUR AS ingested_at",
    )


def raw_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped daily exports from ``events``: entity = user, export = day."""
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    day = f"datediff(CAST(CAST(ts AS TIMESTAMP) AS DATE), DATE {sx.lit(DAY_ORIGIN)})"
    uid = "CAST(user_id AS STRING)"
    connected = (f"date_format(date_add(DATE {sx.lit(CONNECTED_ORIGIN)}, CAST(user_id % 1000 AS INT)), "
                 "'dd MMM yyyy')")
    rows = ev.selectExpr(
        "event_id",
        "date_trunc('day', CAST(ts AS TIMESTAMP)) AS snapshot_ts",
        f"concat('U', {uid}) AS first_name",
        "concat('N', CAST(user_id % 7 AS STRING)) AS last_name",
        f"CASE WHEN event_id % 20 = 0 THEN '' ELSE concat('https://example.com/in/u-', {uid}) END AS url",
        f"CASE WHEN user_id % 4 = 0 THEN concat('u', {uid}, '@example.com') ELSE '' END AS email_address",
        f"{_pick(COMPANIES, f'(user_id * 7 + floor({day} / 5)) % 11')} AS company",
        f"{_pick(TITLES, f'(user_id + floor({day} / 10)) % 17')} AS position",
        f"CASE WHEN user_id % 50 = 7 THEN 'n/a' ELSE {connected} END AS connected_on",
    )
    numbered = row_number_in_groups(rows, ["snapshot_ts"], "event_id", "source_row_number")
    return _bronze_meta(numbered)


def raw_snap_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped quarterly exports from ``orders``: entity = customer."""
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    ck = "CAST(o_custkey AS STRING)"
    rows = o.selectExpr(
        "o_orderkey",
        "date_trunc('quarter', CAST(o_orderdate AS TIMESTAMP)) AS snapshot_ts",
        f"concat('C', {ck}) AS first_name",
        "'Customer' AS last_name",
        f"concat('https://example.com/c/', {ck}) AS url",
        "'' AS email_address",
        "o_orderpriority AS company",
        "o_orderstatus AS position",
        "date_format(o_orderdate, 'dd MMM yyyy') AS connected_on",
    )
    numbered = row_number_in_groups(rows, ["snapshot_ts"], "o_orderkey", "source_row_number")
    return _bronze_meta(numbered)
