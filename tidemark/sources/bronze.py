"""Bronze table and ingest ledger: append-only rows of every ingested export.

Rows are Parquet under ``batch_id=…/snapshot_date=…``; a batch overwrites its
own folder only. The ledger has one row per file that was ever looked at (key,
size, time, full hash, status) and is written after the batch's rows: readers
see the rows of batches that the ledger has. The newest export's time comes from
the ledger (one row per file), and its rows from the folders of its date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import at_parts

BRONZE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "first_name", "last_name", "url", "email_address", "company", "position", "connected_on")]
    + [
        T.StructField("snapshot_ts", T.TimestampType(), False),
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("source_object", T.StringType(), False),
        T.StructField("source_row_number", T.LongType(), False),
        T.StructField("ingested_at", T.TimestampType(), False),
    ]
)
BRONZE_COLUMNS = tuple(f.name for f in BRONZE_SCHEMA.fields)


LEDGER_SCHEMA = ("key string, snapshot_ts timestamp, size_bytes long, last_modified timestamp, file_hash string, "
                 "status string, rows_ingested long, header_line_index int, encoding string, message string, "
                 "batch_id string")


def ledger_path(path: str) -> str:
    return path.rstrip("/") + "_ledger"


def read_table_or_empty(spark: SparkSession, schema, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as err:  # noqa: BLE001 - missing path
        if "PATH_NOT_FOUND" in str(err) or "does not exist" in str(err):
            return spark.createDataFrame([], schema)
        raise


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_table_or_empty(spark, LEDGER_SCHEMA, ledger_path(path))


def read_bronze(spark: SparkSession, path: str, with_batch: bool = False, at: Column | None = None) -> DataFrame:
    """The rows of committed batches, or an empty frame when none exists yet.
    ``at`` selects rows below the join with the batches, by any column and by
    ``snapshot_date``, of which only the folders that fit are opened."""
    stored = T.StructType([*BRONZE_SCHEMA.fields, T.StructField("batch_id", T.StringType()),
                           T.StructField("snapshot_date", T.DateType())])
    committed = read_ledger(spark, path).select("batch_id").distinct()
    rows = read_table_or_empty(spark, stored, path)
    rows = (rows if at is None else rows.where(at)).join(committed, "batch_id", "left_semi")
    return rows.select(*BRONZE_COLUMNS, *(["batch_id"] if with_batch else []))


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest ingested export: its time is a scalar subquery over the
    ledger, and the scan is limited to the folders of its date at run time. No
    export: no rows."""
    newest = read_ledger(spark, path).where("status = 'ingested'").agg(F.max("snapshot_ts")).scalar()
    return read_bronze(spark, path, at=(F.col("snapshot_date") == F.to_date(newest)) & (F.col("snapshot_ts") == newest))


def read_exports(spark: SparkSession, path: str, parts: list[str], with_batch: bool = False) -> DataFrame:
    """Rows of the exports of ``parts`` (names by ``tables.part_of``): only the
    folders of their dates are opened."""
    days = sorted({f"DATE '{p[:4]}-{p[4:6]}-{p[6:8]}'" for p in parts})
    at = F.expr(f"snapshot_date IN ({', '.join(days)})") & at_parts(parts) if days else F.lit(False)
    return read_bronze(spark, path, with_batch, at)


def latest_snapshot(bronze: DataFrame, snapshot_ts=None) -> DataFrame:
    """Rows of one export: the given one, or the newest (scalar subquery)."""
    if snapshot_ts is not None:
        return bronze.filter(F.col("snapshot_ts") == F.lit(snapshot_ts).cast("timestamp"))
    return bronze.filter(F.col("snapshot_ts") == bronze.agg(F.max("snapshot_ts")).scalar())


def ingestion_log(bronze: DataFrame) -> DataFrame:
    """One row per ingested export: rows and load time, numbered newest first
    (the window runs over one row per export)."""
    return (
        bronze.groupBy("snapshot_ts", "file_hash", "source_object")
        .agg(F.count(F.lit(1)).alias("row_count"), F.max("ingested_at").alias("ingested_at"))
        .withColumn("log_order", F.expr("row_number() over (order by snapshot_ts desc, source_object)"))
        .orderBy(F.desc("snapshot_ts"))
    )


def append_bronze(rows: DataFrame, path: str, batch_id: str) -> None:
    """Write the rows of one batch into its own folder, by snapshot date."""
    (rows.select(*BRONZE_COLUMNS).withColumn("snapshot_date", F.to_date("snapshot_ts")).write.mode("overwrite")
     .partitionBy("snapshot_date").parquet(f"{path}/batch_id={batch_id}"))


def append_ledger(files: DataFrame, path: str, batch_id: str) -> None:
    files.write.mode("overwrite").parquet(f"{ledger_path(path)}/batch_id={batch_id}")
