"""Versioned Parquet tables: write a new version, then move a pointer.

Readers resolve ``<root>/<name>/_CURRENT`` to a version directory, so a
rebuild never overwrites the files it is reading (the SCD2 apply reads the
old history and writes the new one) and a failed run leaves the previous
version current. ``_CURRENT`` holds one empty marker file per version, created
through the Hadoop FileSystem API, so it works on any Hadoop-compatible shared
storage.

A table of rows per export may be kept in parts, one folder per export: a new
version names the folders it consists of (``<name>_parts``, one row per export),
so a run writes the parts that change and keeps the others as they are.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART_FORMAT = "yyyyMMdd'T'HHmmss.SSSSSS"
#: Name of the part that a row belongs to; names sort like the times.
PART_SQL = f'date_format(snapshot_ts, "{_PART_FORMAT}")'
PARTS_SCHEMA = "part string, folder string, schema string"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def current_version(spark: SparkSession, root: str, name: str) -> str | None:
    """The version named by the newest marker under ``_CURRENT``."""
    fs, p, _ = _fs(spark, f"{root}/{name}/_CURRENT")
    if not fs.exists(p):
        return None
    marks = sorted(f.getPath().getName() for f in fs.listStatus(p))
    return marks[-1].split("@", 1)[1] if marks else None


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    return current_version(spark, root, name) is not None


def part_of(ts: dt.datetime) -> str:
    """The part of a timestamp collected from Spark (local time of the driver)."""
    return ts.astimezone(dt.UTC).strftime("%Y%m%dT%H%M%S.%f")


def at_parts(parts: Iterable[str]) -> Column:
    """Rows of the parts: constant timestamps, which reach the Parquet scan."""
    stamps = ", ".join(f"to_timestamp('{p}', \"{_PART_FORMAT}\")" for p in parts)
    return F.expr(f"snapshot_ts IN ({stamps})") if stamps else F.lit(False)


def times_of(spark: SparkSession, parts: Iterable[str]) -> DataFrame:
    """(snapshot_ts) of the parts."""
    return spark.createDataFrame([(p,) for p in parts], "part string").selectExpr(
        f'to_timestamp(part, "{_PART_FORMAT}") AS snapshot_ts')


def _manifest(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    v = current_version(spark, root, f"{name}_parts")
    return None if v is None else spark.read.schema(PARTS_SCHEMA).parquet(f"{root}/{name}_parts/{v}")


def read_table(spark: SparkSession, root: str, name: str, parts: Iterable[str] | None = None) -> DataFrame | None:
    """The current version, or None. Of a table in parts, ``parts`` names those
    to read (all if None); the folders of the others are not opened."""
    manifest = _manifest(spark, root, name)
    if manifest is None:
        v = current_version(spark, root, name)
        return None if v is None else spark.read.parquet(f"{root}/{name}/{v}")
    rows = manifest.collect()  # one row per export, and one with the schema
    schema = T.StructType.fromJson(json.loads(next(r.schema for r in rows if r.part is None)))
    wanted = None if parts is None else set(parts)
    folders = sorted(r.folder for r in rows if r.part is not None and (wanted is None or r.part in wanted))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _make_current(spark: SparkSession, root: str, name: str, version: str) -> None:
    # one empty marker per version, created whole: a reader sees the old newest
    # marker or the new one, never half a pointer
    fs, p, jvm = _fs(spark, f"{root}/{name}/_CURRENT")
    n = len(fs.listStatus(p)) if fs.exists(p) else 0
    fs.create(jvm.org.apache.hadoop.fs.Path(p, f"{n:09d}@{version}"), False).close()


def write_table(df: DataFrame, root: str, name: str, version: str) -> DataFrame:
    """Write ``df`` as a new version and make it current; returns the new table."""
    spark = df.sparkSession
    path = f"{root}/{name}/{version}"
    df.write.mode("overwrite").parquet(path)
    _make_current(spark, root, name, version)
    return spark.read.parquet(path)


def write_parts(df: DataFrame, root: str, name: str, version: str,
                replace: Iterable[str] | None = None) -> DataFrame:
    """Write the rows of ``df`` (with ``snapshot_ts``) as parts of a new version;
    returns the whole table. The parts in ``replace`` are those that ``df`` holds
    now, with or without rows; all other parts of the version before stay. With
    None the new version is ``df`` alone. Rows are rebalanced by part before the
    write, so an export has few files and a large one is split over tasks."""
    spark = df.sparkSession
    path = f"{root}/{name}/{version}"
    stored = T.StructType([*df.schema.fields, T.StructField("part", T.StringType())])
    (df.withColumn("part", F.expr(PART_SQL)).hint("rebalance", "part")
     .write.mode("overwrite").partitionBy("part").parquet(path))
    written = spark.read.schema(stored).parquet(path).select("part").distinct()
    rows = [(r.part, f"{path}/part={r.part}", None) for r in written.collect()]
    before = None if replace is None else _manifest(spark, root, name)
    if before is not None:
        gone = set(replace)
        rows += [tuple(r) for r in before.where("part IS NOT NULL").collect() if r.part not in gone]
    rows.append((None, None, df.schema.json()))
    write_table(spark.createDataFrame(rows, PARTS_SCHEMA).coalesce(1), root, f"{name}_parts", version)
    _make_current(spark, root, name, version)
    return read_table(spark, root, name)


def warehouse_status(spark: SparkSession, root: str,
                     layers=("bronze", "silver", "dim_connection", "mart_network_stats")) -> DataFrame:
    """Which layers exist (and their current version): metadata only."""
    fs, _, jvm = _fs(spark, root)
    rows = []
    for name in layers:
        if name == "bronze":
            exists = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/bronze"))
            rows.append((name, bool(exists), None))
        else:
            v = current_version(spark, root, name)
            rows.append((name, v is not None, v))
    return spark.createDataFrame(rows, "layer string, present boolean, version string")


def safe_sql(spark: SparkSession, sql: str, args: dict | None = None,
             requires: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """Parameterised read (named ``:param`` markers, never string formatting);
    when a required relation does not exist yet, an empty frame with
    ``schema`` instead of an error — the dashboard reads before the first run."""
    missing = [t for t in requires if not spark.catalog.tableExists(t)]
    if missing:
        if schema is None:
            raise ValueError(f"missing relation(s) {missing} and no empty schema given")
        return spark.createDataFrame([], schema)
    return spark.sql(sql, args=args or {})
