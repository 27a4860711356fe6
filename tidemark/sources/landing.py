"""Landing zone: export files named ``<prefix>/<YYYYMMDDTHHMMSSZ>_<hash8>.csv``.

Batch ingest = list (metadata only) → leave out files that the ledger has with
the same key, size and time → examine the others on the executors (full MD5,
encoding, header, rows or error) → decide by the full MD5 against the ledger →
stream the rows of new files into Bronze → record every file in the ledger.
Nothing is decided by the short hash in the key: it is only checked against
the bytes. A batch writes its own Bronze folder and then its ledger rows; rows
of a batch without ledger rows are not visible, so a batch that died and is run
again neither loses nor repeats anything. The same step runs inside a
Structured Streaming ``foreachBatch`` (``tidemark.streaming.ingest``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import KEY_TS_FORMAT, key_hash8, key_is_valid, key_snapshot_ts
from tidemark.session import checkpoint_dir
from tidemark.sources import bronze as bz
from tidemark.sources.exports import KNOWN_COLUMNS, ROW_COLUMNS, examine, read_rows, sniff, spread

# The note lines an export starts with.
NOTE_LINES = ("Notes:", '"Rendered from warehouse tables; some email addresses are blank."', "")

STATUS_INGESTED, STATUS_DUPLICATE = "ingested", "skipped_duplicate"
STATUS_REJECTED, STATUS_HASH_MISMATCH = "rejected", "hash_mismatch"
META_COLUMNS = ("path", "key", "snapshot_ts", "hash8", "size_bytes", "last_modified", "is_valid")


# --- producing export files (fixtures / re-exports) ----------------------------------------
def render_exports(rows: DataFrame) -> DataFrame:
    """Bronze-shaped rows → (export_id, line_no, line) text lines of export files.

    One export, and one file, per snapshot: notes, a blank line, the header
    and RFC-4180 CSV rows in source-row order.
    """
    export_id = F.date_format("snapshot_ts", KEY_TS_FORMAT)
    line = F.to_csv(F.struct(*[F.col(c) for c in ROW_COLUMNS]),
                    {"escape": '"', "quote": '"', "nullValue": "", "emptyValue": ""})
    body = rows.select(export_id.alias("export_id"),
                       F.col("source_row_number").cast("long").alias("line_no"), line.alias("line"))
    heads = body.select("export_id").distinct()
    header_lines = [(-(len(NOTE_LINES) + 1) + i, t) for i, t in enumerate(NOTE_LINES)]
    header_lines.append((0, ",".join(KNOWN_COLUMNS)))
    head = heads.select(
        "export_id",
        F.inline(F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(t).alias("line"))
                           for n, t in header_lines])),
    )
    return head.unionByName(body)


def write_exports(rows: DataFrame, staging_dir: str) -> None:
    """Write one text file per export under ``staging_dir/export_id=…/``; the
    lines of a file are sorted on disk where they do not fit into memory."""
    (render_exports(rows).repartition("export_id").sortWithinPartitions("export_id", "line_no")
     .select("export_id", "line").write.mode("overwrite").partitionBy("export_id")
     .text(staging_dir))


def _move_to_keys(target: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(quote(target, safe="/:@"))
        for batch in batches:
            keys, hashes = [], []
            for path, prefix in zip(batch["path"], batch["prefix"], strict=True):
                _, source = fs.FileSystem.from_uri(quote(path, safe="/:@"))
                with files.open_input_stream(source) as stream:
                    file_hash, _ = sniff(stream)
                key = f"{prefix}_{file_hash[:8]}.csv"
                place = f"{root}/{key}"
                if files.get_file_info(place).type != fs.FileType.NotFound:
                    with files.open_input_stream(place) as stream:
                        if sniff(stream)[0] != file_hash:
                            raise ValueError(f"two files of different bytes have the key {key}")
                files.create_dir(place.rsplit("/", 1)[0])
                files.copy_file(source, place)  # a repeated task writes the same bytes again
                keys.append(key)
                hashes.append(file_hash)
            yield pd.DataFrame({"key": keys, "file_hash": hashes})
    return run


def _uri(path: str) -> str:
    return path if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path) else "file://" + path


def land_exports(spark: SparkSession, staging_dir: str, landing_dir: str, prefix: str) -> DataFrame:
    """Put staged exports into the landing zone under their content-hash keys;
    the executors hash and copy. Returns (key, file_hash)."""
    checkpoint_dir(spark)
    stamp = F.regexp_extract("path", r"export_id=(\d{8}T\d{6}Z)", 1)
    staged = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "part-*").load(staging_dir)
              .select("path", F.concat(F.lit(prefix.strip("/") + "/"), stamp).alias("prefix")))
    return spread(staged).mapInPandas(_move_to_keys(_uri(landing_dir.rstrip("/"))),
                                      "key string, file_hash string").checkpoint(eager=True)


# --- reading the landing zone -----------------------------------------------------------
def _relative_key(path_col: str, landing_dir: str):
    root = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", landing_dir.rstrip("/")).lstrip("/")
    return F.regexp_replace(F.col(path_col), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?/*" + re.escape(root) + "/", "")


def with_key(files: DataFrame, landing_dir: str) -> DataFrame:
    key = _relative_key("path", landing_dir)
    return files.select(
        "path", key.alias("key"), key_snapshot_ts(key).alias("snapshot_ts"), key_hash8(key).alias("hash8"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"),
        key_is_valid(key).alias("is_valid"))


def list_landing(spark: SparkSession, landing_dir: str) -> DataFrame:
    """Every landing object (metadata only: ``content`` is never read here),
    with the parsed key; ``is_valid`` false marks keys that do not parse."""
    return with_key(spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                    .load(landing_dir).select("path", "length", "modificationTime"), landing_dir)


def _same_file(a: str, b: str) -> str:
    return " and ".join(f"{a}.{c} <=> {b}.{c}" for c in ("key", "size_bytes", "last_modified"))


def pending_objects(landing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Objects that the ledger does not have with the same key, size and time."""
    return landing.alias("l").join(ledger.alias("g"), F.expr(_same_file("l", "g")), "left_anti")


def inventory(landing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listing with the ledger's status and an 'in Bronze' flag: a file is in
    Bronze if its bytes (full hash) were ingested under any key."""
    stored = (ledger.where(F.col("status") == STATUS_INGESTED).select(F.col("file_hash").alias("_h")).distinct())
    seen = ledger.select("key", "size_bytes", "last_modified", "file_hash", "status").distinct()
    return (landing.alias("l").join(seen.alias("g"), F.expr(_same_file("l", "g")), "left")
            .join(stored, F.expr("g.file_hash = _h"), "left")
            .select("l.*", F.expr("g.status as status"), F.expr("_h is not null as in_bronze"))
            .orderBy("snapshot_ts", "key"))


# --- ingesting ------------------------------------------------------------------------------
def classify_files(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Examined files with a status: unparsable keys and unusable files are
    rejected, bytes that do not hash to the key are a mismatch, and of equal
    bytes the earliest (snapshot_ts, key) is taken, unless ``ingested``
    (file_hash) has them already."""
    seen = ingested.select(F.col("file_hash").alias("_seen")).distinct()
    usable = F.expr("is_valid and substring(file_hash, 1, 8) = hash8")
    first = (files.where(usable).groupBy(F.col("file_hash").alias("_hash"))
             .agg(F.min(F.struct("snapshot_ts", "key")).alias("_first")))
    out = (files.join(first, F.expr("file_hash = _hash"), "left")
           .join(seen, F.expr("file_hash = _seen"), "left"))
    status = f"""case when not is_valid then '{STATUS_REJECTED}'
        when not coalesce(substring(file_hash, 1, 8) = hash8, false) then '{STATUS_HASH_MISMATCH}'
        when _seen is not null or snapshot_ts <> _first.snapshot_ts or key <> _first.key then '{STATUS_DUPLICATE}'
        when error is not null then '{STATUS_REJECTED}' else '{STATUS_INGESTED}' end"""
    return out.withColumn("status", F.expr(status)).drop("_hash", "_first", "_seen")


def ingest_files(files: DataFrame, bronze_path: str, batch_id: str, *, ingested_at=None,
                 on_mismatch: str = "fail") -> DataFrame:
    """Examine, classify and append one batch of files; returns its ledger rows.

    ``files`` has META_COLUMNS. The facts of the files (one row each) are cut
    from their lineage in the shared checkpoint folder; the rows of new files
    go straight into Bronze.
    """
    spark = files.sparkSession
    checkpoint_dir(spark)
    ledger = bz.read_ledger(spark, bronze_path).where(F.col("batch_id") != batch_id)
    found = classify_files(examine(files.select(*META_COLUMNS)),
                           ledger.where(F.col("status") == STATUS_INGESTED)).checkpoint(eager=True)
    if on_mismatch == "fail":
        bad = found.where(F.col("status") == STATUS_HASH_MISMATCH).select("key").limit(1).collect()
        if bad:
            raise ValueError(f"content hash does not match key: {bad[0]['key']}")
    new = found.where(F.col("status") == STATUS_INGESTED)
    stamp = F.current_timestamp() if ingested_at is None else F.lit(ingested_at).cast("timestamp")
    rows = read_rows(new, "key", "snapshot_ts").select(
        *ROW_COLUMNS, "snapshot_ts", "file_hash", F.col("key").alias("source_object"), "source_row_number",
        stamp.alias("ingested_at"))
    bz.append_bronze(rows, bronze_path, batch_id)
    taken = F.col("status") == STATUS_INGESTED
    message = (F.when(taken, F.format_string("%s: %d rows taken, md5 %s, %s, header after %d lines", "key",
                                             "row_count", "file_hash", "encoding", "header_line_index"))
               .when(F.col("status") == STATUS_DUPLICATE,
                     F.format_string("%s: bytes with md5 %s are in Bronze or earlier in this batch", "key", "file_hash"))
               .when(F.col("status") == STATUS_HASH_MISMATCH,
                     F.format_string("%s: md5 %s does not start with the key's short hash", "key", "file_hash"))
               .when(~F.col("is_valid"), F.format_string("%s: the key does not parse", "key"))
               .otherwise(F.format_string("%s: %s", "key", "error")))
    bz.append_ledger(found.select(
        "key", "snapshot_ts", "size_bytes", "last_modified", "file_hash", "status",
        F.when(taken, F.col("row_count")).otherwise(0).cast("long").alias("rows_ingested"),
        "header_line_index", "encoding", message.alias("message")), bronze_path, batch_id)
    return bz.read_ledger(spark, bronze_path).where(F.col("batch_id") == batch_id)


def ingest_report(results: DataFrame) -> DataFrame:
    """objects_scanned / ingested / skipped_duplicate / rejected / rows_ingested."""
    s = F.col("status")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return results.agg(
        F.count(F.lit(1)).alias("objects_scanned"),
        count(s == STATUS_INGESTED).alias("objects_ingested"),
        count(s == STATUS_DUPLICATE).alias("objects_skipped_duplicate"),
        count(s.isin(STATUS_REJECTED, STATUS_HASH_MISMATCH)).alias("objects_rejected"),
        F.coalesce(F.sum("rows_ingested"), F.lit(0)).cast("long").alias("rows_ingested"),
    )


def ingest(spark: SparkSession, landing_dir: str, bronze_path: str, *, ingested_at=None,
           on_mismatch: str = "fail") -> DataFrame:
    """One incremental batch run; returns its ledger rows (one per file that
    the ledger did not have yet)."""
    pending = pending_objects(list_landing(spark, landing_dir), bz.read_ledger(spark, bronze_path))
    return ingest_files(pending, bronze_path, f"batch-{uuid.uuid4().hex}", ingested_at=ingested_at,
                        on_mismatch=on_mismatch)


def dry_run(spark: SparkSession, landing_dir: str, bronze_path: str) -> DataFrame:
    """What an ingest of every landing object would find, without storing
    anything: hash, rows or error, and whether Bronze has the bytes already."""
    seen = (bz.read_ledger(spark, bronze_path).where(F.col("status") == STATUS_INGESTED)
            .select(F.col("file_hash").alias("_h")).distinct())
    return (examine(list_landing(spark, landing_dir)).join(seen, F.expr("file_hash = _h"), "left")
            .withColumn("is_duplicate", F.expr("_h is not null")).drop("_h"))
