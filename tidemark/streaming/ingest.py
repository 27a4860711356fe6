"""Continuous / triggered ingest of new export files with Structured Streaming.

``readStream.format("binaryFile")`` discovers new files; every micro-batch runs
the same ``ingest_files`` step as the batch job, under a batch id made of the
stream's checkpoint and the batch number. The stream checkpoint remembers which
paths were seen, and the ledger's full hashes make it exactly-once by
*content*: the same bytes under a new name are skipped. A replayed micro-batch
overwrites its own Bronze folder and ledger rows and is compared with the other
batches only. ``availableNow`` processes whatever is there and stops, so a
redundant trigger is a no-op.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import bronze as bz
from tidemark.sources import landing

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
#: Files per micro-batch, so that one batch's metadata stays bounded.
FILES_PER_TRIGGER = 10_000


def landing_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(landing_dir))
    return landing.with_key(files, landing_dir)


def run_available_now(spark: SparkSession, landing_dir: str, bronze_path: str, checkpoint_location: str, *,
                      ingested_at=None, on_mismatch: str = "quarantine") -> DataFrame:
    """Ingest everything new under ``landing_dir`` and stop; returns the ledger
    rows of all runs of this stream so far."""
    name = "stream-" + hashlib.md5(checkpoint_location.encode()).hexdigest()[:12]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        landing.ingest_files(batch, bronze_path, f"{name}-{batch_id}", ingested_at=ingested_at,
                             on_mismatch=on_mismatch)

    query = (landing_stream(spark, landing_dir).writeStream.foreachBatch(on_batch)
             .option("checkpointLocation", checkpoint_location)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return bz.read_ledger(spark, bronze_path).where(F.col("batch_id").startswith(name + "-"))
