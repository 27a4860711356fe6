"""Bucket-notification payloads → created object keys (batch or streaming).

Pure column expressions, so the same function flattens a static table of
payloads or a streaming source of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: event-name prefix of object-creation events.
OBJECT_CREATED_PREFIX = "s3:ObjectCreated:"

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("EventName", T.StringType()),
    T.StructField("Key", T.StringType()),
    T.StructField("Records", T.ArrayType(T.StructType([
        T.StructField("eventName", T.StringType()),
        T.StructField("s3", T.StructType([
            T.StructField("bucket", T.StructType([T.StructField("name", T.StringType())])),
            T.StructField("object", T.StructType([T.StructField("key", T.StringType())])),
        ])),
    ]))),
])


def decode_key(c) -> F.Column:
    """Form-decoding ('+' is a space); a malformed escape leaves the text as is."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def notification_keys(payloads: DataFrame, raw_prefix: str, payload_col: str = "payload",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per created object key under ``raw_prefix``."""
    parsed = payloads.select(*keep, F.from_json(payload_col, PAYLOAD_SCHEMA).alias("p"))
    recs = parsed.select(*keep, F.explode_outer("p.Records").alias("r"))
    key = decode_key(F.coalesce(F.col("r.s3.object.key"), F.lit("")))
    created = F.coalesce(F.col("r.eventName"), F.lit("")).startswith(OBJECT_CREATED_PREFIX)
    return recs.filter(created).select(*keep, key.alias("key")).filter(
        F.col("key").startswith(raw_prefix.strip("/")))


def payloads_for_exports(exports: DataFrame, bucket: str = "landing") -> DataFrame:
    """Notification payloads for a table of export keys (one creation and one
    removal record per export), as an object store would send them."""
    enc = F.url_encode("source_object")

    def rec(event: str):
        return F.struct(F.lit(event).alias("eventName"), F.struct(
            F.struct(F.lit(bucket).alias("name")).alias("bucket"),
            F.struct(enc.alias("key")).alias("object")).alias("s3"))

    payload = F.struct(
        F.lit(OBJECT_CREATED_PREFIX + "Put").alias("EventName"),
        F.concat(F.lit(bucket + "/"), F.col("source_object")).alias("Key"),
        F.array(rec(OBJECT_CREATED_PREFIX + "Put"), rec("s3:ObjectRemoved:Delete")).alias("Records"),
    )
    return exports.select("source_object", F.to_json(payload).alias("payload"))
