"""Bucket-notification flattening."""

from __future__ import annotations

import json

from tidemark.streaming.notifications import notification_keys

PREFIX = "raw/connections"
KEY = "raw/connections/20260823T140501Z_1f3c9ab2.csv"


def event(event="s3:ObjectCreated:Put", key="raw%2Fconnections%2F20260823T140501Z_1f3c9ab2.csv"):
    return json.dumps({"EventName": event, "Key": f"landing/{key}", "Records": [
        {"eventName": event, "s3": {"bucket": {"name": "landing"}, "object": {"key": key}}}]})


def keys(spark, payloads):
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    return [r["key"] for r in notification_keys(df, PREFIX).collect()]


def test_created_keys_are_decoded(spark):
    assert keys(spark, [event()]) == [KEY]


def test_other_events_and_prefixes_and_empty_payloads_are_ignored(spark):
    assert keys(spark, [event(event="s3:ObjectRemoved:Delete"), event(key="other%2Fthing.csv"),
                        "{}", "not json"]) == []


def test_plus_is_a_space(spark):
    assert keys(spark, [event(key="raw/connections/a+b.csv")]) == ["raw/connections/a b.csv"]
