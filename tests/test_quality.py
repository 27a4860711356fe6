"""The Bronze suite on the fixture export, including negative cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import EXPORT_V1, KEY_TS_V1, put
from tidemark.operators import quality as dq
from tidemark.plans.pipeline import bronze_suite
from tidemark.sources import bronze as bz
from tidemark.sources import landing


@pytest.fixture(scope="module")
def bronze(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("dq"))
    put(f"{root}/landing", KEY_TS_V1, EXPORT_V1)
    landing.ingest(spark, f"{root}/landing", f"{root}/bronze")
    return bz.read_bronze(spark, f"{root}/bronze").cache()


def report(df):
    res = dq.run_checks(df, bronze_suite(dq.PROFILE_URL_REGEX) + [dq.columns_exact(bz.BRONZE_COLUMNS)])
    return dq.suite_report(res).first()


def test_a_healthy_export_passes(bronze):
    r = report(bronze)
    assert r["success"], r["failed_checks"]
    assert r["evaluated"] == 9


def test_blank_emails_never_fail(bronze):
    assert report(bronze.withColumn("email_address", F.lit("")))["success"]


def test_restricted_rows_are_counted(bronze):
    assert dq.restricted_rows(bronze).first()[0] == 1


def test_schema_change_fails(bronze):
    r = report(bronze.withColumn("mystery_score", F.lit(1)))
    assert not r["success"] and "columns_exact" in r["failed_checks"]


def test_changed_date_format_fails(bronze):
    r = report(bronze.withColumn("connected_on", F.lit("2025-02-04")))
    assert r["failed_checks"] == ["matches:connected_on"]


def test_mostly_blank_urls_fail(bronze):
    r = report(bronze.withColumn("url", F.when(F.col("source_row_number") <= 6, F.lit(""))
                                 .otherwise(F.col("url"))))
    assert r["failed_checks"] == ["matches:url"]


def test_empty_batch_fails(bronze):
    r = report(bronze.limit(0))
    assert "row_count_at_least_1" in r["failed_checks"]


def test_key_level_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c")], "k int, v string")
    parent = spark.createDataFrame([("a",)], "v string")
    res = {r["check"]: r["failed_rows"] for r in dq.run_checks(df, [
        dq.unique("k"), dq.unique("k", "v"), dq.relationship("v", parent, "v"),
        dq.accepted_values("v", ["a", "b"]), dq.in_range("k", 1, 1), dq.not_null("v")]).collect()}
    assert res == {"unique:k": 1, "unique:k,v": 0, "relationship:v": 2,
                   "accepted_values:v": 1, "in_range:k": 1, "not_null:v": 1}
