"""Hot groups must not land in one task."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import silver


def _bronze(spark, n=30_000):
    ts = dt.datetime(2026, 1, 1)
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(""))                       # a third: no identity
        .when(F.col("id") % 3 == 1, F.lit("https://example.com/in/hot"))  # a third: one entity
        .otherwise(F.concat(F.lit("https://example.com/in/u"), F.col("id").cast("string")))
        .alias("url"),
        F.lit("A").alias("first_name"), F.lit("B").alias("last_name"),
        F.lit("").alias("email_address"), F.lit("Co").alias("company"),
        F.lit("Data Engineer").alias("position"), F.lit("04 Feb 2025").alias("connected_on"),
        F.lit(ts).alias("snapshot_ts"), F.lit("h" * 32).alias("file_hash"),
        F.lit("k").alias("source_object"), (F.col("id") + 1).cast("int").alias("source_row_number"),
        F.lit(ts).alias("ingested_at"),
    )
    return base


def test_dedup_spreads_unidentified_rows_and_collapses_copies(spark):
    out = silver.build_silver(_bronze(spark))
    rows = out.groupBy("is_identifiable").count().collect()
    counts = {r["is_identifiable"]: r["count"] for r in rows}
    assert counts == {False: 10_000, True: 10_001}
    hot = out.filter(F.col("connection_id").endswith("/hot")).first()
    assert hot["source_row_number"] == 2          # the first copy wins
    sizes = out.rdd.glom().map(len).collect()
    assert max(sizes) <= 2 * (sum(sizes) / len(sizes)) + 1


def test_dedup_prunes_copies_before_the_shuffle(spark):
    """The group limit stands below the exchange: a copied entity leaves each
    map task once."""
    plan = silver.build_silver(_bronze(spark, 100))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below
    assert "Union" not in plan
