"""Semantic hazards called out in the survey (H-numbers)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import fact, marts, scoring, silver

COLS = ("url string, first_name string, last_name string, email_address string, company string, "
        "position string, connected_on string, snapshot_ts timestamp, file_hash string, "
        "source_object string, source_row_number int, ingested_at timestamp")
T1, T2, T3 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 8), dt.datetime(2026, 1, 15)


def bronze(spark, rows):
    return spark.createDataFrame(
        [(u, "A", "B", "", c, "Data Engineer", "04 Feb 2025", t, "h", "k", i, t)
         for i, (u, c, t) in enumerate(rows, start=1)], COLS)


def test_h12_export_without_identified_rows_has_no_stats_row(spark):
    b = bronze(spark, [("u1", "Acme", T1), ("", "Acme", T2), ("u1", "Acme", T3)])
    s = silver.build_silver(b)
    stats = {r["snapshot_ts"]: r for r in marts.network_stats(fact.fact_with_flow(s), s).collect()}
    assert set(stats) == {T1, T3}
    # T3 follows T1 in the sequence: u1 is not "new" and nobody was lost
    assert stats[T3]["new_connections"] == 0 and stats[T3]["lost_connections"] == 0
    assert stats[T3]["previous_snapshot_ts"] == T1


def test_h14_literal_unknown_shares_the_null_bucket_key_but_not_its_label(spark):
    b = bronze(spark, [("u1", "(Unknown)", T1), ("u2", None, T1), ("u3", "  ", T1)])
    rows = {r["connection_id"]: r for r in silver.build_silver(b).collect()}
    assert rows["u1"]["company_key"] == rows["u2"]["company_key"] == rows["u3"]["company_key"]
    assert rows["u1"]["company_label"] == "(Unknown)" and rows["u2"]["company_label"] == "(unknown)"
    s = silver.build_silver(b)
    st = marts.network_stats(fact.fact_with_flow(s), s).first()
    # the literal label is not the unknown label, so its key counts as an employer
    assert st["distinct_companies"] == 1


def test_h7_ranking_puts_missing_values_last(spark):
    df = spark.createDataFrame([(10, None, "b"), (10, dt.date(2025, 1, 1), None), (10, dt.date(2025, 1, 1), "a")],
                               "score int, connected_on date, full_name string")
    got = [(r["connected_on"], r["full_name"]) for r in scoring.rank(df).collect()]
    assert got == [(dt.date(2025, 1, 1), "a"), (dt.date(2025, 1, 1), None), (None, "b")]


def test_h2_trim_strips_unicode_spaces(spark):
    b = bronze(spark, [(" u1 ", " Acme ", T1)])
    r = silver.build_silver(b).first()
    assert r["connection_id"] == "u1" and r["company"] == "Acme"


def test_h3_percentages_are_doubles(spark):
    b = bronze(spark, [("u1", "Acme", T1), ("u2", "Acme", T1), ("u3", "Acme", T1)])
    s = silver.build_silver(b).withColumn("has_email", F.col("connection_id") == "u1")
    st = marts.network_stats(fact.fact_with_flow(s), s)
    assert dict(st.dtypes)["email_coverage_pct"] == "double"
    assert st.first()["email_coverage_pct"] == 33.33
