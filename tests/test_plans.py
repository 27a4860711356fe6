"""Plan-shape checks and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tidemark.operators.rownum import row_number_in_groups
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: keys whose callables write files (landing zone, pipeline) — checked elsewhere
SIDE_EFFECT_KEYS = {
    "landing_inventory", "parse_exports", "header_check", "validate_exports", "hash_mismatch",
    "bronze_append", "ingest_report", "ingest_batch", "stream_ingest", "late_snapshot",
    "pipeline_run", "export_shortlist", "parse_exports_split", "versioned_table", "layer_status", "seeded_exports",
}
ROWS_ONLY: set[str] = set()


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) - set(o) == ROWS_ONLY


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 30
    assert "net_change" in df.columns


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SIDE_EFFECT_KEYS))
def test_no_python_and_no_cartesian_on_the_data_path(spark, key):
    plan = _plan(entry.queries()[key](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pushdown_and_pruning_reach_the_scan(spark):
    df = entry.queries()["network_stats"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_bucketed_row_number_equals_the_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(0, 5000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5003).alias("o"))
    a = row_number_in_groups(df, ["g"], "o", "rn", bucket_bits=6)
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("int"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_breakdown_ranks_without_a_window_over_a_whole_dimension(spark):
    """Row-level windows are split by count and value prefix; the only windows
    over (export, dimension) run on the histogram of counts."""
    import re

    plan = _plan(entry.queries()["breakdown"](spark, SF))
    specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    ranked = [x for x in specs if "dimension_value" in x]
    assert ranked and all("connection_count" in x and "_prefix" in x for x in ranked)


def test_breakdown_rank_equals_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators.marts import with_rank_and_share

    rows = [(t, d, (None if i % 31 == 0 else f"{'ab'[i % 2] * (i % 5)}{i:03d}"), 1 + (i * i) % 7)
            for t in (1, 2) for d in ("x", "y") for i in range(150)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "snapshot_ts int, dimension_type string, dimension_value string, "
                                     "connection_count long").repartition(4)
    w = Window.partitionBy("snapshot_ts", "dimension_type").orderBy(
        F.desc("connection_count"), F.asc_nulls_last("dimension_value"))
    want = df.withColumn("r", F.row_number().over(w).cast("long")).collect()
    got = with_rank_and_share(df).collect()
    assert sorted((r[0], r[1], str(r[2]), r.r) for r in want) == sorted(
        (r[0], r[1], str(r[2]), r.rank_within_dimension) for r in got)
    one = [r.share_pct for r in got if (r.snapshot_ts, r.dimension_type) == (1, "x")]
    assert abs(sum(one) - 100) < 1
