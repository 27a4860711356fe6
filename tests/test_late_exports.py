"""Late exports spliced into a history equal a replay, in any order of arrival."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scd2

START = dt.datetime(2026, 1, 1)
SCHEMA = ("connection_id string, first_name string, last_name string, full_name string, email_address string, "
          "company string, company_label string, company_key string, position string, connected_on date, "
          "connected_on_date_key int, snapshot_ts timestamp, is_identifiable boolean")


def rows_of(exports):
    """exports: [{entity: (company, position)}] → Silver-shaped rows."""
    out = []
    for k, people in enumerate(exports):
        for who, (company, position) in people.items():
            # full_name is not tracked: it tells from which export a version was taken
            out.append((who, who, "x", f"{who}@{k}", None, company, company, str(company), position, dt.date(2025, 1, 1),
                        20250101, START + dt.timedelta(days=7 * k), True))
    return out


def arrive(spark, silver, stamps, order, first):
    """History of the ``first`` exports of ``order``, then the others one by one."""
    known = sorted(order[:first])
    have = silver.where(F.col("snapshot_ts").isin([stamps[i] for i in known]))
    dim = scd2.replay(have).checkpoint(eager=True)
    for i in order[first:]:
        at = lambda k: None if k is None else stamps[k]
        before, after = max((k for k in known if k < i), default=None), min((k for k in known if k > i), default=None)
        pick = lambda k: silver.where(F.col("snapshot_ts") == F.lit(at(k)))
        dim = scd2.splice(dim, pick(i), pick(after), at=stamps[i], previous_ts=at(before),
                          following_ts=at(after)).checkpoint(eager=True)
        known.append(i)
    return dim


def same_rows(a, b):
    key = lambda df: sorted(map(str, df.select(*scd2.SCD_COLUMNS).collect()))
    assert key(a) == key(b)


@pytest.mark.parametrize("order", [(0, 2, 3, 1), (3, 1, 2, 0), (1, 3, 0, 2)])
def test_every_change_across_three_exports(spark, order):
    """Every way to be away (None), with values a or b, over four exports."""
    states, exports = [None, "a", "b"], [{} for _ in range(4)]
    n = 0
    for w in states:
        for x in states:
            for y in states:
                for z in states:
                    for k, company in enumerate((w, x, y, z)):
                        if company:
                            exports[k][f"e{n:02d}"] = (company, None if company == "a" else "p")
                    n += 1
    stamps = [START + dt.timedelta(days=7 * k) for k in range(4)]
    silver = spark.createDataFrame(rows_of(exports), SCHEMA).checkpoint(eager=True)
    same_rows(arrive(spark, silver, stamps, list(order), 2), scd2.replay(silver))


def test_random_orders_of_arrival(spark):
    gen = random.Random(4)
    exports = [{f"e{i}": (gen.choice("abc"), gen.choice(["p", None])) for i in range(40) if gen.random() < 0.6} for _ in range(7)]
    stamps = [START + dt.timedelta(days=7 * k) for k in range(7)]
    silver = spark.createDataFrame(rows_of(exports), SCHEMA).checkpoint(eager=True)
    want = scd2.replay(silver)
    for seed in range(2):
        order = list(range(7))
        random.Random(seed).shuffle(order)
        same_rows(arrive(spark, silver, stamps, order, 1), want)


def test_versions_away_from_a_late_export_pass_through(spark):
    exports = [{"a": ("x", None)}, {"a": ("y", None)}, {"b": ("x", None)}, {"b": ("z", None)}, {"c": ("x", None)}]
    stamps = [START + dt.timedelta(days=7 * k) for k in range(5)]
    silver = spark.createDataFrame(rows_of(exports), SCHEMA)
    dim = scd2.replay(silver.where(F.col("snapshot_ts") != F.lit(stamps[3]))).checkpoint(eager=True)
    out = scd2.splice(dim, silver.where(F.col("snapshot_ts") == F.lit(stamps[3])),
                      silver.where(F.col("snapshot_ts") == F.lit(stamps[4])), at=stamps[3], previous_ts=stamps[2],
                      following_ts=stamps[4])
    same_rows(out, scd2.replay(silver))
    joins = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in joins  # no history is replayed
