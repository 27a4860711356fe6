"""Tables built export by export equal a build of everything at once."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from tidemark.operators import dims, marts, scd2
from tidemark.operators import fact as fact_ops
from tidemark.operators import silver as silver_ops
from tidemark.plans import delta
from tidemark.sources import bronze as bz
from tidemark.sources import tables

TODAY = "2026-08-27"
START = dt.datetime(2026, 1, 1, 9, 0, 0)
#: (person, company) per export: joiners, leavers, returners, changed spellings,
#: a row without an identity (None) and an export with such rows only.
EXPORTS = [
    [("ann", "Acme"), ("ben", "acme"), (None, "Void"), ("cy", None)],
    [("ann", "ACME"), ("dee", "Bolt"), ("cy", "Bolt")],
    [(None, "Void"), (None, None)],
    [("ann", "Acme"), ("ben", "Bolt"), ("eve", "Acme")],
    [("ben", "bolt"), ("eve", "Acme"), ("fay", "Cog"), ("cy", "Cog"), ("cy", "Acme")],
]


def stamp(k):
    return START + dt.timedelta(days=7 * k)


def bronze(spark, ks, extra=()):
    rows = []
    for k in ks:
        for n, (who, company) in enumerate(EXPORTS[k], 1):
            rows.append((who, "x", who and f"u/{who}", None, company, "P" if n % 2 else None,
                         f"{1 + k:02d} Feb 2025", stamp(k), f"h{k}", f"o{k}", n, START))
    rows += extra
    return spark.createDataFrame(rows, bz.BRONZE_SCHEMA)


def refresh(spark, rows, root, run_id):
    todo = delta.plan(spark, root, delta.exports_of(rows))
    silver = delta.build_silver(rows, root, run_id, todo)
    return todo, delta.build_gold(spark, root, run_id, todo, scd2.replay(silver), TODAY)


def whole(spark, rows):
    s = silver_ops.build_silver(rows)
    fact = fact_ops.fact_with_flow(s)
    return {"silver": s, delta.FACT: fact, "mart_network_stats": marts.network_stats(fact, s),
            "mart_network_breakdown": marts.breakdown(fact), "dim_company": dims.dim_company(s, scd2.replay(s)),
            "dim_date": dims.dim_date(s, TODAY)}


def same(spark, root, rows):
    for name, want in whole(spark, rows).items():
        got = tables.read_table(spark, root, name)
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(want.columns)
        key = lambda df: sorted(map(str, df.select(*cols).collect()))
        assert key(got) == key(want), name


def folders(spark, root, name):
    rows = spark.read.parquet(f"{root}/{name}_parts/{tables.current_version(spark, root, name + '_parts')}")
    return {r.part: r.folder.split("/")[-2] for r in rows.where("part IS NOT NULL").collect()}


@pytest.mark.parametrize("steps", [
    [[0, 1], [2], [3], [4]],        # in order, one without an identity
    [[1, 4], [0], [3, 2]],          # the oldest late, then two at once
    [[3], [4], [1], [0, 2]],        # every late place
])
def test_any_order_of_arrival_equals_a_full_build(spark, tmp_path, steps):
    root, have = str(tmp_path), []
    for n, step in enumerate(steps):
        have += step
        todo, _ = refresh(spark, bronze(spark, have), root, f"run{n}")
        assert todo.full == (n == 0) and len(todo.new) == len(step)
    same(spark, root, bronze(spark, have))


def test_a_new_export_writes_its_own_parts_and_the_one_before(spark, tmp_path):
    root = str(tmp_path)
    refresh(spark, bronze(spark, [0, 1, 3]), root, "run0")
    todo, touched = refresh(spark, bronze(spark, [0, 1, 3, 4]), root, "run1")
    p = [tables.part_of(stamp(k)) for k in (0, 1, 3, 4)]
    assert todo.new == [p[3]] and touched == p[2:]
    assert folders(spark, root, "silver") == {p[0]: "run0", p[1]: "run0", p[2]: "run0", p[3]: "run1"}
    assert folders(spark, root, delta.FACT) == {p[0]: "run0", p[1]: "run0", p[2]: "run1", p[3]: "run1"}
    assert folders(spark, root, "mart_network_breakdown") == {p[0]: "run0", p[1]: "run0", p[2]: "run0", p[3]: "run1"}
    read = tables.read_table(spark, root, "silver", p[3:])
    assert len(read.inputFiles()) < len(tables.read_table(spark, root, "silver").inputFiles())
    assert read.select("snapshot_ts").distinct().count() == 1


def test_the_same_exports_again_change_nothing(spark, tmp_path):
    root, rows = str(tmp_path), bronze(spark, [0, 1])
    refresh(spark, rows, root, "run0")
    before = folders(spark, root, delta.FACT)
    todo, touched = refresh(spark, rows, root, "run1")
    assert (todo.new, todo.full, touched) == ([], False, [])
    assert folders(spark, root, delta.FACT) == before
    same(spark, root, rows)


def test_another_file_of_a_built_export_rebuilds_all(spark, tmp_path):
    root = str(tmp_path)
    refresh(spark, bronze(spark, [0, 1, 3]), root, "run0")
    more = [("zoe", "x", "u/zoe", None, "Acme", None, "01 Feb 2025", stamp(1), "h9", "o9", 1, START)]
    rows = bronze(spark, [0, 1, 3], more)
    todo, _ = refresh(spark, rows, root, "run1")
    assert todo.full
    same(spark, root, rows)


def test_a_run_that_died_is_done_again(spark, tmp_path):
    """Silver and links of the new export were written, the rest was not."""
    root = str(tmp_path)
    refresh(spark, bronze(spark, [0, 1]), root, "run0")
    rows = bronze(spark, [0, 1, 3])
    todo = delta.plan(spark, root, delta.exports_of(rows))
    delta.build_silver(rows, root, "died", todo)
    links = dims.merge_links(tables.read_table(spark, root, "company_links").unionByName(
        dims.company_links(tables.read_table(spark, root, "silver", todo.new))))
    tables.write_table(links, root, "company_links", "died")
    assert refresh(spark, rows, root, "run1")[0].new == todo.new
    same(spark, root, rows)


def test_no_exports_give_empty_tables_and_the_next_run_fills_them(spark, tmp_path):
    root = str(tmp_path)
    refresh(spark, bronze(spark, []), root, "run0")
    assert tables.read_table(spark, root, "silver").count() == 0
    assert tables.read_table(spark, root, delta.FACT).count() == 0
    refresh(spark, bronze(spark, [2]), root, "run1")
    refresh(spark, bronze(spark, [2, 3]), root, "run2")
    same(spark, root, bronze(spark, [2, 3]))


def test_parts_of_a_table(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *ks: spark.createDataFrame([(stamp(k), k) for k in ks], "snapshot_ts timestamp, k int")
    tables.write_parts(rows(0, 0, 1), root, "t", "v0")
    tables.write_parts(rows(1), root, "t", "v1", replace=[tables.part_of(stamp(1)), tables.part_of(stamp(7))])
    got = tables.read_table(spark, root, "t")
    assert sorted(r.k for r in got.collect()) == [0, 0, 1] and got.columns == ["snapshot_ts", "k"]
    assert tables.read_table(spark, root, "t", []).count() == 0
    tables.write_parts(rows(), root, "t", "v2", replace=[tables.part_of(stamp(0))])
    assert [r.k for r in tables.read_table(spark, root, "t").collect()] == [1]


def test_the_newest_export_of_bronze_is_read_by_its_date(spark, tmp_path):
    path = f"{tmp_path}/bronze"
    for k in (0, 1, 3):
        bz.append_bronze(bronze(spark, [k]), path, f"b{k}")
        bz.append_ledger(spark.createDataFrame([("o", stamp(k), f"h{k}", "ingested", f"b{k}")],
                                               "key string, snapshot_ts timestamp, file_hash string, status string, "
                                               "batch_id string"), path, f"b{k}")
    newest = bz.read_newest(spark, path)
    want = bz.latest_snapshot(bz.read_bronze(spark, path))
    key = lambda df: sorted(map(str, df.select(*bz.BRONZE_COLUMNS).collect()))
    assert key(newest) == key(want) and newest.count() == len(EXPORTS[3])
    scans = newest._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*snapshot_date", scans)
    assert bz.read_newest(spark, f"{tmp_path}/none").count() == 0
