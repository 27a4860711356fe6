"""v1 → v2 through the landing zone and the pipeline, checked against
golden numbers derived by hand from the two fixture exports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import EXPORT_MISSING, EXPORT_V1, EXPORT_V2, KEY_TS_V1, KEY_TS_V2, md5, put
from tidemark.operators import scd2
from tidemark.plans import pipeline
from tidemark.sources import bronze as bz
from tidemark.sources import landing, tables

TODAY = "2026-08-27"


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("wh"))
    lz, wh = f"{root}/landing", f"{root}/warehouse"
    put(lz, KEY_TS_V1, EXPORT_V1)
    r1 = pipeline.run(spark, lz, wh, today=TODAY, ingested_at="2026-02-01 10:00:00").collect()
    put(lz, KEY_TS_V2, EXPORT_V2)
    r2 = pipeline.run(spark, lz, wh, today=TODAY, ingested_at="2026-02-08 10:00:00").collect()
    r3 = pipeline.run(spark, lz, wh, today=TODAY).collect()
    return {"lz": lz, "wh": wh, "runs": (r1, r2, r3)}


def table(spark, wh, name):
    return tables.read_table(spark, wh["wh"], name)


def test_runs_report_each_stage(warehouse):
    r1, r2, r3 = warehouse["runs"]
    assert [r["stage"] for r in r1][:3] == ["ingest", "gate", "quality"]
    assert dict((r["stage"], r["status"]) for r in r2)["scd2"] == "ok"
    assert [(r["stage"], r["status"]) for r in r3][-1] == ("gate", "skipped")


def test_bronze_is_appended_once_per_export(spark, warehouse):
    b = bz.read_bronze(spark, f"{warehouse['wh']}/bronze")
    counts = {r["snapshot_ts"]: r["count"] for r in b.groupBy("snapshot_ts").count().collect()}
    assert sorted(counts.values()) == [11, 12]
    assert b.filter("source_row_number = 1 AND first_name = 'Ann'").count() == 2
    assert b.filter("first_name = 'Cole, MSc'").count() == 2


def test_network_stats_golden(spark, warehouse):
    rows = table(spark, warehouse, "mart_network_stats").orderBy("snapshot_ts").collect()
    v1, v2 = rows
    assert (v1.total_connections, v1.new_connections, v1.lost_connections, v1.net_change) == (10, 0, 0, 0)
    assert (v2.total_connections, v2.new_connections, v2.lost_connections, v2.net_change) == (11, 2, 1, 1)
    assert (v1.distinct_companies, v2.distinct_companies) == (9, 8)
    assert (v1.connections_with_email, v1.email_coverage_pct) == (1, 10.0)
    assert (v2.connections_with_email, v2.email_coverage_pct) == (2, 18.18)
    for r in rows:
        assert (r.restricted_profile_rows, r.connections_without_company,
                r.connections_without_position) == (1, 2, 2)
    assert v2.previous_snapshot_ts == dt.datetime(2026, 2, 1, 9, 0)


def test_breakdown_golden(spark, warehouse):
    bd = table(spark, warehouse, "mart_network_breakdown")
    got = {(r["snapshot_ts"].day, r["dimension_type"]): r["count"]
           for r in bd.groupBy("snapshot_ts", "dimension_type").count().collect()}
    assert [got[(1, d)] for d in ("company", "position", "connected_year_month")] == [10, 10, 10]
    assert [got[(8, d)] for d in ("company", "position", "connected_year_month")] == [9, 11, 11]


def test_gold_golden(spark, warehouse):
    fact = table(spark, warehouse, "fct_connection_snapshot")
    dim = table(spark, warehouse, "dim_connection")
    comp = table(spark, warehouse, "dim_company")
    cal = table(spark, warehouse, "dim_date")
    assert fact.count() == 21
    assert dim.count() == 14 and dim.filter("valid_to IS NULL").count() == 11
    closed = {r["first_name"] for r in dim.filter("valid_to IS NOT NULL").collect()}
    assert closed == {"Ann", "Cole, MSc", "Finn"}
    assert comp.count() == 10
    counts = {r["company_name"]: r["current_connection_count"] for r in comp.collect()}
    assert counts["Contoso Group"] == 3 and counts["Northwind Shop"] == 0
    assert cal.count() == 370
    assert cal.agg(F.min("date_day"), F.max("date_day")).first() == (dt.date(2025, 2, 4),
                                                                       dt.date(2026, 2, 8))


def test_scd2_behaviour(spark, warehouse):
    dim = table(spark, warehouse, "dim_connection")
    ann = dim.filter(F.col("first_name") == "Ann").orderBy("valid_from").collect()
    assert [(r["company"], r["valid_to"] is None) for r in ann] == [
        ("Northwind Bank (NWB)", False), ("Contoso Group", True)]
    finn = dim.filter(F.col("first_name") == "Finn").collect()
    assert len(finn) == 1 and finn[0]["valid_to"] == dt.datetime(2026, 2, 8, 9, 0)
    assert dim.filter("first_name = 'Jay' AND valid_to IS NULL").count() == 1
    assert not [c for c in dim.columns if "reason" in c]
    assert scd2.recent_changes(dim, 25).count() == 2
    dep = scd2.departed(dim, 25).collect()
    assert [r["full_name"] for r in dep] == ["Finn Example"]
    fact = table(spark, warehouse, "fct_connection_snapshot")
    assert fact.groupBy("connection_id", "snapshot_ts").count().filter("count > 1").count() == 0
    assert fact.join(dim.filter("first_name = 'Finn'").select("connection_id"),
                     "connection_id").count() == 1


def test_apply_equals_replay(spark, warehouse):
    silver = table(spark, warehouse, "silver")
    replayed = scd2.replay(silver)
    dim = table(spark, warehouse, "dim_connection")
    assert replayed.exceptAll(dim).count() == 0 and dim.exceptAll(replayed).count() == 0


def test_reingest_and_renamed_duplicate_are_noops(spark, tmp_path):
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_V1)
    first = landing.ingest(spark, lz, bronze)
    assert landing.ingest_report(first).first()["rows_ingested"] == 11
    assert landing.ingest_report(landing.ingest(spark, lz, bronze)).first()["objects_scanned"] == 0
    put(lz, "20260301T000000Z", EXPORT_V1)  # same bytes under a new key
    again = landing.ingest(spark, lz, bronze).collect()
    assert [(r["status"], r["rows_ingested"]) for r in again] == [("skipped_duplicate", 0)]
    assert landing.ingest(spark, lz, bronze).count() == 0
    assert bz.read_bronze(spark, bronze).count() == 11


def test_in_batch_duplicates_keep_the_earliest(spark, tmp_path):
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_V1)
    put(lz, KEY_TS_V2, EXPORT_V1)
    res = {r["key"][16:32]: r["status"] for r in landing.ingest(spark, lz, bronze).collect()}
    assert res == {KEY_TS_V1: "ingested", KEY_TS_V2: "skipped_duplicate"}


def test_bad_files_are_reported_not_ingested(spark, tmp_path):
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_MISSING)
    put(lz, KEY_TS_V2, EXPORT_V2, hash8="00000000")
    res = {r["status"]: r["message"] for r in
           landing.ingest(spark, lz, bronze, on_mismatch="quarantine").collect()}
    assert set(res) == {"rejected", "hash_mismatch"}
    assert "Position" in res["rejected"]
    assert bz.read_bronze(spark, bronze).count() == 0
    with pytest.raises(ValueError):
        landing.ingest(spark, lz, f"{tmp_path}/bronze2")


def test_unparsable_keys_are_listed_as_invalid(spark, tmp_path):
    lz = f"{tmp_path}/landing"
    put(lz, KEY_TS_V1, EXPORT_V1)
    path = f"{lz}/raw/connections/not-a-key.csv"
    with open(path, "wb") as fh:
        fh.write(EXPORT_V1)
    got = {r["key"]: r["is_valid"] for r in landing.list_landing(spark, lz).collect()}
    assert got["raw/connections/not-a-key.csv"] is False and sum(got.values()) == 1


def test_equal_short_hashes_do_not_hide_a_file(spark, tmp_path):
    """Two files whose keys carry one short hash: both are looked at, and only
    the one whose bytes do not fit its key is refused."""
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_V1)
    landing.ingest(spark, lz, bronze)
    put(lz, KEY_TS_V2, EXPORT_V2, hash8=md5(EXPORT_V1)[:8])
    got = landing.ingest(spark, lz, bronze, on_mismatch="quarantine").collect()
    assert [r["status"] for r in got] == ["hash_mismatch"]
    files = landing.list_landing(spark, lz)
    ledger = bz.read_ledger(spark, bronze)
    assert landing.pending_objects(files, ledger.where("status = 'ingested'")).count() == 1
    shown = {r["key"][16:32]: (r["in_bronze"], r["status"]) for r in landing.inventory(files, ledger).collect()}
    assert shown == {KEY_TS_V1: (True, "ingested"), KEY_TS_V2: (False, "hash_mismatch")}


def test_a_batch_that_died_is_neither_lost_nor_repeated(spark, tmp_path):
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_V1)
    files = landing.list_landing(spark, lz)
    landing.ingest_files(files, bronze, "b-1")
    import shutil
    shutil.move(f"{bronze}_ledger/batch_id=b-1", f"{tmp_path}/lost")  # died before the ledger was written
    assert bz.read_bronze(spark, bronze).count() == 0
    landing.ingest_files(files, bronze, "b-1")  # the batch again
    assert bz.read_bronze(spark, bronze).count() == 11
    landing.ingest_files(files, bronze, "b-1")  # a replay after all was written
    assert bz.read_bronze(spark, bronze).count() == 11
    assert [r["status"] for r in landing.ingest_files(files, bronze, "b-2").collect()] == ["skipped_duplicate"]


def test_dry_run_stores_nothing(spark, tmp_path):
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_V1)
    put(lz, KEY_TS_V2, EXPORT_MISSING)
    got = {r["key"][16:32]: r for r in landing.dry_run(spark, lz, bronze).collect()}
    assert got[KEY_TS_V1]["row_count"] == 11 and not got[KEY_TS_V1]["is_duplicate"]
    assert "Position" in got[KEY_TS_V2]["error"] and got[KEY_TS_V2]["row_count"] is None
    assert bz.read_bronze(spark, bronze).count() == 0
    landing.ingest(spark, lz, bronze)
    assert {r["key"][16:32]: r["is_duplicate"] for r in landing.dry_run(spark, lz, bronze).collect()} == {
        KEY_TS_V1: True, KEY_TS_V2: False}


def test_unparsable_keys_are_rejected_with_a_row(spark, tmp_path):
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_V1)
    with open(f"{lz}/raw/connections/odd name.csv", "wb") as fh:
        fh.write(EXPORT_V2)
    got = {r["status"]: r["message"] for r in landing.ingest(spark, lz, bronze).collect()}
    assert set(got) == {"ingested", "rejected"} and "does not parse" in got["rejected"]


def test_streaming_is_exactly_once_by_content(spark, tmp_path):
    from tidemark.streaming import ingest as st
    lz = f"{tmp_path}/landing"
    args = (spark, lz, f"{tmp_path}/bronze", f"{tmp_path}/ckpt")
    put(lz, KEY_TS_V1, EXPORT_V1)
    st.run_available_now(*args)
    st.run_available_now(*args)
    put(lz, "20260301T000000Z", EXPORT_V1)  # same bytes under a new name
    put(lz, KEY_TS_V2, EXPORT_V2)
    res = st.run_available_now(*args)
    statuses = sorted(r["status"] for r in res.collect())
    assert statuses == ["ingested", "ingested", "skipped_duplicate"]
    assert bz.read_bronze(spark, f"{tmp_path}/bronze").count() == 23


def test_dedup_keeps_the_first_row_and_every_unidentified_row(spark):
    from tidemark.operators import silver
    rows = [
        ("u1", "Zed", "A", 1), ("u1", "Amy", "B", 2), (None, "X", "C", 3), (None, "Y", "D", 4),
        ("u2", "Bob", "E", 5),
    ]
    df = spark.createDataFrame(
        [(u, f, None, None, c, None, "04 Feb 2025", dt.datetime(2026, 1, 1), "h", "k", n,
          dt.datetime(2026, 1, 1)) for u, f, c, n in rows],
        "url string, first_name string, last_name string, email_address string, company string, "
        "position string, connected_on string, snapshot_ts timestamp, file_hash string, "
        "source_object string, source_row_number int, ingested_at timestamp")
    out = silver.build_silver(df).collect()
    got = sorted((r["connection_id"] or "-", r["first_name"]) for r in out)
    assert got == [("-", "X"), ("-", "Y"), ("u1", "Zed"), ("u2", "Bob")]


def test_two_files_with_the_same_time_both_survive(spark, tmp_path):
    from conftest import EXPORT_V2
    lz, bronze = f"{tmp_path}/landing", f"{tmp_path}/bronze"
    put(lz, KEY_TS_V1, EXPORT_V1)
    landing.ingest(spark, lz, bronze)
    put(lz, KEY_TS_V1, EXPORT_V2)  # same stamp, different content, separate run
    landing.ingest(spark, lz, bronze)
    assert bz.read_bronze(spark, bronze).count() == 23


def test_quality_gate_aborts_before_silver(spark, tmp_path):
    from conftest import NOTES_V1, HEADER, export_bytes
    bad = export_bytes(NOTES_V1, [
        "Ann,Example,https://www.linkedin.com/in/a,,Acme,Data Analyst,2025-02-04"])
    lz, wh = f"{tmp_path}/landing", f"{tmp_path}/warehouse"
    put(lz, KEY_TS_V1, bad)
    with pytest.raises(pipeline.QualityGateError, match="matches:connected_on"):
        pipeline.run(spark, lz, wh, today=TODAY)
    assert tables.read_table(spark, wh, "silver") is None
    assert not tables.table_exists(spark, wh, "dim_connection")
    status = {r["layer"]: r["present"] for r in tables.warehouse_status(spark, wh).collect()}
    assert status == {"bronze": True, "silver": False, "dim_connection": False,
                      "mart_network_stats": False}
    assert HEADER.startswith("First Name")


def test_a_stale_source_stops_the_run_if_asked(spark, tmp_path):
    lz, wh = f"{tmp_path}/landing", f"{tmp_path}/warehouse"
    put(lz, KEY_TS_V1, EXPORT_V1)
    with pytest.raises(pipeline.StaleSourceError):
        pipeline.run(spark, lz, wh, today=TODAY, ingested_at="2026-02-01 10:00:00", fail_on_stale=True)
    assert tables.read_table(spark, wh, "silver") is None
    status = {r["stage"]: r["status"] for r in pipeline.run(
        spark, lz, wh, force=True, today="2026-03-20", fail_on_stale=True).collect()}
    assert status["freshness"] == "warn" and tables.read_table(spark, wh, "silver").count() == 11


def test_a_run_writes_only_the_parts_of_new_exports(spark, warehouse):
    """v1 and v2 came in two runs: Silver of v1 is still that of the first run,
    and the report counts what was built."""
    rows = spark.read.parquet(
        f"{warehouse['wh']}/silver_parts/{tables.current_version(spark, warehouse['wh'], 'silver_parts')}")
    runs = [r.folder.split("/")[-2] for r in rows.where("part IS NOT NULL").orderBy("part").collect()]
    assert len(runs) == 2 and runs[0] != runs[1]
    r1, r2, _ = ({r["stage"]: r["detail"] for r in run} for run in warehouse["runs"])
    assert r1["silver"].endswith("1 export(s) built, all") and r2["silver"].endswith("1 export(s) built")


def _snapshot(ts, names):
    from conftest import export_bytes
    return export_bytes([f"Notes of {ts}:", ""], [
        f"{n},Example,https://www.linkedin.com/in/{n.lower()},,{c},Analyst,04 Feb 2025" for n, c in names])


def test_history_under_late_and_several_exports(spark, tmp_path):
    """A newest export that changed nothing, two exports in one run, then a late
    one: the history always equals a replay of all exports."""
    lz, wh = f"{tmp_path}/landing", f"{tmp_path}/warehouse"
    steps = [
        [("20260101T000000Z", [("Ann", "A")])],
        [("20260301T000000Z", [("Ann", "A")])],
        [("20260401T000000Z", [("Ann", "B")]), ("20260501T000000Z", [("Ann", "C"), ("Cy", "A")])],
        [("20260201T000000Z", [("Ann", "A"), ("Bea", "A")])],
    ]
    how = []
    for step in steps:
        for ts, names in step:
            put(lz, ts, _snapshot(ts, names))
        rep = pipeline.run(spark, lz, wh, today=TODAY, ingested_at="2026-08-01 00:00:00").collect()
        how.append({r["stage"]: r["detail"] for r in rep}["scd2"])
        dim = tables.read_table(spark, wh, "dim_connection")
        want = scd2.replay(tables.read_table(spark, wh, "silver"))
        assert want.exceptAll(dim).count() == 0 and dim.exceptAll(want).count() == 0
    assert how == ["replayed (first run)", "applied 1 export(s)", "applied 2 export(s)",
                   "applied 1 export(s), 1 of them late"]
    bea = dim.where("first_name = 'Bea'").collect()
    assert [(r["valid_from"].month, r["valid_to"].month) for r in bea] == [(2, 3)]


def test_a_refused_batch_stays_out_of_silver(spark, tmp_path):
    from conftest import NOTES_V1, export_bytes
    lz, wh = f"{tmp_path}/landing", f"{tmp_path}/warehouse"
    put(lz, KEY_TS_V1, export_bytes(NOTES_V1, [
        "Ann,Example,https://www.linkedin.com/in/a,,Acme,Data Analyst,2025-02-04"]))
    with pytest.raises(pipeline.QualityGateError):
        pipeline.run(spark, lz, wh, today=TODAY)
    put(lz, KEY_TS_V2, EXPORT_V2)
    with pytest.raises(pipeline.QualityGateError):
        pipeline.run(spark, lz, wh, today=TODAY)
    rows, failed = pipeline.gate(spark, f"{wh}/bronze", r".*")
    assert {r["snapshot_ts"].day for r in rows.collect()} == {8} and failed
