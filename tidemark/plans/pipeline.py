"""One pipeline run: ingest → gate → quality → Silver → SCD2 → Gold/marts →
mart tests → freshness. Returns a run-report DataFrame (stage, status,
detail); every stage's output is a versioned table, so a re-run is
idempotent and a failed run leaves the previous versions current. Silver, fact
and marts are brought up to date from the new exports (``plans/delta.py``); the
table tests run over the rows that the run wrote.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as dq, scd2
from tidemark.plans import delta
from tidemark.session import checkpoint_dir
from tidemark.sources import bronze as bz
from tidemark.sources import landing
from tidemark.sources import tables
from tidemark.sources.tables import at_parts

REPORT_SCHEMA = "stage string, status string, detail string, rows long"
GATE_SCHEMA = "batch_id string, passed boolean"
#: More new exports than this are folded in by one replay instead of one apply each.
MAX_APPLIES = 8


class QualityGateError(RuntimeError):
    """An error-severity check failed; downstream tables were not rebuilt."""


class StaleSourceError(RuntimeError):
    """The newest ingest is too old; downstream tables were not rebuilt."""


def bronze_suite(url_regex: str) -> list[dq.Check]:
    return [
        dq.row_count_at_least(1),
        dq.not_null("file_hash"), dq.not_null("snapshot_ts"), dq.not_null("source_object"),
        dq.not_null("ingested_at"), dq.length_eq("file_hash", 32),
        dq.matches("url", url_regex, mostly=dq.MIN_IDENTIFIABLE_SHARE),
        dq.matches("connected_on", dq.EXPORT_DATE_REGEX, mostly=1.0),
    ]


def gate(spark: SparkSession, bronze_path: str, url_regex: str) -> tuple[DataFrame, list[str]]:
    """Rows of the batches that passed the quality suite, and the checks that
    the undecided batches fail now. Verdicts are kept per batch, so a refused
    batch stays out of Silver until it passes."""
    path = f"{bronze_path}_gate"
    verdicts = bz.read_table_or_empty(spark, GATE_SCHEMA, path)
    rows = bz.read_bronze(spark, bronze_path, with_batch=True)
    done = verdicts.where("passed").select("batch_id").distinct()
    undecided = rows.join(done, "batch_id", "left_anti")
    checks = dq.run_checks(undecided, bronze_suite(url_regex), by=["batch_id", "snapshot_ts"]).where(
        F.col("severity") == dq.ERROR).checkpoint(eager=True)
    (checks.groupBy("batch_id").agg(F.bool_and("passed").alias("passed"))
     .write.mode("append").parquet(path))
    failed = [r["check"] for r in checks.where("not passed").select("check").distinct().collect()]
    passed = bz.read_table_or_empty(spark, GATE_SCHEMA, path).where("passed").select("batch_id").distinct()
    return rows.join(passed, "batch_id", "left_semi").drop("batch_id"), sorted(failed)


def accepted_exports(spark: SparkSession, bronze_path: str, gated: bool) -> DataFrame:
    """(snapshot_ts, files) of the ingested exports, from the ledger: those of
    batches that passed the gate, or of all batches."""
    files = bz.read_ledger(spark, bronze_path).where("status = 'ingested'")
    if gated:
        passed = bz.read_table_or_empty(spark, GATE_SCHEMA, f"{bronze_path}_gate").where("passed")
        files = files.join(passed, "batch_id", "left_semi")
    return delta.exports_of(files)


def new_rows(spark: SparkSession, bronze_path: str, todo: delta.Plan, gated: bool) -> DataFrame:
    """Bronze rows of the exports to build: all, or the folders of their dates."""
    rows = bz.read_bronze(spark, bronze_path, True) if todo.full else bz.read_exports(spark, bronze_path, todo.new, True)
    if gated:
        passed = bz.read_table_or_empty(spark, GATE_SCHEMA, f"{bronze_path}_gate").where("passed")
        rows = rows.join(passed, "batch_id", "left_semi")
    return rows.drop("batch_id")


def freshness(bronze: DataFrame, today: str) -> str:
    """``ok``; ``warn`` beyond 30 days since the newest ingest, ``error`` beyond 90."""
    checks = dq.run_checks(bronze, [dq.freshness("ingested_at", today, 30, dq.WARN),
                                    dq.freshness("ingested_at", today, 90, dq.ERROR)])
    failed = {r["severity"] for r in checks.where("not passed").select("severity").collect()}  # two rows at most
    return "error" if dq.ERROR in failed else "warn" if failed else "ok"


def next_history(silver: DataFrame, old_dim: DataFrame | None, applied: DataFrame | None,
                 fresh: DataFrame | None = None,
                 export: Callable[[dt.datetime | None], DataFrame] | None = None) -> tuple[DataFrame, str]:
    """The SCD2 history of all exports in Silver. New exports are folded in one
    by one: the newest of all by ``apply``, one that arrives late by ``splice``
    between its neighbours in time, which reads that export, the next one and
    the versions that cover them. All are replayed if there is no history, an
    applied export is gone, or more than ``MAX_APPLIES`` are new. ``fresh`` gives
    the times of new exports and ``export`` the rows of one, so that Silver is
    not scanned for them."""
    if old_dim is None or applied is None:
        return scd2.replay(silver), "replayed (first run)"
    rows = silver.where("is_identifiable")
    exports = (rows if fresh is None else fresh).select("snapshot_ts").distinct()
    pending = exports.join(applied, "snapshot_ts", "left_anti").checkpoint(eager=True)
    gone = fresh is None and applied.join(exports, "snapshot_ts", "left_anti").limit(1).count() > 0
    new = [r[0] for r in pending.orderBy("snapshot_ts").limit(MAX_APPLIES + 1).collect()]
    if gone or len(new) > MAX_APPLIES:
        return scd2.replay(silver), "replayed"
    dim, late = old_dim, 0
    export = export or (lambda ts: rows.where(F.col("snapshot_ts") == F.lit(ts)))
    for k, ts in enumerate(new):  # at most MAX_APPLIES, in the order of time
        known = applied.agg(F.max(F.when(F.col("snapshot_ts") < F.lit(ts), F.col("snapshot_ts"))).alias("previous"),
                            F.min(F.when(F.col("snapshot_ts") > F.lit(ts), F.col("snapshot_ts"))).alias("following")).first()
        before = max((x for x in (known.previous, new[k - 1] if k else None) if x is not None), default=None)
        late += known.following is not None
        dim = scd2.splice(dim, export(ts), export(known.following), at=ts, previous_ts=before,
                          following_ts=known.following).checkpoint(eager=True)
    return dim, f"applied {len(new)} export(s)" + (f", {late} of them late" if late else "")


def table_tests(bronze: DataFrame, silver: DataFrame, fact: DataFrame, company: DataFrame, calendar: DataFrame,
                dim: DataFrame, stats: DataFrame, breakdown: DataFrame, today: str,
                history: DataFrame | None = None) -> DataFrame:
    """Every check of the tables that a run builds, one row per check. Silver,
    fact and breakdown may be the parts that a run wrote; ``history`` is then the
    whole fact, for the one check that compares exports."""
    flow = ("total_connections", "new_connections", "lost_connections", "distinct_companies",
            "restricted_profile_rows")
    parts = [
        dq.run_checks(silver, [
            dq.unique("snapshot_ts", "connection_id", where=F.col("is_identifiable")),
            dq.not_null("connection_id", where=F.col("is_identifiable")), dq.not_null("snapshot_ts"),
            dq.not_null("company_key"),
            dq.in_range("connected_on", dt.date(2003, 5, 5), dt.date.fromisoformat(today))]),
        dq.run_checks(fact, [
            dq.unique("connection_snapshot_key"), dq.not_null("connection_id"), dq.not_null("snapshot_ts"),
            dq.relationship("company_key", company, "company_key"),
            dq.relationship("snapshot_date_key", calendar, "date_key"),
            dq.Check("facts_have_an_entity", failures=lambda f: dq.fact_orphans(f, dim))]),
        dq.run_checks(company, [dq.unique("company_key"), dq.not_null("company_name")]),
        dq.run_checks(calendar, [dq.unique("date_key")]),
        dq.run_checks(dim, [dq.unique("scd_id"), dq.not_null("valid_from"),
                            dq.Check("one_open_version", failures=dq.one_open_version)]),
        dq.run_checks(stats, [dq.unique("snapshot_ts"), dq.in_range("email_coverage_pct", 0, 100),
                              *(dq.in_range(c, 0) for c in flow)]),
        dq.run_checks(breakdown, [
            dq.accepted_values("dimension_type", ("company", "position", "connected_year_month")),
            dq.unique("snapshot_ts", "dimension_type", "dimension_value")]),
        dq.run_checks(stats, [dq.Check("counts_agree", failures=lambda s: dq.counts_agree(s, breakdown).where(
            "not agrees"))]),
        dq.run_checks(bronze, [dq.Check("one_file_per_snapshot", dq.WARN, failures=dq.one_batch_per_snapshot)]),
        dq.run_checks(silver, [dq.Check("identifiable_share", dq.WARN, failures=lambda s: dq.identifiable_share(
            s).where("below_threshold"))]),
        dq.run_checks(fact if history is None else history, [dq.Check(
            "volume_anomaly", dq.WARN, failures=lambda f: dq.volume_anomaly(f).where("is_anomalous"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run(spark: SparkSession, landing_dir: str, warehouse: str, *, force: bool = False,
        today: dt.date | str | None = None, url_regex: str = dq.PROFILE_URL_REGEX,
        ingested_at=None, fail_on_quality: bool = True, fail_on_stale: bool = False) -> DataFrame:
    today = str(today or dt.date.today())
    run_id = "run=" + dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    bronze_path = f"{warehouse}/bronze"
    checkpoint_dir(spark)
    report: list[tuple[str, str, str, int | None]] = []

    def note(stage: str, status: str, detail: str, rows: int | None = None) -> None:
        report.append((stage, status, detail, rows))

    results = landing.ingest(spark, landing_dir, bronze_path, ingested_at=ingested_at,
                             on_mismatch="quarantine")
    summary = landing.ingest_report(results).first()
    note("ingest", "ok", str(summary.asDict()), summary["rows_ingested"])
    if not (summary["objects_ingested"] or force):
        note("gate", "skipped", "no new data and force is off")
        return spark.createDataFrame(report, REPORT_SCHEMA)
    note("gate", "ok", "new data" if summary["objects_ingested"] else "forced")

    bronze, failed = gate(spark, bronze_path, url_regex)
    note("quality", "failed" if failed else "ok", ", ".join(failed) or "all checks passed")
    if failed:
        if fail_on_quality:
            raise QualityGateError("bronze checks failed: " + report[-1][2])
        bronze = bz.read_bronze(spark, bronze_path)  # the caller takes refused batches too

    stale = freshness(bronze, today)
    if stale == "error" and fail_on_stale:
        raise StaleSourceError(f"no ingest within 90 days of {today}")
    gated = not failed
    todo = delta.plan(spark, warehouse, accepted_exports(spark, bronze_path, gated))
    silver = delta.build_silver(new_rows(spark, bronze_path, todo, gated), warehouse, run_id, todo)
    note("silver", "ok", f"{run_id}: {len(todo.new)} export(s) built" + (", all" if todo.full else ""), silver.count())

    read = lambda name, parts=None: tables.read_table(spark, warehouse, name, parts)
    built = read("silver", None if todo.full else todo.new)  # the rows that this run wrote
    applied, stamps = read("dim_connection_applied"), built.where("is_identifiable").select("snapshot_ts").distinct()
    if todo.full:
        new_dim, how = next_history(silver, None, None)
        how = how if applied is None else "replayed"
    else:
        new_dim, how = next_history(silver, read("dim_connection"), applied, stamps, lambda ts: read(
            "silver", [] if ts is None else [tables.part_of(ts)]).where("is_identifiable"))
        stamps = stamps.unionByName(applied).distinct()
    dim = tables.write_table(new_dim, warehouse, "dim_connection", run_id)
    tables.write_table(stamps, warehouse, "dim_connection_applied", run_id)
    note("scd2", "ok", how, dim.count())

    touched = delta.build_gold(spark, warehouse, run_id, todo, dim, today)
    fact, stats = read(delta.FACT), read("mart_network_stats")
    company, calendar = read("dim_company"), read("dim_date")
    note("gold", "ok", f"fact of {len(touched)} export(s) written", fact.count())

    new = stats.where(at_parts(todo.new))
    tests = table_tests(bronze, built, read(delta.FACT, touched), company, calendar, dim, new,
                        read("mart_network_breakdown", todo.new), today, history=fact)
    bad = tests.where("not passed").select("check", "severity").collect()
    level = "failed" if any(r["severity"] == dq.ERROR for r in bad) else "warn" if bad else "ok"
    note("tests", level, ", ".join(sorted(r["check"] for r in bad)) or "all tests passed")
    agree = any(r["check"] == "counts_agree" for r in bad)
    note("counts_agree", "failed" if agree else "ok", "stats and breakdown marts")

    note("freshness", stale, f"newest ingested_at vs {today}")
    return spark.createDataFrame(report, REPORT_SCHEMA)
