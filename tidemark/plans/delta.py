"""Silver, fact, dimensions and marts brought up to date from new exports only.

Tables of rows per export are kept in parts, one per export (``tables.write_parts``);
a run writes the parts that the new exports change:

* Silver and breakdown: the new exports;
* fact: the new exports, the one before the first of them (its rows learn who
  left) and every later one (their sequence numbers move). For an export that is
  newest of all these are two parts, computed from three parts of Silver;
* stats: one row per export, those from the first new export on are replaced.

``company_links`` (employer, entity, first and last time, spelling at the last
time) gives first appearances and the employer dimension without the history:
minima and maxima merge, and it grows with the entities, not with the exports.

``exports_built`` (one row per export: its files and date bounds) is written
last. A run that died before has changed nothing that the next run, which takes
the same exports as new, does not write again. Files that came to an export
built before, or went, make the run a full one, since rows may disappear.

No export, or exports without rows or without an identified row: tables without
rows for them; stats and fact skip such exports in the sequence.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dims, marts
from tidemark.operators import fact as fact_ops
from tidemark.operators import silver as silver_ops
from tidemark.sources import tables
from tidemark.sources.tables import PART_SQL, at_parts

FACT = "fct_connection_snapshot"


class Plan(NamedTuple):
    """What a run has to build: ``files`` of every export by part, the parts that
    are ``new`` (all, if ``full``)."""

    files: dict[str, list[str]]
    new: list[str]
    full: bool


def exports_of(bronze: DataFrame) -> DataFrame:
    """(snapshot_ts, files) of Bronze rows, where no ledger gives them."""
    return bronze.groupBy("snapshot_ts").agg(F.array_sort(F.collect_set("file_hash")).alias("files"))


def plan(spark: SparkSession, root: str, exports: DataFrame) -> Plan:
    """Compare the exports that should be there with those built (one row each)."""
    want = {r.part: list(r.files) for r in exports.selectExpr(f"{PART_SQL} AS part", "files").collect()}
    built = tables.read_table(spark, root, "exports_built")
    if built is None:
        return Plan(want, sorted(want), True)
    have = {r.part: list(r.files) for r in built.select("part", "files").collect()}
    if any(want.get(p) != files for p, files in have.items()):
        return Plan(want, sorted(want), True)
    return Plan(want, sorted(set(want) - set(have)), False)


def build_silver(bronze: DataFrame, root: str, run_id: str, todo: Plan) -> DataFrame:
    """Write Silver of the new exports; returns the whole table."""
    rows = bronze if todo.full else bronze.where(at_parts(todo.new))
    return tables.write_parts(silver_ops.build_silver(rows), root, "silver", run_id,
                              replace=None if todo.full else todo.new)


def _parts(rows: DataFrame) -> list[str]:
    """Parts of the rows, in time order: at most one per export."""
    return sorted(r.part for r in rows.select("snapshot_ts").distinct().selectExpr(f"{PART_SQL} AS part").collect())


def _fact(spark: SparkSession, root: str, links: DataFrame, known: list[str], start: int) -> DataFrame:
    """Fact rows of the exports ``known[start:]``. Presence before and after is
    seen in the neighbouring exports, the first appearance in the links."""
    flow = fact_ops.fact_with_flow(tables.read_table(spark, root, "silver", known[max(start - 1, 0):]),
                                   tables.times_of(spark, known)).where(at_parts(known[start:]))
    if start == 0:
        return flow
    seen = links.groupBy("connection_id").agg(F.min("first_seen_ts").alias("_first"))
    return flow.join(seen, "connection_id").select(
        *[F.expr("snapshot_ts = _first").alias(c) if c == "is_first_appearance" else c for c in flow.columns])


def build_gold(spark: SparkSession, root: str, run_id: str, todo: Plan, dim: DataFrame,
               today: dt.date | str) -> list[str]:
    """Write fact, dimensions and marts after Silver; returns the parts of the
    fact that were written."""
    read = lambda name, parts=None: tables.read_table(spark, root, name, parts)
    fresh = read("silver", None if todo.full else todo.new)
    old_stats = None if todo.full else read("mart_network_stats")

    links = dims.company_links(fresh)
    if not todo.full:
        links = dims.merge_links(read("company_links").unionByName(links))
    links = tables.write_table(links, root, "company_links", run_id)

    arrived = _parts(fresh.where("is_identifiable"))
    known = sorted(set(arrived) | set([] if todo.full else _parts(old_stats)))
    touched: list[str] = []
    if todo.full or arrived:
        first = known.index(arrived[0]) if arrived else 0
        touched = known[max(first - 1, 0):]
        fact = tables.write_parts(_fact(spark, root, links, known, max(first - 1, 0)), root, FACT, run_id,
                                  replace=None if todo.full else touched)
        # the export before the first new one gives that one its losses
        stats = marts.network_stats(read(FACT, touched), read("silver", touched)).where(at_parts(known[first:]))
        if not todo.full:
            stats = old_stats.where(at_parts(known[:first])).unionByName(stats)
        tables.write_table(stats.coalesce(1), root, "mart_network_stats", run_id)
        counted = marts.breakdown(fact if todo.full else read(FACT, arrived))
        tables.write_parts(counted, root, "mart_network_breakdown", run_id, replace=None if todo.full else arrived)

    bounds = fresh.groupBy("snapshot_ts").agg(
        F.min("connected_on").alias("first_connected_on"), F.max("connected_on").alias("last_connected_on"),
        F.min("snapshot_date").alias("snapshot_date")).withColumn("part", F.expr(PART_SQL)).drop("snapshot_ts")
    built = spark.createDataFrame([(p, todo.files[p]) for p in todo.new], "part string, files array<string>").join(
        bounds, "part", "left")
    if not todo.full:
        built = read("exports_built").unionByName(built)
    built = built.checkpoint(eager=True)  # one row per export

    tables.write_table(dims.company_of_links(links, dim), root, "dim_company", run_id)
    days = built.selectExpr("explode(array(first_connected_on, last_connected_on)) AS connected_on", "snapshot_date")
    tables.write_table(dims.dim_date(days, today), root, "dim_date", run_id)
    tables.write_table(built.coalesce(1), root, "exports_built", run_id)
    return touched
