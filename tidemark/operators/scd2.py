"""SCD Type 2 history of entities across exports.

* ``replay`` rebuilds the whole history in one pass (gaps and islands): a new
  version starts when an entity appears, re-appears after missing an export,
  or changes a tracked column (null-safe); it closes at the first export in
  which that version is no longer present.
* ``apply`` folds ONE new export into an existing history (check strategy,
  hard deletes close the open version) with a single full outer join.

* ``splice`` puts ONE late export into a history that already has later ones:
  only versions that cover the export before or the export after it can change
  (they end earlier, begin earlier, or are split), all others pass through.

``apply(replay(exports[:-1]), exports[-1]) == replay(exports)``, and ``splice``
in any order of arrival equals it too; the tests check both invariants. A version keeps the non-tracked values it was first
captured with. All windows are partitioned by entity and hold at most one row
per export, so no window group grows with the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.operators.fact import snapshot_sequence

DIM_COLUMNS = (
    "connection_id", "first_name", "last_name", "full_name", "email_address", "company",
    "company_label", "company_key", "position", "connected_on", "connected_on_date_key",
)
SCD_COLUMNS = (*DIM_COLUMNS, "source_snapshot_ts", "scd_id", "valid_from", "valid_to")


def scd_id_sql(entity: str, valid_from: str) -> str:
    e, v = sx.ref(entity), sx.ref(valid_from)
    return f"md5(concat(coalesce(CAST({e} AS STRING), ''), '|', coalesce(CAST({v} AS STRING), '')))"


def scd_id(entity: str | Column, valid_from: str | Column) -> Column:
    if isinstance(entity, str) and isinstance(valid_from, str):
        return F.expr(scd_id_sql(entity, valid_from))
    e = F.col(entity) if isinstance(entity, str) else entity
    v = F.col(valid_from) if isinstance(valid_from, str) else valid_from
    return F.md5(F.concat(F.coalesce(e.cast("string"), F.lit("")), F.lit("|"),
                          F.coalesce(v.cast("string"), F.lit(""))))


def _changed(a: str, b: str) -> str:
    """Null-safe inequality (SQL text)."""
    return f"NOT ({a} <=> {b})"


def replay(
    silver: DataFrame,
    *,
    entity: str = "connection_id",
    tracked: tuple[str, ...] = ("company", "position"),
    ts: str = "snapshot_ts",
    times: DataFrame | None = None,
) -> DataFrame:
    rows = silver.where("is_identifiable").select(*DIM_COLUMNS, ts)
    seq = snapshot_sequence(rows if times is None else times, ts).select(ts, "previous_snapshot_ts", "next_snapshot_ts")
    t = sx.ref(ts)
    w = f"OVER (PARTITION BY {sx.ref(entity)} ORDER BY {t})"
    starts = " OR ".join([
        f"lag({t}) {w} IS NULL", _changed(f"lag({t}) {w}", "previous_snapshot_ts"),
        *[_changed(f"lag({sx.ref(c)}) {w}", sx.ref(c)) for c in tracked],
    ])
    flagged = rows.join(seq, ts).selectExpr("*", f"{starts} AS _start")
    bounds = flagged.selectExpr("*", f"coalesce(lead(_start) {w}, TRUE) AS _end").where("_start OR _end")
    closes_at = f"CASE WHEN _end THEN next_snapshot_ts ELSE lead(next_snapshot_ts) {w} END"
    return bounds.selectExpr("*", f"{closes_at} AS valid_to").where("_start").selectExpr(
        *[sx.ref(c) for c in DIM_COLUMNS],
        f"{t} AS source_snapshot_ts",
        f"{scd_id_sql(entity, ts)} AS scd_id",
        f"{t} AS valid_from",
        "valid_to",
    )


def latest_export(silver: DataFrame, ts: str = "snapshot_ts") -> DataFrame:
    """Identified rows of the newest export (scalar subquery on max ts)."""
    ident = silver.where("is_identifiable")
    return ident.filter(F.col(ts) == ident.agg(F.max(ts)).scalar())


def apply(
    dim: DataFrame,
    latest: DataFrame,
    *,
    entity: str = "connection_id",
    tracked: tuple[str, ...] = ("company", "position"),
    ts: str = "snapshot_ts",
    at: Column | None = None,
) -> DataFrame:
    """Fold the newest export into the history; effective time = its snapshot ts
    (``at``, or found from the rows). ``dim`` is read twice, so give a table."""
    open_v = dim.where("valid_to IS NULL")
    closed_v = dim.where("valid_to IS NOT NULL")
    new = latest.selectExpr(*[sx.ref(c) for c in DIM_COLUMNS], f"{sx.ref(ts)} AS _eff")
    e = sx.ref(entity)
    j = open_v.alias("o").join(new.alias("n"), F.expr(f"o.{e} = n.{e}"), "full_outer") \
        .withColumn("_eff_ts", latest.agg(F.max(ts)).scalar() if at is None else at)
    has_o, has_n = f"(o.{e} IS NOT NULL)", f"(n.{e} IS NOT NULL)"
    differs = "(" + " OR ".join([_changed(f"o.{sx.ref(c)}", f"n.{sx.ref(c)}") for c in tracked] or ["FALSE"]) + ")"
    old = "named_struct(" + ", ".join([
        *[f"{sx.lit(c)}, o.{sx.ref(c)}" for c in DIM_COLUMNS],
        "'source_snapshot_ts', o.source_snapshot_ts", "'scd_id', o.scd_id",
        "'valid_from', o.valid_from",
        f"'valid_to', CASE WHEN NOT {has_n} OR {differs} THEN _eff_ts END",
    ]) + ")"
    fresh = "named_struct(" + ", ".join([
        *[f"{sx.lit(c)}, n.{sx.ref(c)}" for c in DIM_COLUMNS],
        "'source_snapshot_ts', n._eff", f"'scd_id', {scd_id_sql(f'n.{e}', 'n._eff')}",
        "'valid_from', n._eff", "'valid_to', CAST(NULL AS TIMESTAMP)",
    ]) + ")"
    out = j.selectExpr(
        f"explode(array(CASE WHEN {has_o} THEN {old} END, "
        f"CASE WHEN {has_n} AND (NOT {has_o} OR {differs}) THEN {fresh} END)) AS v"
    ).where("v IS NOT NULL").selectExpr("v.*")
    return out.unionByName(closed_v.select(*SCD_COLUMNS))


def splice(
    dim: DataFrame,
    late: DataFrame,
    following: DataFrame,
    *,
    at,
    previous_ts=None,
    following_ts=None,
    entity: str = "connection_id",
    tracked: tuple[str, ...] = ("company", "position"),
    ts: str = "snapshot_ts",
) -> DataFrame:
    """Put the identified rows of a late export (``late``, taken ``at``) into a
    history of other exports. ``previous_ts`` and ``following_ts`` are the
    exports next to it in time (None: there is none), ``following`` holds the
    identified rows of the latter: a version that the late export splits begins
    again there. ``dim`` is read three times, so give a table."""
    if following_ts is None:
        return apply(dim, late, entity=entity, tracked=tracked, ts=ts, at=F.lit(at))
    covers = lambda x: (F.col("valid_from") <= F.lit(x)) & (
        F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(x)))
    before = F.lit(False) if previous_ts is None else covers(previous_ts)
    e = sx.ref(entity)
    whole = "named_struct(" + ", ".join(f"{sx.lit(c)}, {sx.ref(c)}" for c in SCD_COLUMNS) + ")"
    taken = "named_struct(" + ", ".join(f"{sx.lit(c)}, {sx.ref(c)}" for c in DIM_COLUMNS) + ")"
    p = dim.where(before).selectExpr(f"{e} AS pe", f"{whole} AS p")
    n = dim.where(covers(following_ts)).selectExpr(f"{e} AS ne", f"{whole} AS n")
    new = late.selectExpr(f"{e} AS le", f"{taken} AS l")
    again = following.selectExpr(f"{e} AS ae", f"{taken} AS a")
    j = (p.join(new, F.expr("pe = le"), "full_outer").selectExpr("coalesce(pe, le) AS e1", "p", "l")
         .join(n, F.expr("e1 = ne"), "full_outer").selectExpr("coalesce(e1, ne) AS e2", "p", "l", "n")
         .join(again, F.expr("e2 = ae"), "left")
         .withColumn("_t", F.lit(at)).withColumn("_f", F.lit(following_ts)))
    equal = lambda a, b: " AND ".join([f"{a}.{sx.ref(c)} <=> {b}.{sx.ref(c)}" for c in tracked] or ["TRUE"])
    span = "(p IS NOT NULL AND n IS NOT NULL AND p.scd_id <=> n.scd_id)"
    goes_on = f"(l IS NOT NULL AND p IS NOT NULL AND {equal('p', 'l')})"
    begins = f"(l IS NOT NULL AND NOT {goes_on})"
    joins_next = f"({begins} AND n IS NOT NULL AND NOT {span} AND {equal('n', 'l')})"

    def version(row: str, begin: str, end: str) -> str:
        return "named_struct(" + ", ".join([
            *(f"{sx.lit(c)}, {row}.{sx.ref(c)}" for c in DIM_COLUMNS),
            f"'source_snapshot_ts', {begin}, 'scd_id', {scd_id_sql(f'{row}.{entity}', begin)}",
            f"'valid_from', {begin}, 'valid_to', {end}"]) + ")"

    ended = "named_struct(" + ", ".join([
        *(f"{sx.lit(c)}, p.{sx.ref(c)}" for c in SCD_COLUMNS[:-1]),
        f"'valid_to', CASE WHEN {goes_on} THEN p.valid_to ELSE _t END"]) + ")"
    out = j.selectExpr("explode(array(" + ", ".join([
        f"CASE WHEN p IS NOT NULL THEN {ended} END",
        f"CASE WHEN {begins} THEN {version('l', '_t', f'CASE WHEN {joins_next} THEN n.valid_to ELSE _f END')} END",
        f"CASE WHEN n IS NOT NULL AND NOT {span} AND NOT {joins_next} THEN n END",
        f"CASE WHEN {span} AND NOT {goes_on} THEN {version('a', '_f', 'p.valid_to')} END",
    ]) + ")) AS v").where("v IS NOT NULL").selectExpr("v.*")
    untouched = dim.where(~(before | covers(following_ts))).select(*SCD_COLUMNS)
    return out.select(*SCD_COLUMNS).unionByName(untouched)


def current(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("valid_to").isNull())


def recent_changes(dim: DataFrame, n: int | None = 25, entity: str = "connection_id") -> DataFrame:
    """Open versions next to the version immediately before them, newest first."""
    w = Window.partitionBy(entity).orderBy("valid_from")
    prev = dim.select(
        entity, "full_name", "company", "position", "valid_from", "valid_to",
        F.lag("company").over(w).alias("previous_company"),
        F.lag("position").over(w).alias("previous_position"),
        F.lag("valid_from").over(w).alias("_prev_from"),
    )
    out = prev.filter(F.col("valid_to").isNull() & F.col("_prev_from").isNotNull()).select(
        "full_name", "previous_company", "previous_position", "company", "position",
        F.col("valid_from").alias("changed_at"), entity,
    ).orderBy(F.desc("changed_at"), F.asc(entity))
    return out.limit(n) if n else out


def departed(dim: DataFrame, n: int | None = 25, entity: str = "connection_id",
             latest_only: bool = False) -> DataFrame:
    """Closed versions of entities that have no open version (one row per
    closed version; ``latest_only`` keeps the most recent per entity)."""
    open_keys = dim.filter(F.col("valid_to").isNull()).select(entity)
    closed = dim.filter(F.col("valid_to").isNotNull()).join(open_keys, entity, "left_anti")
    if latest_only:
        w = Window.partitionBy(entity).orderBy(F.desc("valid_to"))
        closed = closed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    out = closed.select(
        "full_name", "company", "position", F.col("valid_to").alias("absent_since"), entity
    ).orderBy(F.desc("absent_since"), F.asc(entity))
    return out.limit(n) if n else out


def history(dim: DataFrame, entity_id: str | None = None, entity: str = "connection_id") -> DataFrame:
    """Version history ordered by valid_from (one entity, or every entity)."""
    d = dim if entity_id is None else dim.filter(F.col(entity) == F.lit(entity_id))
    return d.select(
        entity, "company", "position", "valid_from", "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
        F.row_number().over(Window.partitionBy(entity).orderBy("valid_from")).alias("version"),
    ).orderBy(entity, "valid_from")
