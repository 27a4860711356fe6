"""Declarative data-quality checks and one runner.

``run_checks(df, checks, by=None)`` returns ONE DataFrame
``(check, severity, failed_rows, passed)`` (plus the ``by`` columns). Every
column-level check is an aggregate expression, so all of them are evaluated
in a single scan — one ``agg`` (or one partial ``groupBy(by).agg`` for
per-export results). Key-level checks (unique keys, foreign keys) are their
own aggregate / anti-join and are unioned in. Nothing is collected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx

ERROR, WARN = "error", "warn"

# The export's profile-URL and date-format contracts.
PROFILE_URL_REGEX = r"^https://(?:www\.)?linkedin\.com/in/[^\s]+$"
EXPORT_DATE_REGEX = r"^\d{1,2} [A-Za-z]{3} \d{4}$"
MIN_IDENTIFIABLE_SHARE = 0.90
RESULT_COLUMNS = ("check", "severity", "failed_rows", "passed")


def _n_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1))).cast("long")


@dataclass(frozen=True)
class Check:
    name: str
    severity: str = ERROR
    #: aggregate expressions (name → Column) evaluated in the shared scan
    metrics: dict[str, Column] = field(default_factory=dict)
    #: (metric columns) → (failed_rows, passed)
    verdict: Callable[[dict[str, Column]], tuple[Column, Column]] | None = None
    #: key-level check: df → DataFrame of failing keys/rows
    failures: Callable[[DataFrame], DataFrame] | None = None


def _metric_check(name, severity, metrics, verdict) -> Check:
    return Check(name=name, severity=severity, metrics=metrics, verdict=verdict)


def row_count_at_least(n: int = 1, severity: str = ERROR) -> Check:
    return _metric_check(
        f"row_count_at_least_{n}", severity, {"n": F.count(F.lit(1))},
        lambda m: (F.when(m["n"] < n, 1).otherwise(0).cast("long"), m["n"] >= n),
    )


def not_null(col: str, where: Column | None = None, severity: str = ERROR) -> Check:
    cond = F.col(col).isNull() & (where if where is not None else F.lit(True))
    return _metric_check(f"not_null:{col}", severity, {"f": _n_if(cond)},
                         lambda m: (m["f"], m["f"] == 0))


def length_eq(col: str, length: int, severity: str = ERROR) -> Check:
    cond = F.col(col).isNotNull() & (F.length(col) != length)
    return _metric_check(f"length_eq_{length}:{col}", severity, {"f": _n_if(cond)},
                         lambda m: (m["f"], m["f"] == 0))


def matches(col: str, pattern: str, mostly: float = 1.0, severity: str = ERROR) -> Check:
    """Regex expectation: nulls are left out of the denominator, blanks fail."""
    c = F.col(col)
    return _metric_check(
        f"matches:{col}", severity,
        {"f": _n_if(c.isNotNull() & ~c.rlike(pattern)), "nn": F.count(c)},
        lambda m: (m["f"], (m["nn"] == 0) | ((m["nn"] - m["f"]) / m["nn"] >= F.lit(mostly))),
    )


def accepted_values(col: str, values, severity: str = ERROR) -> Check:
    bad = F.coalesce(~F.col(col).isin(*values), F.lit(False))
    return _metric_check(f"accepted_values:{col}", severity, {"f": _n_if(bad)},
                         lambda m: (m["f"], m["f"] == 0))


def in_range(col: str, lo=None, hi=None, severity: str = ERROR) -> Check:
    """Inclusive range; nulls are not failures."""
    c = F.col(col)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= F.lit(lo))
    if hi is not None:
        ok = ok & (c <= F.lit(hi))
    bad = F.coalesce(~ok, F.lit(False))
    return _metric_check(f"in_range:{col}", severity, {"f": _n_if(bad)},
                         lambda m: (m["f"], m["f"] == 0))


def freshness(col: str, now: dt.date | str, max_age_days: int, severity: str) -> Check:
    """Fails when the newest ``col`` is older than ``max_age_days`` at ``now``."""
    age = F.datediff(F.lit(str(now)).cast("date"), F.max(col).cast("date"))
    return _metric_check(
        f"freshness_{severity}:{col}", severity, {"age": age},
        lambda m: (F.when(m["age"] > max_age_days, 1).otherwise(0).cast("long"),
                   F.coalesce(m["age"] <= max_age_days, F.lit(False))),
    )


def unique(*cols: str, where: Column | None = None, severity: str = ERROR) -> Check:
    """Keys occurring more than once (single column: nulls ignored)."""
    def failing(df: DataFrame) -> DataFrame:
        d = df.filter(where) if where is not None else df
        if len(cols) == 1:
            d = d.where(f"`{cols[0]}` IS NOT NULL")
        return d.groupBy(*cols).agg(F.expr("count(1) AS _n")).where("_n > 1")

    return Check(name=f"unique:{','.join(cols)}", severity=severity, failures=failing)


def relationship(col: str, parent: DataFrame, parent_col: str, severity: str = ERROR) -> Check:
    """Child rows whose non-null ``col`` has no match in ``parent``."""
    def failing(df: DataFrame) -> DataFrame:
        keys = parent.select(F.col(parent_col).alias(col)).distinct()
        return df.filter(F.col(col).isNotNull()).join(keys, col, "left_anti")

    return Check(name=f"relationship:{col}", severity=severity, failures=failing)


def columns_exact(expected, severity: str = ERROR) -> Check:
    """The column set (schema metadata, no data scan) equals ``expected``."""
    def failing(df: DataFrame) -> DataFrame:
        got, want = set(df.columns), set(expected)
        diff = sorted(got ^ want)
        spark = df.sparkSession
        return spark.createDataFrame([(c,) for c in diff], "column string")

    return Check(name="columns_exact", severity=severity, failures=failing)


def run_checks(df: DataFrame, checks: list[Check], by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    parts: list[DataFrame] = []
    agg_checks = [c for c in checks if c.verdict is not None]
    if agg_checks:
        exprs = [e.alias(f"c{i}_{k}") for i, c in enumerate(agg_checks) for k, e in c.metrics.items()]
        wide = df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
        rows = []
        for i, c in enumerate(agg_checks):
            failed, passed = c.verdict({k: F.col(f"c{i}_{k}") for k in c.metrics})
            rows.append(F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"),
                                 failed.cast("long").alias("failed_rows"),
                                 F.coalesce(passed, F.lit(False)).alias("passed")))
        parts.append(wide.select(*by, F.inline(F.array(*rows))))
    for c in checks:
        if c.failures is None:
            continue
        if by:
            raise ValueError(f"check {c.name} cannot be grouped")
        n = c.failures(df).agg(F.expr("count(1) AS failed_rows"))
        parts.append(n.selectExpr(f"{sx.lit(c.name)} AS check", f"{sx.lit(c.severity)} AS severity",
                                  "failed_rows", "failed_rows = 0 AS passed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suite_report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Evaluated / successful / failed check names (sorted) / overall success."""
    by = list(by or [])
    agg = [
        F.count(F.lit(1)).alias("evaluated"),
        _n_if(F.col("passed")).alias("successful"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failed_checks"),
        F.bool_and("passed").alias("success"),
    ]
    return results.groupBy(*by).agg(*agg) if by else results.agg(*agg)


# --- export-level (singular) checks -------------------------------------------------
def restricted_rows(bronze: DataFrame, identity_cols=("url", "first_name", "last_name",
                                                       "company", "position"),
                    by: list[str] | None = None) -> DataFrame:
    """Rows whose identity columns are all blank (restricted profiles)."""
    from tidemark.functions.text import trim_ws

    blank = F.lit(True)
    for c in identity_cols:
        blank = blank & (F.coalesce(trim_ws(c), F.lit("")) == "")
    by = list(by or [])
    e = _n_if(blank).alias("restricted_profile_rows")
    return bronze.groupBy(*by).agg(e) if by else bronze.agg(e)


def identifiable_share(silver: DataFrame, minimum: float = 0.90) -> DataFrame:
    """Per export: total, identifiable, share and whether it is below ``minimum``."""
    per = silver.groupBy("snapshot_ts").agg(
        F.count(F.lit(1)).alias("total_rows"),
        _n_if(F.col("is_identifiable")).alias("identifiable_rows"),
    )
    share = F.col("identifiable_rows").cast("double") / F.when(F.col("total_rows") != 0,
                                                              F.col("total_rows"))
    return per.withColumn("identifiable_share", share).withColumn(
        "below_threshold", F.coalesce(F.col("identifiable_share") < minimum, F.lit(False)))


def volume_anomaly(fact: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per export: rows, previous export's rows, relative change, anomaly flag.
    The lag runs over one row per export (a tiny ordered window)."""
    per = fact.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("connection_count"))
    w = Window.orderBy("snapshot_ts")
    prev = F.lag("connection_count").over(w)
    rel = F.abs(F.col("connection_count") - F.col("previous_count")) / F.when(
        F.col("previous_count") != 0, F.col("previous_count").cast("double"))
    return per.withColumn("previous_count", prev).withColumn("relative_change", rel).withColumn(
        "is_anomalous", F.coalesce(F.col("relative_change") > threshold, F.lit(False)))


def one_open_version(dim: DataFrame, entity: str = "connection_id") -> DataFrame:
    return (dim.filter(F.col("valid_to").isNull()).groupBy(entity)
            .agg(F.count(F.lit(1)).alias("open_versions")).filter("open_versions > 1"))


def one_batch_per_snapshot(bronze: DataFrame) -> DataFrame:
    return (bronze.groupBy("snapshot_ts")
            .agg(F.count_distinct("file_hash").alias("batches")).filter("batches > 1"))


def fact_orphans(fact: DataFrame, dim: DataFrame, entity: str = "connection_id") -> DataFrame:
    """Fact rows of the newest export whose entity has no version in the dimension."""
    latest = fact.filter(F.col("snapshot_ts") == fact.agg(F.max("snapshot_ts")).scalar())
    return latest.join(dim.select(entity).distinct(), entity, "left_anti").select(
        entity, "snapshot_ts")


def counts_agree(stats: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Per export: employer count in the stats mart vs company rows in the
    breakdown mart (unknown excluded on both sides) and whether they agree."""
    from tidemark.operators.silver import UNKNOWN_LABEL

    bd = (breakdown.filter((F.col("dimension_type") == "company")
                           & (F.col("dimension_value") != UNKNOWN_LABEL))
          .groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("breakdown_company_count")))
    j = stats.select("snapshot_ts", "distinct_companies").join(bd, "snapshot_ts", "left")
    n = F.coalesce("breakdown_company_count", F.lit(0))
    return j.select("snapshot_ts", "distinct_companies", n.alias("breakdown_company_count"),
                    (F.col("distinct_companies") == n).alias("agrees"))
