"""Employer reach and network-composition aggregates.

All of these are single partial aggregations (plus, for top-k outputs, a
TakeOrderedAndProject that keeps k rows per partition), so a hot employer or
family is combined map-side and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions import taxonomy as tx
from tidemark.functions.text import is_blank_sql
from tidemark.operators.silver import UNKNOWN_LABEL

# Reach weights and report sizes.
WEIGHT_CORE, WEIGHT_DATA_LEADER, WEIGHT_RECRUITER, WEIGHT_DATA_PERSON = 3, 3, 2, 1
REACH_TOP = 15
FAMILY_TOP = 15
DEPTH_TOP = 10
CONCENTRATION_TOP = 10
STRONGHOLD_MINIMUM = 3

REACH_COLUMNS = ("company", "reach", "core_peers", "data_people", "data_leaders", "recruiters",
                 "has_front_door", "connections")


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1))).cast("long")


def _count_if_sql(cond: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS BIGINT)"


def classify(df: DataFrame, target=tx.TARGET_FAMILIES, adjacent=tx.ADJACENT_FAMILIES,
             position: str = "position") -> DataFrame:
    """family, is_core, is_data, is_recruiter, is_data_leader per row."""
    with_tf = df.withColumns({"family": tx.job_family(position), "_tags": tx.role_tags(position)})
    is_data = sx.in_list("family", (*target, *adjacent))
    return with_tf.withColumns(
        {
            "is_core": F.expr(sx.in_list("family", target)),
            "is_data": F.expr(is_data),
            "is_recruiter": F.expr(tx.has_tag_sql("_tags", tx.RECRUITER_TALENT)),
            "is_data_leader": F.expr(f"{tx.leads_sql('_tags')} AND "
                                     f"({is_data} OR {tx.has_tag_sql('_tags', tx.TARGET_PEER)})"),
        }
    ).drop("_tags")


def company_reach(df: DataFrame, target=tx.TARGET_FAMILIES, adjacent=tx.ADJACENT_FAMILIES,
                  company: str = "company_name") -> DataFrame:
    """One row per named employer with the ways in; ordered reach desc, name asc."""
    c = sx.ref(company)
    named = classify(df, target, adjacent).where(
        f"NOT {is_blank_sql(company)} AND {c} != {sx.lit(UNKNOWN_LABEL)}")
    agg = named.groupBy(F.expr(f"{c} AS company")).agg(*[F.expr(e) for e in (
        "count(1) AS connections",
        f"{_count_if_sql('is_core')} AS core_peers",
        f"{_count_if_sql('is_data')} AS data_people",
        f"{_count_if_sql('is_data_leader')} AS data_leaders",
        f"{_count_if_sql('is_recruiter')} AS recruiters",
    )])
    reach = (f"core_peers * {WEIGHT_CORE} + data_leaders * {WEIGHT_DATA_LEADER} + "
             f"recruiters * {WEIGHT_RECRUITER} + data_people * {WEIGHT_DATA_PERSON}")
    return agg.selectExpr(
        "company", f"{reach} AS reach", "core_peers", "data_people", "data_leaders", "recruiters",
        "recruiters > 0 AS has_front_door", "connections",
    ).orderBy(F.desc("reach"), F.asc("company"))


def top_reach(reach: DataFrame, n: int = REACH_TOP) -> DataFrame:
    return reach.orderBy(F.desc("reach"), F.asc("company")).limit(n)


def summarise(reach: DataFrame) -> DataFrame:
    door, leaders, core = F.col("has_front_door"), F.col("data_leaders"), F.col("core_peers")
    return reach.agg(
        F.count(F.lit(1)).alias("companies"),
        _count_if(core > 0).alias("with_core"),
        _count_if(door).alias("front_door"),
        _count_if(~door & (leaders > 0)).alias("closed_with_leader"),
        _count_if((core > 0) & (leaders > 0) & door).alias("all_three"),
    )


def reach_filter(reach: DataFrame, door: str = "any", in_field: bool = True) -> DataFrame:
    """door: 'any' | 'has' | 'none'; in_field keeps employers with a core peer."""
    out = reach
    if door == "has":
        out = out.filter(F.col("has_front_door"))
    elif door == "none":
        out = out.filter(~F.col("has_front_door"))
    if in_field:
        out = out.filter(F.col("core_peers") > 0)
    return out


def family_counts(df: DataFrame, n: int = FAMILY_TOP, position: str = "position") -> DataFrame:
    return (
        df.groupBy(F.expr(f"{tx.job_family_sql(position)} AS family"))
        .agg(F.expr("count(1) AS connections"))
        .orderBy(F.desc("connections"), F.asc("family"))
        .limit(n)
    )


def family_depth(df: DataFrame, n: int = DEPTH_TOP, position: str = "position") -> DataFrame:
    top = (
        df.groupBy(F.expr(f"{tx.job_family_sql(position)} AS family"))
        .agg(F.expr("count(1) AS connections"),
             F.expr(f"{_count_if_sql(tx.seniority_sql(position))} AS senior"))
        .orderBy(F.desc("connections"), F.asc("family"))
        .limit(n)
    )
    return top.withColumn("senior_share", F.expr("100.0D * senior / connections"))


def tag_counts(df: DataFrame, position: str = "position") -> DataFrame:
    """Connections per role tag (multi-label) plus the untagged bucket."""
    preds = tx.tag_predicates_sql(position)
    any_tag = "(" + " OR ".join(preds.values()) + ")"
    wide = df.agg(*[F.expr(f"{_count_if_sql(preds[t])} AS `{t}`") for t in tx.ALL_TAGS],
                  F.expr(f"{_count_if_sql(f'NOT {any_tag}')} AS `{tx.UNTAGGED}`"))
    names = (*tx.ALL_TAGS, tx.UNTAGGED)
    stack = ", ".join(f"'{t}', `{t}`" for t in names)
    return wide.select(F.expr(f"stack({len(names)}, {stack}) AS (tag, connections)"))


def concentration(df: DataFrame, n: int = CONCENTRATION_TOP, minimum: int = STRONGHOLD_MINIMUM,
                  key: str = "company_key", company: str = "company") -> DataFrame:
    """Distinct employers, share of the network at the top-n employers, and
    employers with at least ``minimum`` people."""
    sizes = df.filter(F.col(company).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top_sum = sizes.orderBy(F.desc("n")).limit(n).agg(F.sum("n")).scalar()
    total = df.agg(F.count(F.lit(1))).scalar()
    return sizes.agg(
        F.count(F.lit(1)).alias("employers"),
        (F.lit(100.0) * F.coalesce(top_sum, F.lit(0)) / total).alias("top_share_pct"),
        _count_if(F.col("n") >= minimum).alias("employers_with_min"),
    )


def career_stage(df: DataFrame, position: str = "position") -> DataFrame:
    counts = {
        "senior": tx.seniority_sql(position),
        "early_career": tx.has_tag_sql(tx.role_tags_sql(position), tx.EARLY_CAREER),
        "with_email": "email_address IS NOT NULL",
        "no_company": "company IS NULL",
    }
    wide = df.agg(F.expr("count(1) AS connections"),
                  *[F.expr(f"{_count_if_sql(v)} AS {k}") for k, v in counts.items()])
    return wide.selectExpr(
        "connections",
        *[x for k in counts for x in (k, f"100.0D * {k} / connections AS {k}_pct")],
    )
