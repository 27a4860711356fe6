"""Truth tables for the title taxonomies (tags, families, seniority)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import taxonomy as tx
from tidemark.operators import rules

#: Own titles; the tags follow from the keyword tables by hand.
TAG_CASES = [
    (None, []), ("", []), (" \t", []), ("Baker", []), ("Hrvatska guide", []), ("Headphone tuner", []),
    ("Biathlon coach", []), ("Datum keeper", []), ("Cologne guide", []), ("Leaderboard artist", []),
    ("night-shift SOURCER", [tx.RECRUITER_TALENT]), ("HR desk", [tx.RECRUITER_TALENT]),
    ("People person", [tx.RECRUITER_TALENT]), ("Stage Director", [tx.LEADERSHIP]),
    ("Head chef", [tx.LEADERSHIP]), ("CXO office", [tx.EXECUTIVE]), ("cmo", [tx.EXECUTIVE]),
    ("Deputy CPO", [tx.EXECUTIVE]), ("Vice President, Rivers", [tx.EXECUTIVE]),
    ("Data gardener", [tx.TARGET_PEER]), ("QA baker", [tx.ENGINEERING]), ("Summer Intern", [tx.EARLY_CAREER]),
    ("Trainee front-end tester", [tx.ENGINEERING, tx.EARLY_CAREER]),
    ("People lead and founder", [tx.RECRUITER_TALENT, tx.LEADERSHIP, tx.EXECUTIVE]),
    ("Student data developer", [tx.TARGET_PEER, tx.ENGINEERING, tx.EARLY_CAREER]),
]

#: Every keyword, on its own, belongs to the first family that lists a keyword
#: found in it; and a few own titles where an earlier rule must win.
FAMILY_CASES = [
    ("dbt gardener", "Analytics Engineering"), ("Databricks chef", "Data Engineering"),
    ("Court statistician", "Data Science"), ("llm whisperer", "AI / Machine Learning"),
    ("tableau painter", "Business Intelligence"), ("BA, harbour", "Business Analysis"),
    ("Insights baker", "Data Analytics"), ("Sourcer of tea", "Talent & Recruiting"),
    ("Product baker", "Product"), ("UX baker", "Design"), ("Helpdesk baker", "IT & Security"),
    ("SRE on boats", "Software Engineering"), ("Tax baker", "Finance & Accounting"),
    ("SEO baker", "Sales & Marketing"), ("Advisor to bakers", "Consulting"), ("Tutor", "Academia & Study"),
    ("Logistics baker", "Operations & Delivery"), ("Owner of boats", "Founder & Executive"),
    ("River analyst", "Business Analysis"), ("Baker", "Other"), (None, "Other"), ("", "Other"),
    ("dbt and ETL", "Analytics Engineering"), ("ETL and BI", "Data Engineering"),
    ("network engineer of software", "IT & Security"), ("designer of products", "Design"),
]

SENIORITY_CASES = [
    ("SENIOR baker", True), ("Staff pilot", True), ("Expert tea taster", True), ("Head chef", True),
    ("Seniority scholar", False), ("Baker", False), (None, False), ("", False),
]


def _titles(spark, cases):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, position string")


def test_role_tags_truth_table(spark):
    got = _titles(spark, TAG_CASES).select("i", tx.role_tags("position").alias("t")).collect()
    by_i = {r["i"]: list(r["t"]) for r in got}
    for i, (title, expected) in enumerate(TAG_CASES):
        assert by_i[i] == expected, title


def test_job_family_truth_table(spark):
    got = _titles(spark, FAMILY_CASES).select("i", tx.job_family("position").alias("f")).collect()
    by_i = {r["i"]: r["f"] for r in got}
    for i, (title, expected) in enumerate(FAMILY_CASES):
        assert by_i[i] == expected, title


def test_seniority_truth_table(spark):
    df = _titles(spark, SENIORITY_CASES).select("i", tx.seniority(F.col("position")).alias("s"))
    by_i = {r["i"]: r["s"] for r in df.collect()}
    for i, (title, expected) in enumerate(SENIORITY_CASES):
        assert by_i[i] is expected, title


def test_every_title_lands_in_exactly_one_known_family(spark):
    fams = {r["f"] for r in _titles(spark, FAMILY_CASES)
            .select(tx.job_family("position").alias("f")).collect()}
    assert fams <= set(tx.ALL_JOB_FAMILIES)


def test_rules_table_matches_the_column_form(spark):
    df = _titles(spark, FAMILY_CASES)
    table = rules.apply_rules(df, rules.rules_frame(spark, tx.JOB_FAMILY_RULES), "position",
                              mode="first", default=tx.OTHER_FAMILY, out="family")
    col = df.select("i", tx.job_family("position").alias("family"))
    assert sorted(map(tuple, table.select("i", "family").collect())) == \
        sorted(map(tuple, col.collect()))


def test_rules_table_all_mode_keeps_rule_order(spark):
    df = _titles(spark, TAG_CASES)
    table = rules.apply_rules(df, rules.rules_frame(spark, tx.TAG_KEYWORDS), "position",
                              mode="all", out="tags")
    got = {r["i"]: list(r["tags"]) for r in table.collect()}
    # C-level titles are caught by an extra pattern the keyword table does not carry
    for i, (title, expected) in enumerate(TAG_CASES):
        if title in ("cmo", "Deputy CPO"):
            continue
        assert got[i] == expected, title


def test_taxonomy_is_a_projection_without_python(spark):
    plan = _titles(spark, TAG_CASES).select(
        tx.role_tags("position"), tx.job_family("position"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
