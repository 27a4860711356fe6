"""Keyword taxonomies over free-text job titles, compiled to Column expressions.

Each label becomes ONE case-insensitive, Unicode-aware word-boundary
alternation evaluated by ``rlike`` (the pattern is compiled once per task),
so a whole taxonomy is a handful of regex predicates inside a projection —
no Python on the data path and no codegen-busting expression trees.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx

# ---------------------------------------------------------------------------
# Role tags (multi-label) in taxonomy order, each with its
# keywords. Every keyword matches on word boundaries, ignoring case.
# ---------------------------------------------------------------------------
RECRUITER_TALENT = "recruiter_talent"
LEADERSHIP = "leadership"
EXECUTIVE = "executive"
TARGET_PEER = "target_peer"
ENGINEERING = "engineering"
EARLY_CAREER = "early_career"

TAG_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (RECRUITER_TALENT, ("recruiter", "recruiting", "recruitment", "staffing", "headhunter",
                        "talent", "sourcer", "hr", "human resources", "people")),
    (LEADERSHIP, ("manager", "management", "director", "head", "lead", "leader",
                  "leadership", "principal")),
    (EXECUTIVE, ("chief", "vp", "vice president", "founder", "co-founder", "president", "cxo")),
    (TARGET_PEER, ("data", "analytics", "business intelligence", "bi", "data science",
                   "data scientist", "data engineer", "data engineering")),
    (ENGINEERING, ("engineer", "engineering", "developer", "development", "software",
                   "programmer", "architect", "devops", "sre", "backend", "back-end",
                   "frontend", "front-end", "fullstack", "full-stack", "qa", "tester")),
    (EARLY_CAREER, ("intern", "internship", "student", "fresher", "trainee", "graduate",
                    "apprentice", "junior")),
)
#: C-level titles (CEO, CTO, CFO…) also count as executive.
C_LEVEL_PATTERN = r"\bc[a-z]o\b"
#: Seniority words not already implied by a leadership or executive tag.
SENIORITY_WORDS = ("senior", "sr", "staff", "expert", "principal", "lead")

# ---------------------------------------------------------------------------
# Job families (single-label), in match order — first rule wins.
# ---------------------------------------------------------------------------
OTHER_FAMILY = "Other"
JOB_FAMILY_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Analytics Engineering", ("analytics engineer", "analytic engineer", "dbt")),
    ("Data Engineering", ("data engineer", "data engineering", "big data", "etl", "elt",
                          "data platform", "data infrastructure", "data architect",
                          "data warehouse", "databricks", "data pipeline")),
    ("Data Science", ("data scientist", "data science", "statistician")),
    ("AI / Machine Learning", ("machine learning", "ml engineer", "ai engineer", "deep learning",
                               "nlp", "computer vision", "ai", "ml", "llm", "generative ai")),
    ("Business Intelligence", ("business intelligence", "bi", "power bi", "tableau", "looker",
                               "qlik", "data intelligence")),
    ("Business Analysis", ("business analyst", "business analysis", "ba")),
    ("Data Analytics", ("data analyst", "data analytics", "analytics", "analytics manager",
                        "insight analyst", "insights", "reporting analyst",
                        "reporting specialist")),
    ("Talent & Recruiting", ("recruiter", "recruiting", "recruitment", "talent", "sourcer", "hr",
                             "human resources", "people operations", "people partner")),
    ("Product", ("product manager", "product owner", "product lead", "product")),
    ("Design", ("designer", "design", "ux", "ui", "graphic", "creative", "art director")),
    ("IT & Security", ("cyber security", "cybersecurity", "information security", "infosec",
                       "security analyst", "security engineer", "it support",
                       "information technology support", "help desk", "helpdesk",
                       "service desk", "system administrator", "sysadmin",
                       "systems engineer", "network engineer", "technical support")),
    ("Software Engineering", ("software engineer", "software", "developer", "development",
                              "engineer", "engineering", "programmer", "devops", "sre",
                              "backend", "back-end", "frontend", "front-end", "fullstack",
                              "full-stack", "architect", "qa", "tester",
                              "quality assurance")),
    ("Finance & Accounting", ("finance", "financial", "accountant", "accounting", "audit",
                              "auditor", "tax", "banking", "credit", "investment", "treasury",
                              "actuary", "actuarial")),
    ("Sales & Marketing", ("sales", "marketing", "business development", "account manager",
                           "account executive", "growth", "seo", "brand", "advertising",
                           "customer success", "partnership")),
    ("Consulting", ("consultant", "consulting", "advisory", "advisor")),
    ("Academia & Study", ("student", "lecturer", "professor", "researcher", "research", "phd",
                          "teaching", "teacher", "university", "tutor")),
    ("Operations & Delivery", ("operations", "operation", "supply chain", "logistics",
                               "project manager", "programme manager", "program manager",
                               "scrum", "agile", "delivery manager")),
    ("Founder & Executive", ("founder", "co-founder", "cofounder", "ceo", "cto", "coo", "cfo",
                             "cio", "chief", "vp", "vice president", "president", "owner",
                             "managing director", "partner")),
    ("Business Analysis", ("analyst",)),
)
#: Families the searcher applies for, and neighbouring ones.
TARGET_FAMILIES = ("Business Intelligence", "Data Analytics", "Data Engineering",
                   "Analytics Engineering")
ADJACENT_FAMILIES = ("Data Science", "AI / Machine Learning", "Business Analysis",
                     "Software Engineering", "Product")
# --- end of fixed values ----------------------------------------------------

ALL_TAGS: tuple[str, ...] = tuple(tag for tag, _ in TAG_KEYWORDS)
ALL_JOB_FAMILIES: tuple[str, ...] = (*dict.fromkeys(f for f, _ in JOB_FAMILY_RULES), OTHER_FAMILY)
UNTAGGED = "untagged"


def keyword_regex(keywords: tuple[str, ...] | list[str], *, unicode: bool = True) -> str:
    """One alternation matching any keyword as a whole word, case-insensitively."""
    flags = "(?iU)" if unicode else "(?i)"
    return flags + r"\b(?:" + "|".join(re.escape(k) for k in keywords) + r")\b"


def matches_any_sql(c: str, keywords) -> str:
    """SQL text of :func:`matches_any` (``c`` is a column name or SQL text)."""
    return f"coalesce({sx.ref(c)} RLIKE {sx.lit(keyword_regex(tuple(keywords)))}, FALSE)"


def matches_any(c: str | Column, keywords) -> Column:
    """Null-safe word match: false for a null title.

    No trimming is needed: surrounding blanks never change a word-boundary
    match, and an all-blank title matches no keyword.
    """
    if isinstance(c, str):
        return F.expr(matches_any_sql(c, keywords))
    return F.coalesce(c.rlike(keyword_regex(tuple(keywords))), F.lit(False))


def tag_predicates_sql(c: str) -> dict[str, str]:
    preds = {tag: matches_any_sql(c, kws) for tag, kws in TAG_KEYWORDS}
    c_level = f"coalesce({sx.ref(c)} RLIKE {sx.lit('(?iU)' + C_LEVEL_PATTERN)}, FALSE)"
    preds[EXECUTIVE] = f"({preds[EXECUTIVE]} OR {c_level})"
    return preds


def tag_predicates(c: str | Column) -> dict[str, Column]:
    if isinstance(c, str):
        return {t: F.expr(p) for t, p in tag_predicates_sql(c).items()}
    preds = {tag: matches_any(c, kws) for tag, kws in TAG_KEYWORDS}
    c_level = F.coalesce(c.rlike("(?iU)" + C_LEVEL_PATTERN), F.lit(False))
    preds[EXECUTIVE] = preds[EXECUTIVE] | c_level
    return preds


def role_tags_sql(c: str) -> str:
    preds = tag_predicates_sql(c)
    items = ", ".join(f"CASE WHEN {preds[t]} THEN {sx.lit(t)} END" for t in ALL_TAGS)
    return f"filter(array({items}), x -> x IS NOT NULL)"


def role_tags(c: str | Column) -> Column:
    """array<string> of every matching tag, in taxonomy order ([] when none)."""
    if isinstance(c, str):
        return F.expr(role_tags_sql(c))
    preds = tag_predicates(c)
    return F.filter(
        F.array(*[F.when(preds[t], F.lit(t)) for t in ALL_TAGS]), lambda x: x.isNotNull()
    )


def job_family_sql(c: str, rules=JOB_FAMILY_RULES) -> str:
    return sx.case_when([(matches_any_sql(c, kws), sx.lit(family)) for family, kws in rules],
                        sx.lit(OTHER_FAMILY))


def job_family(c: str | Column, rules=JOB_FAMILY_RULES) -> Column:
    """The first family whose keywords match; 'Other' when none does."""
    if isinstance(c, str):
        return F.expr(job_family_sql(c, rules))
    expr = None
    for family, kws in rules:
        pred = matches_any(c, kws)
        expr = F.when(pred, F.lit(family)) if expr is None else expr.when(pred, F.lit(family))
    return expr.otherwise(F.lit(OTHER_FAMILY))


def has_tag_sql(tags: str, tag: str) -> str:
    return f"coalesce(array_contains({sx.ref(tags)}, {sx.lit(tag)}), FALSE)"


def has_tag(tags: str | Column, tag: str) -> Column:
    if isinstance(tags, str):
        return F.expr(has_tag_sql(tags, tag))
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def leads_sql(tags: str) -> str:
    return f"({has_tag_sql(tags, LEADERSHIP)} OR {has_tag_sql(tags, EXECUTIVE)})"


def leads(tags: str | Column) -> Column:
    if isinstance(tags, str):
        return F.expr(leads_sql(tags))
    return has_tag(tags, LEADERSHIP) | has_tag(tags, EXECUTIVE)


def seniority_sql(position: str, tags: str | None = None) -> str:
    t = role_tags_sql(position) if tags is None else tags
    return f"({leads_sql(t)} OR {matches_any_sql(position, SENIORITY_WORDS)})"


def seniority(position: str | Column, tags: str | Column | None = None) -> Column:
    """Leadership/executive tag, or a senior/sr/staff/expert/principal/lead word.

    Names (or SQL text) build the expression in one parse; Columns are
    combined through the Column API."""
    if isinstance(position, str) and (tags is None or isinstance(tags, str)):
        return F.expr(seniority_sql(position, tags))
    pos = F.col(position) if isinstance(position, str) else position
    t = role_tags(pos) if tags is None else (F.col(tags) if isinstance(tags, str) else tags)
    return leads(t) | matches_any(pos, SENIORITY_WORDS)
