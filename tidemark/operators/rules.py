"""Taxonomy rules held in a table (user-defined taxonomies).

A taxonomy is a bounded parameter: its rules (at most ``MAX_RULES``, checked)
become CASE chains of literal patterns, ``BATCH`` rules per chain, so each
pattern is compiled once and no join is needed to match. Matching runs on
DISTINCT texts, not rows: titles repeat heavily, so the evaluation shrinks to
the vocabulary, and the labels go back to the rows with an equi-join on the
text (AQE picks broadcast or a skew-split sort-merge join from its size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions.taxonomy import keyword_regex

MAX_RULES, BATCH = 5000, 100


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    """(rule_order, label, pattern) from ordered (label, keywords) pairs."""
    rows = [(i, label, keyword_regex(tuple(kws))) for i, (label, kws) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_order int, label string, pattern string")


def apply_rules(df: DataFrame, rules: DataFrame, text_col: str, *, mode: str = "first",
                default: str | None = None, out: str = "label") -> DataFrame:
    """mode='first': label of the lowest-order matching rule (``default`` when none);
    mode='all': every matching label, in rule order, without duplicates."""
    listed = rules.select("rule_order", "label", "pattern").orderBy("rule_order").limit(MAX_RULES + 1).collect()
    if len(listed) > MAX_RULES:
        raise ValueError(f"a taxonomy of more than {MAX_RULES} rules")
    pairs = [(f"_trimmed rlike {sx.lit(r['pattern'])}", sx.lit(r["label"])) for r in listed]
    batches = [pairs[i:i + BATCH] for i in range(0, len(pairs), BATCH)]
    texts = df.select(F.col(text_col).alias("_text")).distinct().selectExpr("_text", "trim(_text) AS _trimmed")
    if mode == "first":
        chains = [sx.case_when(b) for b in batches] + ["CAST(NULL AS STRING)"]
        found, fill = f"coalesce({', '.join(chains)}, CAST(NULL AS STRING))", sx.lit(default)
    else:
        arrays = [f"array({', '.join(f'CASE WHEN {c} THEN {v} END' for c, v in b)})" for b in batches]
        found = f"array_distinct(filter(concat({', '.join([*arrays, 'CAST(array() AS ARRAY<STRING>)'])}), " \
                "x -> x IS NOT NULL))"
        fill = "CAST(array() AS ARRAY<STRING>)"
    blank = "CAST(NULL AS STRING)" if mode == "first" else "CAST(NULL AS ARRAY<STRING>)"
    labels = texts.selectExpr("_text", f"CASE WHEN _trimmed <> '' THEN {found} ELSE {blank} END AS _found")
    joined = df.join(labels, df[text_col].eqNullSafe(labels["_text"]), "left")
    return joined.withColumn(out, F.expr(f"coalesce(_found, {fill})")).drop("_text", "_found")
