"""SQL-text builders: literals survive the parser, and the SQL-text and
Column forms of each helper compute the same values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions import taxonomy as tx
from tidemark.functions.dates import months_since, months_since_sql, warmth, warmth_sql
from tidemark.functions.text import (
    is_blank, is_blank_sql, normalise_company, normalise_company_sql, nullif_blank,
    nullif_blank_sql, trim_ws, trim_ws_sql,
)

TRICKY = [
    "plain", "it's", "back\\slash", r"(?iU)\b(?:a|b\.c)\b", "100% _under_", "tab\there",
    "line\nbreak", "Ngân hàng Ví Dụ", "quote \" double", "\\'mixed\\'", "", " ", "\\u0041",
    "ß → ss", "$1 {x}",
]


def test_string_literals_round_trip(spark):
    row = spark.range(1).select(*[F.expr(sx.lit(s)).alias(f"c{i}") for i, s in enumerate(TRICKY)]).first()
    assert [row[f"c{i}"] for i in range(len(TRICKY))] == TRICKY


def test_typed_literals(spark):
    df = spark.range(1).select(
        F.expr(sx.lit(30.44)).alias("d"), F.expr(sx.lit(86_400_000_000)).alias("l"),
        F.expr(sx.lit(None)).alias("n"), F.expr(sx.lit(True)).alias("b"),
        F.expr(sx.str_array(["a", None, "b"])).alias("arr"))
    types = dict(df.dtypes)
    assert types["d"] == "double" and types["l"] == "bigint" and types["b"] == "boolean"
    assert types["arr"] == "array<string>"
    r = df.first()
    assert r["d"] == 30.44 and r["n"] is None and r["arr"] == ["a", None, "b"]


def test_float_literals(spark):
    import math

    vals = [30.44, 1e-05, 1e20, -2.5, float("inf"), float("-inf"), float("nan")]
    r = spark.range(1).select(*[F.expr(sx.lit(v)).alias(f"f{i}") for i, v in enumerate(vals)]).first()
    for i, v in enumerate(vals):
        assert (math.isnan(r[f"f{i}"]) if math.isnan(v) else r[f"f{i}"] == v), (v, r[f"f{i}"])


def test_ref_quotes_names_only():
    assert sx.ref("position") == "`position`"
    assert sx.ref("lower(position)") == "lower(position)"


TEXTS = ["  Acme   Bank ", " Globex ", "", "   ", None, "Ví Dụ  Co", "(unknown)"]


def test_text_helpers_sql_equals_column(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    pairs = {
        "trim": (F.expr(trim_ws_sql("t")), trim_ws(F.col("t"))),
        "nullif": (F.expr(nullif_blank_sql("t")), nullif_blank(F.col("t"))),
        "blank": (F.expr(is_blank_sql("t")), is_blank(F.col("t"))),
        "norm": (F.expr(normalise_company_sql("t")), normalise_company(F.col("t"))),
    }
    cols = [x.alias(f"{k}_{j}") for k, (a, b) in pairs.items() for j, x in (("s", a), ("c", b))]
    for r in df.select("i", *cols).collect():
        for k in pairs:
            assert r[f"{k}_s"] == r[f"{k}_c"], (k, TEXTS[r["i"]])


TITLES = ["Senior Data Engineer", "Head of Talent", "CTO", "Junior Graphic Designer",
          "Analytics Engineer (dbt)", "Ngân hàng analyst", "", None, "Staff ML engineer"]


def test_taxonomy_sql_equals_column(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "i int, position string")
    p = F.col("position")
    got = df.select(
        "i",
        tx.role_tags("position").alias("tags_s"), tx.role_tags(p).alias("tags_c"),
        tx.job_family("position").alias("fam_s"), tx.job_family(p).alias("fam_c"),
        tx.seniority("position").alias("sen_s"), tx.seniority(p).alias("sen_c"),
    ).collect()
    for r in got:
        assert r["tags_s"] == r["tags_c"] and r["fam_s"] == r["fam_c"] and r["sen_s"] == r["sen_c"], r


def test_month_arithmetic_sql_equals_column(spark):
    df = spark.createDataFrame(
        [("2026-08-27 00:00:00",), ("2024-01-15 10:30:00",), ("2027-01-01 00:00:00",), (None,)],
        "ts string").selectExpr("CAST(ts AS TIMESTAMP) AS ts")
    m_s, m_c = months_since_sql("ts", "2026-08-27"), months_since("ts", "2026-08-27")
    rows = df.select(
        F.expr(m_s).alias("ms"), m_c.alias("mc"),
        F.expr(warmth_sql(m_s, 15, 24.0)).alias("ws"), warmth(m_c, 15, 24.0).alias("wc"),
    ).collect()
    for r in rows:
        assert r["ms"] == r["mc"] and r["ws"] == r["wc"], r


def test_entry_pins_standard_literal_escaping(spark):
    """A session that reads literals raw would corrupt escaped regexes; the
    driver entry points reset it before building any query."""
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    try:
        df = entry.queries()["role_tags"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.parser.escapedStringLiterals") == "false"
        assert spark.range(1).select(F.expr(sx.lit(r"\b(?:a)\b")).alias("p")).first()["p"] == r"\b(?:a)\b"
        assert df.count() >= 0
    finally:
        spark.conf.set("spark.sql.parser.escapedStringLiterals", "false")
