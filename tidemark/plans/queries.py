"""Named queries over the driver tables: key → callable(spark, sf_dir) → DataFrame."""

from __future__ import annotations

import datetime as dt_
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.operators import fact as fact_ops
from tidemark.operators import marts
from tidemark.operators import silver as silver_ops
from tidemark.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def register(fn):
        QUERIES[key] = fn
        return fn

    return register


# --- shared building blocks ---------------------------------------------------
def bronze(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.raw_snap(spark, sf)


def silver(spark: SparkSession, sf: str) -> DataFrame:
    return silver_ops.build_silver(bronze(spark, sf))


def times(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps of the exports, straight from the cleaned rows."""
    return silver_ops.export_times(silver_ops.clean(bronze(spark, sf)))


def fact_flow(spark: SparkSession, sf: str) -> DataFrame:
    return fact_ops.fact_with_flow(silver(spark, sf), times(spark, sf))


# --- registered queries ---------------------------------------------------------
@query("raw_snap")
def q_raw_snap(spark, sf):
    return bronze(spark, sf)


@query("silver")
def q_silver(spark, sf):
    return silver(spark, sf)


@query("fct_snapshot")
def q_fact(spark, sf):
    return fact_ops.build_fact(silver(spark, sf), times(spark, sf))


@query("network_stats")
def q_network_stats(spark, sf):
    s = silver(spark, sf)
    return marts.network_stats(fact_ops.fact_with_flow(s, times(spark, sf)), s)


# --- flow, SCD2 and dimensions -------------------------------------------------------
from tidemark.operators import dims, scd2  # noqa: E402
from tidemark.operators.silver import identifiable  # noqa: E402

TODAY = "2026-08-27"


def dim(spark, sf):
    return scd2.replay(silver(spark, sf), times=times(spark, sf))


def company_dim(spark, sf):
    s = silver(spark, sf)
    return dims.dim_company(s, scd2.replay(s, times=times(spark, sf)))


def bd(spark, sf):
    return marts.breakdown(fact_ops.build_fact(silver(spark, sf), times(spark, sf)))


def bd_latest(spark, sf):
    """Breakdown of the newest export with an identified row."""
    return marts.breakdown_at(silver(spark, sf), times(spark, sf).agg(F.max("snapshot_ts")).scalar())


def stats(spark, sf):
    s = silver(spark, sf)
    return marts.network_stats(fact_ops.fact_with_flow(s, times(spark, sf)), s)


@query("snapshot_sequence")
def q_seq(spark, sf):
    return fact_ops.snapshot_sequence(times(spark, sf))


@query("first_appearance")
def q_first(spark, sf):
    return fact_ops.first_appearance(silver(spark, sf))


@query("identifiable")
def q_ident(spark, sf):
    return identifiable(silver(spark, sf))


@query("lost_entities")
def q_lost(spark, sf):
    return fact_ops.lost_entities(fact_flow(spark, sf))


@query("new_since_previous")
def q_new(spark, sf):
    return fact_ops.build_fact(silver(spark, sf), times(spark, sf)).filter("is_new_since_previous_snapshot").select(
        "snapshot_ts", "connection_id"
    )


@query("scd2_replay")
def q_replay(spark, sf):
    return dim(spark, sf)


@query("scd2_apply")
def q_apply(spark, sf):
    """History of every export but the newest, then the newest folded in."""
    s = silver(spark, sf)
    checkpoint_dir(spark)
    exports = times(spark, sf)
    newest = exports.agg(F.max("snapshot_ts")).scalar()
    before = scd2.replay(s.filter(F.col("snapshot_ts") < newest),
                         times=exports.filter(F.col("snapshot_ts") < newest)).checkpoint(eager=True)
    return scd2.apply(before, identifiable(s).filter(F.col("snapshot_ts") == newest), at=newest)


@query("scd2_late_exports")
def q_splice(spark, sf):
    """History of the exports but four; the oldest, two neighbours and the one
    before the newest arrive later, in no order of time."""
    s, exports = silver(spark, sf).where("is_identifiable"), times(spark, sf)
    checkpoint_dir(spark)
    order = [r[0] for r in exports.select("snapshot_ts").distinct().orderBy("snapshot_ts").collect()]  # one per export
    late = [order[i] for i in dict.fromkeys((len(order) // 2, 0, len(order) - 2, len(order) // 2 - 1)) if 0 <= i < len(order)]
    known = sorted(set(order) - set(late))
    there = F.col("snapshot_ts").isin(known) if known else F.lit(False)
    s = s.checkpoint(eager=True)
    history = scd2.replay(s.filter(there), times=exports.filter(there)).checkpoint(eager=True)
    for at in late:
        before, after = max((x for x in known if x < at), default=None), min((x for x in known if x > at), default=None)
        history = scd2.splice(history, s.filter(F.col("snapshot_ts") == F.lit(at)),
                              s.filter(F.col("snapshot_ts") == F.lit(after)), at=at, previous_ts=before,
                              following_ts=after).checkpoint(eager=True)
        known.append(at)
    return history


@query("scd2_current")
def q_current(spark, sf):
    return scd2.current(dim(spark, sf))


@query("entity_history")
def q_history(spark, sf):
    return scd2.history(dim(spark, sf))


@query("recent_changes")
def q_changes(spark, sf):
    return scd2.recent_changes(dim(spark, sf), 25)


@query("departed")
def q_departed(spark, sf):
    return scd2.departed(dim(spark, sf), 25)


@query("dim_company")
def q_dim_company(spark, sf):
    return company_dim(spark, sf)


@query("current_connections")
def q_current_connections(spark, sf):
    s = silver(spark, sf)
    d = scd2.replay(s, times=times(spark, sf))
    return dims.current_entities(d, dims.dim_company(s, d))


@query("dim_date")
def q_dim_date(spark, sf):
    return dims.dim_date(silver(spark, sf), TODAY)


@query("breakdown")
def q_breakdown(spark, sf):
    return bd(spark, sf)


@query("company_labels")
def q_labels(spark, sf):
    return marts.company_labels(fact_ops.build_fact(silver(spark, sf), times(spark, sf)))


@query("top_breakdown")
def q_top(spark, sf):
    return marts.top_values(bd_latest(spark, sf), marts.COMPANY, 15)


@query("breakdown_value_count")
def q_value_count(spark, sf):
    return marts.value_counts(bd_latest(spark, sf))


@query("undisclosed_count")
def q_undisclosed(spark, sf):
    return marts.undisclosed(bd_latest(spark, sf))


@query("connected_over_time")
def q_monthly(spark, sf):
    return marts.connected_over_time(bd_latest(spark, sf))


@query("cumulative_growth")
def q_cumulative(spark, sf):
    return marts.cumulative(marts.connected_over_time(bd_latest(spark, sf)).drop("month_number"))


@query("headline")
def q_headline(spark, sf):
    return marts.headline(stats(spark, sf))


@query("churn_long")
def q_churn(spark, sf):
    return marts.churn_long(stats(spark, sf))


# --- taxonomy, scoring, reach, search ------------------------------------------------------
from tidemark.functions import taxonomy as tx  # noqa: E402
from tidemark.operators import reach as reach_ops  # noqa: E402
from tidemark.operators import rules as rule_ops  # noqa: E402
from tidemark.operators import scoring  # noqa: E402
from tidemark.operators import search  # noqa: E402

SCORE_COLUMNS = ("connection_id", "tags", "family", "company_has_data_team", "referral_path",
                 "role_points", "seniority_points", "warmth_points", "recent_move_points",
                 "early_career_points", "score", "score_reason")


def network(spark, sf):
    """Current entities enriched with employer and version facts."""
    s = silver(spark, sf)
    d = scd2.replay(s, times=times(spark, sf))
    return dims.current_entities(d, dims.dim_company(s, d))


def scored(spark, sf):
    return scoring.score(network(spark, sf), today=TODAY)


@query("score")
def q_score(spark, sf):
    return scored(spark, sf).select(*SCORE_COLUMNS)


@query("referral_path")
def q_path(spark, sf):
    return scored(spark, sf).select("connection_id", "referral_path")


@query("role_tags")
def q_tags(spark, sf):
    return identifiable(silver(spark, sf)).select(
        "connection_id", "snapshot_ts", "position", tx.role_tags("position").alias("tags"))


@query("job_family")
def q_family(spark, sf):
    return identifiable(silver(spark, sf)).select(
        "connection_id", "snapshot_ts", tx.job_family("position").alias("family"))


@query("taxonomy_join")
def q_taxonomy_join(spark, sf):
    rows = identifiable(silver(spark, sf)).select("connection_id", "snapshot_ts", "position")
    rules = rule_ops.rules_frame(spark, tx.JOB_FAMILY_RULES)
    return rule_ops.apply_rules(rows, rules, "position", mode="first",
                                default=tx.OTHER_FAMILY, out="family").drop("position")


@query("seniority")
def q_seniority(spark, sf):
    return identifiable(silver(spark, sf)).select(
        "connection_id", "snapshot_ts", tx.seniority("position").alias("is_senior"))


@query("months_since")
def q_months(spark, sf):
    from tidemark.functions.dates import months_since
    return network(spark, sf).select(
        "connection_id",
        months_since("connected_on", TODAY).alias("months_since_connected"),
        months_since("valid_from", TODAY).alias("months_since_change"))


@query("warmth")
def q_warmth(spark, sf):
    from tidemark.functions.dates import months_since, warmth
    w = scoring.DEFAULT_WEIGHTS
    return network(spark, sf).select(
        "connection_id",
        warmth(months_since("connected_on", TODAY), w.warmth, w.warmth_decay_months).alias("warmth"))


@query("data_team_flag")
def q_data_team(spark, sf):
    return scoring.data_team_keys(network(spark, sf)).select("company_key")


@query("signal_frequency")
def q_signals(spark, sf):
    return scoring.signal_frequency(scored(spark, sf))


@query("path_frequency")
def q_paths(spark, sf):
    return scoring.path_frequency(scored(spark, sf))


@query("score_bands")
def q_bands(spark, sf):
    return scoring.score_bands(scored(spark, sf))


@query("score_summary")
def q_score_summary(spark, sf):
    return scoring.score_summary(scored(spark, sf))


@query("shortlist_summary")
def q_shortlist_summary(spark, sf):
    return scoring.shortlist_summary(scored(spark, sf))


@query("strongholds")
def q_strongholds(spark, sf):
    return scoring.strongholds(scored(spark, sf))


@query("rank_referrals")
def q_rank(spark, sf):
    return scoring.rank(scoring.with_score_rank(scored(spark, sf))).select(
        *SCORE_COLUMNS, "full_name", "connected_on", "company", "score_rank")


@query("first_by_company")
def q_first_by_company(spark, sf):
    return scoring.rank(scored(spark, sf), "company", 25).select("company", "connection_id")


@query("first_by_name")
def q_first_by_name(spark, sf):
    return scoring.rank(scored(spark, sf), "full_name", 25).select("full_name", "connection_id")


@query("best_referrals")
def q_best(spark, sf):
    return scoring.rank(scored(spark, sf), "score", 25).select("score", "connected_on", "full_name", "connection_id")


@query("company_reach")
def q_reach(spark, sf):
    return reach_ops.company_reach(network(spark, sf))


@query("top_reach")
def q_top_reach(spark, sf):
    return reach_ops.top_reach(reach_ops.company_reach(network(spark, sf)))


@query("reach_summary")
def q_reach_summary(spark, sf):
    return reach_ops.summarise(reach_ops.company_reach(network(spark, sf)))


@query("reach_filters")
def q_reach_filters(spark, sf):
    return reach_ops.reach_filter(reach_ops.company_reach(network(spark, sf)), "has", True)


@query("family_counts")
def q_family_counts(spark, sf):
    return reach_ops.family_counts(network(spark, sf))


@query("family_depth")
def q_family_depth(spark, sf):
    return reach_ops.family_depth(network(spark, sf))


@query("tag_counts")
def q_tag_counts(spark, sf):
    return reach_ops.tag_counts(network(spark, sf))


@query("concentration")
def q_concentration(spark, sf):
    return reach_ops.concentration(network(spark, sf))


@query("career_stage")
def q_career(spark, sf):
    return reach_ops.career_stage(network(spark, sf))


# --- search and display -------------------------------------------------------------
from tidemark.functions import render, text  # noqa: E402
from tidemark.functions.dates import parse_export_date  # noqa: E402
from tidemark.plans.oracles import (  # noqa: E402
    FILTER_TAGS, SEARCH_COMPANY, SEARCH_DOCS, SEARCH_PEOPLE,
)


@query("filter_tags")
def q_filter_tags(spark, sf):
    tagged = network(spark, sf).withColumn("tags", tx.role_tags("position"))
    return search.filter_tags(tagged, list(FILTER_TAGS), include_untagged=False).select(
        "connection_id", "tags")


@query("search_people")
def q_search_people(spark, sf):
    return search.search_people(network(spark, sf), SEARCH_PEOPLE).select(
        "connection_id", "full_name", "position")


@query("search_company")
def q_search_company(spark, sf):
    return search.search_company(network(spark, sf), SEARCH_COMPANY).select(
        "connection_id", "company")


@query("filter_date_range")
def q_date_range(spark, sf):
    return search.date_range(network(spark, sf)).select("connection_id", "connected_on")


@query("shortlist_view")
def q_shortlist(spark, sf):
    return search.shortlist(scoring.rank(scored(spark, sf)))


@query("fold_accents")
def q_fold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    folded = text.fold_accents("text")
    return docs.select("doc_id", F.md5(folded).alias("folded_md5"),
                       F.length(folded).alias("folded_chars"))


@query("search_scripts")
def q_search_scripts(spark, sf):
    """Every customer under a name in one of several scripts, and the needles
    (other spellings of the same letters) that find it."""
    names = F.array(*[F.lit(n) for n, _ in text.SCRIPT_NAMES])
    people = spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", F.concat(F.get(names, F.expr(f"cast(c_custkey % {len(text.SCRIPT_NAMES)} as int)")), F.lit(" "),
                              F.col("c_custkey").cast("string")).alias("name"))
    hits = [F.when(text.contains_folded("name", needle), F.lit(needle)) for _, needle in text.SCRIPT_NAMES]
    return people.select("c_custkey", F.array_join(F.filter(F.array(*hits), lambda x: x.isNotNull()), ",").alias("hits"))


@query("search_documents")
def q_search_docs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    return search.search_company(docs, SEARCH_DOCS, col="text").select("doc_id", "lang")


@query("display_url")
def q_display_url(spark, sf):
    return identifiable(silver(spark, sf)).select(
        "connection_id", render.display_url("connection_id").alias("display_url")).distinct()


@query("change_text")
def q_change_text(spark, sf):
    ch = scd2.recent_changes(dim(spark, sf), None)
    return ch.select(
        "connection_id",
        render.change_text("previous_company", "company").alias("company_change"),
        render.change_text("previous_position", "position").alias("position_change"))


@query("format_cols")
def q_format(spark, sf):
    st = stats(spark, sf)
    secs = F.unix_timestamp("snapshot_ts") - F.unix_timestamp("previous_snapshot_ts")
    return st.select(
        "snapshot_sequence",
        render.format_ts("snapshot_ts").alias("snapshot_label"),
        render.format_ts("previous_snapshot_ts").alias("previous_label"),
        render.format_duration(secs).alias("gap_text"))


@query("normalise")
def q_normalise(spark, sf):
    return silver(spark, sf).select("company_label", "company_normalised", "company_key").distinct()


@query("parse_date")
def q_parse_date(spark, sf):
    return bronze(spark, sf).select(
        F.col("connected_on").alias("raw"), parse_export_date("connected_on").alias("parsed")
    ).distinct()


@query("surrogate_key")
def q_surrogate(spark, sf):
    return fact_ops.build_fact(silver(spark, sf), times(spark, sf)).select(
        "connection_id", "snapshot_ts", "connection_snapshot_key")


# --- data quality ---------------------------------------------------------------------
from tidemark.operators import quality as dq  # noqa: E402
from tidemark.plans.oracles import DATE_REGEX, URL_REGEX  # noqa: E402

BRONZE_COLUMNS = ("first_name", "last_name", "url", "email_address", "company", "position",
                  "connected_on", "snapshot_ts", "file_hash", "source_object",
                  "source_row_number", "ingested_at")


def bronze_suite() -> list:
    return [
        dq.row_count_at_least(1),
        dq.not_null("file_hash"), dq.not_null("snapshot_ts"), dq.not_null("source_object"),
        dq.not_null("ingested_at"), dq.length_eq("file_hash", 32),
        dq.matches("url", URL_REGEX, mostly=0.90),
        dq.matches("connected_on", DATE_REGEX, mostly=1.0),
    ]


def _tagged(df, table):
    return df.selectExpr(f"{sx.lit(table)} AS `table`", *[f"`{c}`" for c in df.columns])


@query("dq_suite")
def q_dq_suite(spark, sf):
    return dq.run_checks(bronze(spark, sf), bronze_suite(), by=["snapshot_ts"])


@query("dq_report")
def q_dq_report(spark, sf):
    res = dq.run_checks(bronze(spark, sf), bronze_suite(), by=["snapshot_ts"])
    return dq.suite_report(res, by=["snapshot_ts"])


@query("dq_columns")
def q_dq_columns(spark, sf):
    """Column set of exports that lack a column and carry an odd one, next to
    row checks of the same rows; and of the exports as they are."""
    rows = bronze(spark, sf)
    odd = rows.drop("position").withColumn("notes", F.lit(None).cast("string"))
    parts = [dq.run_checks(frame, [dq.columns_exact(BRONZE_COLUMNS), dq.row_count_at_least(1), dq.not_null(c)])
             .withColumn("frame", F.lit(name)) for name, frame, c in (("odd", odd, "notes"), ("exports", rows, "url"))]
    return parts[0].unionByName(parts[1])


@query("restricted_rows")
def q_restricted(spark, sf):
    return dq.restricted_rows(bronze(spark, sf), by=["snapshot_ts"])


def _marts(spark, sf):
    """Silver (written once, as a run does, and read by every chain), history, fact."""
    checkpoint_dir(spark)
    s = silver(spark, sf).checkpoint(eager=True)
    d = scd2.replay(s, times=times(spark, sf))
    f = fact_ops.build_fact(s, times(spark, sf))
    return s, d, f


@query("dq_unique")
def q_dq_unique(spark, sf):
    s, d, f = _marts(spark, sf)
    comp = dims.dim_company(s, d)
    cal = dims.dim_date(s, TODAY)
    st = marts.network_stats(fact_ops.fact_with_flow(s, times(spark, sf)), s)
    b = marts.breakdown(f)
    parts = [
        _tagged(dq.run_checks(comp, [dq.unique("company_key")]), "dim_company"),
        _tagged(dq.run_checks(cal, [dq.unique("date_key"), dq.unique("date_day")]), "dim_date"),
        _tagged(dq.run_checks(f, [dq.unique("connection_id", "snapshot_ts"),
                                  dq.unique("connection_snapshot_key")]), "fct_snapshot"),
        _tagged(dq.run_checks(st, [dq.unique("snapshot_ts")]), "network_stats"),
        _tagged(dq.run_checks(b, [dq.unique("snapshot_ts", "dimension_type", "dimension_value")]),
                "breakdown"),
        _tagged(dq.run_checks(s, [dq.unique("connection_id", "snapshot_ts",
                                            where=F.col("connection_id").isNotNull())]), "silver"),
        _tagged(dq.run_checks(d, [dq.unique("scd_id")]), "dim_connection"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_not_null")
def q_dq_not_null(spark, sf):
    s, d, f = _marts(spark, sf)
    comp = dims.dim_company(s, d)
    return (
        _tagged(dq.run_checks(f, [dq.not_null("connection_snapshot_key"),
                                  dq.not_null("connection_id"), dq.not_null("company_key")]),
                "fct_snapshot")
        .unionByName(_tagged(dq.run_checks(comp, [dq.not_null("company_key"),
                                                  dq.not_null("company_name")]), "dim_company"))
        .unionByName(_tagged(dq.run_checks(s, [
            dq.not_null("connection_id", where=F.col("is_identifiable")),
            dq.not_null("company_key"), dq.not_null("connected_on"), dq.not_null("snapshot_ts"),
            dq.not_null("file_hash"), dq.not_null("is_identifiable")]), "silver"))
    )


@query("dq_accepted_values")
def q_dq_accepted(spark, sf):
    s, _, f = _marts(spark, sf)
    return _tagged(dq.run_checks(marts.breakdown(f), [dq.accepted_values(
        "dimension_type", [marts.COMPANY, marts.POSITION, marts.YEAR_MONTH])]), "breakdown"
    ).unionByName(_tagged(dq.run_checks(s, [dq.accepted_values("is_identifiable", [True, False])]),
                          "silver"))


@query("dq_range")
def q_dq_range(spark, sf):
    s, d, _ = _marts(spark, sf)
    st = marts.network_stats(fact_ops.fact_with_flow(s, times(spark, sf)), s)
    return (
        _tagged(dq.run_checks(dims.dim_company(s, d), [dq.in_range("current_connection_count", 0)]),
                "dim_company")
        .unionByName(_tagged(dq.run_checks(st, [dq.in_range("total_connections", 0)]),
                             "network_stats"))
        .unionByName(_tagged(dq.run_checks(s, [dq.in_range(
            "connected_on", dt_.date(2003, 5, 5), dt_.date.fromisoformat(TODAY), severity=dq.WARN)]),
            "silver"))
    )


@query("dq_relationships")
def q_dq_rel(spark, sf):
    s, d, f = _marts(spark, sf)
    comp, cal = dims.dim_company(s, d), dims.dim_date(s, TODAY)
    return _tagged(dq.run_checks(f, [
        dq.relationship("company_key", comp, "company_key"),
        dq.relationship("snapshot_date_key", cal, "date_key"),
        dq.relationship("connected_on_date_key", cal, "date_key"),
    ]), "fct_snapshot")


@query("dq_freshness")
def q_dq_fresh(spark, sf):
    return dq.run_checks(bronze(spark, sf), [
        dq.freshness("ingested_at", TODAY, 30, dq.WARN),
        dq.freshness("ingested_at", TODAY, 90, dq.ERROR),
    ])


@query("dq_identifiable_share")
def q_dq_share(spark, sf):
    return dq.identifiable_share(silver(spark, sf), 0.90)


@query("dq_volume_anomaly")
def q_dq_volume(spark, sf):
    return dq.volume_anomaly(fact_ops.build_fact(silver(spark, sf), times(spark, sf)), 0.5)


@query("dq_one_current")
def q_dq_one_current(spark, sf):
    check = dq.Check("one_open_version", failures=dq.one_open_version)
    return dq.run_checks(dim(spark, sf), [check])


@query("dq_one_batch")
def q_dq_one_batch(spark, sf):
    check = dq.Check("one_batch_per_snapshot", failures=dq.one_batch_per_snapshot)
    return dq.run_checks(bronze(spark, sf), [check])


@query("dq_fact_orphans")
def q_dq_orphans(spark, sf):
    s, d, f = _marts(spark, sf)
    check = dq.Check("current_fact_rows_in_dim", failures=lambda x: dq.fact_orphans(x, d))
    return dq.run_checks(f, [check])


@query("dq_counts_agree")
def q_dq_counts(spark, sf):
    s = silver(spark, sf)
    st = marts.network_stats(fact_ops.fact_with_flow(s, times(spark, sf)), s)
    return dq.counts_agree(st, marts.breakdown(fact_ops.build_fact(s, times(spark, sf))))


@query("dq_negatives")
def q_dq_negatives(spark, sf):
    """The checks over tables with faults put in on purpose: repeated and orphan
    keys, unlisted and out-of-range values, second open versions, second files,
    missing rows, blanked identities. Every check fails, by a known count."""
    s, d, f = _marts(spark, sf)
    raw, b = bronze(spark, sf), marts.breakdown(f)
    st = marts.network_stats(fact_ops.fact_with_flow(s, times(spark, sf)), s)
    zero = "connection_id LIKE '%0'"
    twice = f.unionByName(f.where(zero))
    two_open = d.unionByName(d.where(f"valid_to IS NULL AND {zero}"))
    two_files = raw.withColumn("file_hash", F.expr("CASE WHEN day(snapshot_ts) % 3 = 0 AND source_row_number % 2 = 0 "
                                                   "THEN reverse(file_hash) ELSE file_hash END"))
    blanked = raw.selectExpr(*[
        f"CASE WHEN source_row_number % 13 = 0 THEN ' ' ELSE `{c}` END AS `{c}`"
        if c in ("url", "first_name", "last_name", "company", "position") else f"`{c}`" for c in raw.columns])
    thinned = f.where(f"NOT (day(snapshot_ts) % 2 = 0 AND NOT {zero})")
    short = b.where("NOT (dimension_type = 'company' AND rank_within_dimension <= 2)")
    named = lambda name, fails: dq.Check(name, failures=fails)
    parts = [
        _tagged(dq.run_checks(twice, [dq.unique("connection_snapshot_key"), dq.relationship(
            "company_key", dims.dim_company(s, d).where("company_key < '8'"), "company_key")]), "fct_snapshot"),
        _tagged(dq.run_checks(b, [dq.accepted_values("dimension_type", [marts.COMPANY, marts.YEAR_MONTH]),
                                  dq.in_range("connection_count", 2, 20)]), "breakdown"),
        _tagged(dq.run_checks(two_open, [named("one_open_version", dq.one_open_version)]), "dim_connection"),
        _tagged(dq.run_checks(two_files, [named("one_batch_per_snapshot", dq.one_batch_per_snapshot)]), "raw_snap"),
        _tagged(dq.run_checks(f, [named("current_fact_rows_in_dim", lambda x: dq.fact_orphans(
            x, d.where(f"NOT {zero}")))]), "fct_snapshot"),
        _tagged(dq.run_checks(st, [named("counts_agree", lambda x: dq.counts_agree(x, short).where(
            "NOT agrees"))]), "network_stats"),
        _tagged(dq.run_checks(thinned, [named("volume_anomaly", lambda x: dq.volume_anomaly(x, 0.5).where(
            "is_anomalous"))]), "fct_snapshot"),
        _tagged(dq.run_checks(dq.restricted_rows(blanked, by=["snapshot_ts"]), [dq.in_range(
            "restricted_profile_rows", 0, 0)]), "restricted"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- bronze readers ----------------------------------------------------------------------
from tidemark.sources import bronze as bronze_src  # noqa: E402


@query("latest_snapshot")
def q_latest(spark, sf):
    return bronze_src.latest_snapshot(bronze(spark, sf))


@query("ingestion_log")
def q_ingestion_log(spark, sf):
    return bronze_src.ingestion_log(bronze(spark, sf))


@query("silver_clean")
def q_silver_clean(spark, sf):
    return silver_ops.clean(bronze(spark, sf))


@query("silver_dedup")
def q_silver_dedup(spark, sf):
    return silver_ops.dedup(silver_ops.clean(bronze(spark, sf)))


# --- landing zone, ingest, streaming, pipeline ----------------------------------------------
import uuid  # noqa: E402

from tidemark.functions import keys as keyfn  # noqa: E402
from tidemark.plans import delta, pipeline  # noqa: E402
from tidemark.session import checkpoint_dir, table_path  # noqa: E402
from tidemark.sources import exports as exp  # noqa: E402
from tidemark.sources import landing  # noqa: E402
from tidemark.sources.adapters import ADAPTER_URL_REGEX, LANDING_PREFIX  # noqa: E402
from tidemark.streaming import ingest as stream_ingest  # noqa: E402
from tidemark.streaming import notifications  # noqa: E402


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    return table_path(spark, f"scratch/{name}-{uuid.uuid4().hex[:12]}")


def landed(spark, sf, name: str, rows=None) -> str:
    """Render the adapter's exports as files and land them under content-hash keys."""
    root = scratch(spark, name)
    landing.write_exports(bronze(spark, sf) if rows is None else rows, f"{root}/staging")
    landing.land_exports(spark, f"{root}/staging", f"{root}/landing", LANDING_PREFIX)
    return root


def exports_listing(spark, sf):
    """Landing-object metadata derived from the adapter's export keys."""
    keys = bronze(spark, sf).select("source_object", "snapshot_ts", "file_hash").distinct()
    k = F.col("source_object")
    return keys.select(k.alias("key"), keyfn.key_snapshot_ts(k).alias("key_snapshot_ts"),
                       keyfn.key_hash8(k).alias("hash8"), keyfn.key_is_valid(k).alias("is_valid"),
                       "snapshot_ts", "file_hash")


@query("parse_key")
def q_parse_key(spark, sf):
    keys = bronze(spark, sf).select(F.col("source_object").alias("key")).distinct()
    keys = keys.unionByName(keys.select(F.upper("key").alias("key")))
    k = F.col("key")
    return keys.select("key", keyfn.key_is_valid(k).alias("is_valid"),
                       keyfn.key_snapshot_ts(k).alias("snapshot_ts"),
                       keyfn.key_hash8(k).alias("hash8"), keyfn.key_prefix(k).alias("prefix"))


@query("build_key")
def q_build_key(spark, sf):
    pairs = bronze(spark, sf).select("snapshot_ts", "file_hash").distinct()
    return pairs.withColumn("key", keyfn.build_object_key(LANDING_PREFIX, F.col("snapshot_ts"),
                                                          F.col("file_hash")))


@query("content_hash")
def q_content_hash(spark, sf):
    b = bronze(spark, sf)
    parts = [F.coalesce(F.col(c), F.lit("")) for c in exp.ROW_COLUMNS]
    return b.select("snapshot_ts", "source_row_number",
                    F.md5(F.concat_ws("\x1f", *parts)).alias("row_hash"))


@query("pending_objects")
def q_pending(spark, sf):
    """Two files of one short hash: the ledger knows one of them, the other stays pending."""
    listing = exports_listing(spark, sf).selectExpr(
        "key", "snapshot_ts", "hash8", "cast(1 as long) as size_bytes", "snapshot_ts as last_modified")
    twin = listing.selectExpr("concat('twin/', key) as key", "snapshot_ts", "hash8", "size_bytes", "last_modified")
    newest = listing.agg(F.max("snapshot_ts")).scalar()
    ledger = listing.where(F.col("snapshot_ts") < newest).withColumn("file_hash", F.md5("hash8"))
    return landing.pending_objects(listing.unionByName(twin), ledger).select("key", "snapshot_ts", "hash8")


@query("notification_keys")
def q_notifications(spark, sf):
    exports = bronze(spark, sf).select("source_object").distinct()
    payloads = notifications.payloads_for_exports(exports)
    return notifications.notification_keys(payloads, LANDING_PREFIX, keep=("source_object",))


@query("landing_inventory")
def q_inventory(spark, sf):
    """The older half of the exports is ingested; one key does not parse."""
    rows = bronze(spark, sf)
    root = scratch(spark, "inventory")
    last = rows.agg(F.max("snapshot_ts")).scalar()
    landing.write_exports(rows.where(F.col("snapshot_ts") < last), f"{root}/old")
    landing.land_exports(spark, f"{root}/old", f"{root}/landing", LANDING_PREFIX)
    landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    landing.write_exports(rows.where(F.col("snapshot_ts") == last), f"{root}/new")
    landing.land_exports(spark, f"{root}/new", f"{root}/landing", LANDING_PREFIX)
    landing.write_exports(rows.where(F.col("snapshot_ts") == last), f"{root}/landing/stray")
    files = landing.list_landing(spark, f"{root}/landing").where("path like '%.csv' or path like '%/part-%'")
    return landing.inventory(files, bronze_src.read_ledger(spark, f"{root}/bronze")).select(
        "snapshot_ts", "is_valid", "in_bronze")


def bz_read(spark, path):
    return bronze_src.read_bronze(spark, path)


@query("parse_exports")
def q_parse_exports(spark, sf):
    root = landed(spark, sf, "parse")
    files = exp.examine(landing.list_landing(spark, f"{root}/landing").select("path", "snapshot_ts"))
    return exp.read_rows(files, "snapshot_ts").select("snapshot_ts", "source_row_number", *exp.ROW_COLUMNS)


@query("header_check")
def q_header_check(spark, sf):
    """Headers of the exports: as landed, without a required column, and with an odd one."""
    heads = bronze(spark, sf).select("snapshot_ts").distinct().select(
        "snapshot_ts", F.expr("pmod(datediff(snapshot_ts, date'2024-01-01'), 3)").alias("kind"))
    names = F.array(*[F.lit(c) for c in exp.KNOWN_COLUMNS])
    header = (F.when(F.col("kind") == 0, names)
              .when(F.col("kind") == 1, F.filter(F.transform(names, lambda x: F.upper(x)), lambda x: x != "POSITION"))
              .otherwise(F.concat(names, F.array(F.lit(" Notes "), F.lit("")))))
    return exp.header_check(heads.select("snapshot_ts", header.alias("header"))).select(
        "snapshot_ts", "missing_columns", "unexpected_columns", "is_valid")


@query("validate_exports")
def q_validate(spark, sf):
    """Dry run over a landing zone of which all but the newest export is ingested."""
    rows = bronze(spark, sf)
    root = scratch(spark, "validate")
    last = rows.agg(F.max("snapshot_ts")).scalar()
    for name, part in (("old", F.col("snapshot_ts") < last), ("new", F.col("snapshot_ts") == last)):
        landing.write_exports(rows.where(part), f"{root}/{name}")
        landing.land_exports(spark, f"{root}/{name}", f"{root}/landing", LANDING_PREFIX)
        if name == "old":
            landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    return landing.dry_run(spark, f"{root}/landing", f"{root}/bronze").select(
        "snapshot_ts", "row_count", "header_line_index", "error", "is_duplicate")


@query("hash_mismatch")
def q_hash_mismatch(spark, sf):
    """Every other export's key is changed after landing; one export is landed twice."""
    root = landed(spark, sf, "tamper")
    odd = F.expr("pmod(datediff(snapshot_ts, date'2024-01-01'), 2) = 1")
    files = landing.list_landing(spark, f"{root}/landing").withColumn(
        "hash8", F.when(odd, F.translate("hash8", "0123456789abcdef", "123456789abcdef0")).otherwise(F.col("hash8")))
    again = files.withColumn("key", F.concat(F.lit("z-"), F.col("key")))
    none = spark.createDataFrame([], "file_hash string")
    return landing.classify_files(exp.examine(files.unionByName(again)), none).select("snapshot_ts", "status")


@query("bronze_append")
def q_bronze_append(spark, sf):
    root = landed(spark, sf, "append")
    landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    return bz_read(spark, f"{root}/bronze").groupBy("snapshot_ts").agg(
        F.count(F.lit(1)).alias("rows"))


@query("ingest_report")
def q_ingest_report(spark, sf):
    root = landed(spark, sf, "report")
    return landing.ingest_report(landing.ingest(spark, f"{root}/landing", f"{root}/bronze",
                                                ingested_at=TODAY))


@query("ingest_batch")
def q_ingest_batch(spark, sf):
    """Two runs over the same landing zone: the second adds nothing."""
    root = landed(spark, sf, "batch")
    first = landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    first = first.checkpoint(eager=True)
    second = landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    return first.unionByName(second).select("snapshot_ts", "status", "rows_ingested")


@query("stream_ingest")
def q_stream_ingest(spark, sf):
    """availableNow stream run twice: the redundant second trigger is a no-op."""
    root = landed(spark, sf, "stream")
    args = (spark, f"{root}/landing", f"{root}/bronze", f"{root}/_stream_ckpt")
    stream_ingest.run_available_now(*args, ingested_at=TODAY)
    res = stream_ingest.run_available_now(*args, ingested_at=TODAY)
    return res.select("snapshot_ts", "status", "rows_ingested")


@query("late_snapshot")
def q_late(spark, sf):
    """The oldest export arrives after the others; the marts are rebuilt from
    all of Silver and equal an in-order build."""
    rows = bronze(spark, sf)
    oldest = rows.agg(F.min("snapshot_ts")).scalar()
    root = scratch(spark, "late")
    wh = f"{root}/warehouse"
    landing.write_exports(rows.filter(F.col("snapshot_ts") != oldest), f"{root}/staging1")
    landing.land_exports(spark, f"{root}/staging1", f"{root}/landing", LANDING_PREFIX)
    pipeline.run(spark, f"{root}/landing", wh, today=TODAY, url_regex=ADAPTER_URL_REGEX,
                 ingested_at=TODAY, fail_on_quality=False)
    landing.write_exports(rows.filter(F.col("snapshot_ts") == oldest), f"{root}/staging2")
    landing.land_exports(spark, f"{root}/staging2", f"{root}/landing", LANDING_PREFIX)
    pipeline.run(spark, f"{root}/landing", wh, today=TODAY, url_regex=ADAPTER_URL_REGEX,
                 ingested_at=TODAY, fail_on_quality=False)
    from tidemark.sources import tables
    return tables.read_table(spark, wh, "mart_network_stats")


@query("pipeline_run")
def q_pipeline(spark, sf):
    root = landed(spark, sf, "pipeline")
    return pipeline.run(spark, f"{root}/landing", f"{root}/warehouse", today=TODAY,
                        url_regex=ADAPTER_URL_REGEX, ingested_at=TODAY, fail_on_quality=False).drop("detail")


def built_by_delta(spark, sf) -> str:
    """A warehouse built in three steps: the exports but three, then the newest,
    then the oldest and a middle one, which come late. Returns its folder."""
    rows, root = bronze(spark, sf), scratch(spark, "delta")
    checkpoint_dir(spark)
    order = [r[0] for r in rows.select("snapshot_ts").distinct().orderBy("snapshot_ts").collect()]  # one per export
    newest, late = order[-1:], [x for x in {*order[:1], *order[len(order) // 2:][:1]} if x not in order[-1:]]
    have: list = []
    for n, step in enumerate(([x for x in order if x not in newest + late], newest, late)):
        have += step
        some = rows.where(F.col("snapshot_ts").isin(have)) if have else rows.where("false")
        todo = delta.plan(spark, root, delta.exports_of(some))
        whole = delta.build_silver(some, root, f"run{n}", todo)
        delta.build_gold(spark, root, f"run{n}", todo, scd2.replay(whole), TODAY)
    return root


@query("delta_stats")
def q_delta_stats(spark, sf):
    """Growth per export, built step by step from new exports."""
    return table_store.read_table(spark, built_by_delta(spark, sf), "mart_network_stats")


@query("delta_fact")
def q_delta_fact(spark, sf):
    """Fact of all exports in parts, written by three runs."""
    return table_store.read_table(spark, built_by_delta(spark, sf), delta.FACT).select(*fact_ops.FACT_COLUMNS)


@query("delta_breakdown")
def q_delta_breakdown(spark, sf):
    return table_store.read_table(spark, built_by_delta(spark, sf), "mart_network_breakdown")


@query("delta_company")
def q_delta_company(spark, sf):
    """Employer dimension from links merged over three runs."""
    return table_store.read_table(spark, built_by_delta(spark, sf), "dim_company")


@query("newest_export")
def q_newest_export(spark, sf):
    """Newest export of a Bronze of many: its time from the ledger, its rows from
    the folder of its date."""
    root = landed(spark, sf, "newest")
    landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    text = ("first_name", "last_name", "url", "email_address", "company", "position", "connected_on")
    return bronze_src.read_newest(spark, f"{root}/bronze").select(
        "snapshot_ts", "source_row_number", *[F.coalesce(c, F.lit("")).alias(c) for c in text])


@query("export_shortlist")
def q_export(spark, sf):
    path = scratch(spark, "shortlist")
    search.export_csv(search.shortlist(scoring.rank(scored(spark, sf))), path)
    return spark.read.option("header", True).csv(path)


# --- the orders adapter: quarterly customer exports ---------------------------------------
def orders_silver(spark, sf):
    return silver_ops.build_silver(adapters.raw_snap_orders(spark, sf))


@query("orders_silver")
def q_orders_silver(spark, sf):
    return orders_silver(spark, sf)


@query("orders_network_stats")
def q_orders_stats(spark, sf):
    s = orders_silver(spark, sf)
    return marts.network_stats(fact_ops.fact_with_flow(s), s)


@query("orders_scd2_replay")
def q_orders_replay(spark, sf):
    return scd2.replay(orders_silver(spark, sf))


@query("orders_breakdown")
def q_orders_breakdown(spark, sf):
    return marts.breakdown(fact_ops.build_fact(orders_silver(spark, sf)))


@query("breakdown_union")
def q_breakdown_union(spark, sf):
    """The three-branch union shape (one aggregation per dimension)."""
    return marts.breakdown(fact_ops.build_fact(silver(spark, sf), times(spark, sf)), method="union")


@query("parse_exports_split")
def q_parse_exports_split(spark, sf):
    """The same exports ingested in two batches and read back from Bronze."""
    rows = bronze(spark, sf)
    root = scratch(spark, "parse-split")
    odd = F.expr("pmod(datediff(snapshot_ts, date'2024-01-01'), 2) = 1")
    for name, part in (("odd", odd), ("even", ~odd)):
        landing.write_exports(rows.where(part), f"{root}/{name}")
        landing.land_exports(spark, f"{root}/{name}", f"{root}/landing", LANDING_PREFIX)
        landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    return bz_read(spark, f"{root}/bronze").select("snapshot_ts", "source_row_number", *exp.ROW_COLUMNS)


# --- helpers of a warehouse: parameterised reads, versions, layer status, times -------------
from tidemark.functions import dates as datefn  # noqa: E402
from tidemark.sources import tables as table_store  # noqa: E402


@query("parameterised_read")
def q_parameterised_read(spark, sf):
    """A read with bound parameters, and one of a relation that does not exist yet."""
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("tm_orders")
    found = table_store.safe_sql(
        spark, "SELECT o_orderkey, o_custkey FROM tm_orders WHERE o_custkey % :n = :r AND o_orderpriority <> :p",
        {"n": 7, "r": 3, "p": "' OR 1 = 1 --"}, requires=("tm_orders",))
    none = table_store.safe_sql(spark, "SELECT * FROM tm_absent", requires=("tm_absent",),
                                schema="o_orderkey long, o_custkey long")
    return found.unionByName(none)


@query("versioned_table")
def q_versioned_table(spark, sf):
    """Two versions of Silver written one after the other; readers see the newer."""
    root = scratch(spark, "versions")
    s = silver(spark, sf)
    last = times(spark, sf).agg(F.max("snapshot_ts")).scalar()
    table_store.write_table(s.where(F.col("snapshot_ts") < last), root, "silver", "v1")
    table_store.write_table(s, root, "silver", "v2")
    return table_store.read_table(spark, root, "silver").groupBy("snapshot_ts").agg(F.count("*").alias("rows"))


@query("layer_status")
def q_layer_status(spark, sf):
    """Which layers a warehouse has after ingest and Silver, before the marts."""
    root = landed(spark, sf, "status")
    landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    table_store.write_table(silver_ops.build_silver(bz_read(spark, f"{root}/bronze")), root, "silver", "v1")
    return table_store.warehouse_status(spark, root)


@query("seeded_exports")
def q_seeded_exports(spark, sf):
    """The first export's rows seeded as four exports 7 days apart, each later
    one without every 10th and with a changed title on every 5th row."""
    rows = bronze(spark, sf)
    first = rows.where(F.col("snapshot_ts") == rows.agg(F.min("snapshot_ts")).scalar())
    steps = first.select("*", F.expr("explode(sequence(0, 3)) AS step")).where(
        "step = 0 OR source_row_number % 10 <> step")
    seeded = (steps.withColumn("snapshot_ts", F.expr("snapshot_ts + make_interval(0, 0, step)"))
              .withColumn("position", F.expr("CASE WHEN step > 0 AND source_row_number % 5 = 0 "
                                             "THEN concat('Moved ', CAST(step AS STRING)) ELSE `position` END"))
              .drop("step"))
    root = landed(spark, sf, "seed", seeded)
    landing.ingest(spark, f"{root}/landing", f"{root}/bronze", ingested_at=TODAY)
    return bz_read(spark, f"{root}/bronze").groupBy("snapshot_ts").agg(
        F.count("*").alias("rows"), F.expr("count_if(`position` LIKE 'Moved %')").alias("moved"))


@query("naive_utc")
def q_naive_utc(spark, sf):
    """Event times read as wall time of a zone, as naive UTC."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    shown = lambda c, name: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    return ev.select("event_id", shown(datefn.as_naive_utc("ts"), "same"),
                     shown(datefn.as_naive_utc("ts", "Asia/Ho_Chi_Minh"), "from_zone"))
