"""Reference SQL for every query key, runnable by DuckDB on the driver tables.

The SQL is written independently of the Spark operators — plain joins,
anti-joins and window functions the way an analyst would write them — so a
match between the two is evidence, not tautology. Shared steps are named
CTEs; ``compose`` pulls in the ones a query needs, dependencies first.
"""

from __future__ import annotations

from tidemark.sources.adapters import COMPANIES, CONNECTED_ORIGIN, DAY_ORIGIN, LANDING_PREFIX, TITLES


def _sql_list(values) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'"

    return "[" + ", ".join(lit(v) for v in values) + "]"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


def compose(final: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return final
    body = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    return f"WITH {body}\n{final}"


# --- adapters ----------------------------------------------------------------
cte("ev", f"""
    SELECT event_id, user_id,
           CAST(date_trunc('day', ts) AS TIMESTAMP) AS snapshot_ts,
           date_diff('day', DATE '{DAY_ORIGIN}', CAST(ts AS DATE)) AS d
    FROM events""")
cte("raw_rows", f"""
    SELECT event_id, snapshot_ts,
      'U' || CAST(user_id AS VARCHAR) AS first_name,
      'N' || CAST(user_id % 7 AS VARCHAR) AS last_name,
      CASE WHEN event_id % 20 = 0 THEN ''
           ELSE 'https://example.com/in/u-' || CAST(user_id AS VARCHAR) END AS url,
      CASE WHEN user_id % 4 = 0 THEN 'u' || CAST(user_id AS VARCHAR) || '@example.com'
           ELSE '' END AS email_address,
      {_sql_list(COMPANIES)}[CAST((user_id * 7 + d // 5) % 11 AS INTEGER) + 1] AS company,
      {_sql_list(TITLES)}[CAST((user_id + d // 10) % 17 AS INTEGER) + 1] AS position,
      CASE WHEN user_id % 50 = 7 THEN 'n/a'
           ELSE strftime(DATE '{CONNECTED_ORIGIN}' + CAST(user_id % 1000 AS INTEGER), '%d %b %Y')
      END AS connected_on
    FROM ev""", "ev")
_BRONZE_META = f"""
      md5(CAST(snapshot_ts AS VARCHAR)) AS file_hash,
      '{LANDING_PREFIX}/' || strftime(snapshot_ts, '%Y%m%dT%H%M%SZ') || '_'
        || substr(md5(CAST(snapshot_ts AS VARCHAR)), 1, 8) || '.csv' AS source_object,
      CAST(row_number() OVER (PARTITION BY snapshot_ts ORDER BY {{order}}) AS INTEGER)
        AS source_row_number,
      snapshot_ts + INTERVAL 1 HOUR AS ingested_at"""
cte("raw_snap", f"""
    SELECT first_name, last_name, url, email_address, company, position, connected_on,
      snapshot_ts, {_BRONZE_META.format(order='event_id')}
    FROM raw_rows""", "raw_rows")
cte("raw_snap_orders", f"""
    SELECT 'C' || CAST(o_custkey AS VARCHAR) AS first_name, 'Customer' AS last_name,
      'https://example.com/c/' || CAST(o_custkey AS VARCHAR) AS url, '' AS email_address,
      o_orderpriority AS company, o_orderstatus AS position,
      strftime(o_orderdate, '%d %b %Y') AS connected_on, snapshot_ts,
      {_BRONZE_META.format(order='o_orderkey')}
    FROM (SELECT *, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS snapshot_ts
          FROM orders) o""")

# --- silver ------------------------------------------------------------------
_SILVER_TMPL = """
    SELECT connection_id, first_name, last_name,
      nullif(trim(concat_ws(' ', first_name, last_name)), '') AS full_name,
      email_address, company, coalesce(company, '(unknown)') AS company_label,
      regexp_replace(lower(trim(coalesce(company, '(unknown)'))), '\\s+', ' ', 'g')
        AS company_normalised,
      md5(coalesce(CAST(regexp_replace(lower(trim(coalesce(company, '(unknown)'))),
        '\\s+', ' ', 'g') AS VARCHAR), '_dbt_utils_surrogate_key_null_')) AS company_key,
      position, lower(position) AS position_normalised, connected_on, connected_on_raw,
      CAST(strftime(connected_on, '%Y%m%d') AS INTEGER) AS connected_on_date_key,
      snapshot_ts, CAST(snapshot_ts AS DATE) AS snapshot_date,
      CAST(strftime(CAST(snapshot_ts AS DATE), '%Y%m%d') AS INTEGER) AS snapshot_date_key,
      file_hash, source_object, source_row_number, ingested_at,
      connection_id IS NOT NULL AS is_identifiable, email_address IS NOT NULL AS has_email
    FROM (
      SELECT *, row_number() OVER (PARTITION BY snapshot_ts, connection_id
                                   ORDER BY source_row_number) AS dup_rank
      FROM (
        SELECT nullif(trim(url), '') AS connection_id,
          nullif(trim(first_name), '') AS first_name,
          nullif(trim(last_name), '') AS last_name,
          nullif(trim(email_address), '') AS email_address,
          nullif(trim(company), '') AS company,
          nullif(trim(position), '') AS position,
          CAST(try_strptime(trim(connected_on), '%d %b %Y') AS DATE) AS connected_on,
          nullif(trim(connected_on), '') AS connected_on_raw,
          snapshot_ts, file_hash, source_object, source_row_number, ingested_at
        FROM {src}) c
    ) r
    WHERE connection_id IS NULL OR dup_rank = 1"""
cte("silver", _SILVER_TMPL.format(src="raw_snap"), "raw_snap")
cte("silver_orders", _SILVER_TMPL.format(src="raw_snap_orders"), "raw_snap_orders")

# --- fact --------------------------------------------------------------------
cte("ident", "SELECT * FROM silver WHERE is_identifiable", "silver")
cte("seq", """
    SELECT snapshot_ts,
      CAST(row_number() OVER (ORDER BY snapshot_ts) AS INTEGER) AS snapshot_sequence,
      lag(snapshot_ts) OVER (ORDER BY snapshot_ts) AS previous_snapshot_ts,
      lead(snapshot_ts) OVER (ORDER BY snapshot_ts) AS next_snapshot_ts
    FROM (SELECT DISTINCT snapshot_ts FROM ident) x""", "ident")
cte("fact", """
    SELECT
      md5(coalesce(CAST(i.connection_id AS VARCHAR), '_dbt_utils_surrogate_key_null_') || '-' ||
          coalesce(CAST(i.snapshot_ts AS VARCHAR), '_dbt_utils_surrogate_key_null_'))
        AS connection_snapshot_key,
      i.connection_id, i.snapshot_ts, i.snapshot_date, i.snapshot_date_key,
      q.snapshot_sequence, q.previous_snapshot_ts, i.company_key, i.company_label,
      i.position, i.connected_on, i.connected_on_date_key, i.has_email, i.file_hash,
      i.snapshot_ts = fa.first_ts AS is_first_appearance,
      (p.connection_id IS NULL AND q.previous_snapshot_ts IS NOT NULL)
        AS is_new_since_previous_snapshot,
      CAST(date_diff('day', i.connected_on, i.snapshot_date) AS INTEGER)
        AS days_connected_at_snapshot
    FROM ident i
    JOIN seq q ON q.snapshot_ts = i.snapshot_ts
    JOIN (SELECT connection_id, min(snapshot_ts) AS first_ts FROM ident GROUP BY 1) fa
      ON fa.connection_id = i.connection_id
    LEFT JOIN ident p
      ON p.connection_id = i.connection_id AND p.snapshot_ts = q.previous_snapshot_ts""",
    "ident", "seq")
cte("stats", """
    SELECT a.snapshot_ts, a.snapshot_date_key, a.snapshot_sequence, a.previous_snapshot_ts,
      a.total_connections, a.new_connections,
      coalesce(l.lost_connections, 0) AS lost_connections,
      CAST(a.new_connections - coalesce(l.lost_connections, 0) AS INTEGER) AS net_change,
      a.distinct_companies, a.connections_with_email,
      round(100.0 * a.connections_with_email / nullif(a.total_connections, 0), 2)
        AS email_coverage_pct,
      coalesce(r.restricted_profile_rows, 0) AS restricted_profile_rows,
      coalesce(r.connections_without_company, 0) AS connections_without_company,
      coalesce(r.connections_without_position, 0) AS connections_without_position
    FROM (
      SELECT snapshot_ts, min(snapshot_date_key) AS snapshot_date_key,
        min(snapshot_sequence) AS snapshot_sequence,
        min(previous_snapshot_ts) AS previous_snapshot_ts,
        CAST(count(*) AS INTEGER) AS total_connections,
        CAST(count(DISTINCT CASE WHEN company_label <> '(unknown)' THEN company_key END)
             AS INTEGER) AS distinct_companies,
        CAST(sum(CASE WHEN has_email THEN 1 ELSE 0 END) AS INTEGER) AS connections_with_email,
        CAST(sum(CASE WHEN is_new_since_previous_snapshot THEN 1 ELSE 0 END) AS INTEGER)
          AS new_connections
      FROM fact GROUP BY snapshot_ts) a
    LEFT JOIN (
      SELECT cur.snapshot_ts, CAST(count(*) AS INTEGER) AS lost_connections
      FROM seq cur
      JOIN fact prev ON prev.snapshot_ts = cur.previous_snapshot_ts
      WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.snapshot_ts = cur.snapshot_ts
                          AND f.connection_id = prev.connection_id)
      GROUP BY cur.snapshot_ts) l ON l.snapshot_ts = a.snapshot_ts
    LEFT JOIN (
      SELECT snapshot_ts,
        CAST(sum(CASE WHEN is_identifiable THEN 0 ELSE 1 END) AS INTEGER) AS restricted_profile_rows,
        CAST(sum(CASE WHEN company IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS connections_without_company,
        CAST(sum(CASE WHEN position IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS connections_without_position
      FROM silver GROUP BY snapshot_ts) r ON r.snapshot_ts = a.snapshot_ts""",
    "fact", "seq", "silver")


ORACLES: dict[str, str] = {}


def oracle(key: str, final: str, *needed: str) -> None:
    ORACLES[key] = compose(final, *needed)


oracle("raw_snap", "SELECT * FROM raw_snap", "raw_snap")
oracle("silver", "SELECT * FROM silver", "silver")
oracle("fct_snapshot", "SELECT * FROM fact", "fact")
oracle("network_stats", "SELECT * FROM stats", "stats")

# --- SCD2 / dims ----------------------------------------------------------------
TODAY = "2026-08-27"

cte("scd_flags", """
    SELECT i.connection_id, i.first_name, i.last_name, i.full_name, i.email_address, i.company,
      i.company_label, i.company_key, i.position, i.connected_on, i.connected_on_date_key,
      i.snapshot_ts,
      CASE WHEN lag(i.snapshot_ts) OVER w IS NULL
             OR lag(i.snapshot_ts) OVER w <> q.previous_snapshot_ts
             OR lag(i.company) OVER w IS DISTINCT FROM i.company
             OR lag(i.position) OVER w IS DISTINCT FROM i.position
           THEN 1 ELSE 0 END AS is_start
    FROM ident i JOIN seq q ON q.snapshot_ts = i.snapshot_ts
    WINDOW w AS (PARTITION BY i.connection_id ORDER BY i.snapshot_ts)""", "ident", "seq")
cte("scd_islands", """
    SELECT *, sum(is_start) OVER (PARTITION BY connection_id ORDER BY snapshot_ts
                                  ROWS UNBOUNDED PRECEDING) AS island
    FROM scd_flags""", "scd_flags")
cte("scd2", """
    SELECT s.connection_id, s.first_name, s.last_name, s.full_name, s.email_address, s.company,
      s.company_label, s.company_key, s.position, s.connected_on, s.connected_on_date_key,
      s.snapshot_ts AS source_snapshot_ts,
      md5(s.connection_id || '|' || CAST(s.snapshot_ts AS VARCHAR)) AS scd_id,
      s.snapshot_ts AS valid_from, e.next_snapshot_ts AS valid_to
    FROM scd_islands s
    JOIN (SELECT connection_id, island, max(snapshot_ts) AS last_ts
          FROM scd_islands GROUP BY connection_id, island) g
      ON g.connection_id = s.connection_id AND g.island = s.island
    JOIN seq e ON e.snapshot_ts = g.last_ts
    WHERE s.is_start = 1""", "scd_islands", "seq")
cte("dim_company", """
    SELECT a.company_key, l.company_label AS company_name, a.company_normalised,
      l.company_label = '(unknown)' AS is_unknown_company, a.first_seen_snapshot_ts,
      a.last_seen_snapshot_ts, a.first_connected_on, a.last_connected_on, a.connections_ever,
      coalesce(cc.n, 0) AS current_connection_count
    FROM (SELECT company_key, min(company_normalised) AS company_normalised,
            min(snapshot_ts) AS first_seen_snapshot_ts, max(snapshot_ts) AS last_seen_snapshot_ts,
            min(connected_on) AS first_connected_on, max(connected_on) AS last_connected_on,
            count(DISTINCT connection_id) AS connections_ever
          FROM ident GROUP BY company_key) a
    JOIN (SELECT company_key, company_label,
            row_number() OVER (PARTITION BY company_key
                               ORDER BY snapshot_ts DESC, company_label ASC) AS rk
          FROM ident) l ON l.company_key = a.company_key AND l.rk = 1
    LEFT JOIN (SELECT company_key, count(*) AS n FROM scd2 WHERE valid_to IS NULL
               GROUP BY company_key) cc ON cc.company_key = a.company_key""", "ident", "scd2")
cte("current_conn", """
    SELECT d.connection_id, d.full_name, d.first_name, d.last_name, d.email_address, d.company,
      d.company_key, c.company_name, c.current_connection_count AS company_connection_count,
      d.position, d.connected_on, d.valid_from,
      coalesce(v.version_count, 1) > 1 AS has_previous_version, d.valid_to IS NULL AS is_current
    FROM scd2 d
    LEFT JOIN dim_company c ON c.company_key = d.company_key
    LEFT JOIN (SELECT connection_id, count(*) AS version_count FROM scd2 GROUP BY 1) v
      ON v.connection_id = d.connection_id
    WHERE d.valid_to IS NULL""", "scd2", "dim_company")
cte("breakdown", """
    SELECT snapshot_ts, dimension_type, dimension_value, connection_count,
      row_number() OVER (PARTITION BY snapshot_ts, dimension_type
                         ORDER BY connection_count DESC, dimension_value ASC NULLS LAST)
        AS rank_within_dimension,
      round(100.0 * connection_count
            / sum(connection_count) OVER (PARTITION BY snapshot_ts, dimension_type), 2)
        AS share_pct
    FROM (
      SELECT k.snapshot_ts, 'company' AS dimension_type, lb.company_label AS dimension_value,
             k.n AS connection_count
      FROM (SELECT snapshot_ts, company_key, count(*) AS n FROM fact GROUP BY 1, 2) k
      JOIN (SELECT snapshot_ts, company_key, company_label FROM (
              SELECT snapshot_ts, company_key, company_label,
                row_number() OVER (PARTITION BY snapshot_ts, company_key
                                   ORDER BY count(*) DESC, company_label) AS rk
              FROM fact GROUP BY 1, 2, 3) z WHERE rk = 1) lb
        ON lb.snapshot_ts = k.snapshot_ts AND lb.company_key = k.company_key
      UNION ALL
      SELECT snapshot_ts, 'position', coalesce(position, '(unknown)'), count(*)
      FROM fact GROUP BY 1, 3
      UNION ALL
      SELECT snapshot_ts, 'connected_year_month', strftime(connected_on, '%Y-%m'), count(*)
      FROM fact GROUP BY 1, 3
    ) u""", "fact")
cte("bd_latest", """
    SELECT * FROM breakdown WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM breakdown)""",
    "breakdown")
cte("monthly", """
    SELECT dimension_value AS year_month, connection_count FROM bd_latest
    WHERE dimension_type = 'connected_year_month'""", "bd_latest")

oracle("snapshot_sequence", "SELECT * FROM seq", "seq")
oracle("first_appearance", """
    SELECT connection_id, min(snapshot_ts) AS first_seen_snapshot_ts FROM ident GROUP BY 1""",
    "ident")
oracle("identifiable", "SELECT * FROM ident", "ident")
oracle("lost_entities", """
    SELECT cur.snapshot_ts, prev.connection_id, prev.snapshot_ts AS last_seen_snapshot_ts
    FROM seq cur
    JOIN ident prev ON prev.snapshot_ts = cur.previous_snapshot_ts
    LEFT JOIN ident now ON now.snapshot_ts = cur.snapshot_ts
                       AND now.connection_id = prev.connection_id
    WHERE now.connection_id IS NULL""", "seq", "ident")
oracle("new_since_previous", """
    SELECT snapshot_ts, connection_id FROM fact WHERE is_new_since_previous_snapshot""", "fact")
oracle("scd2_replay", "SELECT * FROM scd2", "scd2")
oracle("scd2_late_exports", "SELECT * FROM scd2", "scd2")
oracle("scd2_apply", "SELECT * FROM scd2", "scd2")
oracle("scd2_current", "SELECT * FROM scd2 WHERE valid_to IS NULL", "scd2")
oracle("entity_history", """
    SELECT connection_id, company, position, valid_from, valid_to,
           valid_to IS NULL AS is_current,
           (SELECT count(*) FROM scd2 e WHERE e.connection_id = d.connection_id AND e.valid_from <= d.valid_from)
             AS version
    FROM scd2 d""", "scd2")
oracle("recent_changes", """
    SELECT c.full_name, p.company AS previous_company, p.position AS previous_position,
           c.company, c.position, c.valid_from AS changed_at, c.connection_id
    FROM (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY valid_from DESC) vr
          FROM scd2) c
    JOIN (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY valid_from DESC) vr
          FROM scd2) p ON p.connection_id = c.connection_id AND p.vr = c.vr + 1
    WHERE c.valid_to IS NULL
    ORDER BY c.valid_from DESC, c.connection_id LIMIT 25""", "scd2")
oracle("departed", """
    SELECT full_name, company, position, valid_to AS absent_since, connection_id FROM scd2
    WHERE valid_to IS NOT NULL
      AND connection_id NOT IN (SELECT connection_id FROM scd2 WHERE valid_to IS NULL)
    ORDER BY valid_to DESC, connection_id LIMIT 25""", "scd2")
oracle("dim_company", "SELECT * FROM dim_company", "dim_company")
oracle("current_connections", "SELECT * FROM current_conn", "current_conn")
oracle("dim_date", f"""
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date_day,
      CAST(extract(year FROM d) AS INTEGER) AS calendar_year,
      CAST(extract(quarter FROM d) AS INTEGER) AS calendar_quarter,
      CAST(extract(month FROM d) AS INTEGER) AS calendar_month,
      strftime(d, '%B') AS month_name, strftime(d, '%Y-%m') AS year_month,
      CAST(extract(day FROM d) AS INTEGER) AS day_of_month,
      CAST(extract(isodow FROM d) AS INTEGER) AS iso_day_of_week,
      strftime(d, '%A') AS day_name, CAST(extract(week FROM d) AS INTEGER) AS iso_week,
      CAST(date_trunc('month', d) AS DATE) AS month_start_date,
      CAST(last_day(d) AS DATE) AS month_end_date, extract(isodow FROM d) >= 6 AS is_weekend
    FROM (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d
          FROM (SELECT coalesce(min(connected_on), DATE '{TODAY}') AS s,
                  greatest(coalesce(max(connected_on), DATE '{TODAY}'),
                           coalesce(max(snapshot_date), DATE '{TODAY}')) AS e
                FROM silver) b) x""", "silver")
oracle("breakdown", "SELECT * FROM breakdown", "breakdown")
oracle("company_labels", """
    SELECT snapshot_ts, company_key, company_label, n AS connection_count FROM (
      SELECT snapshot_ts, company_key, company_label,
        sum(count(*)) OVER (PARTITION BY snapshot_ts, company_key) AS n,
        row_number() OVER (PARTITION BY snapshot_ts, company_key
                           ORDER BY count(*) DESC, company_label) AS rk
      FROM fact GROUP BY 1, 2, 3) z WHERE rk = 1""", "fact")
oracle("top_breakdown", """
    SELECT dimension_value, connection_count, share_pct FROM bd_latest
    WHERE dimension_type = 'company' AND dimension_value <> '(unknown)'
    ORDER BY rank_within_dimension LIMIT 15""", "bd_latest")
oracle("breakdown_value_count", """
    SELECT dimension_type, count(*) AS distinct_values FROM bd_latest
    WHERE dimension_value <> '(unknown)' GROUP BY dimension_type""", "bd_latest")
oracle("undisclosed_count", """
    SELECT dimension_type, connection_count FROM bd_latest
    WHERE dimension_value = '(unknown)'""", "bd_latest")
oracle("connected_over_time", """
    SELECT *, row_number() OVER (ORDER BY year_month ASC NULLS LAST) AS month_number FROM monthly""", "monthly")
oracle("cumulative_growth", """
    SELECT year_month, connection_count,
      CAST(sum(connection_count) OVER (ORDER BY year_month ASC NULLS LAST
                                       ROWS UNBOUNDED PRECEDING) AS BIGINT)
        AS cumulative_connections
    FROM monthly""", "monthly")
oracle("headline", """
    SELECT snapshot_ts, total_connections, distinct_companies, new_connections,
      lost_connections, restricted_profile_rows,
      CASE WHEN c.n > 1 THEN net_change END AS delta_since_previous, c.n AS snapshots_ingested
    FROM stats, (SELECT count(*) AS n FROM stats) c
    WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM stats)""", "stats")
oracle("churn_long", """
    SELECT snapshot_ts, 'Joined' AS change_type, new_connections AS connections FROM stats
    UNION ALL
    SELECT snapshot_ts, 'Left', -lost_connections FROM stats""", "stats")

# --- taxonomy / scoring / reach ----------------------------------------------------
from tidemark.functions import taxonomy as _tx  # noqa: E402
from tidemark.operators import scoring as _sc  # noqa: E402

_META = set(".^$*+?()[]{}|\\-")


def _re(keywords) -> str:
    body = "|".join("".join("\\" + ch if ch in _META else ch for ch in k) for k in keywords)
    return "(?i)\\b(?:" + body + ")\\b"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_match(col: str, keywords) -> str:
    return (f"(coalesce(trim({col}), '') <> '' AND "
            f"coalesce(regexp_matches(trim({col}), {_q(_re(keywords))}), false))")


def sql_tag_preds(col: str) -> dict[str, str]:
    preds = {t: sql_match(col, kws) for t, kws in _tx.TAG_KEYWORDS}
    c_level = (f"(coalesce(trim({col}), '') <> '' AND coalesce(regexp_matches(trim({col}), "
               f"{_q('(?i)' + _tx.C_LEVEL_PATTERN)}), false))")
    preds[_tx.EXECUTIVE] = f"({preds[_tx.EXECUTIVE]} OR {c_level})"
    return preds


def sql_tags(col: str) -> str:
    preds = sql_tag_preds(col)
    items = ", ".join(f"CASE WHEN {preds[t]} THEN {_q(t)} END" for t in _tx.ALL_TAGS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def sql_family(col: str) -> str:
    whens = " ".join(f"WHEN {sql_match(col, kws)} THEN {_q(f)}" for f, kws in _tx.JOB_FAMILY_RULES)
    return f"CASE {whens} ELSE 'Other' END"


def sql_seniority(col: str) -> str:
    p = sql_tag_preds(col)
    word = f"coalesce(regexp_matches({col}, {_q(_re(_tx.SENIORITY_WORDS))}), false)"
    return (f"(coalesce({col}, '') <> '' AND ({p[_tx.LEADERSHIP]} OR {p[_tx.EXECUTIVE]} "
            f"OR {word}))")


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def sql_months(col: str, today: str = TODAY) -> str:
    return (f"(floor((epoch_us(TIMESTAMP '{today}') - epoch_us(CAST({col} AS TIMESTAMP)))"
            f" / 86400000000.0) / 30.44)")


def sql_fold(col: str) -> str:
    return (f"replace(lower(strip_accents(translate(coalesce({col}, ''), "
            f"'đĐð', 'dDd'))), 'ß', 'ss')")


_TARGET, _ADJ = _in(_tx.TARGET_FAMILIES), _in(_tx.ADJACENT_FAMILIES)
_W = _sc.DEFAULT_WEIGHTS
cte("net_tf", f"""
    SELECT n.*, {sql_tags('n.position')} AS tags, {sql_family('n.position')} AS family,
      coalesce(t.has_team, false) AS company_has_data_team
    FROM current_conn n
    LEFT JOIN (SELECT DISTINCT company_key, true AS has_team FROM current_conn
               WHERE company_key IS NOT NULL
                 AND {sql_family('position')} IN {_in(_tx.TARGET_FAMILIES + _tx.ADJACENT_FAMILIES)}) t
      ON t.company_key = n.company_key""", "current_conn")
_LEADS = "(list_contains(tags, 'leadership') OR list_contains(tags, 'executive'))"
cte("net_path", f"""
    SELECT *, CASE
      WHEN coalesce(trim(company), '') = '' THEN 'no_employer'
      WHEN {_LEADS} AND (family IN {_TARGET} OR list_contains(tags, 'target_peer')) THEN 'field_leader'
      WHEN family IN {_TARGET} THEN 'field_peer'
      WHEN list_contains(tags, 'recruiter_talent') THEN
        CASE WHEN company_has_data_team THEN 'inhouse_recruiter' ELSE 'outside_recruiter' END
      WHEN {_LEADS} AND family IN {_ADJ} THEN 'adjacent_leader'
      WHEN family IN {_ADJ} THEN 'adjacent_peer'
      WHEN {_LEADS} THEN 'outside_leader'
      ELSE 'none' END AS referral_path,
      {sql_months('connected_on')} AS m_conn,
      {sql_months('valid_from')} AS m_moved,
      {sql_seniority('position')} AS is_senior
    FROM net_tf""", "net_tf")
_BASE = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in ((p, _W.points(p)) for p, _ in _sc.PATH_REASONS))
_REASON = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in _sc.PATH_REASONS)
cte("net_pts", f"""
    SELECT *,
      CASE WHEN role_base > 0 THEN role_base END AS role_points,
      CASE WHEN role_base > 0 AND referral_path NOT IN {_in(_sc.LEADER_PATHS)} AND is_senior
           THEN {_W.seniority} END AS seniority_points,
      CASE WHEN role_base > 0 AND m_conn >= 0
            AND round_even({_W.warmth} * exp(-m_conn / {_W.warmth_decay_months}), 0) <> 0
           THEN CAST(round_even({_W.warmth} * exp(-m_conn / {_W.warmth_decay_months}), 0) AS INTEGER)
      END AS warmth_points,
      CASE WHEN role_base > 0 AND has_previous_version AND m_moved BETWEEN 0 AND {_W.recent_move_months}
           THEN {_W.recent_move} END AS recent_move_points,
      CASE WHEN role_base > 0 AND list_contains(tags, 'early_career')
           THEN -{_W.early_career_penalty} END AS early_career_points
    FROM (SELECT *, CASE referral_path {_BASE} END AS role_base FROM net_path) b""", "net_path")
cte("scored", f"""
    SELECT *,
      CASE WHEN role_base > 0 THEN greatest(0, role_points + coalesce(seniority_points, 0)
        + coalesce(warmth_points, 0) + coalesce(recent_move_points, 0)
        + coalesce(early_career_points, 0)) ELSE 0 END AS score,
      concat_ws('; ', CASE referral_path {_REASON} END,
        CASE WHEN seniority_points IS NOT NULL THEN 'seniority signal in title' END,
        CASE WHEN warmth_points IS NOT NULL
             THEN 'connected ' || CAST(CAST(floor(m_conn) AS BIGINT) AS VARCHAR) || ' month(s) ago' END,
        CASE WHEN recent_move_points IS NOT NULL THEN 'changed job recently' END,
        CASE WHEN early_career_points IS NOT NULL THEN 'early in their career' END) AS score_reason
    FROM net_pts""", "net_pts")

_SCORE_COLS = ("connection_id, tags, family, company_has_data_team, referral_path, role_points, "
               "seniority_points, warmth_points, recent_move_points, early_career_points, score, "
               "score_reason")
oracle("score", f"SELECT {_SCORE_COLS} FROM scored", "scored")
oracle("referral_path", "SELECT connection_id, referral_path FROM scored", "scored")
oracle("role_tags", f"""
    SELECT connection_id, snapshot_ts, position, {sql_tags('position')} AS tags FROM ident""",
    "ident")
oracle("job_family", f"""
    SELECT connection_id, snapshot_ts, {sql_family('position')} AS family FROM ident""", "ident")
oracle("taxonomy_join", f"""
    SELECT connection_id, snapshot_ts, {sql_family('position')} AS family FROM ident""", "ident")
oracle("seniority", f"""
    SELECT connection_id, snapshot_ts, {sql_seniority('position')} AS is_senior FROM ident""",
    "ident")
oracle("months_since", f"""
    SELECT connection_id, {sql_months('connected_on')} AS months_since_connected,
           {sql_months('valid_from')} AS months_since_change FROM current_conn""", "current_conn")
oracle("warmth", f"""
    SELECT connection_id, CASE WHEN m >= 0 THEN CAST(round_even(
             {_W.warmth} * exp(-m / {_W.warmth_decay_months}), 0) AS INTEGER) END AS warmth
    FROM (SELECT connection_id, {sql_months('connected_on')} AS m FROM current_conn) x""",
    "current_conn")
oracle("data_team_flag", f"""
    SELECT DISTINCT company_key FROM current_conn
    WHERE company_key IS NOT NULL
      AND {sql_family('position')} IN {_in(_tx.TARGET_FAMILIES + _tx.ADJACENT_FAMILIES)}""",
    "current_conn")
_ROUTED = "referral_path NOT IN ('none', 'no_employer')"
_SIG_COLS = ("role_points", "seniority_points", "warmth_points", "recent_move_points",
             "early_career_points")
oracle("signal_frequency", " UNION ALL ".join(
    f"SELECT {_q(label)} AS signal, CAST(count(*) FILTER (WHERE {_ROUTED} AND {c} IS NOT NULL)"
    f" AS BIGINT) AS connections FROM scored"
    for (_, label), c in zip(_sc.SIGNAL_LABELS, _SIG_COLS)), "scored")
oracle("path_frequency", "SELECT r.path, coalesce(c.n, 0) AS connections FROM (VALUES "
       + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in _sc.PATH_REASONS)
       + ") r(referral_path, path) LEFT JOIN (SELECT referral_path, count(*) AS n FROM scored "
         "GROUP BY 1) c ON c.referral_path = r.referral_path", "scored")
oracle("score_bands", " UNION ALL ".join(
    f"SELECT {_q(label)} AS band, CAST(count(*) FILTER (WHERE score BETWEEN {lo} AND {hi})"
    f" AS BIGINT) AS connections FROM scored" for label, lo, hi in _sc.SCORE_BANDS), "scored")
oracle("score_summary", """
    SELECT CAST(trunc(median(score)) AS INTEGER) AS median_score,
      CAST(count(*) FILTER (WHERE score >= 75) AS BIGINT) AS scoring_75_plus,
      CAST(count(*) FILTER (WHERE score >= 50) AS BIGINT) AS scoring_50_plus,
      CAST(count(*) FILTER (WHERE score = 0) AS BIGINT) AS scoring_0
    FROM scored""", "scored")
oracle("shortlist_summary", f"""
    SELECT count(*) AS matching_connections,
      CAST(count(*) FILTER (WHERE score >= {_sc.STRONG_SCORE}) AS BIGINT) AS strong_connections,
      count(DISTINCT CASE WHEN company IS NOT NULL THEN company_key END) AS companies_covered,
      coalesce(max(score), 0) AS best_score
    FROM scored""", "scored")
oracle("strongholds", f"""
    SELECT company, count(connection_id) AS connections,
      CAST(sum(CASE WHEN list_contains(tags, 'target_peer') OR list_contains(tags, 'engineering')
               THEN 1 ELSE 0 END) AS BIGINT) AS in_field,
      CAST(sum(CASE WHEN list_contains(tags, 'recruiter_talent') THEN 1 ELSE 0 END) AS BIGINT)
        AS recruiters,
      max(score) AS best_score
    FROM scored WHERE company IS NOT NULL GROUP BY company
    HAVING count(connection_id) >= {_sc.STRONGHOLD_MINIMUM}
    ORDER BY in_field DESC, best_score DESC, connections DESC, company ASC
    LIMIT {_sc.STRONGHOLD_TOP}""", "scored")
oracle("rank_referrals", f"""
    SELECT {_SCORE_COLS}, full_name, connected_on, company, rank() OVER (ORDER BY score DESC NULLS LAST) AS score_rank
    FROM scored""", "scored")
for _key, _order, _cols in (
        ("first_by_company", "company ASC NULLS LAST", "company, connection_id"),
        ("first_by_name", "full_name ASC NULLS LAST", "full_name, connection_id"),
        ("best_referrals", "score DESC NULLS LAST, connected_on DESC NULLS LAST, full_name ASC NULLS LAST",
         "score, connected_on, full_name, connection_id")):
    oracle(_key, f"SELECT {_cols} FROM scored ORDER BY {_order}, connection_id ASC NULLS LAST LIMIT 25", "scored")

_ALL_FAM = _in(_tx.TARGET_FAMILIES + _tx.ADJACENT_FAMILIES)
cte("classified", f"""
    SELECT *, family IN {_TARGET} AS is_core, family IN {_ALL_FAM} AS is_data,
      list_contains(tags, 'recruiter_talent') AS is_recruiter,
      {_LEADS} AND (family IN {_ALL_FAM} OR list_contains(tags, 'target_peer')) AS is_data_leader
    FROM (SELECT *, {sql_tags('position')} AS tags, {sql_family('position')} AS family
          FROM current_conn) x""", "current_conn")
cte("reach", """
    SELECT company, core_peers * 3 + data_leaders * 3 + recruiters * 2 + data_people AS reach,
      core_peers, data_people, data_leaders, recruiters, recruiters > 0 AS has_front_door,
      connections
    FROM (SELECT company_name AS company, count(*) AS connections,
            CAST(sum(CASE WHEN is_core THEN 1 ELSE 0 END) AS BIGINT) AS core_peers,
            CAST(sum(CASE WHEN is_data THEN 1 ELSE 0 END) AS BIGINT) AS data_people,
            CAST(sum(CASE WHEN is_data_leader THEN 1 ELSE 0 END) AS BIGINT) AS data_leaders,
            CAST(sum(CASE WHEN is_recruiter THEN 1 ELSE 0 END) AS BIGINT) AS recruiters
          FROM classified
          WHERE coalesce(trim(company_name), '') <> '' AND company_name <> '(unknown)'
          GROUP BY company_name) a""", "classified")
oracle("company_reach", "SELECT * FROM reach ORDER BY reach DESC, company", "reach")
oracle("top_reach", "SELECT * FROM reach ORDER BY reach DESC, company LIMIT 15", "reach")
oracle("reach_summary", """
    SELECT count(*) AS companies,
      CAST(count(*) FILTER (WHERE core_peers > 0) AS BIGINT) AS with_core,
      CAST(count(*) FILTER (WHERE has_front_door) AS BIGINT) AS front_door,
      CAST(count(*) FILTER (WHERE NOT has_front_door AND data_leaders > 0) AS BIGINT)
        AS closed_with_leader,
      CAST(count(*) FILTER (WHERE core_peers > 0 AND data_leaders > 0 AND has_front_door)
           AS BIGINT) AS all_three
    FROM reach""", "reach")
oracle("reach_filters", "SELECT * FROM reach WHERE has_front_door AND core_peers > 0", "reach")
oracle("family_counts", f"""
    SELECT {sql_family('position')} AS family, count(*) AS connections FROM current_conn
    GROUP BY 1 ORDER BY connections DESC, family LIMIT 15""", "current_conn")
oracle("family_depth", f"""
    SELECT family, connections, senior, 100.0 * senior / connections AS senior_share FROM (
      SELECT {sql_family('position')} AS family, count(*) AS connections,
        CAST(sum(CASE WHEN {sql_seniority('position')} THEN 1 ELSE 0 END) AS BIGINT) AS senior
      FROM current_conn GROUP BY 1 ORDER BY connections DESC, family LIMIT 10) t""",
    "current_conn")
_TP = sql_tag_preds("position")
oracle("tag_counts", " UNION ALL ".join(
    [f"SELECT {_q(t)} AS tag, CAST(count(*) FILTER (WHERE {_TP[t]}) AS BIGINT) AS connections "
     f"FROM current_conn" for t in _tx.ALL_TAGS]
    + ["SELECT 'untagged', CAST(count(*) FILTER (WHERE NOT (" + " OR ".join(_TP.values())
       + ")) AS BIGINT) FROM current_conn"]), "current_conn")
cte("sizes", """
    SELECT company_key, count(*) AS n FROM current_conn WHERE company IS NOT NULL
    GROUP BY company_key""", "current_conn")
oracle("concentration", """
    SELECT count(*) AS employers,
      100.0 * coalesce((SELECT sum(n) FROM (SELECT n FROM sizes ORDER BY n DESC LIMIT 10) t), 0)
        / (SELECT count(*) FROM current_conn) AS top_share_pct,
      CAST(count(*) FILTER (WHERE n >= 3) AS BIGINT) AS employers_with_min
    FROM sizes""", "sizes")
oracle("career_stage", f"""
    SELECT connections, senior, 100.0 * senior / connections AS senior_pct,
      early_career, 100.0 * early_career / connections AS early_career_pct,
      with_email, 100.0 * with_email / connections AS with_email_pct,
      no_company, 100.0 * no_company / connections AS no_company_pct
    FROM (SELECT count(*) AS connections,
            CAST(count(*) FILTER (WHERE {sql_seniority('position')}) AS BIGINT) AS senior,
            CAST(count(*) FILTER (WHERE {_TP[_tx.EARLY_CAREER]}) AS BIGINT) AS early_career,
            CAST(count(*) FILTER (WHERE email_address IS NOT NULL) AS BIGINT) AS with_email,
            CAST(count(*) FILTER (WHERE company IS NULL) AS BIGINT) AS no_company
          FROM current_conn) t""", "current_conn")

# --- search / display ---------------------------------------------------------------
SEARCH_PEOPLE = "data"
SEARCH_COMPANY = "ngan hang"
SEARCH_DOCS = "uber"
FILTER_TAGS = ("leadership", "executive")
cte("tagged_net", f"SELECT *, {sql_tags('position')} AS tags FROM current_conn", "current_conn")
oracle("filter_tags", f"""
    SELECT connection_id, tags FROM tagged_net
    WHERE list_has_any(tags, [{", ".join(_q(t) for t in FILTER_TAGS)}])""", "tagged_net")
oracle("search_people", f"""
    SELECT connection_id, full_name, position FROM current_conn
    WHERE contains({sql_fold('full_name')} || ' ' || {sql_fold('position')},
                   {_q(SEARCH_PEOPLE)})""", "current_conn")
oracle("search_company", f"""
    SELECT connection_id, company FROM current_conn
    WHERE contains({sql_fold('company')}, {_q(SEARCH_COMPANY)})""", "current_conn")
oracle("filter_date_range", """
    SELECT connection_id, connected_on FROM current_conn
    WHERE connected_on BETWEEN (SELECT min(connected_on) FROM current_conn)
                           AND (SELECT max(connected_on) FROM current_conn)""", "current_conn")
_DISPLAY_URL = ("CASE WHEN coalesce(connection_id, '') = '' THEN '' ELSE coalesce("
                "url_decode(replace(connection_id, '+', '%2B')), connection_id) END")
oracle("shortlist_view", f"""
    SELECT full_name AS name, coalesce(company, '—') AS company,
      coalesce(position, '—') AS position,
      CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE '—' END AS tags,
      coalesce(strftime(connected_on, '%Y-%m-%d'), '—') AS connected, score,
      score_reason AS why, {_DISPLAY_URL} AS profile
    FROM scored""", "scored")
oracle("fold_accents", f"""
    SELECT doc_id, md5({sql_fold('text')}) AS folded_md5,
           length({sql_fold('text')}) AS folded_chars FROM documents""")
oracle("search_documents", f"""
    SELECT doc_id, lang FROM documents WHERE contains({sql_fold('text')}, {_q(SEARCH_DOCS)})""")
oracle("display_url", f"SELECT DISTINCT connection_id, {_DISPLAY_URL} AS display_url FROM ident",
       "ident")
_DASH = ("CASE WHEN coalesce(trim(CAST({c} AS VARCHAR)), '') = '' THEN '—' "
         "ELSE trim(CAST({c} AS VARCHAR)) END")


def sql_change(prev: str, cur: str) -> str:
    p, c = _DASH.format(c=prev), _DASH.format(c=cur)
    return f"CASE WHEN {p} = {c} THEN {c} ELSE {p} || ' → ' || {c} END"


oracle("change_text", f"""
    SELECT c.connection_id, {sql_change('p.company', 'c.company')} AS company_change,
      {sql_change('p.position', 'c.position')} AS position_change
    FROM (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY valid_from DESC) vr
          FROM scd2) c
    JOIN (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY valid_from DESC) vr
          FROM scd2) p ON p.connection_id = c.connection_id AND p.vr = c.vr + 1
    WHERE c.valid_to IS NULL""", "scd2")
oracle("format_cols", """
    SELECT snapshot_sequence, strftime(snapshot_ts, '%Y-%m-%d %H:%M') AS snapshot_label,
      coalesce(strftime(previous_snapshot_ts, '%Y-%m-%d %H:%M'), '—') AS previous_label,
      CASE WHEN secs IS NULL THEN '—'
           WHEN secs // 60 > 0 THEN printf('%dm %02ds', secs // 60, secs % 60)
           ELSE printf('%ds', secs % 60) END AS gap_text
    FROM (SELECT *, CAST(floor(epoch(snapshot_ts) - epoch(previous_snapshot_ts)) AS BIGINT)
                    AS secs FROM stats) s""", "stats")
oracle("normalise", """
    SELECT DISTINCT company_label, company_normalised, company_key FROM silver""", "silver")
oracle("parse_date", """
    SELECT DISTINCT connected_on AS raw,
      CAST(try_strptime(trim(connected_on), '%d %b %Y') AS DATE) AS parsed FROM raw_snap""",
    "raw_snap")
oracle("surrogate_key", """
    SELECT connection_id, snapshot_ts, connection_snapshot_key FROM fact""", "fact")

# --- data quality --------------------------------------------------------------------
from tidemark.operators.quality import EXPORT_DATE_REGEX as DATE_REGEX  # noqa: E402
from tidemark.sources.adapters import ADAPTER_URL_REGEX as URL_REGEX  # noqa: E402

_SUITE = [
    ("row_count_at_least_1", "error", "CASE WHEN count(*) < 1 THEN 1 ELSE 0 END",
     "count(*) >= 1"),
] + [
    (f"not_null:{c}", "error", f"count(*) FILTER (WHERE {c} IS NULL)",
     f"count(*) FILTER (WHERE {c} IS NULL) = 0")
    for c in ("file_hash", "snapshot_ts", "source_object", "ingested_at")
] + [
    ("length_eq_32:file_hash", "error", "count(*) FILTER (WHERE length(file_hash) <> 32)",
     "count(*) FILTER (WHERE length(file_hash) <> 32) = 0"),
] + [
    (f"matches:{c}", "error",
     f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_matches({c}, {_q(rx)}))",
     f"(count({c}) = 0 OR (count({c}) - count(*) FILTER (WHERE {c} IS NOT NULL AND NOT "
     f"regexp_matches({c}, {_q(rx)}))) / count({c}) >= {mostly})")
    for c, rx, mostly in (("url", URL_REGEX, 0.9), ("connected_on", DATE_REGEX, 1.0))
]
cte("dq_suite", " UNION ALL ".join(
    f"SELECT snapshot_ts, {_q(n)} AS \"check\", {_q(sev)} AS severity, "
    f"CAST({failed} AS BIGINT) AS failed_rows, coalesce({passed}, false) AS passed "
    f"FROM raw_snap GROUP BY snapshot_ts" for n, sev, failed, passed in _SUITE), "raw_snap")
oracle("dq_suite", "SELECT * FROM dq_suite", "dq_suite")
oracle("dq_report", """
    SELECT snapshot_ts, count(*) AS evaluated,
      CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS successful,
      coalesce(list_sort(list("check") FILTER (WHERE NOT passed)), []) AS failed_checks,
      bool_and(passed) AS success
    FROM dq_suite GROUP BY snapshot_ts""", "dq_suite")
oracle("restricted_rows", """
    SELECT snapshot_ts, CAST(count(*) FILTER (WHERE coalesce(trim(url), '') = ''
      AND coalesce(trim(first_name), '') = '' AND coalesce(trim(last_name), '') = ''
      AND coalesce(trim(company), '') = '' AND coalesce(trim(position), '') = '') AS BIGINT)
      AS restricted_profile_rows
    FROM raw_snap GROUP BY snapshot_ts""", "raw_snap")


def _dq_row(table: str, check: str, failed_sql: str, severity: str = "error") -> str:
    return (f"SELECT {_q(table)} AS \"table\", {_q(check)} AS \"check\", {_q(severity)} AS severity, "
            f"CAST(({failed_sql}) AS BIGINT) AS failed_rows, ({failed_sql}) = 0 AS passed")


def _dup(table: str, cols: str, where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    return f"SELECT count(*) FROM (SELECT {cols} FROM {table} {w} GROUP BY {cols} HAVING count(*) > 1) d"


cte("dim_date", """
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date_day
    FROM (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d
          FROM (SELECT min(connected_on) AS s,
                  greatest(max(connected_on), max(snapshot_date)) AS e FROM silver) b) x""",
    "silver")
oracle("dq_unique", " UNION ALL ".join([
    _dq_row("dim_company", "unique:company_key",
            _dup("dim_company", "company_key", "company_key IS NOT NULL")),
    _dq_row("dim_date", "unique:date_key", _dup("dim_date", "date_key", "date_key IS NOT NULL")),
    _dq_row("dim_date", "unique:date_day", _dup("dim_date", "date_day", "date_day IS NOT NULL")),
    _dq_row("fct_snapshot", "unique:connection_id,snapshot_ts",
            _dup("fact", "connection_id, snapshot_ts")),
    _dq_row("fct_snapshot", "unique:connection_snapshot_key",
            _dup("fact", "connection_snapshot_key", "connection_snapshot_key IS NOT NULL")),
    _dq_row("network_stats", "unique:snapshot_ts", _dup("stats", "snapshot_ts", "snapshot_ts IS NOT NULL")),
    _dq_row("breakdown", "unique:snapshot_ts,dimension_type,dimension_value",
            _dup("breakdown", "snapshot_ts, dimension_type, dimension_value")),
    _dq_row("silver", "unique:connection_id,snapshot_ts",
            _dup("silver", "connection_id, snapshot_ts", "connection_id IS NOT NULL")),
    _dq_row("dim_connection", "unique:scd_id", _dup("scd2", "scd_id", "scd_id IS NOT NULL")),
]), "dim_company", "dim_date", "fact", "stats", "breakdown", "silver", "scd2")


def _nn(table: str, col: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM {table} WHERE {col} IS NULL AND {where}"


oracle("dq_not_null", " UNION ALL ".join(
    [_dq_row("fct_snapshot", f"not_null:{c}", _nn("fact", c))
     for c in ("connection_snapshot_key", "connection_id", "company_key")]
    + [_dq_row("dim_company", f"not_null:{c}", _nn("dim_company", c))
       for c in ("company_key", "company_name")]
    + [_dq_row("silver", "not_null:connection_id", _nn("silver", "connection_id", "is_identifiable"))]
    + [_dq_row("silver", f"not_null:{c}", _nn("silver", c))
       for c in ("company_key", "connected_on", "snapshot_ts", "file_hash", "is_identifiable")]),
    "fact", "dim_company", "silver")
oracle("dq_accepted_values", " UNION ALL ".join([
    _dq_row("breakdown", "accepted_values:dimension_type",
            "SELECT count(*) FROM breakdown WHERE dimension_type NOT IN "
            "('company', 'position', 'connected_year_month')"),
    _dq_row("silver", "accepted_values:is_identifiable",
            "SELECT count(*) FROM silver WHERE is_identifiable NOT IN (true, false)"),
]), "breakdown", "silver")
oracle("dq_range", " UNION ALL ".join([
    _dq_row("dim_company", "in_range:current_connection_count",
            "SELECT count(*) FROM dim_company WHERE NOT (current_connection_count >= 0)"),
    _dq_row("network_stats", "in_range:total_connections",
            "SELECT count(*) FROM stats WHERE NOT (total_connections >= 0)"),
    _dq_row("silver", "in_range:connected_on",
            f"SELECT count(*) FROM silver WHERE NOT (connected_on >= DATE '2003-05-05' "
            f"AND connected_on <= DATE '{TODAY}')", "warn"),
]), "dim_company", "stats", "silver")


def _orphans(col: str, parent: str, pcol: str) -> str:
    return (f"SELECT count(*) FROM fact f WHERE f.{col} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pcol} = f.{col})")


oracle("dq_relationships", " UNION ALL ".join([
    _dq_row("fct_snapshot", "relationship:company_key", _orphans("company_key", "dim_company", "company_key")),
    _dq_row("fct_snapshot", "relationship:snapshot_date_key",
            _orphans("snapshot_date_key", "dim_date", "date_key")),
    _dq_row("fct_snapshot", "relationship:connected_on_date_key",
            _orphans("connected_on_date_key", "dim_date", "date_key")),
]), "fact", "dim_company", "dim_date")
oracle("dq_freshness", " UNION ALL ".join(
    f"SELECT {_q(f'freshness_{sev}:ingested_at')} AS \"check\", {_q(sev)} AS severity, "
    f"CAST(CASE WHEN age > {days} THEN 1 ELSE 0 END AS BIGINT) AS failed_rows, "
    f"coalesce(age <= {days}, false) AS passed "
    f"FROM (SELECT date_diff('day', CAST(max(ingested_at) AS DATE), DATE '{TODAY}') AS age "
    f"FROM raw_snap) a" for sev, days in (("warn", 30), ("error", 90))), "raw_snap")
oracle("dq_identifiable_share", """
    SELECT snapshot_ts, total_rows, identifiable_rows,
      CAST(identifiable_rows AS DOUBLE) / nullif(total_rows, 0) AS identifiable_share,
      coalesce(CAST(identifiable_rows AS DOUBLE) / nullif(total_rows, 0) < 0.9, false)
        AS below_threshold
    FROM (SELECT snapshot_ts, count(*) AS total_rows,
            CAST(sum(CASE WHEN is_identifiable THEN 1 ELSE 0 END) AS BIGINT) AS identifiable_rows
          FROM silver GROUP BY snapshot_ts) p""", "silver")
oracle("dq_volume_anomaly", """
    SELECT snapshot_ts, connection_count, previous_count,
      abs(connection_count - previous_count) / nullif(CAST(previous_count AS DOUBLE), 0)
        AS relative_change,
      coalesce(abs(connection_count - previous_count)
               / nullif(CAST(previous_count AS DOUBLE), 0) > 0.5, false) AS is_anomalous
    FROM (SELECT snapshot_ts, connection_count,
            lag(connection_count) OVER (ORDER BY snapshot_ts) AS previous_count
          FROM (SELECT snapshot_ts, count(*) AS connection_count FROM fact GROUP BY 1) a) b""",
    "fact")
oracle("dq_one_current", """
    SELECT 'one_open_version' AS "check", 'error' AS severity, count(*) AS failed_rows,
      count(*) = 0 AS passed
    FROM (SELECT connection_id FROM scd2 WHERE valid_to IS NULL GROUP BY 1
          HAVING count(*) > 1) x""", "scd2")
oracle("dq_one_batch", """
    SELECT 'one_batch_per_snapshot' AS "check", 'error' AS severity, count(*) AS failed_rows,
      count(*) = 0 AS passed
    FROM (SELECT snapshot_ts FROM raw_snap GROUP BY 1 HAVING count(DISTINCT file_hash) > 1) x""",
    "raw_snap")
oracle("dq_fact_orphans", """
    SELECT 'current_fact_rows_in_dim' AS "check", 'error' AS severity, count(*) AS failed_rows,
      count(*) = 0 AS passed
    FROM fact f LEFT JOIN (SELECT DISTINCT connection_id FROM scd2) d
      ON d.connection_id = f.connection_id
    WHERE f.snapshot_ts = (SELECT max(snapshot_ts) FROM fact) AND d.connection_id IS NULL""",
    "fact", "scd2")
oracle("dq_counts_agree", """
    SELECT s.snapshot_ts, s.distinct_companies,
      coalesce(b.n, 0) AS breakdown_company_count, s.distinct_companies = coalesce(b.n, 0) AS agrees
    FROM stats s LEFT JOIN (SELECT snapshot_ts, count(*) AS n FROM breakdown
                            WHERE dimension_type = 'company' AND dimension_value <> '(unknown)'
                            GROUP BY 1) b ON b.snapshot_ts = s.snapshot_ts""", "stats", "breakdown")
oracle("latest_snapshot", """
    SELECT * FROM raw_snap WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM raw_snap)""",
    "raw_snap")
oracle("ingestion_log", """
    SELECT snapshot_ts, file_hash, source_object, count(*) AS row_count,
      max(ingested_at) AS ingested_at, row_number() OVER (ORDER BY snapshot_ts DESC, source_object) AS log_order
    FROM raw_snap GROUP BY 1, 2, 3""", "raw_snap")
oracle("silver_clean", """
    SELECT nullif(trim(url), '') AS connection_id, nullif(trim(first_name), '') AS first_name,
      nullif(trim(last_name), '') AS last_name, nullif(trim(email_address), '') AS email_address,
      nullif(trim(company), '') AS company, nullif(trim(position), '') AS position,
      CAST(try_strptime(trim(connected_on), '%d %b %Y') AS DATE) AS connected_on,
      nullif(trim(connected_on), '') AS connected_on_raw, snapshot_ts, file_hash, source_object,
      source_row_number, ingested_at
    FROM raw_snap""", "raw_snap")
oracle("silver_dedup", """
    SELECT connection_id, first_name, last_name, email_address, company, position, connected_on,
      connected_on_raw, snapshot_ts, file_hash, source_object, source_row_number, ingested_at
    FROM silver""", "silver")

# --- landing zone / ingest --------------------------------------------------------------
_KEY_RX = r"^(.*/)?(\d{8}T\d{6}Z)_([0-9a-f]{8})\.csv$"
oracle("parse_key", f"""
    SELECT key, regexp_matches(key, {_q(_KEY_RX)}) AS is_valid,
      CASE WHEN regexp_matches(key, {_q(_KEY_RX)})
           THEN try_strptime(regexp_extract(key, {_q(_KEY_RX)}, 2), '%Y%m%dT%H%M%SZ') END
        AS snapshot_ts,
      CASE WHEN regexp_matches(key, {_q(_KEY_RX)}) THEN regexp_extract(key, {_q(_KEY_RX)}, 3) END
        AS hash8,
      CASE WHEN regexp_matches(key, {_q(_KEY_RX)}) THEN regexp_extract(key, {_q(_KEY_RX)}, 1) END
        AS prefix
    FROM (SELECT DISTINCT source_object AS key FROM raw_snap
          UNION ALL SELECT DISTINCT upper(source_object) FROM raw_snap) k""", "raw_snap")
oracle("build_key", f"""
    SELECT DISTINCT snapshot_ts, file_hash,
      '{LANDING_PREFIX}/' || strftime(snapshot_ts, '%Y%m%dT%H%M%SZ') || '_' || substr(file_hash, 1, 8)
        || '.csv' AS key
    FROM raw_snap""", "raw_snap")
oracle("content_hash", """
    SELECT snapshot_ts, source_row_number,
      md5(concat_ws(chr(31), coalesce(first_name, ''), coalesce(last_name, ''), coalesce(url, ''),
        coalesce(email_address, ''), coalesce(company, ''), coalesce(position, ''),
        coalesce(connected_on, ''))) AS row_hash
    FROM raw_snap""", "raw_snap")
oracle("pending_objects", """
    SELECT DISTINCT source_object AS key, snapshot_ts, substr(file_hash, 1, 8) AS hash8 FROM raw_snap
    WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM raw_snap)
    UNION ALL SELECT DISTINCT 'twin/' || source_object, snapshot_ts, substr(file_hash, 1, 8) FROM raw_snap""", "raw_snap")
oracle("notification_keys", """
    SELECT DISTINCT source_object, source_object AS key FROM raw_snap""", "raw_snap")
oracle("landing_inventory", """
    SELECT snapshot_ts, true AS is_valid, snapshot_ts < max(snapshot_ts) OVER () AS in_bronze
    FROM (SELECT DISTINCT snapshot_ts FROM raw_snap)
    UNION ALL SELECT CAST(NULL AS TIMESTAMP), false, false""", "raw_snap")
oracle("parse_exports", """
    SELECT snapshot_ts, source_row_number,
      coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name,
      coalesce(url, '') AS url, coalesce(email_address, '') AS email_address,
      coalesce(company, '') AS company, coalesce(position, '') AS position,
      coalesce(connected_on, '') AS connected_on
    FROM raw_snap""", "raw_snap")
oracle("header_check", """
    SELECT snapshot_ts, CASE WHEN k = 1 THEN ['position'] ELSE CAST([] AS VARCHAR[]) END AS missing_columns,
      CASE WHEN k = 2 THEN ['notes'] ELSE CAST([] AS VARCHAR[]) END AS unexpected_columns, k = 0 AS is_valid
    FROM (SELECT DISTINCT snapshot_ts, date_diff('day', DATE '2024-01-01', CAST(snapshot_ts AS DATE)) % 3 AS k
          FROM raw_snap)""", "raw_snap")
oracle("validate_exports", """
    SELECT snapshot_ts, count(*) AS row_count, 3 AS header_line_index, CAST(NULL AS VARCHAR) AS error,
      snapshot_ts < (SELECT max(snapshot_ts) FROM raw_snap) AS is_duplicate
    FROM raw_snap GROUP BY snapshot_ts""", "raw_snap")
oracle("hash_mismatch", """
    SELECT snapshot_ts, unnest(CASE WHEN k = 1 THEN ['hash_mismatch', 'hash_mismatch']
                                    ELSE ['ingested', 'skipped_duplicate'] END) AS status
    FROM (SELECT DISTINCT snapshot_ts, date_diff('day', DATE '2024-01-01', CAST(snapshot_ts AS DATE)) % 2 AS k
          FROM raw_snap)""", "raw_snap")
oracle("bronze_append", """
    SELECT snapshot_ts, count(*) AS rows FROM raw_snap GROUP BY snapshot_ts""", "raw_snap")
oracle("ingest_report", """
    SELECT count(DISTINCT snapshot_ts) AS objects_scanned,
      count(DISTINCT snapshot_ts) AS objects_ingested, CAST(0 AS BIGINT) AS objects_skipped_duplicate,
      CAST(0 AS BIGINT) AS objects_rejected, count(*) AS rows_ingested FROM raw_snap""", "raw_snap")
oracle("ingest_batch", """
    SELECT snapshot_ts, 'ingested' AS status, count(*) AS rows_ingested
    FROM raw_snap GROUP BY snapshot_ts""", "raw_snap")
oracle("stream_ingest", ORACLES["ingest_batch"])
oracle("late_snapshot", "SELECT * FROM stats", "stats")

# --- the orders adapter: the same chain over quarterly customer exports ----------------
import re as _re  # noqa: E402

_ORDERS_RENAME = {"raw_snap": "raw_snap_orders", "silver": "silver_orders", "ident": "ident_o",
                  "seq": "seq_o", "fact": "fact_o", "stats": "stats_o", "scd_flags": "scd_flags_o",
                  "scd_islands": "scd_islands_o", "scd2": "scd2_o", "breakdown": "breakdown_o"}


def _renamed(sql: str) -> str:
    return _re.sub(r"\b(" + "|".join(_ORDERS_RENAME) + r")\b",
                   lambda m: _ORDERS_RENAME[m.group(1)], sql)


for _name in ("ident", "seq", "fact", "stats", "scd_flags", "scd_islands", "scd2", "breakdown"):
    _sql, _deps = CTES[_name]
    cte(_ORDERS_RENAME[_name], _renamed(_sql), *[_ORDERS_RENAME.get(d, d) for d in _deps])

oracle("orders_silver", "SELECT * FROM silver_orders", "silver_orders")
oracle("orders_network_stats", "SELECT * FROM stats_o", "stats_o")
oracle("orders_scd2_replay", "SELECT * FROM scd2_o", "scd2_o")
oracle("orders_breakdown", "SELECT * FROM breakdown_o", "breakdown_o")
oracle("breakdown_union", "SELECT * FROM breakdown", "breakdown")
oracle("parse_exports_split", ORACLES["parse_exports"])
oracle("newest_export", ORACLES["parse_exports"] + " WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM raw_snap)")
oracle("delta_stats", ORACLES["network_stats"])
oracle("delta_fact", ORACLES["fct_snapshot"])
oracle("delta_breakdown", ORACLES["breakdown"])
oracle("delta_company", ORACLES["dim_company"])

# --- column checks, shortlist files, pipeline report, scripts -----------------------------
oracle("dq_columns", """
    SELECT 'columns_exact' AS "check", 'error' AS severity, 2 AS failed_rows, false AS passed, 'odd' AS frame
    UNION ALL SELECT 'row_count_at_least_1', 'error', 0, count(*) >= 1, 'odd' FROM raw_snap
    UNION ALL SELECT 'not_null:notes', 'error', count(*), count(*) = 0, 'odd' FROM raw_snap
    UNION ALL SELECT 'columns_exact', 'error', 0, true, 'exports'
    UNION ALL SELECT 'row_count_at_least_1', 'error', 0, count(*) >= 1, 'exports' FROM raw_snap
    UNION ALL SELECT 'not_null:url', 'error', count(*) FILTER (url IS NULL), count(*) FILTER (url IS NULL) = 0, 'exports'
    FROM raw_snap""", "raw_snap")
oracle("export_shortlist", f"""
    SELECT full_name AS name, coalesce(company, '—') AS company, coalesce(position, '—') AS position,
      CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE '—' END AS tags,
      coalesce(strftime(connected_on, '%Y-%m-%d'), '—') AS connected, CAST(score AS VARCHAR) AS score,
      score_reason AS why, {_DISPLAY_URL} AS profile
    FROM scored""", "scored")
from tidemark.functions.text import SCRIPT_NAMES as _SCRIPTS  # noqa: E402

oracle("search_scripts", "SELECT c_custkey, CASE CAST(c_custkey % " + str(len(_SCRIPTS)) + " AS INT) " + " ".join(
    f"WHEN {i} THEN {_q(needle)}" for i, (_, needle) in enumerate(_SCRIPTS)) + " END AS hits FROM customer")
oracle("pipeline_run", """
    SELECT 'ingest' AS stage, 'ok' AS status, count(*) AS rows FROM raw_snap
    UNION ALL SELECT 'gate', 'ok', NULL
    UNION ALL SELECT 'quality', CASE WHEN count(*) FILTER (NOT regexp_matches(connected_on,
      '^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$')) > 0 THEN 'failed' ELSE 'ok' END, NULL FROM raw_snap
    UNION ALL SELECT 'silver', 'ok', count(*) FROM silver
    UNION ALL SELECT 'scd2', 'ok', count(*) FROM scd2
    UNION ALL SELECT 'gold', 'ok', count(*) FROM fact
    UNION ALL SELECT 'tests', 'warn', NULL
    UNION ALL SELECT 'counts_agree', 'ok', NULL
    UNION ALL SELECT 'freshness', 'ok', NULL""", "raw_snap", "silver", "scd2", "fact")

_ZERO = "connection_id LIKE '%0'"
oracle("dq_negatives", " UNION ALL ".join([
    _dq_row("fct_snapshot", "unique:connection_snapshot_key", f"SELECT count(*) FROM fact WHERE {_ZERO}"),
    _dq_row("fct_snapshot", "relationship:company_key",
            f"SELECT count(*) + count(*) FILTER ({_ZERO}) FROM fact WHERE company_key >= '8'"),
    _dq_row("breakdown", "accepted_values:dimension_type",
            "SELECT count(*) FROM breakdown WHERE dimension_type = 'position'"),
    _dq_row("breakdown", "in_range:connection_count",
            "SELECT count(*) FROM breakdown WHERE connection_count NOT BETWEEN 2 AND 20"),
    _dq_row("dim_connection", "one_open_version",
            f"SELECT count(DISTINCT connection_id) FROM scd2 WHERE valid_to IS NULL AND {_ZERO}"),
    _dq_row("raw_snap", "one_batch_per_snapshot",
            "SELECT count(*) FROM (SELECT snapshot_ts FROM raw_snap WHERE day(snapshot_ts) % 3 = 0 GROUP BY 1 "
            "HAVING count(DISTINCT source_row_number % 2) = 2) a"),
    _dq_row("fct_snapshot", "current_fact_rows_in_dim",
            f"SELECT count(*) FROM fact WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM fact) AND {_ZERO}"),
    _dq_row("network_stats", "counts_agree",
            "SELECT count(*) FROM stats s WHERE s.distinct_companies <> (SELECT count(*) FROM breakdown b "
            "WHERE b.snapshot_ts = s.snapshot_ts AND b.dimension_type = 'company' AND b.rank_within_dimension > 2 "
            "AND b.dimension_value <> '(unknown)')"),
    _dq_row("fct_snapshot", "volume_anomaly",
            "SELECT count(*) FROM (SELECT n, lag(n) OVER (ORDER BY snapshot_ts) AS p FROM (SELECT snapshot_ts, "
            f"count(*) AS n FROM fact WHERE day(snapshot_ts) % 2 = 1 OR {_ZERO} GROUP BY 1) a) b "
            "WHERE abs(n - p) > 0.5 * p"),
    _dq_row("restricted", "in_range:restricted_profile_rows",
            "SELECT count(*) FROM (SELECT snapshot_ts FROM raw_snap WHERE source_row_number % 13 = 0 GROUP BY 1) a"),
]), "fact", "breakdown", "scd2", "raw_snap", "stats")
oracle("parameterised_read", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 3")
oracle("versioned_table", "SELECT snapshot_ts, count(*) AS rows FROM silver GROUP BY 1", "silver")
oracle("layer_status", """
    SELECT 'bronze' AS layer, count(*) > 0 AS present, CAST(NULL AS VARCHAR) AS version FROM raw_snap
    UNION ALL SELECT 'silver', count(*) > 0, 'v1' FROM silver
    UNION ALL SELECT unnest(['dim_connection', 'mart_network_stats']), false, NULL""", "raw_snap", "silver")
oracle("seeded_exports", """
    SELECT snapshot_ts + to_days(7 * CAST(step AS INT)) AS snapshot_ts, count(*) AS rows,
      count(*) FILTER (step > 0 AND source_row_number % 5 = 0) AS moved
    FROM raw_snap, (SELECT unnest([0, 1, 2, 3]) AS step) s
    WHERE snapshot_ts = (SELECT min(snapshot_ts) FROM raw_snap) AND (step = 0 OR source_row_number % 10 <> step)
    GROUP BY 1""", "raw_snap")
oracle("naive_utc", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS same,
      strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS from_zone FROM events""")
