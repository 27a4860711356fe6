"""URL verdicts: host-path rules first, then indexed pattern rules.

Pattern rules are regular expressions with the literal tokens that any match
must contain. Each rule is indexed by the one of its literals that the fewest
URLs hold (counted over the whole table); the tokens of a URL fetch the rules
indexed by them, and only these regular expressions run. Everything is a
DataFrame expression inside the scan stage: no row is shuffled for a verdict.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule, and the verdict ``allow``; repeated rows are judged one by one; an empty
table gives an empty result; ties between host-path rules of one length cannot
both fit (same host suffix and path prefix of one length are the same rule).
The rule lists are parameters, at most ``MAX_RULES`` entries each (checked).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sqltext import lit as lit_str

MAX_RULES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is matched in the lower-cased url; every match contains all
    ``literals`` (runs of ``[a-z0-9]``) as whole tokens."""

    pattern: str
    literals: tuple[str, ...]


#: Production rules.
PATH_RULES = (
    PathRule("block", "net", "/"), PathRule("allow", "example.net", "/en/"),
    PathRule("block", "example.com", "/de/"), PathRule("allow", "org", "/fr/"),
)
PATTERN_RULES = (
    PatternRule(r"://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    PatternRule(r"://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    PatternRule(r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule(r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule(r"://([^/?#]*[.-])?adult-(videos|photos)\.", ("adult",)),
    PatternRule(r"/wp-login\.php([?#]|$)", ("wp", "login", "php")),
    PatternRule(r"[?&]aff_?id=[0-9]+", ()),
)


def _index(urls: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, list[str]]:
    """Pattern rules by their rarest literal token ('' without a literal).

    One pass counts, for the literals of the rules only, the URLs that hold
    them; at most one small row per literal reaches the driver.
    """
    words = sorted({x for r in rules for x in r.literals})
    counts: dict[str, int] = {}
    if words:
        listed = ", ".join(lit_str(w) for w in words)
        held = urls.selectExpr(
            f"explode(array_distinct(filter(split(translate(url, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), "
            f"t -> t in ({listed})))) as token")
        counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[str]] = {}
    for r in rules:
        key = min(r.literals, key=lambda x: (counts.get(x, 0), x), default="")
        index.setdefault(key, []).append(r.pattern)
    return index


def _pattern_verdict(index: dict[str, list[str]]) -> str:
    """SQL for: some rule that the tokens of ``url_lower`` fetch matches."""
    always = " or ".join(f"url_lower rlike {lit_str(p)}" for p in index.get("", []))
    keyed = {k: v for k, v in index.items() if k}
    parts = [f"({always})"] if always else []
    if keyed:
        listed = ", ".join(lit_str(k) for k in keyed)
        cases = " ".join(
            f"when t = {lit_str(k)} then " + " or ".join(f"url_lower rlike {lit_str(p)}" for p in v)
            for k, v in keyed.items())
        parts.append("exists(filter(split(url_lower, '[^a-z0-9]+'), "
                     f"t -> t in ({listed})), t -> case {cases} else false end)")
    return " or ".join(parts) or "false"


def url_verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                 path_rules: tuple[PathRule, ...] = PATH_RULES,
                 pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    if max(len(path_rules), len(pattern_rules)) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    index = _index(rows, pattern_rules)
    fits = []
    for r in sorted(path_rules, key=lambda r: (-len(r.name), r.name)):
        host, path = lit_str(r.host), lit_str(r.path)
        fits.append((f"(host = {host} or endswith(host, {lit_str('.' + r.host)})) and startswith(path, {path})", r))
    rule = "case " + " ".join(f"when {c} then {lit_str(r.name)}" for c, r in fits) + " end" if fits else "string(null)"
    judged = "case " + " ".join(
        [f"when {c} then {lit_str(r.verdict)}" for c, r in fits]
        + [f"when {_pattern_verdict(index)} then 'block' else 'allow' end"])
    after = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
    return (
        rows.selectExpr("page_id", f"coalesce({after}, '') as rest",
                        f"coalesce(translate(url, '{UPPER}', '{LOWER}'), '') as url_lower")
        .selectExpr("page_id", "url_lower", "regexp_extract(rest, '^([^/?#]*)', 1) as raw_host",
                    "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path")
        .selectExpr("page_id", "url_lower", f"translate(raw_host, '{UPPER}', '{LOWER}') as host", "path")
        .selectExpr("page_id", "host", "path", f"{rule} as rule", f"{judged} as verdict")
    )


def url_verdicts_sql(pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same rows in DuckDB SQL, with every pattern tried on every url."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    patterns = " or ".join(f"regexp_matches(low, {quoted(r.pattern)})" for r in pattern_rules)
    return f"""
with p as (
  select page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') as low,
         case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages),
q as (
  select page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p),
fit as (
  select q.*, r.host || r.path as rule, r.verdict as said
  from q left join (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                           ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(verdict, host, path)
    on (q.host = r.host or suffix(q.host, '.' || r.host)) and starts_with(q.path, r.path)),
best as (
  select *, row_number() over (partition by page_id order by length(rule) desc nulls last) as k from fit)
select page_id, host, path, rule,
       coalesce(said, case when {patterns} then 'block' else 'allow' end) as verdict
from best where k = 1
"""
