"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); a cell weighs its tokens
(words ``[^\\x20\\x09-\\x0D]+``). Raking scales the cells in turn until their
sums by source, by language and by topic meet the targets: the natural share of
each value raised to a power per margin (1 keeps it, 0 makes all equal). The
ratio of raked to natural weight, divided by its maximum, is the probability
with which the documents of a cell are kept; a document is kept if the fraction
that its id's MD5 gives is below it, so the choice is repeatable.

Raking goes on in blocks of ``ROUNDS`` rounds until no margin is off its target
by more than ``TOLERANCE`` of it. Targets that the observed cells cannot meet
(a block brings the error down by less than ``STALL``, or ``MAX_ROUNDS`` are
over) keep the weights of the first block, with a warning that gives the error:
the rounds would go on between contradicting margins and starve cells.

Only the table of cells (one row per observed combination) is raked, by window
sums; texts are read, never shuffled. The cells are broadcast to the documents
below ``BROADCAST_CELLS`` rows (counted), else joined.

Defined cases: null source, language or topic is the value ``(none)``; null or
blank texts weigh nothing and are never kept; ids may repeat or be null (equal
ids share one fraction); an empty table gives an empty result. All figures are
DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Production parameters: power of the natural share per margin, and rounds of
#: a block.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS = 8
#: Largest relative error of a margin, least progress of a block, most rounds.
TOLERANCE, STALL, MAX_ROUNDS = 1e-4, 0.01, 800
BROADCAST_CELLS = 50_000
NONE = "(none)"
#: Topic of a text by its form: SQL over ``text``, the same in both dialects.
TOPIC = ("case when text is null then null when instr(text, ' | ') > 0 then 'table' "
         "when instr(text, '@') > 0 then 'contact' when instr(text, 'icense') > 0 then 'legal' "
         "when instr(text, '***') > 0 or instr(text, '%%%') > 0 then 'marked' else 'prose' end")
_WORDS = "'[^\\\\x20\\\\x09-\\\\x0D]+'"
#: The fraction in [0, 1) of a document: the first 52 bits of its id's MD5.
_FRACTION = "conv(substr(md5(cast(coalesce(cast(doc_id as string), '') as binary)), 1, 13), 16, 10) / 4503599627370496D"


def cell_expressions(source: str = "source", lang: str = "lang", text: str = "text", topic: str = TOPIC) -> dict:
    """SQL of the cell of a document and of its weight."""
    body = topic.replace("text", f"`{text}`")
    return {"source": f"coalesce(`{source}`, '{NONE}')", "lang": f"coalesce(`{lang}`, '{NONE}')",
            "topic": f"coalesce({body}, '{NONE}')",
            "n_tokens": f"cast(regexp_count(coalesce(`{text}`, ''), {_WORDS}) as bigint)"}


def rake(cells: DataFrame, powers: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Margins and ``factor`` of every cell: raked over natural weight.

    ``cells`` has one row per combination of the margins and its ``w0`` > 0.
    """
    powers = dict(POWERS if powers is None else powers)
    base = df = cut(cells)
    for m, power in powers.items():
        share = base.groupBy(m).agg(F.sum("w0").alias("s")).selectExpr(m, f"pow(s, {power!r}D) as p")
        total = share.agg(F.sum("p")).scalar()
        df = df.join(share.select(m, (F.col("p") / total).alias(f"t_{m}")), m)
    df = df.withColumn("w", F.col("w0").cast("double"))

    def block(df: DataFrame) -> tuple[DataFrame, float]:
        for _ in range(rounds):
            for m in powers:
                df = df.withColumn("w", F.expr(f"w * t_{m} / sum(w) over (partition by {m})"))
        df = cut(df)
        off = [f"abs(sum(w) over (partition by {m}) / t_{m} - 1)" for m in powers]
        worst = df.selectExpr(f"greatest({', '.join([*off, '0D'])}) as e").agg(F.max("e")).first()[0]
        return df, worst or 0.0

    first, error = block(df)
    df, done = first, rounds
    while error > TOLERANCE:
        before = error
        df, error = block(df)
        done += rounds
        if error > TOLERANCE and (error > (1 - STALL) * before or done >= MAX_ROUNDS):
            warnings.warn(f"mixture targets not met: a margin is off by {error:.2g} of its target after {done} rounds; "
                          f"weights of the first {rounds} rounds are used", stacklevel=2)
            df = first
            break
    return df.select(*powers, (F.col("w") / F.col("w0")).alias("factor"))


def mixed(docs: DataFrame, names: dict[str, str], powers: dict[str, float] | None = None,
          rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (with columns named by ``names``, see below) and the columns
    probability and kept; rows without weight have probability 0.

    names: the columns that hold source, lang, topic, n_tokens and fraction.
    """
    margins = list(POWERS if powers is None else powers)
    cells = (docs.where(f"{names['n_tokens']} > 0").groupBy(*(F.col(names[m]).alias(m) for m in margins))
             .agg(F.sum(names["n_tokens"]).alias("w0")))
    factors = rake(cells, powers, rounds)
    top = factors.agg(F.max("factor")).scalar()
    odds = factors.select(*(F.col(m).alias(f"_{m}") for m in margins), (F.col("factor") / top).alias("_odds"))
    if factors.count() <= BROADCAST_CELLS:
        odds = F.broadcast(odds)
    same = " and ".join(f"{names[m]} = _{m}" for m in margins)
    chance = f"case when {names['n_tokens']} > 0 then coalesce(_odds, 0D) else 0D end"
    return (docs.join(odds, F.expr(same), "left").drop(*(f"_{m}" for m in margins))
            .withColumn("probability", F.expr(chance)).drop("_odds")
            .withColumn("kept", F.expr(f"{names['fraction']} < probability")))


def raked_mixture(docs: DataFrame, doc_id: str = "doc_id", powers: dict[str, float] | None = None,
                  rounds: int = ROUNDS, **columns) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept of every document."""
    cell = cell_expressions(**columns)
    rows = cut(docs.selectExpr(f"`{doc_id}` as doc_id", *(f"{v} as {k}" for k, v in cell.items())))
    rows = rows.withColumn("fraction", F.expr(_FRACTION))
    names = {x: x for x in (*cell, "fraction")}
    return mixed(rows, names, powers, rounds).select("doc_id", *cell, F.round("probability", 6).alias("probability"),
                                                     "kept")


def keep_mixture(docs: DataFrame, doc_id: str = "doc_id", powers: dict[str, float] | None = None,
                 rounds: int = ROUNDS, **columns) -> DataFrame:
    """The sampled documents with their own columns only."""
    cell = {**cell_expressions(**columns), "fraction": _FRACTION.replace("doc_id", f"`{doc_id}`")}
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                      *(F.expr(v).alias(k) for k, v in cell.items()))
    return mixed(own, {k: k for k in cell}, powers, rounds).where("kept").select("row.*")


def raked_mixture_sql(powers: dict[str, float] | None = None, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB SQL, the rounds of the first block written out: equal where these are enough, or the
    targets cannot be met."""
    powers = dict(POWERS if powers is None else powers)
    margins = list(powers)
    steps, last = [], "r0"
    for i in range(rounds):
        for m in margins:
            name = f"r{i}_{m}"
            steps.append(f"{name} as (select * replace (w * t_{m} / sum(w) over (partition by {m}) as w) from {last})")
            last = name
    shares = ", ".join(f"s_{m} as (select {m}, pow(sum(w0), {p}) as p from cells group by {m}), "
                       f"t_{m} as (select {m}, p / (select sum(p) from s_{m}) as t_{m} from s_{m})"
                       for m, p in powers.items())
    return f"""
with d as (
  select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang,
         coalesce({TOPIC}, '{NONE}') as topic,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / 4503599627370496.0
           as fraction
  from documents),
cells as (select {', '.join(margins)}, sum(n_tokens) as w0 from d where n_tokens > 0 group by {', '.join(margins)}),
{shares},
r0 as (select cells.*, {', '.join(f't_{m}' for m in margins)}, cast(w0 as double) as w
       from cells {' '.join(f'join t_{m} using ({m})' for m in margins)}),
{', '.join(steps)},
f as (select {', '.join(margins)}, w / w0 as factor from {last}),
g as (select *, factor / max(factor) over () as odds from f),
p as (select d.*, case when n_tokens > 0 then coalesce(odds, 0) else 0 end as chance
      from d left join g using ({', '.join(margins)}))
select doc_id, source, lang, topic, n_tokens, round(chance, 6) as probability, fraction < chance as kept from p
"""
