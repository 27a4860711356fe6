"""String expressions: trimming, blanks, company normalisation, accent folding."""

from __future__ import annotations


import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx

#: Unicode space separators at either end (U+00A0 included). Spark's ``trim``
#: only strips ASCII space, while the export parser stripped every Unicode
#: blank, so this is the trim the Silver layer uses.
_EDGE_SPACE = r"^\p{Zs}+|\p{Zs}+$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Each helper has an SQL-text form (``*_sql``: column name or SQL text in,
# SQL text out) used to build wide projections in one parse, and a Column
# form; a name given to the Column form goes through the SQL text.
def trim_ws_sql(c: str) -> str:
    return f"regexp_replace({sx.ref(c)}, {sx.lit(_EDGE_SPACE)}, '')"


def trim_ws(c: str | Column) -> Column:
    if isinstance(c, str):
        return F.expr(trim_ws_sql(c))
    return F.regexp_replace(c, _EDGE_SPACE, "")


def nullif_blank_sql(c: str) -> str:
    return f"nullif({trim_ws_sql(c)}, '')"


def nullif_blank(c: str | Column) -> Column:
    """``nullif(trim(x), '')``: blank and null collapse to null."""
    if isinstance(c, str):
        return F.expr(nullif_blank_sql(c))
    trimmed = trim_ws(c)
    return F.when(trimmed == "", F.lit(None).cast("string")).otherwise(trimmed)


def is_blank_sql(c: str) -> str:
    return f"(coalesce({trim_ws_sql(c)}, '') = '')"


def is_blank(c: str | Column) -> Column:
    """True for null, empty or all-space values."""
    if isinstance(c, str):
        return F.expr(is_blank_sql(c))
    return F.coalesce(trim_ws(c), F.lit("")) == ""


def normalise_company_sql(c: str) -> str:
    return f"regexp_replace(lower({trim_ws_sql(c)}), {sx.lit(r'\s+')}, ' ')"


def normalise_company(c: str | Column) -> Column:
    """Lower-case, trim and squeeze inner whitespace so spelling variants merge."""
    if isinstance(c, str):
        return F.expr(normalise_company_sql(c))
    return F.regexp_replace(F.lower(trim_ws(c)), r"\s+", " ")


def snake_case(c: str | Column) -> Column:
    """Header text to snake_case: non-alphanumerics become separators."""
    squeezed = F.regexp_replace(trim_ws(c), r"[^\p{L}\p{N}]+", " ")
    return F.regexp_replace(F.lower(F.trim(squeezed)), " ", "_")


# --- accent folding ---------------------------------------------------------
# Letters that are not an accented form of another letter, so a
# canonical decomposition leaves them alone; search still treats them as "d".
FOLD_EXCEPTIONS_FROM = "đĐð"
FOLD_EXCEPTIONS_TO = "dDd"


#: The arithmetic of composed Hangul syllables.
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
HANGUL_LEAD, HANGUL_VOWEL, HANGUL_TAIL = (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def fold_text(text: str) -> str:
    """The folding rule: special letters, canonical decomposition, marks
    dropped, case folded. It works letter by letter, so the column form below
    is generated from it and both sides of a search follow one rule."""
    plain = text.translate(str.maketrans(FOLD_EXCEPTIONS_FROM, FOLD_EXCEPTIONS_TO))
    return "".join(x for x in unicodedata.normalize("NFD", plain) if not unicodedata.combining(x)).casefold()


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) of one ``translate`` pass, and the letters that fold to
    several, generated from the running Python's Unicode database.

    Letters that fold to one other letter come first, then (without a
    counterpart in ``to``, so ``translate`` deletes them) those that fold to
    nothing. Hangul syllables go by arithmetic instead.
    """
    src, dst, gone, longer = [], [], [], []
    for cp in range(0x30000):
        ch = chr(cp)
        if HANGUL_FIRST <= cp <= HANGUL_LAST or 0xD800 <= cp <= 0xDFFF:
            continue
        to = fold_text(ch)
        if not to:
            gone.append(ch)
        elif len(to) > 1:
            longer.append((ch, to))
        elif to != ch:
            src.append(ch)
            dst.append(to)
    return "".join(src + gone), "".join(dst), tuple(longer)


def _hangul_sql(x: str) -> str:
    """SQL: the letters of every composed syllable of ``x``."""
    letters = lambda first, n: sx.str_array(chr(first + i) for i in range(n))
    tails = sx.str_array(["", *(chr(HANGUL_TAIL[0] + i) for i in range(1, HANGUL_TAIL[1]))])
    code = f"(ascii(c) - {HANGUL_FIRST})"
    each = (f"CASE WHEN ascii(c) BETWEEN {HANGUL_FIRST} AND {HANGUL_LAST} THEN concat("
            f"{letters(*HANGUL_LEAD)}[CAST({code} DIV 588 AS INT)], "
            f"{letters(*HANGUL_VOWEL)}[CAST({code} % 588 DIV 28 AS INT)], "
            f"{tails}[CAST({code} % 28 AS INT)]) ELSE c END")
    return f"array_join(transform(split({x}, ''), c -> {each}), '')"


def _ranges(letters: str, gap: int = 8) -> str:
    """A regex class of a few ranges that holds the letters (and others that
    lie between them: the class only says which texts take the longer way)."""
    points, out = sorted(map(ord, letters)), []
    for cp in points:
        if out and cp - out[-1][1] <= gap:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


#: The one letter that folds to several and is frequent: its own replacement
#: costs less than to look for it first.
SHARP_S = "ß"


def fold_accents_sql(c: str) -> str:
    """SQL text of :func:`fold_text` over a column ('' for null): lower case for
    ASCII texts, else one ``translate`` pass; only texts that hold a Hangul
    syllable or another letter that folds to several take one more step. Every
    branch is a built-in function of generated code but the Hangul arithmetic."""
    src, dst, longer = _fold_tables()
    source = f"coalesce({sx.ref(c)}, '')"
    once = lambda x: f"translate({x}, {sx.lit(src)}, {sx.lit(dst)})"

    def many(x: str) -> str:
        out = once(x)
        for ch, to in longer:
            out = f"replace({out}, {sx.lit(ch)}, {sx.lit(to)})"
        return out

    rare = sx.lit(_ranges("".join(ch for ch, _ in longer if ch != SHARP_S)))
    syllables = sx.lit(f"[{chr(HANGUL_FIRST)}-{chr(HANGUL_LAST)}]")
    return (f"CASE WHEN octet_length({source}) = length({source}) THEN lower({source}) "
            f"WHEN {source} rlike {syllables} THEN {many(_hangul_sql(source))} "
            f"WHEN {source} rlike {rare} THEN {many(source)} "
            f"ELSE replace({once(source)}, {sx.lit(SHARP_S)}, {sx.lit(fold_text(SHARP_S))}) END")


def fold_accents(c: str) -> Column:
    """Accent-blind, case-blind form of a string column ('' for null)."""
    return F.expr(fold_accents_sql(c))


def contains_folded(haystack: str, needle: str) -> Column:
    """Literal (not regex) accent-blind substring test over a column or SQL text."""
    folded = fold_text(needle.strip())
    return F.locate(folded, fold_accents(haystack)) > 0 if folded else F.lit(True)


#: Sample names in several scripts and, for each, a needle in another spelling.
SCRIPT_NAMES = (("김철수", "김철"), ("ΟΔΟΣ ΑΘΗΝΩΝ", "οδός"), ("ﬁnance oﬃce", "FINANCE OFFICE"), ("Nguyễn Đức", "nguyen duc"),
                ("Straße", "STRASSE"), ("İzmir", "izmir"))
