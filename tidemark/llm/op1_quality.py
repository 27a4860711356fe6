"""Quality rules by repetition coverage.

Every text is seen as words ``[^\\x20\\x09-\\x0D]+`` and as lines split at
``\\n``. Rolling 64-bit hashes of word n-grams of several lengths, computed in
numpy over slices of an Arrow batch, find the n-grams that occur twice or more
inside one text; the characters inside them (each counted once, first
occurrences included) over all word characters is the coverage of that length.
Duplicated lines are measured alike, the first occurrence left out.

Defined cases: a null or empty text has no words, so it fails the base rule; a
text of any length is read whole; repeated rows each get their own verdict; an
empty table gives an empty result. Input columns other than the two named ones
are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (SPACE, RollingHash, lut, mix64, packed, per_row,
                                 row_slices, small_batches, tidy, utf8_view, words_of)

#: Production limits: share of word characters inside n-grams found twice or
#: more, by n-gram length, and share of line characters in repeated lines
#: (Rae et al. 2021, Scaling Language Models, table A1).
MAX_COVERAGE: dict[int, float] = {5: 0.15, 7: 0.13, 10: 0.10}
MAX_LINE_COVERAGE = 0.20
#: Production limit: symbol characters per word. On sf0.1 tables (cell bars)
#: have 0.1 to 0.5, texts with marks strewn in more, all others under 0.01.
MAX_SYMBOLS_PER_WORD = 0.5
MIN_WORDS = 50
SYMBOLS = lut(*map(ord, "#*$%&|<>"))

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key occurs twice or more, it occurred earlier) for every position."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    more = later.copy()
    more[order[:-1]] |= same
    return more, later


def _covered(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in an n-word window found twice or more in their row."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < n:
        return out
    with np.errstate(over="ignore"):
        gram = hashes[:len(hashes) - n + 1].copy()
        for j in range(1, n):
            gram = gram * np.uint64(RollingHash.BASE) + hashes[j:len(hashes) - n + 1 + j]
    at = np.flatnonzero(row[:len(hashes) - n + 1] == row[n - 1:])
    if not len(at):
        return out
    with np.errstate(over="ignore"):
        keys = mix64(gram[at] + mix64(row[at].astype(np.uint64) + np.uint64(1)))
    hit = at[_repeated(keys)[0]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], hasher: RollingHash) -> dict:
    """Counts and coverages of the rows of one slice."""
    n = len(offsets) - 1
    lead = (buf & 0xC0) != 0x80  # first bytes: one for each code point
    starts, ends, row = words_of(buf, offsets)
    word_hash = hasher.runs(buf, starts, ends)
    chars = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    word_len = chars[ends] - chars[starts]
    word_chars = np.bincount(row, word_len, n).astype(np.int64)
    out = {
        "n_words": np.bincount(row, minlength=n).astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": per_row(SYMBOLS[buf], offsets),
        "n_repeat_words": np.bincount(row[_covered(word_hash, row, 3)], minlength=n).astype(np.int64),
    }
    for k in lengths:
        cover = _covered(word_hash, row, k)
        inside = np.bincount(row[cover], word_len[cover], n)
        out[k] = inside / np.maximum(word_chars, 1)

    # lines: a row of bytes [o, p) has its breaks, and p itself, as line ends
    breaks = np.flatnonzero(buf == 0x0A)
    line_end = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    owner = np.concatenate((np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)))
    owner = owner[np.argsort(np.concatenate((breaks, offsets[1:])), kind="stable")]
    line_start = np.empty(len(line_end), np.int64)
    if len(line_end):
        line_start[0] = offsets[0]
        line_start[1:] = line_end[:-1] + 1
        new = np.ones(len(line_end), bool)
        new[1:] = owner[1:] != owner[:-1]
        line_start[new] = offsets[owner[new]]
    ink = np.concatenate(([0], np.cumsum(~SPACE[buf], dtype=np.int64)))
    has_word = ink[line_end] > ink[line_start]
    line_start, line_end, owner = line_start[has_word], line_end[has_word], owner[has_word]
    with np.errstate(over="ignore"):
        keys = mix64(hasher.runs(buf, line_start, line_end) + mix64(owner.astype(np.uint64) + np.uint64(1)))
    later = _repeated(keys)[1]
    line_len = chars[line_end] - chars[line_start]
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n).astype(np.int64)
    total = np.bincount(owner, line_len, n)
    out["lines"] = np.bincount(owner[later], line_len[later], n) / np.maximum(total, 1)
    return out


def quality(text: Column, max_coverage: dict[int, float] | None = None,
            max_line_coverage: float = MAX_LINE_COVERAGE,
            max_symbols_per_word: float = MAX_SYMBOLS_PER_WORD,
            min_words: int = MIN_WORDS) -> tuple[Column, str, str]:
    """Struct of the counts and coverages of a text column, and, over that
    struct as ``s``, the SQL of the base rule's failure and of the method's."""
    limits = dict(MAX_COVERAGE if max_coverage is None else max_coverage)
    lengths = tuple(sorted(limits))
    kind = ", ".join([*(f"{f}: bigint" for f in FIELDS), *(f"coverage_{k}: double" for k in lengths),
                      "line_coverage: double"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = RollingHash()
        for batch in batches:
            buf, offsets = utf8_view(batch)
            parts = [measure(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lengths, hasher)
                     for lo, hi in row_slices(offsets)]
            join = lambda k, t: np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(t)
            yield pa.StructArray.from_arrays(
                [*(pa.array(join(f, np.int64)) for f in FIELDS),
                 *(pa.array(join(k, np.float64)) for k in lengths), pa.array(join("lines", np.float64))],
                names=[*FIELDS, *(f"coverage_{k}" for k in lengths), "line_coverage"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    stats = F.arrow_udf(tidy(run), "struct<" + kind + ">")(text)
    over = " or ".join([f"s.coverage_{k} > {limits[k]!r}D" for k in lengths]
                       + [f"s.line_coverage > {max_line_coverage!r}D",
                          f"s.n_symbols > {max_symbols_per_word!r}D * s.n_words"])
    return stats, f"s.n_words < {min_words} or 100 * s.n_repeat_words > 50 * s.n_words", over


def repetition_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """doc_id, counts, coverages, base_failed and kept of every document."""
    stats, base, over = quality(F.col("text"), **limits)
    return (small_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .select("doc_id", stats.alias("s"))
            .selectExpr("doc_id", "s.*", f"({base}) as base_failed", f"not ({base}) and not ({over}) as kept"))


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that pass, with their own columns only."""
    stats, base, over = quality(F.col(f"row.`{text}`"), **limits)
    return packed(small_batches(docs)).withColumn("s", stats).where(f"not ({base}) and not ({over})").select("row.*")
