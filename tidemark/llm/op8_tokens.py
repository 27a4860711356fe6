"""Token counts by a dynamic programme over prefixes.

Byte-pair merges inside one pre-token obey a local law: a token sequence is the
encoding of its text if and only if every two neighbours are the encoding of
their joined bytes. So the encodings of all prefixes of a pre-token follow from
one left-to-right pass: the last token of prefix p is the only vocabulary token
that ends at p and agrees with the last token of the prefix before it, and
``count[p] = count[p - len(token)] + 1``. A document stores the running count
at the end of every unit (blank-separated); with the prefix counts inside the
pre-tokens of the unit that a position falls into, any truncation or budget question is
answered by a look-up, without encoding again.

Defined cases: null text is empty and has 0 tokens; repeated rows are counted
one by one; special strings of the tokenizer inside a text are one token each,
as the library treats them by default; an empty table gives an empty result.
A pre-token of any length takes one pass over its bytes.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, tidy

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: The published splitting pattern of byte-level tokenizers (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank before white space or the end.
LOOSE_BLANK = re.compile(r" (?:\s|\Z)").search
#: Pre-tokens remembered per worker, and the longest that is remembered.
CACHE, CACHE_LENGTH = 400_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class PrefixCounter:
    """Prefix counts of pre-tokens and documents for one vocabulary file."""

    path: str

    def __post_init__(self):
        import ahocorasick
        import regex

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        stand = byte_alphabet()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        special = set(self.special)
        # byte strings are held as Latin-1 text: one character is one byte
        raw = lambda s: "".join(chr(stand[c]) for c in s)
        self.vocab = [raw(t) for t in spec["model"]["vocab"] if t not in special]
        self.merges = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[raw(a), raw(b)] = i
        self.ends = ahocorasick.Automaton()
        for i, token in enumerate(self.vocab):
            self.ends.add_word(token, (len(token), i))
        self.ends.make_automaton()
        self.whole = [self.merge(t) == [t] if len(t) < 3 else None for t in self.vocab]
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
                                 + ")").split if self.special else (lambda t: [t])
        self.agree: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.later = Later(self)

    def merge(self, data: str) -> list[str]:
        """Merges of a short byte string, lowest rank first, leftmost first."""
        parts, none = list(data), 1 << 60
        while len(parts) > 1:
            ranks = [self.merges.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether two tokens stay apart when their joined bytes are merged."""
        if before < 0:
            if self.whole[token] is None:
                self.whole[token] = self.merge(self.vocab[token]) == [self.vocab[token]]
            return self.whole[token]
        a, b = self.vocab[before], self.vocab[token]
        return self.merge(a + b) == [a, b]

    def prefixes(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1], ..., data."""
        n, agree = len(data), self.agree
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        done = [False] * (n + 1)
        for end, (size, token) in self.ends.iter(data.decode("latin-1")):
            p = end + 1
            if done[p]:
                continue
            before = last[p - size]
            key = before << 20 | token
            fits = agree.get(key)
            if fits is None:
                if len(agree) >= CACHE:
                    agree.clear()
                fits = agree[key] = self.fits(before, token)
            if fits:
                done[p], last[p], counts[p] = True, token, counts[p - size] + 1
        return counts

    def word(self, word: str) -> int:
        """Tokens of one pre-token or special string."""
        got = self.words.get(word)
        if got is None:
            got = 1 if word in self.special else self.prefixes(word.encode())[-1]
            if len(word) <= CACHE_LENGTH:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[word] = got
        return got

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a text, in order."""
        if not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut(text):
            out.extend([part] if part in self.special else self.split(part))
        return out

    def units(self, text: str) -> list[str]:
        """A text cut before every single blank that ink follows (always the
        start of a pre-token), the blanks left out; one unit where a blank is
        followed by white space, or where a special string stands."""
        if LOOSE_BLANK(text) or any(s in text for s in self.special):
            return [text]
        return text.split(" ")

    def boundaries(self, text: str) -> tuple[list[str], np.ndarray]:
        """Units of a text, and its running token counts at their ends."""
        units = self.units(text)
        later = self.later
        if len(later) >= CACHE:
            later.clear()
        counts = np.fromiter(map(later.__getitem__, units), np.int64, len(units))
        counts[0] = sum(map(self.word, self.pieces(units[0])))
        return units, np.cumsum(counts)


class Later(dict):
    """Tokens of units that follow a blank, filled on first sight."""

    def __init__(self, counter: "PrefixCounter"):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> int:
        got = sum(map(self.counter.word, self.counter.pieces(" " + unit))) if unit else 0
        if len(unit) <= CACHE_LENGTH:
            self[unit] = got
        return got


class PrefixIndex:
    """Answers for one text from its running counts and one unit of it."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter = counter
        self.units, self.tokens_at = counter.boundaries(text)

    def _unit(self, k: int) -> str:
        return " " * (k > 0) + self.units[k]

    def _before(self, k: int) -> tuple[int, int]:
        """Bytes and tokens of the units before unit k."""
        lead = " ".join(self.units[:k])
        return len(lead.encode()), int(self.tokens_at[k - 1]) if k else 0

    def _inside(self, k: int) -> list[tuple[int, int]]:
        """(bytes, tokens) of every prefix that ends in unit k."""
        at, n = self._before(k)
        out = [(at, n)]
        for word in self.counter.pieces(self._unit(k)):
            data = word.encode()
            counts = [0, *[1] * len(data)] if word in self.counter.special else self.counter.prefixes(data)
            out += [(at + i, n + c) for i, c in enumerate(counts) if i]
            at, n = out[-1]
        return out

    def tokens(self, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes, cut inside the pre-token of
        the whole text that they end in."""
        sizes = np.cumsum([len(self._unit(k).encode()) for k in range(len(self.units))])
        k = min(int(np.searchsorted(sizes, n_bytes)), len(self.units) - 1)
        return dict(self._inside(k))[n_bytes]

    def longest(self, budget: int) -> int:
        """The most bytes from the start whose tokens keep within ``budget``
        (counts inside a pre-token need not grow with the prefix)."""
        k = min(int(np.searchsorted(self.tokens_at, budget, "right")), len(self.units) - 1)
        return max(at for at, n in self._inside(k) if n <= budget)


def worker_counter(path: str) -> PrefixCounter:
    """One counter per Python worker process and file: workers outlive tasks,
    so what one task has learned about words serves the next."""
    held = sys.modules.setdefault("_prefix_counters", ModuleType("_prefix_counters")).__dict__
    if path not in held:
        held[path] = PrefixCounter(path)
    return held[path]


def token_stats(text: Column, path: str, budget: int = LIMIT) -> Column:
    """Struct of a text's tokens and of the bytes that fit into ``budget``."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = worker_counter(path)
        for batch in batches:
            total, fit = [], []
            for item in batch:
                text = item.as_py()
                if not text:
                    total.append(0)
                    fit.append(0)
                    continue
                index = PrefixIndex(counter, text)
                total.append(int(index.tokens_at[-1]))
                fit.append(len(text.encode()) if total[-1] <= budget else index.longest(budget))
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(fit, pa.int64())],
                                             names=["n_tokens", "fit_bytes"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "struct<n_tokens: bigint, fit_bytes: bigint>")(text)


def prefix_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the running token counts (array<int>) at the ends of units."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = worker_counter(path)
        for batch in batches:
            yield pa.array([None if t is None else counter.boundaries(t)[1].tolist() for t in batch.to_pylist()],
                           pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return small_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.arrow_udf(tidy(run), "array<int>")(F.col(f"`{text}`")).alias("running_tokens"))


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_bytes of every document."""
    return (
        small_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        .select("doc_id", F.expr("coalesce(cast(octet_length(text) as bigint), 0L)").alias("n_bytes"),
                token_stats(F.col("text"), path, limit).alias("s"))
        .selectExpr("doc_id", "n_bytes", "s.n_tokens", f"s.n_tokens > {limit} as over_limit", "s.fit_bytes")
    )
