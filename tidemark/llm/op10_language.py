"""Language identification by mixture inference.

A model holds, for each learned language, the likelihood of byte n-grams
(hashed to ``BUCKETS``). A document is a bag of n-grams drawn from a mixture of
languages: expectation-maximisation estimates the proportions, and the language
set is the nested set (languages by proportion) of highest likelihood less a
penalty for each language beyond the first, of any size up to all learned
languages (sets beyond ``ALL_ROWS`` languages are tried for the rows whose full
mixture is likely enough to pay the penalty). The prediction is the language of
the largest proportion in the chosen set, the score that proportion.

Learning counts n-grams over all learnable rows (each task adds up its own
rows, then one small sum per language and bucket); only the table of counts,
``BUCKETS`` numbers for each of at most ``MAX_LANGUAGES`` languages, reaches
the driver.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and
no languages; so is every text when nothing could be learned. Rows with null
lang, text or doc_id are not learned from; a null doc_id is not held out. Ties
go to the language that sorts first. Repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, row_slices, small_batches, tidy, utf8_view

BUCKETS = 1 << 12
MAX_LANGUAGES = 256
ORDER = 3
#: Cost of one more language, in units of log(number of n-grams).
PENALTY = 8.0
ROUNDS, ALL_ROWS = 10, 3
SMOOTH = 0.5
UND = "und"

#: ASCII letters fold to lower case, other ASCII bytes to space; bytes of
#: longer code points stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte n-grams of every row, a blank before and after
    it; blank-only n-grams and those over a row's end are left out."""
    size = np.diff(offsets) + 2
    row = np.repeat(np.arange(len(size)), size)
    n = len(row) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    byte = np.full(len(row), 0x20, np.uint32)
    byte[np.arange(len(buf)) + 2 * np.repeat(np.arange(len(size)), size - 2) + 1] = _FOLD[buf]
    code = byte[:n] << 16 | byte[1:n + 1] << 8 | byte[2:n + 2]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    ok = (row[:n] == row[ORDER - 1:]) & (code != 0x202020)
    return row[:n][ok], bucket[ok].astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x BUCKETS, natural log of likelihoods

    def infer(self, buf: np.ndarray, offsets: np.ndarray):
        """(best language or -1, its proportion, proportions) of every row."""
        n, kinds = len(offsets) - 1, len(self.languages)
        row, bucket = grams(buf, offsets)
        table = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS)
        cell = np.flatnonzero(table)
        c, row, bucket = table[cell].astype(np.float64), cell // BUCKETS, cell % BUCKETS
        theta_out = np.zeros((n, kinds))
        live = np.flatnonzero(np.bincount(row, minlength=n))
        if not len(live) or not kinds:
            return np.full(n, -1), np.zeros(n), theta_out
        at = np.searchsorted(row, live)  # first cell of each live row
        count = np.diff(np.append(at, len(row)))
        where = np.repeat(np.arange(len(live)), count)
        total = np.add.reduceat(c, at)
        logs = self.logs[:, bucket]  # languages x cells
        single = np.add.reduceat(logs * c, at, axis=1).T
        likely = np.exp(logs - logs.max(axis=0))
        lift = np.add.reduceat(c * logs.max(axis=0), at)

        def em(theta: np.ndarray, rounds: int, cells=slice(None), rows=slice(None)) -> tuple[np.ndarray, np.ndarray]:
            """Shares and fit of the rows, ``cells`` being theirs in order."""
            like, n_of = likely[:, cells], c[cells]
            sizes = count[rows]
            first, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            for _ in range(rounds):
                mix = np.einsum("lc,cl->c", like, theta[of])
                theta = theta * np.add.reduceat(like * (n_of / mix), first, axis=1).T / total[rows][:, None]
                theta = np.maximum(theta, 1e-12)
                theta /= theta.sum(axis=1, keepdims=True)
            mix = np.einsum("lc,cl->c", like, theta[of])
            return theta, np.add.reduceat(n_of * np.log(mix), first) + lift[rows]

        start, whole = em(np.full((len(live), kinds), 1.0 / kinds), ROUNDS)
        order = np.argsort(-start, axis=1, kind="stable")
        best = single.argmax(axis=1)
        chosen = np.zeros((len(live), kinds))
        chosen[np.arange(len(live)), best] = 1.0
        value = single[np.arange(len(live)), best]
        cost = PENALTY * np.log(np.maximum(total, 2.0))
        rows = np.arange(len(live))
        for size in range(2, kinds + 1):
            if size > ALL_ROWS:
                # no set fits better than the whole mixture, save for what its rounds left: one more cost is ample
                rows = rows[whole[rows] - cost[rows] * (size - 2) > value[rows]]
                if not len(rows):
                    break
            cells = slice(None) if len(rows) == len(live) else np.flatnonzero(np.isin(where, rows))
            member = np.zeros((len(rows), kinds), bool)
            np.put_along_axis(member, order[rows, :size], True, axis=1)
            theta = np.where(member, np.maximum(start[rows], 1e-3), 0.0)
            theta, fit = em(theta / theta.sum(axis=1, keepdims=True), ROUNDS // 2, cells, rows)
            gain = fit - cost[rows] * (size - 1)
            better = gain > value[rows]
            chosen[rows[better]] = np.where(member, theta, 0.0)[better]
            value[rows[better]] = gain[better]
        theta_out[live] = chosen
        top, share = np.full(n, -1), np.zeros(n)
        top[live] = chosen.argmax(axis=1)
        share[live] = np.clip(chosen.max(axis=1), 0.0, 1.0)
        return top, share, theta_out


def held_out(doc_id: str = "doc_id") -> str:
    return f"coalesce(crc32(cast(cast(`{doc_id}` as string) as binary)) % 4 = 2, false)"


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows that are not held out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            ids = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            labels = names.dictionary.to_pylist()
            buf, offsets = utf8_view(batch.column("text"))
            for lo, hi in row_slices(offsets):
                row, bucket = grams(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                kinds = ids[lo:hi]
                table = np.bincount(kinds[row] * BUCKETS + bucket, minlength=len(labels) * BUCKETS)
                for i in np.unique(kinds):
                    got = sums.setdefault(labels[i], np.zeros(BUCKETS, np.int64))
                    got += table[i * BUCKETS:(i + 1) * BUCKETS]
        for label, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at])],
                names=["lang", "bucket", "n"])

    rows = small_batches(docs).selectExpr(f"`{text}` as text", f"`{lang}` as lang", f"not {held_out(doc_id)} and `{doc_id}` is not "
                           "null as learn").where("learn and lang is not null and text is not null")
    counts = (rows.select("lang", "text").mapInArrow(tidy(count), "lang string, bucket int, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    by_lang = (counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
               .orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(by_lang), BUCKETS))
    for i, r in enumerate(by_lang):
        for bucket, n in r["cells"]:
            table[i, bucket] = n
    table += SMOOTH
    return Model([r["lang"] for r in by_lang], np.log(table / table.sum(axis=1, keepdims=True)))


def language(text: Column, model: Model) -> Column:
    """Struct of lang, score and languages (names and shares) of a text column."""
    kind = "struct<lang: string, score: double, languages: array<string>, shares: array<double>>"
    names = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            buf, offsets = utf8_view(batch)
            lang, score, sets, shares = [], [], [], []
            for lo, hi in row_slices(offsets, 1 << 18):
                top, share, theta = model.infer(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                lang += [names[t] if t >= 0 else UND for t in top]
                score += share.tolist()
                for one in theta:
                    at = np.argsort(-one, kind="stable")[:int((one > 0).sum())]
                    sets.append(names[at].tolist())
                    shares.append(one[at].tolist())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())),
                 pa.array(shares, pa.list_(pa.float64()))], names=["lang", "score", "languages", "shares"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), kind)(text)


def _no_letter(text: str) -> str:
    return f"({text} is null or not {text} rlike '\\\\p{{L}}')"


def language_mix(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares of every document;
    without a model, one is learned from ``docs``."""
    model = model or learn(docs, doc_id, text, lang)
    none = _no_letter("text")
    return (small_batches(docs).selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
            .withColumn("p", language(F.col("text"), model))
            .selectExpr("doc_id", f"{held_out()} as held_out",
                        f"case when {none} then '{UND}' else p.lang end as lang_pred",
                        f"case when {none} then 0D else p.score end as score",
                        f"case when {none} then array() else p.languages end as languages",
                        f"case when {none} then array() else p.shares end as shares"))


def keep_known(docs: DataFrame, min_share: float = 0.4, text: str = "text", **columns) -> DataFrame:
    """The documents whose main language is known and holds ``min_share`` of
    the text, with their own columns only."""
    model = learn(docs, text=text, **columns)
    return (packed(docs).withColumn("p", language(F.col(f"row.`{text}`"), model))
            .where(f"not {_no_letter(f'row.`{text}`')} and p.lang <> '{UND}' and p.score >= {min_share!r}D")
            .select("row.*"))
