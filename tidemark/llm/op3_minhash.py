"""Near-duplicate groups by fast similarity sketches.

A document's set holds its distinct word n-grams (64-bit hashes of lower-cased
words). The sketch has one coordinate per bin: in each round every element is
thrown into one hashed bin, a bin keeps the smallest value of the first round
that reaches it, and after as many rounds as there are bins each further round
fills one bin for certain, so every coordinate is filled; agreeing coordinates
estimate the similarity with the concentration of independent samples. Groups
of ``rows`` coordinates (bands) put documents into buckets.

Buckets of more than one distinct set join documents into candidate families
(components of the bucket graph; a bucket links its members to its smallest, so
no pairs are listed). Inside a family every pair of distinct sets is decided
exactly on the full sets: an inverted index over the rarest n-grams of each set
(prefix filter: sets at the threshold must share one) proposes pairs, pairs
already connected are skipped, the rest are intersected. A family of more than
``UNIT_SHINGLES`` is cut into blocks, and every pair of blocks is a unit of its
own: any family size is decided exactly, in bounded memory. Copies (equal sets)
are one set from the start; only ``u -> smallest`` rows leave a unit.

Defined cases: null, empty or blank text has the empty set and is linked with
nothing; fewer words than the n-gram length make one n-gram of all words; rows
with one doc_id are one node; a null doc_id is linked with nothing, has a null
component and is not kept; a set of any size is confirmed whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, cut, mix64, packed, row_slices, small_batches, tidy, utf8_view, words_of
from tidemark.llm.components import components

#: Words of a shingle, percent of the union that a link needs.
SHINGLE, PERCENT = 3, 85
#: (bands, rows) by threshold: a pair at the threshold shares no bucket with a
#: probability below 2e-7.
BANDING = {85: (36, 6), 80: (40, 5)}
#: Most shingles of a block of a family that one task confirms.
UNIT_SHINGLES = 300_000
#: Tables keyed by bucket or document are broadcast up to this many rows.
BROADCAST_ROWS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shingle_sets(texts: pa.Array, words: int, hasher: RollingHash) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    buf_all, offsets_all = utf8_view(texts)
    for lo, hi in row_slices(offsets_all):
        buf = _LOWER[buf_all[offsets_all[lo]:offsets_all[hi]]]
        offsets = offsets_all[lo:hi + 1] - offsets_all[lo]
        starts, ends, row = words_of(buf, offsets)
        token = hasher.runs(buf, starts, ends)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        with np.errstate(over="ignore"):
            gram = np.zeros(max(len(token) - words + 1, 0), np.uint64)
            for j in range(words):
                gram = gram * np.uint64(RollingHash.BASE) + token[j:j + len(gram)]
            gram = mix64(gram + np.uint64(words))
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                yield np.unique(gram[a:b - words + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    one = np.uint64(b - a)
                    for w in token[a:b]:
                        one = mix64(np.array([one * np.uint64(RollingHash.BASE) + w]))[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """One (round, value) number per bin, for a non-empty set."""
    empty = np.uint64(2**64 - 1)
    out = np.full(bins, empty, np.uint64)
    step, start = max(1, min(64, -(-3 * bins // len(items)))), 0
    with np.errstate(over="ignore"):
        while start < bins:
            rounds = np.arange(start, min(start + step, bins), dtype=np.uint64)
            y = mix64((items[None, :] + (rounds * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))[:, None]).ravel())
            at = ((y >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            key = (np.repeat(rounds, len(items)) << np.uint64(32)) | (y & np.uint64(0xFFFFFFFF))
            new = np.full(bins, empty, np.uint64)
            np.minimum.at(new, at.astype(np.int64), key)
            out = np.minimum(out, new)
            if (out != empty).all():
                return out
            start += step
        for b in np.flatnonzero(out == empty):  # the rounds that fill one bin each
            turn = np.uint64(bins + int(b))
            y = mix64(items + turn * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
            out[b] = (turn << np.uint64(32)) | (y & np.uint64(0xFFFFFFFF)).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = mix64(coordinates).reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows):
            key = mix64(key * np.uint64(RollingHash.BASE) + table[:, j])
    return key.view(np.int64)


def sets_and_bands(text: Column, words: int, bands: int, rows: int) -> Column:
    """Struct of n (set size), two digest numbers of the set, and its band keys."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = RollingHash()
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for items in shingle_sets(batch, words, hasher):
                digest = np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(items))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                keys.append(band_keys(sketch(items, bands * rows), bands, rows) if len(items)
                            else np.zeros(0, np.int64))
            size = np.cumsum([0] + [len(k) for k in keys])
            flat = pa.array(np.concatenate(keys or [np.zeros(0, np.int64)]), pa.int64())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat)], names=["n", "d1", "d2", "bands"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "struct<n: bigint, d1: bigint, d2: bigint, bands: array<bigint>>")(text)


def full_sets(text: Column, words: int) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = RollingHash()
        for batch in batches:
            yield pa.array([s.tobytes() for s in shingle_sets(batch, words, hasher)], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "binary")(text)


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int, crossing: bool) -> np.ndarray:
    """Component label (an index) of every set under the links; with
    ``crossing`` only pairs of different sides are decided."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    by_size = np.argsort(size, kind="stable")
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # rare n-grams first
    shared = np.empty(len(count), bool)
    shared[rank] = count > 1
    edge = np.concatenate(([0], np.cumsum(size)))
    ranked = [np.sort(rank[inverse[edge[i]:edge[i + 1]]]) for i in range(m)]
    label = np.arange(m)
    members = {i: 1 << i for i in range(m)}
    of_side = [0, 0]
    held: dict[int, int] = {}
    mark = np.zeros(len(count), bool)
    for x in by_size.tolist():
        mine = ranked[x]
        nx = len(mine)
        prefix = mine[:nx - -(-percent * nx // 100) + 1]
        prefix = prefix[shared[prefix]].tolist()
        near = 0
        for token in prefix:
            near |= held.get(token, 0)
        if crossing:
            near &= of_side[1 - int(side[x])]
        near &= ~members[label[x]]
        if near:
            mark[mine] = True
            while near:
                y = near.bit_length() - 1
                near ^= 1 << y
                ny = int(size[y])
                if 100 * min(nx, ny) < percent * max(nx, ny):
                    continue
                both = int(np.count_nonzero(mark[ranked[y]]))
                if 100 * both >= percent * (nx + ny - both):
                    a, b = int(label[x]), int(label[y])
                    near &= ~members[b]
                    members[a] |= members.pop(b)
                    label[label == b] = a
            mark[mine] = False
        bit = 1 << x
        of_side[int(side[x])] |= bit
        for token in prefix:
            held[token] = held.get(token, 0) | bit
    return label


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block = table.column("block").to_numpy()
        label = linked(sets, (block == j).astype(np.int64), percent, i != j)
        order = np.lexsort((ids, label))
        new = np.ones(len(order), bool)
        new[1:] = label[order][1:] != label[order][:-1]
        least = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        u, v = ids[order], least
        return pa.table({"u": pa.array(u[u != v], pa.int64()), "v": pa.array(v[u != v], pa.int64())})
    return run


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, with a broadcast hint if it is counted as small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def families(marked: DataFrame) -> DataFrame:
    """(doc_id, family) of the documents that share a bucket with another set."""
    rows = marked.selectExpr("doc_id", "d1", "explode(bands) as key")
    mixed = cut(rows.groupBy("key").agg(F.min("doc_id").alias("c"), F.min("d1").alias("lo"), F.max("d1").alias("hi"))
                .where("lo <> hi").selectExpr("key as m_key", "c"))
    star = rows.join(_small(mixed), F.expr("key = m_key")).selectExpr("doc_id as u", "c as v").distinct()
    found = components(star)
    return found.selectExpr("u as doc_id", "v as family").unionAll(
        found.selectExpr("v as doc_id", "v as family").distinct())


def links(docs: DataFrame, marked: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v) rows, v the smaller, whose components are those of all links."""
    member = families(marked).withColumnRenamed("doc_id", "f_id")
    sets = (marked.select("doc_id", "n", "d1", "d2").join(member, F.expr("doc_id = f_id"))
            .groupBy("family", "d1", "d2").agg(F.min("doc_id").alias("f_id"), F.max("n").alias("n")))
    total = sets.groupBy("family").agg(F.expr(f"cast(ceil(sum(n) / {UNIT_SHINGLES}) as int) as blocks"))
    placed = cut(sets.join(total, "family")
                 .selectExpr("f_id", "family", "cast(pmod(xxhash64(f_id), blocks) as int) as block", "blocks"))
    unit = ("inline(transform(sequence(0, blocks - 1), x -> named_struct('i', least(x, block), "
            "'j', greatest(x, block))))")
    return (docs.join(_small(placed), F.expr("doc_id = f_id"))
            .select("doc_id", "family", "block", "blocks", full_sets(F.col("text"), words).alias("items"))
            .selectExpr("doc_id", "family", "block", "items", unit)
            .groupBy("family", "i", "j").applyInArrow(_confirm(percent), "u long, v long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE,
                    percent: int = PERCENT, banding: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    bands, rows = banding or BANDING[percent]
    own = small_batches(docs).selectExpr(f"cast(`{doc_id}` as bigint) as doc_id", f"`{text}` as text")
    table = cut(own.select("doc_id", sets_and_bands(F.col("text"), words, bands, rows).alias("s"))
                .selectExpr("doc_id", "s.n", "s.d1", "s.d2", "s.bands"))
    known = table.where("n > 0 and doc_id is not null")
    found = components(links(own.where("doc_id is not null"), known, words, percent))
    found = found.selectExpr("u", "v as smallest")
    copies = (known.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1")
              .join(found, F.expr("first = u"), "left")
              .selectExpr("d1 as c1", "d2 as c2", "coalesce(smallest, first) as of_copies"))
    return (table.select("doc_id", "n", "d1", "d2")
            .join(copies, F.expr("d1 = c1 and d2 = c2 and n > 0 and doc_id is not null"), "left")
            .join(found, F.expr("doc_id = u"), "left")
            .selectExpr("doc_id", "n as n_shingles", "coalesce(of_copies, smallest, doc_id) as component_id")
            .selectExpr("doc_id", "n_shingles", "component_id", "coalesce(doc_id = component_id, false) as kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
               **params) -> DataFrame:
    """One document of each group, with its own columns only; only near copies go.

    A row is told by a hash of its id and text, so rows with a null id and rows
    of different texts under one id are documents of their own. Of a group the
    row with the smallest id stays (null last), of rows equal in id and text the
    one whose content hashes lowest; rows without words all stay.
    """
    uid = f"xxhash64(cast(`{doc_id}` as bigint), `{text}`)"
    found = near_duplicates(docs.selectExpr(f"{uid} as doc_id", f"`{text}` as text"), "doc_id", "text", words, percent,
                            **params)
    once = cut(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("uid"))
               .agg(F.count("*").alias("n"), F.min("component_id").alias("group_id")))
    groups = once.where("uid <> group_id").select("group_id").distinct()
    member = cut(once.join(groups, "group_id").select("uid", "group_id"))
    first = (docs.selectExpr(f"{uid} as uid", f"cast(`{doc_id}` as bigint) as id").join(_small(member), "uid")
             .groupBy("group_id").agg(F.expr("min(struct(id is null as no_id, id, uid)).uid as uid")))
    gone = cut(member.select("uid").join(first.select("uid"), "uid", "left_anti"))
    rows = packed(docs).selectExpr("row", f"xxhash64(cast(row.`{doc_id}` as bigint), row.`{text}`) as uid")
    rows = rows.join(_small(gone), "uid", "left_anti")
    again = cut(once.where("n > 1").select("uid"))
    if again.take(1):
        again = _small(again)
        one = (rows.join(again, "uid", "left_semi")
               .withColumn("other", F.expr(f"xxhash64(1, reverse(row.`{text}`))"))
               .groupBy("uid", "other").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")))
        rows = rows.join(again, "uid", "left_anti").select("row").unionByName(one.select("row"))
    return rows.select("row.*")
