"""Exact top-k inner products by a three-phase uniform threshold.

Components become integers floor(64 x). Vectors are packed into tiles of at
most ``TILE`` rows; the query set (a stated part of the rows) is packed the
same way, and every query tile meets every candidate tile of its dimension in
one of ``salts`` join keys, so no task sees all candidates. The dimensions are
cut into ``LISTS`` score lists; a score is the sum of its list scores.

1. Gather: for each query, each list's best k candidates of a tile give exact
   scores of a few candidates; the best k per query and task are gathered and
   merged. The k-th of them is a safe cutoff: the true k-th score is no lower.
2. Broadcast and collect: the cutoff t travels with its query. A candidate
   whose score reaches t has a list score of t / LISTS or more (uniform
   threshold); only such candidates are collected.
3. Resolve: their remaining list scores are added up exactly; those that reach
   t enter the final ranking, the best k per task first.

Scores are exact: matrices multiply in float32 or float64 only when every
possible sum is an integer that the type holds; else in Python integers (a
score beyond 64 bits is then clamped).

Defined cases: vectors that are null, empty, or hold a null or non-finite
component, and rows with null id, take no part; vectors meet only vectors of
their own length; repeated rows are candidates of each other; ties go to the
smaller id; a query with fewer than k candidates gets them all; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches, tidy

TILE, QUERY_TILE, LISTS, TOP = 2048, 1024, 2, 20
#: Candidate tiles that one join key holds, about.
TILES_PER_SALT = 8
_TILE = "dim int, part long, n int, ids binary, data binary"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix as float64) of the usable rows, by dimension."""
    ids, vec = batch.column("id"), batch.column("vec")
    if isinstance(vec, pa.ChunkedArray):
        ids, vec = ids.combine_chunks(), vec.combine_chunks()
    good = np.asarray(ids.is_valid()) & np.asarray(vec.is_valid())
    size = np.where(good, np.nan_to_num(np.asarray(vec.value_lengths().fill_null(0))), 0).astype(np.int64)
    flat = vec.flatten()  # leaves out the items of null rows
    value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.asarray(vec.value_lengths().fill_null(0)).astype(np.int64)
    first = np.cumsum(length) - length
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        table = value[first[at][:, None] + np.arange(dim)]
        ok = np.isfinite(table).all(axis=1)
        with np.errstate(over="ignore"):
            yield number[at[ok]], np.floor(64.0 * table[ok])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def tile(dim: int) -> pa.RecordBatch:
        ids = np.concatenate([x[0] for x in held[dim]])
        data = np.concatenate([x[1] for x in held[dim]])
        held[dim] = [(ids[TILE:], data[TILE:])]
        ids, data = ids[:TILE], data[:TILE]
        small = np.abs(data).max(initial=0) < 1 << 15
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([0], pa.int64()), pa.array([len(ids)], pa.int32()),
             pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
             pa.array([data.astype(np.int16 if small else np.float64).tobytes()], pa.binary())],
            names=["dim", "part", "n", "ids", "data"])

    for batch in batches:
        for ids, data in _rows(batch):
            for lo in range(0, len(ids), TILE):
                dim = data.shape[1]
                held.setdefault(dim, []).append((ids[lo:lo + TILE], data[lo:lo + TILE]))
                while sum(len(x[0]) for x in held[dim]) >= TILE:
                    yield tile(dim)
    for dim in held:
        if sum(len(x[0]) for x in held[dim]):
            yield tile(dim)


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.float64).reshape(n, dim)


def _lists(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Score matrices of the lists, exact, of an integer-valued type."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    edges = np.linspace(0, q.shape[1], LISTS + 1).astype(int)
    cast = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else None
    out = []
    for a, b in zip(edges, edges[1:]):
        if cast is not None:
            out.append(q[:, a:b].astype(cast) @ c[:, a:b].astype(cast).T)
        else:
            whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(len(m), -1)
            left, right = whole(q[:, a:b].tolist()), whole(c[:, a:b].tolist())
            out.append(left.dot(right.T) if b > a else np.zeros((len(q), len(c)), dtype=object))
    return out


def _clamped(scores) -> list[int]:
    return [max(-(2**63), min(2**63 - 1, int(x))) for x in scores]


def _queries_of(keep) -> callable:
    """Tiles of the query rows of candidate tiles; a row's ``uid`` is its
    candidate tile and place, so that it can be told from equal rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                at = np.flatnonzero(keep(ids))
                data = _matrix(r["data"], r["n"], r["dim"])
                for lo in range(0, len(at), QUERY_TILE):
                    some = at[lo:lo + QUERY_TILE]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["dim"]], pa.int32()), pa.array([r["part"]], pa.int64()),
                         pa.array([some.astype(np.int64).tobytes()], pa.binary()),
                         pa.array([ids[some].tobytes()], pa.binary()),
                         pa.array([np.ascontiguousarray(data[some]).tobytes()], pa.binary())],
                        names=["q_dim", "q_part", "q_at", "q_ids", "q_data"])
    return run


def _pairs(batches: Iterator[pa.RecordBatch]):
    """(query row, candidate row, score lists with a query's own row lowest)."""
    for batch in batches:
        for r in batch.to_pylist():
            at = np.frombuffer(r["q_at"], np.int64)
            q, c = _matrix(r["q_data"], len(at), r["q_dim"]), _matrix(r["data"], r["n"], r["dim"])
            lists = _lists(q, c)
            yield r, at, lists, sum(lists[1:], lists[0])


def _own(r: dict, at: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """False where a candidate is the query's own row."""
    ok = np.ones(shape, bool)
    if r["q_part"] == r["part"]:
        ok[np.arange(len(at)), at] = False
    return ok


def _gather(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, np.ndarray] = {}
        shape: dict[tuple, np.ndarray] = {}

        def flush():
            for (part, _), scores in best.items():
                at = shape[part, _]
                for lo in range(0, len(at), QUERY_TILE):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(at), pa.int64()), pa.array(at),
                         pa.array([_clamped(x for x in s if x != -np.inf) for s in scores], pa.list_(pa.int64()))],
                        names=["q_part", "q_at", "scores"])
            best.clear()

        for r, at, lists, full in _pairs(batches):
            ok = _own(r, at, full.shape)
            seen = np.zeros(full.shape, bool)
            wide = min(k + 1, full.shape[1])
            for s in lists:
                top = np.argpartition(s, full.shape[1] - wide, axis=1)[:, -wide:] if s.dtype != object else \
                    np.argsort(s, axis=1)[:, -wide:]
                np.put_along_axis(seen, top, True, axis=1)
            # at most LISTS * (k + 1) exact scores for each query
            got = np.where(seen & ok, full, -np.inf)
            got = np.sort(got, axis=1)[:, -k:] if got.dtype == object else \
                np.partition(got, max(0, got.shape[1] - k), axis=1)[:, -k:]
            key = (r["q_part"], r["q_at"])
            if key in best:
                got = np.sort(np.concatenate((best[key], got), axis=1), axis=1)[:, -k:]
            elif len(best) >= 64:
                yield from flush()
            best[key], shape[key] = got, at
        yield from flush()
    return run


def _resolve(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def shrink(key) -> tuple:
            at, cand, score = (np.concatenate([x[i] for x in held[key]]) for i in range(3))
            order = np.lexsort((cand, -score, at)) if score.dtype != object else \
                np.array(sorted(range(len(at)), key=lambda i: (at[i], -score[i], cand[i])), np.int64)
            at, cand, score = at[order], cand[order], score[order]
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            keep = np.arange(len(at)) - first < k
            held[key] = [(at[keep], cand[keep], score[keep])]
            return held[key][0]

        def flush():
            for key in list(held):
                at, cand, score = shrink(key)
                q = dict(zip(np.frombuffer(key[1], np.int64).tolist(), np.frombuffer(key[2], np.int64).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(at), pa.int64()), pa.array(at, pa.int64()),
                     pa.array([q[x] for x in at.tolist()], pa.int64()), pa.array(cand, pa.int64()),
                     pa.array(_clamped(score), pa.int64())],
                    names=["q_part", "q_at", "query_id", "vec_id", "score"])
            held.clear()

        for r, at, lists, full in _pairs(batches):
            low = dict(zip(r["cut_at"] or [], r["cut"] or []))
            floor = np.array([-np.inf if low.get(x) is None else low[x] for x in at.tolist()],
                             dtype=object if full.dtype == object else np.float64)[:, None]
            enough = np.zeros(full.shape, bool)
            for s in lists:
                enough |= np.asarray(s * LISTS >= floor, bool)
            row, col = np.nonzero(enough & _own(r, at, full.shape))
            score = full[row, col]
            reach = np.asarray(score >= floor[row, 0], bool)
            row, col, score = row[reach], col[reach], score[reach]
            if score.dtype != object:
                score = score.astype(np.int64)
            key = (r["q_part"], r["q_at"], r["q_ids"])
            if key not in held and len(held) >= 64:
                yield from flush()
            held.setdefault(key, []).append((at[row], np.frombuffer(r["ids"], np.int64)[col], score))
            if sum(len(x[0]) for x in held[key]) > 4 * k * QUERY_TILE or len(held[key]) > 16:
                shrink(key)
        yield from flush()
    return run


def exact_top_k(vectors: DataFrame, every: int, k: int = TOP, vec_id: str = "vec_id",
                embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query:
    the rows whose id is divisible by ``every``."""
    tiles = cut(small_batches(vectors).selectExpr(f"cast(`{vec_id}` as bigint) as id", f"`{embedding}` as vec")
                .mapInArrow(tidy(_pack), _TILE).withColumn("part", F.monotonically_increasing_id()))
    salts = max(1, -(-tiles.count() // TILES_PER_SALT))
    queries = tiles.mapInArrow(_queries_of(lambda ids: ids % every == 0),
                               "q_dim int, q_part long, q_at binary, q_ids binary, q_data binary")
    spread = queries.select("*", F.expr(f"explode(sequence(0, {salts - 1})) as q_salt"))
    salted = tiles.withColumn("salt", F.expr(f"cast(pmod(xxhash64(part), {salts}) as int)"))
    same = F.expr("q_dim = dim and q_salt = salt")

    lists = (spread.join(salted, same).select("q_dim", "q_part", "q_at", "q_data", "dim", "part", "n", "data")
             .mapInArrow(tidy(_gather(k)), "q_part long, q_at long, scores array<long>"))
    # the k-th best gathered score of a query: none if fewer were gathered
    cutoff = (lists.groupBy("q_part", "q_at").agg(F.flatten(F.collect_list("scores")).alias("s"))
              .selectExpr("q_part", "q_at as at", f"try_element_at(sort_array(s, false), {k}) as cut"))
    by_part = cut(cutoff.where("cut is not null").groupBy("q_part")
                  .agg(F.collect_list("at").alias("cut_at"), F.collect_list("cut").alias("cut"))
                  .withColumnRenamed("q_part", "c_part"))
    bounded = (queries.join(by_part, F.expr("q_part = c_part"), "left").drop("c_part")
               .select("*", F.expr(f"explode(sequence(0, {salts - 1})) as q_salt")))
    found = (bounded.join(salted, same)
             .select("q_dim", "q_part", "q_at", "q_ids", "q_data", "cut_at", "cut", "dim", "part", "n", "ids", "data")
             .mapInArrow(tidy(_resolve(k)), "q_part long, q_at long, query_id long, vec_id long, score long"))
    return (found.withColumn("rank", F.expr(
        "row_number() over (partition by q_part, q_at order by score desc, vec_id)")).where(f"rank <= {k}")
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def exact_top_k_sql(every: int, k: int = TOP) -> str:
    """The same rows in DuckDB SQL over all pairs."""
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % {every} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= {k}
"""
