"""Helpers shared by the operators: lineage cuts and byte views of Arrow text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

#: Text bytes handled at once inside a Python task (one text may exceed it).
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session: the rows are
    written once, and a lost executor costs a re-read, not a re-computation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: as
    ``cut``, with the true size known to the planner (a loop needs that: sizes
    estimated through joins multiply from round to round)."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keyed tables are broadcast up to this many (counted) rows.
BROADCAST_ROWS = 500_000


def counted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A cut table, with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


#: Rows and bytes of the Arrow batches between the JVM and Python workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
         "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session: both sides hold a batch in
    memory outside the heap, for every task at once."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df


def tidy(run):
    """A batch function that gives freed memory back to the system when its
    task ends: Python workers stay alive between tasks and stages."""
    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    released.__annotations__ = dict(run.__annotations__)
    return released


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct column ``row``, so that no column of theirs can
    clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def utf8_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; null is empty text.

    ``bytes[offsets[i]:offsets[i + 1]]`` are the UTF-8 bytes of row i.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return raw[first:int(offsets[-1])], offsets.astype(np.int64) - first


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``limit`` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1, lo + 1)
        yield lo, min(hi, n)
        lo = hi


def per_row(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over the rows that ``offsets`` delimit."""
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def lut(*members: int | range) -> np.ndarray:
    """Boolean lookup table over the 256 byte values."""
    table = np.zeros(256, bool)
    for m in members:
        table[m if isinstance(m, int) else list(m)] = True
    return table


#: The white space that separates words: space and U+0009 to U+000D.
SPACE = lut(0x20, range(0x09, 0x0E))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective 64-bit mixer (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Polynomial hashes (mod 2^64, random byte values) of byte runs."""

    BASE = 0x9E3779B97F4A7C15 | 1
    BLOCK = 1 << 19

    def __init__(self, seed: int = 7):
        gen = np.random.default_rng(seed)
        self.values = gen.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
        self.powers = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 4096)
            step = np.full(size, self.BASE, np.uint64)
            step[0] = 1
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(step, dtype=np.uint64)
        return self.powers

    def runs(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of buf[s:e] for every run (sorted, disjoint); blocks of bytes
        bound the memory, and a run may span blocks."""
        out = np.zeros(len(starts), np.uint64)
        if not len(starts):
            return out
        pw = self.upto(int((ends - starts).max()) + 1)
        first = 0
        with np.errstate(over="ignore"):
            while first < len(starts):
                # whole runs of up to BLOCK bytes, or one long run piecewise
                last = max(int(np.searchsorted(ends, starts[first] + self.BLOCK, "right")), first + 1)
                s, e = starts[first:last], ends[first:last]
                if last == first + 1:
                    for at in range(int(s[0]), int(e[0]), self.BLOCK):
                        part = buf[at:min(at + self.BLOCK, int(e[0]))]
                        k = at - int(s[0])
                        out[first] += (self.values[part] * pw[k:k + len(part)]).sum(dtype=np.uint64)
                else:
                    size = e - s
                    at = np.cumsum(size) - size
                    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
                    byte = buf[within + np.repeat(s, size)]
                    term = self.values[byte] * pw[within]
                    full = size > 0
                    out[first:last][full] = np.add.reduceat(term, at[full]) if full.any() else 0
                first = last
        return mix64(out ^ (ends - starts).astype(np.uint64))


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of the rows in a byte buffer."""
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    edges = offsets[1:-1][offsets[1:-1] < len(buf)]
    if len(buf):
        before = np.empty(len(buf), bool)
        before[0], before[1:] = False, inside[:-1]
        before[edges] = False
        first &= ~before
        after = np.empty(len(buf), bool)
        after[-1], after[:-1] = False, inside[1:]
        after[edges[edges > 0] - 1] = False
        last &= ~after
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
