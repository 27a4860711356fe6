"""SentencePiece encoding and decoding, giant documents by a max-plus scan.

The model is a public BPE file. Its encoding obeys a local law: a piece
sequence is the encoding of its text if and only if every two neighbours are
the encoding of their joined text. So encoding is a search for the one path
without a forbidden neighbour pair, and splits like a Viterbi lattice:

1. A document longer than ``chunk`` characters is cut into chunks. The state at
   a cut is the piece that covers the character after it (every vocabulary
   piece around it is a candidate).
2. Each chunk alone yields its transfer matrix over the states at its two ends:
   minus the number of pieces on the path between them, minus infinity where a
   neighbour pair is forbidden.
3. The matrices of a document are combined by associative max-plus products
   (prefix and suffix scans); at each cut the state with the best sum of both
   is on the path.
4. Each chunk is then traced on its own between its two known states.

A document of one chunk has no cut, so only step 4 remains. Text between cuts is
encoded by segments (a run of blanks and what follows, or a line end): no piece
holds a blank after another character, or a line end, which is checked when the
model is loaded.

Defined cases: null or empty text has no pieces; ids may repeat or be null;
equal rows each get a result; U+2581 in a text counts as a blank, as the
library has it, and round trips compare blanks alike; an empty table gives an
empty result. Memory per task is bounded by one document and one Arrow batch.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, tidy

MODEL = "piece_bpe_32k.model"
CHUNK = 65_536
#: Segments remembered per worker, and the longest that is remembered.
CACHE, CACHE_LENGTH = 150_000, 48
BLANK = "▁"
SEGMENT = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
#: Characters of new segments that are encoded in one call.
CALL = 256
LOW = float("-inf")


def normal(text: str) -> str:
    """The text as the model sees it."""
    return BLANK + text.replace(" ", BLANK) if text else ""


class Pieces:
    """One loaded model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = sp = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.vocab = {sp.id_to_piece(i) for i in plain}
        self.letters = set("".join(self.vocab))
        self.longest = max(map(len, self.vocab))
        if any(BLANK in p.lstrip(BLANK) for p in self.vocab) or "\n" in self.letters:
            raise ValueError("a piece holds a blank after another character, or a line end")
        # a line end is no part of any piece: what stands between two of them is
        # encoded as it stands
        self.guard = sp.encode("\n")
        self.line_end = self.guard[-1]
        self.numbers = list(range(sp.vocab_size()))  # one object per id in all that is remembered
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def raw(self, part: str) -> list[int]:
        return self.model.encode("\n" + part.replace(BLANK, " "))[len(self.guard):]

    def learn(self, segments: list[str]) -> None:
        """Encode new segments, many in one call with line ends between them."""
        at = 0
        while at < len(segments):
            size, first = 0, at
            while at < len(segments) and (at == first or size < CALL):
                size += len(segments[at])
                at += 1
            got: list[int] = []
            ids = iter(self.raw("\n".join(segments[first:at])) + [self.line_end])
            place = first
            for i in ids:
                if i == self.line_end:
                    self.known[segments[place]] = got
                    got, place = [], place + 1
                else:
                    got.append(self.numbers[i])

    def parts(self, stretch: str) -> list[list[int]]:
        """Ids of the segments of a stretch of normalised text that starts and
        ends at piece ends."""
        segments, known = SEGMENT.findall(stretch), self.known
        if len(known) >= CACHE:
            known.clear()
        known["\n"] = [self.line_end]
        out = list(map(known.get, segments))
        if None in out:
            new = list(dict.fromkeys(x for x, ids in zip(segments, out) if ids is None))
            self.learn(new)
            out = list(map(known.get, segments))
            for x in new:
                if len(x) > CACHE_LENGTH:
                    del known[x]
        return out

    def ids(self, stretch: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.parts(stretch)), np.int32)

    def text(self, ids) -> str:
        """Normalised text of ids, with blanks as spaces."""
        return self.model.decode(self.guard + ids.tolist())[1:]

    def apart(self, a: str, b: str) -> bool:
        """Whether two pieces stay neighbours when their joined text is encoded."""
        if not a or not b or a not in self.vocab or b not in self.vocab:
            return True  # a document end, or a character that no piece holds
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            sp = self.model
            got = self.pairs[key] = self.raw(a + b) == [sp.piece_to_id(a), sp.piece_to_id(b)]
        return got

    def states(self, part: str, at: int) -> list[tuple[int, int]]:
        """Spans, relative to ``at``, of the pieces that may cover part[at]."""
        out = []
        for a in range(max(0, at - self.longest + 1), at + 1):
            for b in range(at + 1, min(len(part), a + self.longest) + 1):
                if part[a:b] in self.vocab or b == a + 1:
                    out.append((a - at, b - at))
        return out

    def edge_pieces(self, part: str) -> tuple[int, str, str]:
        """(number of pieces, first, last) of a stretch; unknown characters,
        which become several bytes, stand as themselves."""
        if not part:
            return 0, "", ""
        ids = self.parts(part)
        name = self.model.id_to_piece
        first, last = name(ids[0][0]), name(ids[-1][-1])
        return (sum(map(len, ids)), first if first in self.vocab else part[0],
                last if last in self.vocab else part[-1])

    def transfer(self, part: str, left: int, right: int, first: bool, final: bool) -> np.ndarray:
        """Scores from each state at ``left`` to each state at ``right``."""
        entry = [(0, 0)] if first else self.states(part, left)
        leave = [(0, 0)] if final else self.states(part, right)
        out = np.full((len(entry), len(leave)), LOW)
        piece = lambda span, at: part[at + span[0]:at + span[1]]
        begin = [left + b for _, b in entry]
        stop = [right + a for a, _ in leave]
        hard = [m.start() for m in re.finditer(f"(?<=[^{BLANK}]){BLANK}", part)
                if max(begin) < m.start() < min(stop)]
        if hard:
            middle = self.edge_pieces(part[hard[0]:hard[-1]])[0]
            heads = [self.edge_pieces(part[p:hard[0]]) for p in begin]
            tails = [self.edge_pieces(part[hard[-1]:q]) for q in stop]
            for i, (n, head, _) in enumerate(heads):
                for j, (m, _, tail) in enumerate(tails):
                    if (first or self.apart(piece(entry[i], left), head)) and (
                            final or self.apart(tail, piece(leave[j], right))):
                        out[i, j] = -(n + middle + m + (not final))
            return out
        for i, p in enumerate(begin):
            for j, q in enumerate(stop):
                if p > q:
                    continue
                n, head, tail = self.edge_pieces(part[p:q])
                own, other = "" if first else piece(entry[i], left), "" if final else piece(leave[j], right)
                fits = self.apart(own, other) if p == q else self.apart(own, head) and self.apart(tail, other)
                if fits:
                    out[i, j] = -(n + (not final))
        return out


def worker_pieces(path: str) -> Pieces:
    """One model per Python worker process and file: workers outlive tasks, so
    segments that one task has encoded serve the next."""
    held = sys.modules.setdefault("_piece_models", ModuleType("_piece_models")).__dict__
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefix_products(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by pairs: half as many
    matrices are scanned, and the odd ones filled in."""
    if len(parts) < 2:
        return list(parts)
    pairs = prefix_products([product(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)])
    out = [parts[0]]
    for i in range(1, len(parts)):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], parts[i]))
    return out


def path_states(parts: list[np.ndarray]) -> list[int]:
    """Index of the state on the best path at every inner cut."""
    forward = prefix_products(parts)
    backward = [m.T for m in prefix_products([m.T for m in reversed(parts)])][::-1]
    if forward[-1][0, 0] == LOW:
        raise ValueError("no path through a document")
    return [int((forward[k][0] + backward[k + 1][:, 0]).argmax()) for k in range(len(parts) - 1)]


def chunks_of(text: str, chunk: int, margin: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(k, chunks, left cut, right cut, text with margins) of a document."""
    whole = normal(text)
    n = max(1, -(-len(whole) // chunk))
    for k in range(n):
        lo, hi = k * chunk, min((k + 1) * chunk, len(whole))
        a, b = max(0, lo - margin), min(len(whole), hi + margin)
        yield k, n, lo - a, hi - a, whole[a:b]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    size = np.cumsum([0] + [len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(size, pa.int32()),
                                    pa.array(np.concatenate(parts or [np.zeros(0, np.int32)]), pa.int32()))


def encode(text: Column, path: str) -> Column:
    """Struct of ids and round_trip of a text column, each text as one chunk."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = worker_pieces(path)
        for batch in batches:
            ids, same = [], []
            for x in batch:
                part = normal(x.as_py() or "")
                ids.append(pieces.ids(part))
                same.append(pieces.text(ids[-1]) == part.replace(BLANK, " "))
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(same, pa.bool_())], names=["ids", "round_trip"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "struct<ids: array<int>, round_trip: boolean>")(text)


def decode(ids: Column, path: str) -> Column:
    """Texts of id arrays; null is null."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = worker_pieces(path)
        for batch in batches:
            yield pa.array([None if x is None else pieces.text(np.array(x, np.int32))[1:] for x in batch.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "string")(ids)


def _cut_chunks(chunk: int, margin: int):
    names = ["doc_id", "digest", "k", "n", "lo", "hi", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = chunks_of(batch.column("text")[i].as_py(), chunk, margin)
                while some := [r for _, r in zip(range(64), rows)]:
                    same = [pa.concat_arrays([batch.column(c).slice(i, 1)] * len(some)) for c in ("doc_id", "digest")]
                    cols = list(zip(*some))
                    yield pa.RecordBatch.from_arrays(
                        [*same, *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                        names=names)
    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path)
        for batch in batches:
            keep = batch.select(["doc_id", "digest", "k"])
            found = [pieces.transfer(r["part"], r["lo"], r["hi"], r["k"] == 0, r["k"] == r["n"] - 1)
                     for r in batch.select(["k", "n", "lo", "hi", "part"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array([m.shape[0] for m in found], pa.int32()),
                 pa.array([m.ravel().tolist() for m in found], pa.list_(pa.float64()))],
                names=["doc_id", "digest", "k", "rows", "scores"])
    return run


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (its matrices in order) to one state per inner cut."""
    for batch in batches:
        out = []
        for row in batch.column("parts").to_pylist():
            parts = {r["k"]: np.array(r["scores"]).reshape(r["rows"], -1) for r in row}
            out.append(path_states([parts[k] for k in sorted(parts)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(out, pa.list_(pa.int32()))],
            names=["doc_id", "digest", "states"])


def _trace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path)
        for batch in batches:
            ids, same = [], []
            for r in batch.select(["k", "n", "lo", "hi", "part", "enter", "leave"]).to_pylist():
                part, lo, hi = r["part"], r["lo"], r["hi"]
                if r["k"] > 0:
                    lo += pieces.states(part, r["lo"])[r["enter"]][1]
                inner, last = part[lo:hi], ""
                if r["k"] < r["n"] - 1:
                    a, b = pieces.states(part, hi)[r["leave"]]
                    inner, last = part[lo:hi + a], part[hi + a:hi + b]
                ids.append(np.concatenate((pieces.ids(inner), pieces.ids(last))))
                same.append(pieces.text(ids[-1]) == (inner + last).replace(BLANK, " "))
            keep = batch.select(["doc_id", "digest", "k"])
            yield pa.RecordBatch.from_arrays([*keep.columns, _lists(ids), pa.array(same, pa.bool_())],
                                             names=["doc_id", "digest", "k", "ids", "round_trip"])
    return run


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK,
                     margin: int = 64) -> DataFrame:
    """doc_id, ids, n_tokens, n_chunks, round_trip of every document."""
    rows = small_batches(docs).selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = f"coalesce(length(text), 0) >= {chunk}"
    short = (rows.where(f"not {is_long}").select("doc_id", encode(F.col("text"), path).alias("e"))
             .selectExpr("doc_id", "e.ids", "1 as n_chunks", "e.round_trip"))

    parts = (rows.where(is_long).selectExpr("doc_id", "md5(cast(text as binary)) as digest", "text")
             .mapInArrow(tidy(_cut_chunks(chunk, margin)),
                         f"doc_id {kind}, digest string, k int, n int, lo int, hi int, part string"))
    # equal rows have equal chunks: one matrix of each is enough
    matrices = parts.mapInArrow(tidy(_matrices(path)),
                                f"doc_id {kind}, digest string, k int, rows int, scores array<double>")
    states = (matrices.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("k", "rows", "scores")).alias("parts"))
              .mapInArrow(tidy(_states), f"doc_id {kind}, digest string, states array<int>")
              .selectExpr("doc_id", "digest", "states", "explode(sequence(0, size(states))) as k")
              .selectExpr("doc_id as s_id", "digest as s_digest", "k as s_k", "get(states, k - 1) as enter",
                          "get(states, k) as leave"))
    traced = (parts.join(states, F.expr("doc_id <=> s_id and digest = s_digest and k = s_k"))
              .select("doc_id", "digest", "k", "n", "lo", "hi", "part", "enter", "leave")
              .mapInArrow(tidy(_trace(path)),
                          f"doc_id {kind}, digest string, k int, ids array<int>, round_trip boolean"))
    # the traces of equal rows are equal: one is kept, and repeated
    whole = (traced.groupBy("doc_id", "digest", "k")
             .agg(F.count("*").alias("copies"), F.first("ids").alias("ids"), F.min("round_trip").alias("round_trip"))
             .groupBy("doc_id", "digest")
             .agg(F.expr("flatten(transform(array_sort(collect_list(struct(k, ids))), x -> x.ids))").alias("ids"),
                  F.count("*").cast("int").alias("n_chunks"), F.min("round_trip").alias("round_trip"),
                  F.min("copies").alias("copies"))
             .selectExpr("doc_id", "ids", "n_chunks", "round_trip", "explode(sequence(1L, copies)) as _copy")
             .drop("_copy"))
    return short.unionByName(whole).selectExpr("doc_id", "ids", "cast(size(ids) as bigint) as n_tokens", "n_chunks",
                                               "round_trip")
