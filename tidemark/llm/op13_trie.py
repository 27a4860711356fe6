"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations are sequences of turns (role, text). A node is a distinct prefix;
it is named by its smallest member and its depth, and a prefix is recognised by
the exclusive or of 128-bit hashes of (depth, role, text), which is associative:
a conversation of any length is cut into blocks of 4,096 turns, scanned
inside the blocks, and the blocks get the running value of those before them.
Turns are put in order by one range exchange, so that a conversation with a
third of all turns spreads over tasks; its positions continue across tasks by
an offset (at most one conversation begins before a task, so the table of
offsets has at most one row per task).

A node of one member is the private tail of a conversation: a chain with one
leaf and nothing to save. The nodes of two members or more are the forest that
is rolled up:

1. The subtree weight of a node, the turns of its members from its depth on, is
   known from one aggregation. In every component the deepest node with more
   than half of the component's weight is the centroid; the parts that remain
   without it have half the weight at most, so the rounds needed grow with the
   logarithm of the number of turns, however deep the trie is.
2. Which nodes lie below the centroid, and under which of its children, is read
   from the table of ancestors (conversation, depth) -> node; no walk is made.
3. The totals of the centroid's part (own values and components below it) are
   added to every node on the path from the centroid to the component's top:
   pairs (node, descendant) meet in the one component whose centroid separates
   them, so every pair counts once.

Defined cases: a null conv_id belongs to no conversation and is left out; a
null role or text is empty; turns with one number (null is first) are ordered
by a hash of their content, and equal turns count each time; conversations
whose rebuilt sequence is empty are members of the root only; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import counted, cut, small_batches, stored, tidy

#: Conversations share the first turns of the conversation ``c - c % FAMILY``.
FAMILY = 20
#: Turns of a block of the prefix scan and ids of a piece of a member list, as a power of two.
BLOCK_BITS = 12
#: A key is heavy if it has more than 1 / HEAVY of the rows (so fewer than HEAVY keys are).
HEAVY = 2000
_WORD = r"[^\x20\x09-\x0D]+"


def join_on_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join with a table unique by ``keys`` whose column ``n`` is the
    number of ``rows`` of the key: fewer than HEAVY keys hold more than
    total / HEAVY rows and are broadcast, so no exchanged key is large."""
    edge = max(total // HEAVY, 1)
    heavy = F.broadcast(facts.where(f"{n} > {edge}"))
    return (rows.join(heavy, keys).unionByName(
        rows.join(heavy.select(*keys), keys, "left_anti").join(facts.where(f"{n} <= {edge}"), keys)))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of every row in its conversation, among the rows of the task."""
    last, seen = None, 0
    for batch in batches:
        c = batch.column("c").to_numpy()
        if not len(c):
            continue
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        new[0] = last is None or last != c[0]
        first = np.maximum.accumulate(np.where(new, np.arange(len(c)), -seen))
        place = np.arange(len(c)) - first + 1
        last, seen = c[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())],
                                         names=[*batch.schema.names, "place"])


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, p, h1, h2, words): turn p, from 1, of conversation c with its content
    hash and words, (c, size): every conversation)."""
    text, role = F.expr("coalesce(text, '')"), F.expr("coalesce(role, '')")
    light = (small_batches(conversations).selectExpr("cast(conv_id as bigint) as c", "cast(turn as bigint) as turn",
                                                     "cast(role as string) as role", "cast(text as string) as text")
             .where("c is not null")
             .select("c", "turn", F.md5(F.concat(F.expr("cast(octet_length(coalesce(role, '')) as string)"),
                                                 F.lit(":"), role, text)).alias("h"),
                     F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
             .selectExpr("c", "turn", "cast(conv(substr(h, 1, 16), 16, -10) as bigint) as h1",
                         "cast(conv(substr(h, 17), 16, -10) as bigint) as h2", "words",
                         "monotonically_increasing_id() as copy"))
    order = ["c", "turn", "h1", "h2", "copy"]
    placed = cut(light.repartitionByRange(*order).sortWithinPartitions(*order)
                 .selectExpr("c", "h1", "h2", "words", "spark_partition_id() as task")
                 .mapInArrow(tidy(_places), "c long, h1 long, h2 long, words long, task int, place long"))
    runs = cut(placed.groupBy("c", "task").agg(F.max("place").alias("n")))
    before = (runs.selectExpr("c", "task", "sum(n) over (partition by c order by task) - n as shift")
              .where("shift > 0"))  # at most one conversation of a task began before it
    turns = (placed.join(F.broadcast(before), ["c", "task"], "left")
             .selectExpr("c", "place + coalesce(shift, 0) as p", "h1", "h2", "words"))
    return turns, runs.groupBy("c").agg(F.sum("n").alias("size"))


def rebuilt_paths(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, d, g1, g2, words, len): the prefix of d rebuilt turns, root included,
    (c, len): every rebuilt conversation)."""
    sizes = cut(sizes)
    base = sizes.where(f"c % {FAMILY} = 0").selectExpr("c as b", "size as b_size")
    facts = cut(sizes.selectExpr("c", "size", f"c - c % {FAMILY} as b", "crc32(cast(c as string)) % 4 as h")
                .join(base, "b", "left")
                .selectExpr("c", "size", "b", "h", "least(h, coalesce(b_size, 0)) as k")
                .selectExpr("*", "k + greatest(size - h, 0) as len"))
    total = sizes.agg(F.expr("coalesce(sum(size), 0)")).first()[0]
    heads = turns.where(f"c % {FAMILY} = 0 and p <= 3").withColumnRenamed("c", "b")
    shared = facts.join(heads, "b").where("p <= h").selectExpr("c", "p as d", "h1", "h2", "words", "len")
    own = (join_on_facts(turns, facts.select("c", "size", "h", "k", "len"), ["c"], "size", total)
           .where("p > h").selectExpr("c", "p - h + k as d", "h1", "h2", "words", "len"))
    rows = (shared.unionByName(own)
            .selectExpr("c", "d", "words", "len", f"shiftright(d - 1, {BLOCK_BITS}) as block",
                        "xxhash64(d, h1, h2) as t1", "xxhash64(h2, 1, h1, d) as t2"))
    over = "over (partition by c, block order by d rows between unbounded preceding and current row)"
    scanned = rows.selectExpr("c", "d", "words", "len", "block", f"bit_xor(t1) {over} as g1", f"bit_xor(t2) {over} as g2")
    block = 1 << BLOCK_BITS
    if facts.where(f"len > {block}").take(1):
        scanned = cut(scanned)
        ends = (scanned.where(f"len > {block} and d % {block} = 0")
                .selectExpr("c", "block + 1 as block",
                            "bit_xor(g1) over (partition by c order by block) as o1",
                            "bit_xor(g2) over (partition by c order by block) as o2"))
        scanned = (scanned.join(ends, ["c", "block"], "left")
                   .selectExpr("c", "d", "words", "len", "g1 ^ coalesce(o1, 0L) as g1", "g2 ^ coalesce(o2, 0L) as g2"))
    root = facts.selectExpr("c", "0L as d", "0L as words", "len", "0L as g1", "0L as g2")
    return cut(scanned.select("c", "d", "words", "len", "g1", "g2").unionByName(root)), facts.select("c", "len")


def rollup(forest: DataFrame, ancestors: DataFrame, values: list[str]) -> DataFrame:
    """m, d and, for each value column, its sum over the node's subtree.

    ``forest`` has the nodes (m, d) of one tree, their subtree weight w and the
    values; ``ancestors`` has, for the conversations m, the node ``up`` at depth
    ``e`` of conversation ``a`` and ``next`` at depth e + 1 (names of nodes at
    those depths).
    """
    top = forest.where("d = 0").select("m").first()
    if top is None:
        return forest.selectExpr("m", "d", *values)
    level = stored(forest.selectExpr("m", "d", "w", *values, f"{top.m}L as tm", "0L as td",
                                     *(f"0L as sum_{v}" for v in values)))
    done = []
    while not level.isEmpty():
        tops = level.where("m = tm and d = td").selectExpr("tm", "td", "w as weight")
        centre = stored(level.join(tops, ["tm", "td"]).where("2 * w > weight").groupBy("tm", "td")
                        .agg(F.max(F.struct("d", "m", "w")).alias("c"))
                        .selectExpr("tm", "td", "c.m as cm", "c.d as cd", "c.w as cw"))
        parts = centre.count()
        seen = level.join(counted(centre, parts), ["tm", "td"])
        # nodes named by the centroid's conversation are on its path; others are looked up
        near = seen.where("m = cm").selectExpr("*", "m as up", "m as next")
        far = (seen.where("m <> cm").withColumn("a", F.expr("if(d >= cd, m, cm)"))
               .withColumn("e", F.expr("least(d, cd)")).join(ancestors, ["a", "e"], "left").drop("a", "e"))
        placed = stored(near.unionByName(far).selectExpr(
            "m", "d", "w", "tm", "td", "cm", "cd", "cw", "next", "m = cm and d = cd as centre",
            "coalesce(d >= cd and up = cm, false) as below", "coalesce(d < cd and up = m, false) as path",
            *values, *(f"sum_{v}" for v in values)))
        totals = stored(placed.where("below").groupBy("tm", "td").agg(*(F.sum(v).alias(f"t_{v}") for v in values)))
        added = placed.join(counted(totals, parts), ["tm", "td"]).selectExpr(
            "m", "d", "if(path, w - cw, w) as w", *values, "if(below and not centre, next, tm) as tm",
            "if(below and not centre, cd + 1, td) as td", "centre",
            *(f"sum_{v} + if(path or centre, t_{v}, 0L) as sum_{v}" for v in values))
        done.append(added.where("centre").selectExpr("m", "d", *(f"sum_{v} as {v}" for v in values)))
        level = stored(added.where("not centre").drop("centre"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, in order, joined by commas."""
    at, state = None, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                           pa.array([x[1] for x in out], pa.int64()),
                                           pa.array([x[2] for x in out], pa.string())], names=["m", "d", "sha"])
        out.clear()
        return rows

    for batch in batches:
        for m, d, piece in zip(*(batch.column(c).to_pylist() for c in ("m", "d", "piece"))):
            if at != (m, d):
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (m, d), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield flush()
    if at is not None:
        out.append((*at, state.hexdigest()))
        yield flush()


def member_hashes(ends: DataFrame) -> DataFrame:
    """m, d, sha of the nodes (m, d) at which conversations c end. Ids are put
    in pieces of at most 4096; a node's pieces stream through one hash."""
    pieces = (ends.groupBy("m", "d", F.expr(f"shiftright(c, {BLOCK_BITS})").alias("part"))
              .agg(F.expr("array_join(transform(array_sort(collect_list(c)), x -> cast(x as string)), ',') as piece")))
    return (pieces.repartition("m", "d").sortWithinPartitions("m", "d", "part").select("m", "d", "piece")
            .mapInArrow(tidy(_hashes), "m long, d long, sha string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 of every node."""
    turns, sizes = ordered_turns(conversations)
    paths, lengths = rebuilt_paths(turns, sizes)
    nodes = cut(paths.groupBy("d", "g1", "g2").agg(
        F.min("c").alias("m"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.sum("len").alias("lens"), F.max("len").alias("deepest")))
    shared = nodes.where("n_convs > 1")
    total = paths.count()
    met = stored(join_on_facts(paths.select("c", "d", "g1", "g2"), shared.select("d", "g1", "g2", "m", "n_convs"),
                            ["d", "g1", "g2"], "n_convs", total).selectExpr("c as a", "d as e", "m as up"))
    parent = met.selectExpr("a as m", "e + 1 as d", "up as met")
    full = cut(nodes.join(parent, ["m", "d"], "left")
               .selectExpr("m", "d", "n_convs", "words", "lens", "deepest", "met",
                           "if(d = 0, null, coalesce(met, m)) as parent"))
    kids = (full.where("met is not null").groupBy(F.col("met").alias("m"), F.expr("d - 1 as d"))
            .agg(F.count("*").alias("n_children"), F.expr("count_if(n_convs = 1) as tails")))
    forest = stored(full.where("n_convs > 1").join(kids, ["m", "d"], "left")
                 .selectExpr("m", "d", "lens - n_convs * (d - 1) as w", "coalesce(n_children, 0L) as n_children",
                             "coalesce(tails, 0L) + if(n_children is null, 1L, 0L) as leaves",
                             "(n_convs - 1) * words as saved"))
    reps = forest.selectExpr("m as a").distinct()
    ancestors = stored(met.join(reps, "a", "left_semi")
                    .join(met.selectExpr("a", "e - 1 as e", "up as next"), ["a", "e"], "left"))
    rolled = rollup(forest.select("m", "d", "w", "leaves", "saved"), ancestors, ["leaves", "saved"])
    known = forest.select("m", "d", "n_children").join(rolled, ["m", "d"])
    ends = member_hashes(lengths.selectExpr("c", "len as d").join(met.selectExpr("a as c", "e as d", "up"),
                                                                  ["c", "d"], "left")
                         .selectExpr("coalesce(up, c) as m", "d", "c"))
    return (full.join(known, ["m", "d"], "left").join(ends, ["m", "d"], "left")
            .selectExpr("m as conv_id", "d as depth", "parent as parent_conv_id", "n_convs",
                        "coalesce(n_children, if(deepest > d, 1L, 0L)) as n_children",
                        "coalesce(leaves, 1L) as n_leaves", "coalesce(saved, 0L) as saved_tokens",
                        "coalesce(sha, sha2('', 256)) as ends_sha256"))
