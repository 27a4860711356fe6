"""Operators 11 to 13: DuckDB oracle, exact integers and eigenvectors, a plain trie; edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import op11_decontamination, op12_whitening, op13_trie
from tidemark.llm.op11_decontamination import contaminated_documents, contamination_digest, contamination_sql
from tidemark.llm.op12_whitening import Fit, exact_sums, independent_columns, whiten
from tidemark.llm.op13_trie import prefix_trie

# ---------------------------------------------------------------- 11

ITEMS = [(1, prose(50, 40)), (2, "Short ITEM"), (3, "one"), (4, prose(51, 10)), (5, None), (6, " .,; "),
         (7, prose(50, 40)), (None, prose(52, 20)), (10, "Ünder ÉTÉ naïve " + prose(53, 12)), (1, prose(54, 12)),
         (8, "x x x x x x x x x x x x x x x x")]
DOCS = [(0, prose(50, 40).upper().replace(" ", "\n--")), (1, "a short, item here; one"), (2, None), (3, ""), (4, " \t"),
        (5, "b " * 30 + prose(51, 10) + " c" * 20 + " " + prose(51, 10)), (6, prose(60, 4000) + " " + prose(50, 25)),
        (7, "x " * 30), (8, prose(52, 20)), (None, prose(54, 12)), (9, prose(9, 50)), (9, prose(9, 50)),
        (9, prose(50, 40)), (11, "Ünder ÉTÉ naïve " + prose(53, 12)), (12, "ünder été naïve " + prose(53, 12)),
        (13, " ".join(prose(51, 10).split(" ")[:9])), (14, "no\x00ne o\x7fne"), (15, "short short item item")]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, True) for r in rows],
                                 "doc_id long, text string, w string, key int, start boolean").repartition(3)


def _items(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, len int")


def test_leaks_equal_oracle(spark):
    con = duckdb.connect()
    for name, columns, rows in (("documents", "doc_id bigint, text varchar", DOCS), ("benchmark", "item_id bigint, text varchar", ITEMS)):
        con.execute(f"create table {name} ({columns})")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    want = con.execute(contamination_sql())
    got = contamination_digest(_docs(spark, DOCS), _items(spark, ITEMS))
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_leaks_in_parts_of_the_index(spark, monkeypatch):
    whole = sorted(map(str, contamination_digest(_docs(spark, DOCS), _items(spark, ITEMS)).collect()))
    monkeypatch.setattr(op11_decontamination, "PART_ROWS", 7)
    assert sorted(map(str, contamination_digest(_docs(spark, DOCS), _items(spark, ITEMS)).collect())) == whole


def test_leaks_against_words_counted_by_hand(spark):
    item = prose(70, 14)
    words = item.split(" ")
    docs = [(1, "a b " + " ".join(words[1:13]) + " c"), (2, " ".join(words[:9])), (3, item + " z " + item)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in
           contaminated_documents(_docs(spark, docs), _items(spark, [(10, item), (9, item)])).collect()}
    assert got == {1: (15, 12, ["10", "9"]), 2: (9, 0, []), 3: (29, 28, ["10", "9"])}


def test_leaks_of_no_rows(spark):
    assert contamination_digest(_docs(spark, []), _items(spark, ITEMS)).count() == 0
    clean = contamination_digest(_docs(spark, DOCS), _items(spark, [])).collect()
    assert len(clean) == len(DOCS) and not any(r.contaminated for r in clean)
    assert {r.items_sha256 for r in clean} == {hashlib.sha256(b"").hexdigest()}


def test_leak_search_uses_no_python_workers(spark):
    plan = contamination_digest(_docs(spark, DOCS), _items(spark, ITEMS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- 12

def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "z", 1, "d") for i, v in rows],
                                 "vec_id long, embedding array<double>, z string, n int, dim string").repartition(3)


def _check(got, rows, top=32):
    """Rows against exact integers and numpy's eigenvectors."""
    want = [(i, [int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in rows]
    n, x = len(want), np.array([v for _, v in want], dtype=object)
    total = x.sum(axis=0)
    exact = n * x.T.dot(x) - np.outer(total, total)
    cov = np.array([[float(Fraction(int(e), n * n)) for e in r] for r in exact])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(r, total)] for r in x])
    rank = int((values > values[0] * 1e-9).sum()) if values[0] > 0 else 0
    k = min(rank, top)
    assert len(got) == k * n
    dev = defaultdict(set)
    for i, r in zip((i for i, _ in want), x):
        dev[i].add(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)))
    z = {}
    for r in got:
        assert r.n == n and int(r.deviation) in dev[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-6)
        assert r.identity_error < 1e-8
        z.setdefault(r.component, []).append((r.vec_id, r.whitened))
    for c in range(1, k + 1):
        mine = np.array([w for _, w in sorted(z[c])])
        true = np.array([w for _, w in sorted(zip((i for i, _ in want), centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])))])
        assert min(np.abs(mine - true).max(), np.abs(mine + true).max()) < 1e-6


def test_whitening_of_random_vectors(spark):
    gen = np.random.default_rng(3)
    rows = [(i, (gen.normal(size=40) * np.linspace(1, 9, 40)).tolist()) for i in range(400)]
    _check(whiten(_vectors(spark, rows)).collect(), rows)


def test_whitening_of_dependent_and_constant_columns(spark):
    gen = np.random.default_rng(4)
    a = gen.integers(-50, 50, size=(60, 3))
    table = np.column_stack((a[:, 0], a[:, 0] * 2, a[:, 1], np.full(60, 7), a[:, 0] - a[:, 1], a[:, 2] * 5))
    rows = [(i, (r / 64.0).tolist()) for i, r in enumerate(table)]
    _check(whiten(_vectors(spark, rows)).collect(), rows)
    assert independent_columns(exact_sums(table.astype(float))[1:].astype(object)) == [0, 2, 3, 5]


def test_whitening_of_nearly_dependent_columns(spark):
    gen = np.random.default_rng(5)
    a = gen.integers(-(1 << 26), 1 << 26, size=(300, 2)).astype(float)
    table = np.column_stack((a[:, 0], a[:, 0] + gen.integers(0, 2, 300), a[:, 1]))
    got = whiten(_vectors(spark, [(i, (r / 64.0).tolist()) for i, r in enumerate(table)])).collect()
    assert len(got) == 900 and max(r.identity_error for r in got) < 1e-4


def test_whitening_edges(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, 3.0]), (3, [1.0, -1.0]), (3, [1.0, -1.0]), (None, [2.0, 2.0])]
    odd = [(4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])]
    got = whiten(_vectors(spark, rows + odd)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, None} and {r.n for r in got} == {5} and len(got) == 10
    assert whiten(_vectors(spark, [])).count() == 0
    assert whiten(_vectors(spark, [(1, [1.0]), (2, [1.0])])).count() == 0
    one = whiten(_vectors(spark, [(1, [0.0]), (2, [1.0])])).collect()
    assert sorted(round(r.whitened, 9) for r in one) == [-1.0, 1.0] and {int(r.deviation) for r in one} == {64 * 64}


def test_sums_stay_exact_for_large_values():
    y = np.array([[2.0**40, -(2.0**33)], [3.0, 2.0**61]])
    whole = np.array([[int(v) for v in r] for r in y], dtype=object)
    back = op12_whitening._whole(op12_whitening._limbs(exact_sums(y)))
    assert (back[1:] == whole.T.dot(whole)).all() and (back[0] == whole.sum(axis=0)).all()
    f = Fit(2, back)
    assert f.deviations(y) == [str(sum((2 * int(a) - int(s)) ** 2 for a, s in zip(r, back[0]))) for r in whole]


# ---------------------------------------------------------------- 13

TURNS = "conv_id long, turn long, role string, text string, m long, d int, words string"


def _turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "w") for r in rows], TURNS).repartition(3)


def plain_trie(rows):
    """The trie in plain Python: (conv_id, depth) -> the other columns."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), role or "", text or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + convs[c][h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
        ends[tuple(rebuilt[c])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = own + sum(saved[x] for x in kids[k])
    return {(min(members[k]), len(k)): (min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k],
                                        hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k in members}


def _trie(df):
    rows = df.collect()
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                          "ends_sha256"]
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_trie_of_random_conversations(spark):
    gen = random.Random(1)
    rows = [(c, t, gen.choice("ua"), gen.choice(["x", "y z", " a b  c\n"])) for c in range(90) for t in range(gen.randint(1, 8))]
    assert _trie(prefix_trie(_turns(spark, rows))) == plain_trie(rows)


def test_trie_of_deep_copies_in_blocks(spark, monkeypatch):
    """Chains longer than a block, copies that part at every depth, awkward rows."""
    monkeypatch.setattr(op13_trie, "BLOCK_BITS", 2)
    gen = random.Random(2)
    rows = [(c, t if t else None, "u" if c % 3 else None, f"w{t % 5}" if gen.random() < 0.98 else None)
            for c in range(45) for t in range(gen.randint(1, 30))]
    rows += [(-7, 1, "a", "b"), (None, 1, "a", "b"), (500, 0, "z", "z"), (521, 0, "z", "z"), (521, 0, "z", "z")]
    assert _trie(prefix_trie(_turns(spark, rows))) == plain_trie(rows)


def test_trie_of_few_and_no_rows(spark):
    assert prefix_trie(_turns(spark, [])).count() == 0
    for rows in ([(3, 1, "u", "hello there")], [(40, 2, "u", "a b"), (40, 1, "s", "c"), (41, 1, "s", "c"), (42, 9, None, None)]):
        assert _trie(prefix_trie(_turns(spark, rows))) == plain_trie(rows)


def test_hot_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op13_trie, "HEAVY", 3)
    rows = [(c, t, "u", f"t{t}") for c in range(12) for t in range(5)] + [(99, t, "u", f"x{t}") for t in range(80)]
    assert _trie(prefix_trie(_turns(spark, rows))) == plain_trie(rows)
