"""Repetition coverage against brute force; language mixtures."""

from __future__ import annotations

import collections
import random
import re

import pytest

from tests.llm.conftest import SCHEMA, by_id, document_rows, prose
from tidemark.llm.op1_quality import keep_good, repetition_quality
from tidemark.llm.op10_language import keep_known, language_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered(words, 3)))


def covered(words, n):
    grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    times = collections.Counter(grams)
    return {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(n)}


def check_rows(got, texts):
    for doc, text in texts.items():
        r, words = got[doc], WORD.findall(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), doc
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        for n in (5, 7, 10):
            inside = sum(len(words[i]) for i in covered(words, n))
            assert r[f"coverage_{n}"] == pytest.approx(inside / max(1, sum(map(len, words))))


def test_counts_equal_brute_force(edge_docs):
    texts = {r[0]: r[1] for r in document_rows()}
    got = by_id(repetition_quality(edge_docs))
    check_rows(got, texts)
    assert not got[3].kept and not got[10].kept and not got[11].kept and not got[13].kept
    assert got[0].kept and got[9].kept and got[None].kept


def test_random_texts_equal_brute_force(spark):
    gen = random.Random(5)
    texts = {i: "".join(gen.choices(["a", "b", "é", " ", "  ", "\n", "\t", "\x0b", "c d", "🎉", "#"],
                                    k=gen.randint(0, 60))) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    check_rows(by_id(repetition_quality(df)), texts)


def test_filter_keeps_rows_whole(edge_docs, no_docs):
    kept = keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 9, 12, 14, 15, None}
    assert sum(r.doc_id == 14 for r in rows) == 2
    assert all(r.row == "r" and r.kept is True and r.s == "s" for r in rows)
    assert keep_good(no_docs).count() == 0 and repetition_quality(no_docs).count() == 0


def test_passages_pasted_twice_are_rejected(spark):
    words = prose(31, 400).split(" ")
    pasted = " ".join(words + words[40:80] + prose(32, 60).split(" ") + words[200:240])
    df = spark.createDataFrame([(1, pasted), (2, " ".join(words) + " " + prose(32, 140))], "doc_id long, text string")
    got = by_id(repetition_quality(df))
    assert 0.25 < got[1].coverage_10 < 0.35 and not got[1].base_failed and not got[1].kept
    assert got[2].kept and [r.doc_id for r in keep_good(df).collect()] == [2]


TONGUES = {"en": "the of and tion ing ent er ly with this that ", "de": "der die und sch ung ich ein keit für über ",
           "es": "el la que ción mente ado ñ los por está "}


def sentence(lang, seed, n=60):
    gen = random.Random(seed)
    return " ".join("".join(gen.choices(TONGUES[lang].split(), k=2)) for _ in range(n))


def language_rows():
    rows = [(i, sentence(lang, i), lang) for i in range(300) for lang in [list(TONGUES)[i % 3]]]
    return rows + [(900, None, "en"), (901, "", None), (902, "12 34 !!", "de"), (903, "A.", "en"), (None, "der", "de"),
                   (904, sentence("de", 1, 90) + " " + sentence("es", 2, 60), None)]


def test_language_of_held_out_and_mixed(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string").repartition(4)
    got = by_id(language_mix(df))
    held = [(r, lang) for i, _, lang in language_rows() for r in [got[i]] if r.held_out and i < 300]
    assert len(held) > 40
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[900].score == 0.0 and got[903].lang_pred in TONGUES and got[None].held_out is False
    mixed = got[904]
    assert mixed.lang_pred == "de" and set(mixed.languages) == {"de", "es"} and 0.4 < mixed.score < 0.8
    assert all(0 <= r.score <= 1 and abs(sum(r.shares) - 1) < 1e-6 for r in got.values() if r.languages)
    kept = keep_known(df)
    assert kept.columns == df.columns
    assert {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})


def test_documents_of_four_and_five_languages(spark):
    parts = ["bcd", "fgh", "jkl", "mnp", "qrs", "tvw"]
    names = "abcdef"

    def said(k, seed, n):
        gen = random.Random(seed)
        return " ".join("".join(gen.choice(parts[k]) + gen.choice("aeiou") for _ in range(3)) for _ in range(n))

    rows = [(i, said(i % 6, i, 60), names[i % 6]) for i in range(240)]
    mixes = {900: (35, 25, 20, 20), 901: (30, 25, 20, 15, 10), 902: (20, 20, 20, 20, 20), 903: (50, 30, 20)}
    rows += [(i, " ".join(said(k, i + k, 20 * n) for k, n in enumerate(mix)), None) for i, mix in mixes.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = by_id(language_mix(df))
    for i, mix in mixes.items():
        found = dict(zip(got[i].languages, got[i].shares))
        assert found == pytest.approx({names[k]: n / 100 for k, n in enumerate(mix)}, abs=0.03), i
    assert {900, 901, 902}.isdisjoint(kept := {r.doc_id for r in keep_known(df).collect()}) and 903 in kept


def test_language_without_anything_to_learn(edge_docs, no_docs, spark):
    assert language_mix(no_docs).count() == 0 and keep_known(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert by_id(language_mix(nothing))[1].lang_pred == "und"
    assert keep_known(edge_docs).columns == edge_docs.columns
    assert len(SCHEMA.split(",")) == len(edge_docs.columns) and prose(1, 3)
