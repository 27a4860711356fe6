"""Main text of pages, token counts and piece encodings."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import by_id, document_rows, prose
from tidemark.llm.op2_html import extract_main_text, host_paths, main_text, page_blocks
from tidemark.llm.op5_pieces import (Pieces, chunks_of, decode, encode_documents, normal, path_states, prefix_products,
                                     product)
from tidemark.llm.op8_tokens import PrefixCounter, PrefixIndex, prefix_counts, token_counts

BYTE_BPE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "A paragraph of the story that is long enough to matter, told at some length. "

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{x:"</p>"}}</style><script>var a="<p>no</p>";</script></head>'
    '<body class="has-sidebar"><header class="top"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><{open}><header><h1>Title &amp; more</h1>'
    '<span>by line</span></header><p>One<br/>two &lt;b&gt; <a href="x">link</a>&nbsp;end<p>Second &eacute;&#233;&#xe9;'
    '<div class="share">share me</div><form><p>mail</p><button>go</button></form><!-- <p>gone</p> --><ul><li>i1<li>i2'
    '</ul><p style="display:none">hidden</p><p>{text}</p></{close}><div id="comments"><article class="comment"><p>' +
    LONG * 30 + "</p></article></div><aside><p>side</p></aside><footer>&copy; foot</footer></body></html>")
WANT = "Title & more\nOne two <b> link end\nSecond ééé\ni1\ni2\n"


def pages():
    rows = [(i, f"https://h{i % 2}.example/{i}",
             PAGE.format(open="article" if i % 2 else 'main class="c12"', close="article" if i % 2 else "main",
                         text=f"text {i}")) for i in range(20)]
    return rows + [(20, "https://h1.example/odd", "<p>" + LONG + "<div>tail</div>"), (21, None, None), (22, "", ""),
                   (23, "https://h1.example/x", "no markup at all &amp; more"), (24, "https://h9.example/", "<nav>menu"),
                   (25, "https://h1.example/cut", '<body><article><p>cut <b>off <i cla'),
                   (26, "https://h0.example/long", "<main class='c3'><p>" + "word " * 60_000 + "</main>")]


def test_main_text(spark):
    df = spark.createDataFrame([p + ("clash", "c") for p in pages()],
                               "page_id long, url string, html string, host string, path string").repartition(3)
    got = by_id(extract_main_text(df), "page_id")
    for i in range(20):
        assert got[i].text == WANT + f"text {i}", i
    assert got[20].text == LONG.strip() + "\ntail" and got[23].text == "no markup at all & more"
    assert [got[i].text for i in (21, 22, 24)] == [""] * 3 and got[21].n_chars == 0 and got[21].url is None
    assert got[25].text == "cut off" and got[26].n_chars == 60_000 * 5 - 1
    paths = {r.host: r.path for r in host_paths(df).collect()}
    assert paths["h1.example"] == "/html/body.has-sidebar/article" and paths["h0.example"] == "/html/body.has-sidebar/main.c#"
    assert extract_main_text(df.limit(0)).count() == 0
    assert extract_main_text(df.union(df)).count() == 2 * len(pages())


def test_majority_path_beats_a_page_of_its_own(spark):
    page = "<body><div class='story'><p>{}</p></div><div class='extra'><p>{}</p></div></body>"
    rows = [(i, "http://h/", page.format(LONG * 3, "x")) for i in range(5)] + [(9, "http://h/", page.format("ok", LONG))]
    got = by_id(extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[9].text == "ok"
    assert main_text(page.format("ok", LONG), None) == LONG.strip()
    assert page_blocks("")[0] == [] and page_blocks("<" * 1000 + "a" * 10)[0]


@pytest.mark.parametrize("around", [
    "<article class='post category-social'>{}</article>", "<article class='post tag-ads'>{}</article>",
    "<div id='content-sidebar-wrap'><article>{}</article></div>", "<div class='layout right-sidebar'><main>{}</main></div>",
    "<main><div class='layout right-sidebar'><article>{}</article></div></main>",
    "<div class='layout right-sidebar'><div class='story'>{}</div></div>", "<div class='form-page'>{}</div>"])
def test_a_word_in_the_class_does_not_drop_the_story(spark, around):
    rest = ("<nav>Home</nav><div class='ad'>Buy</div>{}<section class='related'><article>teaser of another</article>"
            "</section><div id='comments'><article class='comment'><p>" + LONG * 30 + "</p></article></div>")
    rows = [(i, "http://h/", "<body>" + rest.format(around.format(f"<h1>T</h1><p>{LONG * 3}{i}</p>"
             "<div class='share'>share</div>")) + "</body>") for i in range(3)]
    got = by_id(extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[i].text for i in range(3)] == [f"T\n{LONG * 3}{i}" for i in range(3)]


def test_adverts_do_not_stand_for_a_short_story():
    advert = f"<div class='ad'>{LONG}</div>"
    assert main_text(f"<body>{advert}<article><h1>Short.</h1></article></body>", None) == "Short."
    assert main_text(f"<body>{advert}<div>Short.</div></body>", None) == "Short."
    assert main_text(f"<main><h1>T</h1><div class='layout right-sidebar'>{LONG * 2}</div></main>", None).startswith("T\nA par")


def odd_texts(n, size=40, seed=3):
    gen = random.Random(seed)
    some = [*"abc  \n\t'sdlveré日本   \x85\x1c　①½٣🎉́▁", "<|endoftext|>", "'ll", "123", "\r\n", "the", " of", "ing"]
    return ["".join(gen.choices(some, k=gen.randint(0, size))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    texts = {i: t for i, t in enumerate(odd_texts(1500))} | {-1 - (99 if r[0] is None else r[0]): r[1] for r in document_rows()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for doc, r in by_id(token_counts(df, BYTE_BPE)).items():
        text = texts[doc] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(ids), len(text.encode()), len(ids) > 512), repr(text[:60])
        if not r.over_limit:
            assert r.fit_bytes == r.n_bytes
    assert token_counts(edge_docs, BYTE_BPE).count() == len(document_rows())
    assert token_counts(no_docs, BYTE_BPE).count() == 0
    running = by_id(prefix_counts(df, BYTE_BPE))
    assert running[-4].running_tokens is None and running[-1].running_tokens[-1] > 100


def test_every_prefix_and_budget():
    counter = PrefixCounter(BYTE_BPE)
    for word in (" international", "aaaaaaaaaaaaaaa", " Ierrepamentenré", "日本語テキスト", "...!!!..."):
        data = word.encode()
        assert counter.prefixes(data) == [len(counter.merge(data[:i].decode("latin-1"))) for i in range(len(data) + 1)]
    index = PrefixIndex(counter, prose(3, 200) + "\n\nend <|endoftext|> x")
    size = len((prose(3, 200) + "\n\nend <|endoftext|> x").encode())
    counts = [index.tokens(i) for i in range(0, size + 1)]
    for budget in (0, 1, 7, 50, 10_000):
        assert index.longest(budget) == max(i for i, n in enumerate(counts) if n <= budget)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PIECE)


def scanned(pieces, text, chunk):
    """The three steps on one machine, as the operator strings them together."""
    parts = list(chunks_of(text, chunk, 64))
    mats = [pieces.transfer(p, lo, hi, k == 0, k == n - 1) for k, n, lo, hi, p in parts]
    states = path_states(mats) if len(mats) > 1 else []
    ids = []
    for k, n, lo, hi, part in parts:
        start = lo + pieces.states(part, lo)[states[k - 1]][1] if k else lo
        a, b = pieces.states(part, hi)[states[k]] if k < n - 1 else (0, 0)
        ids += pieces.ids(part[start:hi + a]).tolist() + pieces.ids(part[hi + a:hi + b]).tolist()
    return ids, mats


def test_scan_equals_the_library(pieces):
    gen = random.Random(8)
    some = [*"abcdetherinon   \n日本é🎉▁", "the", "ing", " of"]
    for i in range(150):
        text = "".join(gen.choices(some, k=gen.randint(0, 400)))
        for chunk in (40, 97):
            assert scanned(pieces, text, chunk)[0] == pieces.model.encode(text), repr(text)
    unbroken = "abcdetherinonthequickbrown" * 150
    ids, mats = scanned(pieces, unbroken, 500)
    assert ids == pieces.model.encode(unbroken) and -prefix_products(mats)[-1][0, 0] == len(ids)


def test_products_are_associative():
    gen = np.random.default_rng(1)
    a, b, c = (np.where(gen.random(s) < 0.3, -np.inf, gen.integers(-9, 0, s)) for s in ((1, 4), (4, 3), (3, 2)))
    assert np.array_equal(product(product(a, b), c), product(a, product(b, c)))
    assert np.array_equal(prefix_products([a, b, c])[-1], product(product(a, b), c))


def test_encode_and_decode_documents(spark, edge_docs, no_docs, pieces):
    from pyspark.sql import functions as F

    texts = {r[0]: r[1] for r in document_rows()}
    for chunk in (16_384, 500):
        rows = encode_documents(edge_docs, PIECE, chunk=chunk).collect()
        assert len(rows) == len(document_rows()) and all(r.round_trip for r in rows)
        for r in rows:
            assert r.ids == pieces.model.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
            assert r.n_chunks == max(1, -(-len(normal(texts[r.doc_id] or "")) // chunk))
    back = encode_documents(edge_docs, PIECE).select("doc_id", decode(F.col("ids"), PIECE).alias("t"))
    assert all(r.t == (texts[r.doc_id] or "") for r in back.collect())
    assert encode_documents(no_docs, PIECE).count() == 0
