"""Main text of pages: a plain tree extractor as brute force, and awkward markup."""

from __future__ import annotations

import random
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from tests.llm.conftest import by_id, prose
from tidemark.llm.op2_html import BLOCK, CONTAINERS, extract_main_text, main_text, vote

LONG = "A paragraph of plain prose that carries the story of the page onwards. "


class Tree(HTMLParser):
    """The whole element tree of a well-formed page: [tag, class, children]."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["html", "", []]
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class", ""), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


GONE = {"nav", "footer", "aside", "form", "script", "button", "ad", "sidebar", "comments"}


def plain_text(page):
    """Best container by its definition, over the whole tree."""
    blocks, run = [], []

    def flush(path):
        line = " ".join("".join(t for t, _ in run).split())
        if line:
            blocks.append((path, line, sum(len(t) for t, link in run if link)))
        run.clear()

    def walk(node, path, link):
        tag, cls, children = node
        if tag in GONE or cls in GONE:
            if tag in BLOCK:
                flush(path)
            return
        if tag in BLOCK:
            flush(path)
        inner = path + ((f"{tag}.{cls}" if cls else tag),) if tag in CONTAINERS else path
        for c in children:
            if isinstance(c, str):
                run.append((c, link or tag == "a"))
            else:
                walk(c, inner, link or tag == "a")
        if tag in BLOCK:
            flush(inner)

    root = Tree(page).root
    for c in root[2]:
        walk(c, ("html",), False)
    paths, scores = [], {}
    for path, _, _ in blocks:
        paths += [path[:i + 1] for i in range(len(path)) if path[:i + 1] not in paths]
    for p in paths:
        scores[p] = sum((len(t) - 2.0 * n) / 2 ** (len(q) - len(p)) for q, t, n in blocks if q[:len(p)] == p)
        if p[-1].split(".")[0] in ("article", "main"):
            scores[p] *= 2
    best = max(scores.values(), default=0)
    if best <= 0:
        return [("/".join(()), "\n".join(t for _, t, _ in blocks))]
    out = []
    for won in (p for p in paths if scores[p] == best):
        beside = {won[:i] for i in range(2, len(won)) if won[i - 1].split(".")[0] != "body"}
        out.append(("/" + "/".join(won), "\n".join(
            t for q, t, n in blocks if q[:len(won)] == won or q in beside and 2 * n < len(t))))
    return out


def random_page(gen):
    def some(depth):
        out = []
        for _ in range(gen.randint(1, 4)):
            kind = gen.random()
            text = prose(gen.randrange(10**6), gen.randint(1, 30))
            if kind < 0.4 or depth > 5:
                out.append(f"<p>{text} <b>bold</b> {gen.choice(['', '<button>go</button>', '<span class=ad>buy</span>'])}</p>")
            elif kind < 0.55:
                out.append(f"<{gen.choice(['nav', 'aside', 'footer', 'form'])}>{some(depth + 2)}</{{}}>")
                out[-1] = out[-1].replace("{}", out[-1][1:out[-1].index(">")])
            elif kind < 0.65:
                out.append(f"<p><a href=x>{text}</a></p>")
            else:
                tag, cls = gen.choice(["div", "section", "article", "main", "div"]), gen.choice(["", "x", "y", "body"])
                out.append(f"<{tag} class='{cls}'>{some(depth + 1)}</{tag}>" if cls else f"<{tag}>{some(depth + 1)}</{tag}>")
        return "\n".join(out)
    return f"<body>{some(0)}</body>"


def test_main_text_equals_a_plain_tree_walk():
    gen = random.Random(8)
    for _ in range(250):
        page = random_page(gen)
        wants = plain_text(page)
        assert main_text(page, None) in [t for _, t in wants]
        assert vote(page)[0] in [p for p, _ in wants]


@pytest.mark.parametrize("page", [
    "<div>x" * 100_000, "<blockquote>text " * 50_000, "<svg/>" * 100_000 + "<p>hello there</p>",
    "<b>" * 4_000 + "</i>" * 100_000 + "hi", "<b>" * 4_000 + "<p>a</p>" * 20_000, "<div class='ad'>q " * 30_000,
    "<dl><dt><div>" + "<b>" * 4_000 + "<dd>a</dd>" * 20_000, "<div class='a b c'>" * 20_000 + LONG])
def test_deep_and_odd_pages_take_time_and_memory_by_their_length(page):
    start = time.perf_counter()
    main_text(page, None)
    assert time.perf_counter() - start < 20
    tracemalloc.start()
    main_text(page[:len(page) // 4], None)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_deep_pages_do_not_fail_the_job(spark):
    rows = [(1, "http://a.b/x", "<div>" * 1_100 + LONG * 3), (2, "http://a.b/y", "<div>" * 30_000 + LONG)]
    got = by_id(extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[1].text == (LONG * 3).strip() and got[2].text == LONG.strip()


def test_inline_adverts_forms_and_hidden_text_are_dropped():
    page = ("<body><article><p>Real text <button>Subscribe now</button> goes <span class='ad'>BUY SHOES</span> on "
            "<span hidden>HIDDEN</span><select><option>one</option></select><a class='share' href=x>Share</a> here. "
            f"{LONG}</p><pre><code><span class='token comment'># stays</span></code></pre></article></body>")
    assert main_text(page, None) == f"Real text goes on here. {LONG.strip()}\n# stays"


def test_text_beside_the_winning_container_is_kept():
    page = (f"<body><h1>Site</h1><div class='post'><h1>Head</h1><p>intro</p><div class='text'><p>{LONG * 5}</p></div>"
            "<p>closing</p><p><a href=x>only links here</a></p></div><p>outside</p></body>")
    assert main_text(page, None) == f"Head\nintro\n{(LONG * 5).strip()}\nclosing"


def test_words_in_an_article_drop_only_what_they_name():
    page = (f"<body><article><h1>T</h1><p id='search-results-study'>Study.</p><div class='related-work'>{LONG}</div>"
            "<div class='comments-area'>c</div><div class='social-share'>s</div><div class='ad'>a</div></article></body>")
    assert main_text(page, None) == f"T\nStudy.\n{LONG.strip()}"
