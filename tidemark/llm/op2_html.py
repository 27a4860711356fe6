"""Main text of web pages by consensus paths per host.

Every page is read once by a small tag scanner that yields its text blocks with
the generalised path of their containers (tag and classes, digits as ``#``).
Each container of a page is scored by the text in its blocks, less link text;
the best container's path is the page's vote. Votes are added up per host in
Spark (hash aggregation: one row per host and path leaves a task), and the
winning path of a host extracts the text of all its pages; a page without that
path falls back to its own best container. Text that stands right beside the
winning container, in the containers around it below the body, belongs to it.

Dropped inside a container: menus, headers (headings of an article's own header
stay), footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments, told by tag, by class, id or role words, and by hidden markup; inline
elements too, at any depth (not in source code, whose classes are colours). An
``article``, an inline element, a paragraph or a heading is dropped by a word
only if a whole class, id or role is the word (``ad``, not ``tag-ads``); other
elements of an article go by the word at an end of a value, and only by words
for adverts, comments, sharing and navigation. An element dropped by words stands again (nested
ones stay dropped) if it is the outermost around an ``article`` or ``main`` and
the page keeps no other one, save for reader comments; and if it holds
``LEAST`` characters or more, less link text, and the page keeps next to
nothing: fewer than ``FEW`` characters, or, save for comments, less than a
tenth of them, and no other article or main. Elements whose whole class, id or
role is a word for adverts or consent never stand. White
space inside a block becomes one space, blocks are trimmed and joined by ``\\n``.

Defined cases: null html is empty and gives empty text; null or odd urls share
the host ``''``; unclosed or misnested tags are closed by their parents; a page
of any length is read whole; repeated rows are treated one by one; ties between
paths of a host go to more votes, then the larger score, then the path that
sorts first, and within a page to the container that opens first;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches, tidy

#: Winning paths are broadcast up to this many hosts (counted), else joined.
BROADCAST_HOSTS = 200_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z0-9]+")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "body", "head", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
         "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"body", "article", "main", "section", "div", "td", "center", "blockquote"}
DROPPED_TAGS = {"head", "nav", "footer", "aside", "menu", "form", "fieldset", "button", "select", "dialog", "search",
                "datalist", "label", "option"}
DROPPED_WORDS = {
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "topbar", "masthead", "footer", "sidebar", "aside", "rail", "widget", "widgets", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "banner", "alert", "popup", "modal", "overlay", "disclaimer", "copyright", "ad",
    "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo",
    "promotion", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "share",
    "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription",
    "signup", "login", "search", "searchbox", "form", "skip", "contentinfo", "complementary"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion"}
ADVERT_WORDS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
                "sponsors", "promo", "promotion", "cookie", "cookies", "consent", "gdpr"}
#: Words that, at an end of a longer value, drop an element of an article.
STORY_WORDS = (ADVERT_WORDS | COMMENT_WORDS | {"share", "sharing", "social", "newsletter", "subscribe", "signup", "sidebar",
                                               "nav", "navigation", "menu", "footer", "pagination", "breadcrumb", "breadcrumbs"}
               ) - {"discussion", "reply", "respond"}
KEPT_TAGS = {"html", "body", "main"}
#: Elements that a start tag of the key closes when one is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: An implied end looks no further up than these.
FENCE = {"ul", "ol", "table", "dl", "select", "div", "article", "section", "body", "main", "aside", "nav"}


#: Path of the page itself, the container of blocks outside any other.
ROOT = "/html"


#: Characters of kept text that are next to nothing, and of a dropped element
#: that may stand instead.
FEW, LEAST = 25, 50


#: Elements dropped by words that one chain tells apart; inside so many others
#: an element never stands.
CHAIN = 16
#: Score levels: beyond them a container's share is next to nothing.
LEVELS = 40


class Paths:
    """Generalised container paths of one page as numbers: a path is its
    parent's number and a label, so deep pages take memory by their length."""

    def __init__(self):
        self.parent, self.label, self.known = [-1], [ROOT[1:]], {}

    def child(self, parent: int, label: str) -> int:
        found = self.known.get((parent, label))
        if found is None:
            found = self.known[parent, label] = len(self.label)
            self.parent.append(parent)
            self.label.append(label)
        return found

    def name(self, path: int) -> str:
        parts = []
        while path >= 0:
            parts.append(self.label[path])
            path = self.parent[path]
        return "/" + "/".join(reversed(parts))

    def find(self, name: str) -> int | None:
        """Number of a named path, if the page has it."""
        parts = name.split("/")[1:]
        if not parts or parts[0] != self.label[0]:
            return None
        path: int | None = 0
        for label in parts[1:]:
            path = self.known.get((path, label))
            if path is None:
                return None
        return path

    def under(self, path: int) -> list[bool]:
        """Whether each path is ``path`` or below it (parents come first)."""
        out = [False] * len(self.label)
        for p in range(path, len(out)):
            out[p] = p == path or self.parent[p] >= 0 and out[self.parent[p]]
        return out


class Block:
    __slots__ = ("path", "text", "links", "drops", "story")

    def __init__(self, path: int, text: str, links: int, drops: tuple = (), story: tuple | None = None):
        self.path, self.text, self.links = path, text, links
        #: open elements dropped by words, from outside, as (number, 0 or 1 comments or 2 adverts)
        self.drops = drops
        #: of the innermost article or main: its drops, whether it is in an article, number of its main
        self.story = story


def _labels(raw: str) -> tuple[str, list[str], bool, set[str]]:
    """(generalised classes, words of class, id and role, hidden, whole values)."""
    classes, words, hidden, whole = "", [], False, set()
    if raw and not raw.isspace():
        for m in ATTR.finditer(raw):
            name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
            if name == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "#", c).replace("/", "|") for c in value.lower().split()}))
            if name in ("class", "id", "role"):
                words += WORD.findall(value.lower())
                whole.update(value.lower().split())
            elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
    return classes, words, hidden, whole


def _dropped(tag: str, words: list[str], whole: set[str], in_story: bool) -> bool:
    """Dropped by words. An article, an inline element and a paragraph or
    heading go by a whole value only, and so does any element inside an article
    or main unless its value starts or ends with a word for adverts, comments
    or sharing (``related-work`` is text of the article)."""
    if tag in KEPT_TAGS:
        return False
    if not whole.isdisjoint(DROPPED_WORDS):
        return True
    if tag == "article" or tag == "p" or tag in HEADINGS or tag not in BLOCK:
        return False
    if in_story:
        ends = {w for value in whole for w in (WORD.findall(value) or [""])[::len(WORD.findall(value)) - 1 or 1]}
        return not ends.isdisjoint(STORY_WORDS)
    return any(w in DROPPED_WORDS and not (i and words[i - 1] in ("with", "has", "no", "without"))
               for i, w in enumerate(words))


def _standing(blocks: list[Block]) -> list[Block]:
    """The blocks kept once dropped elements that stand again are kept."""
    again: set[int] = set()

    def still(b: Block) -> tuple:
        return tuple(d for d in b.drops if d[0] not in again)

    def worth(some: list[Block]) -> int:
        return sum(max(0, len(b.text) - 2 * b.links) for b in some)

    while True:
        kept = [b for b in blocks if not still(b)]
        rest = [b for b in blocks if still(b)]
        if not rest:
            return kept
        stories = {b.story for b in kept if b.story and not b.drops}
        mains = {b.story[2] for b in kept if b.story and b.story[2]}
        new = set()
        if not any(b.story and b.story[1] for b in kept):
            for b in rest:
                if b.story and mains <= {b.story[2]} and not any(c for _, c in still(b)):
                    new |= {d[0] for d in b.story[0] if d[0] not in again and d == still(b)[0]}
        if not new:
            size, groups = worth(kept), {}
            for b in rest:
                if still(b)[0][1] < 2 and (not stories or b.story in stories):
                    groups.setdefault(still(b)[0], []).append(b)
            big = sorted((-worth(g), d) for d, g in groups.items()
                         if worth(g) >= LEAST and (size < FEW or not d[1] and 10 * size < worth(g)))
            # comments stand only if nothing else does
            new = {d[0] for _, d in sorted(big, key=lambda x: x[1][1])[:1]}
        if not new:
            return kept
        again |= new


_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
#: Elements that matter to implied ends.
_MARKS = FENCE | set().union(*CLOSES.values())


class Element:
    __slots__ = ("tag", "path", "state", "drops", "story", "verbatim")

    def __init__(self, tag: str, path: int, state: int, drops: tuple, story: tuple | None, verbatim: bool):
        self.tag, self.path = tag, path
        #: 0 kept, 1 headings only, 2 dropped
        self.state, self.drops, self.story = state, drops, story
        #: inside pre or code, where classes of inline elements colour the source
        self.verbatim = verbatim


class Scanner:
    """One pass over the tags of a page. Open elements are counted by tag, and
    blocks and implied ends have stacks of their own, so that no tag looks
    through all open elements."""

    def __init__(self):
        self.paths, self.out = Paths(), []
        self.stack = [Element("", 0, 0, (), None, False)]
        self.open: dict[str, int] = {}
        self.blocks: list[int] = []
        self.marks: list[int] = []
        self.text: list[str] = []
        self.links = self.opened = 0

    def add(self, piece: str) -> None:
        """Text counts by the state of the element that it is in."""
        last = self.stack[-1]
        if last.state == 0 or last.state == 1 and any(x.tag in HEADINGS for x in self.stack[-4:]):
            self.text.append(piece)
            if any(x.tag == "a" for x in self.stack[-4:]):
                self.links += len(piece)

    def emit(self) -> None:
        if self.text:
            last = self.stack[-1]
            line = " ".join(entities.unescape("".join(self.text)).split())
            if line:
                self.out.append(Block(last.path, line, self.links, last.drops, last.story))
            self.text.clear()
        self.links = 0

    def shut(self, k: int) -> None:
        if self.blocks and self.blocks[-1] >= k:
            self.emit()
        for some in (self.blocks, self.marks):
            while some and some[-1] >= k:
                some.pop()
        for x in self.stack[k:]:
            self.open[x.tag] -= 1
        del self.stack[k:]

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.shut(k)
        elif tag in BLOCK:
            self.emit()

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.shut(self.blocks[-1])  # an open paragraph ends at any block
        if tag in CLOSES:
            i = len(self.marks) - 1
            while i >= 0:
                k = self.marks[i]
                if self.stack[k].tag in CLOSES[tag]:
                    self.shut(k)
                    if tag != "tr":
                        break
                elif self.stack[k].tag in FENCE:
                    break
                i -= 1
        if tag in BLOCK:
            self.emit()
        classes, words, hidden, whole = _labels(attributes)
        last = self.stack[-1]
        path, state, drops, story = last.path, last.state, last.drops, last.story
        verbatim = last.verbatim or tag in ("pre", "code")
        if state < 2:
            self.opened += 1
            comments = not COMMENT_WORDS.isdisjoint(whole if tag == "article" else words)
            kind = 2 if not ADVERT_WORDS.isdisjoint(whole) else int(comments)
            head = tag == "header" or "header" in words and tag in ("div", "section", "hgroup")
            if hidden or tag in DROPPED_TAGS:
                state = 2
            elif _dropped(tag, words, whole, story is not None):
                if tag not in BLOCK:
                    state = state if verbatim else 2
                elif len(drops) < CHAIN:
                    drops = (*drops, (self.opened, kind))
                else:
                    state = 2
            elif head:
                state = 1 if self.open.get("article") or self.open.get("main") else 2
            if tag == "article" and not comments:
                story = (drops, True, story[2] if story else 0)
            elif tag == "main":
                story = (drops, story is not None and story[1], self.opened)
        if tag in CONTAINERS:
            path = self.paths.child(path, f"{tag}{'.' + classes if classes else ''}")
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        if tag in _MARKS:
            self.marks.append(len(self.stack))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(Element(tag, path, state, drops, story, verbatim))

    def scan(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = TAG.search(page, at)
            if m is None:
                self.add(page[at:])
                break
            if m.start() > at:
                self.add(page[at:m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[6] or ""
            if m[1] or m[4]:
                self.end(tag)
            elif tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = _CLOSE[tag].search(page, at)
                    at = close.end() if close else end
            elif tag in VOID:
                if tag == "hr":
                    self.emit()
                elif tag == "br":
                    self.add(" ")
            else:
                self.start(tag, attributes)
        self.emit()


def page_blocks(page: str) -> tuple[list[Block], Paths]:
    """The kept text blocks of a page, in order, and its paths."""
    scanner = Scanner()
    scanner.scan(page)
    return _standing(scanner.out), scanner.paths


def best_container(blocks: list[Block], paths: Paths) -> tuple[int, float]:
    """The container of the highest score: the text of its own blocks in full,
    of the blocks one level down by half, and so on (``LEVELS`` levels); link
    text counts against; an ``article`` or ``main`` weighs twice."""
    scores: dict[int, float] = {}
    for b in blocks:
        worth, p = len(b.text) - 2.0 * b.links, b.path
        for _ in range(LEVELS):
            if p < 0:
                break
            scores[p] = scores.get(p, 0.0) + worth
            worth, p = worth / 2, paths.parent[p]
    best, top = -1, 0.0
    for p, s in scores.items():
        if re.match(r"(article|main)\b", paths.label[p]):
            s *= 2.0
        if s > top or s == top and 0 <= p < best:
            best, top = p, s
    return best, top


def inside(blocks: list[Block], paths: Paths, path: int | None) -> list[Block]:
    """Blocks under a path, and the text right beside it: blocks of its parents'
    own, up to the page's body, that are not mostly links."""
    if path is None or path < 0:
        return []
    under, beside, p = paths.under(path), set(), paths.parent[path]
    if not any(under[b.path] for b in blocks):
        return []
    while p > 0 and not re.match(r"(html|body)\b", paths.label[p]):
        beside.add(p)
        p = paths.parent[p]
    return [b for b in blocks if under[b.path] or b.path in beside and 2 * b.links < len(b.text)]


def main_text(page: str, path: str | None) -> str:
    """Text of the blocks under ``path``, else under the page's best container."""
    blocks, paths = page_blocks(page)
    kept = inside(blocks, paths, paths.find(path)) if path else []
    if not kept and blocks:
        kept = inside(blocks, paths, best_container(blocks, paths)[0]) or blocks
    return "\n".join(b.text for b in kept)


def vote(page: str) -> tuple[str, float]:
    """Path and score of a page's best container."""
    blocks, paths = page_blocks(page)
    best, score = best_container(blocks, paths)
    return (paths.name(best) if best >= 0 else ""), score


def _vote(page: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = [vote(x.as_py() or "") for x in batch]
            yield pa.StructArray.from_arrays([pa.array([p for p, _ in got], pa.string()),
                                              pa.array([s for _, s in got], pa.float64())], names=["path", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "struct<path: string, score: double>")(page)


def _extract(page: Column, path: Column) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, paths in batches:
            yield pa.array([main_text(x.as_py() or "", p.as_py()) for x, p in zip(pages, paths)], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "string")(page, path)


#: Host of a url: after the first ``://`` up to ``/``, ``?``, ``#`` or the end.
HOST = ("lower(regexp_extract(coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) "
        "end, ''), '^([^/?#]*)', 1))")


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, votes, score: the winning container path of every host."""
    votes = (small_batches(pages).selectExpr(f"`{url}` as url", f"`{html}` as html").selectExpr(f"{HOST} as host", "html")
             .select("host", _vote(F.col("html")).alias("v")).where("v.path <> ''")
             .groupBy("host", "v.path").agg(F.count("*").alias("votes"), F.round(F.sum("v.score"), 3).alias("score")))
    best = votes.groupBy("host").agg(F.max(F.struct("votes", "score")).alias("b"))
    # ties on votes and score: the smallest path
    return (votes.join(best, "host").where("votes = b.votes and score = b.score")
            .groupBy("host").agg(F.min("path").alias("path"), F.max("votes").alias("votes"),
                                 F.max("score").alias("score")))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    won = cut(host_paths(pages, url, html).select("host", "path"))
    if won.count() <= BROADCAST_HOSTS:
        won = F.broadcast(won)
    rows = pages.selectExpr(f"`{page_id}` as page_id", f"`{url}` as url", f"`{html}` as html")
    return (rows.withColumn("host", F.expr(HOST)).join(won, "host", "left")
            .select("page_id", "url", _extract(F.col("html"), F.col("path")).alias("text"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
