"""HTML extraction by scoring the tree.

A page becomes a tree in one pass over its tags. What is never main text goes with all it holds:
scripts, styles, forms, menus, footers, asides, and headers outside an article. Each paragraph of what
is left passes points, one and those for its length and commas, to its ancestors, in full to the first
and in parts to those above; a container's points are discounted by the share of its text that stands
in links. Names (of a class or id) and roles that speak of adverts, notices, comments and the like only
weigh: what is so named counts for a tenth and passes no points on, but what it holds may still be the best,
as in a wrapper that is named after the sidebar beside it. The best container is kept, with those
siblings that score well beside it or are long paragraphs without links, and it is widened to the article
around it if it holds half of that or more. Parts of what is kept that are so named are left out.

Of what is kept every text counts: references are decoded, white space within a block becomes one
space, and blocks are joined by one space in page order. Time is linear in the page, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
NEVER = frozenset("head nav footer aside form button select dialog menu".split()) | RAW
BLOCK = frozenset("html body article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption fieldset address details summary hr form center".split())
#: Open elements that a start tag ends, up to the nearest that bounds the search.
ENDS = {
    "li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("tr td th thead tbody tfoot", "table"), "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table"), "option": ("option", "select"), "body": ("head", "html"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: How far up a start tag looks for an element that it ends.
DEEP = 64
#: Nouns that heads of class names and ids have to be, and roles, if they say that it is not main text.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu footer header masthead sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login comment comments commentlist disqus replies respond breadcrumb breadcrumbs pagination pager widget toolbar skip search".split()
)
#: What may follow such a noun, and what a name begins with that speaks of something else on the page.
GENERIC = frozenset("area bar block body bottom box button buttons card cell col column container content cta entry form group head holder icon icons inner item items left link links list main message outer panel post posts primary region right row secondary section slot strip text thread title toggle top unit wrap wrapper zone".split())
STATES = frozenset("has with no without is not show hide js".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
BASE = {"article": 30, "main": 25, "section": 5, "div": 5, "td": 3, "pre": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5}
PARAGRAPH = 25
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
COMMAS = re.compile("[,،、，]")


class Tree:
    """Elements by number, parents before children; texts in page order with the element they are in."""

    def __init__(self) -> None:
        self.tag, self.parent, self.gone, self.named = ["#"], [-1], [False], [False]
        self.texts: list[tuple[int, str | None]] = []  # None: the edge of a block
        self.stack = [0]
        self.blocks: list[int] = []  # places in the stack of open blocks
        self.opened: dict[str, int] = {}  # how many are open of each tag

    def cut(self, at: int) -> None:
        """Ends the open elements from this place of the stack on."""
        for n in self.stack[at:]:
            self.opened[self.tag[n]] -= 1
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def open(self, tag: str, attributes: str) -> None:
        stack, opened = self.stack, self.opened
        if tag in ENDS:
            ended, bound = ENDS[tag]
            i = len(stack) - 1
            for _ in range(min(i, DEEP) if any(map(opened.get, ended)) else 0):
                name = self.tag[stack[i]]
                if name in bound:
                    break
                if name in ended:
                    self.cut(i)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                i -= 1
        elif tag in BLOCK and self.blocks and self.tag[stack[self.blocks[-1]]] == "p":  # ends an open paragraph
            self.cut(self.blocks[-1])
        n, up = len(self.tag), stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.gone.append(self.gone[up] or tag in NEVER or tag == "header" and not opened.get("article") and not opened.get("main") or bool(attributes) and _hidden(attributes))
        self.named.append(bool(attributes) and tag not in ("html", "body", "main") and _aside(tag, attributes))
        if tag in BLOCK or tag == "br":
            self.texts.append((n, None))
        if tag not in VOID:
            if tag in BLOCK:
                self.blocks.append(len(stack))
            stack.append(n)
            opened[tag] = opened.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if not self.opened.get(tag):
            return
        i = len(self.stack) - 1
        while self.tag[self.stack[i]] != tag:
            i -= 1
        if tag in BLOCK:
            self.texts.append((self.stack[i], None))
        self.cut(i)


def _attributes(attributes: str) -> Iterator[tuple[str, str]]:
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        yield name.lower(), html.unescape(a or b or c)


def _hidden(attributes: str) -> bool:
    return "hidden" in attributes.lower() and any(name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" for name, value in _attributes(attributes))


def _says_aside(name: str) -> bool:
    """Is the head noun of a class name or id one of ``ASIDE``?"""
    parts = [x for y in PARTS.split(name) if y and (x := y.lower().rstrip("0123456789"))]
    if not parts or parts[0] in STATES:
        return False
    while len(parts) > 1 and parts[-1] in GENERIC:
        parts.pop()
    return parts[-1] in ASIDE or "".join(parts) in ASIDE


def _aside(tag: str, attributes: str) -> bool:
    for name, value in _attributes(attributes):
        if name in ("class", "id"):
            said = any(map(_says_aside, value.split()))
            if said and (tag != "article" or "comment" in value.lower()):
                return True
        elif name == "role" and value.lower().strip() in ROLES:
            return True
    return False


def parse(page: str) -> Tree:
    tree, at, find, tags = Tree(), 0, page.find, TAG
    while at < len(page):
        i = find("<", at)
        if i < 0:
            i = len(page)
        if i > at:
            tree.texts.append((tree.stack[-1], page[at:i]))
        if i >= len(page):
            break
        m = tags.match(page, i)
        if m is None and tags is TAG and page[i + 1 : i + 2].isalpha():  # a quote that nothing ends: quotes count no more
            tags = LOOSE
            m = tags.match(page, i)
        if m:
            tag, at = m[2].lower(), m.end()
            if m[1]:
                tree.close(tag)
                continue
            tree.open(tag, m[3])
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
        elif page.startswith("<!--", i):
            end = find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?", "</"), i) or page[i + 1 : i + 2].isalpha():
            end = find(">", i + 1)
            at = end + 1 if end >= 0 else len(page)
        else:
            tree.texts.append((tree.stack[-1], "<"))
            at = i + 1
    return tree


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    tree = parse(page)
    tag, parent, gone, n = tree.tag, tree.parent, tree.gone, len(tree.tag)
    size, links, own, commas, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    block = list(range(n))
    for i in range(1, n):
        linked[i] = tag[i] == "a" or linked[parent[i]]
        block[i] = i if tag[i] in BLOCK else block[parent[i]]
    texts = []
    for i, t in tree.texts:
        if t is None:
            texts.append((i, None))
        elif not gone[i]:
            t = html.unescape(t) if "&" in t else t
            texts.append((i, t))
            k = len(t.strip())
            size[i] += k
            own[block[i]] += k
            commas[block[i]] += len(COMMAS.findall(t))
            if linked[i]:
                links[i] += k
    # Points of paragraphs one, two, three and more levels below; children come before parents.
    one, two, three, more = ([0.0] * n for _ in range(4))
    named, most = tree.named, [0] * n  # most: text of an element without its named parts
    for i in range(n - 1, 0, -1):
        up = parent[i]
        size[up] += size[i]
        links[up] += links[i]
        most[i] += own[i] if block[i] == i else 0
        passed = 0.0 if named[i] else 1.0
        if not named[i]:
            most[up] += most[i]
        if own[i] >= PARAGRAPH and not gone[i]:
            one[up if tag[i] != "body" else i] += passed * (1 + commas[i] + own[i] / 100)
        two[up] += passed * one[i]
        three[up] += passed * two[i]
        more[up] += passed * (three[i] + more[i])
    points = [a + b / 2 + c / 6 + d / 9 for a, b, c, d in zip(one, two, three, more)]
    score = [(BASE.get(tag[i], 0) + points[i]) * (1 - links[i] / max(1, size[i])) * (0.1 if named[i] else 1) if points[i] and not gone[i] and tag[i] in BLOCK else float("-inf") for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] == float("-inf"):
        best = next((i for i in range(1, n) if tag[i] in ("article", "main") and not gone[i] and size[i]), next((i for i in range(1, n) if tag[i] == "body"), 0))
    least = max(10.0, 0.2 * score[best])
    top = parent[best]
    while top > 0 and tag[top] not in ("article", "body", "html"):
        top = parent[top]
    if top <= 0 or tag[top] != "article":
        top = parent[best]
        while top > 0 and tag[top] not in ("main", "body", "html"):
            top = parent[top]
    if top > 0 and tag[top] in ("article", "main") and 2 * size[best] >= most[top]:
        best = top  # the article is whole, headings and all
    keep = [False] * n
    keep[best] = True
    for i in range(1, n):
        up = parent[i]
        if keep[up]:
            keep[i] = not named[i]
        elif i != best and up == parent[best] and best > 0 and not gone[i] and not named[i] and tag[best] not in ("body", "html", "article"):
            keep[i] = score[i] >= least or tag[i] == "p" and size[i] > 80 and links[i] < 0.25 * size[i]
    out: list[str] = []
    for i, t in texts:
        if t is None:
            out.append(" ")
        elif keep[i]:
            out.append(t)
    return " ".join("".join(out).split())


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array([main_text(p) for p in batch["html"].to_pylist()], pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none) and n_chars (code points).

    Null html: as empty. Null page_id or url: kept as null. Repeated rows: each gives a row. Empty table:
    no rows. Broken markup never fails: open elements end where the page does. Extra columns are
    ignored."""
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
