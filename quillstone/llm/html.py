"""Main text of web pages by tree scoring.

Pages are parsed into a tree of block elements with text blocks at its nodes.
Subtrees that are no part of an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out: by tag, role or
hidden attribute always; by a word of class or id as evidence that much text outweighs:
such a subtree stays if it holds most of the page's text (STAYS) and no article element stands outside, and words
that say what a holder has or lacks (has-sidebar, no-comments) are none. Each remaining
paragraph earns points for its length and commas and passes them to its ancestors, less the
farther away; a container's points are discounted by its link density. The best
container, raised to the article or main element around it, is kept with those of
its siblings that score alike or are plain paragraphs, and all of their blocks are
returned in page order. A list, table, quotation or preformatted text is a part of what
holds it, never the whole article.

A null or empty page gives an empty text; a page cut off inside a tag loses that
tag only, and an element never closed (a script, a button) itself only; of containers
with equal scores the first in the page is the best; repeated rows are answered each;
no text is capped, however long; an empty table gives no rows; a column of pages named
main_text gives way to the result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotated

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
#: HTML's raw-text and void elements, block elements, and what is no article.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
STARTS = re.compile("<(" + "|".join(sorted(BLOCK)) + r")\b", re.IGNORECASE)
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "search", "fieldset"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion",
    "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signin", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
NEVER_OUTSIDE = {"html", "body", "article", "main"}
#: Words after these in a name say what its holder has or lacks.
ABOUT = {"has", "have", "no", "not", "with", "without", "hide", "hidden", "show", "is", "toggle"}
#: Words that name what readers or advertisers write.
OF_OTHERS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "cookie", "cookies", "discussion", "disqus", "promoted", "replies", "reply", "respond", "sponsor", "sponsored"}
#: How sure a name is (an outside word amid others, at an end or alone, one of others), and the share of the page's own text from which it is ignored.
AMID, AT_END, BY_OTHERS = 1, 2, 3
STAYS = {AMID: 0.4, AT_END: 0.9, BY_OTHERS: 1.0}
#: Never an article alone: what holds them is.
PARTS = {"ul", "ol", "dl", "menu", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr"}
#: In a script or style never closed, a block's start tag that is in no string ends it.
CODE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|<(" + "|".join(sorted(BLOCK)) + r")\b", re.IGNORECASE | re.DOTALL)
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
SIBLING_SHARE, LEAST_SCORED, LEAST_SIBLING = 0.2, 25, 80


def name_says(value: str) -> int:
    """How sure a class or id is that its element is no article: 0, AMID, AT_END or BY_OTHERS."""
    sure = 0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        words = words[: next((k for k, w in enumerate(words) if w in ABOUT), len(words))]
        for k, w in enumerate(words):
            if w in OUTSIDE_WORDS:
                sure = max(sure, AMID if 0 < k < len(words) - 1 else BY_OTHERS if w in OF_OTHERS else AT_END)
    return sure


def outside(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is no article for certain, and how sure its name is of it."""
    if tag in OUTSIDE:
        return True, 0
    sure = 0
    if attributes and tag not in NEVER_OUTSIDE:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                sure = max(sure, name_says(value))
                continue
            value = value.lower()
            if name == "role" and value in OUTSIDE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, sure
    return False, sure


class Tree:
    """Block elements by number (parents before children), and text blocks (node, text, letters in links)."""

    def __init__(self, page: str):
        self.parent, self.tag, self.outside, self.sure = [-1], ["#"], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        stack, open_tags = [0], {}
        inline_outside: list[str] = []  # inline elements that are left out, and what is open inside them
        pieces: list[str] = []
        links, in_link, at, n = 0, 0, 0, len(page)

        def flush():
            nonlocal links
            if pieces:
                text = "".join(pieces)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((stack[-1], text, min(links, len(text))))
                pieces.clear()
            links = 0

        def pop_to(tag):
            while True:
                name = self.tag[stack.pop()]
                open_tags[name] -= 1
                if name == tag:
                    return

        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at and not self.outside[stack[-1]] and not inline_outside:
                piece = page[at:lt]
                pieces.append(piece)
                if in_link:
                    links += len(piece)
            if lt == n:
                break
            m = TOKEN.match(page, lt)
            if not m:
                # a stray "<" is text, as browsers have it
                if not self.outside[stack[-1]] and not inline_outside:
                    pieces.append("<")
                at = lt + 1
                continue
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if inline_outside:
                    if tag == inline_outside[-1]:
                        inline_outside.pop()
                    elif tag not in BLOCK:
                        continue
                if tag == "a":
                    in_link = 0
                elif tag in BLOCK:
                    inline_outside.clear()
                    flush()
                    if open_tags.get(tag):
                        pop_to(tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.IGNORECASE).search(page, at) if not m[3].endswith("/") else None
                if end:
                    at = end.end()
                elif not m[3].endswith("/"):
                    # never closed: what stands up to the next block goes with it, not the rest of the page
                    block = next((x for x in (CODE if tag in ("script", "style") else STARTS).finditer(page, at) if x[1]), None)
                    at = block.start() if block else n
                continue
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            elif tag in VOID:
                continue
            elif tag == "a":
                in_link = 1
            elif tag in BLOCK:
                flush()
                in_link = 0 if tag not in ("h1", "h2", "h3", "h4", "h5", "h6") else in_link
                if open_tags.get("p"):
                    pop_to("p")
                if tag in CLOSES_ITSELF and open_tags.get(tag):
                    for node in reversed(stack):
                        if self.tag[node] == tag:
                            pop_to(tag)
                            break
                        if self.tag[node] in CLOSES_ITSELF[tag]:
                            break
                self.parent.append(stack[-1])
                self.tag.append(tag)
                certain, sure = outside(tag, m[3])
                self.outside.append(self.outside[stack[-1]] or certain)
                self.sure.append(sure)
                stack.append(len(self.tag) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
            elif m[3] and not m[3].endswith("/") and (inline_outside and tag == inline_outside[-1] or any(outside(tag, m[3]))):
                inline_outside.append(tag)
        flush()
        self._weigh()

    def _weigh(self) -> None:
        """Leaves out the blocks of subtrees whose name says they are no article, but those that hold most of the page's text."""
        if not any(self.sure):
            return
        n = len(self.tag)
        held = [0.0] * n
        for node, text, links in self.blocks:
            held[node] += len(text) - links
        for k in range(n - 1, 0, -1):
            held[self.parent[k]] += held[k]
        # text of article and main elements outweighs any name outside of them
        inside, marked = [False] * n, [0.0] * n
        for k in range(1, n):
            named = self.tag[k] in ("article", "main")
            inside[k] = inside[self.parent[k]] or named
            marked[k] = held[k] if named and not inside[self.parent[k]] else 0.0
        for k in range(n - 1, 0, -1):
            marked[self.parent[k]] += marked[k]
        gone = [False] * n
        for k in range(1, n):
            share = held[k] / max(held[0], 1) if inside[k] or marked[k] == marked[0] else 0.0
            gone[k] = gone[self.parent[k]] or self.sure[k] > 0 and share < STAYS[self.sure[k]]
        self.blocks = [b for b in self.blocks if not gone[b[0]]]


def main_text(page: str | None) -> str:
    """The article of a page as one line."""
    if not page:
        return ""
    tree = Tree(page)
    n = len(tree.tag)
    points, letters, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in tree.blocks:
        letters[node] += len(text)
        linked[node] += links
        if len(text) >= LEAST_SCORED and tree.tag[node] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
            # a paragraph's points go to what holds it; text that stands in a container itself counts there
            up = tree.parent[node] if tree.tag[node] in ("p", "pre", "li", "td", "dd", "blockquote") else node
            for share in (1, 2, 4, 6, 8):
                if up <= 0:
                    break
                points[up] += worth / share
                up = tree.parent[up]
    for k in range(n - 1, 0, -1):
        letters[tree.parent[k]] += letters[k]
        linked[tree.parent[k]] += linked[k]
    score = [p * (1 - linked[k] / letters[k]) if letters[k] else 0.0 for k, p in enumerate(points)]
    best = max(range(n), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        best = next((k for name in ("article", "main") for k in range(n) if tree.tag[k] == name and letters[k]), 0)
    for name in ("article", "main"):
        up = best
        while up > 0 and tree.tag[up] != name:
            up = tree.parent[up]
        if up > 0:
            best = up
            break
    while tree.tag[best] in PARTS and tree.tag[tree.parent[best]] not in ("#", "body", "html") and linked[tree.parent[best]] * 2 < letters[tree.parent[best]]:
        best = tree.parent[best]
    kept = {best}
    if best and tree.tag[best] not in ("body", "html"):
        least = max(SIBLING_SHARE * score[best], 1e-9)
        for k in range(1, n):
            if tree.parent[k] == tree.parent[best] and k != best and letters[k]:
                density = linked[k] / letters[k]
                if tree.tag[best] != "article" and (score[k] >= least or tree.tag[k] == "p" and letters[k] >= LEAST_SIBLING and density < 0.25) or tree.tag[k] == "article" == tree.tag[best] and score[k] >= least:
                    kept.add(k)
    inside = [False] * n
    for k in range(n):
        inside[k] = k in kept or k > 0 and inside[tree.parent[k]]
    return " ".join(text for node, text, _ in tree.blocks if inside[node])


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages and main_text."""

    def make():
        return lambda batch: [pa.array([main_text(x) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()], pa.string())]

    return annotated(pages, make, [("main_text", pa.string(), "string")])
