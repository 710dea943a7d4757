"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to the elements around them, discounted
by link density. The element with the most points and those beside it that score well are
kept; what their marks show to be menus, notices, adverts, forms or comments is left out.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from skewlens.llm.words import mapped

# Element names and words in class, id and role, by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img br".split()
)
LEFT_OUT = frozenset("head nav footer aside form button dialog menu header fieldset".split())
#: An opening tag ends an open element of these names first.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: An open element is not ended from beyond these.
HOLDS = frozenset("table ul ol dl body html article section div td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = re.compile(
    r"(ads?|adv|advert\w*|adsense|adslot|sponsor\w*|promos?|promoted|promotions?|banners?|nav|navs|navbar|navigation|navlist|"
    r"menus?|menubar|sidebars?|side|breadcrumbs?|"
    r"pagination|pager|footer|masthead|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|commenter|commentform|disqus\w*|respond|replies|reply|"
    r"widget\w*|toolbar|skip|hidden|outbrain|taboola|paywall|topbar|bottombar|rail)$"
)
#: Marks of an element around the whole page, which is no sidebar although it has one.
AROUND = frozenset("has with no without wrapper layout container page site left right".split())
CONTENT = frozenset("article content main post entry story body text".split())

#: Elements above a paragraph that get points from it; farther ones would get under 1/64.
LEVELS = 64

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LETTERS = re.compile(r"[a-z]+")


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in LEFT_OUT and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        parts = LETTERS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if any(MARKS.match(p) for p in parts) and not AROUND.intersection(parts):
            return True
        if "header" in parts and not in_article and not CONTENT.intersection(parts):
            return True
    return False


class _Tree:
    """Elements by number: parent, tag, whether left out; and the text blocks in page order."""

    def __init__(self):
        self.parent, self.tag, self.out, self.article = [-1], ["#page"], [False], [False]
        self.stack = [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters within links
        self.pieces: list[str] = []
        self.linked, self.place, self.links = 0, 0, 0

    def text(self, raw: str) -> None:
        at = self.stack[-1]
        if self.out[at]:
            return
        text = unescape(raw) if "&" in raw else raw
        if not self.pieces:
            if not text.strip():
                return
            place = at
            while self.tag[place] in INLINE:
                place = self.parent[place]
            self.place = place
        self.pieces.append(text)
        if self.links:
            self.linked += len(text)

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.place, text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.end_block()
            self._close_first("p", HOLDS) if tag != "p" else self._close_first("p", HOLDS | {"button"})
            for name in ENDS.get(tag, ()):
                self._close_first(name, frozenset({"table", "ul", "ol", "dl", "select"}) - {name})
        if tag == "br" and self.pieces:
            self.pieces.append(" ")
        if tag in VOID:
            return
        above = self.stack[-1]
        within = self.article[above] or tag in ("article", "main")
        self.parent.append(above)
        self.tag.append(tag)
        self.article.append(within)
        self.out.append(self.out[above] or _left_out(tag, attributes, self.article[above]))
        self.stack.append(len(self.tag) - 1)
        self.links += tag == "a"

    def _close_first(self, tag: str, holds) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[depth]]
            if name == tag:
                return self._pop(depth)
            if name in holds:
                return

    def _pop(self, depth: int) -> None:
        for at in self.stack[depth:]:
            self.links -= self.tag[at] == "a"
        del self.stack[depth:]

    def close(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.end_block()
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[depth]]
            if name == tag:
                return self._pop(depth)
            if inline and name not in INLINE:
                return


def parse(html: str) -> _Tree:
    tree, at, end = _Tree(), 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        if not found:
            tree.text(html[at:])
            break
        if found.start() > at:
            tree.text(html[at : found.start()])
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                tree.text(found[0][9:].removesuffix("]]>"))
            continue
        if not found[4]:
            break  # the page ends within a tag
        tag = found[2].lower()
        if found[1]:
            tree.close(tag)
        elif tag in RAW:
            if not found[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = close.end() if close else end
        else:
            tree.open(tag, found[3])
    tree.end_block()
    return tree


def main_text(html: str) -> str:
    """Blocks of the article joined by line feeds; empty if the page has none."""
    tree = parse(html)
    if not tree.blocks:
        return ""
    size = len(tree.tag)
    points, chars, linked = [0.0] * size, [0] * size, [0] * size
    for place, text, in_links in tree.blocks:
        chars[place] += len(text)
        linked[place] += in_links
        if len(text) < 25:
            continue
        worth = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - in_links / len(text))
        own = tree.tag[place] in ("p", "pre", "td", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "figcaption")
        at, step = tree.parent[place] if own else place, 1
        while at >= 0 and step <= LEVELS:
            points[at] += worth / step
            at, step = tree.parent[at], step + 1
    for k in range(size - 1, 0, -1):  # elements come after their parents
        chars[tree.parent[k]] += chars[k]
        linked[tree.parent[k]] += linked[k]
    score = [p * (1 - l / c) if c else 0.0 for p, l, c in zip(points, linked, chars)]
    best = max(range(size), key=score.__getitem__)
    if score[best] > 0:
        lifted, at = best, best
        while at >= 0:
            if tree.tag[at] in ("article", "main"):
                lifted = at
            at = tree.parent[at]
        best = lifted
    else:
        inside = [k for k in range(size) if tree.article[k] and chars[k]]
        best = inside[0] if inside else 0
    enough = max(10.0, 0.2 * score[best])
    kept = {best}
    for k in range(1, size):
        if k != best and tree.parent[k] == tree.parent[best] and best and chars[k]:
            density = linked[k] / chars[k]
            paragraph = tree.tag[k] in ("p", "pre", "blockquote") and chars[k] > 80 and density < 0.25
            if not tree.article[best] and (score[k] >= enough or paragraph or re.fullmatch("h[1-6]", tree.tag[k])):
                kept.add(k)
            elif tree.tag[k] == tree.tag[best] and score[k] >= enough:
                kept.add(k)
    inside: dict[int, bool] = {-1: False}

    def is_in(k: int) -> bool:
        path = []
        while k not in inside and k not in kept:
            path.append(k)
            k = tree.parent[k]
        found = True if k in kept else inside[k]
        for p in path:
            inside[p] = found
        return found

    listed: dict[int, bool] = {-1: False}

    def link_list(k: int) -> bool:
        path, found = [], False
        while k not in listed and k not in kept:
            path.append(k)
            if tree.tag[k] in ("ul", "ol", "div", "section", "table", "dl") and linked[k] > 0.66 * chars[k]:
                found = True
                break
            k = tree.parent[k]
        else:
            found = k not in kept and listed[k]
        for p in path:
            listed[p] = found
        return found

    return "\n".join(text for place, text, n in tree.blocks if is_in(place) and not (n and link_list(place)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (code points).

    A null or blank page, or one without an article, has an empty text. Columns of ``pages``
    that clash with a result are replaced. Repeated rows stay. Any nesting depth is read
    without recursion.
    """

    def make():
        def of_pages(column):
            found = [main_text(page) for page in column.to_pylist()]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return of_pages

    return mapped(pages, [c for c in pages.columns if c != html], "text string, n_chars long", make, text=html)
