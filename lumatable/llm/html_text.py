"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?](?:\[CDATA\[.*?(?:\]\]>|\Z)|[^>]*+(?:>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe noembed noframes xmp svg annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead title tr ul".split()
)
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li td th dd dt figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of these ends an open element of the listed kinds, unless a boundary lies between.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
    "body": frozenset(["head"]),
}
BOUNDARY = frozenset("table ul ol dl select html body article section main div nav aside footer header form".split())
CLOSE_P = BLOCKS - frozenset("html head body title caption legend summary td th tr tbody thead tfoot dd dt li".split()) | frozenset(
    "li dt dd".split()
)

# Furniture by tag, by role, and by the words of class and id.
DROP_TAGS = frozenset(
    "nav footer aside menu dialog head button select option datalist object canvas audio video".split()
) | RAW
# These too, unless they hold the page's prose, as where a server puts the whole page into a form.
MARKED_TAGS = frozenset("form fieldset".split())
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog note tablist".split()
)
DROP_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail footer header masthead banner topbar ad ads advert adverts"
    " advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup"
    " modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations"
    " pagination pager widget widgets toolbar tags copyright disclaimer paywall teaser skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
KEEP_WORDS = frozenset("article main content body post story entry text page".split())
NEVER_DROPPED = frozenset("html body article main".split())
# Class tokens that say nothing of the element itself, and words of elements that only lay out others.
MODIFIER = re.compile(r"(?:has|with|without|no|is|not)[-_]", re.I)
LAYOUT_WORDS = frozenset("wrap wrapper container layout row col column columns grid outer inner".split())
# A marked element stays if its text outside links is more than so many times what else is kept.
FURNITURE, COMMENTS, LAYOUT = 1.0, 8.0, 0.25
LEAST = 80  # characters of prose of a marked element that is no layout
FADE = (1, 2, 6, 9, 12)  # what points are divided by at the next ancestors, and from there on:
FURTHER = 0.8


def _dropped(tag: str, attributes: str, in_article: bool) -> bool | float:
    """True if the element is no part of the text; a factor above 0 if its class words only suggest so."""
    if tag in DROP_TAGS:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes:
        return FURNITURE if tag in MARKED_TAGS else False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True
    if tag in NEVER_DROPPED:
        words = set()
    else:
        names = f"{values.get('class', '')} {values.get('id', '')}".split()
        words = {w.lower() for name in names if not MODIFIER.match(name) for w in WORDS.findall(name)}
    if values.get("role", "").lower() in DROP_ROLES and tag not in NEVER_DROPPED:
        return True
    if words & COMMENT_WORDS:
        return COMMENTS
    if words & DROP_WORDS and not words & KEEP_WORDS:
        return LAYOUT if words & LAYOUT_WORDS else FURNITURE
    return FURNITURE if tag in MARKED_TAGS else False


class Page:
    """The element tree in page order, and the text blocks with the element that holds each."""

    def __init__(self, html: str):
        self.tags, self.parents, self.gone = ["#"], [0], [False]
        self.marked: dict[int, float] = {}  # elements whose class words suggest furniture
        self.blocks: list[list] = []  # [element, text pieces, link characters]
        self.last = -1  # number of the block that text now goes to, or -1
        self.stack = [0]
        # Places on the stack: by tag, of boundaries, and of blocks. What is open is found without a walk.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.bounds, self.holders = [], [0]
        at = 0
        while True:
            m = MARKUP.search(html, at)
            piece = html[at : m.start() if m else len(html)]
            if piece and not self.gone[self.stack[-1]]:
                self._text(piece, bool(self.places["a"]))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if self.places[tag]:
                    self._close(self.places[tag][-1], ended=True)
                elif tag in BLOCKS:
                    self.last = -1
                continue
            if tag in BLOCKS:
                self.last = -1
            if tag in CLOSE_P or tag in ENDS:
                ends = ENDS.get(tag, frozenset()) | (frozenset(["p"]) if tag in CLOSE_P else frozenset())
                place = max((self.places[name][-1] for name in ends if self.places[name]), default=-1)
                if place > (self.bounds[-1] if self.bounds else 0):
                    self._close(place)
            if tag in VOID:
                if tag == "br" and not self.gone[self.stack[-1]]:
                    self._text(" ", False)
                continue
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(self.stack[-1])
            verdict = _dropped(tag, m[3], bool(self.places["article"]))
            if verdict and verdict is not True and not self.gone[self.stack[-1]]:
                self.marked[node] = verdict
            self.gone.append(self.gone[self.stack[-1]] or verdict is True)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if m[3].rstrip().endswith("/") and tag not in BLOCKS and tag != "a":
                continue
            self._open(node, tag)

    def _open(self, node: int, tag: str) -> None:
        place = len(self.stack)
        self.stack.append(node)
        self.places[tag].append(place)
        if tag in BOUNDARY:
            self.bounds.append(place)
        if tag in BLOCKS:
            self.holders.append(place)

    def _close(self, place: int, ended: bool = False) -> None:
        """Takes the element at a place and all inside it off the stack; an end tag also ends the text block."""
        while len(self.stack) > place:
            tag = self.tags[self.stack.pop()]
            self.places[tag].pop()
            if tag in BOUNDARY:
                self.bounds.pop()
            if tag in BLOCKS:
                self.holders.pop()
                if ended:
                    self.last = -1

    def _text(self, piece: str, linked: bool) -> None:
        if self.last < 0:
            if not piece.strip():
                return
            self.last = len(self.blocks)
            self.blocks.append([self.stack[self.holders[-1]], [], 0])
        block = self.blocks[self.last]
        block[1].append(piece)
        if linked:
            block[2] += len(piece.strip())

    def _drop_marked(self, letters: list[int], linked: list[int]) -> None:
        """Drops marked elements that are small, or mostly links, next to the other prose of the page.

        Elements of layout come first, and inner ones after those around them, so that what is kept is known.
        """
        n = len(self.tags)
        prose = [a - b for a, b in zip(letters, linked, strict=True)]
        around, depth, heads = [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            above = self.parents[k]
            around[k] = above if above in self.marked else around[above]
            depth[k] = depth[above] + (k in self.marked)
            holder = k if k in self.marked else around[k]
            if self.tags[k] in ("h1", "main") and not self.gone[k] or self.tags[k] == "article" and k not in self.marked:
                heads[holder] = holder > 0
        factor = {k: f / 4 if heads[k] else f for k, f in self.marked.items()}
        kept = prose[0] - sum(prose[k] for k in self.marked if not around[k])
        for k in sorted(self.marked, key=lambda k: (depth[k], factor[k], -prose[k], k)):
            outer = around[k]
            if outer and self.gone[outer]:
                self.gone[k] = True
                continue
            other = kept - prose[k] if outer else kept
            enough = prose[k] > 0 if heads[k] or factor[k] <= LAYOUT else prose[k] >= LEAST
            stays = enough and linked[k] <= letters[k] / 2 and prose[k] > factor[k] * other
            self.gone[k] = not stays
            kept += (prose[k] if stays else 0) - (prose[k] if outer else 0)
        for k in range(1, n):
            self.gone[k] = self.gone[k] or self.gone[self.parents[k]]

    def main_text(self) -> str:
        n = len(self.tags)
        points, letters, linked = [0.0] * n, [0] * n, [0] * n
        texts = [" ".join(unescape("".join(pieces)).split()) for _, pieces, _ in self.blocks]

        def count() -> None:
            letters[:], linked[:] = [0] * n, [0] * n
            for (element, _, links), text in zip(self.blocks, texts, strict=True):
                letters[element] += len(text)
                linked[element] += min(links, len(text))
            for node in range(n - 1, 0, -1):
                letters[self.parents[node]] += letters[node]
                linked[self.parents[node]] += linked[node]

        count()
        if self.marked:
            self._drop_marked(letters, linked)
            texts = ["" if self.gone[element] else text for (element, _, _), text in zip(self.blocks, texts, strict=True)]
            count()
        # Elements that hold the same text get the same points: the next ancestor with more is one level up.
        same, up = list(range(n)), list(range(n))
        for node in range(1, n):
            above = self.parents[node]
            same[node] = same[above] if letters[node] == letters[above] else node
            up[node] = same[above]
        far = [0.0] * n
        for (element, _, links), text in zip(self.blocks, texts, strict=True):
            if not text:
                continue
            worth = 1 + text.count(",") + min(len(text) / 100, 3)
            worth *= 1 - min(1.0, links / len(text))
            if self.tags[element] in HEADINGS:
                worth *= 0.5
            node = same[self.parents[element] if self.tags[element] in PARAGRAPHS else element]
            for fade in FADE:
                points[node] += worth / fade
                if not node:
                    break
                node = up[node]
            else:
                far[node] += worth / FADE[-1] * FURTHER
        for node in range(n - 1, -1, -1):
            points[node] += far[node]
            if node:
                far[up[node]] += far[node] * FURTHER
        points = [points[same[node]] for node in range(n)]
        scores = [p * (1 - linked[k] / letters[k]) if letters[k] and p else 0.0 for k, p in enumerate(points)]
        for k in range(n):
            if scores[k] and self.tags[k] in ("article", "main"):
                scores[k] = 1.25 * scores[k] + 2
        best = max(range(n), key=lambda k: (scores[k], -k))
        if not scores[best]:
            return ""
        up = best  # the article as a whole, when the best part lies in one
        while up and self.tags[up] not in ("article", "main"):
            up = self.parents[up]
        best = up or best
        bar = max(10.0, 0.2 * scores[best])
        chosen = {best}
        if best:
            for k in range(1, n):
                if self.parents[k] == self.parents[best] and k != best and letters[k]:
                    density = linked[k] / letters[k]
                    prose = self.tags[k] == "p" and (density < 0.25 and letters[k] > 80)
                    if not self.gone[k] and (scores[k] >= bar or prose):
                        chosen.add(k)
        kept = [False] * n
        for k in range(n):
            kept[k] = k in chosen or (k > 0 and kept[self.parents[k]])
        return "\n".join(t for (element, _, _), t in zip(self.blocks, texts, strict=True) if t and kept[element])


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(df: DataFrame) -> DataFrame:
    """Main text of every page and its length in code points.

    Blocks pass points for length and commas to their ancestors, less by their share of link text; the
    best container, or the article around it, and siblings of similar worth are kept, without menus, headers,
    footers, sidebars, notices, adverts, forms, scripts and comments. Null and empty pages, and pages of
    furniture only, have an empty text; broken markup is read as far as it goes; repeated rows are read each; an
    empty table gives no rows; other columns are ignored. One pass, no shuffle.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(page) for page in pages], dtype="object")

    return df.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
