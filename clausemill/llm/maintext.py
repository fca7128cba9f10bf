"""Main text of web pages by composite text density.

Every node of a page's tree has a density: characters for each tag, adjusted by
the share of link characters and link tags. The node whose children's densities
sum to the most is the core of the article; the smallest density on its way up
to the body is the threshold that everything beside that way must reach to
belong to it. Elements that never hold an article (menus, forms, scripts, page
footers) are out of the tree before densities are taken. What class names, ids
and roles say is weak evidence: the characters of a part that is called a
sidebar or a notice count as those of links, so that it isn't dense, unless the
page would then have hardly any text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title nav aside footer form button select textarea option iframe object svg canvas audio video map dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p li blockquote pre dd table figcaption".split()) | HEADINGS
LISTS = frozenset("div ul ol dl table section".split())
#: A start tag of the first kind ends open elements of the second.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
SCOPES = frozenset("table td th ul ol dl article section div body html main aside nav footer header form blockquote".split())
CELLS = frozenset(("td", "th"))
#: Words of class names, ids and roles: of what readers or advertisers wrote, of what is around an article, and such as say nothing of their own beside one of these.
FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored comment comments commentlist reply replies respond disqus cookie cookies consent gdpr".split())
AROUND = frozenset(
    "promo promotion notice notices alert newsletter subscribe subscription signup sidebar widget widgets related recommended share sharing social responses discussion menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar popup modal overlay search login contentinfo complementary skip".split()
)
PARTS = frozenset(
    "area bar block body bottom box button buttons card cards container content count feed form group header holder icons inner item items left link links list main meta module outer panel post posts "
    "primary right row section site slot stories thread title top unit wrap wrapper zone".split()
)
#: A tag or declaration begins.
CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
NOT_MARKS = frozenset(("with", "has", "no", "is", "without"))
#: Characters of a page that must be left unmarked for what only surrounds an article to be believed: this share of all that are in no link.
BELIEVED = 0.25


def mark_of(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2 if an element is called something that isn't the author's or is hidden, 1 if it is called something around an article, else 0.

    A name counts if it ends in such a word or if all its other words are plain
    parts (ad-slot, comment-list, but not search-results). The id of a
    paragraph or heading names a place in the text and says nothing.
    """
    found = 0
    for name, value in attrs:
        if name in ("class", "role") and value or name == "id" and value and tag not in PROSE:
            for word in value.lower().split():
                parts = [p for p in re.split(r"[-_:]+|\d+$", word) if p]
                if not parts or parts[0] in NOT_MARKS:
                    continue
                for words, mark in ((FOREIGN, 2), (AROUND, 1)):
                    if parts[-1] in words or parts[0] in words and all(p in PARTS or p in words for p in parts[1:]):
                        found = max(found, mark)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
            found = 2
    return found


class Tree(HTMLParser):
    """A page as lists by node, in page order: tag, parent, out (holds no article), mark, and the text pieces (node, text), with a space of no node (-1) where a block or line begins or ends; node 0 is the page.

    Each tag takes constant time, or as much as the elements that it ends: where
    the open elements of a name and the open scopes are on the way is kept in stacks.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.out, self.mark, self.text = ["#page"], [-1], [False], [0], []
        self.path = [0]
        self.places: dict[str, list[int]] = {}  # by name: places on the path
        self.scopes: list[int] = []
        self.tables: list[int] = []  # scopes but cells
        self.seen: set[str] = set()

    def cut(self, place: int) -> None:
        """Ends the element at a place on the path, and all within."""
        while len(self.path) > place:
            at, tag = len(self.path) - 1, self.tag[self.path.pop()]
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
                if self.tables and self.tables[-1] == at:
                    self.tables.pop()

    def place(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            if tag in self.seen:
                return
            self.seen.add(tag)
        ends = ENDS.get(tag) or (("p",) if tag in ENDS_P else ())
        if ends:
            scopes = self.tables if tag in ("tr", "td", "th") else self.scopes
            scope = scopes[-1] if scopes else 0
            within = [p for p in map(self.place, ends) if p > 0 and p >= scope]
            if within:
                self.cut(min(within))
        if tag not in INLINE:
            self.text.append((-1, " "))
        here = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.path[-1])
        in_article = self.places.get("article") or self.places.get("main")
        self.out.append(tag in DROPPED or tag == "header" and not in_article)
        self.mark.append(mark_of(tag, attrs) if attrs and tag not in ("html", "body", "main") else 0)
        if tag not in VOID:
            at = len(self.path)
            self.path.append(here)
            self.places.setdefault(tag, []).append(at)
            if tag in SCOPES:
                self.scopes.append(at)
                if tag not in CELLS:
                    self.tables.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        before = len(self.tag)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.tag) > before and tag not in ("html", "body"):
            self.cut(len(self.path) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = self.place(tag)
        if at <= 0 or tag in INLINE and self.scopes and self.scopes[-1] > at:
            return
        self.cut(at)
        if tag not in INLINE:
            self.text.append((-1, " "))

    def handle_data(self, data: str) -> None:
        self.text.append((self.path[-1], data))

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment without an end goes to the end of the page."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def read(self, html: str) -> None:
        """All of a page. A tag that the page's end cuts off is dropped."""
        last = html.rfind(">") + 1
        begun = CUT_OFF.search(html, last)
        self.feed(html[: begun.start()] if begun else html)
        self.close()


class Counts:
    """By node: characters, those in links, tags and link tags below it, without what is out; marked nodes count as links."""

    def __init__(self, page: Tree, marked: list[bool]) -> None:
        tag, parent, n = page.tag, page.parent, len(page.tag)
        out, link = list(page.out), [t == "a" for t in tag]
        for i in range(1, n):
            out[i] = out[i] or out[parent[i]]
            link[i] = link[i] or link[parent[i]] or marked[i]
        self.out, self.link = out, link
        self.chars, self.links, self.tags, self.link_tags, self.headed = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        self.prose = [t in PROSE for t in tag]
        for i, text in page.text:
            if i >= 0 and not out[i]:
                size = len(text) - text.count(" ") - text.count("\n")
                self.chars[i] += size
                self.links[i] += size * link[i]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if not out[i]:
                self.chars[p] += self.chars[i]
                self.links[p] += self.links[i]
                self.tags[p] += self.tags[i] + (tag[i] not in ("br", "wbr"))
                self.link_tags[p] += self.link_tags[i] + link[i]
                self.headed[p] += self.chars[i] if tag[i] in HEADINGS else self.headed[i]
                self.prose[p] = self.prose[p] or self.prose[i]

    def plain(self, i: int) -> int:
        return self.chars[i] - self.links[i]


def density(chars: int, links: int, tags: int, link_tags: int, body_links: float) -> float:
    """Characters for each tag, less the more of them and of the tags are links; body_links is the whole page's share of link characters."""
    if not chars:
        return 0.0
    plain, linked, tags, link_tags = max(1, chars - links), max(1, links), max(1, tags), max(1, link_tags)
    base = math.log(chars / plain * linked + body_links * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / linked * tags / link_tags)) / math.log(max(base, 1.000001)) if base > 1 else 0.0


def chosen_nodes(page: Tree, c: Counts, body: int) -> tuple[set[int], list[bool]]:
    """Nodes whose subtrees make up the article, and by node whether it is out of it all the same.

    The core is the node with the largest sum of its children's densities. From
    there the article grows upward while what a parent adds, headings aside, is
    nothing or as dense as the threshold; it also grows to an article or main
    element on the way. Beside the way to the body belongs what has prose and
    reaches the threshold, and a heading straight before what belongs.
    """
    tag, parent, n = page.tag, page.parent, len(page.tag)
    body_links = c.links[body] / c.chars[body]
    dense = [0.0 if c.out[i] else density(c.chars[i], c.links[i], c.tags[i], c.link_tags[i], body_links) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += dense[i]
    within = [False] * n
    within[body] = True
    for i in range(body + 1, n):
        within[i] = within[parent[i]] and not c.out[i]
    core = max((i for i in range(body, n) if within[i]), key=lambda i: (total[i], -i))
    if not total[core]:
        core = body
    way = [core]
    while way[-1] != body:
        way.append(parent[way[-1]])
    on_way, limit = set(way), min(dense[i] for i in way)
    root, semantic = core, False
    if tag[core] in INLINE or tag[core] in PROSE:
        root = parent[core] if core != body else body
    for p in way[1:]:
        if p <= root and (p != body or tag[root] in INLINE):
            rest = density(*(a - b for a, b in ((c.chars[p] - c.headed[p], c.chars[root] - c.headed[root]), (c.links[p], c.links[root]), (c.tags[p], c.tags[root]), (c.link_tags[p], c.link_tags[root]))), body_links)
            adds = c.chars[p] - c.headed[p] > c.chars[root] - c.headed[root]
            if tag[p] in ("article", "main") or root in on_way and (not adds or rest >= limit):
                root = p
    for p in way:
        semantic = semantic or tag[p] in ("article", "main") and p >= root
    chosen = {root}
    beside = [i for i in range(body + 1, n) if within[i] and parent[i] in on_way and i not in on_way and i > body]
    for i in beside:
        if dense[i] >= limit and c.prose[i] and c.chars[i] > 2 * c.links[i]:
            chosen.add(i)
    for i, following in zip(beside, beside[1:] + [n]):
        if tag[i] in HEADINGS and not c.link[i] and (following in chosen or i < root <= following or i < core <= following):
            chosen.add(i)
    out = list(c.out)
    for i in range(body + 1, n):
        # Beside the way, what is mostly links, or scraps of text in many tags, isn't as dense as the article.
        menu = not semantic and i not in on_way and tag[i] in LISTS and dense[i] < limit
        menu = menu and (2 * c.links[i] > c.chars[i] > 0 or parent[i] == root and root in on_way and c.tags[i] > 1 and not c.prose[i])
        out[i] = out[i] or out[parent[i]] or menu
    return chosen, out


def main_text(html: str | None) -> str:
    """The article of a page; empty for null, empty and textless pages."""
    if not html:
        return ""
    page = Tree()
    page.read(html)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    # What is called something else is that, unless it holds the title, a main element or all articles there are.
    titles, articles = [t in ("main", "h1") for t in tag], [int(t == "article") for t in tag]
    every = sum(articles)
    for i in range(n - 1, 0, -1):
        titles[parent[i]] |= titles[i]
        articles[parent[i]] += articles[i]
    other = [tag[i] == "article" or not titles[i] and (not articles[i] or articles[i] < every) for i in range(n)]
    firm = [page.mark[i] == 2 and other[i] for i in range(n)]
    weak = [page.mark[i] == 1 and other[i] for i in range(n)]
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    unmarked = Counts(page, firm)
    if not unmarked.chars[body]:
        body = 0
    if not unmarked.chars[body]:
        return ""
    counts = Counts(page, [a or b for a, b in zip(firm, weak)]) if any(weak) else unmarked
    if counts.plain(body) < BELIEVED * unmarked.plain(body):
        counts, weak = unmarked, [False] * n
    marked = [a or b for a, b in zip(firm, weak)]
    if any(marked) and not counts.plain(body):  # nothing else is there
        counts, marked = Counts(page, [False] * n), [False] * n
    chosen, out = chosen_nodes(page, counts, body)
    kept = [False] * n
    for i in range(n):
        out[i] = out[i] or marked[i] or i > 0 and out[parent[i]]
        kept[i] = not out[i] and (i in chosen or i > 0 and kept[parent[i]])
    return " ".join("".join(text for i, text in page.text if i < 0 or kept[i]).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every row of pages.

    Null, empty and textless pages have an empty text. Character references are
    decoded; white space inside a block becomes one space and blocks are joined
    by one, in page order. Repeated rows give repeated results; of equally dense
    nodes the first in page order is the core. A page of any length is read whole,
    in one task, in time and memory proportional to it. An empty table gives an
    empty result. Other columns aren't looked at.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
