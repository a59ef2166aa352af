"""Main text of web pages by consensus paths of their hosts.

Each page is read into blocks of text with the generalised path of their container (tags and classes, digits as #).
A page votes for the container that holds most of its running text, widened to the article around it; Spark counts the votes per host, and every page is
read again with its host's winning path. A page without a block below that path uses the container it voted for.
Votes are counted with map-side combining, one row per host and path; the join with the winners carries the pages, and
Spark broadcasts the winners as long as they are small and splits a hot host if not.

Defined cases: null and empty html, and an empty table, give empty results; a very long or deeply nested page takes time and
memory in proportion to its length; a null url has the empty host; repeated pages stay repeated;
ties between paths go to the one that sorts first; extra columns stay, result columns replace columns of that name.
"""
from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsieve.session import materialize

from .common import schema

_QUOTED = r"""([^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+)"""
_RAW = "script|style|noscript|template|iframe|textarea|select|title"
# markup whose tag holds no other "<" is read here, so an attempt ends at the next one; the rest is left to ``Tags``
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
      |<({_RAW})\b{_QUOTED}>.*?(?:</\1\s*>|\Z)
      |<(/?)([a-zA-Z][^\s/<>]*+){_QUOTED}>
      |<(?P<hard>[a-zA-Z!?/])""", re.S | re.I | re.X)
_RAW_START = re.compile(rf"<({_RAW})\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split("|")}
_NAME = re.compile(r"<(/?)(?=[a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]|\Z")
_EVENT = re.compile(r"""[>"']""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_LONG_NUMBER = re.compile(r"&#[1-9][0-9]{7,}")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu".split())
BOILERPLATE_NAMES = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|cookies?|consent|notices?|comments?|replies|disqus|menu|nav\w*|"
    r"breadcrumbs?|footer|header|masthead|share|sharing|social|related|newsletter|subscribe|popup|modal|toolbar|"
    r"pagination|pager|login|signup", re.I)
# what a class or id may add to these names and still name boilerplate
PLACES = frozenset("site page main global primary secondary top bottom left right upper lower sticky fixed mobile desktop "
                   "bar box wrap wrapper container inner outer widget block list area section links buttons icons form "
                   "items item panel posts articles content signup overlay message text policy".split())
MODIFIERS = frozenset("has no with without is not show hide hides".split())
# names of what stands beside the main text even if it is longer
BESIDE = re.compile(r"comments?|replies|disqus|related|cookies?|consent|ads?|advert\w*|sponsor\w*|nav\w*|menu|footer", re.I)
HEAD_TAGS = frozenset("head title meta link script style base noscript template".split())
_SVG_END = re.compile(
    r"</svg\s*>|<foreignobject\b|(?=</?(?:article|aside|blockquote|body|center|code|dd|div|dl|dt|em|footer|form|h[1-6]|header|"
    r"hr|img|li|main|nav|ol|p|pre|section|small|span|strong|table|td|th|tr|ul)\b)", re.I)
_SVG_CLOSE = re.compile(r"</svg\s*>", re.I)
BONUS = {"article": 1.5, "main": 1.3}
FRAME_TAGS = frozenset("nav footer aside header".split())
FRAME_NAMES = re.compile(r"nav\w*|menu|breadcrumbs?|footer|header|masthead|side-?bar|banner|toolbar", re.I)


def boilerplate_names(value: str) -> list[str]:
    """The boilerplate words of a class or id whose words are such and places only, from each token of it."""
    out: list[str] = []
    for token in value.split():
        parts = [p for p in re.split(r"[-_]+|\d+|(?<=[a-z])(?=[A-Z])", token.replace("side-bar", "sidebar")) if p]
        named = [p for p in parts if BOILERPLATE_NAMES.fullmatch(p)]
        if named and not MODIFIERS & {p.lower() for p in parts} and all(
                p in named or p.lower() in PLACES for p in parts):
            out += named
    return out


def after_svg(page: str, at: int) -> int:
    """Where the drawing whose start tag ends at ``at`` ends: its end tag, or a tag that cannot be inside. -1 if none."""
    m = _SVG_END.search(page, at)
    if m and m.group().lower() == "<foreignobject":
        m = _SVG_CLOSE.search(page, m.end())
    return m.end() if m else -1


class Tags:
    """The markup of a page, in time linear in its length: what an unclosed tag or quote has ruled out is remembered."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.events: list[int] | None = None  # places of > and quotes
        self.dead: set[int] = set()           # quotes, met outside of quotes, after which no tag ends
        self.name_end = (1, 0)                # a place, and the first end of a name from there on

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, slash of an end tag, name, attributes) of the first markup from ``at`` on. What is not a tag, or
        is raw text with both its tags, has no name."""
        while m := _TOKEN.search(self.page, at):
            if not m["hard"]:
                return m.start(), m.end(), m.group(3) or "", m.group(4), m.group(5) or ""
            if found := self.hard(m.start()):
                return found
            at = m.start() + 1
        return None

    def hard(self, start: int) -> tuple[int, int, str, str | None, str] | None:
        """Markup with a "<" inside, or none."""
        page = self.page
        if start > self.last:
            return None
        if (raw := _RAW_START.match(page, start)) and (end := self.tag_end(raw.end())) >= 0:
            close = _RAW_END[raw.group(1).lower()].search(page, end)
            return start, close.end() if close else len(page), "", None, ""
        if m := _NAME.match(page, start):
            if not self.name_end[0] <= m.end() <= self.name_end[1]:
                self.name_end = m.end(), _NAME_END.search(page, m.end()).start()
            name_end = self.name_end[1]
            if (end := self.tag_end(name_end)) >= 0:
                return start, end, m.group(1), page[m.end():name_end], page[name_end:end - 1]
        if page[start + 1] in "!?/" and (end := page.find(">", start + 2)) >= 0:
            return start, end + 1, "", None, ""
        return None

    def tag_end(self, at: int) -> int:
        """The place after the first > outside of quotes, -1 if there is none."""
        if self.events is None:
            self.events = [m.start() for m in _EVENT.finditer(self.page)]
        met = []
        while (k := bisect_left(self.events, at)) < len(self.events) and (event := self.events[k]) not in self.dead:
            if (char := self.page[event]) == ">":
                return event + 1
            met.append(event)
            if (quote := self.page.find(char, event + 1)) < 0:
                break
            at = quote + 1
        self.dead.update(met)
        return -1


@dataclass
class Page:
    """Blocks of text in a tree of containers; equal paths are one container, and a parent comes before its children."""

    labels: list[str] = field(default_factory=lambda: [""])  # of containers; the first is the page itself
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str, float]] = field(default_factory=list)  # container, text, weight
    frames: set[int] = field(default_factory=set)  # containers in which navigation, headers, footers and side bars stand
    children: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, parent: int, label: str) -> int:
        node = self.children.get((parent, label))
        if node is None:
            node = self.children[parent, label] = len(self.labels)
            self.labels.append(label)
            self.parents.append(parent)
        return node

    def line(self, node: int) -> list[int]:
        """The containers from below the page down to ``node``."""
        out = []
        while node:
            out.append(node)
            node = self.parents[node]
        return out[::-1]

    def name(self, node: int) -> str:
        return ">".join(self.labels[k] for k in self.line(node))

    def find(self, name: str) -> int | None:
        node: int | None = 0
        for label in name.split(">") if name else ():
            if (node := self.children.get((node, label))) is None:
                return None
        return node

    def text(self, top: int) -> list[str]:
        """Texts of the blocks below a container."""
        inside = [k == top for k in range(len(self.labels))]
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parents[k]]
        return [text for node, text, _ in self.blocks if inside[node]]


def below(parents: list[int], values: list) -> list:
    """Sums over each element and all below it; parents come first, -1 stands for none."""
    out = list(values)
    for k in range(len(out) - 1, -1, -1):
        if parents[k] >= 0:
            out[parents[k]] += out[k]
    return out


def read_blocks(page: str) -> Page:
    """The page without its frames."""
    return replace(read_page(page), frames=set())


def plain(text: str) -> str:
    """Character references decoded, white space as single spaces; numbers beyond all code points are cut short."""
    if "&#" in text:
        text = _LONG_NUMBER.sub("&#9999999", _ZEROS.sub("&#", text))
    return _SPACE.sub(" ", entities.unescape(text)).strip()


class _Stack:
    """Open elements as (tag, container, boilerplate number or -1), with the places of each tag."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.solid: list[int] = []  # places of elements that are not inline
        self.around = [-1]          # innermost open boilerplate element, last

    def push(self, tag: str, node: int, skipped: int = -1) -> None:
        self.places[tag].append(len(self.items))
        if tag not in INLINE:
            self.solid.append(len(self.items))
        if skipped >= 0:
            self.around.append(skipped)
        self.items.append((tag, node, skipped))

    def pop_to(self, depth: int) -> None:
        while len(self.items) > depth:
            tag, _, skipped = self.items.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.solid.pop()
            if skipped >= 0:
                self.around.pop()

    @property
    def node(self) -> int:
        return self.items[-1][1] if self.items else 0

    def open(self, tag: str) -> bool:
        return bool(self.places.get(tag))


def read_page(source: str) -> Page:
    """Blocks of text in page order, without boilerplate. A weight is the length of the text less twice that of its links.

    An element that is named like boilerplate is kept if it holds the page's only article or main, or most of its
    running text; what by its name stands beside the main text only if it holds both. Time and memory follow the length
    of the page, however deep its elements lie in each other.
    """
    page, stack, tags = Page(), _Stack(), Tags(source)
    parts: list[str] = []
    links = 0
    around: list[int] = []     # of each block: its innermost boilerplate element, -1 for none
    outer: list[int] = []      # of each boilerplate element: the one around it
    beside: list[bool] = []    # of each boilerplate element
    holders: list[int] = []    # of each article or main: the boilerplate element around it

    def flush() -> None:
        nonlocal links
        if parts:
            if text := plain("".join(parts)):
                page.blocks.append((stack.node, text, len(text) - 2.0 * links))
                around.append(stack.around[-1])
            parts.clear()
            links = 0

    def add(text: str) -> None:
        nonlocal links
        if stack.open("head") and not text.isspace():
            leave_head()
        parts.append(text)
        if stack.open("a"):
            links += len(text.strip())

    def leave_head() -> None:
        parts.clear()
        stack.pop_to(stack.places["head"][0])

    at = 0
    while found := tags.next(at):
        start, end, slash, tag, attributes = found
        if start > at:
            add(source[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if stack.open("head") and not slash and tag not in HEAD_TAGS:
            leave_head()  # its end tag may be left out
        if tag == "svg":
            if not slash and not attributes.endswith("/"):
                end = after_svg(source, at)
                at = end if end >= 0 else len(source)
            continue
        if slash:
            if tag not in INLINE:
                flush()
            if stack.open(tag):
                depth = stack.places[tag][-1]
                # an end tag of inline markup does not close the blocks around it
                if tag not in INLINE or not stack.solid or stack.solid[-1] < depth:
                    stack.pop_to(depth)
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag not in VOID:
                stack.push(tag, stack.node)
            continue
        flush()
        if tag in VOID:
            continue
        # a new block ends an open text block and inline markup left open in it
        depth = len(stack.items)
        while depth and (last := stack.items[depth - 1][0]) and (last in INLINE or last in TEXT_BLOCKS and (
                last in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or last == tag)):
            depth -= 1
        stack.pop_to(depth)
        names = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if attributes else {}
        role = names.get("role", "").lower()
        named = [] if tag in ("html", "body", "article", "main") else [
            n for k in ("class", "id") for n in boilerplate_names(names.get(k, ""))]
        skipped = (tag in BOILERPLATE_TAGS or tag == "header" and not any(map(stack.open, BONUS))
                   or role in ("navigation", "banner", "complementary", "contentinfo") or bool(named))
        if skipped and (tag in FRAME_TAGS or role or any(FRAME_NAMES.fullmatch(n) for n in named)):
            page.frames.add(stack.node)
        if tag in BONUS:
            holders.append(stack.around[-1])
        node = stack.node
        if tag not in TEXT_BLOCKS and tag not in ("html", "body"):  # the latter two may be left out in a page
            classes = ".".join(sorted(set(re.sub(r"\d+", "#", names.get("class", "").lower().replace(">", "")).split())))
            node = page.child(node, f"{tag}.{classes}" if classes else tag)
        if skipped:
            outer.append(stack.around[-1])
            beside.append(tag in BOILERPLATE_TAGS and tag != "form" or role in ("navigation", "complementary", "contentinfo")
                          or any(BESIDE.fullmatch(n) for n in named))
        stack.push(tag, node, len(outer) - 1 if skipped else -1)
    if at < len(source):
        add(source[at:])
    flush()
    if outer:
        out = inside_boilerplate([(k, weight) for k, (_, _, weight) in zip(around, page.blocks)], outer, beside, holders)
        page.blocks = [block for k, block in zip(around, page.blocks) if k < 0 or not out[k]]
    return page


def inside_boilerplate(blocks: list[tuple[int, float]], outer: list[int], beside: list[bool],
                       holders: list[int]) -> list[bool]:
    """Which boilerplate elements go, or lie in one that goes. ``blocks`` are (innermost element, weight)."""
    # the running text of each element, apart from what stands beside the main text within it
    aside: list[bool] = []
    for k, up in enumerate(outer):
        aside.append(beside[k] or up >= 0 and aside[up])
    running, held = [0.0] * len(outer), [0] * len(outer)
    total = whole = 0.0
    for k, weight in blocks:
        weight = max(0.0, weight)
        whole += weight
        if k >= 0:
            running[k] += weight
        if k < 0 or not aside[k]:
            total += weight
    for k in range(len(outer) - 1, -1, -1):
        if outer[k] >= 0 and not beside[k]:
            running[outer[k]] += running[k]
    for k in holders:
        if k >= 0:
            held[k] += 1
    held = below(outer, held)
    gone: list[bool] = []
    for k, up in enumerate(outer):
        every = bool(holders) and held[k] == len(holders)
        kept = every and 2 * running[k] > whole if beside[k] else every or not holders and 2 * running[k] > total
        gone.append(not kept or up >= 0 and gone[up])
    return gone


def best_node(page: Page) -> tuple[int, float]:
    """The container with most running text and its score; of equals the deeper one, then the one that sorts first."""
    n = len(page.labels)
    weights, blocks = [0.0] * n, [0] * n
    for node, _, weight in page.blocks:
        weights[node] += weight
        blocks[node] += 1
    weights, blocks = below(page.parents, weights), below(page.parents, blocks)
    depth, within = [0] * n, [frozenset()] * n  # which of the tags with a bonus are around
    for k in range(1, n):
        up = page.parents[k]
        tag = page.labels[k].split(".")[0]
        depth[k], within[k] = depth[up] + 1, within[up] | {tag} if tag in BONUS else within[up]

    def score(node: int) -> float:
        value = weights[node]
        for tag, bonus in BONUS.items():
            if tag in within[node]:
                value *= bonus
        return value

    scores = [score(k) for k in range(n)]
    top = min((-scores[k], -depth[k]) for k in range(n) if blocks[k])
    equal = {k for k in range(n) if blocks[k] and (-scores[k], -depth[k]) == top}
    return min(equal) if len(equal) == 1 else first_sorted(page, equal), max(0.0, -top[0])


def first_sorted(page: Page, nodes: set[int]) -> int:
    """Of containers equally deep the one whose path sorts first, level by level up to the one above all."""
    chain = [nodes]
    while len(chain[-1]) > 1:
        chain.append({page.parents[k] for k in chain[-1]})
    at = next(iter(chain[-1]))
    for level in reversed(chain[:-1]):
        at = min((k for k in level if page.parents[k] == at), key=page.labels.__getitem__)
    return at


def best_container(page: Page) -> tuple[str, float]:
    """Path and score of the container with most running text, widened to the whole main text around it."""
    if not page.blocks:
        return "", 0.0
    best, value = best_node(page)
    return page.name(widened(page, best)), value


def widened(page: Page, best: int) -> int:
    """The article around a container, else the main, else the highest container that holds no navigation, header,
    footer or side bar outside it: lists of links count against a container, but belong to its text."""
    line = page.line(best)
    for tag in BONUS:
        for k in line:
            if page.labels[k].split(".")[0] == tag:
                return k
    frames = below(page.parents, [int(k in page.frames) for k in range(len(page.labels))])
    blocks = [0] * len(page.labels)
    for node, _, _ in page.blocks:
        blocks[node] += 1
    blocks = below(page.parents, blocks)
    top = best
    for k in reversed(line[:-1]):
        if frames[k] > frames[best]:
            break
        top = k
    if top:  # down again as long as no block is left out
        line = line[line.index(top):]
    return next((k for k in reversed(line) if blocks[k] == blocks[top]), top)


def main_text(page: Page, winner: str | None) -> tuple[str, str]:
    """Text of the blocks below the winning path, or below the page's own best container; and the path used."""
    if winner is not None and (node := page.find(winner)) is not None and (found := page.text(node)):
        return "\n".join(found), winner
    if not page.blocks:
        return "", ""
    node = widened(page, best_node(page)[0])
    return "\n".join(page.text(node)), page.name(node)


@F.pandas_udf(schema(path=T.StringType(), score=T.DoubleType()))
def _vote(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_container(read_page(p)) if p else ("", 0.0) for p in pages], columns=["path", "score"])


@F.pandas_udf(schema(text=T.StringType(), path=T.StringType()))
def _extract(pages: pd.Series, winners: pd.Series) -> pd.DataFrame:
    rows = []
    for page, winner in zip(pages, winners):
        rows.append(main_text(read_page(page) if page else Page(), winner))
    return pd.DataFrame(rows, columns=["text", "path"])


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning container path of each host, with its votes."""
    votes = (pages.select(host(url_col).alias("host"), _vote(F.col(html_col)).alias("v"))
             .groupBy("host", F.col("v.path").alias("path"))
             .agg(F.count("*").alias("votes"), F.sum(F.round("v.score").cast("long")).alias("score"))
             .filter(F.col("score") > 0))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return votes.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).drop("_r")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``path`` to every page."""
    winners = materialize(host_paths(pages, url_col, html_col).select(
        F.col("host").alias("_host"), F.col("path").alias("_winner")), "host-paths")
    joined = pages.drop("text", "path").join(winners, host(url_col) == F.col("_host"), "left")
    return (joined.withColumn("_x", _extract.asNondeterministic()(F.col(html_col), F.col("_winner")))
            .select("*", "_x.*").drop("_x", "_host", "_winner"))
