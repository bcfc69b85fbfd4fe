"""Main-text extraction by minimum-cut labelling.

A page becomes blocks of text, each with its open elements.  A linear classifier over element
names, class and id words, link share, length and punctuation gives every block a cost of being
labelled content or boilerplate; these are the capacities to the two terminals.  Neighbouring
blocks, and successive blocks of one parent element, are joined by smoothness edges that are weaker
the further apart the blocks are in the tree and weakest across the border of a page part such as
navigation.  The minimum cut labels all blocks at once.  Nodes whose terminal capacity exceeds all
their edges are settled first (no cut can move them), so the flow runs on what is left.

Text: character references decoded, white space inside a block made one space, blocks joined in
page order by an empty line; nothing else is dropped or shortened.  Null or empty html, pages
without text and pages that are all boilerplate give an empty text.  Markup is read leniently:
unclosed and stray tags, quotes and comments never raise.  Repeated rows and rows with null ids are
extracted once each, by their own html; a tie of the cut goes to content.  Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque
from math import tanh

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
# HTML element names by role, and class/id words by what they tell.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "title", "select"}
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PARTS = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -6.0, "head": -9.0, "menu": -6.0, "dialog": -7.0, "button": -6.0, "fieldset": -5.0}
BAD = set("ad ads adbox adslot adsense advert advertisement advertising adverts adsbygoogle alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation navbar newsletter notice notification outbrain pagination paging pager popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets".split())
GOOD = set("article articlebody body content entry main maincontent post postbody story text".split())
ROLES = {"navigation": -7.0, "banner": -6.0, "contentinfo": -7.0, "complementary": -7.0, "search": -7.0, "alert": -6.0, "dialog": -7.0, "form": -6.0, "main": 3.0, "article": 3.0}
SURE = 2.0  #: largest terminal capacity
_CLOSES_P = BLOCK - {"body", "html", "head"}


class _Element:
    __slots__ = ("bad", "good", "number", "part", "tag", "up")

    def __init__(self, number: int, tag: str, up: _Element | None, attrs: str):
        self.number, self.tag, self.up = number, tag, up
        bad, good = PARTS.get(tag, 0.0), 0.0
        inside = up.good if up else 0.0
        if tag in ("article", "main"):
            good = 4.0
        elif tag == "header":
            bad = 0.0 if inside >= 2.0 else -6.0
        if attrs:
            for name, *values in _ATTRIBUTE.findall(attrs):
                name, value = name.lower(), next((v for v in values if v), "").lower()
                if name == "role":
                    bad, good = min(bad, ROLES.get(value, 0.0)), max(good, ROLES.get(value, 0.0))
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    bad = -8.0
                elif name in ("class", "id") and tag not in ("html", "body"):
                    words = set(_SPLIT.split(value))
                    if words & BAD or value in ("header", "site-header", "page-header", "top-header"):
                        bad = min(bad, -6.0)
                    elif words & GOOD:
                        good = max(good, 2.0)
        self.bad = min(bad, up.bad if up else 0.0)
        self.good = max(good, inside)
        self.part = number if bad < 0 else (up.part if up else 0)


class Block:
    __slots__ = ("element", "link", "path", "text")

    def __init__(self, text: str, element: _Element, link: float):
        self.text, self.element, self.link = text, element, link


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    top = at = _Element(0, "", None, "")
    made, count, out = 0, 0, []
    pieces: list[str] = []
    in_link, linked, plain = 0, 0, 0

    def flush():
        nonlocal linked, plain, in_link
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, at, linked / max(1, plain)))
        pieces.clear()
        linked = plain = 0

    end, size = 0, len(page)
    while end < size:
        match = _TOKEN.match(page, end)
        start, end = end, match.end()
        slash, tag, attrs = match.group(1, 2, 3)
        if tag is None:
            slash, tag, attrs = match.group(4, 5, 6)
        if tag is None:
            raw = match.group()
            if raw[0] != "<" or raw == "<":
                text = html_lib.unescape(raw) if "&" in raw else raw
                pieces.append(text)
                n = len(text.strip())
                plain += n
                linked += n if in_link else 0
            continue
        tag = tag.lower()
        if not slash and tag in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, end)
            end = close.end() if close else size
            if tag in ("script", "style", "template", "title"):
                continue
            pieces.append(" ")
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = 0 if slash else 1
        elif tag in BLOCK or tag in PARTS:
            flush()
            in_link = 0
            if slash:
                up = at
                while up is not top and up.tag != tag:
                    up = up.up
                if up is not top:
                    at = up.up
            else:
                if tag in _CLOSES_P and at.tag == "p":
                    at = at.up
                if tag in ("li", "dd", "dt", "td", "th", "tr", "option") and at.tag == tag:
                    at = at.up
                if tag in ("body", "main", "article") and at.bad <= -9.0:  # a head that was never closed
                    at = top
                made += 1
                if tag not in VOID and not attrs.endswith("/"):
                    at = _Element(made, tag, at, attrs)
    flush()
    return out


def weight(block: Block) -> float:
    """Terminal capacity of a block: above 0 to content, below 0 to boilerplate, at most ``SURE``.

    The bound is on the scale of the smoothness edges, so blocks with little evidence of their own
    follow their neighbours, and even a sure one can be outvoted inside one page part.
    """
    return SURE * tanh(evidence(block) / SURE)


def evidence(block: Block) -> float:
    """The linear classifier: above 0 for content."""
    text, own = block.text, block.element
    words = text.count(" ") + 1
    score = -0.6 + own.good + own.bad
    score += min(words, 40) * 0.05 - 4.0 * block.link * (1.0 if words < 60 else 0.5)
    if own.tag in ("p", "blockquote", "pre", "figcaption"):
        score += 1.0
    elif own.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 0.8
    if text[-1] in ".!?…。\"”":
        score += 0.5
    return score


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        parent = block.element.up
        key = parent.number if parent else -1
        if i:
            other = found[i - 1].element
            if other.part != block.element.part:
                w = 0.1
            elif other.up is parent or other is block.element:
                w = 1.0
            elif (other.up and other.up.up is parent) or (parent and parent.up is other.up):
                w = 0.6
            else:
                w = 0.3
            out.append((i - 1, i, w))
        if key in last and last[key] < i - 1 and found[last[key]].element.part == block.element.part:
            out.append((last[key], i, 0.5))
        last[key] = i
    return out


def labels(costs: list[float], joins: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: True for the content side.  Ties go to content."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in joins:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    cost, side = list(costs), [None] * n
    open_ = deque(range(n))
    while open_:
        i = open_.popleft()
        if side[i] is None and abs(cost[i]) >= sum(near[i].values()):
            side[i] = cost[i] >= 0
            for j, w in near[i].items():
                del near[j][i]
                cost[j] += w if side[i] else -w
                open_.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, content in _cut(left, cost, near).items():
            side[i] = content
    return side


def _cut(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Max-flow by shortest augmenting paths in level graphs; content is what cannot reach the sink."""
    source, sink = -1, -2
    rest: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        rest[i] = dict(near[i])
    for i in nodes:
        if cost[i] >= 0:
            rest[source][i], rest[i][source] = cost[i], 0.0
        else:
            rest[i][sink], rest[sink][i] = -cost[i], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in rest[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            break
        turn = {i: iter(list(rest[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(rest[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    rest[a][b] -= flow
                    rest[b][a] += flow
                at = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if rest[a][b] <= 1e-12)
                del path[at + 1 :]
                turn[path[-1]] = iter(list(rest[path[-1]]))
                continue
            for j in turn[i]:
                if rest[i][j] > 1e-12 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level[i] = -1
    reach, queue = {sink}, deque([sink])
    while queue:
        i = queue.popleft()
        for j in rest[i]:
            if j not in reach and rest[j].get(i, 0.0) > 1e-12:
                reach.add(j)
                queue.append(j)
    return {i: i not in reach for i in nodes}


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = labels([weight(b) for b in found], edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
