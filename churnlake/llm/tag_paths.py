"""Main text of web pages by tag-path ratios.

A page is split into blocks, the runs of text between block-level tags. Text length, punctuation and link text are aggregated by
root-to-leaf tag path; length and punctuation per block are smoothed along the page, fused, and a path whose blocks reach a share of
the page's typical value is a content path. Blocks of elements that never hold main text (menus, footers, asides, forms, scripts, and
containers of which a whole token of class, id or role says so) take no part; headings, paragraphs and the like are never judged by
these. Inside an article or main element an id, and a class of several words, is only a hint: such blocks take part, and are dropped
if theirs is no content path. The content region is the deepest element that holds nearly all text of
the content paths, widened to the article it lies in and to headings before it; every block in it is kept but for lists of links.

Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line. Null, empty and textless
pages have empty text. Unclosed and stray tags are mended as browsers do in simple cases; an unfinished tag or comment at the
end is no text. Each page is worked on by itself, so repeated ids and rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from churnlake.llm.tables import read_table
from churnlake.llm.text_arrays import slices

# Names of HTML elements by kind, and words in class, id and role that mark what is no main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math select object audio video canvas".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr
    ul""".split())
NEVER = set("nav footer aside form dialog menu search head button fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
MARKED = set("""ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies
    discussion disqus foot footer form gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager
    pagination popup promo promoted promotion recommended related replies reply share sharing side sidebar signup social sponsor
    sponsored subscribe subscription toolbar widget""".split())
MARKED_OUTSIDE = set("header masthead topbar".split())      # inside an article they hold its title
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = set("ul ol dl table article section main div body".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
#: Words beside marked ones that say where or how large an element is.
NEUTRAL = set("""area bar block bottom box center container content footer header inner item items left list main outer page panel post posts
    region right section site top wrap wrapper""".split())
#: Elements that class, id and role may mark; the others are headings, paragraphs, tables, quotes and inline text.
CONTAINERS = set("center dd details div dl dt figure header hgroup li ol section span ul".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

CONTENT_SHARE = 0.3         # of the typical fused value, for a content path
REGION_SHARE = 0.75         # of the content paths' text, for the region
MOST_LINKED = 0.5           # share of link text, above it a block of no content path is a list of links


class Block(NamedTuple):
    nodes: tuple[int, ...]      # element numbers from the root
    path: tuple[str, ...]
    text: str
    linked: int                 # characters in links
    doubtful: bool              # in an element that may hold no main text


def _marked(element: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the element certainly, and whether it perhaps holds no main text."""
    perhaps = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, True
        if name not in ("class", "id", "role") or element not in CONTAINERS:
            continue
        for token in value.split():
            words = [w.lower() for w in WORD.findall(token)]
            marks = MARKED if inside else MARKED | MARKED_OUTSIDE
            if marks.isdisjoint(words) or not all(w in marks or w in NEUTRAL for w in words):
                continue
            if not inside or name != "id" and len(words) == 1:
                return True, True
            perhaps = True
    return False, perhaps


def blocks(page: str) -> Iterator[Block]:
    """The page's blocks outside of elements that never hold main text."""
    names, nodes, alive, doubts = [], [], [], []        # open elements, their numbers, whether they may hold main text, and may not
    parts, linked, count, links, at = [], 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        n, linked = linked, 0
        if text:
            path = [(i, x) for i, x in zip(nodes, names) if x in BLOCKS]
            yield Block(tuple(i for i, _ in path), tuple(x for _, x in path), text, n, any(doubts))

    def add(raw: str):
        nonlocal linked
        if raw and (not alive or alive[-1]):
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    def close(k: int):
        nonlocal links
        links -= sum(x == "a" for x in names[k:])
        del names[k:], nodes[k:], alive[k:], doubts[k:]

    size = len(page)
    while at < size:
        found = TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        ending, name, attributes = found.group(1), found.group(2), found.group(3)
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not ending and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCKS
        if block:
            yield from flush()
        if ending:
            for k in range(len(names) - 1, -1, -1):
                if names[k] == name:
                    close(k)
                    break
                if not block and names[k] in BLOCKS:
                    break       # an inline end tag doesn't close blocks
            continue
        if block and "p" in names:      # a block ends an open paragraph
            k = len(names) - 1 - names[::-1].index("p")
            if not any(x in FENCES or x == "li" or x == "td" for x in names[k + 1:]):
                close(k)
        for k in range(len(names) - 1, -1, -1):
            if names[k] in FENCES:
                break
            if names[k] in CLOSES.get(name, ()):
                close(k)
        if name in VOID:
            continue
        inside = "article" in names or "main" in names
        whole = name in ("html", "body", "article", "main")
        marked, doubtful = _marked(name, attributes, inside) if attributes and not whole else (False, False)
        live = (not alive or alive[-1]) and name not in NEVER and not (name == "header" and not inside) and not marked
        count += 1
        names.append(name)
        nodes.append(count)
        alive.append(live)
        doubts.append(doubtful)
        links += name == "a"
    yield from flush()


def _fused(found: list[Block]) -> np.ndarray:
    """The fused, smoothed ratio of every block's path."""
    paths = {path: i for i, path in enumerate(dict.fromkeys(b.path for b in found))}
    of = np.array([paths[b.path] for b in found])
    length = np.array([len(b.text) for b in found], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in found], float)
    linked = np.array([min(b.linked, len(b.text)) for b in found], float)
    n = np.bincount(of)
    by_length, by_marks = np.bincount(of, length) / n, np.bincount(of, marks) / n
    free = 1 - np.bincount(of, linked) / np.bincount(of, length)
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)

    def smooth(x):
        # the block's own path counts most, its neighbours lift paths that stand among long text
        return np.convolve(x, kernel, "same") / np.convolve(np.ones(len(x)), kernel, "same") if len(x) >= 5 else x

    return smooth(by_length[of]) * (1 + smooth(by_marks[of])) * free[of]


def main_text(page: str | None) -> str:
    """The page's main text; empty if it has none."""
    found = list(blocks(page or ""))
    if not found:
        return ""
    value = _fused(found)
    length = np.array([len(b.text) for b in found], float)
    level = (value * length).sum() / length.sum()
    paths: dict[tuple, list[float]] = {}
    for b, v in zip(found, value):
        paths.setdefault(b.path, []).append(v)
    content = np.array([max(paths[b.path]) >= CONTENT_SHARE * level and level > 0 for b in found])
    if not content.any():
        return ""
    # down to the deepest element with nearly all content, but not to a single leaf
    whole, depth, region = (length * content).sum(), 0, None
    while True:
        weight: dict[int, float] = {}
        for b, c, n in zip(found, content, length):
            if c and len(b.nodes) > depth + 1 and (region is None or b.nodes[depth - 1] == region):
                weight[b.nodes[depth]] = weight.get(b.nodes[depth], 0.0) + n
        best = max(weight, key=weight.get, default=None)
        if best is None or weight[best] < REGION_SHARE * whole:
            break
        region, depth = best, depth + 1
    # up to the article, and to parents that add headings or content only
    line = next((b for b in found if region is not None and region in b.nodes), found[0])
    top = depth
    for k in range(depth):
        if line.path[k] in ("article", "main"):
            top = k + 1
            break
    while top > 1 and not any(x in ("article", "main") for x in line.path[:top]):
        parent = line.nodes[top - 2]
        extra = [(b, c) for b, c in zip(found, content)
                 if len(b.nodes) > top - 2 and b.nodes[top - 2] == parent and (len(b.nodes) < top or b.nodes[top - 1] != line.nodes[top - 1])]
        if not all(c or b.path[-1] in HEADINGS for b, c in extra):
            break
        top -= 1
    keep = []
    for b, c in zip(found, content):
        if top and (len(b.nodes) < top or b.nodes[top - 1] != line.nodes[top - 1]):
            continue
        if not c and (b.doubtful or b.linked > MOST_LINKED * len(b.text)):
            continue
        keep.append(b.text)
    return "\n\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html)."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
