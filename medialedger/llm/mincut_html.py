"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A logistic classifier gives the cost of calling a block content or boilerplate; these are the
capacities to the two terminals. Blocks that follow each other, and blocks that follow each other within the same container,
are tied by edges that cost more the closer they stand in the document tree. The minimum cut, found by maximum flow, is the
labelling with the least sum of costs and cut edges.

The classifier looks at structure: a block's size, links, tag and ending, the links of its container, and what share of the
page's unlinked text its region holds. Names of containers are a vote among others, and none where a container's names
disagree. These weights are fitted, and held close to their starting values, on a bounded sample of pages; the labels come from
elsewhere, the elements by which pages say what a part is for (article and main, or nav, footer, aside, form ...), which are no
inputs of the fit. Where a page has such elements they count as evidence of fixed weight: what lies in them, and, on a page that
marks its article, what lies outside.

Defined cases: null or empty pages have an empty text; tags that are not closed end where their parent or, for paragraphs and
items, the next block begins; comments, scripts and styles without an end run to the end of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .markup import short_numbers, tokens

#: Pages from which the classifier is fitted.
SAMPLE_PAGES = 400
#: Most that an edge costs, between neighbours and within a container.
NEAR, INSIDE = 0.6, 0.6

#: Elements of which nothing is looked at.
RAW = frozenset("script style noscript template textarea iframe".split())
ATTRIBUTE = re.compile(r"(?<![\w:.-])(class|id|role|hidden|style)(?![\w:.-])\s*+(?:=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul button label option caption".split())
ENDS_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "label", "option", "button"}
SIBLING = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements whose text is not shown as the page's; without an end tag they end with their parent.
DROPPED = frozenset("svg object select".split())
KEEPS_LIST = frozenset("ul ol dl table tbody thead tfoot menu select".split())
#: Containers whose tag or name tells their role. Fixed values.
AWAY_TAGS = frozenset("nav footer aside head title menu button dialog label".split())
AWAY_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disclaimer discussion disqus dropdown footer footnav gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond recommended search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article story post entry main content body text".split())
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Starting weights of what is fitted: none, size, links, heading, list item, paragraph, end of a sentence, links of the
#: container, unlinked share of the region, name says away, name says main.
PRIOR = np.array([-1.5, 0.35, -3.0, 0.3, -0.4, 0.5, 0.4, -1.5, 3.0, -4.0, 2.5])
#: Weights of what elements say: away, main, outside of the marked article, outside of what a name marks, and of a name that
#: says away within the marked article.
STATED = np.array([-7.0, 3.5, -5.0, -2.0, -5.0])
#: Least share of the text, but for what elements say is away, that a marked article has.
MARKED = 0.2
#: A form with this share of the page's text, or a container with this share of the article's, is the page's own, whatever
#: it is called.
MOST = 0.5


@dataclass(slots=True)
class Role:
    """What an element and those around it say: by tag, by name; the outermost that says anything is the region."""

    away: bool = False
    main: bool = False
    name_away: bool = False
    name_main: bool = False
    region: int = 0
    form: int = 0  # the outermost form
    named: int = 0  # the outermost container whose name says away


@dataclass(slots=True)
class Block:
    text: str
    linked: float
    tag: str
    role: Role
    container: int
    depth: int
    common: int  # elements that it shares with the block before


def role(tag: str, attributes: str, around: Role, number: int) -> Role:
    away, main = tag in AWAY_TAGS or (tag == "header" and not around.main), tag in MAIN_TAGS
    votes = [0, 0]
    if attributes and ("=" in attributes or "hidden" in attributes.lower()):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                away = True
            elif key == "role":
                away, main = away or value in AWAY_ROLES, main or value in ("main", "article")
            elif key in ("class", "id"):
                for name in value.split():
                    parts = NAME.findall(name)
                    if not parts or parts[0] in ("has", "with", "no", "is"):
                        continue
                    if tag == "article" and {"comment", "comments", "reply", "ad", "promo", "related"} & set(parts):
                        away = True
                    elif tag not in ("html", "body", "main", "article") and any(p in AWAY_NAMES for p in parts):
                        votes[0] += 1
                    elif any(p in MAIN_NAMES for p in parts):
                        votes[1] += 1
    name_away, name_main = bool(votes[0]) and not votes[1], bool(votes[1]) and not votes[0]
    form = number if tag == "form" else 0
    if not (away or main or name_away or name_main or form):
        return around
    region = around.region or (number if away or main or name_away or name_main else 0)
    named = around.named or (number if name_away else 0)
    return Role(away or around.away, main or around.main, name_away or around.name_away, name_main or around.name_main, region, around.form or form, named)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    # an open element: tag, role, number; and how many of each tag are open
    stack: list[tuple[str, Role, int]] = [("", Role(), 0)]
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    links = linked = number = dropped = 0
    shallow = 1  # the fewest open elements since the last block

    def flush() -> None:
        nonlocal linked, shallow
        if text:
            words = SPACE.sub(" ", html.unescape(short_numbers("".join(text)))).strip()
            if words:
                top = len(stack) - 1
                while top and stack[top][0] not in BLOCK:
                    top -= 1
                out.append(Block(words, min(1.0, linked / len(words)), stack[top][0], stack[top][1], stack[top - 1][2] if top else 0, top + 1, min(shallow, top + 1)))
                shallow = top + 1
            text.clear()
        linked = 0

    def push(tag: str, role: Role) -> None:
        nonlocal links, dropped
        stack.append((tag, role, number))
        open_tags[tag] += 1
        links += tag == "a"
        dropped += tag in DROPPED

    def close(at: int) -> None:
        nonlocal links, dropped, shallow
        for tag, *_ in stack[at:]:
            open_tags[tag] -= 1
            links -= tag == "a"
            dropped -= tag in DROPPED
        del stack[at:]
        shallow = min(shallow, at)

    pos = 0
    for start, end, kind, tag, attributes in tokens(page, RAW):
        if start > pos and not dropped:
            piece = page[pos:start]
            text.append(piece)
            if links:
                linked += len(piece)
        pos = end
        if kind not in ("open", "close"):
            continue
        if kind == "close":
            if not open_tags[tag]:
                continue
            above, block = 0, tag in BLOCK
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == tag:
                    if dropped == above and block:
                        flush()
                    close(at)
                    break
                if tag not in BLOCK and tag not in DROPPED and stack[at][0] in BLOCK:
                    break
                above += stack[at][0] in DROPPED
                block = block or stack[at][0] in BLOCK
            continue
        if dropped:
            if open_tags["svg"] and not open_tags["foreignobject"] and tag in BLOCK and tag != "title":
                close(next(k for k, x in enumerate(stack) if x[0] == "svg"))  # blocks end an open drawing
            else:
                if tag not in VOID and not attributes.endswith("/"):
                    number += 1
                    push(tag, stack[-1][1])
                continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P and open_tags["p"]:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] == "p":
                        close(at)
                        break
                    if stack[at][0] in BLOCK:
                        break
            if tag in SIBLING:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] in SIBLING[tag]:
                        close(at)
                        break
                    if stack[at][0] in KEEPS_LIST:
                        break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        number += 1
        push(tag, role(tag, attributes, stack[-1][1], number))
    if not dropped:
        text.append(page[pos:])
    flush()
    return out


def features(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """(what the fitted weights see, what elements say) of a page's blocks."""
    size = np.array([len(b.text) for b in blocks], float)
    linked = np.array([b.linked for b in blocks])
    away, main, name_away, name_main = np.array([(b.role.away, b.role.main, b.role.name_away, b.role.name_main) for b in blocks]).T

    def sums(ids: list[int], values: np.ndarray) -> np.ndarray:
        _, at = np.unique(ids, return_inverse=True)
        return np.bincount(at, values)[at]

    form = np.array([b.role.form for b in blocks])
    away = away | (form > 0) & (sums(form, size * ~away) < MOST * max(1.0, size[~away].sum()))
    main, name_main = main & ~away, name_main & ~name_away
    container = [b.container for b in blocks]
    region = [b.role.region or b.container for b in blocks]
    unlinked = size * (1 - linked)
    tags = [b.tag for b in blocks]
    seen = [
        np.ones(len(blocks)),
        np.log1p(size),
        linked,
        [t[:1] == "h" and t[1:].isdigit() for t in tags],
        [t == "li" for t in tags],
        [t in ("p", "blockquote", "pre") for t in tags],
        [b.text[-1] in ".!?\"'”»:…" for b in blocks],
        sums(container, size * linked) / sums(container, size),
        sums(region, unlinked) / max(1.0, unlinked.sum()),
        name_away,
        name_main,
    ]
    rest = max(1.0, size[~away].sum())
    marked, named = size[main].sum() >= MARKED * rest, size[name_main & ~away].sum() >= MARKED * rest
    # a small part of the article whose name speaks against it is none of it; a large one is left to the classifier
    within = main & name_away & (sums([b.role.named for b in blocks], size * main) < MOST * size[main].sum())
    stated = [away, main & ~name_away, ~main & marked, ~name_main & ~main & (named and not marked), within]
    return np.stack(seen, axis=1).astype(float), np.stack(stated, axis=1).astype(float)


def fit(pages: list[str], rounds: int = 200) -> np.ndarray:
    """Weights from the blocks whose elements say what they are for, held close to the starting ones."""
    both = [features(b) for b in map(blocks_of, pages) if b]
    if not both:
        return PRIOR
    x, stated = (np.concatenate(z) for z in zip(*both, strict=True))
    use = (stated[:, 0] > 0) | (stated[:, 1] > 0)
    x, y = x[use], stated[use, 1]
    if len(set(y.tolist())) < 2:
        return PRIOR
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both kinds count alike
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.3 * (x.T @ ((p - y) * weight) / np.maximum(1, np.abs(x).max(axis=0)) + 0.05 * (w - PRIOR))
    return w


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Ties between blocks that follow each other, in the page and within a container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            apart = blocks[i - 1].depth + b.depth - 2 * min(b.common, blocks[i - 1].depth)
            out[i - 1, i] = NEAR / max(1, apart - 1)
        before = last.get(b.container)
        if before is not None:
            out[before, i] = out.get((before, i), 0.0) + INSIDE
        last[b.container] = i
    return out


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node whether it is content, with the least sum of costs: content[i] or boilerplate[i], and cut edges.

    A node whose costs differ by more than all its edges is settled, and its edges become costs of its neighbours; most nodes
    settle so. Flow is sent between those that are left, each source in turn by shortest paths. What a source still reaches
    when no path is left is content and can't be passed any more, so no part of a page is searched twice in vain.
    """
    n = len(content)
    # what flows straight from terminal to terminal is the same for all labellings
    excess = (boilerplate - content).tolist()
    left: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        left[i][j] = left[i].get(j, 0.0) + c
        left[j][i] = left[j].get(i, 0.0) + c
    tiny, keep, todo = 1e-9, [False] * n, list(range(n))
    settled = [False] * n
    while todo:
        i = todo.pop()
        if settled[i] or abs(excess[i]) <= sum(left[i].values()):
            continue
        settled[i], keep[i] = True, excess[i] > 0
        for j, c in left[i].items():
            excess[j] += c if keep[i] else -c
            del left[j][i]
            todo.append(j)
        left[i] = {}
    for source in range(n):
        while not settled[source] and excess[source] > tiny:
            came, line, end = {source: -1}, deque([source]), -1
            while line and end < 0:
                i = line.popleft()
                for j, c in left[i].items():
                    if c > tiny and j not in came and not settled[j]:
                        came[j] = i
                        if excess[j] < -tiny:
                            end = j
                            break
                        line.append(j)
            if end < 0:
                for i in came:
                    settled[i] = keep[i] = True
                break
            path = [end]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            flow = min(excess[source], -excess[end], *(left[a][b] for b, a in zip(path, path[1:], strict=False)))
            for b, a in zip(path, path[1:], strict=False):
                left[a][b] -= flow
                left[b][a] = left[b].get(a, 0.0) + flow
            excess[source] -= flow
            excess[end] += flow
    return keep


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    seen, stated = features(blocks)
    z = np.clip(seen @ weights + stated @ STATED, -30, 30)
    # costs are the negative logarithms of the classifier's probabilities
    cost_content, cost_boilerplate = np.logaddexp(0, -z), np.logaddexp(0, z)
    keep = minimum_cut(cost_content, cost_boilerplate, edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def train(pages: DataFrame, n: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from the n pages with the smallest hashes; only hashes are sorted, and only n pages leave the executors."""
    keyed = pages.where("html is not null").select(F.xxhash64("html").alias("k"), "html")
    picked = keyed.select("k").distinct().orderBy("k").limit(n)
    rows = keyed.join(F.broadcast(picked), "k").groupBy("k").agg(F.min("html").alias("html")).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: r["k"])])


def extracted(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """pages, but for their html, with text and n_chars; columns of these names are replaced."""
    columns = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                text = [main_text(x, weights) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [*columns, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in columns), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*columns, F.col("html").cast("string")).mapInArrow(go, schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, train(pages))
