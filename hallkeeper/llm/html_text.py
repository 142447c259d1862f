"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes a list of text blocks with features of their form and place. A logistic classifier, fitted to blocks of
a bounded sample of pages whose own markup names their role, turns each block's features into the cost of either
label. These costs are the capacities between the block and the two terminals; edges between blocks that follow each
other or share an ancestor make it dear to label neighbours differently. The maximum flow gives the cheapest labels.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.llm.shipping import ship

SAMPLE_PAGES = 2000
"""Different pages, those with the smallest hashes of their html, whose blocks the classifier is fitted to."""

# The elements of HTML by their part in a page.
SKIPPED = frozenset("script style noscript template svg math head iframe object canvas select option textarea button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
"""Open elements that the start of an element ends."""

ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)

CONTENT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))
OTHER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|consent|disqus|footer|foot|header|login|masthead|"
    r"menu|modal|nav\w*|newsletter|notice|pagination|popup|promo\w*|related|share|sharing|sidebar|side|signup|social|"
    r"sponsor\w*|subscribe|toolbar|topbar|widget|reply|replies|respond|discussion|alert)(?:$|[\s_-])",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
OTHER_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_RAW = re.compile(r"</(script|style|textarea|noscript|template|title)", re.I)
_NAME = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    linked: int
    path: tuple[int, ...]
    tag: str
    inside_content: bool
    inside_other: bool
    named_content: bool
    named_other: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without scripts, styles and hidden elements; never fails on bad markup."""
    out: list[Block] = []
    # Open elements: (tag, number, in content tag, in other tag, content name, other name, skipped).
    stack: list[tuple] = [("", 0, False, False, False, False, False)]
    parts: list[str] = []
    links: list[str] = []
    counter = depth_a = at = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                linked = len(_SPACE.sub(" ", html.unescape("".join(links))).strip())
                holder = [e for e in stack if e[0] not in INLINE]
                top = stack[-1]
                out.append(
                    Block(text, min(linked, len(text)), tuple(e[1] for e in holder), holder[-1][0], *top[2:6])
                )
            parts.clear()
            links.clear()

    def pop_to(level: int) -> None:
        nonlocal depth_a
        while len(stack) > level:
            if stack.pop()[0] == "a":
                depth_a = max(0, depth_a - 1)

    def words(piece: str) -> None:
        if piece and not stack[-1][6]:
            parts.append(piece)
            if depth_a:
                links.append(piece)

    n = len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            words(page[at:])
            break
        words(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][0] == tag:
                    if tag not in INLINE or any(e[0] not in INLINE for e in stack[level:]):
                        flush()
                    pop_to(level)
                    break
            continue
        if tag in INLINE:
            if tag == "br":
                words(" ")
                continue
        else:
            flush()
            if tag in ENDS_P:
                for level in range(len(stack) - 1, 0, -1):
                    if stack[level][0] == "p":
                        pop_to(level)
                        break
                    if stack[level][0] not in INLINE:
                        break
            for level in range(len(stack) - 1, 0, -1):
                if stack[level][0] in CLOSES.get(tag, ()):
                    pop_to(level)
                    break
                if stack[level][0] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                    break
        if tag in VOID or found[3].rstrip().endswith("/") and tag not in SKIPPED:
            continue
        names, hidden = [], False
        if found[3]:
            for m in _NAME.finditer(found[3]):
                value = m[2] or m[3] or m[4] or ""
                key = m[1].lower()
                if key in ("class", "id"):
                    names.append(value)
                elif key == "role":
                    hidden = hidden or value.lower() == "none-visible"
                    if value.lower() in OTHER_ROLES:
                        names.append("nav")
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    hidden = True
                elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
        name = " ".join(names)
        above = stack[-1]
        counter += 1
        # A nested article inside a comment section is still a comment: other names hold until an element ends.
        stack.append(
            (
                tag,
                counter,
                above[2] or tag in CONTENT_TAGS,
                above[3] or tag in OTHER_TAGS,
                above[4] or bool(name and CONTENT_NAMES.search(name)),
                above[5] or bool(name and OTHER_NAMES.search(name)),
                above[6] or tag in SKIPPED or hidden,
            )
        )
        if tag == "a":
            depth_a += 1
        if tag in ("script", "style", "textarea", "noscript", "template", "title"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag != "title" or end is None:
                at = end.start() if end else n
    flush()
    return out


FEATURES = (
    "bias", "log_length", "words", "link_share", "marks", "heading", "paragraph", "item", "cell",
    "inside_content", "inside_other", "named_content", "named_other", "first", "last", "sentence",
)

PRIOR = (-0.6, 0.5, 0.3, -4.0, 0.8, 0.2, 0.6, -0.4, -0.2, 2.5, -4.5, 0.8, -4.0, -0.3, -0.5, 0.4)
"""Weights before any page is seen; the fit moves them as far as the sample tells."""

PRIOR_STRENGTH = 4.0

ADJACENT = 0.5
SAME_PARENT = 0.7
SAME_GRANDPARENT = 0.3


def features(page: list[Block]) -> np.ndarray:
    """One row per block."""
    n = len(page)
    x = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(page):
        length = len(b.text)
        n_words = b.text.count(" ") + 1
        x[i] = (
            1.0,
            math.log1p(length) - 4.0,
            min(n_words, 40) / 20 - 0.5,
            b.linked / length,
            min(sum(b.text.count(c) for c in ".,;:") / n_words, 0.3) * 3,
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.tag in ("p", "blockquote", "pre"),
            b.tag in ("li", "dt", "dd"),
            b.tag in ("td", "th"),
            b.inside_content,
            b.inside_other,
            b.named_content,
            b.named_other,
            i < 0.1 * n,
            i >= 0.9 * n,
            b.text[-1] in ".!?…\"'”»",
        )
    return x


def _label(b: Block) -> int | None:
    """What a page's own markup says of a block: 1 content, 0 boilerplate, None nothing."""
    if b.inside_other or b.named_other:
        return 0
    return 1 if b.inside_content or b.named_content else None


def fit_weights(pages: list[str]) -> list[float]:
    """Logistic regression towards PRIOR on the blocks whose role the markup names."""
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        labels = [_label(b) for b in found]
        use = [i for i, y in enumerate(labels) if y is not None]
        if use:
            xs.append(features(found)[use])
            ys.append(np.array([labels[i] for i in use], float))
    w = np.array(PRIOR, float)
    if xs:
        x, y = np.concatenate(xs), np.concatenate(ys)
        # Both roles weigh the same, and together as much as a hundred blocks.
        weight = np.where(y == 1, 50 / max(y.sum(), 1), 50 / max((1 - y).sum(), 1))
        prior = np.array(PRIOR, float)
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + PRIOR_STRENGTH * (w - prior)
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
            w = w - np.linalg.solve(hessian, gradient)
    return [round(float(v), 6) for v in w]


def min_cut(content: list[float], other: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True is content) of least cost: content[i] or other[i] for a block labelled so, w for a parted edge.

    The flow over a block's two terminal edges is taken out first; the rest is found by shortest augmenting paths.
    """
    n = len(content)
    excess = [other[i] - content[i] for i in range(n)]  # above 0: joined to content's side
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + w
    tiny = 1e-9
    while True:
        # Levels from all blocks with flow left towards those that can take it.
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if excess[i] < -tiny:
                reached = True
            for j, w in graph[i].items():
                if w > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        order = [list(graph[i]) for i in range(n)]
        place = [0] * n
        for source in range(n):
            while excess[source] > tiny and level[source] == 0:
                path = [source]
                while path and excess[path[-1]] >= -tiny:
                    i = path[-1]
                    while place[i] < len(order[i]):
                        j = order[i][place[i]]
                        if graph[i][j] > tiny and level[j] == level[i] + 1:
                            break
                        place[i] += 1
                    if place[i] == len(order[i]):
                        path.pop()
                        if path:
                            place[path[-1]] += 1
                    else:
                        path.append(order[i][place[i]])
                if not path:
                    break
                push = min(excess[source], -excess[path[-1]], *[graph[a][b] for a, b in zip(path, path[1:])]) if len(path) > 1 else 0.0
                if push <= 0:
                    break
                for a, b in zip(path, path[1:]):
                    graph[a][b] -= push
                    graph[b][a] = graph[b].get(a, 0.0) + push
                excess[source] -= push
                excess[path[-1]] += push


def smoothness(page: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, and between a block and the next one under the same (grand)parent."""
    edges = [(i, i + 1, ADJACENT) for i in range(len(page) - 1)]
    for up, w in ((2, SAME_PARENT), (3, SAME_GRANDPARENT)):
        last: dict[int, int] = {}
        for i, b in enumerate(page):
            if len(b.path) > up:
                ancestor = b.path[-up]
                if ancestor in last:
                    edges.append((last[ancestor], i, w))
                last[ancestor] = i
    return edges


def main_text(page: str, weights: list[float]) -> str:
    """The content blocks of a page, joined by empty lines."""
    found = blocks(page)
    if not found:
        return ""
    score = np.clip(features(found) @ np.array(weights), -30, 30)
    content, other = np.log1p(np.exp(-score)).tolist(), np.log1p(np.exp(score)).tolist()
    keep = min_cut(content, other, smoothness(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [main_text(page or "", weights) for page in part.column("html").to_pylist()]
                yield pa.record_batch(
                    {c: part.column(c) for c in part.schema.names if c != "html"} | {"text": pa.array(texts, pa.string())}
                )

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages without content, have an empty text. Repeated rows are read each; other columns
    of ``pages`` are left aside.
    """
    ship(pages.sparkSession)
    # Hashes are sorted without their pages; the list that is broadcast has SAMPLE_PAGES numbers.
    hashed = pages.filter("html is not null").select("html", F.xxhash64("html").alias("at"))
    least = hashed.select("at").distinct().orderBy("at").limit(SAMPLE_PAGES)
    sample = (
        hashed.join(F.broadcast(least), "at", "left_semi")
        .dropDuplicates(["at"])
        .select("html")
        .mapInArrow(_shorten, "html string")
    )
    weights = fit_weights(sorted(r[0] for r in sample.collect()))
    kept = pages.select("page_id", "url", "html")
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(
        _extract(weights), f"page_id {fields['page_id']}, url {fields['url']}, text string"
    ).withColumn("n_chars", F.char_length("text").cast("long"))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's pages as they are, but for those above 64 KB, which are left out of the fit."""
    for batch in batches:
        yield pa.record_batch({"html": pa.array([p for p in batch.column("html").to_pylist() if len(p) < 1 << 16], pa.string())})
