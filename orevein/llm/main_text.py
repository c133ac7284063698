"""The main text of web pages by a minimum cut.

A page becomes a row of blocks (what stands between tags that break lines), each with its place in the tree of elements. A classifier gives each block a score; its amount is
the capacity to one terminal, content or boilerplate. Neighbours in page order, and blocks that follow each other in one element, are joined by
edges that are the stronger the nearer they stand in the tree. The minimum cut is the labelling that goes against the scores and parts neighbours at the least cost: a short line
amid paragraphs stays with them, a lone sentence amid links goes.

The classifier's part that looks at a block's shape (words, links, sentences) is trained here: blocks whose elements say what they are, counted by cells of shape, are
its labelled rows, and a prior stands in where there are few. What elements say for themselves (article, nav, a class of "sidebar") counts beside it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements of HTML, and words of class, id and role by which pages name their parts.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = {"hr"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
UNSEEN = "script style noscript template iframe svg textarea select button title canvas audio video datalist object".split()
CONTENT_TAGS, BOILERPLATE_TAGS = {"article", "main"}, set("nav footer aside form menu dialog search".split())
CONTENT_ROLES, BOILERPLATE_ROLES = {"main", "article"}, set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
CONTENT_WORDS = set("article articlebody articletext post postbody entry story".split())
BOILERPLATE_WORDS = set("nav navbar menu ad ads adv advert toc tags reply replies share sharing social related recommended login signup popup modal overlay widget toolbar pager respond masthead legal".split())
BOILERPLATE_STEMS = tuple("advert sponsor promo cookie consent newsletter subscri sidebar footer breadcrumb navig comment disqus pagination trackback copyright disclaimer notice notif alert banner outbrain taboola".split())
HEADER_WORDS = set("header topbar".split())
CUES = ["©", "cookie", "copyright", "all rights reserved", "privacy policy", "terms of use", "terms of service", "subscribe", "newsletter", "advertisement"]

#: A start or end tag with its name and attributes, a comment, other markup, text, or a lone "<".
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
CLOSERS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in UNSEEN}
ENDS, CLOSING = tuple(".!?…。！？"), "\"'”’»)]"

#: Scores: of a block inside what calls itself content; inside what calls itself boilerplate; outside of the content of a page that marks it. The shape's own counts SHAPE_MOST at most, either way.
INSIDE, BOILERPLATE, OUTSIDE, SHAPE_MOST = 4.0, -7.0, -4.0, 3.0
#: Capacity between neighbours in one element, halved, put in three ... by each step that lies between them in the tree; and between blocks that follow each other in one element but not on the page.
NEIGHBOUR, SIBLING = 1.0, 0.5
#: Pages that the shape's weights are learned from, at most on average: those with the smallest hashes of page_id and url.
MOST_PAGES = 20_000
#: Shape features: bias, share of linked text (in quarters), words (0: up to 3, 1: up to 9, 2: up to 24, 3: more), ends like a sentence, heading, list item, has a cue word. The prior's centre and its weight in blocks.
SHAPE = ["bias", "linked", "long", "sentence", "heading", "item", "cue"]
PRIOR, PRIOR_WEIGHT = np.array([-1.0, -1.0, 0.8, 1.2, 1.0, -0.5, -1.5]), 20.0


class Block:
    """text, cell (a value for each of SHAPE), parent (number of its element), marked (inside: 1, boilerplate: -1, else 0)."""

    __slots__ = ("text", "cell", "parent", "marked")

    def __init__(self, text: str, cell: tuple, parent: int):
        self.text, self.cell, self.parent, self.marked = text, cell, parent, 0


class Elements:
    """The tree of block elements: parent, depth and what each says of itself."""

    def __init__(self):
        self.parent, self.depth, self.says, self.holds = [-1], [0], [0], [False]

    def add(self, parent: int, says: int, content: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.says.append(says)
        self.holds.append(False)
        while content and parent >= 0 and not self.holds[parent]:
            self.holds[parent] = True
            parent = self.parent[parent]
        return len(self.parent) - 1

    def steps(self, a: int, b: int) -> int:
        n = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, n = self.parent[a], n + 1
        return n


#: What an element says: content; boilerplate by its tag or role; by a class or id, which counts unless the element holds marked content; a header, which counts outside of content.
CONTENT, SURELY, CLASSED, HEADER = 1, 2, 3, 4


def _says(tag: str, attributes: str) -> int:
    if tag in ("body", "html"):
        return 0
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return SURELY
        if name == "role":
            if value.lower() in BOILERPLATE_ROLES:
                return SURELY
            if value.lower() in CONTENT_ROLES:
                words.add("article")
        elif name in ("class", "id", "itemprop"):
            words.update(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
            words.update(re.findall(r"[a-z]+", value.lower()))
    if tag in BOILERPLATE_TAGS:
        return SURELY
    if words & BOILERPLATE_WORDS or any(w.startswith(BOILERPLATE_STEMS) for w in words):
        return CLASSED
    if tag in CONTENT_TAGS or words & CONTENT_WORDS and not words & HEADER_WORDS:
        return CONTENT
    return HEADER if tag == "header" or words & HEADER_WORDS else 0


def blocks_of(page: str) -> tuple[list[Block], Elements, bool]:
    """The page's blocks in order, its elements, and whether any block lies inside marked content."""
    tree, out = Elements(), []
    open_: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            n, share = text.count(" ") + 1, min(1.0, linked / len(text))
            tags, low = {t for t, _ in open_[-2:]}, text.lower()
            cell = (1, round(4 * share) / 4, (n > 3) + (n > 9) + (n > 24), text.rstrip(CLOSING).endswith(ENDS), bool(tags & HEADINGS), open_[-1][0] == "li", any(c in low for c in CUES))
            out.append(Block(text, cell, open_[-1][1]))
        linked = 0

    def leave(tags: set[str], stop: set[str]) -> None:
        """Close the innermost open element of tags, and what is open in it, but not beyond one of stop."""
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][0] in tags:
                del open_[k:]
                return
            if open_[k][0] in stop:
                return

    while at < len(page):
        m = TOKEN.match(page, at)
        if m is None:  # a "<" of a tag that never ends
            at = len(page) if page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/" else at + 1
            continue
        at = m.end()
        text, tag = m[4], m[2]
        if text is not None:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            linked += len(text.strip()) if links else 0
        elif tag:
            tag = tag.lower()
            if tag in CLOSERS and not m[1]:
                end = CLOSERS[tag].search(page, at)
                if end or tag in ("script", "style", "textarea", "title"):
                    at = end.end() if end else len(page)
            elif tag == "a":
                links = 0 if m[1] else 1
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCKS:
                flush()
                if m[1]:
                    leave({tag} if tag not in HEADINGS else HEADINGS, {"td", "th"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "article", "main", "body", "html") else set())
                    continue
                leave({"p"}, BLOCKS - {"p"})
                if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    same = {"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {tag}
                    leave(same, {"ul", "ol", "menu", "dir", "dl", "table"} | ({"tr"} if tag in ("td", "th") else set()))
                if tag not in VOID:
                    says = _says(tag, m[3])
                    open_.append((tag, open_[-1][1] if tag in ("p", "html", "body") and not says else tree.add(open_[-1][1], says, tag in CONTENT_TAGS)))
    flush()
    return out, tree, _mark(out, tree)


def _mark(blocks: list[Block], tree: Elements) -> bool:
    """Say of blocks what the elements around them say. Boilerplate anywhere around a block counts, of content the innermost kind that the page has."""
    inside, tagged = [False] * len(tree.parent), [False] * len(tree.parent)
    for k in range(1, len(tree.parent)):  # parents come first
        up, says = tree.parent[k], tree.says[k]
        inside[k] = inside[up] or says == CONTENT
        tagged[k] = tagged[up] or says == SURELY or says == CLASSED and not tree.holds[k] or says == HEADER and not inside[k] and not tree.holds[k]
    # where content lies in content (an article in main), the innermost is meant
    inner = [False] * len(tree.parent)
    for k in range(len(tree.parent) - 1, 0, -1):
        if tree.says[k] == CONTENT and not tagged[k]:
            inner[tree.parent[k]] = True
        inner[tree.parent[k]] |= inner[k]
    held = [False] * len(tree.parent)
    for k in range(1, len(tree.parent)):
        held[k] = held[tree.parent[k]] or tree.says[k] == CONTENT and not inner[k]
    some = False
    for b in blocks:
        b.marked = -1 if tagged[b.parent] else int(held[b.parent])
        some |= b.marked == 1
    return some


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node, whether it lies on the source's side of a minimum cut (the smallest such side). scores: capacity to the source (positive) or the sink (negative).

    Nodes that outweigh all their edges are settled first, and lend their neighbours the edge between them; the flow only runs among the rest.
    """
    near: list[dict[int, float]] = [{} for _ in scores]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * len(scores)
    score, held = list(scores), [sum(x.values()) for x in near]
    todo = deque(range(len(scores)))
    while todo:
        k = todo.popleft()
        if side[k] is None and (abs(score[k]) > held[k] + 1e-9 or not near[k]):
            side[k] = score[k] > 0
            for j, c in near[k].items():
                if side[j] is None:
                    score[j] += c if side[k] else -c
                    held[j] -= c
                    todo.append(j)
    rest = [k for k, s in enumerate(side) if s is None]
    if rest:
        # 0 is the source, 1 the sink
        at = {k: n + 2 for n, k in enumerate(rest)}
        flow: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
        for k in rest:
            here = at[k]
            flow[here].update({at[j]: c for j, c in near[k].items() if j in at})
            a, b = (0, here) if score[k] > 0 else (here, 1)
            flow[a][b], flow[b][a] = abs(score[k]), 0.0
        reached = _max_flow(flow)
        for k in rest:
            side[k] = at[k] in reached
    return side


def _max_flow(flow: list[dict[int, float]]) -> set[int]:
    """Push all flow there is from node 0 to node 1 by levels; flow becomes what is left of the capacities. Returns the nodes that can still be reached from 0."""
    while True:
        level, todo = {0: 0}, deque([0])
        while todo:
            a = todo.popleft()
            for b, c in flow[a].items():
                if c > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    todo.append(b)
        if 1 not in level:
            return set(level)
        left, path = [list(x) for x in flow], [0]
        while path:
            a = path[-1]
            if a == 1:
                least = min(flow[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    flow[x][y] -= least
                    flow[y][x] = flow[y].get(x, 0.0) + least
                path = path[: next(k for k, (x, y) in enumerate(zip(path, path[1:], strict=False)) if flow[x][y] <= 1e-9) + 1]
                continue
            while left[a] and not (flow[a][left[a][-1]] > 1e-9 and level.get(left[a][-1]) == level[a] + 1):
                left[a].pop()
            if left[a]:
                path.append(left[a][-1])
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The page's main text, a line for each block."""
    blocks, tree, marks = blocks_of(page or "")
    w = weights.tolist()
    scores, edges, before = [], {}, {}
    for k, b in enumerate(blocks):
        shape = sum(x * y for x, y in zip(w, b.cell, strict=True))
        scores.append(max(-SHAPE_MOST, min(SHAPE_MOST, shape)) + (INSIDE if b.marked > 0 else BOILERPLATE if b.marked < 0 else OUTSIDE if marks else 0.0))
        if k:
            edges[k - 1, k] = NEIGHBOUR / (1 + tree.steps(blocks[k - 1].parent, b.parent))
        if before.get(b.parent, k - 1) < k - 1:
            edges[before[b.parent], k] = SIBLING
        before[b.parent] = k
    return "\n".join(b.text for b, good in zip(blocks, minimum_cut(scores, edges), strict=True) if good)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many blocks of each shape lie inside content, and how many in boilerplate."""
    found: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            found.update((*map(float, b.cell), b.marked > 0) for b in blocks_of(page or "")[0] if b.marked)
    if found:
        rows = list(found)
        arrays = [pa.array([r[k] for r in rows]) for k in range(len(SHAPE) + 1)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([found[r] for r in rows], pa.int64())], names=[*SHAPE, "good", "n"])


def fitted(cells: list[tuple[tuple, bool, int]], rounds: int = 50) -> np.ndarray:
    """Weights of SHAPE by logistic regression on (shape, good, how many), either label as weighty as the other, drawn to PRIOR. Without rows: PRIOR."""
    w, total = PRIOR.copy(), [sum(n for _, g, n in cells if g == good) for good in (False, True)]
    if not all(total):
        return w
    x, y = np.array([c for c, _, _ in cells], float), np.array([g for _, g, _ in cells], float)
    n = np.array([k * sum(total) / 2 / total[g] for _, g, k in cells])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - PRIOR_WEIGHT * (w - PRIOR)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + PRIOR_WEIGHT * np.eye(len(w)), gradient)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(pages: DataFrame, most: int = MOST_PAGES) -> np.ndarray:
    """Weights learned from about `most` pages (all, if there are fewer): counts by cells of shape, a few hundred rows whatever the input."""
    n = pages.count()
    if n > most:
        pages = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)) < int((1 << 40) * (most / n)))
    counts = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(_counting, ", ".join(f"{c} double" for c in SHAPE) + ", good boolean, n long")
    cells = counts.groupBy(*SHAPE, "good").agg(F.sum("n").alias("n")).collect()
    return fitted(sorted((tuple(r[c] for c in SHAPE), r.good, r.n) for r in cells))


def _extracting(weights: np.ndarray):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return extract


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id long, url and html string; other columns are left alone).

    A null or empty html, and one without main text, gives an empty text. page_id and url are passed on, null or not; repeated rows are all returned. An empty table gives no rows.
    A page has to fit into a task; the rows of a task are worked on one by one. weights: those of an earlier train(); without them it runs here.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = train(pages) if weights is None else weights
    return pages.mapInArrow(_extracting(weights), "page_id long, url string, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: What the method has to find on pages that mark their article and put nothing else into it: its paragraphs and headings.
OP12_SQL = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
split AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(replace(a, '<br>', ' '), '</?(p|h[1-6])>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS b FROM articles),
plain AS (SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS b FROM split),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
