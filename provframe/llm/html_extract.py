"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements, in which runs of like siblings are folded into one node. The trees of a host
are aligned by simple tree matching: in rounds, some trees at a time are merged into one that has the nodes of all, until
each host has one wrapper. Then every page's tree is aligned with its host's wrapper, and the pages vote on the wrapper's nodes: a text
that stands at a node in nearly all pages that have the node is constant there. Votes are counted for the host and for each
layout, which is the set of a page's outer nodes. Nodes with a constant text are template, nodes that vary are slots. A page's text is
what its slots hold, less what the tags and names of the elements around say is something else than the article.

Pages are parsed twice, for votes and for texts, so that no text is written in between. Merging and aligning see each different tree of a host once, votes are added up per host before
they are shuffled, and pages meet the verdict on their tree in a join that Spark can split, so a host may own any
share of the pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provframe.llm.common import materialize

#: A node of the template was seen in so many pages that are no copies of each other, and had the same text in such a share of them.
MIN_PAGES, SAME = 5, 0.9
#: Depth to which the nodes of a page make its layout.
LAYOUT_DEPTH = 4
#: Trees merged at once, about; pairs of siblings whose table is held at once, where the roots of longer lists don't need more. The result doesn't depend on it.
FAN_IN, SIBLING_PAIRS = 16, 250_000

#: Elements that part blocks of text, elements without end tag, elements whose content is no markup.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea svg object video audio canvas".split())
#: Elements that an element of the same kind ends when it starts, and what keeps it from reaching further up.
CLOSES = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
CLOSES = {k: (frozenset(v[0].split()), frozenset(v[1])) for k, v in CLOSES.items()}
#: Blocks before which an open paragraph ends.
ENDS_P = BLOCKS - frozenset("button caption head html body legend li dt dd option optgroup td th tr tbody thead tfoot title iframe noscript template".split())
#: Elements and words in class, id or role that hold something else than the article.
OTHER_TAGS = frozenset("nav footer aside form script style noscript iframe template button select dialog head menu search textarea svg object video audio canvas".split())
OTHER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer foot sidebar aside ad ads adv advert adverts advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription comment comments reply replies respond disqus "
    "discussion social share sharing related recommended recommendations form login signup search widget alert complementary contentinfo navigation".split()
)
#: Inside an article only these count, as whole names in class or role, and not on elements of running text; an id there names a part of the text.
OTHER_IN_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored navbar breadcrumb breadcrumbs newsletter subscribe comment comments disqus share sharing".split()
)
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th caption".split())
PAGE_HEAD = frozenset("header head topbar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")


class Page:
    """Block elements of a page in document order: label, parent, whether inside an article or main element, whether it
    holds something else; and the page's blocks of text, each with its element."""

    def __init__(self, source: str):
        self.labels, self.parents, self.inside, self.other = ["#"], [-1], [0], [False]
        self.blocks: list[tuple[int, str]] = []
        self._found = False
        self._parse(source)

    def _open(self, tag: str, rest: str, parent: int) -> int:
        words, names, hidden = [], set(), False
        for name, value in NAMES.findall(rest) if rest else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words += WORDS.findall(value)
                if name != "id":
                    names.update(value.split())
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
        inside = self.inside[parent] | (2 if tag == "article" else 1 if tag == "main" or "main" in words else 0)
        around = self.other[parent]
        if tag in ("html", "body"):
            words, names = [], set()  # they say what the page has somewhere
        elif tag in ("article", "main") and not self._found:
            self._found, around = True, False  # so do the names of what holds the first article
        other = around or hidden or tag in OTHER_TAGS or not (tag in RUNNING or OTHER_IN_ARTICLE.isdisjoint(names) if self.inside[parent] & 2 else OTHER_WORDS.isdisjoint(words))
        other = other or not inside & 2 and (tag == "header" or not PAGE_HEAD.isdisjoint(words))
        self.labels.append(".".join([tag, *sorted(set(words))]))
        self.parents.append(parent)
        self.inside.append(inside)
        self.other.append(bool(other))
        return len(self.labels) - 1

    def _parse(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("#", 0)]
        text: list[str] = []
        at = 0

        def end_block() -> None:
            if text:
                block = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if block:
                    self.blocks.append((open_[-1][1], block))

        def leave(depth: int) -> None:
            end_block()
            del open_[depth:]

        found = TAG.search(source)
        while found:
            if found.start() > at:
                text.append(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag:
                tag = tag.lower()
                if found[1]:
                    for depth in range(len(open_) - 1, 0, -1):
                        if open_[depth][0] == tag:
                            leave(depth)
                            break
                    if tag == "p":
                        end_block()
                elif tag in RAW:
                    if not found[3].endswith("/"):
                        close = re.compile(rf"</{tag}(?:\s[^>]*)?>", re.I).search(source, at)
                        at = close.end() if close else len(source)
                elif tag == "br":
                    text.append(" ")
                else:
                    block = tag in BLOCKS
                    if block:
                        end_block()
                        kinds, stops = CLOSES.get(tag, (frozenset(), frozenset()))
                        for depth in range(len(open_) - 1, 0, -1):
                            name = open_[depth][0]
                            if name == "p" and tag in ENDS_P or name in kinds:
                                leave(depth)
                                break
                            if name in stops or name in BLOCKS and name not in ("p",) and not kinds:
                                break
                    rest = found[3]
                    if tag not in VOID and (block or "class" in rest or "id" in rest or "hidden" in rest or "style" in rest or "role" in rest):
                        node = self._open(tag, rest, open_[-1][1])
                        if block or self.other[node] != self.other[self.parents[node]]:
                            if not block:
                                end_block()
                            open_.append((tag, node))
                        else:  # an inline element that changes nothing
                            for column in (self.labels, self.parents, self.inside, self.other):
                                column.pop()
            found = TAG.search(source, at)
        if at < len(source):
            text.append(source[at:])
        end_block()


#: A tree: the parent of each node, and its label, in document order; node 0 is the root.
Nodes = tuple[list[int], list[str]]


def folded(page: Page) -> tuple[Nodes, list[int]]:
    """The tree with runs of like siblings as one node, and the folded node of each element."""
    place, last = [0] * len(page.labels), {}
    parents, labels = [-1], ["#"]
    for k in range(1, len(page.labels)):
        parent = place[page.parents[k]]
        before = last.get(parent)
        if before is not None and labels[before] == page.labels[k]:
            place[k] = before
        else:
            place[k] = last[parent] = len(labels)
            parents.append(parent)
            labels.append(page.labels[k])
    return (parents, labels), place


class Tree:
    def __init__(self, nodes: Nodes):
        self.parents, self.labels = nodes
        self.children: list[list[int]] = [[] for _ in self.labels]
        for k, parent in enumerate(self.parents):
            if parent >= 0:
                self.children[parent].append(k)


def _next_row(above: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The next row of a table of best chains: with one more left sibling, whose weights with the right ones are ``own``."""
    row = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + own), out=row[1:])
    return row


def _chain(count: int, width: int, own: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """The heaviest pairs of siblings that keep their order. Some rows of the table are kept, the ones between are made again on the way back."""
    step = max(isqrt(count), SIBLING_PAIRS // (width + 1), 1)
    kept, row = [], np.zeros(width + 1, np.int64)
    for i in range(count):
        if i % step == 0:
            kept.append(row)
        row = _next_row(row, own(i))
    pairs, i, j = [], count, width
    while i and j:
        start = (i - 1) // step * step
        rows = [kept[start // step]]
        for k in range(start, i):
            rows.append(_next_row(rows[-1], own(k)))
        while i > start and j:
            if rows[i - start][j] == rows[i - start - 1][j]:
                i -= 1
            elif rows[i - start][j] == rows[i - start][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return pairs


class Matcher:
    """Simple tree matching of two trees. Equal subtrees are one kind, and weights are found once for two kinds."""

    def __init__(self, a: Tree, b: Tree):
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.heights: list[int] = []
        self.of_a, self.of_b = self._kinds(a), self._kinds(b)
        self.weight: dict[tuple[int, int], int] = {}
        self.chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _kinds(self, tree: Tree) -> list[int]:
        kinds = [0] * len(tree.labels)
        for k in range(len(tree.labels) - 1, -1, -1):  # parents come first
            below = tuple(kinds[c] for c in tree.children[k])
            kinds[k] = self.numbers.setdefault((tree.labels[k], below), len(self.labels))
            if kinds[k] == len(self.labels):
                self.labels.append(tree.labels[k])
                self.children.append(below)
                self.heights.append(1 + max((self.heights[c] for c in below), default=0))
        return kinds

    def _by_label(self, kinds: tuple[int, ...], inner: bool) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for k in dict.fromkeys(kinds):
            if self.children[k] or not inner:
                found.setdefault(self.labels[k], []).append(k)
        return found

    def _rows(self, x: int, y: int) -> tuple[int, int, Callable[[int], np.ndarray]]:
        """Numbers of children of two kinds, and the weights of a left child with each right one."""
        left, right = self.children[x], self.children[y]
        places: dict[int, list[int]] = {}
        for j, k in enumerate(right):
            places.setdefault(k, []).append(j)
        places = {k: np.array(v) for k, v in places.items()}
        alike = self._by_label(right, inner=False)

        def own(i: int) -> np.ndarray:
            row = np.zeros(len(right), np.int64)
            for k in alike.get(self.labels[left[i]], ()):
                row[places[k]] = self.weight.get((left[i], k), 1)  # only the nodes themselves where one has no children
            return row

        return len(left), len(right), own

    def weigh(self) -> None:
        todo = [(self.of_a[0], self.of_b[0])]
        met = set(todo)
        for x, y in todo:
            right = self._by_label(self.children[y], inner=True)
            for label, kinds in self._by_label(self.children[x], inner=True).items():
                new = {(u, v) for u in kinds for v in right.get(label, ())} - met
                met |= new
                todo += new
        for x, y in sorted(todo, key=lambda pair: self.heights[pair[0]]):
            count, width, own = self._rows(x, y)
            row = np.zeros(width + 1, np.int64)
            for i in range(count):
                row = _next_row(row, own(i))
            self.weight[x, y] = 1 + int(row[-1])

    def pairs(self, x: int, y: int) -> list[tuple[int, int]]:
        """Places of the children that are matched under two matched nodes."""
        if not self.children[x] or not self.children[y]:
            return []
        if (x, y) not in self.chosen:
            self.chosen[x, y] = _chain(*self._rows(x, y))
        return self.chosen[x, y]


def tree_matching(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Largest set of node pairs with equal labels that keeps ancestors and the order of siblings (simple tree matching).

    Kinds of subtrees are weighed bottom up, without recursion, so trees may have any depth, and by rows of a table, so
    sibling lists may have any length.
    """
    if a.labels[0] != b.labels[0]:
        return []
    matcher = Matcher(a, b)
    matcher.weigh()
    result = [(0, 0)]
    for x, y in result:
        left, right = a.children[x], b.children[y]
        result += [(left[i], right[j]) for i, j in matcher.pairs(matcher.of_a[x], matcher.of_b[y])]
    return result


def merged(a: Nodes, b: Nodes) -> Nodes:
    """The tree with the nodes of both, aligned ones once; a node of ``b`` alone comes after its aligned left sibling."""
    left, right = Tree(a), Tree(b)
    partner = {y: x for x, y in tree_matching(left, right)}
    if len(partner) == len(right.labels):
        return a
    parents, labels = list(left.parents), list(left.labels)
    children = [list(c) for c in left.children]
    at = dict(partner)
    for y in range(len(right.labels)):  # parents come first
        after = 0  # the place behind the last sibling that is in the merged tree
        for v in right.children[y]:
            above = children[at[y]]
            if v in at:
                after = above.index(at[v]) + 1
                continue
            at[v] = len(labels)
            parents.append(at[y])
            labels.append(right.labels[v])
            children.append([])
            above.insert(after, at[v])
            after += 1
    order, stack = [], [0]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(reversed(children[x]))
    number = {x: k for k, x in enumerate(order)}
    return [number[parents[x]] if parents[x] >= 0 else -1 for x in order], [labels[x] for x in order]


def layout_of(nodes: Nodes) -> int:
    """A hash of the page's outer nodes, each with the labels on its path."""
    found, depths = [], []
    for parent, label in zip(*nodes):
        found.append(xxhash.xxh64_intdigest(f"{found[parent] if parent >= 0 else 0}/{label}") >> 1)
        depths.append(depths[parent] + 1 if parent >= 0 else 0)
    return xxhash.xxh64_intdigest(repr(sorted({p for p, d in zip(found, depths) if d <= LAYOUT_DEPTH}))) >> 1 or 1


def own_blocks(page: Page) -> list[tuple[int, str]]:
    """Blocks that tags and names leave to the article."""
    own = [(node, text) for node, text in page.blocks if not page.other[node]]
    needed = next((n for n in (2, 1) if any(page.inside[node] & n for node, _ in own)), 0)
    return [(node, text) for node, text in own if not needed or page.inside[node] & needed]


def page_votes(blocks: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(node, text, content) of each folded node of the article.

    ``text`` hashes what stands there, ``content`` the other long texts: those of at least a quarter of the longest. Pages
    that are equal in both are copies for this node, whatever adverts or time stamps do.
    """
    texts: dict[int, list[str]] = {}
    for node, text in blocks:
        texts.setdefault(node, []).append(text)
    joined = {node: "\n".join(t) for node, t in texts.items()}
    hashes = {node: xxhash.xxh64_intdigest(t) >> 1 for node, t in joined.items()}
    ranked = sorted(joined, key=lambda node: -len(joined[node]))
    votes = []
    for node in ranked:
        longest = len(joined[ranked[node == ranked[0]]]) if len(ranked) > 1 else 0
        rest = []
        for other in ranked:
            if 4 * len(joined[other]) < longest:
                break
            if other != node:
                rest.append(hashes[other])
        votes.append((node, hashes[node], xxhash.xxh64_intdigest(repr(sorted(rest))) >> 1))
    return votes


def main_text(page: Page) -> str:
    """The page's text where its host has no template: the blocks that belong to the article, in page order."""
    return "\n".join(text for _, text in own_blocks(page))


TREE = "tree long, parents array<int>, labels array<string>"
VOTES = f"host string, layout long, {TREE}, votes array<struct<node:int,text:long,content:long>>"
BLOCKS_OF = "page_id long, url string, host string, layout long, tree long, blocks array<struct<node:int,text:string>>"


def _read(source: str | None) -> tuple[Nodes, int, list[tuple[int, str]]]:
    """A page's tree with a hash of it, and its blocks by folded node."""
    page = Page(source or "")
    nodes, place = folded(page)
    return nodes, xxhash.xxh64_intdigest(repr(nodes)) >> 1, [(place[k], own) for k, own in own_blocks(page)]


def _votes(rows: DataFrame) -> DataFrame:
    """Each page's tree and votes, without its texts."""
    node, number = pa.int32(), pa.int64()
    kinds = [number, number, pa.list_(node), pa.list_(pa.string()), pa.list_(pa.struct([("node", node), ("text", number), ("content", number)]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in kinds]
            for source in batch.column(1):
                nodes, tree, blocks = _read(source.as_py())
                votes = [dict(zip(("node", "text", "content"), v)) for v in page_votes(blocks)]
                for column, value in zip(columns, (layout_of(nodes), tree, *nodes, votes)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["host", "layout", "tree", "parents", "labels", "votes"])

    return rows.select("host", "html").mapInArrow(run, VOTES)


def _blocks(rows: DataFrame) -> DataFrame:
    """Each page's blocks, with the hashes that name its tree and layout."""
    number, block = pa.int64(), pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, trees, texts = [], [], []
            for source in batch.column(3):
                nodes, tree, blocks = _read(source.as_py())
                layouts.append(layout_of(nodes))
                trees.append(tree)
                texts.append([{"node": n, "text": t} for n, t in blocks])
            arrays = [*batch.columns[:3], pa.array(layouts, number), pa.array(trees, number), pa.array(texts, block)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "layout", "tree", "blocks"])

    return rows.select("page_id", "url", "host", "html").mapInArrow(run, BLOCKS_OF)


def _merged_group(group: pa.Table) -> pa.Table:
    """One tree from the trees of a group, the largest first, so that the result doesn't depend on where rows lay."""
    trees = sorted(zip(group["parents"].to_pylist(), group["labels"].to_pylist()), key=lambda t: (-len(t[1]), t))
    nodes = reduce(merged, trees)
    tree = xxhash.xxh64_intdigest(repr(nodes)) >> 1
    return pa.table(
        [group["host"].combine_chunks()[:1], pa.array([tree], pa.int64()), pa.array([nodes[0]], pa.list_(pa.int32())), pa.array([nodes[1]], pa.list_(pa.string()))],
        names=["host", "tree", "parents", "labels"],
    )


def wrappers(trees: DataFrame) -> DataFrame:
    """(host, parents, labels): one merged tree for each host, from its different trees (host, tree, parents, labels).

    Each round merges about FAN_IN trees of a host in one group; the rounds grow with the logarithm of the most trees of a host.
    """
    while True:
        counts = trees.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
        most = counts.agg(F.max("of_host")).head()[0] or 0
        if most <= 1:
            return trees.select("host", "parents", "labels")
        dealt = trees.join(counts, "host").withColumn("group", F.pmod(F.xxhash64("tree"), F.ceil(F.col("of_host") / FAN_IN)))
        # A group of one stays as it is; in the last round all of a host are one group.
        trees = materialize(dealt.select("host", "tree", "parents", "labels", "group").groupBy("host", "group").applyInArrow(_merged_group, f"host string, {TREE}"), "merged-trees")


def alignments(trees: DataFrame, whole: DataFrame) -> DataFrame:
    """(host, layout, tree, nodes): for each node of a tree its node in the host's wrapper, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for own, labels, of_host, host_labels in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6))):
                partner = dict(tree_matching(Tree((own, labels)), Tree((of_host, host_labels))))
                nodes.append([partner.get(k, -1) for k in range(len(labels))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.list_(pa.int32()))], names=["host", "layout", "tree", "nodes"])

    other = whole.select("host", F.col("parents").alias("host_parents"), F.col("labels").alias("host_labels"))
    both = trees.join(other, "host").select("host", "layout", "tree", "parents", "labels", "host_parents", "host_labels")
    return both.mapInArrow(run, "host string, layout long, tree long, nodes array<int>")


def templates(votes: DataFrame) -> DataFrame:
    """(host, scope, node) of the wrapper nodes with a constant text, from votes (host, layout, node, text, content); scope 0 is the whole host."""
    scoped = votes.select("host", F.explode(F.array(F.lit(0).cast("long"), "layout")).alias("scope"), "node", "text", "content")
    # Copies vote once; then texts of a node are counted, and the commonest against all.
    texts = scoped.distinct().groupBy("host", "scope", "node", "text").agg(F.count(F.lit(1)).alias("n"))
    seen = texts.groupBy("host", "scope", "node").agg(F.sum("n").alias("seen"), F.max("n").alias("same"))
    return seen.where((F.col("seen") >= MIN_PAGES) & (F.col("same") >= F.col("seen") * SAME)).select("host", "scope", "node")


def _length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.char_length(b["text"]))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every row.

    Null and empty html give an empty text. Pages without a host in their url share one. A host with fewer than MIN_PAGES
    different pages has no template, so tags and names alone decide there. A template that would take more at one
    node than it leaves takes the article itself, as on a host of copies; such a page keeps all its blocks. Repeated rows are extracted
    each; ids may be null. An empty table gives no row. Other columns aren't read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host, F.col(html_col).alias("html"))
    parsed = materialize(_votes(rows), "page-votes")
    trees = parsed.groupBy("host", "layout", "tree").agg(F.first("parents").alias("parents"), F.first("labels").alias("labels"))
    trees = materialize(trees, "trees")
    aligned = materialize(alignments(trees, wrappers(trees)), "alignments")

    page_votes_ = parsed.select("host", "layout", "tree", F.explode("votes").alias("v")).select("host", "layout", "tree", "v.*").distinct()
    # One row a tree on the right: node 0 of "nodes" is the root.
    on_wrapper = page_votes_.join(aligned, ["host", "layout", "tree"]).withColumn("node", F.get("nodes", F.col("node"))).where("node >= 0")
    constant = materialize(templates(on_wrapper.select("host", "layout", "node", "text", "content")), "templates")

    # The verdict on a tree's own nodes: those whose wrapper node is constant for the host or for the tree's layout.
    own = aligned.select("host", "layout", "tree", F.posexplode("nodes").alias("place", "node")).where("node >= 0")
    scoped = own.withColumn("scope", F.explode(F.array(F.lit(0).cast("long"), "layout")))
    verdict = scoped.join(constant, ["host", "scope", "node"]).groupBy("host", "layout", "tree").agg(F.collect_set("place").alias("taken"))
    verdict = materialize(verdict, "template-places")  # written, so that Spark knows its size and need not deal out pages where it is small
    met = _blocks(rows).join(verdict, ["host", "layout", "tree"], "left")

    is_taken = lambda b: F.array_contains(F.col("taken"), b["node"])
    kept = F.when(F.col("taken").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~is_taken(b)))
    most = F.array_max(F.transform("taken", lambda n: _length(F.filter("blocks", lambda b: b["node"] == n))))
    met = met.withColumn("kept", kept).withColumn("most", F.coalesce(most, F.lit(0)))
    final = F.when(F.col("most") <= _length(F.col("kept")), F.col("kept")).otherwise(F.col("blocks"))
    text = F.array_join(F.transform(final, lambda b: b["text"]), "\n").alias("text")
    return met.select("page_id", "url", text).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
