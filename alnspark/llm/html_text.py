"""Operator 3: main text of web pages by a tree-structured graphical model.

A page becomes its tree of elements and text runs.  Every node is content or not; node potentials come from tag, class words,
lengths and links, edge potentials couple a node with its parent by the kind of the node.  Sum-product messages
run from the leaves to the roots and back, for all pages of a batch and one depth of the trees at a time, and give
every node its exact marginal.  The potentials are fitted to labelled pages by the gradient of the likelihood, which
takes the same messages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices
from .training_pages import CLOSE, OPEN, labelled_pages

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video".split()
)
#: An opening tag ends these open elements, up to the nearest of the second set.
ENDS_P = BLOCK - {"br", "button", "body", "caption", "head", "html", "legend", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "video", "canvas", "iframe"}
KEEPS_P = ("td", "th", "button", "table", "li", "div", "article", "section")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: An element with a whole class, id or role of this form holds readers' comments, also where it is marked up as an article.
REMARK = re.compile(r"(?:[a-z]+-)?(?:comments?|repl(?:y|ies)|responses?|discussions?)(?:-(?:body|box|content|item|list|text|thread|\d+))?")
WEIGHTS = 1 << 14
BATCH_BYTES = 1 << 20
TEXT = "#text"


class Tree:
    """Nodes in page order: parent, tag, class words, and the raw text and block number of text nodes."""

    __slots__ = ("block", "parent", "tag", "text", "words")

    def __init__(self):
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.words: list[str] = []
        self.text: list[str] = []
        self.block: list[int] = []

    def add(self, parent: int, tag: str, words: str = "", text: str = "", block: int = 0) -> int:
        for name, x in zip(("parent", "tag", "words", "text", "block"), (parent, tag, words, text, block), strict=True):
            getattr(self, name).append(x)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    """The tree of a page; what is never shown (comments, scripts, styles, embedded objects) is left out."""
    tree, at, block, last, gap = Tree(), 0, 0, -1, False
    stack = [tree.add(-1, "#page")]

    def put(raw: str) -> None:
        """A text node; a blank run is given to its neighbours in the block, whichever of them is content."""
        nonlocal last, gap
        near = last >= 0 and tree.block[last] == block
        if raw and not raw.isspace():
            last = tree.add(stack[-1], TEXT, text=" " + raw if near and gap else raw, block=block)
            gap = False
        elif raw:
            gap = True
            if near:
                tree.text[last] += " "

    #: Where on the stack the open elements of each tag are, so that none is searched for.
    opened: dict[str, list[int]] = {}

    def nearest(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(to: int) -> None:
        while len(stack) > to:
            opened[tree.tag[stack.pop()]].pop()

    while at < len(page):
        m = TOKEN.search(page, at)
        put(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block += tag in BLOCK
        if m[1]:
            if to := nearest((tag,)):
                close(to)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in ENDS_P and (to := nearest(("p",))) > nearest(KEEPS_P):
            close(to)
        while tag in CLOSED_BY and (to := nearest(CLOSED_BY[tag])) > nearest(SCOPE[tag]):
            close(to)
            if tag != "tr" or tree.tag[stack[-1]] not in CLOSED_BY[tag]:
                break
        words = " ".join(x for a in ATTRIBUTE.findall(m[3]) for x in (a[1] or a[2] or a[3]).lower().split())
        node = tree.add(stack[-1], tag, words)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return tree


@lru_cache(maxsize=1 << 16)
def named(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % WEIGHTS


@lru_cache(maxsize=1 << 14)
def class_features(words: str) -> tuple[int, ...]:
    """Whole names, and the parts of compound ones apart from them: a part says less."""
    names = sorted(set(words.split()))
    parts = sorted({p for w in names for p in re.split(r"[^a-z0-9]+", w) if p and p != w})
    return tuple(named("c:" + w) for w in names) + tuple(named("cp:" + p) for p in parts)


def bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def kind_of(tag: str) -> str:
    """Elements within a line other than links and parts of forms are one kind, whatever they are called."""
    return tag if tag in BLOCK or tag in ("a", "label", "input", "ins", TEXT, "#page") else "#line"


class Forest:
    """Trees side by side with their features, ready for messages."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tag) for t in trees]
        base = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if trees else np.zeros(0, np.int64)
        self.n = int(sum(sizes))
        self.parent = np.full(self.n, -1, np.int64)
        depth = np.zeros(self.n, np.int64)
        self.edge = np.zeros(self.n, np.int64)
        of, feature = [], []
        for t, start in zip(trees, base.tolist(), strict=True):
            n = len(t.tag)
            chars, links, level, inside, kept = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
            for k in range(n):
                p = t.parent[k]
                if p >= 0:
                    level[k] = level[p] + 1
                    inside[k] = inside[p] or (t.tag[k] in ("article", "main") and not any(map(REMARK.fullmatch, t.words[k].split())))
                    kept[k] = kept[p] or t.tag[k] == "a"
            for k in range(n - 1, -1, -1):  # children stand after their parents
                if t.tag[k] == TEXT:
                    chars[k] = len(t.text[k].strip())
                    links[k] = chars[k] if kept[k] else 0
                if t.parent[k] >= 0:
                    chars[t.parent[k]] += chars[k]
                    links[t.parent[k]] += links[k]
            has = any(inside)
            for k in range(n):
                p = t.parent[k]
                tag = kind_of(t.tag[k])
                up = kind_of(t.tag[p]) if p >= 0 else ""
                names = [f"t:{tag}", f"tp:{tag}:{up}", f"l:{tag == TEXT}:{bucket(chars[k])}", f"d:{tag == TEXT}:{4 * links[k] // max(1, chars[k])}", f"i:{has}:{inside[k]}:{tag == TEXT}", f"p:{tag == TEXT}:{up}"]
                if tag == TEXT:
                    names.append(f"e:{t.text[k].rstrip()[-1:] in '.!?'}:{bucket(chars[k])}")
                found = [named(x) for x in names]
                if tag != TEXT and t.words[k]:
                    found += class_features(t.words[k])
                of += [start + k] * len(found)
                feature += found
                if p >= 0:
                    self.parent[start + k] = start + p
                self.edge[start + k] = named("e:" + tag)
            depth[start : start + n] = level
        self.of, self.feature = np.array(of, np.int64), np.array(feature, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def normal(x: np.ndarray) -> np.ndarray:
    return x - np.logaddexp(x[:, :1], x[:, 1:])


def marginals(forest: Forest, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-marginals of each node, and the joint ones with its parent (parent label, own label)."""
    local = np.zeros((forest.n, 2))
    local[:, 1] = np.bincount(forest.of, weights=weight[forest.feature], minlength=forest.n)
    edges = pair[forest.edge]  # (node, parent label, own label)
    up = local.copy()
    sent = np.zeros((forest.n, 2))
    for nodes in forest.levels[:0:-1]:
        up[nodes] = normal(up[nodes])
        sent[nodes] = np.logaddexp(edges[nodes, :, 0] + up[nodes, :1], edges[nodes, :, 1] + up[nodes, 1:])
        above, at = np.unique(forest.parent[nodes], return_inverse=True)
        for y in (0, 1):
            up[above, y] += np.bincount(at, weights=sent[nodes, y])
    joint = np.zeros((forest.n, 2, 2))
    belief = np.zeros((forest.n, 2))
    for depth, nodes in enumerate(forest.levels):
        if depth == 0:
            belief[nodes] = normal(up[nodes])
            continue
        above = belief[forest.parent[nodes]] - sent[nodes]  # what the parent knows without this child
        j = above[:, :, None] + edges[nodes] + up[nodes][:, None, :]
        top = j.max(axis=(1, 2), keepdims=True)
        j -= top + np.log(np.exp(j - top).sum(axis=(1, 2), keepdims=True))
        joint[nodes] = j
        belief[nodes] = np.logaddexp(j[:, 0, :], j[:, 1, :])
    return belief, joint


def read_labels(tree: Tree) -> np.ndarray:
    """Labels from the marks in a training page's text, which are taken out: an element is content if half of its characters are."""
    n = len(tree.tag)
    good, every = np.zeros(n), np.zeros(n)
    for k in range(n - 1, -1, -1):
        if tree.tag[k] == TEXT:
            every[k] = len(tree.text[k])
            good[k] = every[k] if OPEN in tree.text[k] else 0
            tree.text[k] = tree.text[k].replace(OPEN, "").replace(CLOSE, "")
        if tree.parent[k] >= 0:
            good[tree.parent[k]] += good[k]
            every[tree.parent[k]] += every[k]
    return ((good > 0) & (2 * good >= every)).astype(np.int64)


class ExtractionModel:
    def __init__(self, steps: int = 100, rate: float = 0.12, penalty: float = 3e-4):
        self.steps, self.rate, self.penalty = steps, rate, penalty
        self.weight, self.pair = np.zeros(WEIGHTS), np.zeros((WEIGHTS, 2, 2))

    def fit(self, pages: list[str]) -> ExtractionModel:
        """Adam on the likelihood of the labels; expected features are exact, from the marginals."""
        trees = [parse(p) for p in pages]
        labels = np.concatenate([read_labels(t) for t in trees])
        forest = Forest(trees)
        below = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((WEIGHTS, 2, 2))
        np.add.at(seen, (forest.edge[below], labels[forest.parent[below]], labels[below]), 1)
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.weight, self.pair)]
        for step in range(1, self.steps + 1):
            belief, joint = marginals(forest, self.weight, self.pair)
            miss = labels - np.exp(belief[:, 1])
            p = np.exp(joint[below])
            expected = np.stack([np.bincount(forest.edge[below], weights=p[:, a, b], minlength=WEIGHTS) for a in (0, 1) for b in (0, 1)], axis=1).reshape(-1, 2, 2)
            slopes = (np.bincount(forest.feature, weights=miss[forest.of], minlength=WEIGHTS), seen - expected)
            for x, slope, (m, v) in zip((self.weight, self.pair), slopes, state, strict=True):
                slope = slope / len(pages) - self.penalty * x
                m *= 0.9
                m += 0.1 * slope
                v *= 0.999
                v += 0.001 * slope**2
                x += self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def texts(self, pages: list[str]) -> list[str]:
        """Main text of each page: content text in page order, references decoded, white space within a block made one space, blocks joined by one."""
        trees = [parse(p) for p in pages]
        content = marginals(Forest(trees), self.weight, self.pair)[0]
        content = content[:, 1] > content[:, 0]
        out, start = [], 0
        for t in trees:
            blocks: list[list[str]] = []
            last = None
            for k in range(len(t.tag)):
                if t.tag[k] == TEXT and content[start + k]:
                    if t.block[k] != last:
                        blocks.append([])
                        last = t.block[k]
                    blocks[-1].append(html.unescape(t.text[k]))  # a reference ends with its run of text
            start += len(t.tag)
            lines = (" ".join("".join(b).split()) for b in blocks)
            out.append(" ".join(line for line in lines if line))
        return out


@lru_cache(maxsize=1)
def default_model() -> ExtractionModel:
    return ExtractionModel().fit(labelled_pages())


def main_text(pages: DataFrame, model: ExtractionModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars (code points of the text).

    A null or empty page, and one without an article, has the empty text.  Markup may be broken: missing end tags are
    implied or end with the page, stray ones are ignored, and what looks like no tag is text.  Repeated and null ids are
    read row by row, pages whole.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())
    chosen = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = [f.dataType.simpleString() for f in chosen.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in text_slices(batch, 2, BATCH_BYTES):
                texts = held.value.texts(raw)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return chosen.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
