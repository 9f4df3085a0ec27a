"""Problem 4: main body against page furniture, by a tree-structured graphical model.

The nodes of a page form the tree that its Markdown or text still shows of the document's elements: page, blocks (between
blank lines), lines, and list items below the line that heads them. Each node is main body or furniture. Lines carry a
potential from their words, shape and place; parent and child are tied by potentials that depend on the kind of edge.
One upward and one downward pass of sum-product messages give each line's marginal.

Potentials of lines and edges are trained together, by gradients of the likelihood through the same messages (blocks and
pages are hidden nodes), from all raw pages and all records:

* raw pages, whose elements say what they hold (article, main, ... against nav, footer, notices);
* records: lines that recur in ``RECUR`` of them (in larger tables, in as large a share as ``RECUR`` of ``SHARD``) are
  furniture, and so are the items below such a line that are no sentences; of those that stand in one only (in one of
  ``SHARD``), long lines of sentences, items that are sentences or stand below no line and link nowhere, quotes, rows of
  tables and the line that the record's ``metadata.title`` gives are main body; all other lines are hidden, labelled by
  the messages only.

Lines are counted over all records. Pages and records are dealt by their ids to shards of about ``SHARD``; each shard is
fitted where it lies, and the model is the mean of the shards', weighted by their labels.

Defined cases: null and blank contents and blank lines have no rows; code fences are main body; records of the
residue and spam operators have no rows; repeated deliveries give equal rows, which count once; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators import dom
from . import spam
from .coded import DATA, KINDS, LIST, PAIRED, PLACE_KEYS, PLACES, Coded, distinct, ends_sentence, feature_key, key, letters, ranges, shape, words_of
from .common import cut, scrapes
from .residue import ASSESSED, described_as, is_case, weighed, with_evidence

#: Records (about) that are fitted together, shards to which each page is dealt (pages are fewer), and the pages and records
#: of a part of a shard, of which each round takes the next.
SHARD = 4000
COPIES = 5
PART = 500
#: Records of a shard in which a line (its letters) recurs, and the words of a line, or a list item, of sentences that is an
#: article's own.
RECUR = 6
PARAGRAPH = 25
ITEM = 5
MAIN, FURNITURE, HIDDEN = 0, 1, -1

def features(line: str) -> list[str]:
    """The features of a line, each once, in a fixed order."""
    words = words_of(line)
    if len(words) <= PAIRED:
        padded = ["^", *words, "$"]
        return [*dict.fromkeys(words), *dict.fromkeys(f"{a} {b}" for a, b in zip(padded, padded[1:])), *shape(line, len(words))]
    return [*dict.fromkeys(words), *shape(line, len(words))]


class Line:
    """A non-blank line: its number, text, parent in the tree (an earlier line, or -1 for its block) and place."""

    __slots__ = ("no", "text", "block", "parent", "kind", "place", "fenced")

    def __init__(self, no: int, text: str, block: int, parent: int, kind: str, fenced: bool):
        self.no, self.text, self.block, self.parent, self.kind, self.fenced, self.place = no, text, block, parent, kind, fenced, ()


def tree(content: str) -> list[Line]:
    """The lines of a page with their place in the tree."""
    out: list[Line] = []
    block, fresh, fence, head = -1, True, False, -1
    for no, text in enumerate(content.split("\n"), 1):
        s = text.strip()
        if not s and not fence:
            fresh = True
            continue
        if fresh:
            block, fresh, head = block + 1, False, -1
        if s.startswith("```"):
            fence = not fence
            out.append(Line(no, s, block, -1, "block", True))
            continue
        if not s:
            continue
        if not fence and LIST.match(s):
            out.append(Line(no, s, block, head, "item" if head >= 0 else "loose", False))
        else:
            if not fence:
                head = len(out)
            out.append(Line(no, s, block, -1, "block", fence or bool(DATA.match(s))))
    if out:
        blocks = out[-1].block + 1
        sizes = Counter(x.block for x in out)
        for k, x in enumerate(out):
            back = len(out) - 1 - k
            x.place = (
                "@top" + str(k) if k < 4 else "@mid",
                "@bottom" + str(min(back, 6)) if back < 7 else "@far",
                "@block" + str(min(x.block, 2)) + ("l" if x.block == blocks - 1 else ""),
                "@size" + str(min(4, sizes[x.block])),
            )
    return out


class Model:
    """Weights of the line features, under their keys, and potentials of the edges; ``chain`` judges spam."""

    def __init__(self, weights: dict[str, float] | tuple[np.ndarray, np.ndarray], edges: dict[str, tuple[float, ...]], bias: float, chain: spam.Chain | None = None):
        if isinstance(weights, dict):
            weights = np.array([feature_key(f) for f in weights], dtype=np.uint64), np.array(list(weights.values()), dtype=float)
        order = np.argsort(weights[0])
        self.keys, self.values = weights[0][order], weights[1][order]
        self.edges, self.bias, self.chain = edges, bias, chain or spam.Chain()

    def weights(self, keys: np.ndarray) -> np.ndarray:
        """The weights of features by their keys."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)

    def potential(self, line: Line) -> float:
        """Log odds of furniture from the line alone."""
        if line.fenced:
            return -12.0
        got = self.bias + float(self.weights(np.array([feature_key(f) for f in (*features(line.text), *line.place)], dtype=np.uint64)).sum())
        return max(-12.0, min(12.0, got))

    def beliefs(self, coded: Coded) -> np.ndarray:
        """Log odds of furniture of each line of many records, as :meth:`marginals` has them for one."""
        if not len(coded.which):
            return np.zeros(0)
        texts = np.bincount(coded.rows, weights=self.weights(coded.keys)[coded.codes], minlength=coded.n_texts)
        own = np.clip(self.bias + texts[coded.which] + self.weights(PLACE_KEYS)[coded.places].sum(axis=1), -12, 12)
        own[coded.fenced] = -12.0
        return Forest.of(coded).beliefs(own, np.log(np.array([self.edges[k] for k in KINDS]).reshape(4, 2, 2)))[0]

    def marginals(self, lines: list[Line]) -> list[float]:
        """P(furniture) of each line by sum-product messages, up from the items to the page and down again.
        Messages are pairs kept as their log ratio (furniture against main)."""
        n = len(lines)
        if not n:
            return []
        own = [self.potential(x) for x in lines]
        blocks = lines[-1].block + 1
        up = [0.0] * n  # messages to the parent of each line
        total = own[:]  # own potential and messages from below
        at_block = [0.0] * blocks
        # list items first (they come after their heads, so a backward sweep meets children before parents)
        for k in range(n - 1, -1, -1):
            x = lines[k]
            up[k] = self._pass(x.kind, total[k], True)
            if x.parent >= 0:
                total[x.parent] += up[k]
            else:
                at_block[x.block] += up[k]
        block_up = [self._pass("page", b, True) for b in at_block]
        page = sum(block_up)
        belief_block = [at_block[b] + self._pass("page", page - block_up[b], False) for b in range(blocks)]
        belief = [0.0] * n
        for k, x in enumerate(lines):
            above = (belief[x.parent] if x.parent >= 0 else belief_block[x.block]) - up[k]
            belief[k] = total[k] + self._pass(x.kind, above, False)
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]

    def furniture(self, content: str) -> frozenset[int]:
        """Numbers of the lines of ``content`` that are not main body."""
        return self.furnitures([content])[0]

    def furnitures(self, contents: list[str]) -> list[frozenset[int]]:
        """``furniture`` of many records."""
        return self.furniture_of(Coded(contents))

    def furniture_of(self, coded: Coded) -> list[frozenset[int]]:
        """``furniture`` of coded records."""
        gone = self.beliefs(coded) > 0
        ends = np.cumsum(coded.sizes)
        nos = np.where(gone, coded.nos, 0).tolist()
        return [frozenset(nos[a:b]) - {0} for a, b in zip((ends - coded.sizes).tolist(), ends.tolist())]

    def _pass(self, kind: str, ratio: float, upward: bool) -> float:
        """The message over an edge, as a log ratio, from the sender's ratio."""
        mm, mf, fm, ff = self.edges[kind]  # first: parent's state, second: child's
        r = math.exp(max(-30.0, min(30.0, ratio)))
        if upward:
            return math.log((fm + ff * r) / (mm + mf * r))
        return math.log((mf + ff * r) / (mm + fm * r))


# --- labelled pages ---------------------------------------------------------------------------------------------

_MAIN_TAGS = frozenset(["article", "main", "section"])
_MAIN_NAMES = re.compile(r"\b(?:post|content|entry|article|story|text)\b", re.I)
_OTHER_TAGS = frozenset(["nav", "footer", "aside", "header", "noscript"])
_OTHER_NAMES = re.compile(r"menu|\bad\b|notice|cookie|promo|banner|share|related|comment|newsletter", re.I)
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th div".split())


def _label(node: dom.Node) -> int | None:
    """Label of an element by the nearest element around it that says what it holds."""
    x = node
    while x is not None:
        name = f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}"
        if x.tag in _MAIN_TAGS or x.tag == "div" and _MAIN_NAMES.search(name):
            return MAIN
        if x.tag == "div" and _OTHER_NAMES.search(name):
            # a menu left open swallows the article: its headings and paragraphs are not the menu's
            return None if node.tag in ("p", "h1", "h2") and "menu" in name else FURNITURE
        if x.tag in ("footer", "aside", "noscript"):
            return FURNITURE
        if x.tag in ("nav", "header"):
            return FURNITURE if node.tag in ("li", "a") else None
        x = x.parent
    return None


def labelled(html: str, plain: bool = False) -> tuple[str, list[int]] | None:
    """A raw page as the lines of its elements, in Markdown or as plain text, and the label of each: an item a line, a blank
    line between elements that are not items of one list. None if the page does not hold both kinds."""
    root = dom.body(dom.parse(html))
    lines: list[tuple[str, int, object]] = []  # text, label, list it is an item of
    for node in root.elements():
        if node.tag not in _BLOCKS or any(c.tag in _BLOCKS or c.tag in ("ul", "ol", "table") for c in node.elements() if c is not node):
            continue
        label = _label(node)
        text = re.sub(r"\s+", " ", node.text()).strip()
        if label is None or not text:
            continue
        link = node.find("a") if node.tag == "li" else None
        if plain:
            pass
        elif node.tag == "li":
            text = f"- [{text}]({link.attrs.get('href') or '#'})" if link is not None else "- " + text
        elif node.tag[0] == "h" and node.tag[1:].isdigit():
            text = "#" * int(node.tag[1]) + " " + text
        lines.append((text, label, node.parent if node.tag == "li" else node))
    if len({label for _, label, _ in lines}) < 2:
        return None
    out: list[str] = []
    for k, (text, _, group) in enumerate(lines):
        if k and group is not lines[k - 1][2]:
            out.append("")
        out.append(text)
    return "\n".join(out), [label for _, label, _ in lines]


def line_key(key: str) -> int:
    """The hash under which a line's letters are counted over all records."""
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Marks:
    """What the labels of the lines of records go by: the hash of a line's letters and whether it has any, whether it is an
    item that falls with its head, and whether it is an article's own if it recurs nowhere."""

    def __init__(self, coded: Coded, titles: list[str | None]):
        heads, ends, held, items, plain, keys = [], [], [], [], [], []
        for s, n, k in zip(coded.texts, coded.words.tolist(), coded.letters):
            end, item = ends_sentence(s), bool(LIST.match(s))
            heads.append(s[0] != "#")
            ends.append(end)
            held.append(s[0] == ">" or s[0] == s[-1] == "|" or end and n >= (ITEM if item else PARAGRAPH))
            items.append(item and n >= ITEM and "](" not in s)  # if it stands below no line
            plain.append(bool(k))
            keys.append(line_key(k))
        which, parent = coded.which, coded.parent
        bools = [np.array(x, dtype=bool)[which] for x in (heads, ends, held, items, plain)]
        self.key, self.lettered = np.array(keys, dtype=np.int64)[which], bools[4]
        self.below = (parent >= 0) & bools[0][parent] & ~bools[1]
        title = np.array([line_key(letters(t or "")) for t in titles], dtype=np.int64)
        self.own = bools[2] | bools[3] & (coded.kind == KINDS.index("loose")) | (self.key == np.repeat(title, coded.sizes))

    def of(self, lines: np.ndarray) -> Marks:
        """The marks of these lines."""
        out = object.__new__(Marks)
        out.key, out.lettered, out.below, out.own = (x[lines] for x in (self.key, self.lettered, self.below, self.own))
        return out

    def keys(self, coded: Coded) -> np.ndarray:
        """The keys of each record's lines outside fences, each once a record."""
        some = self.lettered & ~coded.fenced
        record = np.repeat(np.arange(len(coded.sizes)), coded.sizes)[some]
        found = distinct(self.key[some])
        return found[distinct(record * max(1, len(found)) + np.searchsorted(found, self.key[some])) % max(1, len(found))]

    def labels(self, coded: Coded, known: tuple[np.ndarray, np.ndarray], recur: float, rare: float, unknown: int = 1) -> np.ndarray:
        """The labels of all lines, by the counts of keys (sorted)."""
        counts = np.full(len(self.key), unknown)
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], self.key), len(known[0]) - 1)
            counts = np.where(known[0][at] == self.key, known[1][at], unknown)
        counts = np.where(self.lettered, counts, 0)
        labels = np.where(self.own & (counts > 0) & (counts <= rare), MAIN, HIDDEN)
        labels[(counts >= recur) | self.below & (counts[coded.parent] >= recur)] = FURNITURE
        labels[coded.fenced] = MAIN
        return labels


def letter_hashes(contents: list[str], coded: Coded, marks: Marks) -> list[list[int | None]]:
    """For each content what :func:`lines.line_hashes` gives, a hash for each line by its letters (other signs that Python
    takes for word characters left out), null for lines without: as numbers of its own, known for the lines of ``coded``."""
    keys = np.zeros(len(coded.texts), dtype=np.int64)
    keys[coded.which] = marks.key

    def of(spelt: str) -> int | None:
        spelt = "".join(filter(str.isalpha, spelt))
        return line_key(spelt) if spelt else None

    known = {s: k if spelt.isalpha() else of(spelt) for s, k, spelt in zip(coded.texts, keys.tolist(), coded.letters)}
    out = []
    for content in contents:
        hashes = []
        for line in content.split("\n"):
            s = line.strip()
            if s not in known:
                known[s] = of(s.lower())
            hashes.append(known[s])
        out.append(hashes)
    return out


def supposed(records: list[tuple[str, str | None]], recur: float = RECUR, rare: float = 1, known: dict[int, int] | None = None) -> list[tuple[str, list[int]]]:
    """Records, given as content and title, with the label of each of their non-blank lines, as far as it can be told.
    ``known``: the counts over all records of the lines (their keys) that stand in more than ``rare``; without it, these
    records are all."""
    coded = Coded([c for c, _ in records])
    marks = Marks(coded, [t for _, t in records])
    counts = np.unique(marks.keys(coded), return_counts=True) if known is None else tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(known.items()))) or (np.zeros(0, np.int64),) * 2
    labels = marks.labels(coded, counts, recur, rare, int(known is not None)).tolist()
    ends = np.cumsum(coded.sizes).tolist()
    return [(c, labels[b - n : b]) for (c, _), n, b in zip(records, coded.sizes.tolist(), ends)]


class Forest:
    """The trees of many pages laid side by side, for passes over all of them at once."""

    def __init__(self, trees: list[list[Line]]):
        lines = [x for t in trees for x in t]
        self.kind = np.array([KINDS.index(x.kind) for x in lines], dtype=np.int64)
        self.fenced = np.array([x.fenced for x in lines], dtype=bool)
        starts = np.cumsum([0, *(len(t) for t in trees)])
        parent = np.array([x.parent for x in lines], dtype=np.int64)
        page = np.repeat(np.arange(len(trees)), [len(t) for t in trees])
        blocks = np.cumsum([0, *(t[-1].block + 1 for t in trees)])
        self.block = np.array([x.block for x in lines], dtype=np.int64) + blocks[page]
        self.page = np.repeat(np.arange(len(trees)), np.diff(blocks))  # of each block
        self.items = np.flatnonzero(parent >= 0)
        self.heads = parent[self.items] + starts[page[self.items]]
        self.tops = np.flatnonzero(parent < 0)
        self.sizes = len(lines), len(self.page), len(trees)

    @classmethod
    def of(cls, coded: Coded) -> Forest:
        """The trees of coded records."""
        out = cls.__new__(cls)
        out.kind, out.fenced, out.block = coded.kind, coded.fenced, coded.block
        out.page = np.repeat(np.arange(len(coded.sizes)), coded.blocks)
        out.items, out.tops = np.flatnonzero(coded.parent >= 0), np.flatnonzero(coded.parent < 0)
        out.heads = coded.parent[out.items]
        out.sizes = len(coded.which), len(out.page), len(coded.sizes)
        return out

    def beliefs(self, own: np.ndarray, log_edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of furniture of each line, from their own log odds and the log potentials of the edges by kind (4, 2,
        2), and the expected number of edges of each kind in each pair of states."""
        n, n_blocks, n_pages = self.sizes
        table = np.exp(log_edges)
        expected = np.zeros((4, 2, 2))

        def send(kind: np.ndarray | int, ratio: np.ndarray, upward: bool) -> np.ndarray:
            r = np.exp(np.clip(ratio, -30, 30))
            mm, mf, fm, ff = (table[:, i, j][kind] for i in (0, 1) for j in (0, 1))
            if not upward:
                mf, fm = fm, mf
            return np.log((fm + ff * r) / (mm + mf * r))

        def count(kind: np.ndarray | int, above: np.ndarray, below: np.ndarray) -> None:
            a, b = np.exp(np.clip(above, -30, 30)), np.exp(np.clip(below, -30, 30))
            mm, mf, fm, ff = (table[:, i, j][kind] for i in (0, 1) for j in (0, 1))
            t = [mm, mf * b, fm * a, ff * (a * b)]
            total = t[0] + t[1] + t[2] + t[3]
            for k, x in enumerate(t):
                x = x / total
                if isinstance(kind, int):
                    expected[kind, k // 2, k % 2] += x.sum()
                else:
                    expected[:, k // 2, k % 2] += np.bincount(kind, weights=x, minlength=4)

        items, tops = self.items, self.tops
        kind = self.kind
        item, of_page = 0, 3
        up_items = send(item, own[items], True)
        total = own + np.bincount(self.heads, weights=up_items, minlength=n)
        up_lines = send(kind[tops], total[tops], True)
        at_block = np.bincount(self.block[tops], weights=up_lines, minlength=n_blocks)
        up_blocks = send(of_page, at_block, True)
        above = np.bincount(self.page, weights=up_blocks, minlength=n_pages)[self.page] - up_blocks
        count(of_page, above, at_block)
        block = at_block + send(of_page, above, False)
        belief = np.zeros(n)
        above = block[self.block[tops]] - up_lines
        count(kind[tops], above, total[tops])
        belief[tops] = total[tops] + send(kind[tops], above, False)
        above = belief[self.heads] - up_items
        count(item, above, own[items])
        belief[items] = own[items] + send(item, above, False)
        return belief, expected


class Part:
    """Some of the records of a sample as arrays: their forest, labels, places, and the features (of ``place``, by number)
    of their distinct texts."""

    def __init__(self, coded: Coded, records: np.ndarray, y: np.ndarray, rows: np.ndarray, codes: np.ndarray):
        starts = np.cumsum(coded.sizes) - coded.sizes
        self.y = y[ranges(starts[records], coded.sizes[records])]
        x = coded.of(records)
        self.forest, self.places = Forest.of(x), x.places.astype(np.int64)
        some = np.zeros(coded.n_texts, dtype=bool)
        some[x.which] = True
        number = np.cumsum(some) - 1
        self.which, self.texts = number[x.which], int(some.sum())
        here = some[rows]
        self.rows, self.codes = number[rows[here]], codes[here]
        self.labels = max(1, int((self.y >= 0).sum()))
        self.sure = np.where(self.y == FURNITURE, 25.0, -25.0)


def fitted(sample: list[tuple[str, list[int]]], rounds: int = 80, l2: float = 2e-5, chain: spam.Chain | None = None, part: int = 0) -> Model:
    """The model fitted to pages, given as text and the label of each non-blank line (HIDDEN where it is not known)."""
    coded = Coded([text for text, _ in sample])
    same = np.flatnonzero((coded.sizes > 0) & (coded.sizes == np.array([len(ys) for _, ys in sample], dtype=np.int64)))
    return fitted_to(coded.of(same), np.array([v for k in same.tolist() for v in sample[k][1]], dtype=np.int64), rounds, l2, chain, part)


def fitted_to(coded: Coded, y: np.ndarray, rounds: int = 80, l2: float = 2e-5, chain: spam.Chain | None = None, part: int = 0) -> Model:
    """The model fitted to coded records and the labels of their lines, by Adam on the likelihood of the labels: what is
    expected with the labels less what is expected without. With ``part``, the records are dealt to parts of about so many,
    which the rounds take in turn."""
    edges = np.tile(np.log(np.array([[1.5, 0.67], [0.67, 1.5]])), (4, 1, 1))
    if not len(y):
        return Model({}, {k: tuple(np.exp(e).ravel().tolist()) for k, e in zip(KINDS, edges)}, 0.0, chain)
    times = np.bincount(coded.which, minlength=coded.n_texts)
    often = np.flatnonzero(np.bincount(coded.codes, weights=times[coded.rows], minlength=len(coded.keys)) >= 3)
    place = np.full(len(coded.keys), -1)
    place[often] = np.arange(len(often))
    codes = place[coded.codes]
    rows, codes = coded.rows[codes >= 0], codes[codes >= 0]
    size = len(often)
    used = np.bincount(coded.places.ravel(), minlength=len(PLACES)) >= 3
    several = max(1, len(coded.sizes) // part) if part else 1
    parts = [Part(coded, np.arange(p, len(coded.sizes), several), y, rows, codes) for p in range(several)]
    theta = [np.zeros(size + len(PLACES) + 1), edges]  # of features, places and a bias
    mean = [np.zeros_like(x) for x in theta]
    square = [np.zeros_like(x) for x in theta]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        w, e = theta
        x = parts[t % several]
        own = np.bincount(x.rows, weights=w[x.codes], minlength=x.texts)[x.which] + w[size:-1][x.places].sum(axis=1) + w[-1]
        own[x.forest.fenced] = -12.0
        free, among = x.forest.beliefs(own, e)
        held, among_held = x.forest.beliefs(np.where(x.y >= 0, x.sure, own), e)
        d = np.where(x.y >= 0, x.y == FURNITURE, sigmoid(held)) - sigmoid(free)
        d[x.forest.fenced] = 0.0
        slope = np.concatenate(
            (
                np.bincount(x.codes, weights=np.bincount(x.which, weights=d, minlength=x.texts)[x.rows], minlength=size),
                np.bincount(x.places.ravel(), weights=np.repeat(d, x.places.shape[1]), minlength=len(PLACES)) * used,
                [d.sum()],
            )
        )
        slope = [slope / x.labels - l2 * w, (among_held - among) / x.labels - l2 * e]
        rate = 0.12 / (1 + t / 60)
        for k, (v, g) in enumerate(zip(theta, slope)):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            step = mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-9)
            theta[k] = v + rate * step * (0.3 if k == 1 else 1.0)
    w, e = theta
    keys, values = np.concatenate((coded.keys[often], PLACE_KEYS)), w[:-1]
    told = np.abs(values) > 1e-3
    return Model((keys[told], values[told]), {k: tuple(np.exp(e[j]).ravel().tolist()) for j, k in enumerate(KINDS)}, float(w[-1]), chain)


def train(pages: list[str], records: list[tuple[str, str | None]] | None = None) -> Model:
    """The model of raw pages and records."""
    return fitted([got for k, html in enumerate(pages) if (got := labelled(html, bool(k % 2))) is not None] + supposed(records or []))


#: A shard: what the model is fitted to and, if asked for, what is judged; the symbols of its records, the keys of their
#: lines, the number of records that are articles, and if asked for, the records as the residue operator assesses them.
PREPARED = T.StructType([T.StructField("shard", T.BinaryType()), T.StructField("symbols", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("records", T.LongType()), T.StructField("assessed", T.ArrayType(ASSESSED))])
PAGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("text", T.StringType()), T.StructField("labels", T.ArrayType(T.IntegerType()))])
WEIGHTS = T.StructType([T.StructField("name", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("labels", T.LongType())])
#: Names beside those of features.
BIAS = key("\x00bias")
EDGES = [key(f"\x00edge{k}{j}") for k in KINDS for j in range(4)]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Raw pages as their lines with labels."""
    for batch in batches:
        rows = [(i, tie, *got) for i, tie, html in zip(*(c.to_pylist() for c in batch.columns)) if (got := labelled(html, bool((i or 0) % 2))) is not None]
        columns = list(zip(*rows)) or [()] * len(PAGES)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())))], names=PAGES.names)


class Judged:
    """Records with what is needed to judge them: coded, with the observations of the spam model and those lines' evidence
    where there is any."""

    def __init__(self, ids: list[int | None], coded: Coded, seen: spam.Seen, evidence: dict[int, list[tuple[int, int]]]):
        self.ids, self.coded, self.seen, self.evidence = ids, coded, seen, evidence

    @classmethod
    def of(cls, ids: list[int | None], contents: list[str]) -> Judged:
        evidence = {k: got for k, c in enumerate(contents) if (got := weighed(c))}
        return cls(ids, Coded(contents), spam.Seen(contents), evidence)

    def furniture(self, model: Model) -> tuple[list[int | None], list[int]]:
        """Ids and numbers of the furniture lines of the records that are neither spam nor residue."""
        coded = self.coded
        gone = model.beliefs(coded) > 0
        out = model.chain.are_spam(self.seen)
        starts = np.cumsum(coded.sizes) - coded.sizes
        for k, lines in self.evidence.items():
            if not out[k]:
                a = starts[k]
                lost = frozenset(coded.nos[a : a + coded.sizes[k]][gone[a : a + coded.sizes[k]]].tolist())
                out[k] = is_case(lines, lost)
        record = np.repeat(np.arange(len(coded.sizes)), coded.sizes)
        found = gone & ~out[record]
        return [self.ids[k] for k in record[found].tolist()], coded.nos[found].tolist()


def _prepared(batches: Iterator[pa.RecordBatch], judged: bool | Callable) -> Iterator[pa.RecordBatch]:
    """A shard of labelled pages and records, each once (all rows of an id are in one shard: repeated deliveries count
    once), in the order of their ids: coded, with the labels of the pages and the marks of the records that are articles by
    the spam model's starting tables. ``judged``: all records also as they are judged, or what it finds to be judged of
    them by their ids, contents and labels of language."""
    pages, records, deliveries = {}, {}, []
    for batch in batches:
        for i, tie, text, title, labels, language in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if labels is not None:
                pages[i, tie, text] = labels
            else:
                records.setdefault((i, text, title), set()).add(language)
        if callable(judged):
            some = batch.filter(batch.column(6))
            if some.num_rows:
                deliveries.append((some.column(2).to_pylist(), [some.column(0), *some.columns[7:]]))
    rows = sorted(records, key=lambda r: (r[0] or 0, r[1], r[2] or ""))
    contents = [text for _, text, _ in rows]
    seen = spam.Seen(contents)
    article = ~spam.Chain().are_spam(seen)
    evidence = {k: got for k, c in enumerate(contents) if (got := weighed(c))}
    for k, lines in evidence.items():
        article[k] &= not is_case(lines)
    article &= np.array([bool(c.strip()) for c in contents], dtype=bool)
    ids = [i for i, _, _ in rows]
    suspects = judged(ids, contents, [records[r] for r in rows]) if callable(judged) else range(len(rows)) if judged else ()
    coming = article.copy()
    coming[np.array(list(suspects), dtype=np.int64)] = True
    first = sorted(pages.items(), key=lambda r: (r[0][0] or 0, r[0][2], r[0][1] or 0))
    texts = [text for (_, _, text), _ in first]
    coded = Coded(texts + [c for c, x in zip(contents, coming) if x])
    marks = Marks(coded, [None] * len(texts) + [title for (_, _, title), x in zip(rows, coming) if x])
    place = len(texts) + np.cumsum(coming) - 1  # of each record
    at = place[article]
    own = marks.of(ranges((np.cumsum(coded.sizes) - coded.sizes)[at], coded.sizes[at]))
    keys = own.keys(coded.of(at))
    assessed = None
    if callable(judged):
        known = {contents[k]: got for k, got in evidence.items()}
        assessed = []
        for got, columns in deliveries:
            hashes = pa.array(letter_hashes(got, coded, marks), pa.list_(pa.int64()))
            assessed.append(with_evidence([*columns, hashes], got, [known.get(c) for c in got]).to_struct_array())
        assessed = pa.concat_arrays(assessed) if assessed else None
    del coded.texts, coded.letters
    if not judged:
        coded.drop_rare()
    shard = {"coded": coded, "marks": marks, "sample": np.concatenate((np.full(len(texts), True), article[coming])), "labels": np.array([v for _, ys in first for v in ys], dtype=np.int64)}
    if judged:
        shard |= {"ids": ids, "place": place, "seen": seen}
    if callable(judged):
        shard["judged"] = suspects
    elif judged:
        shard["evidence"] = evidence
    if assessed is None:
        assessed = pa.array([], to_arrow_type(ASSESSED))
    columns = [pa.array([packed(shard)], pa.binary()), pa.array([seen.flat()], pa.list_(pa.int32())), pa.array([keys], pa.list_(pa.int64())), pa.array([int(article.sum())], pa.int64())]
    columns.append(pa.ListArray.from_arrays(pa.array([0, len(assessed)], pa.int32()), assessed))
    yield pa.RecordBatch.from_arrays(columns, names=PREPARED.names)


def packed(shard: dict) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=-1).compress(pickle.dumps(shard, protocol=5))


def unpacked(data: bytes) -> dict:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def mixed(prepared: DataFrame, chain: spam.Chain, shard: int = SHARD, part: int = PART) -> Model:
    """The mean of the models fitted to each row of ``prepared``, weighted by its labels, for each feature over the rows that
    have it; lines are counted over all."""
    scale = max(1.0, (prepared.agg(F.sum("records")).first()[0] or 0) / shard)
    # lines in more than one of ``shard`` records: their number is bounded by the lines of ``shard`` records
    counts = prepared.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > scale).collect()
    known = sorted((r["key"], r["count"]) for r in counts)
    shared = prepared.sparkSession.sparkContext.broadcast((np.array([k for k, _ in known], dtype=np.int64), np.array([n for _, n in known], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = unpacked(data.as_py())
                coded, sample = x["coded"], x["sample"]
                y = x["marks"].labels(coded, shared.value, RECUR * scale, scale)
                y[: len(x["labels"])] = x["labels"]
                records = np.flatnonzero(sample & (coded.sizes > 0))
                starts = np.cumsum(coded.sizes) - coded.sizes
                y = y[ranges(starts[records], coded.sizes[records])]
                labels = int((y != HIDDEN).sum())
                if labels:
                    m = fitted_to(coded.of(records), y, part=part)
                    names = np.concatenate((m.keys, np.array([BIAS, *EDGES], dtype=np.uint64))).view(np.int64)
                    weights = np.concatenate((m.values, [m.bias], np.log([v for k in KINDS for v in m.edges[k]])))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(labels * weights), pa.array(np.full(len(names), labels))], names=WEIGHTS.names)

    # decimals: their sum is the same in any order
    sums = prepared.select("shard").mapInArrow(run, WEIGHTS).groupBy("name").agg(F.sum(F.col("weight").cast("decimal(28,9)")).cast("double").alias("weight"), F.sum("labels").alias("labels")).toArrow()
    if not len(sums):
        return fitted([], chain=chain)
    names, weights = np.asarray(sums["name"].to_numpy()).view(np.uint64), sums["weight"].to_numpy() / sums["labels"].to_numpy()
    beside = np.isin(names, np.array([BIAS, *EDGES], dtype=np.uint64))
    means = dict(zip(names[beside].tolist(), weights[beside].tolist()))
    edges = np.exp([means[e] for e in EDGES]).reshape(len(KINDS), 4)
    told = ~beside & (np.abs(weights) > 1e-3)
    return Model((names[told], weights[told]), {k: tuple(e) for k, e in zip(KINDS, edges.tolist())}, means[BIAS], chain)


def prepare(spark, sf: str, shard: int = SHARD, judged: bool | Callable = False) -> DataFrame:
    """All raw pages and all records in shards. Half of the pages are written in Markdown and half as plain text, the two
    formats of records; each page is parsed once, and goes to ``COPIES`` shards. ``judged``: see :func:`_prepared`."""
    raw = spark.read.parquet(f"{sf}/pages.parquet").where("html IS NOT NULL AND html <> ''").select(F.col("page_id").alias("id"), F.xxhash64("html").alias("tie"), "html")
    copies = raw.mapInArrow(_labelled, PAGES).select("id", "tie", "text", F.lit(None).cast("string").alias("title"), "labels", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))
    df = scrapes(spark, sf)
    records = df.where("content IS NOT NULL").select(F.col("scrape_id").alias("id"), F.lit(0).cast("bigint").alias("tie"), F.col("content").alias("text"), F.col("metadata.title").alias("title"), F.lit(None).cast("array<int>").alias("labels"), F.lit(0).alias("copy"), *([F.col("metadata.language").alias("language"), *described_as(df)[:-1]] if callable(judged) else []))
    shards = max(1, round(records.count() / shard))
    every = copies.unionByName(records, allowMissingColumns=True)
    if not callable(judged):
        every = every.withColumn("language", F.lit(None).cast("string"))
    return cut(every.repartition(shards, "id", "copy").drop("copy").mapInArrow(lambda batches: _prepared(batches, judged), PREPARED))


def fit_to(prepared: DataFrame, shard: int = SHARD, part: int = PART) -> Model:
    """The model trained on prepared shards, and the spam model of their records."""
    return mixed(prepared, spam.learned(cut(prepared.select("symbols"))), shard, part)


def fit(spark, sf: str, shard: int = SHARD, part: int = PART) -> Model:
    """The model trained on all raw pages and all records, and the spam model of the same records."""
    return fit_to(prepare(spark, sf, shard), shard, part)


FOUND = T.StructType([T.StructField("scrape_id", T.LongType()), T.StructField("line_no", T.LongType())])


def _found(ids: list[int | None], nos: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64())], names=FOUND.names)


def found_lines(df: DataFrame, model: Model) -> DataFrame:
    """(scrape_id, line_no) of the furniture lines of (scrape_id, content)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # features that three lines of a shard share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _found(*Judged.of(batch.column(0).to_pylist(), batch.column(1).to_pylist()).furniture(shared.value))

    return df.select("scrape_id", "content").where("trim(content) <> ''").mapInArrow(run, FOUND).distinct()


def found_prepared(prepared: DataFrame, model: Model) -> DataFrame:
    """``found_lines`` of all records of shards that were prepared with ``judged``."""
    shared = prepared.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = unpacked(data.as_py())
                yield _found(*Judged(x["ids"], x["coded"].of(x["place"]), x["seen"], x["evidence"]).furniture(shared.value))

    return prepared.select("shard").mapInArrow(run, FOUND).distinct()


def p4_found(spark, sf):
    """(scrape_id, line_no) of the lines that are not main body."""
    prepared = prepare(spark, sf, judged=True)
    return found_prepared(prepared, fit_to(prepared))
