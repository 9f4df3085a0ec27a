"""Many records as arrays, for the main-body model: their trees, and the features of their distinct lines.

The features are those of :func:`mainbody.features`, each under a 64-bit key (pairs of words under the mixed keys of the two),
found for all lines in one pass over their words. ``Coded`` holds what a pass over the model needs; no text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import compress

import numpy as np


def charset(pattern: str) -> str:
    """The characters that match a pattern, up to U+FFFF, as they stand in a set: looked up at once, where classes are tried
    one by one."""
    one = re.compile(pattern)
    fits = [bool(one.match(chr(c))) for c in range(0x10000)]
    starts = [c for c in range(0x10000) if fits[c] and not (c and fits[c - 1])]
    ends = [c for c in range(0x10000) if fits[c] and not (c < 0xFFFF and fits[c + 1])]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


# Of lines without the odd characters below.
_TOKEN = re.compile(rf"[{charset(r'[^\W\d_]')}]+|\d+|[©|·»›>•/↑]|\n")
_WORD = re.compile(r"[^\W\d_]+|\d+|[©|·»›>•/↑]", re.U)
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
# Lines whose words are cut by themselves: with CJK characters, digits that are no decimals, or characters above U+FFFF.
_ODD = re.compile("[぀-ヿ㐀-鿿가-힯" + "".join(c for c in map(chr, range(0x80, 0x10000)) if c.isdigit() and not c.isdecimal()) + "\U00010000-\U0010ffff]")
_DIGIT = re.compile(r"\d")
LIST = re.compile(r"^(?:[-*+•]|\d{1,3}[.)])\s+")
_LINK = re.compile(r"\[([^\]]*)\]\([^)\s]*\)")
_SENTENCE = re.compile(r"[.!?…。！？](?:(?<=[。！？])|(?=\s))")
_DATE = re.compile(r"\b(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}\b|\b\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d\b")
_NAME = re.compile(r"\b[A-ZÀ-ÖØ-ÞА-Я]\w+")
DATA = re.compile(r"[\[{<](?=.*(?:\":|':|</\w+>)).*[\]}>,]$")
_SEPARATORS = re.compile(r"\s[|·»›>•/]\s")

KINDS = ("item", "loose", "block", "page")
#: Features of a line's place; their numbers are those of ``places``.
PLACES = [*(f"@top{k}" for k in range(4)), "@mid", *(f"@bottom{k}" for k in range(7)), "@far", *(f"@block{k}{last}" for k in range(3) for last in ("", "l")), *(f"@size{k}" for k in range(5))]
#: Words up to which a line's pairs of words are features.
PAIRED = 40


def words_of(line: str) -> list[str]:
    """Lower-case words of a line, numbers as ``0``, links by their text, CJK text as single characters."""
    if "](" in line:
        line = _LINK.sub(r"\1", line)
    out = _WORD.findall(line.lower())
    if not line.isascii() and _CJK.search(line):
        cut: list[str] = []
        for w in out:
            cut.extend(w if _CJK.match(w) else [w])
        out = cut
    return ["0" if w[0].isdigit() else w for w in out] if _DIGIT.search(line) else out


def ends_sentence(text: str) -> bool:
    """Whether a line ends with an end mark, but for quotes, brackets and emphasis."""
    return text.rstrip("\"'”’»)*_")[-1:] in (".", "!", "?", "…") or text.rstrip("」』”’）*_")[-1:] in ("。", "！", "？")


def shape(line: str, n: int) -> list[str]:
    """What the look of a line of ``n`` words says, apart from its words and place."""
    s = line.strip()
    bare = s.strip("*_")
    out = []
    ends = ends_sentence(bare)
    first = s[0]
    if first == "#":
        out.append("~heading")
    elif first == "|" and s[-1] == "|" and len(s) > 1:
        out.append("~table")
    elif first == ">":
        out.append("~quote")
    item = bool(LIST.match(s))
    if item:
        out.append("~item.end" if ends else "~item")
    if first in "*_" and s[-1] in "*_" and bare != s:
        out.append("~emphasis")
    if "](" in s and (links := _LINK.findall(s)):
        share = sum(map(len, links)) / max(1, len(_LINK.sub(r"\1", s)))
        out.append("~link.all" if share > 0.8 else "~link.some" if share > 0.3 else "~link")
    if ("|" in s or "/" in s or ">" in s or not s.isascii() and ("·" in s or "»" in s or "›" in s or "•" in s)) and (seps := len(_SEPARATORS.findall(s))):
        out.append("~sep" + str(min(seps, 4)))
    if ends:
        again = _SENTENCE.search(bare)
        out.append("~end" + ("+" if again and _SENTENCE.search(bare, again.end()) else "") + ("." if n > 6 else ""))
    elif not item and first not in "#|":
        out.append("~noend")
    out.append("~n" + str(min(9, (n + 1).bit_length() - 1)))
    if n > 2 and bare.isupper():
        out.append("~upper")
    if ("19" in bare or "20" in bare) and _DATE.search(bare):
        out.append("~date")
    if 1 < n < 12 and not ends:
        names = len(_NAME.findall(bare))
        out.append("~names" + str(min(names, 4)) + ("all" if names >= n - 1 else ""))
    return out


def key(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The keys of pairs of words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feature_key(feature: str) -> int:
    """The key of a feature as :func:`mainbody.features` writes it."""
    a, blank, b = feature.partition(" ")
    return int(mixed(np.array([key(a)], np.uint64), np.array([key(b)], np.uint64))[0]) if blank else key(feature)


PLACE_KEYS = np.array([key(p) for p in PLACES], dtype=np.uint64)
_START, _END = key("^"), key("$")


class _Numbers(dict):
    """Numbers of words; all numbers are ``0``."""

    def __missing__(self, w: str) -> int:
        if w[0].isdecimal() and w != "0":
            k = self["0"]
        else:
            k = len(self.names)
            self.names.append(w)
        self[w] = k
        return k

    def __init__(self):
        self.names = ["\n"]
        self["\n"] = 0


def letters(line: str) -> str:
    return "".join(_LETTERS.findall(line.lower()))


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of an array, each once, in their order."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The features of each text: numbers of texts and of features, side by side, and the features' keys; the number of
    words of each text, and its letters."""
    fast, slow, spread, at_fast, at_slow = [], [], [], [], []
    for k, s in enumerate(texts):
        if "](" in s:
            s = _LINK.sub(r"\1", s)
        if not s.isascii() and _ODD.search(s):
            slow.append(words_of(texts[k]))
            at_slow.append(k)
        else:
            fast.append(s)
            at_fast.append(k)
    tokens = _TOKEN.findall("\n" + "\n".join(fast).lower()) if fast else []
    for w in slow:
        spread.append("\n")
        spread += w
    tokens += spread
    tokens.append("\n")
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    del spread, slow, fast
    size = len(numbers.names)
    keys = np.fromiter(map(key, numbers.names), np.uint64, size)
    text = np.array(at_fast + at_slow, dtype=np.int64)
    line = np.cumsum(ids == 0) - 1
    word = ids > 0
    count = np.bincount(line[word], minlength=len(text))
    one = distinct(line[word] * size + ids[word])
    paired = (count <= PAIRED)[line[:-1]] if len(text) else np.zeros(0, bool)
    both = ids[:-1][paired] * size + ids[1:][paired]
    pairs = distinct(both)
    two = distinct(line[:-1][paired] * max(1, len(pairs)) + np.searchsorted(pairs, both))
    written = np.array([w[0].isalpha() for w in numbers.names])[ids]
    runs = list(compress(tokens, written.tolist()))
    ends = np.cumsum(np.bincount(line[written], minlength=len(text))).tolist()
    spelt = [""] * len(texts)
    for k, a, b in zip(at_fast, [0, *ends], ends):
        spelt[k] = "".join(runs[a:b]) if "](" not in texts[k] else letters(texts[k])
    for k in at_slow:
        spelt[k] = letters(texts[k])
    del tokens, runs
    before, after = keys.copy(), keys
    before[0], after[0] = _START, _END
    pair_keys = mixed(before[pairs // size], after[pairs % size])
    shapes: dict[str, int] = {}
    n_words = np.zeros(len(texts), dtype=np.int64)
    n_words[text] = count
    looks = [[shapes.setdefault(f, len(shapes)) for f in shape(s, n)] for s, n in zip(texts, n_words.tolist())]
    rows = np.concatenate((text[one // size], text[two // max(1, len(pairs))], np.repeat(np.arange(len(texts)), [len(x) for x in looks] if looks else 0)))
    codes = np.concatenate((one % size, size + two % max(1, len(pairs)), size + len(pairs) + np.array([c for x in looks for c in x], dtype=np.int64)))
    return rows.astype(np.int32), codes.astype(np.int32), np.concatenate((keys, pair_keys, np.fromiter(map(key, shapes), np.uint64, len(shapes)))), n_words, spelt


class Coded:
    """Records laid side by side. For each line: its record, number, block, parent (line, -1 for its block), kind, whether it
    is fenced, its places and its text; the features of the distinct texts."""

    def __init__(self, contents: list[str]):
        known: dict[str, int] = {}
        which, nos, blocks, parents, kinds, fenced, sizes = [], [], [], [], [], [], []
        for content in contents:
            block, fresh, fence, head, first = -1, True, False, -1, len(which)
            for no, text in enumerate(content.split("\n"), 1):
                s = text.strip()
                if not s:
                    fresh = fresh or not fence
                    continue
                if fresh:
                    block, fresh, head = block + 1, False, -1
                if s[:3] == "```":
                    fence = not fence
                    parent, kind, closed = -1, 2, True
                elif not fence and LIST.match(s):
                    parent, kind, closed = head, 0 if head >= 0 else 1, False
                else:
                    if not fence:
                        head = len(which)
                    parent, kind, closed = -1, 2, fence or s[0] in "[{<" and bool(DATA.match(s))
                which.append(known.setdefault(s, len(known)))
                nos.append(no)
                blocks.append(block)
                parents.append(parent)
                kinds.append(kind)
                fenced.append(closed)
            sizes.append(len(which) - first)
        self.texts = list(known)
        self.which, self.nos, self.parent, self.kind = (np.array(x, dtype=np.int64) for x in (which, nos, parents, kinds))
        self.fenced = np.array(fenced, dtype=bool)
        self.sizes = np.array(sizes, dtype=np.int64)
        block = np.array(blocks, dtype=np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        record = np.repeat(np.arange(len(sizes)), self.sizes)
        self.blocks = np.zeros(len(sizes), dtype=np.int64)  # of each record
        some = self.sizes > 0
        self.blocks[some] = block[starts[some] + self.sizes[some] - 1] + 1
        self.block = block + (np.cumsum(self.blocks) - self.blocks)[record]
        top = np.arange(len(which)) - starts[record]
        back = self.sizes[record] - 1 - top
        of_block = np.bincount(self.block, minlength=int(self.blocks.sum()))[self.block]
        self.places = np.stack((np.minimum(top, 4), 5 + np.minimum(back, 7), 13 + 2 * np.minimum(block, 2) + (block == self.blocks[record] - 1), 19 + np.minimum(4, of_block)), axis=1).astype(np.int8)
        self.n_texts = len(self.texts)
        self.rows, self.codes, self.keys, self.words, self.letters = features_of(self.texts)

    def drop_rare(self, least: int = 3) -> None:
        """Leave out the features that fewer lines have."""
        often = np.bincount(self.codes, weights=np.bincount(self.which, minlength=self.n_texts)[self.rows], minlength=len(self.keys)) >= least
        kept = often[self.codes]
        self.rows, self.codes, self.keys = self.rows[kept], (np.cumsum(often) - 1)[self.codes[kept]].astype(np.int32), self.keys[often]

    def of(self, records: np.ndarray) -> Coded:
        """These records (numbers) alone; the texts stay as they are."""
        out = object.__new__(Coded)
        starts, first = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.blocks) - self.blocks
        out.sizes, out.blocks = self.sizes[records], self.blocks[records]
        lines = ranges(starts[records], out.sizes)
        record = np.repeat(np.arange(len(records)), out.sizes)
        moved = (np.cumsum(out.sizes) - out.sizes - starts[records])[record]
        out.parent = np.where(self.parent[lines] >= 0, self.parent[lines] + moved, -1)
        out.block = self.block[lines] + (np.cumsum(out.blocks) - out.blocks - first[records])[record]
        out.which, out.nos, out.kind, out.fenced, out.places = (x[lines] for x in (self.which, self.nos, self.kind, self.fenced, self.places))
        out.n_texts, out.rows, out.codes, out.keys = self.n_texts, self.rows, self.codes, self.keys
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size, laid end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
