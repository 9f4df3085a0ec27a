"""Problem 6: keyword-stuffed pages and lists of links, tags, codes or places.

The lines of a record are the observations of a hidden Markov model whose states are prose, link list, tag list and
menu. Each line is reduced to one symbol by its shape (sentences, links, tags and codes, repetition of word pairs), a
long line that is stuffed in part to one for each run of its stretches; the most likely sequence of states labels the
lines. A record is flagged by the share of its words that are not prose, if lists make up enough of them: menus and
site furniture alone are no list.

The model's probabilities are learned by expectation and maximisation (Baum-Welch) from the symbols of all records; the
tables below are where it starts, and weigh as much as ``PRIOR`` observations of each state, so that the states keep
their meaning where a table lacks one of them.

Defined cases: null, blank and very short contents are no cases; code and data are prose; several rows of one id
count as one record, flagged if any of its texts is; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coded import charset
from .common import cut, scrapes

STATES = ("prose", "links", "tags", "menu")
SYMBOLS = ("sentence", "brief", "phrase", "separated", "own link", "link", "tags", "stuffed", "title", "data", "paragraph")
# Where the learning starts: P(symbol | state) and P(state | state before), by the shapes named; rows as STATES.
EMISSIONS = (
    (0.26, 0.03, 0.03, 0.02, 0.05, 0.010, 0.004, 0.004, 0.13, 0.062, 0.400),
    (0.02, 0.02, 0.08, 0.03, 0.15, 0.600, 0.040, 0.020, 0.03, 0.008, 0.002),
    (0.02, 0.02, 0.40, 0.03, 0.03, 0.040, 0.280, 0.150, 0.02, 0.008, 0.002),
    (0.16, 0.30, 0.09, 0.22, 0.13, 0.020, 0.004, 0.003, 0.07, 0.001, 0.002),
)
TRANSITIONS = (
    (0.84, 0.02, 0.02, 0.12),
    (0.04, 0.86, 0.04, 0.06),
    (0.04, 0.03, 0.88, 0.05),
    (0.22, 0.04, 0.04, 0.70),
)
START = (0.45, 0.08, 0.08, 0.39)
#: Rounds of the learning, and the weight of where it starts.
ROUNDS = 6
PRIOR = 200.0

#: Least words in link and tag lists, and least share of words that are not prose.
MIN_WORDS = 20
SHARE = 0.6
LONG = 25
#: Words of a stretch whose pairs are compared, and the share of distinct pairs below which it counts as stuffed.
STRETCH = 150
PAIRS = 0.72

_WORD = re.compile(r"[^\W_]+")
# The same for text without characters above U+FFFF.
_PLAIN_WORD = re.compile(f"[{charset(_WORD.pattern)}]+")
_HIGH = re.compile("[\U00010000-\U0010ffff]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_URL = re.compile(r"https?://([^\s/)\]]+)[^\s)\]]*")
_MD = re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)")
_END = re.compile(r"[.!?…。！？](?:(?<=[。！？])|(?=\s|$|[\"'”’»)*_]))")  # one set of first characters: the search skips to them
_HASH = re.compile(r"(?:^|[\s|,;•])#\w{3,}|(?<=\w)#\w{3,}")
_TWO_DIGITS = re.compile(r"\d\d")
_CODE = re.compile(r"\b[A-Z]{2,}[A-Z0-9]*-\d{2,}\b|\b\d{6,13}\b.*\d[.,]\d\d\b")
_SEGMENTS = re.compile(r"\s*(?:[,;•·|/]|\s[-–>»]\s)\s*")
_ITEM = re.compile(r"^(?:[-*+•>]|\d{1,3}[.)])\s+")


def stuffed_runs(words: list[str], least: float) -> list[tuple[bool, int]]:
    """(stuffed, words) of the runs of stretches of ``words`` that are alike: a stretch is stuffed if its distinct
    word pairs are under ``least`` of its word pairs. A short rest belongs to the stretch before it."""
    runs: list[tuple[bool, int]] = []
    starts = range(0, max(1, len(words) - STRETCH // 2), STRETCH)
    for a in starts:
        w = words[a : a + STRETCH]
        bound = least * (len(w) - 1)  # every word but the first ends a pair: the pairs are no fewer than the words less one
        stuffed = len(w) >= 12 and len(set(w)) - 1 < bound and len(set(zip(w, w[1:]))) < bound
        size = len(words) - a if a == starts[-1] else STRETCH
        if runs and runs[-1][0] == stuffed:
            size += runs.pop()[1]
        runs.append((stuffed, size))
    return runs


def once(line: str) -> list[str]:
    """Words of a line, each of its sentences taken once."""
    return _WORD.findall(" ".join(dict.fromkeys(x.strip() for x in _END.split(line.lower()))))


def shape(s: str, bare: str, ends: int, n: int) -> int:
    """The symbol of a line of ``n`` words without links, tags and codes that is not stuffed."""
    sentence = 10 if n >= LONG else 0
    if ends and n >= 4 and sum(map(bare.count, ",;•·|/")) < 7:
        return sentence  # too few separators for a list
    parts = [p for p in _SEGMENTS.split(bare) if p]
    if len(parts) >= 8 and n >= 16 and ends <= len(parts) // 8:
        return 6
    if ends and (n >= 4 or ends > 1):
        return sentence
    if len(parts) >= 2 and n <= 40 and not _ITEM.match(s):
        return 3 if len(parts) > 2 or n > 7 or not re.search(r"\s[-–@]\s", bare) else 2
    if n <= 2:
        return 1
    return 2 if n <= 7 else 8


def symbols(line: str, hosts: Counter) -> list[tuple[int, int]]:
    """(symbol, words) of a non-blank line outside fences, one for each run of its stretches where some are stuffed.
    ``hosts``: how often each host is linked in the record."""
    s = line.strip()
    if s[0] in "[{<" and s[-1] in "]},>" and ('":' in s or "</" in s):
        return [(9, 0)]
    links = _MD.findall(s) if "](" in s else []
    plain = _MD.sub(r"\1", s) if links else s
    urls = _URL.findall(s) if "://" in s else []
    if urls:
        plain = _URL.sub(" ", plain)
    item = _ITEM.match(plain)
    bare = (plain[item.end() :] if item else plain).strip("*_ ")
    words = (_PLAIN_WORD if bare.isascii() or not _HIGH.search(bare) else _WORD).findall(bare.lower())
    cjk = 0 if bare.isascii() else len(_CJK.findall(bare))
    n = len(words) if not cjk else len(_WORD.findall(_CJK.sub(" ", bare))) + cjk // 2
    if s[0] == "#" and re.match(r"#{1,6} ", s):
        return [(8, n)]
    if s[0] == "|" and s[-1] == "|" and len(s) > 1:
        return [(9, n)]
    if "#" in s and (len(_HASH.findall(s)) >= 3 or s[0] == "#" and n <= 2):
        return [(6, n)]
    ends = len(_END.findall(bare))
    if urls or links:
        linked = sum(len(_WORD.findall(t)) for t, _ in links) if links else 0
        if len(urls) + len(links) >= 1 and (linked >= 0.6 * n or not links and not ends):
            foreign = [h for h in urls if not 2 <= hosts[h] <= 10]
            return [(5 if foreign else 4 if urls else 3, n)]
    if (not ends or n <= 14) and _TWO_DIGITS.search(s) and _CODE.search(s):
        return [(6, n)]
    if n < 25:
        return [(shape(s, bare, ends, n), n)]
    least = PAIRS if n >= 40 else 0.6
    runs = stuffed_runs(words, least)
    if ends >= 2 and any(stuffed for stuffed, _ in runs):
        runs = stuffed_runs(once(bare), least)  # also without the sentences that only come again
    if not any(stuffed for stuffed, _ in runs):
        return [(shape(s, bare, ends, n), n)]
    rest = shape(s, bare, ends, n) if len(runs) > 1 else 10
    total = sum(size for _, size in runs)
    return [(7 if stuffed else rest, round(n * size / total)) for stuffed, size in runs]


def observe(content: str, short: dict[str, list[tuple[int, int]]] | None = None) -> list[tuple[int, int]]:
    """(symbol, words) of each non-blank line, or of its runs of stretches. ``short`` keeps the answers of short lines
    without addresses over many records."""
    hosts = Counter(_URL.findall(content)) if "://" in content else Counter()
    out: list[tuple[int, int]] = []
    fenced = False
    known: dict[str, list[tuple[int, int]]] = {}
    for line in content.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
        elif s:
            if fenced:
                out.append((9, len(_WORD.findall(s))))
            else:
                of = short if short is not None and len(s) < 200 and "://" not in s else known
                got = of.get(s)
                if got is None:
                    got = of[s] = symbols(s, hosts)
                out += got
    return out


class Chain:
    """The model: logarithms of its probabilities."""

    def __init__(self, start=START, transitions=TRANSITIONS, emissions=EMISSIONS):
        self.start, self.transitions, self.emissions = (np.log(np.asarray(x, dtype=float)).tolist() for x in (start, transitions, emissions))

    def states(self, symbols: list[int]) -> list[int]:
        """The most likely states of a sequence of symbols (Viterbi)."""
        if not symbols:
            return []
        steps, emit = self.transitions, self.emissions
        score = [self.start[k] + emit[k][symbols[0]] for k in range(4)]
        back: list[tuple[int, ...]] = []
        for o in symbols[1:]:
            new, ptr = [], []
            for k in range(4):
                best = max(range(4), key=lambda j: score[j] + steps[j][k])
                ptr.append(best)
                new.append(score[best] + steps[best][k] + emit[k][o])
            back.append(tuple(ptr))
            score = new
        at = max(range(4), key=score.__getitem__)
        path = [at]
        for ptr in reversed(back):
            at = ptr[at]
            path.append(at)
        return path[::-1]

    def weigh(self, content: str, seen: list[tuple[int, int, int]] | None = None) -> list[int]:
        """Words of each state of a record, whose observations may be known."""
        seen = repeated(observe(content)) if seen is None else seen
        path = self.states([o for o, _, times in seen for _ in range(times)])
        words = [0, 0, 0, 0]
        at = 0
        for _, n, times in seen:
            words[path[at]] += n
            at += times
        return words

    def is_spam(self, content: str | None, seen: list[tuple[int, int, int]] | None = None) -> bool:
        if not content or not content.strip():
            return False
        words = self.weigh(content, seen)
        lists = words[1] + words[2]
        return lists >= MIN_WORDS and lists > words[0] and lists + words[3] >= SHARE * sum(words)


    def are_spam(self, seen: Seen) -> np.ndarray:
        """``is_spam`` of many records."""
        lengths = seen.lengths()
        path = np.zeros(int(lengths.sum()), dtype=np.int64)
        flat = np.repeat(seen.symbols, seen.times)
        starts = np.cumsum(lengths) - lengths
        for k in np.flatnonzero(lengths > TOGETHER).tolist():
            path[starts[k] : starts[k] + lengths[k]] = self.states(flat[starts[k] : starts[k] + lengths[k]].tolist())
        order = np.argsort(-lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= TOGETHER)]
        if len(order):
            steps, emit = np.array(self.transitions).T, np.array(self.emissions).T
            begins, sizes = starts[order], lengths[order]
            many = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()
            score = np.array(self.start) + emit[flat[begins]]
            last, back = score.copy(), [None]
            for t in range(1, int(sizes[0])):
                k = many[t]
                sums = score[:k, None, :] + steps  # by the state after, then the one before
                back.append(best := sums.argmax(axis=2))
                score = np.take_along_axis(sums, best[:, :, None], 2)[:, :, 0] + emit[flat[begins[:k] + t]]
                last[:k] = score
            state = last.argmax(axis=1)
            for t in range(int(sizes[0]) - 1, -1, -1):
                k = many[t]
                path[begins[:k] + t] = state[:k]
                if t:
                    state[:k] = back[t][np.arange(k), state[:k]]
        record = np.repeat(np.arange(len(seen.sizes)), seen.sizes)
        at = np.cumsum(seen.times) - seen.times
        words = np.bincount(record * 4 + path[at], weights=seen.words, minlength=4 * len(seen.sizes)).reshape(-1, 4)
        lists = words[:, 1] + words[:, 2]
        return (lists >= MIN_WORDS) & (lists > words[:, 0]) & (lists + words[:, 3] >= SHARE * words.sum(axis=1))


#: Symbols up to which sequences are judged together.
TOGETHER = 400


def symbols_of(content: str) -> list[int]:
    """The sequence of symbols of a record."""
    return [o for o, _, times in repeated(observe(content)) for _ in range(times)]


def repeated(seen: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(symbol, words, times): a long line, or run of its stretches, is an observation for each LONG words of it."""
    return [(o, n, max(1, n // LONG)) for o, n in seen]


class Seen:
    """The observations of many records, laid end to end: symbols, words, how often each comes, and their number a record."""

    def __init__(self, contents: list[str]):
        short: dict[str, list[tuple[int, int]]] = {}
        each = [observe(c, short) if c.strip() else [] for c in contents]
        self.sizes = np.array([len(x) for x in each], dtype=np.int64)
        self.symbols = np.array([o for x in each for o, _ in x], dtype=np.int8)
        self.words = np.array([n for x in each for _, n in x], dtype=np.int64)
        self.times = np.maximum(1, self.words // LONG)

    def lengths(self) -> np.ndarray:
        """The number of symbols of each record, each as often as it comes."""
        return np.diff(np.concatenate(([0], np.cumsum(self.times)))[np.concatenate(([0], np.cumsum(self.sizes)))])

    def flat(self) -> np.ndarray:
        """The symbols of all records, each as often as it comes, and END after each record."""
        return np.insert(np.repeat(self.symbols, self.times).astype(np.int32), np.cumsum(self.lengths()), END)


#: Ends a sequence of symbols.
END = -1


def expected(first: np.ndarray, step: np.ndarray, emit: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The expected numbers of starts, steps and emissions over sequences of symbols, laid end to end, with END after each."""
    n_first, n_step, n_emit = np.zeros(4), np.zeros((4, 4)), np.zeros((4, len(SYMBOLS)))
    ends = np.flatnonzero(flat == END)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    starts, lengths = starts[order], (ends - starts)[order]
    starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    if len(starts):
        many = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences longer than t
        at = [flat[starts[:k] + t] for t, k in enumerate(many.tolist())]  # symbols of place t
        emitted = emit.T
        forward, scale = [], []
        for t, o in enumerate(at):
            a = (first[None, :] if t == 0 else forward[-1][: len(o)] @ step) * emitted[o]
            scale.append(a.sum(axis=1, keepdims=True))
            forward.append(a / scale[-1])
        later = np.ones((len(at[-1]), 4))
        for t in range(len(at) - 1, -1, -1):
            post = forward[t].copy()
            if t + 1 < len(at):
                k = len(at[t + 1])
                ahead = emitted[at[t + 1]] * later / scale[t + 1]
                n_step = n_step + step * (forward[t][:k].T @ ahead)
                later = np.concatenate((ahead @ step.T, np.ones((len(at[t]) - k, 4))))
                post *= later
            for k in range(4):
                n_emit[k] += np.bincount(at[t], weights=post[:, k], minlength=len(SYMBOLS))
            if t == 0:
                n_first = n_first + post.sum(axis=0)
    return np.concatenate((n_first, n_step.ravel(), n_emit.ravel()))


def learned(sequences: list[list[int]] | DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> Chain:
    """The model of the sequences of symbols, by expectation and maximisation. They are a list, or a column ``symbols``
    (with END after each sequence) of which all rows count, where they lie: only expected numbers come to the driver."""
    first, step, emit = (np.asarray(x, dtype=float) for x in (START, TRANSITIONS, EMISSIONS))
    start = np.concatenate((first, step.ravel(), emit.ravel()))
    if not isinstance(sequences, DataFrame):
        flat = np.array([o for x in sequences for o in (*x, END)], dtype=np.int32)
    for _ in range(rounds):
        if isinstance(sequences, DataFrame):
            now = first, step, emit

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array([expected(*now, batch.column(0).flatten().to_numpy()).tolist()], pa.list_(pa.float64()))], names=["n"])  # noqa: B023

            seen = sorted(tuple(r["n"]) for r in sequences.select("symbols").where("size(symbols) > 0").mapInArrow(run, "n array<double>").collect())
        else:
            seen = [expected(first, step, emit, flat)] if any(sequences) else []
        if not seen:
            return Chain()
        n = prior * start + np.sum(np.array(seen), axis=0)
        n_first, n_step, n_emit = n[:4], n[4:20].reshape(4, 4), n[20:].reshape(4, -1)
        first, step, emit = n_first / n_first.sum(), n_step / n_step.sum(axis=1, keepdims=True), n_emit / n_emit.sum(axis=1, keepdims=True)
    return Chain(first, step, emit)


OBSERVED = T.StructType([T.StructField("id", T.LongType()), T.StructField("symbols", T.ArrayType(T.IntegerType()))])


def fit(df: DataFrame) -> Chain:
    """The model learned from all rows of (scrape_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[*symbols_of(c), END] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=OBSERVED.names)

    return learned(cut(df.where("content IS NOT NULL").select("scrape_id", "content").mapInArrow(run, OBSERVED).distinct()))


FLAGGED = T.StructType([T.StructField("scrape_id", T.LongType())])


def found(df: DataFrame, chain: Chain | None = None) -> DataFrame:
    """scrape_id of the records that are cases."""
    shared = df.sparkSession.sparkContext.broadcast(chain or Chain())  # four small tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            keep = pa.array([chain.is_spam(c) for c in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=FLAGGED.names)

    return df.select("scrape_id", "content").where("trim(content) <> ''").mapInArrow(run, FLAGGED).distinct()


def p6_found(spark, sf):
    """scrape_id of keyword-stuffed pages and lists of links, tags, codes or places."""
    df = scrapes(spark, sf)
    return found(df, fit(df))
