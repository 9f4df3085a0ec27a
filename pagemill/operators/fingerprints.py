"""SimHash of words and of page structure, and pairs within a Hamming distance."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import shared_checkpoints
from .page import tag_sequence

_BASIS, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
_SPACE = re.compile(r"[\s\x85\xa0  -     　]+")


def fnv1a64(data: bytes) -> int:
    h = _BASIS
    for b in data:
        h = ((h ^ b) * _PRIME) & _MASK
    return h


class WordHasher:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 200_000):
        self.known: dict[str, int] = {}
        self.bound = bound

    def __call__(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > self.bound:
                self.known.clear()
            h = self.known[word] = fnv1a64(word.encode("utf-8", "surrogatepass"))
        return h


def simhash(words: list[str], hasher: WordHasher) -> int:
    """Signed 64-bit SimHash: each occurrence votes on each bit; ties are 0; no words give 0."""
    if not words:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, len(words), 65536):  # long texts: bounded memory
        h = np.array([hasher(w) for w in words[a : a + 65536]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(words), bitorder="little").view("<i8")[0])


def tag_words(html: str) -> list[str]:
    tags = tag_sequence(html)
    return ["_".join(tags[i : i + 3]) for i in range(len(tags) - 2)] if len(tags) >= 3 else tags


def _hashed(words: Callable[[str], list[str]]):
    """A column function of the SimHash of the words of a text; a task keeps its hashes of words."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = WordHasher()
        for texts in batches:
            yield pd.Series([simhash(words(t or ""), hasher) for t in texts], dtype="int64")

    return run


#: SimHash of a text's words, and of a page's structure: its start tags in threes.
simhash_of = _hashed(lambda t: [w for w in _SPACE.split(t) if w])
tag_fingerprint = _hashed(tag_words)

#: Fingerprints of a block, blocks at most (larger ones beyond), and pairs that are sent on at once.
BLOCK = 8192
BLOCKS = 128
BATCH = 1 << 19


def within(x: np.ndarray, y: np.ndarray | None, distance: int, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in ``x``, place in ``y``, distance) of the pairs of uint64 within a Hamming distance, in pieces of about
    ``batch``; without ``y``, each two of the ``x`` once. A fingerprint meets only those whose number of bits set differs by
    ``distance`` at most."""
    order = np.argsort(np.bitwise_count(x), kind="stable")
    other = order if y is None else np.argsort(np.bitwise_count(y), kind="stable")
    some, all_ = x[order], (x if y is None else y)[other]
    bits, bits_all = np.bitwise_count(some).astype(np.int64), np.bitwise_count(all_).astype(np.int64)
    low = np.arange(1, len(some) + 1) if y is None else np.searchsorted(bits_all, bits - distance, "left")
    high = np.searchsorted(bits_all, bits + distance, "right")
    apart, count, near = np.empty(len(all_), np.uint64), np.empty(len(all_), np.uint8), np.empty(len(all_), bool)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def piece() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(order[[i for i, _, _ in held]], [len(j) for _, j, _ in held]), other[np.concatenate([j for _, j, _ in held])], np.concatenate([d for _, _, d in held])

    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        n = b - a
        if n <= 0:
            continue
        np.bitwise_xor(all_[a:b], some[i], out=apart[:n])
        np.bitwise_count(apart[:n], out=count[:n])
        np.less_equal(count[:n], distance, out=near[:n])
        j = np.flatnonzero(near[:n])
        if len(j):
            held.append((i, a + j, count[j]))
            size += len(j)
            if size >= batch:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("distance", T.LongType())])


def near_pairs(prints: DataFrame, distance: int, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance) with a < b of fingerprints (id, fingerprint) within a Hamming distance of at most six; zero (empty
    texts) has no pairs.

    Fingerprints are dealt to blocks by their ids, and each two blocks meet once, in a group that compares them where
    they lie, so that only results become rows. The bits of texts are far from even and independent: keys of two equal octets
    gave a join a third as many rows as there are pairs; comparing 64-bit words takes a few nanoseconds a pair."""
    if not 0 <= distance <= 6:
        raise ValueError("distance must be between 0 and 6")
    shared_checkpoints(prints.sparkSession)
    prints = prints.where("fingerprint <> 0").select("id", "fingerprint").distinct().checkpoint(eager=True)
    n = min(blocks, -(-prints.count() // block)) or 1
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = prints.select("id", "fingerprint", own.alias("own")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    posted = dealt.select(F.least("own", "k").alias("p"), F.greatest("own", "k").alias("q"), "own", "id", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        own, ids, every = (group.column(c).to_numpy() for c in ("own", "id", "fingerprint"))
        every = every.view(np.uint64)
        x, y = own == p, own == q
        ids_x, ids_y = ids[x], ids[y]
        for i, j, d in within(every[x], None if p == q else every[y], distance):
            i, j = ids_x[i], ids_y[j]
            keep = i != j
            yield pa.RecordBatch.from_arrays([pa.array(z[keep]) for z in (np.minimum(i, j), np.maximum(i, j), d.astype(np.int64))], names=PAIRS.names)

    return posted.repartition(n * (n + 1) // 2, "p", "q").groupBy("p", "q").applyInArrow(run, PAIRS)
