"""Problem 8: byte-level BPE ids of a whole corpus by a pair occurrence index.

Words (pieces of the vocabulary's split pattern) are encoded once per worker and batch, not once per
occurrence: the distinct unseen words of a batch are laid out in one array of symbols, each adjacent
pair is mapped to all its positions in that array, and the active ranks are applied in ascending order,
each merge updating the lists of the pairs it makes.

Texts: null and empty give an empty list; nothing is trimmed or normalised; strings that look like special
tokens are ordinary text; lone surrogates (not possible in Parquet strings) are encoded as ``?``.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The published split pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memory of pieces already encoded; it is emptied when full.
MEMORY = 200_000
#: Longest piece, in characters, that is worth remembering.
REMEMBER = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for
    themselves, all others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(others)) for b in range(256)]


class PairIndex:
    """Merges of a byte-level BPE vocabulary, applied to many words at once."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[s] for s in byte_symbols()], dtype=np.int32)
        #: (left id, right id) as one integer -> (rank, merged id)
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        self.pair: list[int] = []
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            key = vocab[left] << 32 | vocab[right]
            self.rank[key] = rank
            self.merged.append(vocab[left + right])
            self.pair.append(key)
        #: Two bytes that stand side by side in some entry of the vocabulary; no merge crosses any other two.
        number = {c: i for i, c in enumerate(byte_symbols())}
        self.joins = np.zeros(1 << 16, dtype=bool)
        for entry in vocab:
            b = [number[c] for c in entry]
            for x, y in zip(b, b[1:]):
                self.joins[x << 8 | y] = True
        self.atoms: dict[bytes, bytes] = {}

    def encode_words(self, words: list[bytes], memory: int = MEMORY) -> list[bytes]:
        """Ids of each word, as little-endian int32 bytes. Words are first cut where no merge can cross, and only
        parts not met before are merged."""
        if not words:
            return []
        if len(self.atoms) > memory:
            self.atoms.clear()
        flat = b"".join(words)
        b = np.frombuffer(flat, dtype=np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        cuts = np.ones(len(b), dtype=bool)  # cuts[i]: an atom ends after byte i
        cuts[:-1] = ~self.joins[b[:-1] << 8 | b[1:]]
        cuts[ends - 1] = True
        stops = (np.flatnonzero(cuts) + 1).tolist()
        parts = [flat[x:y] for x, y in zip([0, *stops], stops)]
        atoms = self.atoms
        new = list(set(parts) - atoms.keys())
        atoms.update(zip(new, self.merge(new)))
        per_word = np.cumsum(cuts)[ends - 1].tolist()
        get = atoms.__getitem__
        return [get(parts[x]) if y - x == 1 else b"".join(map(get, parts[x:y])) for x, y in zip([0, *per_word], per_word)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The pair occurrence index: ids of each part."""
        if not words:
            return []
        lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)].tolist()
        n = len(symbols)
        # right[i] / left[i]: neighbours inside the word, -1 at its ends; a merged-away symbol becomes -1
        last = set((ends - 1).tolist())
        right = [-1 if i in last else i + 1 for i in range(n)]
        left = [-1] * n
        for i, r in enumerate(right):
            if r >= 0:
                left[r] = i
        rank, merged, pair = self.rank, self.merged, self.pair
        index: dict[int, list[int]] = {}
        for i, r in enumerate(right):
            if r >= 0 and (k := rank.get(symbols[i] << 32 | symbols[r])) is not None:
                index.setdefault(k, []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            k = heapq.heappop(active)
            places = index.pop(k, None)
            if places is None:
                continue
            want, new = pair[k], merged[k]
            places.sort()
            for i in places:
                r = right[i]
                if r < 0 or symbols[i] < 0 or symbols[i] << 32 | symbols[r] != want:
                    continue
                symbols[i] = new
                symbols[r] = -1
                after = right[i] = right[r]
                before = left[i]
                if after >= 0:
                    left[after] = i
                    if (q := rank.get(new << 32 | symbols[after])) is not None:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(i)
                if before >= 0 and (q := rank.get(symbols[before] << 32 | new)) is not None:
                    if q not in index:
                        index[q] = []
                        heapq.heappush(active, q)
                    index[q].append(before)
        flat = np.array(symbols, dtype=np.int32)
        kept = np.cumsum(flat >= 0)
        flat = flat[flat >= 0]
        bounds = np.concatenate(([0], kept[ends - 1])).tolist()
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Ids of whole texts, with a bounded memory of pieces. A piece is what lies between two places where one
    space is followed by a non-space; the split pattern never joins characters across such a place."""

    def __init__(self, spec: bytes, memory: int = MEMORY):
        import regex

        self.index = PairIndex(spec)
        self.words_of = regex.compile(PATTERN).findall
        self.odd = re.compile(r" (?=\s|$)").search
        self.places = re.compile(r"(?= \S)").split
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.memory = memory

    def split(self, text: str) -> list[str]:
        if self.odd(text):
            return [p for p in self.places(text) if p]
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t) if t else () for t in texts]
        if len(self.known) > self.memory:
            self.known.clear()
        if len(self.words) > self.memory:
            self.words.clear()
        known, own = self.known, {}
        unseen = set(chain.from_iterable(split)) - known.keys()
        if unseen:
            cut = {p: self.words_of(p) for p in unseen}
            words = self.words
            new = list(set(chain.from_iterable(cut.values())) - words.keys())
            fresh = dict(zip(new, self.index.encode_words([w.encode("utf-8", "replace") for w in new])))
            words.update((w, i) for w, i in fresh.items() if len(w) <= REMEMBER)
            for p, ws in cut.items():
                ids = b"".join([fresh[w] if w in fresh else words[w] for w in ws])
                (known if len(p) <= REMEMBER else own)[p] = ids
        if own:
            return [b"".join([own[p] if p in own else known[p] for p in s]) for s in split]
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: bytes) -> Encoder:
    """The worker's encoder of a vocabulary; built once per worker process."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _spec(df: DataFrame, tokenizer: str):
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not follow the data


def encode(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, ids: str = "ids") -> DataFrame:
    """``df`` without ``text`` and with ``ids``, array<int>. Other columns pass through unchanged; a column
    already called ``ids`` is replaced. An empty table gives an empty table."""
    spec = _spec(df, tokenizer)
    df = df.drop(ids) if ids != text else df
    at = df.columns.index(text)
    fields = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(spec.value)
        for batch in batches:
            got = coder.encode(batch.column(at).to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(g) // 4 for g in got]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(got), dtype=np.int32), type=pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, n: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with the number of its tokens as ``n`` (bigint)."""
    spec = _spec(df, tokenizer)
    at = df.columns.index(text)
    fields = [f for f in df.schema.fields if f.name not in (text, n)]
    schema = T.StructType([*fields, T.StructField(n, T.LongType(), False)])
    keep = [i for i, c in enumerate(df.columns) if c not in (text, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(spec.value)
        for batch in batches:
            got = coder.encode(batch.column(at).to_pylist())
            counts = pa.array([len(g) // 4 for g in got], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), counts], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def p8_ids(spark, sf):
    """(doc_id, ids) of every document by byte_bpe_50k."""
    from .common import documents

    return encode(documents(spark, sf).select("doc_id", "text"))
