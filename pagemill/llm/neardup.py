"""Problem 7: near copies by a signature-coordinate inverted join.

Each record gets a signature of K coordinates (each the hash of four of the min-hashes of its three-word sequences).
Records are posted under every (coordinate, value) pair but the last coordinate's; collisions are counted and pairs with
at least ``MATCHES`` of them kept. The skipped coordinate travels with the postings, folded to 16 bits, and is compared
where a pair meets. What is left is checked exactly on the sets of sequences (64-bit hashes).

Records of equal sets are one class, numbered by 64 bits of the set's fingerprint (two sets of 25 million meet in a number
with a chance of 1 in 60,000) and posted once. Posting lists are streamed in key order; a list longer than ``LIST``
is not expanded but posted again under its key and every other coordinate, which a true pair must share too. A list
that is long even then is cut into blocks of about ``LIST`` members, and each two blocks meet in a group of their own,
so that no key is expanded in one task and no pair is lost. Classes and links between them are expanded in such blocks,
too. The plan is the same at every size: the only table that is broadcast is a bitmap of ``BITS`` bits at most, which
keeps rows without a partner out of two shuffles.

Results: links between classes, with the members of all classes (:func:`near_copies`), all pairs (:func:`near_pairs`), or
the group of each record (:func:`groups`: components of the links, by least id).

Defined cases: null and short contents (under ``MIN_WORDS`` words) have no rows; several rows of one id (deliveries) count
as one record, and if their texts differ the one of the least class number stands for it; copies are pairs like others,
with similarity 1; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scrapes

WORDS = 3
MIN_WORDS = 60
SIMILARITY = 0.6
#: Min-hashes of a record, coordinates made of them and min-hashes of each, and collisions a candidate pair needs. Four
#: min-hashes and three collisions keep the chance meetings of unlike records few however many there are (1 in 10,000
#: pairs of similarity 0.15). A pair at the similarity limit is missed once in 2,100 (simulated).
HASHES = 144
COORDINATES = 120
ROWS = 4
MATCHES = 3
#: Bits of the bitmap that is broadcast (8 MB).
BITS = 1 << 26
#: Postings of one coordinate value that are expanded at once.
LIST = 256

words_of = re.compile(r"[^\W_]+").findall
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Hasher:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 200_000):
        self.known: dict[str, int] = {}
        self.bound = bound

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > self.bound:
                known.clear()
            for w in {w for w in words if w not in known}:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            return np.array([known[w] for w in words], dtype=np.uint64)

    def sequences(self, text: str, n: int = WORDS) -> tuple[np.ndarray, int]:
        """Distinct hashes of the n-word sequences of ``text``, sorted, and the number of words."""
        words = words_of(text.lower())
        if len(words) < n:
            return np.empty(0, dtype=np.uint64), len(words)
        h = self.words(words)
        s = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            s = _mix((s + h[k : len(h) - n + 1 + k]) * _M)
        return np.unique(s), len(words)


def seeds(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * _M) | np.uint64(1)


def layout(coordinates: int = COORDINATES, rows: int = ROWS, hashes: int = HASHES) -> np.ndarray:
    """The min-hashes of each coordinate: every row goes through fixed shuffles of all min-hashes."""
    columns = []
    for r in range(rows):
        rounds = range(-(-coordinates // hashes))
        columns.append(np.concatenate([np.argsort(_mix(np.arange(hashes, dtype=np.uint64) + np.uint64(hashes * (7 * r + k) + 1)) * _M) for k in rounds])[:coordinates])
    out = np.stack(columns, axis=1)
    for c in out:
        for r in range(rows):  # four different ones
            while c[r] in c[:r]:
                c[r] = (c[r] + 1) % hashes
    return out


def signature(s: np.ndarray, of: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Keys of the coordinates (48 bits): each holds the coordinate's number and value. ``of``: their min-hashes."""
    low = np.empty(len(odd), dtype=np.uint64)
    for a in range(0, len(s), 4096):  # long texts: bounded memory
        block = s[a : a + 4096]
        m = np.empty(len(odd), dtype=np.uint64)
        for k in range(0, len(odd), 48):
            m[k : k + 48] = ((block[None, :] * odd[k : k + 48, None]) ^ (block[None, :] >> np.uint64(32))).min(axis=1)
        low = m if a == 0 else np.minimum(low, m)
    key = np.arange(len(of), dtype=np.uint64) * _M
    for r in range(of.shape[1]):
        key = _mix((key + low[of[:, r]]) * _M)
    return key >> np.uint64(16)


def class_of(s: bytes) -> int:
    """The number of a class: 64 bits of the fingerprint of its set."""
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def signatures(rows: DataFrame, min_words: int = MIN_WORDS, n: int = WORDS) -> DataFrame:
    """(id, node, n, keys) of each text of (id, text) with enough words: class and size of its set of sequences and the
    keys of its coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, odd, of = Hasher(), seeds(HASHES), layout()
        for batch in batches:
            ids, nodes, ns, keys = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s, w = hasher.sequences(t, n)
                if w >= min_words and len(s):
                    ids.append(i)
                    nodes.append(class_of(s.tobytes()))
                    ns.append(len(s))
                    keys.append(signature(s, of, odd))
            if ids:
                flat = np.concatenate(keys).view(np.int64)
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(of))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=SIGNED.names)

    return rows.where(F.col(rows.columns[1]).isNotNull()).mapInArrow(run, SIGNED)


MET = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("key", T.LongType())])


def packed(n: Column, mark: Column) -> Column:
    """The size of a set and, in the low 16 bits, what is compared where a pair meets."""
    return F.shiftleft(n.cast("bigint"), 16).bitwiseOR(mark.bitwiseAND(F.lit(0xFFFF)))


def may_hold(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``ids`` (one column of that name): by a bitmap of a
    hash, of bounded size whatever the number of ids. Rows that are among them all stay."""
    place = F.pmod(F.xxhash64(column), F.lit(BITS))
    maps = ids.select(F.floor(place / 32768).cast("int").alias("_bucket"), (place % 32768).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    x = rows.withColumn("_at", place)
    test = F.expr("(shiftright(cast(conv(hex(substring(_bits, cast((_at % 32768) div 8 + 1 AS INT), 1)), 16, 10) AS INT), cast(_at % 8 AS INT)) & 1) = 1")
    return x.join(F.broadcast(maps), (F.floor(F.col("_at") / 32768).cast("int") == F.col("_bucket")) & test).select(*rows.columns)


def _meet(postings: DataFrame, similarity: float, bound: int) -> DataFrame:
    """From postings (key, id, packed) the pairs (a, b, mark, or -1 if they have not the same) met in lists up to ``bound``
    and whose sizes allow the similarity, and the members (id, null, key) of longer lists. Lists are streamed in key
    order."""

    def fits(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        m, n = p >> 16, q >> 16
        return np.minimum(m, n) >= similarity * np.maximum(m, n)

    def pairs(ids: np.ndarray, ns: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = fits(ns[i], ns[j]) & (ids[i] != ids[j])
        x, y, p, q = ids[i[ok]], ids[j[ok]], ns[i[ok]] & 0xFFFF, ns[j[ok]] & 0xFFFF
        return np.minimum(x, y), np.maximum(x, y), np.where(p == q, p, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the list still open, up to bound + 1 rows
        long_key = None

        def out(a, b, key):
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if key is None else pa.array(key)], names=MET.names)

        def close(ks, ids, ns) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1]))) if len(ks) else np.empty(0, dtype=np.int64)
            sizes = np.diff(np.concatenate((starts, [len(ks)])))
            got = []
            two = starts[sizes == 2]  # most lists that matter have two members
            if len(two):
                got.append(pairs(ids, ns, two, two + 1))
            for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if size > bound:
                    yield out(ids[s : s + size], None, ks[s : s + size])
                    continue
                i, j = np.triu_indices(size, 1)
                got.append(pairs(ids, ns, i + s, j + s))
                if sum(len(x[0]) for x in got) > 100_000:
                    yield out(*map(np.concatenate, zip(*got)))
                    got = []
            if sum(len(x[0]) for x in got):
                yield out(*map(np.concatenate, zip(*got)))

        for batch in batches:
            ks, ids, ns = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(ks):
                continue
            if long_key is not None:  # the open list is a long one: pass its members on
                stop = int(np.searchsorted(ks != long_key, True))
                if stop:
                    yield out(ids[:stop], None, ks[:stop])
                    ks, ids, ns = ks[stop:], ids[stop:], ns[stop:]
                if not len(ks):
                    continue
                long_key = None
            if held:
                ks, ids, ns = (np.concatenate([held[0][c], x]) for c, x in enumerate((ks, ids, ns)))
            once = np.concatenate(([True], (ks[1:] != ks[:-1]) | (ids[1:] != ids[:-1])))  # repeated rows of a record
            ks, ids, ns = ks[once], ids[once], ns[once]
            at = len(ks) - int(np.searchsorted((ks != ks[-1])[::-1], True))  # start of the last, open list
            yield from close(ks[:at], ids[:at], ns[:at])
            if len(ks) - at > bound:
                long_key = ks[-1]
                yield out(ids[at:], None, ks[at:])
                held = []
            else:
                held = [(ks[at:].copy(), ids[at:].copy(), ns[at:].copy())]
        if held:
            yield from close(*held[0])

    keyed = postings.repartition(F.col("key")).sortWithinPartitions("key", "id")
    return keyed.mapInArrow(run, MET)


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame, bound: int = LIST) -> DataFrame:
    """Each two of the ``rows`` (key, id, ...) of one key side by side, as (key, id, ..., id_y, ..._y), both ways round: each
    list is cut into blocks of about ``bound`` members by the ids, and each two blocks meet under a key of their own.
    ``sizes``: (key, size)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / bound)).cast("int")
    placed = rows.join(sizes.select(key, blocks.alias("blocks")), key)
    own, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = placed.withColumn("p", own).withColumn("q", every).drop("blocks")
    y = placed.withColumn("q", own).withColumn("p", every).drop("blocks").withColumnsRenamed({c: f"{c}_y" for c in rows.columns if c != key})
    return x.join(y, [key, "p", "q"]).drop("p", "q")


def candidates(signed: DataFrame, similarity: float = SIMILARITY, bound: int = LIST) -> DataFrame:
    """(a, b) with a < b: classes of (node, n, keys) whose signatures match in at least ``MATCHES`` coordinates."""
    posted = signed.select(F.explode(F.slice("keys", 1, COORDINATES - 1)).alias("key"), F.col("node").alias("id"), packed(F.col("n"), F.element_at("keys", -1)).alias("n"))
    met = cut(_meet(posted, similarity, bound))
    # collisions in the posted coordinates, and the skipped one
    hits = met.where("b IS NOT NULL").groupBy("a", "b").agg((F.count("*") + F.max(F.when(F.col("key") >= 0, 1).otherwise(0))).alias("hits")).where(F.col("hits") >= MATCHES).select("a", "b")
    long_lists = met.where("b IS NULL").select(F.col("a").alias("node"), "key").distinct()
    if long_lists.isEmpty():
        return hits
    # A pair that meets in long lists shares other coordinates besides each: post it under both keys. Its collisions are
    # counted for each long list apart, told by a fold of the list's key.
    again = may_hold(signed, "node", long_lists.select("node")).dropDuplicates(["node"]).join(long_lists, "node")
    finer = again.select(F.col("node").alias("id"), packed(F.col("n"), F.col("key")).alias("n"), F.col("key").alias("first"), F.explode("keys").alias("other")).where("first <> other")
    met2 = cut(_meet(finer.select(F.xxhash64("first", "other").alias("key"), "id", "n"), similarity, bound))
    fine = met2.where("b IS NOT NULL").groupBy("a", "b", "key").agg(F.count("*").alias("hits")).where(F.col("hits") >= MATCHES - 1).select("a", "b")
    # lists of records alike in several min-hashes that are long even so
    rest = met2.where("b IS NULL").select("key", F.col("a").alias("node")).distinct().join(signed.select("node", "n").distinct(), "node").select("key", F.col("node").alias("id"), "n")
    both = in_blocks(rest, "key", rest.groupBy("key").agg(F.count("*").alias("size")), bound)
    more = both.where((F.col("id") < F.col("id_y")) & (F.least("n", "n_y") >= similarity * F.greatest("n", "n_y"))).select(F.col("id").alias("a"), F.col("id_y").alias("b"))
    return hits.union(fine).union(more).distinct()


SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("s", T.BinaryType())])


def verified(pairs: DataFrame, members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, n: int = WORDS) -> DataFrame:
    """(a, b, similarity) of the pairs of classes whose sets of sequences reach the similarity. ``members`` is (node, id),
    ``texts`` (id, text); one text of each class that is in a pair is read again."""
    pairs = cut(pairs)
    first = members.groupBy("node").agg(F.min("id").alias("id"))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first.hint("merge"), "node"))
    need = may_hold(texts.where("text IS NOT NULL"), "id", ids.select("id")).join(ids.hint("merge"), "id").select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            s = [hasher.sequences(t, n)[0].tobytes() for t in batch.column(1).to_pylist()]
            own = [class_of(x) == node for x, node in zip(s, batch.column(0).to_pylist())]  # not another delivery's text
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], names=SETS.names).filter(pa.array(own, pa.bool_()))

    known = need.mapInArrow(sets, SETS).dropDuplicates(["node"])
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.intersect1d(p, q, assume_unique=True).size
                sim.append(both / (p.size + q.size - both))
            got = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=out.names)
            yield got.filter(pa.array([s >= similarity for s in sim], pa.bool_()))

    joined = pairs.join(known.select(F.col("node").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(known.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(compare, out)


def near_copies(texts: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between classes of (id, text), and the members (node, id) of all classes."""
    signed = cut(signatures(texts, min_words=min_words, n=n))
    several = signed.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("id", "least")
    if not several.isEmpty():  # deliveries of different texts
        signed = cut(signed.join(several, "id", "left").where("least IS NULL OR node = least").drop("least"))
    members = cut(signed.select("node", "id").distinct())
    return cut(verified(candidates(signed, similarity), members, texts, similarity, n)), members


def expanded(links: DataFrame, members: DataFrame, bound: int = LIST) -> DataFrame:
    """(a, b, similarity) with a < b of all pairs of records: links between classes and pairs within them, each class in
    blocks of about ``bound`` members."""
    sizes = members.groupBy("node").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / bound).cast("int")
    placed = members.join(sizes, "node").select("node", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))

    def side(rows: DataFrame, end: str, to: str) -> DataFrame:
        """``rows`` with each member of the class of ``end`` as ``to``."""
        spread = rows.join(sizes.select(F.col("node").alias(end), blocks.alias("blocks")), end).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return spread.join(placed.select(F.col("node").alias(end), "block", F.col("id").alias(to)), [end, "block"]).drop("block")

    across = side(side(links, "a", "x"), "b", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    own = sizes.where("size > 1")
    within = in_blocks(members, "node", own, bound).where("id < id_y").select(F.col("id").alias("a"), F.col("id_y").alias("b"), F.lit(1.0).alias("similarity"))
    return across.union(within)


def near_pairs(texts: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(a, b, similarity) with a < b of all near copies among (id, text), each pair once."""
    return expanded(*near_copies(texts, similarity, n, min_words))


def groups(texts: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, group_id, links) of the records that have a near copy: the least id among all that are linked to it, directly
    or over others, and the number of classes its class is linked to. Components are found on the links between
    classes by sending each node's larger neighbours, then all its neighbours, to the least one, until nothing moves."""
    links, members = near_copies(texts, similarity, n, min_words)
    edges = cut(links.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # now each edge points to a lesser node: send these to the least of them
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
        new = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        if new.count() == edges.count() and new.subtract(edges).isEmpty():
            break
        edges = new
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    size = members.groupBy("node").agg(F.count("*").alias("size"))
    own = members.join(size, "node").join(ends, "node", "left").join(root, "node", "left").where("size > 1 OR links IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    heads = own.groupBy("root").agg(F.min("id").alias("group_id"))
    return own.join(heads, "root").select("id", "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def records(df: DataFrame) -> DataFrame:
    """(id, text) of the scrapes that have content."""
    return df.where("content IS NOT NULL").select(F.col("scrape_id").alias("id"), F.col("content").alias("text"))


def p7_found(spark, sf):
    """(scrape_id_a, scrape_id_b) of all near copies."""
    got = near_pairs(records(scrapes(spark, sf)))
    return got.select(F.col("a").alias("scrape_id_a"), F.col("b").alias("scrape_id_b"))


def p7_groups(spark, sf):
    """(scrape_id, group_id, links) of all records that have a near copy."""
    return groups(records(scrapes(spark, sf))).withColumnRenamed("id", "scrape_id")
