"""Problem 10: long exact spans shared between records, by sliding sentence spans.

Texts are cut into sentences and clauses; stretches without any mark are cut where a rolling hash is least in its
neighbourhood, so that no piece is long and pieces depend only on the characters near them. Every run of several
consecutive pieces is hashed; of the runs that begin within a number of characters the one of the least hash is posted, so
that any span of ``SPAN`` characters holds a posted run, the same in every record (see :func:`among`). Posted runs are
joined globally by one shuffle, which carries their places. Around the runs that occur in two records the characters
are compared exactly, to the left and to the right, which gives the spans' true bounds.

Runs that occur very often (more than ``GROUP`` times) are not compared within one group: their records' windows of
``SPAN`` characters are hashed and counted instead, which no single key can hold up. Groups are streamed; none is held
beyond ``GROUP`` rows. Nothing is broadcast: the plan is the same at every size.

Defined cases: null texts and texts under ``SPAN`` characters have no rows; offsets count code points; spans repeated
only within one record are not shared; equal texts share all of themselves; overlapping and touching spans are
merged into one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents

SPAN = 200
#: Least characters of a run; its last piece completes it.
RUN = 48
#: Neighbourhood of the cuts in stretches without marks, characters hashed there, and the cuts' distance from marks.
NEAR = 16
GRAM = 8
APART = 4
GROUP = 256

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def among(span: int) -> int:
    """Places of run starts among which one is posted. A cut depends on NEAR - 1 characters before it and NEAR + GRAM - 2
    after it, and there is one within any NEAR + 2 * APART places; a run ends at the first cut RUN or more characters on.
    So all runs that begin within these places of a span are the same wherever the span stands, and there is one."""
    return span - (NEAR - 1) - (NEAR + GRAM - 1) - (RUN + NEAR + 2 * APART)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Powers:
    """Powers of the base of the rolling hash and of its inverse, modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m, _BASE, dtype=np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m, self.inverse, dtype=np.uint64))), dtype=np.uint64)


#: Code points of the texts that are worked on at once; a longer text is worked on alone.
AT_ONCE = 400_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _kinds() -> np.ndarray:
    """Kind of each code point: 1 a mark before white space, 2 a mark by itself, 3 a line end, 4 other white space."""
    k = np.zeros(0x10000, dtype=np.uint8)
    k[[ord(c) for c in ".!?…;:,"]] = 1
    k[[ord(c) for c in "。！？；：，、"]] = 2
    k[ord("\n")] = 3
    k[[c for c in range(0x10000) if chr(c).isspace() and c != 10]] = 4
    return k


_KIND = _kinds()


class Texts:
    """Several texts laid end to end, a separator after each, with prefix sums for the hash of any part."""

    def __init__(self, texts: list[str], powers: Powers):
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)[:-1]))
        self.ends = self.starts + self.lengths
        self.codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        powers.grow(len(self.codes) + 1)
        self.powers = powers
        values = _mix((self.codes.astype(np.uint64) + np.uint64(1)) * _M)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values * powers.up[: len(values)], dtype=np.uint64)))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.powers.down[a] + (b - a).astype(np.uint64))

    def boundaries(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending starts of the pieces and ends of the texts, and the number of each one's text."""
        n = len(self.codes)
        kind = _KIND[np.minimum(self.codes, 0xFFFF)]
        kind[self.ends] = 5
        before = np.concatenate(([5], kind[:-1]))
        earlier = np.concatenate(([5, 5], kind[:-2]))
        fresh = (kind != 3) & (kind != 4)
        mark = (before == 2) & (kind != 2) | fresh & ((before == 3) | (before == 4) & (earlier == 1))
        mark[self.starts] = True
        mark[self.ends] = True
        marks = np.flatnonzero(mark)
        if n > NEAR + GRAM:
            number = np.repeat(np.arange(len(self.starts)), self.lengths + 1)
            h = np.full(n, _TOP, dtype=np.uint64)
            at = np.flatnonzero(np.arange(n) + GRAM <= self.ends[number])
            h[at] = np.minimum(self.hash(at, at + GRAM), _TOP - np.uint64(1))
            h[self.ends] = 0  # the least of every window over two texts, so that none of their places is chosen by it
            least = _extreme(h, NEAR, np.minimum)
            # chosen: the least of some window of NEAR places that holds it
            padded = np.concatenate((np.zeros(NEAR - 1, dtype=np.uint64), least, np.zeros(NEAR - 1, dtype=np.uint64)))
            chosen = np.flatnonzero((_extreme(padded, NEAR, np.maximum) == h) & (h != 0) & (h != _TOP))
            k = np.searchsorted(marks, chosen, side="right") - 1
            mark[chosen[(chosen - marks[k] >= APART) & (marks[np.minimum(k + 1, len(marks) - 1)] - chosen >= APART)]] = True
            marks = np.flatnonzero(mark)
        return marks, np.searchsorted(self.starts, marks, side="right") - 1

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, start, end) of the run from each piece: the fewest pieces with at least RUN
        characters. Places count over all the texts."""
        bounds, number = self.boundaries()
        stop = np.searchsorted(bounds, bounds + RUN)
        ok = stop < len(bounds)
        ok[ok] = bounds[stop[ok]] <= self.ends[number[ok]]
        return number[ok], bounds[ok], bounds[stop[ok]]

    def posted(self, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, place within it, hash) of the runs that have the least hash of those that begin within
        some ``among(span)`` places; of equal hashes each."""
        number, x, y = self.runs()
        w = among(span)
        h = self.hash(x, y)
        if not len(x):
            return number, x, h
        # least hash of the runs that begin in each stretch of w places; a place without a run has the greatest
        at = np.full(len(self.codes) + 2 * (w - 1), _TOP, dtype=np.uint64)
        at[x + (w - 1)] = np.minimum(h, _TOP - np.uint64(1))
        least = _extreme(at, w, np.minimum)
        least[least == _TOP] = 0
        kept = _extreme(least, w, np.maximum)[x] == np.minimum(h, _TOP - np.uint64(1))
        # _extreme over all stretches that hold x gives the greatest of their least hashes: x has it if it is the least of one
        return number[kept], x[kept] - self.starts[number[kept]], h[kept]


def portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are worked on at once."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _extreme(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) of each w consecutive values."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = f(out[:-step], out[step:])
        done += step
    return out


POSTED = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.IntegerType())])
SHARED = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("often", T.BooleanType())])


def _posted(span: int):
    """The posted runs of (doc_id, text), with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                number, at, h = Texts(texts[a:b], powers).posted(span)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a:b][number]), pa.array(at.astype(np.int32))], names=POSTED.names)

    return run


def _shared(group: int):
    """Of posted runs in the order of their hashes those that two records have, or that occur more than ``group`` times
    (``often``). At most ``group`` rows of a hash are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last hash's rows so far, while they are no more than ``group``
        long_key = None

        def out(h, d, at, often):
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.array(at), pa.array(np.full(len(h), often))], names=SHARED.names)

        def closed(h, d, at) -> Iterator[pa.RecordBatch]:
            """Whole groups."""
            if not len(h):
                return
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(h)])))
            two = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts)
            many = sizes > group
            for keep, often in ((two & ~many, False), (two & many, True)):
                rows = np.repeat(keep, sizes)
                if rows.any():
                    yield out(h[rows], d[rows], at[rows], often)

        for batch in batches:
            h, d, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if long_key is not None:
                stop = int(np.searchsorted(h != long_key, True)) if len(h) and h[0] == long_key else 0
                if stop:
                    yield out(h[:stop], d[:stop], at[:stop], True)
                    h, d, at = h[stop:], d[stop:], at[stop:]
                if not len(h):
                    continue
                long_key = None
            if not len(h):
                continue
            if held is not None:
                h, d, at = (np.concatenate((x, y)) for x, y in zip(held, (h, d, at)))
                held = None
            last = len(h) - int(np.searchsorted((h != h[-1])[::-1], True))  # start of the open group
            yield from closed(h[:last], d[:last], at[:last])
            if len(h) - last > group:
                long_key = h[-1]
                yield out(h[last:], d[last:], at[last:], True)
            else:
                held = [h[last:].copy(), d[last:].copy(), at[last:].copy()]
        if held is not None:
            yield from closed(*held)

    return run


def shared_runs(docs: DataFrame, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """(h, doc_id, at, often) of the posted runs that stand in two records."""
    return docs.mapInArrow(_posted(span), POSTED).repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(_shared(group), SHARED)


AROUND = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
WINDOWS = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType())])
COVER = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("earlier", T.BooleanType())])


def _around(span: int):
    """For (doc_id, text, runs): each run with the characters that a span holding it may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for r in runs:
                    x = r["at"]
                    rows.append((r["h"], i, x, text[max(0, x + RUN - span) : x], text[x : x + span]))
                if len(rows) > 5000:
                    yield _arrow(rows, AROUND)
                    rows = []
            if rows:
                yield _arrow(rows, AROUND)

    return run


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows), schema.fields)], names=schema.names)


def _windows(span: int):
    """For (doc_id, text, runs): two hashes of each window of ``span`` characters that holds a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                t = Texts([text], powers)
                n = len(text)
                mark = np.zeros(n + 2, dtype=np.int64)
                for r in runs:
                    lo, hi = max(0, r["at"] + RUN - span), min(r["at"], n - span)
                    if lo <= hi:
                        mark[lo] += 1
                        mark[hi + 1] -= 1
                at = np.flatnonzero(np.cumsum(mark)[: max(0, n - span + 1)] > 0)
                if len(at):
                    half = at + span // 2
                    w1 = t.hash(at, at + span).view(np.int64)
                    w2 = (t.hash(at, half) ^ (t.hash(half, at + span) * _M)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(np.full(len(at), i, dtype=np.int64)), pa.array(at.astype(np.int64))], names=WINDOWS.names)

    return run


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:  # a[:lo] == b[:lo], a[:hi] != b[:hi]
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def compare(group: list[tuple[int, int, str, str]], span: int = SPAN) -> list[tuple[int, int, int, bool]]:
    """(doc, start, end, earlier) of the spans of at least ``span`` characters around one run that records share:
    from (doc, place, characters before, characters from there on). ``earlier``: shared with a lower doc."""
    out: list[tuple[int, int, int, bool]] = []
    if len(group) <= 24:
        flipped = [x[2][::-1] for x in group]
        for k, (d, p, _, right) in enumerate(group):
            for m in range(k):
                e, q, _, other = group[m]
                if d == e:
                    continue
                r, left = common_prefix(right, other), common_prefix(flipped[k], flipped[m])
                if left + r >= span:
                    out.append((d, p - left, p + r, d > e))
                    out.append((e, q - left, q + r, e > d))
        return out
    # many: a window is shared if the same characters stand in two records
    seen: dict[str, list[int]] = {}
    for d, _, left, right in group:
        s = left + right
        for k in range(len(s) - span + 1):
            w = s[k : k + span]
            got = seen.get(w)
            if got is None:
                seen[w] = [d, d]
            else:
                got[0], got[1] = min(got[0], d), max(got[1], d)
    for d, p, left, right in group:
        s, base = left + right, p - len(left)
        for k in range(len(s) - span + 1):
            low, high = seen[s[k : k + span]]
            if low != high:
                out.append((d, base + k, base + k + span, d > low))
    return _merge_rows(out)


def _merge_rows(rows: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, bool]]:
    out: list[tuple[int, int, int, bool]] = []
    for d, a, b, e in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        if out and out[-1][0] == d and out[-1][3] == e and a <= out[-1][2]:
            out[-1] = (d, out[-1][1], max(b, out[-1][2]), e)
        else:
            out.append((d, a, b, e))
    return out


def _compared(span: int):
    """Groups of one hash, streamed in order: rows of COVER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            for h, d, p, left, right in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if h != key:
                    if len(group) > 1:
                        out += compare(group, span)
                    key, group = h, []
                    if len(out) > 20_000:
                        yield _arrow(out, COVER)
                        out = []
                group.append((d, p, left, right))
        if len(group) > 1:
            out += compare(group, span)
        if out:
            yield _arrow(out, COVER)

    return run


def coverage(docs: DataFrame, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """(doc_id, a, b, earlier): parts of the texts of (doc_id, text) that stand in another record, not yet merged."""
    if among(span) < NEAR + 2 * APART:
        raise ValueError("span is too short to hold a run")
    docs = docs.where(F.length("text") >= span)
    lists = cut(shared_runs(docs, span, group).groupBy("doc_id", "often").agg(F.collect_list(F.struct("h", "at")).alias("runs")))  # a record's own runs
    few, many = lists.where("NOT often").select("doc_id", "runs"), lists.where("often").select("doc_id", "runs")

    def texts(chosen: DataFrame) -> DataFrame:
        return docs.join(chosen, "doc_id").select("doc_id", "text", "runs")

    near = texts(few).mapInArrow(_around(span), AROUND).repartition(F.col("h")).sortWithinPartitions("h")
    out = near.mapInArrow(_compared(span), COVER)
    if many.isEmpty():
        return out
    windows = texts(many).mapInArrow(_windows(span), WINDOWS)
    shared = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    often = windows.join(shared, ["w1", "w2"]).select("doc_id", F.col("at").alias("a"), (F.col("at") + span).alias("b"), (F.col("doc_id") > F.col("low")).alias("earlier"))
    return out.union(often)


SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType())])


def merged(cover: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): parts of each record, overlapping and touching ones in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] | None = None
        for batch in batches:
            rows = []
            for d, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if now is not None and now[0] == d and a <= now[2]:
                    now[2] = max(now[2], b)
                else:
                    if now is not None:
                        rows.append(tuple(now))
                    now = [d, a, b]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=SPANS.names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in now], names=SPANS.names)

    rows = cover.select("doc_id", "a", "b").distinct().repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "a", "b")
    return rows.mapInArrow(run, SPANS)


def amounts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each record stands elsewhere; null texts count 0."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    out = docs.select("doc_id", n.alias("n_chars")).join(sums, "doc_id", "left")
    shared = F.coalesce("shared", F.lit(0)).cast("bigint")
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))


_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]+|\n\s*")
CLEAN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())])


def without_repeats(docs: DataFrame, cover: DataFrame) -> DataFrame:
    """(doc_id, text, removed): texts without the sentences covered by a span that an earlier record has."""
    later = merged(cover.where("earlier")).groupBy("doc_id").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))  # a record's own spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not spans or text is None:
                    texts.append(text)
                    removed.append(0)
                    continue
                cuts = [0, *(m.end() for m in _SENTENCE.finditer(text)), len(text)]
                parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
                gone = [any(s["span_start"] <= a and a + len(text[a:b].rstrip()) <= s["span_end"] for s in spans) and bool(text[a:b].strip()) for a, b in parts]
                texts.append("".join(text[a:b] for (a, b), g in zip(parts, gone) if not g))
                removed.append(sum(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=CLEAN.names)

    return docs.join(later, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, CLEAN)


def _docs(spark, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "text")


def p10_found(spark, sf):
    """(doc_id, span_start, span_end) of the shared parts."""
    return merged(coverage(_docs(spark, sf)))


def p10_shares(spark, sf):
    """How much of each document stands in another."""
    return amounts(_docs(spark, sf), p10_found(spark, sf))


def p10_clean(spark, sf):
    """Documents without the sentences that an earlier document has in a shared span."""
    return without_repeats(_docs(spark, sf), coverage(_docs(spark, sf)))
