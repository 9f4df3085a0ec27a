"""Problem 1: cut oversized texts into balanced pieces at natural boundaries.

The smallest number of pieces is computed first, equal-length targets are placed, each is snapped to the
strongest boundary near it, and if any piece then breaks the limit one more piece is used. Each piece but the
first starts exactly ``overlap_tokens`` (three code points a token) before the end of the one before.

Defined cases: null, empty and short texts come out of :func:`split_oversized` as no row; repeated rows give
repeated pieces; a text without any boundary is cut at its targets, never inside a sequence of combining marks
or a CR LF pair where the limit allows; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of one token in the service's estimate.
CHARS = 3
#: Boundaries, strongest first; a piece may end where a match ends.
BOUNDARIES = [
    re.compile(r"\n(?=#{1,6} )"),
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*\s*"),
    re.compile(r"[;:,–—]\s+|[，；：、]"),
    re.compile(r"\s+"),
]


def _joined(text: str, at: int) -> bool:
    c = text[at]
    return unicodedata.combining(c) != 0 or unicodedata.category(c) in ("Mn", "Me", "Cf") or text[at - 1 : at + 1] == "\r\n" or text[at - 1] == "‍"


def _snap(text: str, target: int, reach: int) -> int:
    """The end of the strongest boundary within ``reach`` of ``target``, the nearest of these, else the target."""
    lo, hi = max(1, target - reach), min(len(text) - 1, target + reach)
    base = max(0, lo - 40)
    while base and not text[base - 1].isalnum():  # a boundary may begin long before it ends
        base -= 1
    window = text[base : hi + 40]
    for pattern in BOUNDARIES:
        ends = [e for m in pattern.finditer(window) if lo <= (e := base + m.end()) <= hi]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    for step in range(reach + 1):
        for at in (target - step, target + step):
            if lo <= at <= hi and not _joined(text, at):
                return at
    return target


def cut_points(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of ``text``; one piece if it is within the limit."""
    n, cap, over = len(text), CHARS * max_tokens + CHARS - 1, CHARS * overlap_tokens
    if over >= cap:
        raise ValueError("the overlap must be smaller than the limit")
    if n <= cap:
        return [(0, n)] if n else []
    count = 1 + -(-(n - cap) // (cap - over))
    while True:
        length = (n + (count - 1) * over) / count
        # reach below half the new part of a piece, so that ends always ascend
        reach = max(0, int(min(length / 4, (length - over) / 2.5, max(cap - length, 24))))
        ends = [_snap(text, round(length * (i + 1) - over * i), reach) for i in range(count - 1)] + [n]
        starts = [0, *(max(0, e - over) for e in ends[:-1])]
        if all(e - s <= cap for s, e in zip(starts, ends)) and all(a < b for a, b in zip(ends, ends[1:])):
            return list(zip(starts, ends))
        count += 1


def split_oversized(df: DataFrame, key: str, text: str, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """Pieces of the texts above the limit: (key, piece_no, piece_start, piece_end, piece). Only rows above the
    limit reach Python; the test of the limit is a native filter."""
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("piece_no", T.LongType(), False),
            T.StructField("piece_start", T.LongType(), False),
            T.StructField("piece_end", T.LongType(), False),
            T.StructField("piece", T.StringType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # long texts: small batches out
                part = batch.slice(start, 64)
                index, rows = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for no, (a, b) in enumerate(cut_points(t, max_tokens, overlap_tokens), 1):
                        index.append(i)
                        rows.append((no, a, b, t[a:b]))
                if rows:
                    no, a, b, p = zip(*rows)
                    keys = part.column(0).take(pa.array(index, type=pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(no, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.string())], names=schema.names)

    long_ones = df.select(F.col(key), F.col(text)).where(F.floor(F.length(text) / CHARS) > max_tokens)
    return long_ones.mapInArrow(run, schema)


def limits(spark, sf: str, purpose: str) -> tuple[int, int]:
    """The limit and overlap of a purpose, from the fixed table of limits."""
    row = spark.read.parquet(f"{sf}/split_limits.parquet").where(F.col("purpose") == purpose).first()
    return row["max_tokens"], row["overlap_tokens"]


def _pieces(spark, sf: str, purpose: str) -> DataFrame:
    from .common import scrapes

    return split_oversized(scrapes(spark, sf), "scrape_id", "content", *limits(spark, sf, purpose))


def p1_found(spark, sf):
    """Records that the operator cuts under the limit of purpose ``index``."""
    return _pieces(spark, sf, "index").where("piece_no > 1").select("scrape_id").distinct()


def p1_pieces(spark, sf):
    """All pieces of the records above the limit of ``index``; repeated deliveries count once."""
    p = _pieces(spark, sf, "index").select("scrape_id", "piece_no", "piece_start", "piece_end", "piece")
    return p.dropDuplicates(["scrape_id", "piece_no", "piece_start", "piece_end"])
