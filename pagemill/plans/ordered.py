"""Folds over a key's rows in order, in chunks of time: a window holds a chunk of a key, not the key, and what the chunks before
leave is found on one row a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "DAY"


def with_chunk(df: DataFrame, ts: str, unit: str = CHUNK) -> DataFrame:
    """``df`` with ``_chunk``: the start of the unit of time that a row lies in."""
    return df.withColumn("_chunk", F.date_trunc(unit, F.col(ts).cast("timestamp")))


def _joined(df: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Rows with what is known of their chunk; null keys and chunks meet, too."""
    other = chunks.withColumnsRenamed({key: "_k", "_chunk": "_c"})
    return df.join(other, F.col(key).eqNullSafe(F.col("_k")) & F.col("_chunk").eqNullSafe(F.col("_c")), "left").drop("_k", "_c")


def last_before(df: DataFrame, key: str, order: list[str], value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """``df`` (with ``_chunk``, a rising function of ``order``) and ``name``: the last ``value`` that is not null of the rows of
    the key before each row, or up to it (``inclusive``), by ``order``."""
    rows = df.withColumn("_v", value)
    within = W.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    chunks = rows.where("_v IS NOT NULL").groupBy(key, "_chunk").agg(F.max_by("_v", F.struct(*order)).alias("_l"))
    # chunks without a value take part, so that each finds what came before it
    every = rows.select(key, "_chunk").distinct()
    chunks = _joined(every, chunks, key)
    before = F.last("_l", ignorenulls=True).over(W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    chunks = chunks.withColumn("_before", before).drop("_l")
    out = _joined(rows.withColumn("_in", F.last("_v", ignorenulls=True).over(within)), chunks, key)
    return out.withColumn(name, F.coalesce("_in", "_before")).drop("_v", "_in", "_before")


def clamped_sum(df: DataFrame, key: str, order: list[str], step: Column) -> DataFrame:
    """``df`` (with ``_chunk``) and ``score`` and ``uses``: the running sum of ``step`` over the key that is never let below
    zero, and the running number of rows. The clamped sum is the plain one less the lowest point below zero so far; both
    are combined from those within a chunk and those at its start."""
    within = W.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_step", step).withColumn("_s", F.sum("_step").over(within)).withColumn("_n", F.count("*").over(within)).withColumn("_m", F.min("_s").over(within))
    chunks = rows.groupBy(key, "_chunk").agg(F.sum("_step").alias("_S"), F.min("_s").alias("_M"), F.count("*").alias("_N"))
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("_T", F.coalesce(F.sum("_S").over(earlier), F.lit(0.0))).withColumn("_low", F.coalesce(F.min(F.col("_T") + F.col("_M")).over(earlier), F.lit(0.0))).withColumn("_U", F.coalesce(F.sum("_N").over(earlier), F.lit(0)))
    out = _joined(rows, chunks.select(key, "_chunk", "_T", "_low", "_U"), key)
    score = F.col("_T") + F.col("_s") - F.least(F.lit(0.0), F.col("_low"), F.col("_T") + F.col("_m"))
    return out.withColumn("score", score).withColumn("uses", F.col("_U") + F.col("_n")).drop("_step", "_s", "_n", "_m", "_T", "_low", "_U")
