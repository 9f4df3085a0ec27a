"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found below this bound; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if shared:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(shared)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "pagemill-checkpoint"))
    return shared or ""


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there (survives the loss of any executor)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, its counted rows, are below ``bound``."""
    return F.broadcast(df) if rows <= bound else df


def host(url: Column) -> Column:
    """Host of a URL in lower case without user, port and leading ``www.``; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def site(source_url: Column, final_url: Column) -> Column:
    """Site of a record: the host of ``source_url``, of ``final_url`` where that is null or blank."""
    return host(F.coalesce(F.when(F.trim(source_url) != "", source_url), final_url))


def scrapes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/scrapes.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")
