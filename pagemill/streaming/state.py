"""Streams: windowed counts with a watermark, and keyed state (rate limits, caches) as streams and as batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.checkpoints import shared_folder
from ..plans.ordered import last_before, with_chunk

RATE, BURST = 5.0, 10


def allow(tokens: float, elapsed: float, rate: float = RATE, burst: int = BURST) -> tuple[bool, float]:
    """Whether a request passes a bucket that held ``tokens`` and was filled for ``elapsed`` seconds, and what is left."""
    tokens = min(float(burst), tokens + max(0.0, elapsed) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def rate_limited(requests: DataFrame, identity: str, ts: str, rate: float = RATE, burst: int = BURST) -> DataFrame:
    """``requests`` with ``allowed``: a token bucket per identity, in order of time (ties by all columns).

    A bucket is full again after ``burst / rate`` seconds without a request, whatever was before. The requests between two
    such rests are a run of their own: runs are found in chunks of time, and each is streamed in order, with one number of
    state, wherever it falls. Only an identity that never rests is one run."""
    others = [c for c in requests.columns if c not in (identity, ts)]
    order = [ts, *others]
    rest = int(burst / rate * 1e6)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    x = last_before(with_chunk(requests, ts, "HOUR"), identity, order, F.col(ts), "_previous")
    fresh = F.col("_previous").isNull() | (micros(ts) - micros("_previous") >= rest)
    x = last_before(x.withColumn("_fresh", fresh), identity, order, F.when(F.col("_fresh"), F.coalesce(micros(ts), F.lit(-(1 << 62)))), "_run", inclusive=True)
    rows = x.select(*requests.columns, "_run")
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType(), False)])
    ki, ti, ri = requests.columns.index(identity), requests.columns.index(ts), len(requests.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, last = object(), float(burst), None
        for batch in batches:
            out = []
            times = batch.column(ti).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
            for k, r, t in zip(batch.column(ki).to_pylist(), batch.column(ri).to_pylist(), times):
                if (k, r) != key:
                    key, tokens, last = (k, r), float(burst), t
                ok, tokens = allow(tokens, ((t or 0) - (last or 0)) / 1e6, rate, burst)
                last = t
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[:ri], pa.array(out, pa.bool_())], names=schema.names)

    return rows.repartition(F.col(identity), F.col("_run")).sortWithinPartitions(identity, "_run", ts, *others).mapInArrow(run, schema)


def _work(spark: SparkSession) -> str:
    """A fresh folder for a stream's files, in the cluster's shared folder where one is set."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """One Parquet file or folder as a stream of files, at most so many a trigger, in the order of their times."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream over all data there is, written as Parquet with exactly-once checkpoints."""
    spark = stream.sparkSession
    work = _work(spark)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def hourly(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Counts and sums (in hundredths) of events by hour and type; a stream emits an hour once the watermark passed."""
    x = events.where("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("value"))
    if x.isStreaming:
        x = x.withWatermark("ts", watermark)
    g = x.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def hourly_counts(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The table as a stream: each batch writes the hours it changed, the last state of an hour stands. Once the watermark
    has passed an hour its state is dropped, and rows that come for it later are lost."""
    stream = hourly(_source(spark, path, files_per_trigger))
    work = _work(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/out/number={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    fields = [*stream.schema.fields, T.StructField("batch", T.IntegerType())]
    try:
        rows = spark.read.schema(T.StructType(fields)).parquet(f"{work}/out")
    except AnalysisException:  # no batch, no folder
        return spark.createDataFrame([], stream.schema)
    return rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("hour", "event_type", "r.n", "r.total")


LOOKUP = T.StructType([T.StructField("key", T.StringType()), T.StructField("asked_at", T.TimestampType()), T.StructField("status", T.StringType())])


def cache_stream(lookups: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Look-ups (key, created_at, asked_at, max_age) against a keyed cache: a look-up hits if its entry, the latest
    created no later than it, is not older than max_age; entries leave the state after ``ttl_ms`` of
    processing time without use (None: never, for streams that are drained and end). A key's look-ups of one trigger are
    taken in the order of time, across the frames they come in; how many there may be is set by the source's rate."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entry = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["asked_at", "created_at", "max_age"])
        for first in range(0, len(rows), 10_000):
            out = []
            for r in rows.iloc[first : first + 10_000].itertuples(index=False):
                created = None if pd.isna(r.created_at) else int(r.created_at.value // 1000)
                asked = int(r.asked_at.value // 1000)
                if created is not None and (entry is None or created > entry) and created <= asked:
                    entry = created
                most = 0 if pd.isna(r.max_age) else int(r.max_age)
                used = created if created is not None else entry
                hit = most > 0 and used is not None and (asked - used) / 1000 <= most
                out.append((r.key, r.asked_at, "off" if most <= 0 else "hit" if hit else "miss"))
            yield pd.DataFrame(out, columns=LOOKUP.names)
        if entry is not None:
            state.update((entry,))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)

    rows = lookups.where("key IS NOT NULL AND asked_at IS NOT NULL").select("key", F.col("created_at").cast("timestamp"), F.col("asked_at").cast("timestamp"), "max_age")
    return rows.groupBy("key").applyInPandasWithState(step, LOOKUP, "created bigint", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def cached_stream(spark: SparkSession, path: str) -> DataFrame:
    return _drained(cache_stream(_source(spark, path), None))
