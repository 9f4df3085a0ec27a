"""Where results go: event streams as text, webhooks, and benchmark reports."""

from __future__ import annotations

import hashlib
import hmac
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.native import shorten, thousands
from ..plans.jobs import RETRY_DELAYS

#: (url, body, headers) -> HTTP status
Transport = Callable[[str, bytes, dict], int]
SIGNATURE_HEADER = "X-Signature"


def event_text(event: Column, data: Column) -> Column:
    """An event of an event stream: its name and its data (JSON text)."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def event_stream(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): the events (key, order, event, data) of each key as one stream, in order. A key's events are those of one
    request, four at most."""
    rows = events.select(key, F.col(order).alias("_o"), event_text(F.col("event"), F.col("data")).alias("_t"))
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_o", "_t"))).alias("l"))
    return lists.select(key, F.array_join("l._t", "").alias("text"))


def post(url: str, body: bytes, headers: dict) -> int:
    """An HTTP POST by the standard library; no answer counts as status 0."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=10) as answer:
            return answer.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return 0


def deliver(url: str, secret: str | None, body: str, transport: Transport, wait: Callable[[float], None]) -> tuple[int, int]:
    """(attempts, last status) of a delivery: up to four attempts at growing delays until a status below 400."""
    data = body.encode()
    headers = {"Content-Type": "application/json"}
    if secret:
        headers[SIGNATURE_HEADER] = "sha256=" + hmac.new(secret.encode(), data, hashlib.sha256).hexdigest()
    status = 0
    for k, delay in enumerate(RETRY_DELAYS, 1):
        if delay:
            wait(delay)
        status = transport(url, data, headers)
        if 0 < status < 400:
            return k, status
    return len(RETRY_DELAYS), status


OUTCOME = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("status", T.IntegerType()), T.StructField("delivered", T.BooleanType())])


def delivered(events: DataFrame, transport: Transport = post, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(event_id, attempts, status, delivered) of the events (event_id, url, secret, body), sent from the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, secrets, bodies = (batch.column(k).to_pylist() for k in range(4))
            got = [deliver(u or "", s, b or "", transport, wait) for u, s, b in zip(urls, secrets, bodies)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array([k for k, _ in got], pa.int32()), pa.array([s for _, s in got], pa.int32()), pa.array([0 < s < 400 for _, s in got], pa.bool_())], names=OUTCOME.names
            )

    return events.select(F.col("event_id").cast("string"), "url", "secret", "body").mapInArrow(run, OUTCOME)


def webhook_writer(log: str, transport: Transport = post, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch``: sends a batch's events and writes the outcomes below ``log``. A batch that is tried again
    overwrites its outcomes and skips the events that were delivered before it failed."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{log}/batch={number}"
        todo = batch
        try:
            done = spark.read.schema(OUTCOME).parquet(path).where("delivered").select("event_id")
            todo = batch.join(done, "event_id", "left_anti")
        except Exception:  # noqa: BLE001 - nothing was written yet
            pass
        delivered(todo, transport, wait).write.mode("append").parquet(path)

    return write


def page_events(results: DataFrame) -> DataFrame:
    """(job_id, seq, type, body) of a crawl's webhook events: one for each result (job_id, idx, success, data), in order, and
    the final one of its status."""
    total = results.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    failed = F.col("n") - F.col("ok")
    status = F.when(failed == F.col("n"), "failed").when(failed > 0, "partial").otherwise("completed")
    pages = results.select("job_id", F.col("idx").cast("bigint").alias("seq"), F.lit("crawl.page").alias("type"), F.col("data").alias("data"))
    last = total.select("job_id", F.col("n").cast("bigint").alias("seq"), F.concat(F.lit("crawl."), status).alias("type"), F.to_json(F.struct(F.col("ok").alias("completed"), F.col("n").alias("total"))).alias("data"))
    body = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","job_id":"'), F.col("job_id"), F.lit('","data":'), F.coalesce("data", F.lit("null")), F.lit("}"))
    return pages.unionByName(last).select("job_id", "seq", "type", body.alias("body"))


# --- benchmark reports ------------------------------------------------------------------------------------------


def benchmark_lines(averages: DataFrame) -> DataFrame:
    """(url, line): the row of a benchmark table of each URL, from (url, ok, total_ms, savings_percent, content_length,
    status_code); tabs stand between its columns."""
    good = F.format_string("%s\t%dms\t%.1f%%\t%s\t%d", shorten(F.col("url"), 40), F.col("total_ms").cast("bigint"), F.bround("savings_percent", 1), thousands(F.col("content_length").cast("bigint")), F.col("status_code"))
    return averages.select("url", F.when(F.coalesce("ok", F.lit(0)) > 0, good).otherwise(F.concat(shorten(F.col("url"), 40), F.lit("\tFAILED\t-\t-\t-"))).alias("line"))


def write_report(averages: DataFrame, path: str) -> None:
    """The averages as lines of JSON below ``path``."""
    averages.write.mode("overwrite").json(path)


# --- reports of jobs as text ------------------------------------------------------------------------------------

# What a report says (fixed texts).
_HEAD = {"batch": ("Batch ", " completed)\n\n"), "crawl": ("Crawl ", " pages)\n\n")}


def job_report(results: DataFrame, kind: str = "batch") -> DataFrame:
    """(job_id, idx, part): a job's report in parts, to be read in the order of idx: a head (idx -1) with status and counts, and
    a part for each result (job_id, idx, success, title, source_url, content, message). Parts stay rows: a job may be
    of any size."""
    w = W.partitionBy("job_id").orderBy("idx")
    n = F.row_number().over(w).cast("string")
    title = F.coalesce("title", F.lit(""))
    failed = F.coalesce("message", F.lit("unknown error"))
    if kind == "batch":
        part = F.when(F.col("success"), F.concat(F.lit("--- ["), n, F.lit("] "), title, F.lit(" ---\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))).otherwise(F.concat(F.lit("--- ["), n, F.lit("] FAILED: "), failed, F.lit(" ---\n\n")))
    else:
        part = F.when(F.col("success"), F.concat(F.lit("--- Page "), n, F.lit(": "), title, F.lit(" ("), F.coalesce("source_url", F.lit("")), F.lit(") ---\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))).otherwise(F.concat(F.lit("--- Page "), n, F.lit(": FAILED: "), failed, F.lit(" ---\n\n")))
    parts = results.withColumn("success", F.coalesce("success", F.lit(False))).select("job_id", F.col("idx").cast("bigint").alias("idx"), part.alias("part"))
    total = results.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("success", F.lit(False))).alias("ok"))
    lost = F.col("n") - F.col("ok")
    status = F.when(lost == F.col("n"), "failed").when(lost > 0, "partial").otherwise("completed")
    first, last = _HEAD[kind]
    head = total.select("job_id", F.lit(-1).cast("bigint").alias("idx"), F.concat(F.lit(first), "job_id", F.lit(": "), status, F.lit(" ("), F.col("ok").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(last)).alias("part"))
    return head.unionByName(parts)


def url_report(urls: DataFrame) -> DataFrame:
    """(key, idx, part) of lists of URLs (key, url): a head with their number (idx 0), then each URL as a row (idx 1), to be
    read in the order of idx and part."""
    one = urls.select("key", "url").distinct()
    head = one.groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit(0).cast("bigint").alias("idx"), F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" URLs:\n\n")).alias("part"))
    rows = one.select("key", F.lit(1).cast("bigint").alias("idx"), F.concat("url", F.lit("\n")).alias("part"))
    return head.unionByName(rows)


def extract_report(rows: DataFrame) -> DataFrame:
    """(scrape_id, report) of structured data (scrape_id, data, metadata, error)."""
    head = F.when(F.col("metadata").isNotNull(), F.concat(F.lit("Source: "), F.coalesce("metadata.source_url", F.lit("")), F.lit("\nTitle: "), F.coalesce("metadata.title", F.lit("")), F.lit("\n\n"))).otherwise(F.lit(""))
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("["), F.coalesce("error.code", F.lit("")), F.lit("] "), F.coalesce("error.message", F.lit("")))).otherwise(F.lit("extraction failed"))
    return rows.select("scrape_id", F.when(F.col("data").isNotNull(), F.concat(head, F.lit("Extracted Data:\n"), "data")).otherwise(failed).alias("report"))


# --- responses --------------------------------------------------------------------------------------------------


def responses(rows: DataFrame, *names: str) -> DataFrame:
    """(…names, json): each row as the JSON text of its response, without the columns ``names`` and without null fields."""
    return rows.select(*names, F.to_json(F.struct(*[c for c in rows.columns if c not in names])).alias("json"))


def write_responses(rows: DataFrame, path: str) -> None:
    """Responses as lines of JSON below ``path``."""
    rows.write.mode("overwrite").json(path)
