"""Roll-ups of jobs, races, caches and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import host_suffixes, pool_degraded
from .ordered import clamped_sum, last_before, with_chunk


def latest(df: DataFrame, *keys: str, by: str = "ingested_at") -> DataFrame:
    """One row per key: the one delivered last (ties by all columns' hash)."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(F.col(by), F.xxhash64(*rest)))
    return df.groupBy(*keys).agg(picked.alias("r")).select(*keys, "r.*")


def batch_status(rows: DataFrame) -> DataFrame:
    """(job_id, total, completed, failed, status) of job rows (job_id, idx, success): each index once, its last
    delivery; an outcome that is not known is a failure."""
    one = latest(rows, "job_id", "idx")
    n = one.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("success", F.lit(False))).alias("ok"))
    failed = F.col("total") - F.col("ok")
    status = F.when(failed == F.col("total"), "failed").when(failed > 0, "partial").otherwise("completed")
    return n.select("job_id", "total", F.col("ok").alias("completed"), failed.alias("failed"), status.alias("status"))


def race_winners(attempts: DataFrame) -> DataFrame:
    """(url, started_at, engine, finish_ms) of the engine that answered first in each race: the success with the
    least delay plus latency, ties by name; unknown or negative times never win."""
    finish = F.col("start_delay_ms") + F.col("latency_ms")
    ok = attempts.where("success AND start_delay_ms >= 0 AND latency_ms >= 0").distinct()
    best = F.min(F.struct(finish.cast("bigint").alias("finish_ms"), F.col("engine")))
    return ok.groupBy("url", "started_at").agg(best.alias("b")).select("url", "started_at", "b.engine", "b.finish_ms")


def domain_memory(winners: DataFrame, host: Column, ttl: str = "24 hours") -> DataFrame:
    """For each race the engine remembered for its host: the winner of the last earlier race that is not older than
    ``ttl``; null if there is none. Input as of :func:`race_winners`. A host's races are taken in chunks of a day."""
    x = with_chunk(winners.withColumn("host", host), "started_at")
    x = last_before(x, "host", ["started_at", "url"], F.struct("engine", "started_at"), "last")
    fresh = F.col("last.started_at") + F.expr(f"INTERVAL {ttl}") >= F.col("started_at")
    return x.select("host", "url", "started_at", "engine", F.when(fresh, F.col("last.engine")).alias("remembered"))


def cache_lookups(rows: DataFrame) -> DataFrame:
    """Distinct look-ups with their status, from (key, created_at, asked_at, max_age in ms): ``hit`` if an entry exists and
    is not older than a positive max_age, ``miss`` with a positive max_age otherwise, ``off`` without one."""
    age = (F.unix_micros(F.col("asked_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000
    status = F.when(F.coalesce("max_age", F.lit(0)) <= 0, "off").when(F.col("created_at").isNotNull() & (age <= F.col("max_age")), "hit").otherwise("miss")
    return rows.select("key", "created_at", "asked_at", "max_age").distinct().withColumn("status", status)


def run_averages(runs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Means of the metrics over successful runs per key (null without any), with the number of runs."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return runs.groupBy(key).agg(F.count("*").alias("runs"), F.count_if(ok).alias("ok"), *[F.avg(F.when(ok, F.col(m))).alias(f"avg_{m}") for m in metrics])


def dominant_status(runs: DataFrame, key: str, status: str = "status_code") -> DataFrame:
    """The most frequent status per key, the lowest of equals."""
    n = runs.where(F.col(status).isNotNull()).groupBy(key, status).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(status)).alias("low")))
    return n.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.low")).alias(status), F.col("b.n").alias("n"))


def health_scores(events: DataFrame, key: str, order: list[str], failed: Column, created: Column | None = None) -> DataFrame:
    """Running health of a handle: a failure adds 1, a success takes 0.5 but never below 0. A handle retires at a score of
    3, after 50 uses, or 50 minutes after ``created``. ``order`` begins with a time; a handle's events are taken in chunks
    of a day."""
    x = clamped_sum(with_chunk(events, order[0]), key, order, F.when(failed, 1.0).otherwise(-0.5)).drop("_chunk")
    retire = (F.col("score") >= 3) | (F.col("uses") >= 50)
    if created is not None:
        retire = retire | (F.col(order[0]).cast("timestamp") >= created.cast("timestamp") + F.expr("INTERVAL 50 MINUTES"))
    return x.withColumn("retire", retire)


# Hosts of advertising and tracking services (fixed values).
AD_HOSTS = [
    "doubleclick.net", "googlesyndication.com", "googleadservices.com", "google-analytics.com", "googletagmanager.com", "googletagservices.com",
    "facebook.net", "connect.facebook.net", "facebook.com", "fbcdn.net", "adnxs.com", "adsrvr.org", "amazon-adsystem.com", "criteo.com", "criteo.net",
    "outbrain.com", "taboola.com", "moatads.com", "pubmatic.com", "rubiconproject.com", "scorecardresearch.com", "quantserve.com", "hotjar.com",
    "mixpanel.com", "segment.io", "segment.com", "analytics.twitter.com", "ads-twitter.com", "static.ads-twitter.com", "chartbeat.com", "chartbeat.net",
    "optimizely.com", "zedo.com", "media.net", "contextweb.com", "bidswitch.net", "openx.net", "casalemedia.com", "demdex.net", "krxd.net",
    "bluekai.com", "exelator.com", "turn.com", "mathtag.com", "serving-sys.com", "eyeota.net", "agkn.com", "rlcdn.com", "sharethis.com", "addthis.com",
    "consensu.org",
]


def is_ad_host(host: Column) -> Column:
    """Whether a host or any parent domain is a known advertising host."""
    return F.arrays_overlap(host_suffixes(host), F.array(*map(F.lit, AD_HOSTS)))


def progress_events(requests: DataFrame) -> DataFrame:
    """(scrape_id, seq, event) of each request (scrape_id, success, cached): started, navigated (not from cache or on
    failure), completed or error."""
    events = F.when(F.col("cached"), F.array(F.lit("scrape.started"), F.lit("scrape.completed"))).when(
        F.col("success"), F.array(F.lit("scrape.started"), F.lit("scrape.navigated"), F.lit("scrape.completed"))
    ).otherwise(F.array(F.lit("scrape.started"), F.lit("scrape.error")))
    return requests.select("scrape_id", F.posexplode(events).alias("seq", "event"))


RETRY_DELAYS = [0, 1, 5, 30]


def delivery_attempts(events: DataFrame, succeeds_on: Column) -> DataFrame:
    """(…, attempt, at_second, delivered) of webhook deliveries: at most four attempts at growing delays, ending with
    the first success (``succeeds_on``: its number, null for never)."""
    total, plan = 0, []
    for k, d in enumerate(RETRY_DELAYS, 1):
        total += d
        plan.append(F.struct(F.lit(k).alias("attempt"), F.lit(total).alias("at_second")))
    tries = events.withColumn("s", succeeds_on).withColumn("t", F.explode(F.array(*plan)))
    kept = tries.where(F.col("s").isNull() | (F.col("t.attempt") <= F.col("s")))
    return kept.withColumn("delivered", F.coalesce(F.col("t.attempt") == F.col("s"), F.lit(False))).select(*events.columns, "t.attempt", "t.at_second", "delivered")


def scrape_report(rows: DataFrame) -> DataFrame:
    """(scrape_id, report) as text: title, source, content and token line, or the error. What it says is fixed."""
    body = F.concat(
        F.when(F.col("metadata").isNotNull(), F.concat(F.lit("Title: "), F.coalesce("metadata.title", F.lit("")), F.lit("\nSource: "), F.coalesce("metadata.source_url", F.lit("")), F.lit("\n\n"))).otherwise(F.lit("")),
        F.coalesce("content", F.lit("")),
        F.when(
            F.col("tokens").isNotNull(),
            F.format_string("\n\n---\nTokens: %d (saved %d%% from original %d)", F.coalesce("tokens.cleaned_estimate", F.lit(0)), F.bround(F.coalesce("tokens.savings_percent", F.lit(0.0)), 0).cast("bigint"), F.coalesce("tokens.original_estimate", F.lit(0))),
        ).otherwise(F.lit("")),
    )
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("["), F.coalesce("error.code", F.lit("")), F.lit("] "), F.coalesce("error.message", F.lit("")))).otherwise(F.lit("scrape failed"))
    return rows.select("scrape_id", F.when(F.coalesce("success", F.lit(False)), body).otherwise(failed).alias("report"))


def health(pool: DataFrame) -> DataFrame:
    """One row: pages in use, pages there may be, and whether the pool is degraded, from pages (in_use, ...)."""
    n = pool.agg(F.count_if(F.coalesce("in_use", F.lit(False))).alias("active_pages"), F.count("*").alias("max_pages"))
    return n.withColumn("status", pool_degraded(F.col("active_pages"), F.col("max_pages")))
