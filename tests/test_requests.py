"""Binding and validation of requests, look-ups, keys, sinks and reports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators.fingerprints import near_pairs
from pagemill.plans import checkpoints, jobs
from pagemill.plans import requests as Q
from pagemill.sources import sinks as D

T0 = dt.datetime(2025, 1, 1)


def bound(spark, kind, *bodies):
    df = spark.createDataFrame([(k, b if isinstance(b, (str, type(None))) else json.dumps(b)) for k, b in enumerate(bodies)], "k int, body string")
    return Q.bind(df, kind).orderBy("k").collect()


def test_scrape_requests(spark):
    ok, raw, *bad = bound(
        spark,
        "scrape",
        {"url": "https://a.example/x"},
        {"url": "http://a", "only_main_content": False, "timeout": 120, "output_format": "markdown_citations", "actions": [{"type": "scroll", "direction": "up"}], "cookies": [{"name": "a", "value": "b"}]},
        {"url": "not a url"},
        {"url": "https://a", "timeout": 121},
        {"url": "https://a", "output_format": "pdf", "max_age": -1},
        {"url": "https://a", "actions": [{"type": "wait"}] * 51},
        {"url": "https://a", "actions": [{"type": "dance"}]},
        {"url": "https://a", "cookies": [{"name": "a"}]},
        {},
        "{broken",
        "[]",
        None,
    )
    r = ok.request
    assert ok.error is None and (r.timeout, r.output_format, r.extract_mode, r.wait_for_network_idle, r.max_age) == (30, "markdown", "readability", True, 0)
    assert raw.error is None and raw.request.extract_mode == "raw" and raw.request.timeout == 120
    assert [x.error.code for x in bad] == ["INVALID_INPUT"] * len(bad)
    assert [x.error.message for x in bad] == ["invalid url", "invalid timeout", "invalid max_age, output_format", "invalid actions", "invalid actions", "invalid cookies", "invalid url", "not a JSON object", "not a JSON object", "not a JSON object"]


def test_other_requests(spark):
    batch = bound(spark, "batch", {"urls": ["https://a", "https://b"]}, {"urls": []}, {"urls": ["x"] * 101}, {"urls": ["https://a"], "options": {"extract_mode": "auto"}})
    assert [x.error and x.error.message for x in batch] == [None, "invalid urls", "invalid urls", "invalid extract_mode"] and batch[0].request.options.timeout == 30
    crawl = bound(spark, "crawl", {"url": "https://a"}, {"url": "https://a", "max_depth": 11, "max_pages": 501, "scope": "world", "webhook_url": "x y"}, {"url": "https://a", "max_depth": 10, "scope": "page"})
    assert [x.error and x.error.message for x in crawl] == [None, "invalid max_depth, max_pages, scope, webhook_url", None]
    assert (crawl[0].request.max_depth, crawl[0].request.max_pages, crawl[0].request.scope, crawl[0].request.options.output_format) == (3, 100, "subdomain", "markdown")
    extract = bound(spark, "extract", {"url": "https://a", "schema": "{}", "llm_api_key": "k"}, {"url": "https://a"})
    assert extract[0].error is None and extract[0].request.llm_model == "gpt-4o-mini" and extract[1].error.message == "invalid llm_api_key, schema"
    urls = Q.batch_urls(Q.bind(spark.createDataFrame([("j", '{"urls": ["https://b", "https://a"]}')], "job_id string, body string"), "batch")).collect()
    assert [(r.job_id, r.idx, r.url) for r in urls] == [("j", 0, "https://b"), ("j", 1, "https://a")]


def test_keys(spark):
    df = spark.createDataFrame([("a", None), (None, "Bearer b"), ("", "Bearer x"), (None, "Basic b"), (None, None)], "x_api_key string, authorization string")
    assert [r.allowed for r in Q.authorised(df, ["a", "b"]).collect()] == [True, True, False, False, False]
    assert [r.error and r.error.message[:7] for r in Q.authorised(df, ["a"]).collect()] == [None, "invalid", "invalid", "missing", "missing"]
    assert all(r.allowed for r in Q.authorised(df, []).collect()) and not any(r.allowed for r in Q.authorised(df, [""]).collect())
    assert len(spark.range(1).select(Q.job_id("batch_").alias("j")).first().j) == 22


def test_lookups(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    asked = spark.createDataFrame([("u", "markdown", "raw", m, s(t)) for m, t in ((5000, 5), (4999, 5), (0, 5), (None, 5), (5000, -1))] + [("v", "markdown", "raw", 5000, s(1))], "url string, output_format string, extract_mode string, max_age bigint, asked_at timestamp_ntz")
    key = spark.range(1).select(Q.cache_key(F.lit("u"), F.lit("markdown"), F.lit("raw")).alias("k")).first().k
    entries = spark.createDataFrame([(key, s(-50), "old"), (key, s(0), "new")], "key string, created_at timestamp_ntz, content string")
    got = sorted((r.url, r.max_age if r.max_age is not None else -1, r.asked_at, r.cache_status, r.content) for r in Q.looked_up(asked, entries).collect())
    assert [x[3:] for x in got] == [("off", None), ("off", None), ("miss", None), ("miss", None), ("hit", "new"), ("miss", None)]
    many = spark.createDataFrame([(str(k), s(-k * 60)) for k in range(120)], "key string, created_at timestamp_ntz")
    now = F.lit(T0).cast("timestamp_ntz")
    assert Q.kept_entries(many, now, 1000).count() == 61 and Q.kept_entries(many, now, 10).count() == 10 and Q.live_jobs(many, now).count() == 61


def test_webhooks(spark, tmp_path):
    calls = []

    def transport(url, body, headers):
        calls.append((url, headers))
        return 200 if "good" in url else 500 if len(calls) < 3 else 204

    waits = []
    assert D.deliver("http://good", "k", "{}", transport, waits.append) == (1, 200) and calls[0][1][D.SIGNATURE_HEADER].startswith("sha256=") and waits == []
    calls.clear()
    assert D.deliver("http://slow", None, "{}", transport, waits.append) == (3, 204) and waits == [1, 5] and D.SIGNATURE_HEADER not in calls[0][1]
    assert D.deliver("http://never", None, "{}", lambda *_: 0, waits.append) == (4, 0)
    events = spark.createDataFrame([("1", "http://good/1", "s", "{}"), ("2", "http://bad", None, None)], "event_id string, url string, secret string, body string")
    write = D.webhook_writer(str(tmp_path / "log"), lambda url, body, headers: 200 if "good" in url else 404, lambda _: None)
    write(events, 0)
    write(events, 0)  # tried again: what was delivered is not sent a second time
    log = [(r.event_id, r.attempts, r.delivered) for r in spark.read.parquet(str(tmp_path / "log")).collect()]
    assert sorted(log) == [("1", 1, True), ("2", 4, False), ("2", 4, False)]
    signed = spark.createDataFrame([("{}",)], "b string").select(D.F.lit("x"), "b")
    assert signed.count() == 1


def test_texts(spark):
    e = spark.createDataFrame([(1, 1, "b", "{}"), (1, 0, "a", "{}")], "k int, seq int, event string, data string")
    assert D.event_stream(e, "k", "seq").first().text == "event: a\ndata: {}\n\nevent: b\ndata: {}\n\n"
    r = spark.createDataFrame([("j", 1, True, "T", "u", "text", None), ("j", 0, False, None, None, None, "no")], "job_id string, idx int, success boolean, title string, source_url string, content string, message string")
    assert "".join(x.part for x in D.job_report(r).orderBy("idx").collect()) == "Batch j: partial (1/2 completed)\n\n--- [1] FAILED: no ---\n\n--- [2] T ---\ntext\n\n"
    assert "".join(x.part for x in D.job_report(r, "crawl").orderBy("idx").collect()) == "Crawl j: partial (1/2 pages)\n\n--- Page 1: FAILED: no ---\n\n--- Page 2: T (u) ---\ntext\n\n"
    b = spark.createDataFrame([("http://x.example/" + "y" * 40, 2, 12.9, 12.25, 1234567, 200), ("u", 0, None, None, None, None)], "url string, ok int, total_ms double, savings_percent double, content_length bigint, status_code int")
    assert [x.line for x in D.benchmark_lines(b).collect()] == ["http://x.example/" + "y" * 20 + "...\t12ms\t12.2%\t1,234,567\t200", "u\tFAILED\t-\t-\t-"]
    x = spark.createDataFrame([(1, "{}", ("s", "t"), None), (2, None, None, ("C", "m")), (3, None, None, None)], "scrape_id int, data string, metadata struct<source_url: string, title: string>, error struct<code: string, message: string>")
    assert [t.report for t in D.extract_report(x).collect()] == ["Source: s\nTitle: t\n\nExtracted Data:\n{}", "[C] m", "extraction failed"]
    assert [x.part for x in D.url_report(spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a")], "key string, url string")).orderBy("idx", "part").collect()] == ["Found 2 URLs:\n\n", "a\n", "b\n"]
    h = jobs.health(spark.createDataFrame([(True,)] * 5 + [(None,)], "in_use boolean")).first()
    assert (h.active_pages, h.max_pages, h.status) == (5, 6, "degraded")


def test_fingerprint_pairs_equal_brute_force(spark):
    import random

    r = random.Random(9)
    base = [r.getrandbits(64) - 2**63 for _ in range(30)]
    prints = base + base[:5] + [b ^ sum(1 << k for k in r.sample(range(63), n)) for b in base for n in (1, 5, 6, 7)] + [0, 0]
    rows = list(enumerate(prints))
    got = {(x.a, x.b, x.distance) for x in near_pairs(spark.createDataFrame(rows, "id bigint, fingerprint bigint"), 6).collect()}
    want = {(a, b, d) for a, x in rows for b, y in rows if a < b and x and y and (d := bin((x ^ y) & (2**64 - 1)).count("1")) <= 6}
    assert got == want
    with pytest.raises(ValueError):
        near_pairs(spark.createDataFrame(rows, "id bigint, fingerprint bigint"), 7)


def test_crowded_fingerprints(spark):
    """Most fingerprints share octets, as those of texts do: they are compared without a join, of which each
    pair with common octets would be a row."""
    import numpy as np

    r = np.random.default_rng(5)
    bits = r.random((9_000, 64)) < np.where(np.arange(64) < 32, 0.002, 0.5)
    prints = np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]
    prints[:300] = prints[300]
    rows = spark.createDataFrame(list(enumerate(prints.tolist())), "id bigint, fingerprint bigint")
    pairs = near_pairs(rows, 6)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = np.array([tuple(x) for x in pairs.collect()])
    u = prints.view(np.uint64)
    near = [(a, a + 1 + b, d[b]) for a in range(len(u)) if u[a] for d in [np.bitwise_count(u[a + 1 :] ^ u[a]).astype(int)] for b in np.flatnonzero((d <= 6) & (u[a + 1 :] != 0)).tolist()]
    assert len(near) > 44_850 and np.array_equal(got[np.lexsort(got.T[::-1])], np.array(near))


def test_shared_folder(spark):
    assert checkpoints.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_responses(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, None, ("T", None)), (2, False, "x", None)], "scrape_id int, success boolean, content string, metadata struct<title: string, author: string>")
    assert [r.json for r in D.responses(rows, "scrape_id").collect()] == ['{"success":true,"metadata":{"title":"T"}}', '{"success":false,"content":"x"}']
    D.write_responses(rows, str(tmp_path / "r"))
    assert {r.scrape_id for r in spark.read.json(str(tmp_path / "r")).collect()} == {1, 2}
