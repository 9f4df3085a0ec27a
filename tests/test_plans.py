"""Cleaning, crawl, job, cache and stream plans on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagemill.operators.page import Filters
from pagemill.plans import clean as C
from pagemill.plans import crawl as G
from pagemill.plans import extract as X
from pagemill.plans import jobs as J
from pagemill.plans import ordered as O
from pagemill.streaming import state as S

T0 = dt.datetime(2025, 1, 1)
BODY = "The quick brown fox, which is quick, jumps over the lazy dog again and again. " * 3
PAGE = f"<html lang=en><head><title>T</title></head><body><nav><a href=/n>n</a></nav><article><h1>T</h1><p>{BODY}</p></article><footer>f</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://a.example/p", PAGE), (2, "http://a.example/e", ""), (3, None, None)], "page_id bigint, url string, html string")


@pytest.mark.parametrize("mode", C.MODES)
@pytest.mark.parametrize("fmt", C.FORMATS)
def test_clean(pages, mode, fmt):
    rows = {r.page_id: r for r in C.clean(pages, C.Options(mode, fmt)).collect()}
    assert all(r.success and r.error is None for r in rows.values()) and "jumps over" in rows[1].content
    assert rows[1].metadata.title == "T" and rows[1].tokens.original_estimate == len(PAGE) // 3 and rows[2].tokens.savings_percent == 0
    if mode != "raw":
        assert ">f<" not in rows[1].content or mode == "auto"
    if fmt == "html" and mode == "raw":
        assert rows[1].content == PAGE


def test_clean_options(pages):
    assert C.Options("pruning", only_main_content=False).extract_mode == "raw" and C.Options("odd").extract_mode == "readability"
    bad = C.clean(pages, C.Options(filters=Filters(css_selector="p[[["))).first()
    assert not bad.success and bad.error.code == "INVALID_INPUT" and bad.content is None
    kept = C.clean(pages, C.Options("raw", "html", filters=Filters(css_selector="h1"))).first()
    assert kept.content == "<h1>T</h1>" and kept.links.internal == []


def test_parse_is_pruned_and_pushed(pages, tmp_path):
    path = str(tmp_path / "p")
    pages.write.parquet(path)
    df = C.clean(pages.sparkSession.read.parquet(path), C.Options("raw", "html")).where("page_id = 1").select("page_id", "content")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,1)]" in plan and plan.count("ArrowEvalPython") == 1


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def crawled(df):
    return sorted((r.url, r.depth) for r in df.collect())


def test_crawl(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("a", "a"), ("b", None))
    seed = spark.createDataFrame([("a",)], "url string")
    every = lambda *x, **k: crawled(G.crawl(*x, scope="all", **k))
    assert every(seed, e, 2) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert every(seed, e, 5, max_pages=2) == [("a", 0), ("b", 1)]
    assert every(seed, e, 5, failed=spark.createDataFrame([("d",)], "url string")) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert every(seed, e, 0) == [("a", 0)] and every(seed.where("false"), e, 3) == []
    w = edges(spark, ("http://a.example/", "http://a.example/x"), ("http://a.example/", "http://A.example/z"), ("http://a.example/", "http://b.a.example/y"), ("http://a.example/", "http://c.test/"), ("http://a.example/", "ftp://a.example/f"))
    start = spark.createDataFrame([("http://a.example/",)], "url string")
    for scope in ("domain", "subdomain"):  # only links within a page's host are followed
        assert [u for u, _ in crawled(G.crawl(start, w, 1, scope=scope))] == ["http://A.example/z", "http://a.example/", "http://a.example/x"]
    assert crawled(G.crawl(start, w, 1)) == crawled(G.crawl(start, w, 1, scope="domain")) and len(crawled(G.crawl(start, w, 1, scope="page"))) == 1
    assert len(crawled(G.crawl(start, w, 1, exclude=["/x"]))) == 2 and len(every(start, w, 1)) == 6


def test_discovery(spark):
    u = lambda *x: spark.createDataFrame([(v,) for v in x], "url string")
    assert sorted(r.url for r in G.discover(u("a", "b"), u("b", " ", None)).collect()) == ["a", "b"]
    robots = spark.createDataFrame([("x", "SiteMap:  u1 \r\nsitemap:\nnot sitemap: z\n sitemap:u2"), ("y", None)], "site string, body string")
    assert sorted(r.url for r in G.robots_sitemaps(robots).collect()) == ["u1", "u2"]
    docs = spark.createDataFrame([("r", "<sitemapindex><sitemap><loc>s</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"), ("s", "<urlset><url><loc>p</loc></url></urlset>"), ("m", "<urlset><url>")], "url string, body string")
    assert [r.url for r in G.expand_sitemaps(u("r"), docs).collect()] == ["p"] and G.expand_sitemaps(u("m"), docs).count() == 0


def test_job_status(spark):
    rows = [("ok", 0, True, T0), ("ok", 1, True, T0), ("mixed", 0, True, T0), ("mixed", 1, None, T0), ("bad", 0, True, T0), ("bad", 0, False, T0 + dt.timedelta(1))]
    got = {r.job_id: (r.total, r.completed, r.failed, r.status) for r in J.batch_status(spark.createDataFrame(rows, "job_id string, idx int, success boolean, ingested_at timestamp")).collect()}
    assert got == {"ok": (2, 2, 0, "completed"), "mixed": (2, 1, 1, "partial"), "bad": (1, 0, 1, "failed")}
    r = spark.createDataFrame([(True,), (False,)], "success boolean")
    assert G.crawl_status(r).first().status == "partial" and G.crawl_status(r.where("false")).first().status == "completed" and G.crawl_status(r.where("not success")).first().status == "failed"


def test_race_and_memory(spark):
    rows = [("u", "http", 0, 50, False, T0), ("u", "rod", 2000, 100, True, T0), ("u", "stealth", 5000, -1, True, T0), ("v", "http", 0, 9, False, T0), ("u", "http", 0, 5, True, T0 + dt.timedelta(hours=2)), ("u", "http", 0, 5, True, T0 + dt.timedelta(hours=30))]
    a = spark.createDataFrame(rows, "url string, engine string, start_delay_ms int, latency_ms int, success boolean, started_at timestamp_ntz")
    w = J.race_winners(a)
    assert sorted((r.url, r.engine, r.finish_ms) for r in w.collect()) == [("u", "http", 5), ("u", "http", 5), ("u", "rod", 2100)]
    assert [r.remembered for r in J.domain_memory(w, F.col("url")).orderBy("started_at").collect()] == [None, "rod", None]


def test_cache(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [("k", s(0), s(10), 10_000), ("k", s(0), s(10), 9_999), ("k", s(0), s(1), 0), ("k", None, s(1), 5), ("k", s(0), s(1), None)]
    got = J.cache_lookups(spark.createDataFrame(rows, "key string, created_at timestamp_ntz, asked_at timestamp_ntz, max_age bigint"))
    assert sorted((r.asked_at, r.max_age if r.max_age is not None else -1, r.status) for r in got.collect()) == [(s(1), -1, "off"), (s(1), 0, "off"), (s(1), 5, "miss"), (s(10), 9999, "miss"), (s(10), 10000, "hit")]


def test_health(spark):
    rows = [(k, k, bad) for k, bad in enumerate([False, False, True, True, False, True, True, False])]
    want, score = [], 0.0
    for _, _, bad in rows:
        score = score + 1 if bad else max(0.0, score - 0.5)
        want.append(score)
    e = spark.createDataFrame([("h", *r) for r in rows], "h string, t bigint, k bigint, bad boolean")
    got = J.health_scores(e, "h", ["t"], F.col("bad")).orderBy("t").collect()
    assert [r.score for r in got] == want and [r.retire for r in got] == [w >= 3 for w in want]


def test_averages_and_modes(spark):
    r = spark.createDataFrame([("a", True, 2, 200), ("a", True, 4, 500), ("a", False, 100, 500), ("b", False, 1, None)], "k string, success boolean, ms int, status_code int")
    got = {x.k: (x.runs, x.ok, x.avg_ms) for x in J.run_averages(r, "k", ["ms"]).collect()}
    assert got == {"a": (3, 2, 3.0), "b": (1, 0, None)} and [(x.k, x.status_code, x.n) for x in J.dominant_status(r, "k").collect()] == [("a", 500, 2)]
    tie = spark.createDataFrame([("a", 500), ("a", 200)], "k string, status_code int")
    assert J.dominant_status(tie, "k").first().status_code == 200


def test_deliveries_and_events(spark):
    e = spark.createDataFrame([("x", 2), ("y", None)], "id string, s int")
    got = [(r.id, r.attempt, r.at_second, r.delivered) for r in J.delivery_attempts(e, F.col("s")).orderBy("id", "attempt").collect()]
    assert got == [("x", 1, 0, False), ("x", 2, 1, True), *[("y", k, t, False) for k, t in ((1, 0), (2, 1), (3, 6), (4, 36))]]
    q = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, False)], "scrape_id bigint, success boolean, cached boolean")
    assert [r.n for r in J.progress_events(q).groupBy("scrape_id").agg(F.count("*").alias("n")).orderBy("scrape_id").collect()] == [2, 3, 2]
    ads = spark.createDataFrame([("pagead2.googlesyndication.com",), ("notsegment.io",), ("SEGMENT.io",)], "h string")
    assert [r.a for r in ads.select(J.is_ad_host(F.col("h")).alias("a")).collect()] == [True, False, True]


def test_extract(spark):
    d = spark.createDataFrame([("# t\nopening",), ("bad",), (None,)], "content string")

    def extractor(content, schema):
        if content == "bad":
            return "{"
        if not content:
            raise ValueError("nothing")
        return X.first_sentences(content, schema)

    got = X.extract(d, "content", "{}", extractor).collect()
    assert '"title": "t"' in got[0].data and got[0].extract_error is None and got[1].extract_error.message == "invalid JSON" and got[2].extract_error.message == "nothing"
    body = d.select(X.chat_request(F.col("content"), '{"a": 1}', instructions="Do it.").alias("r")).first().r
    assert '"temperature":0' in body and 'Do it.\\n{\\"a\\": 1}' in body
    answers = [(200, '{"choices": [{"message": {"content": "{}"}}]}'), (200, '{"choices": [{}]}'), (None, None), (500, '{"error": {"message": "x"}}'), (200, "[]"), (200, "")]
    r = spark.createDataFrame(answers, "s int, b string").select(X.chat_response(F.col("s"), F.col("b")).alias("r")).select("r.*").collect()
    assert r[0].data == "{}" and r[0].usage.total_tokens == 0 and r[0].error is None
    assert [x.error.message for x in r[1:]] == ["LLM returned invalid JSON", "LLM API returned 0: LLM API error", "LLM API returned 500: x", "LLM returned no choices", "failed to parse LLM response"]


def test_token_bucket(spark):
    rows = [("a", T0, k) for k in range(11)] + [("a", T0 + dt.timedelta(milliseconds=200), 11), ("b", T0, 0), (None, T0, 0)]
    got = S.rate_limited(spark.createDataFrame(rows, "who string, ts timestamp_ntz, n bigint"), "who", "ts").collect()
    assert sorted((r.n, r.allowed) for r in got if r.who == "a") == [(k, k != 10) for k in range(12)] and all(r.allowed for r in got if r.who != "a")


def test_buckets_equal_one_pass(spark):
    """Runs between rests give what one pass over all rows of an identity gives."""
    import random

    r = random.Random(6)
    rows, t = [], T0
    for k in range(1500):
        t += dt.timedelta(milliseconds=r.choice([0, 20, 60, 150, 400, 1999, 2000, 2600, 900_000]) if r.random() < 0.3 else r.choice([0, 20, 60]))
        rows.append((r.choice(["a", "a", "b", None]), t if k % 97 else None, k))
    df = spark.createDataFrame(rows, "who string, ts timestamp_ntz, n bigint")
    want, state = {}, {}
    for who, ts, n in sorted(rows, key=lambda x: (x[1] is not None, x[1] or T0, x[2])):
        now = (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) if ts else 0
        tokens, last = state.get(who, (10.0, now))
        want[n], left = S.allow(tokens, (now - last) / 1e6)
        state[who] = (left, now)
    got = {x.n: x.allowed for x in S.rate_limited(df, "who", "ts").collect()}
    assert got == want and 100 < sum(want.values()) < 1500


def test_folds_in_chunks(spark):
    import random

    r = random.Random(2)
    rows = [(r.choice("xy"), T0 + dt.timedelta(hours=r.randrange(0, 400)), k, r.random() < 0.4) for k in range(600)]
    e = spark.createDataFrame(rows, "h string, t timestamp_ntz, k bigint, bad boolean")
    want, state = {}, {}
    for h, t, k, bad in sorted(rows, key=lambda x: (x[1], x[2])):
        score, n = state.get(h, (0.0, 0))
        state[h] = (score + 1 if bad else max(0.0, score - 0.5), n + 1)
        want[k] = state[h]
    got = {x.k: (x.score, x.uses) for x in J.health_scores(e, "h", ["t", "k"], F.col("bad")).collect()}
    assert got == want
    late = {x.k: x.seen for x in O.last_before(O.with_chunk(e, "t"), "h", ["t", "k"], F.when(F.col("bad"), F.col("k")), "seen").collect()}
    last = {}
    for h, t, k, bad in sorted(rows, key=lambda x: (x[1], x[2])):
        assert late[k] == last.get(h)
        if bad:
            last[h] = k
    assert J.health_scores(e.where("false"), "h", ["t", "k"], F.col("bad")).count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    """With a file a trigger, rows older than the watermark are lost and others change their hour."""
    s = lambda n: T0 + dt.timedelta(minutes=n)
    files = [[(s(0), "v", 1.0), (s(30), "v", 1.0)], [(s(40), "v", 2.0), (s(600), "w", 1.0)], [(s(601), "w", 1.0)], [(s(50), "v", 4.0), (s(602), "w", 1.0)]]
    import os

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        os.makedirs(tmp_path / "e", exist_ok=True)
        for f in os.listdir(tmp_path / f"p{k}"):
            if f.endswith(".parquet"):
                os.rename(tmp_path / f"p{k}" / f, tmp_path / "e" / f"{k}.parquet")
                os.utime(tmp_path / "e" / f"{k}.parquet", (1_700_000_000 + k * 60,) * 2)
    got = sorted((r.hour, r.event_type, r.n, r.total) for r in S.hourly_counts(spark, str(tmp_path / "e"), 1).collect())
    assert got == [(T0, "v", 3, 400), (T0 + dt.timedelta(hours=10), "w", 3, 300)]


def test_streams_equal_batches(spark, tmp_path):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    e = spark.createDataFrame([(s(k * 1000), "v" if k % 3 else "w", float(k)) for k in range(40)] + [(None, "v", 1.0)], "ts timestamp_ntz, event_type string, value double")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = S.hourly_counts(spark, str(tmp_path / "e"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.hourly(e).collect()))
    rows = [("k", s(0), s(10), 10_000), ("k", s(0), s(10), 9_999), ("j", s(0), s(1), 0), ("j", None, s(5), 5000)]
    c = spark.createDataFrame(rows, "key string, created_at timestamp_ntz, asked_at timestamp_ntz, max_age bigint")
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    assert sorted(r.status for r in S.cached_stream(spark, str(tmp_path / "c")).collect()) == ["hit", "hit", "miss", "off"]
