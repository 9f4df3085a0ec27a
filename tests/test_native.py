"""Native column functions: fingerprints, keys, scores and small formats."""

import hashlib
import hmac

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import native as N
from pagemill.operators.fingerprints import WordHasher, fnv1a64, near_pairs, simhash, tag_words


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def fp(text: str) -> int:
    return simhash(text.split(), WordHasher())


def distance(a: int, b: int) -> int:
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


FOX = "the quick brown fox jumps over the lazy dog"


def test_text_fingerprints():
    assert fp(FOX) == signed(0xCAB7991C5475EDEE) and fp("hello") == signed(0xA430D84680AABD0B) and fp("") == 0 and fp(" \t ") == 0
    assert distance(fp(FOX), fp(FOX.replace("jumps", "leaps"))) <= 10 and distance(fp(FOX), fp("quantum computing uses qubits for parallel processing")) >= 5


def test_dom_fingerprints():
    a = "<html><head><title>A</title></head><body><div><h1>x</h1><p>y</p></div></body></html>"
    b = "<html><head><title>B</title></head><body><div><h1>other</h1><p>words</p></div></body></html>"
    table = "<html><body><table><tr><td>1</td></tr><tr><td>2</td></tr></table></body></html>"
    d = lambda h: simhash(tag_words(h), WordHasher())
    assert d(a) == d(b) and distance(d(a), d(table)) >= 3 and d("") == 0 and d("plain") == 0
    assert d("<br/>") == signed(0x08A64607B54DF055)


def test_native_equals_python(spark):
    words = ["hello", "", "é", "日本語", "a" * 50]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(N.fnv1a64(F.col("w")).alias("h")).collect()
    assert [r.h for r in rows] == [signed(fnv1a64(w.encode())) for w in words]
    got = one(spark, N.simhash_bits(F.transform(N.words(F.lit(FOX)), N.fnv1a64)), N.simhash_bits(F.array().cast("array<bigint>")))
    assert got.c0 == fp(FOX) and got.c1 == 0


@pytest.mark.parametrize(("a", "b", "want"), [(255, 255, 0), (0, -1, 64), (0, 1, 1), (0, 3, 2), (0, 0, 0)])
def test_hamming(spark, a, b, want):
    got = one(spark, N.hamming(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")), N.similar(F.lit(a), F.lit(b), want), N.similar(F.lit(a), F.lit(b), want - 1))
    assert got.c0 == want and got.c1 and not got.c2


@given(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1))
def test_distance_is_a_metric(a, b, c):
    assert distance(a, b) == distance(b, a) and distance(a, a) == 0 and distance(a, c) <= distance(a, b) + distance(b, c)


def test_shingles(spark):
    got = one(spark, N.shingles(F.array(*map(F.lit, "abcd"))), N.shingles(F.array(*map(F.lit, "ab"))))
    assert got.c0 == ["a_b_c", "b_c_d"] and got.c1 == []


def test_near_pairs_equal_brute_force(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = [signed(b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4)))) for b in base for _ in range(8)] + [0, 0, signed(base[0]), signed(base[0])]
    rows = list(enumerate(prints))
    got = {(x.a, x.b, x.distance) for x in near_pairs(spark.createDataFrame(rows, "id bigint, fingerprint bigint"), 4).collect()}
    assert got == {(i, j, distance(p, q)) for i, p in rows for j, q in rows if i < j and p and q and distance(p, q) <= 4}
    assert near_pairs(spark.createDataFrame([], "id bigint, fingerprint bigint"), 3).count() == 0


def test_tokens_and_savings(spark):
    cases = {"": 0, "a": 1, "ab": 1, "abc": 1, "abcdef": 2, "日本語日本語日本語": 3, "😀😀😀😀😀😀": 2}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.estimate_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases
    got = one(spark, N.savings_percent(F.lit(3), F.lit(2)), N.savings_percent(F.lit(0), F.lit(5)), N.savings_percent(F.lit(2), F.lit(3)), N.estimate_tokens(F.lit(None).cast("string")))
    assert (got.c0, got.c1, got.c2, got.c3) == (33.33, 0.0, -50.0, 0)


def test_urls(spark):
    u = lambda s: F.lit(s)
    got = one(
        spark,
        N.base_domain(u("a.b.example.com:8080")), N.base_domain(u("localhost")), N.in_scope(u("http://A.example/x"), u("http://a.example/"), "domain"), N.in_scope(u("http://a.example:1/"), u("http://a.example/"), "domain"),
        N.in_scope(u("https://x.a.example/"), u("http://y.a.example/"), "subdomain"), N.in_scope(u("ftp://a.example/"), u("http://a.example/"), "subdomain"), N.in_scope(u("http://a.example/"), u("http://a.example/"), "page"), N.url_host(u("not a url")),
        N.redact_proxy(u("socks5://u:p@h:1")), N.shorten(u("abcdefghij"), 8),
    )
    assert list(got) == ["example.com", "localhost", True, False, True, False, False, "not a url", "socks5://***@h:1", "abcde..."]


def test_globs(spark):
    e = lambda url, *p: N.excluded(F.lit(url), list(p))
    got = one(spark, e("http://a.example/blog/x", "/blog/*"), e("http://a.example/blog/x/y", "/blog/*"), e("http://a.example/f.pdf", "*.pdf"), e("http://a.example/f.pdf", "/*.pdf"), e("http://a.example/x", "[bad"), e("http://a.example/b7", "/b[0-9]"), e("http://a.example/bx", "/b[^0-9]"))
    assert list(got) == [True, False, False, True, False, True, True] and N.glob_regex("a[") is None and N.glob_regex("\\") is None


def test_signature(spark):
    for secret in ("s", "x" * 100):
        want = "sha256=" + hmac.new(secret.encode(), "bödy".encode(), hashlib.sha256).hexdigest()
        assert one(spark, N.hmac_sha256(F.lit("bödy"), secret)).c0 == want
    assert one(spark, N.hmac_sha256(F.lit("x"), "")).c0 is None


def test_scores(spark):
    s = lambda tag, cls, t, h, k: N.element_score(F.lit(tag), F.lit(cls), F.lit(None).cast("string"), F.lit(t), F.lit(h), F.lit(k))
    got = one(spark, s("div", "", 0, 0, 0), s("div", "main sidebar", 0, 10, 0), s("article", "", 99, 198, 0), s("div", "shadow", 0, 5, 0))
    assert got.c0 == 0.0 and got.c1 == 0.0 and got.c2 == pytest.approx(1.5 + 7.5 + 1.0) and got.c3 == -3.0


@pytest.mark.parametrize(("r", "p", "want"), [(100, 100, "readability"), (601, 60, "pruning"), (600, 60, "readability"), (500, 50, "readability"), (60, 601, "readability"), (60, 600, "pruning"), (50, 900, "pruning")])
def test_choice(spark, r, p, want):
    assert one(spark, N.choose_extraction(F.lit(r), F.lit(p))).c0 == want


def test_errors(spark):
    got = one(spark, N.error_status(F.lit("ACTION_FAILED")), N.error_status(F.lit("LLM_AUTH_FAILURE"), True), N.navigation_error(F.lit("context deadline exceeded")), N.navigation_error(F.lit("dns")), N.llm_error(F.lit(500), F.lit('{"error":{"message":"m"}}')), N.is_json(F.lit("{")), N.is_json(F.lit("[1]")), N.error_text(F.lit(None).cast("string"), F.lit("m"), F.lit(None).cast("string")))
    assert (got.c0, got.c1, got.c2, got.c3, got.c5, got.c6, got.c7) == (500, 401, "SCRAPE_TIMEOUT", "NAVIGATION_FAILED", False, True, "INTERNAL_ERROR: m")
    assert tuple(got.c4) == ("LLM_FAILURE", "LLM API returned 500: m")
