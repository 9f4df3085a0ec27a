"""The queries of the core operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import native as N
from .operators import page as P
from .operators.fingerprints import near_pairs, simhash_of, tag_fingerprint
from .plans import clean as C
from .plans import crawl as G
from .plans import extract as X
from .plans import jobs as J
from .plans import requests as Q
from .sources import sinks as D
from .streaming import state as S


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


# SQL of the estimate and of URL parts, as used in several statements.
def _est(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN greatest(1, length({x}) // 3) ELSE 0 END"


def _netloc(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"


def _host(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


def _path(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _base(netloc: str) -> str:
    cut = f"regexp_replace({netloc}, ':[^:]*$', '')"
    return f"CASE WHEN len(string_split({cut}, '.')) <= 2 THEN {cut} ELSE array_to_string(string_split({cut}, '.')[-2:], '.') END"


# --- tokens, URLs, keys -----------------------------------------------------------------------------------------


@query(
    "q_token_estimate",
    f"SELECT 'pages' AS kind, page_id AS id, ({_est('html')})::BIGINT AS tokens FROM pages UNION ALL SELECT 'documents', doc_id, ({_est('text')})::BIGINT FROM documents",
)
def q_token_estimate(spark, sf):
    a = table(spark, sf, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), N.estimate_tokens(F.col("html")).alias("tokens"))
    b = table(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), N.estimate_tokens(F.col("text")).alias("tokens"))
    return a.union(b)


@query(
    "q_scrape_savings",
    f"""WITH s AS (SELECT scrape_id, lower({_host('final_url')}) AS host, arg_max(tokens.original_estimate, ingested_at)::BIGINT AS o, ({_est('any_value(content)')})::BIGINT AS c
  FROM scrapes WHERE tokens.original_estimate IS NOT NULL AND content IS NOT NULL GROUP BY scrape_id, final_url)
SELECT host, count(*) AS records, sum(o)::BIGINT AS original, sum(c)::BIGINT AS cleaned,
  CASE WHEN sum(o) > 0 THEN round((sum(o) - sum(c))::DOUBLE / sum(o)::DOUBLE * 100 * 100) / 100 ELSE 0.0 END AS savings FROM s GROUP BY host""",
)
def q_scrape_savings(spark, sf):
    """Original and measured tokens of records, by host; repeated deliveries count once."""
    s = table(spark, sf, "scrapes").where("tokens.original_estimate IS NOT NULL AND content IS NOT NULL")
    x = s.select("scrape_id", "final_url", "ingested_at", F.col("tokens.original_estimate").cast("bigint").alias("o"), N.estimate_tokens(F.col("content")).alias("c"))
    one = x.groupBy("scrape_id", "final_url").agg(F.max_by("o", "ingested_at").alias("o"), F.first("c").alias("c"))
    g = one.groupBy(F.lower(N.url_host(F.col("final_url"))).alias("host")).agg(F.count("*").alias("records"), F.sum("o").alias("original"), F.sum("c").alias("cleaned"))
    return g.withColumn("savings", N.savings_percent(F.col("original"), F.col("cleaned")))


@query("q_base_domain", f"SELECT page_id, {_host('url')} AS host, {_base(_netloc('url'))} AS base_domain FROM pages")
def q_base_domain(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", N.url_host(u).alias("host"), N.base_domain(N.url_netloc(u)).alias("base_domain"))


@query(
    "q_scope_filter",
    f"""SELECT src, dst, regexp_matches(dst, '^(?i:https?):') AND lower({_netloc('dst')}) = lower({_netloc('src')}) AS by_domain,
  regexp_matches(dst, '^(?i:https?):') AND lower({_base(_netloc('dst'))}) = lower({_base(_netloc('src'))}) AS by_subdomain FROM (SELECT DISTINCT src, dst FROM crawl_edges WHERE src IS NOT NULL AND dst IS NOT NULL)""",
)
def q_scope_filter(spark, sf):
    e = table(spark, sf, "crawl_edges").where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    s, d = F.col("src"), F.col("dst")
    return e.select("src", "dst", N.in_scope(d, s, "domain").alias("by_domain"), N.in_scope(d, s, "subdomain").alias("by_subdomain"))


@query(
    "q_exclude_glob",
    f"SELECT page_id, regexp_matches({_path('url')}, '^/item-[^/]*$') OR regexp_matches({_path('url')}, '^/the-[a-m][^/]*$') OR regexp_matches(url, '^[^/]*[.]pdf$') AS excluded FROM pages",
)
def q_exclude_glob(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.excluded(F.col("url"), ["/item-*", "/the-[a-m]*", "*.pdf", "[broken"]).alias("excluded"))


@query("q_cache_key", "SELECT page_id, sha256(concat_ws('|', url, 'markdown', 'readability')) AS key FROM pages")
def q_cache_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.cache_key(F.col("url"), F.lit("markdown"), F.lit("readability")).alias("key"))


_SECRET = "whsec-example"


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in _SECRET.encode().ljust(64, b"\0")).hex()


@query(
    "q_webhook_signature",
    f"""WITH j AS (SELECT DISTINCT job_id, concat('{{"type":"batch.completed","job_id":"', job_id, '"}}') AS body FROM job_rows WHERE job_id IS NOT NULL)
SELECT job_id, concat('sha256=', sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(body))))) AS signature FROM j""",
)
def q_webhook_signature(spark, sf):
    jobs = table(spark, sf, "job_rows").where("job_id IS NOT NULL").select("job_id").distinct()
    body = F.concat(F.lit('{"type":"batch.completed","job_id":"'), F.col("job_id"), F.lit('"}'))
    return jobs.select("job_id", N.hmac_sha256(body, _SECRET).alias("signature"))


@query(
    "q_small_formats",
    f"""SELECT page_id, CASE WHEN length(url) > 40 THEN concat(substr(url, 1, 37), '...') ELSE url END AS short,
  concat('https://www.google.com/search?q=', {_host('url')}) AS referer, format('{{:,}}', page_id * 1000) AS pretty, {_path('url')} AS path FROM pages""",
)
def q_small_formats(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", N.shorten(u, 40).alias("short"), N.search_referer(u).alias("referer"), N.thousands(F.col("page_id") * 1000).alias("pretty"), N.url_path(u).alias("path"))


# --- page parsing -----------------------------------------------------------------------------------------------

_UNESCAPE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


_TITLE = "coalesce(regexp_extract(html, '<title>([^<]*)', 1), '')"


@query("q_title", f"SELECT page_id, trim({_UNESCAPE.format(_TITLE)}) AS title FROM pages")
def q_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.title_of("html").alias("title"))


_TAGS = "regexp_extract_all(coalesce(html, ''), '<([a-z][a-z0-9]*)(?:\\s[^<>]*)?>', 1)"


@query("q_tag_histogram", f"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest({_TAGS}) AS tag FROM pages) GROUP BY tag")
def q_tag_histogram(spark, sf):
    t = table(spark, sf, "pages").select("page_id", F.explode(P.tags_of("html")).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query(
    "q_shingles",
    f"""WITH t AS (SELECT page_id, {_TAGS} AS t FROM pages), s AS (SELECT page_id, unnest(CASE WHEN len(t) >= 3 THEN [concat_ws('_', t[i], t[i + 1], t[i + 2]) FOR i IN range(1, len(t) - 1)] ELSE [] END) AS shingle FROM t)
SELECT shingle, count(*) AS n FROM s GROUP BY shingle""",
)
def q_shingles(spark, sf):
    s = table(spark, sf, "pages").select(P.tags_of("html").alias("tags")).select(F.explode(N.shingles(F.col("tags"))).alias("shingle"))
    return s.groupBy("shingle").agg(F.count("*").alias("n"))


_ANCHORS = f"""h AS (SELECT page_id, url, {_netloc('url')} AS home, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS origin, regexp_replace(CASE WHEN {_path('url')} = '' THEN '/' ELSE {_path('url')} END, '[^/]*$', '') AS dir, regexp_extract_all(coalesce(html, ''), '<a href="([^"]+)">([^<]*)', 1) AS hrefs, regexp_extract_all(coalesce(html, ''), '<a href="([^"]+)">([^<]*)', 2) AS texts FROM pages),
  a AS (SELECT *, hrefs[i] AS href, trim({_UNESCAPE.format('texts[i]')}) AS text FROM h, range(1, 60) r(i) WHERE i <= len(hrefs) AND home <> ''),
  f AS (SELECT page_id, i, home, text, CASE WHEN starts_with(href, '#') THEN concat(regexp_replace(url, '#.*$', ''), href) WHEN regexp_matches(href, '^https?:') THEN href WHEN starts_with(href, '/') THEN concat(origin, href) WHEN starts_with(href, '../') THEN concat(origin, CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END, substr(href, 4)) ELSE concat(origin, dir, href) END AS href FROM a),
  o AS (SELECT page_id, href, min(i) AS i, arg_min(text, i) AS text, any_value(home) AS home FROM f GROUP BY page_id, href)"""


@query("q_links", f"WITH {_ANCHORS} SELECT page_id, lower({_netloc('href')}) = lower(home) AS internal, row_number() OVER (PARTITION BY page_id, lower({_netloc('href')}) = lower(home) ORDER BY i) - 1 AS pos, href, text FROM o")
def q_links(spark, sf):
    """Every link of every page: absolute URL, text, and whether it is internal."""
    x = table(spark, sf, "pages").select("page_id", P.links_of("html", "url").alias("l"))
    # both lists in one array: the page is parsed once
    marked = lambda kind, inside: F.transform(f"l.{kind}", lambda a, i: F.struct(F.lit(inside).alias("internal"), i.cast("bigint").alias("pos"), a["href"].alias("href"), a["text"].alias("text")))
    return x.select("page_id", F.explode(F.concat(marked("internal", True), marked("external", False))).alias("a")).select("page_id", "a.*")


@query(
    "q_link_counts",
    """WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '<a href="([^"]+)"[^>]*>', 1)) AS href FROM pages), r AS (SELECT page_id, CASE
  WHEN starts_with(href, '#') THEN concat(regexp_replace(url, '#.*$', ''), href) WHEN regexp_matches(href, '^https?:') THEN href
  WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), href)
  WHEN starts_with(href, '../') THEN concat('up:', href) ELSE concat('here:', href) END AS u FROM h)
SELECT page_id, count(DISTINCT u) AS links FROM r GROUP BY page_id""",
)
def q_link_counts(spark, sf):
    x = table(spark, sf, "pages").select("page_id", P.links_of("html", "url").alias("l"))
    return x.select("page_id", (F.size("l.internal") + F.size("l.external")).cast("bigint").alias("links")).where("links > 0")


def _escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@query(
    "q_images",
    """WITH d AS (SELECT scrape_id, any_value(images) AS l FROM scrapes WHERE len(images) > 0 AND final_url IS NOT NULL GROUP BY scrape_id), i AS (SELECT scrape_id, k, l[k].src AS src, trim(l[k].alt) AS alt FROM d, range(1, 100) r(k) WHERE k <= len(l))
SELECT scrape_id, src, arg_min(coalesce(alt, ''), k) AS alt FROM i WHERE src <> '' AND NOT starts_with(lower(src), 'data:') GROUP BY scrape_id, src""",
)
def q_images(spark, sf):
    """Images of pages that are written from the images of records, each twice."""
    s = table(spark, sf, "scrapes").where("size(images) > 0 AND final_url IS NOT NULL").groupBy("scrape_id").agg(F.first("images").alias("images"), F.first("final_url").alias("final_url"))
    one = F.transform("images", lambda i: F.concat(F.lit('<img src="'), _escaped(i["src"]), F.lit('" alt="'), _escaped(F.coalesce(i["alt"], F.lit(""))), F.lit('">')))
    html = F.concat(F.lit("<body><p>"), F.array_join(F.concat(one, one), " "), F.lit('<img src="data:image/gif;base64,x"></p></body>'))
    got = s.select("scrape_id", html.alias("html"), F.col("final_url").alias("url"))
    return got.select("scrape_id", F.explode(P.images_of("html", "url")).alias("i")).select("scrape_id", "i.src", "i.alt")


@query(
    "q_open_graph",
    f"SELECT page_id, {_UNESCAPE.format('t')} AS og_title FROM (SELECT page_id, regexp_extract(html, '<meta property=\"og:title\" content=\"([^\"]+)\">', 1) AS t FROM pages) WHERE t <> ''",
)
def q_open_graph(spark, sf):
    x = table(spark, sf, "pages").select("page_id", P.open_graph_of("html").alias("og"))
    return x.where("og.title <> ''").select("page_id", F.col("og.title").alias("og_title"))


# Visible text of pages as these are written: tags closed or cut off at the end, nothing hidden but scripts, styles, comments.
_BODY = "CASE WHEN strpos(h, '<body') > 0 THEN substr(h, strpos(h, '<body')) ELSE '' END"
_HIDDEN = r"(?s)<!--.*?(?:-->|$)|<(script|style|noscript)\b[^>]*>.*?(?:</(script|style|noscript)>|$)"
_VISIBLE = f"""v AS (SELECT page_id, coalesce(html, '') AS h FROM pages), w AS (SELECT page_id, h, list_filter(list_transform(string_split_regex(regexp_replace({_BODY}, '{_HIDDEN}', '<x>', 'g'), '<[^>]*(?:>|$)'), lambda x: regexp_replace({_UNESCAPE.format('x')}, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM v),
  t AS (SELECT page_id, h, array_to_string(list_transform(parts, lambda x: concat(x, ' ')), '') AS visible FROM w)"""


@query("q_visible_text", f"WITH {_VISIBLE} SELECT page_id, visible FROM t")
def q_visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.visible_of("html").alias("visible"))


@query(
    "q_needs_browser",
    f"""WITH {_VISIBLE} SELECT page_id, strlen(visible) < 50 OR contains(lower(h), '<div id="root"></div>') OR contains(lower(h), '<div id="app"></div>') OR contains(lower(h), '<div id="__next"></div>')
  OR regexp_matches(lower(h), '<noscript[^>]*>[^<]*(enable|activate|turn on|requires?)\\s+javascript') OR (len(regexp_extract_all(lower(h), '<script')) > 10 AND strlen(visible) < 200) AS needs_browser FROM t""",
)
def q_needs_browser(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.needs_browser_of("html").alias("needs_browser"))


@query(
    "q_savings_by_host",
    f"""WITH {_VISIBLE}, p AS (SELECT lower({_host('url')}) AS host, {_est('html')} AS o, {_est('visible')} AS c FROM pages JOIN t USING (page_id))
SELECT host, count(*) AS pages, sum(o)::BIGINT AS original, sum(c)::BIGINT AS cleaned,
  CASE WHEN sum(o) > 0 THEN round((sum(o) - sum(c))::DOUBLE / sum(o)::DOUBLE * 100 * 100) / 100 ELSE 0.0 END AS savings FROM p GROUP BY host""",
)
def q_savings_by_host(spark, sf):
    """Tokens of pages and of their visible text, by host."""
    x = table(spark, sf, "pages").select(F.lower(N.url_host(F.col("url"))).alias("host"), N.estimate_tokens(F.col("html")).alias("o"), N.estimate_tokens(P.visible_of("html")).alias("c"))
    g = x.groupBy("host").agg(F.count("*").alias("pages"), F.sum("o").alias("original"), F.sum("c").alias("cleaned"))
    return g.withColumn("savings", N.savings_percent(F.col("original"), F.col("cleaned")))


@query("q_prune_scores")
def q_prune_scores(spark, sf):
    return C.scored_parts(table(spark, sf, "pages"))


def _named(name: str, words: str, amount: str) -> str:
    return f"CASE WHEN regexp_matches({name}, '{words}') THEN {amount} ELSE 0.0 END"


@query(
    "q_notice_scores",
    f"""WITH d AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<div class="((?:ad|notice|promo|cookie-bar)">[^<]*)</div>', 1)) AS d FROM pages),
  x AS (SELECT page_id, string_split(d, '">')[1] AS class, {_UNESCAPE.format("substr(d, strpos(d, '\">') + 2)")} AS text FROM d),
  y AS (SELECT page_id, class, text, strlen(trim(text))::DOUBLE AS n, strlen(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;')) AS written FROM x)
SELECT page_id, class, text, round({_named("concat(class, ' ')", "content|article|post|entry|body|main|text", "3.0")} - {_named("concat(class, ' ')", "|".join(N.NEGATIVE_NAMES), "3.0")}
  + 3.0 * n / (written + strlen(class) + 20) + 0.5 * log10(n + 1.0), 9) AS score FROM y""",
)
def q_notice_scores(spark, sf):
    """Scores of simple notice blocks (text only), by native expressions over a native extraction."""
    d = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<div class="((?:ad|notice|promo|cookie-bar)">[^<]*)</div>'), 1)).alias("d"))
    text = F.expr("substring(d, instr(d, '\">') + 2)")
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    x = d.select("page_id", F.substring_index("d", '">', 1).alias("class"), text.alias("text"))
    written = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        written = F.replace(written, F.lit(a), F.lit(b))
    score = N.element_score(F.lit("div"), F.col("class"), F.lit(""), F.octet_length(F.trim("text")), F.octet_length(written) + F.octet_length("class") + 20, F.lit(0))
    return x.select("page_id", "class", "text", F.round(score, 9).alias("score"))


_NUMBERS = "length(p_name) * 7 % 97 * 13 AS text_len, length(p_type) * 11 % 53 * 31 AS html_len, p_partkey % 17 * 5 AS link_len"
_PARTS = f"SELECT p_partkey, (['article', 'NAV', 'div', 'footer', 'section', 'p'])[p_size % 6 + 1] AS tag, (['Main-Content', 'sidebar post', 'x', 'share text', ''])[p_partkey % 5 + 1] AS class, CASE WHEN p_partkey % 3 = 0 THEN 'footer-nav' ELSE 'entry' END AS id, {_NUMBERS} FROM part"


@query(
    "q_element_scores",
    f"""SELECT p_partkey, round(3.0 * CASE WHEN html_len > 0 THEN text_len::DOUBLE / html_len ELSE 0 END - 2.0 * CASE WHEN text_len > 0 THEN link_len::DOUBLE / text_len ELSE 0 END
  + 1.5 * CASE WHEN lower(tag) IN ('article', 'main', 'section') THEN 5.0 WHEN lower(tag) IN ('nav', 'footer', 'aside', 'header') THEN -5.0 ELSE 0.0 END
  + {_named("lower(concat(class, ' ', id))", "|".join(N.POSITIVE_NAMES), "3.0")} - {_named("lower(concat(class, ' ', id))", "|".join(N.NEGATIVE_NAMES), "3.0")} + 0.5 * log10(text_len + 1.0), 9) AS score FROM ({_PARTS})""",
)
def q_element_scores(spark, sf):
    """Scores of page parts with all signals: tags, names, densities, links and lengths."""
    p = table(spark, sf, "part")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    tag, cls = pick(["article", "NAV", "div", "footer", "section", "p"], F.col("p_size")), pick(["Main-Content", "sidebar post", "x", "share text", ""], F.col("p_partkey"))
    ident = F.when(F.col("p_partkey") % 3 == 0, "footer-nav").otherwise("entry")
    score = N.element_score(tag, cls, ident, F.length("p_name") * 7 % 97 * 13, F.length("p_type") * 11 % 53 * 31, F.col("p_partkey") % 17 * 5)
    return p.select("p_partkey", F.round(score, 9).alias("score"))


@query(
    "q_extraction_choice",
    """SELECT l_orderkey, l_linenumber, CASE WHEN r >= p THEN CASE WHEN p > 50 AND r > p * 10 THEN 'pruning' ELSE 'readability' END ELSE CASE WHEN r > 50 AND p > r * 10 THEN 'readability' ELSE 'pruning' END END AS choice
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 700 AS r, l_suppkey % 130 * (l_linenumber % 4) * 10 AS p FROM lineitem)""",
)
def q_extraction_choice(spark, sf):
    """Which of two extractions is taken, by the lengths of their texts."""
    r, p = F.col("l_partkey") % 700, F.col("l_suppkey") % 130 * (F.col("l_linenumber") % 4) * 10
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.choose_extraction(r, p).alias("choice"))


@query(
    "q_small_lookups",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS is_html, event_type IN ('Image', 'Media') AS blocked, CASE event_id % 3 WHEN 0 THEN 'SCRAPE_TIMEOUT' ELSE 'NAVIGATION_FAILED' END AS navigation,
  concat('http://***@p', event_id, ':80/') AS proxy, CASE event_id % 5 WHEN 0 THEN 504 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 401 END AS status,
  concat(CASE event_id % 2 WHEN 0 THEN 'X_CODE' ELSE 'INTERNAL_ERROR' END, ': said', CASE event_id % 7 WHEN 0 THEN ': cause' ELSE '' END) AS error FROM events""",
)
def q_small_lookups(spark, sf):
    """Content types, blocked resources, navigation errors, redacted proxies, statuses and error texts."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["text/HTML; charset=x", "application/xhtml+xml", "image/png", ""])), (i % 4 + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(x) for x in ("SCRAPE_TIMEOUT", "RATE_LIMITED", "OTHER", "UNAUTHORIZED", None)]), (i % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id",
        N.is_html_type(kind).alias("is_html"),
        N.blocked_resource(F.col("event_type"), ["Image", "Media"]).alias("blocked"),
        N.navigation_error(F.when(i % 3 == 0, "context deadline exceeded").otherwise("net::ERR")).alias("navigation"),
        N.redact_proxy(F.concat(F.lit("http://user:pass@p"), i.cast("string"), F.lit(":80/"))).alias("proxy"),
        N.error_status(code).alias("status"),
        N.error_text(F.when(i % 2 == 0, "X_CODE"), F.lit("said"), F.when(i % 7 == 0, "cause")).alias("error"),
    )


def _cleaned(mode: str, fmt: str):
    def run(spark, sf):
        got = C.clean(table(spark, sf, "pages"), C.Options(mode=mode, output_format=fmt))
        return got.select("page_id", "success", "content", F.col("metadata.title").alias("title"), F.col("tokens.original_estimate").alias("original"), F.col("tokens.cleaned_estimate").alias("cleaned"), F.col("tokens.savings_percent").alias("savings"))

    return run


for _mode in C.MODES:
    for _fmt in C.FORMATS:
        query(f"q_clean_{_mode}_{_fmt}")(_cleaned(_mode, _fmt))
_identity = f"""SELECT page_id, TRUE AS success, coalesce(html, '') AS content, trim({_UNESCAPE.format(_TITLE)}) AS title,
  ({_est('html')})::BIGINT AS original, ({_est('html')})::BIGINT AS cleaned, 0.0::DOUBLE AS savings FROM pages"""
ORACLE["q_clean_raw_html"] = ORACLE["q_clean_raw_text"] = _identity


@query("q_clean_selected")
def q_clean_selected(spark, sf):
    """Cleaning with a selector and with kept and dropped tags, with links, images and metadata."""
    o = C.Options(mode="raw", output_format="markdown", filters=P.Filters(css_selector="body > *", exclude=("nav", "footer", "div.ad, div.notice")))
    return C.clean(table(spark, sf, "pages"), o).select("page_id", "success", "content", "metadata.title", F.size("links.internal").alias("internal"), F.size("links.external").alias("external"), F.size("images").alias("images"))


# Hand-made pages, and what cleaning must make of them by the rules of HTML and of the service.
_PAGES = {
    "head": '<html><head><title> T &amp; U </title><meta property="og:title" content="A"><meta property="og:title" content="B"></head><body><h1>Head</h1><p>One <b>bold</b> and <i>soft</i>.</p></body></html>',
    "links": '<body><p><a href="/a">A</a> <a href="b">B</a> <a href="#f">F</a> <a href="mailto:m@x.example">M</a> <a href="/a">again</a> <a href="https://other.example/z">Z</a> <a>none</a></p></body>',
    "lists": '<body><ul><li>one<li>two<ul><li>in</ul></ul><ol start="3"><li>three</li><li>four</li></ol></body>',
    "table": "<body><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table></body>",
    "quote": '<body><blockquote><p>said</p><p>more</p></blockquote><pre><code class="language-py">x = 1\ny</code></pre></body>',
    "hidden": '<body><script>var a = "<p>no</p>";</script><style>p{}</style><noscript>n</noscript><p>seen</p><!-- c --></body>',
    "broken": "<p>one<p>two <b>three</p><div>four",
    "empty": "",
    "text": "just &lt;text&gt;",
}
_AS_MARKDOWN = [
    ("head", "T & U", "# Head\n\nOne **bold** and *soft*.", "", "", "B"),
    ("links", "", "[A](https://x.example/a) [B](https://x.example/d/b) [F](https://x.example/d/p#f) [M](mailto:m@x.example) [again](https://x.example/a) [Z](https://other.example/z) none", "https://x.example/a https://x.example/d/b https://x.example/d/p#f", "https://other.example/z", ""),
    ("lists", "", "- one\n- two\n  - in\n\n3. three\n4. four", "", "", ""),
    ("table", "", "| a | b |\n|---|---|\n| 1 | 2\\|3 |", "", "", ""),
    ("quote", "", "> said\n>\n> more\n\n```py\nx = 1\ny\n```", "", "", ""),
    ("hidden", "", "seen", "", "", ""),
    ("broken", "", "one\n\ntwo **three**\n\n**four**", "", "", ""),
    ("empty", "", "", "", "", ""),
    ("text", "", "just <text>", "", "", ""),
]
_FILTERED = [
    ("selector", "quote", "<p>said</p><p>more</p>"),
    ("selector", "broken", "<p>one</p><p>two <b>three</b></p>"),
    ("selector", "table", _PAGES["table"]),
    ("include", "lists", "<li>one</li><li>two<ul><li>in</li></ul></li><li>in</li><li>three</li><li>four</li>"),
    ("include", "table", "<td>1</td><td>2|3</td>"),
    ("exclude", "hidden", "<html><head></head><body><style>p{}</style><noscript>n</noscript><p>seen</p></body></html>"),
    ("exclude", "empty", "<html><head></head><body></body></html>"),
    ("exclude", "broken", "<html><head></head><body><p>one</p><p>two <b>three</b></p><div><b>four</b></div></body></html>"),
]


def _pages_by_hand(spark):
    return spark.createDataFrame([(k, "https://x.example/d/p", h) for k, h in _PAGES.items()], "case_id string, url string, html string")


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in v.split("\n")) + ")"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


@query("q_html_cases", _values(_AS_MARKDOWN, "case_id, title, content, internal, external, og_title"))
def q_html_cases(spark, sf):
    """Hand-made pages as Markdown, with title, links and Open Graph title."""
    got = C.clean(_pages_by_hand(spark), C.Options(mode="raw", output_format="markdown"))
    joined = lambda kind: F.array_join(F.transform(f"links.{kind}", lambda a: a["href"]), " ").alias(kind)
    return got.select("case_id", "metadata.title", "content", joined("internal"), joined("external"), F.col("og_metadata.title").alias("og_title"))


@query("q_filter_cases", _values(_FILTERED, "kind, case_id, content"))
def q_filter_cases(spark, sf):
    """Hand-made pages through a selector, kept tags and dropped tags."""
    kinds = {"selector": P.Filters(css_selector="p"), "include": P.Filters(include=("li", "td")), "exclude": P.Filters(exclude=("a", "img", "script"))}
    out = None
    for kind, filters in kinds.items():
        cases = _pages_by_hand(spark).where(F.col("case_id").isin([c for k, c, _ in _FILTERED if k == kind]))
        got = C.clean(cases, C.Options(mode="raw", output_format="html", filters=filters)).select(F.lit(kind).alias("kind"), "case_id", "content")
        out = got if out is None else out.union(got)
    return out


@query("q_clean_bad_selector", "SELECT page_id, FALSE AS success, 'INVALID_INPUT' AS code FROM pages")
def q_clean_bad_selector(spark, sf):
    o = C.Options(filters=P.Filters(css_selector="div[[["))
    return C.clean(table(spark, sf, "pages"), o).select("page_id", "success", "error.code")


_CITED = r"\[([^\]]+)\]\(([^)]+)\)"


@query(
    "q_citations",
    f"""WITH s AS (SELECT DISTINCT scrape_id, content FROM scrapes WHERE content IS NOT NULL),
  m AS (SELECT scrape_id, content, regexp_extract_all(content, '{_CITED}', 0) AS links, regexp_extract_all(content, '{_CITED}', 1) AS texts, regexp_extract_all(content, '{_CITED}', 2) AS urls, string_split_regex(content, '{_CITED}') AS rest FROM s),
  u AS (SELECT *, list_filter(urls, lambda x, i: list_position(urls, x) = i) AS once FROM m)
SELECT scrape_id, CASE WHEN len(urls) = 0 THEN content ELSE concat(array_to_string([concat(rest[i], CASE WHEN i <= len(urls) THEN concat('[', texts[i], '][', list_position(once, urls[i]), ']') ELSE '' END) FOR i IN range(1, len(rest) + 1)], ''),
  chr(10) || chr(10) || '---' || chr(10), array_to_string([concat('[', i, ']: ', once[i]) FOR i IN range(1, len(once) + 1)], chr(10))) END AS content FROM u""",
)
def q_citations(spark, sf):
    s = table(spark, sf, "scrapes").where("content IS NOT NULL").select("scrape_id", "content").distinct()
    return s.select("scrape_id", P.citations_of("content").alias("content"))


# --- fingerprints -----------------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B\\x1C-\\x1F]+'), lambda w: w <> '')"
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: concat('0x', x)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::UHUGEINT)"
_SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN ({0}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {0}::BIGINT END"


@query("q_word_fnv", f"WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM documents) SELECT w AS word, {_SIGNED.format('f')} AS fnv FROM (SELECT w, {_FNV} AS f FROM w)")
def q_word_fnv(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(N.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", N.fnv1a64(F.col("word")).alias("fnv"))


def _sim(source: str, key: str, words: str) -> str:
    return f"""k AS (SELECT i, (1::HUGEINT << i::HUGEINT)::UHUGEINT AS p FROM range(0, 64) r(i)), w AS (SELECT {key}, unnest({words}) AS w FROM {source}), v AS (SELECT w, {_FNV} AS f FROM (SELECT DISTINCT w FROM w)),
  b AS (SELECT {key}, i, sum(CASE WHEN (f // p) % 2 = 1 THEN 1 ELSE -1 END) AS votes FROM w JOIN v USING (w), k GROUP BY {key}, i),
  s AS (SELECT {key}, sum(CASE WHEN votes > 0 THEN p::HUGEINT ELSE 0::HUGEINT END)::UHUGEINT AS f FROM b JOIN k USING (i) GROUP BY {key}),
  h AS (SELECT {key}, {_SIGNED.format('coalesce(s.f, 0)')} AS fingerprint FROM {source} LEFT JOIN s USING ({key}))"""


@query("q_simhash_docs", f"WITH {_sim('documents', 'doc_id', _WORDS)} SELECT doc_id, fingerprint FROM h")
def q_simhash_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", simhash_of("text").alias("fingerprint"))


_DOM_WORDS = f"(SELECT CASE WHEN len(t) >= 3 THEN [concat_ws('_', t[i], t[i + 1], t[i + 2]) FOR i IN range(1, len(t) - 1)] ELSE t END FROM (SELECT {_TAGS} AS t))"


@query("q_dom_fingerprint", f"WITH {_sim('pages', 'page_id', _DOM_WORDS)} SELECT page_id, fingerprint FROM h")
def q_dom_fingerprint(spark, sf):
    return table(spark, sf, "pages").select("page_id", tag_fingerprint("html").alias("fingerprint"))


@query(
    "q_simhash_pairs",
    f"""WITH {_sim('documents', 'doc_id', _WORDS)} SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.fingerprint, b.fingerprint))::BIGINT AS distance
FROM h a JOIN h b ON a.doc_id < b.doc_id AND a.fingerprint <> 0 AND b.fingerprint <> 0 AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 6""",
)
def q_simhash_pairs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), simhash_of("text").alias("fingerprint"))
    return near_pairs(d, 6)


@query(
    "q_dom_groups",
    f"WITH {_sim('pages', 'page_id', _DOM_WORDS)} SELECT fingerprint, count(*) AS pages, min(page_id) AS first_page FROM h GROUP BY fingerprint",
)
def q_dom_groups(spark, sf):
    """Pages of equal structure."""
    return q_dom_fingerprint(spark, sf).groupBy("fingerprint").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


# --- discovery and crawl ----------------------------------------------------------------------------------------


@query("q_map_union", "SELECT DISTINCT url FROM (SELECT src AS url FROM crawl_edges UNION ALL SELECT dst FROM crawl_edges UNION ALL SELECT url FROM pages) WHERE trim(url) <> ''")
def q_map_union(spark, sf):
    e = table(spark, sf, "crawl_edges")
    return G.discover(e.select(F.col("src").alias("url")), e.select(F.col("dst").alias("url")), table(spark, sf, "pages").select("url"))


@query(
    "q_url_counts",
    f"SELECT lower({_host('src')}) AS host, count(DISTINCT dst) AS urls FROM crawl_edges WHERE src IS NOT NULL GROUP BY 1",
)
def q_url_counts(spark, sf):
    e = table(spark, sf, "crawl_edges").where("src IS NOT NULL")
    return e.groupBy(F.lower(N.url_host(F.col("src"))).alias("host")).agg(F.count_distinct("dst").alias("urls"))


@query(
    "q_robots_sitemaps",
    "SELECT page_id, concat(url, x) AS url FROM pages, (VALUES (''), ('?part=2')) t(x) WHERE url IS NOT NULL UNION ALL SELECT page_id, concat(url, '?part=3') FROM pages WHERE url IS NOT NULL AND page_id % 2 = 0",
)
def q_robots_sitemaps(spark, sf):
    """Sitemaps that robots texts name, one text for each page."""
    u = F.col("url")
    body = F.concat(F.lit("User-agent: *\r\nSITEMAP: "), u, F.lit("\r\nsitemap:\r\nDisallow: /x\nnot a sitemap: y\n  sitemap:  "), u, F.lit("?part=2  "), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\nSitemap:"), u, F.lit("?part=3"))).otherwise(F.lit("")))
    return G.robots_sitemaps(table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", body.alias("body")))


@query(
    "q_sitemaps",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM crawl_edges WHERE src IS NOT NULL AND dst IS NOT NULL), o(page) AS (SELECT min(src) FROM e GROUP BY lower({_host('src')}) UNION SELECT e.dst FROM o JOIN e ON e.src = o.page WHERE length(o.page) % 3 > 0)
SELECT DISTINCT e.dst AS url FROM o JOIN e ON e.src = o.page WHERE length(o.page) % 3 = 0""",
)
def q_sitemaps(spark, sf):
    """URLs reached through sitemap documents that are written from the links: two sources of three are indexes."""
    e = table(spark, sf, "crawl_edges").where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    loc = lambda tag: F.concat(F.lit(f"<{tag}><loc> "), _escaped(F.col("dst")), F.lit(f" </loc></{tag}>"))
    index = F.length("src") % 3 > 0
    parts = e.select("src", index.alias("index"), F.when(index, loc("sitemap")).otherwise(loc("url")).alias("part")).groupBy("src", "index").agg(F.array_join(F.collect_list("part"), "").alias("l"))
    body = F.when(F.col("index"), F.concat(F.lit("<sitemapindex>"), "l", F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> </loc></url>'), "l", F.lit("</urlset>")))
    roots = e.groupBy(F.lower(N.url_host(F.col("src")))).agg(F.min("src").alias("url")).select("url")
    return G.expand_sitemaps(roots, parts.select(F.col("src").alias("url"), body.alias("body")), depth=40)


@query("q_discover", f"WITH {_ANCHORS} SELECT href AS url FROM o WHERE lower({_netloc('href')}) = lower(home) AND trim(href) <> '' UNION SELECT concat(url, '?part=2') FROM pages WHERE url IS NOT NULL UNION SELECT dst FROM crawl_edges WHERE trim(dst) <> ''")
def q_discover(spark, sf):
    """URLs of a site from its home page's own links, robots texts and sitemaps."""
    pages = table(spark, sf, "pages")
    home = pages.select(F.explode(P.links_of("html", "url")["internal"]).alias("a")).select(F.col("a.href").alias("url"))
    robots = G.robots_sitemaps(pages.where("url IS NOT NULL").select("page_id", F.concat(F.lit("Sitemap: "), F.col("url"), F.lit("?part=2")).alias("body"))).select("url")
    return G.discover(home, robots, table(spark, sf, "crawl_edges").select(F.col("dst").alias("url")))


_BUDGET = 200
_STARTS = "SELECT min(src) AS url FROM crawl_edges WHERE src IS NOT NULL GROUP BY lower({host})"


@query(
    "q_crawl_bfs",
    f"""WITH RECURSIVE failed AS (SELECT metadata.source_url AS url FROM scrapes WHERE metadata.source_url IS NOT NULL GROUP BY 1 HAVING NOT bool_or(coalesce(success, FALSE))),
  e AS (SELECT DISTINCT src, dst FROM crawl_edges WHERE src <> dst AND regexp_matches(dst, '^(?i:https?):') AND lower({_netloc('src')}) = lower({_netloc('dst')}) AND NOT regexp_matches({_path('dst')}, '^/the-[a-f][^/]*$')),
  r(url, depth) AS (SELECT url, 0 FROM ({_STARTS.format(host=_host('src'))}) UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 4 AND r.url NOT IN (SELECT url FROM failed)), m AS (SELECT url, min(depth)::BIGINT AS depth FROM r GROUP BY url)
SELECT url, depth FROM m ORDER BY depth, url LIMIT {_BUDGET}""",
)
def q_crawl_bfs(spark, sf):
    """A crawl of at most 200 pages and depth 4 from the first source of every host, within hosts, with excluded paths and
    pages that failed (the budget is the feature)."""
    e = table(spark, sf, "crawl_edges")
    seeds = e.where("src IS NOT NULL").groupBy(F.lower(N.url_host(F.col("src")))).agg(F.min("src").alias("url")).select("url")
    s = table(spark, sf, "scrapes").select(F.col("metadata.source_url").alias("url"), "success").where("url IS NOT NULL")
    failed = s.groupBy("url").agg(F.bool_or(F.coalesce("success", F.lit(False))).alias("ok")).where("NOT ok").select("url")
    return G.crawl(seeds, e, max_depth=4, max_pages=_BUDGET, exclude=["/the-[a-f]*"], failed=failed)


@query(
    "q_reachable",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM crawl_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst), r(url, depth) AS (SELECT url, 0 FROM ({_STARTS.format(host=_host('src'))}) UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 3)
SELECT url, min(depth)::BIGINT AS depth FROM r GROUP BY url""",
)
def q_reachable(spark, sf):
    """Depths of all pages within three links of the first source of every host, over all links, without a budget."""
    e = table(spark, sf, "crawl_edges")
    seeds = e.where("src IS NOT NULL").groupBy(F.lower(N.url_host(F.col("src")))).agg(F.min("src").alias("url")).select("url")
    return G.crawl(seeds, e, max_depth=3, scope="all")


_CRAWL_HOSTS = f"""WITH s AS (SELECT scrape_id, lower({_host('final_url')}) AS host, bool_or(coalesce(success, FALSE)) AS ok FROM scrapes GROUP BY scrape_id, final_url)
SELECT host, count(*) AS total, count(*) FILTER (WHERE ok) AS completed, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'partial' ELSE 'completed' END AS status FROM s GROUP BY host"""


@query("q_crawl_status", _CRAWL_HOSTS)
def q_crawl_status(spark, sf):
    """Status of a crawl of each host, from its records."""
    s = table(spark, sf, "scrapes").groupBy("scrape_id", "final_url").agg(F.bool_or(F.coalesce("success", F.lit(False))).alias("ok"))
    g = s.groupBy(F.lower(N.url_host(F.col("final_url"))).alias("host")).agg(F.count("*").alias("total"), F.count_if("ok").alias("completed"))
    return g.withColumn("status", N.job_status(F.col("completed"), F.col("total") - F.col("completed")))


# --- jobs, races, caches ----------------------------------------------------------------------------------------


@query(
    "q_batch_status",
    """WITH d AS (SELECT DISTINCT * FROM job_rows), l AS (SELECT job_id, idx, max(ingested_at) AS t FROM d GROUP BY ALL), x AS (SELECT d.job_id, d.idx, max(coalesce(success, FALSE)) AS ok FROM d JOIN l ON d.job_id IS NOT DISTINCT FROM l.job_id AND d.idx IS NOT DISTINCT FROM l.idx AND d.ingested_at = l.t GROUP BY d.job_id, d.idx)
SELECT job_id, count(*) AS total, count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS failed, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'partial' ELSE 'completed' END AS status FROM x GROUP BY job_id""",
)
def q_batch_status(spark, sf):
    return J.batch_status(table(spark, sf, "job_rows"))


@query(
    "q_engine_race",
    """WITH a AS (SELECT DISTINCT url, started_at, engine, (start_delay_ms + latency_ms)::BIGINT AS f FROM race_attempts WHERE success AND start_delay_ms >= 0 AND latency_ms >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY url, started_at ORDER BY f, engine) AS k FROM a)
SELECT url, started_at, engine, f AS finish_ms FROM r WHERE k = 1""",
)
def q_engine_race(spark, sf):
    return J.race_winners(table(spark, sf, "race_attempts"))


@query(
    "q_domain_memory",
    f"""WITH a AS (SELECT DISTINCT url, started_at, engine, start_delay_ms + latency_ms AS f FROM race_attempts WHERE success AND start_delay_ms >= 0 AND latency_ms >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY url, started_at ORDER BY f, engine) AS k FROM a),
  w AS (SELECT lower({_host('url')}) AS host, url, started_at, engine FROM r WHERE k = 1), l AS (SELECT *, lag(engine) OVER o AS e, lag(started_at) OVER o AS t FROM w WINDOW o AS (PARTITION BY host ORDER BY started_at, url))
SELECT host, url, started_at, engine, CASE WHEN t + INTERVAL 24 HOUR >= started_at THEN e END AS remembered FROM l""",
)
def q_domain_memory(spark, sf):
    return J.domain_memory(J.race_winners(table(spark, sf, "race_attempts")), F.lower(N.url_host(F.col("url"))))


@query(
    "q_cache_hits",
    """SELECT DISTINCT key, asked_at, created_at, max_age, CASE WHEN coalesce(max_age, 0) <= 0 THEN 'off' WHEN created_at IS NOT NULL AND (epoch_us(asked_at) - epoch_us(created_at)) / 1000.0 <= max_age THEN 'hit' ELSE 'miss' END AS status FROM cache_rows""",
)
def q_cache_hits(spark, sf):
    return J.cache_lookups(table(spark, sf, "cache_rows"))


@query(
    "q_run_averages",
    "SELECT engine, count(*) AS runs, count(*) FILTER (WHERE success) AS ok, avg(latency_ms) FILTER (WHERE success AND latency_ms >= 0) AS avg_latency_ms, avg(start_delay_ms) FILTER (WHERE success) AS avg_start_delay_ms FROM (SELECT DISTINCT * EXCLUDE (ingested_at) FROM race_attempts) GROUP BY engine",
)
def q_run_averages(spark, sf):
    a = table(spark, sf, "race_attempts").drop("ingested_at").distinct().withColumn("latency_ms", F.when(F.col("latency_ms") >= 0, F.col("latency_ms")))
    return J.run_averages(a, "engine", ["latency_ms", "start_delay_ms"])


@query(
    "q_dominant_status",
    f"""WITH s AS (SELECT DISTINCT scrape_id, lower({_host('final_url')}) AS host, status_code FROM scrapes WHERE status_code IS NOT NULL), n AS (SELECT host, status_code, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, status_code) AS k FROM n)
SELECT host, status_code, n FROM r WHERE k = 1""",
)
def q_dominant_status(spark, sf):
    s = table(spark, sf, "scrapes").where("status_code IS NOT NULL").select("scrape_id", F.lower(N.url_host(F.col("final_url"))).alias("host"), "status_code").distinct()
    return J.dominant_status(s, "host")


@query(
    "q_page_health",
    """WITH e AS (SELECT DISTINCT url, engine, started_at, coalesce(success, FALSE) AS ok FROM race_attempts), x AS (SELECT url, engine, started_at, ok, sum(CASE WHEN ok THEN -0.5 ELSE 1.0 END) OVER w AS s, count(*) OVER w AS uses FROM e WINDOW w AS (PARTITION BY url ORDER BY started_at, engine, ok ROWS UNBOUNDED PRECEDING)),
  y AS (SELECT *, s - least(0.0, min(s) OVER w) AS score FROM x WINDOW w AS (PARTITION BY url ORDER BY started_at, engine, ok ROWS UNBOUNDED PRECEDING))
SELECT url, engine, started_at, ok, uses, score::DOUBLE AS score, score >= 3 OR uses >= 50 AS retire FROM y""",
)
def q_page_health(spark, sf):
    e = table(spark, sf, "race_attempts").select("url", "engine", "started_at", F.coalesce("success", F.lit(False)).alias("ok")).distinct()
    return J.health_scores(e, "url", ["started_at", "engine", "ok"], ~F.col("ok")).select("url", "engine", "started_at", "ok", "uses", "score", "retire")


@query(
    "q_ad_hosts",
    f"""WITH u AS (SELECT DISTINCT unnest(list_concat(links.internal, links.external)).href AS url FROM scrapes UNION SELECT * FROM (VALUES ('https://pagead2.googlesyndication.com/x'), ('https://STATIC.ads-twitter.com'), ('https://notsegment.io/'))), h AS (SELECT DISTINCT lower({_host('url')}) AS host FROM u WHERE url IS NOT NULL)
SELECT host, len(list_filter([{', '.join(repr(x) for x in J.AD_HOSTS)}], lambda a: host = a OR ends_with(host, '.' || a))) > 0 AS is_ad FROM h""",
)
def q_ad_hosts(spark, sf):
    s = table(spark, sf, "scrapes")
    urls = s.select(F.explode(F.concat("links.internal", "links.external")).alias("a")).select(F.col("a.href").alias("url"))
    some = spark.createDataFrame([("https://pagead2.googlesyndication.com/x",), ("https://STATIC.ads-twitter.com",), ("https://notsegment.io/",)], "url string")
    hosts = urls.union(some).where("url IS NOT NULL").select(F.lower(N.url_host(F.col("url"))).alias("host")).distinct()
    return hosts.select("host", J.is_ad_host(F.col("host")).alias("is_ad"))


_STATUS_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.EXTRACT_ERROR_STATUS.items())


@query("q_error_status", f"SELECT error.code AS code, CASE error.code {_STATUS_CASE} ELSE 500 END AS status, count(DISTINCT scrape_id) AS records FROM scrapes WHERE error.code IS NOT NULL GROUP BY error.code")
def q_error_status(spark, sf):
    s = table(spark, sf, "scrapes").where("error.code IS NOT NULL").select("scrape_id", "error.code")
    g = s.groupBy("code").agg(F.count_distinct("scrape_id").alias("records"))
    return g.select("code", N.error_status(F.col("code"), extract=True).alias("status"), "records")


@query("q_json_validity", "SELECT event_id, coalesce(json_valid(props), FALSE) AS valid FROM events")
def q_json_validity(spark, sf):
    return table(spark, sf, "events").select("event_id", N.is_json(F.col("props")).alias("valid"))


@query(
    "q_progress_events",
    """WITH s AS (SELECT scrape_id, bool_or(coalesce(success, FALSE)) AS ok, bool_or(coalesce(cache_status = 'hit', FALSE)) AS hit FROM scrapes GROUP BY scrape_id), e AS (SELECT scrape_id, CASE WHEN hit THEN ['scrape.started', 'scrape.completed'] WHEN ok THEN ['scrape.started', 'scrape.navigated', 'scrape.completed'] ELSE ['scrape.started', 'scrape.error'] END AS l FROM s)
SELECT scrape_id, (i - 1)::INTEGER AS seq, l[i] AS event FROM e, range(1, 4) r(i) WHERE i <= len(l)""",
)
def q_progress_events(spark, sf):
    s = table(spark, sf, "scrapes").groupBy("scrape_id").agg(F.bool_or(F.coalesce("success", F.lit(False))).alias("success"), F.bool_or(F.coalesce(F.col("cache_status") == "hit", F.lit(False))).alias("cached"))
    return J.progress_events(s)


@query(
    "q_delivery_attempts",
    """WITH j AS (SELECT DISTINCT job_id FROM job_rows WHERE job_id IS NOT NULL), s AS (SELECT job_id, NULLIF(length(job_id) % 5, 0) AS s FROM j), t(attempt, at_second) AS (VALUES (1, 0), (2, 1), (3, 6), (4, 36))
SELECT job_id, attempt, at_second, coalesce(attempt = s, FALSE) AS delivered FROM s, t WHERE s IS NULL OR attempt <= s""",
)
def q_delivery_attempts(spark, sf):
    j = table(spark, sf, "job_rows").where("job_id IS NOT NULL").select("job_id").distinct()
    return J.delivery_attempts(j, F.nullif(F.length("job_id") % 5, F.lit(0)))


@query(
    "q_scrape_report",
    """SELECT DISTINCT scrape_id, CASE WHEN coalesce(success, FALSE) THEN concat(CASE WHEN metadata IS NOT NULL THEN concat('Title: ', metadata.title, chr(10), 'Source: ', metadata.source_url, chr(10), chr(10)) ELSE '' END, content,
  CASE WHEN tokens IS NOT NULL THEN concat(chr(10), chr(10), '---', chr(10), 'Tokens: ', coalesce(tokens.cleaned_estimate, 0), ' (saved ', printf('%.0f', coalesce(tokens.savings_percent, 0.0)), '% from original ', coalesce(tokens.original_estimate, 0), ')') ELSE '' END)
  ELSE CASE WHEN error IS NOT NULL THEN concat('[', error.code, '] ', error.message) ELSE 'scrape failed' END END AS report FROM scrapes""",
)
def q_scrape_report(spark, sf):
    return J.scrape_report(table(spark, sf, "scrapes")).distinct()


_BLANK = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F"


@query(
    "q_extract",
    f"""WITH s AS (SELECT DISTINCT scrape_id, content FROM scrapes WHERE content IS NOT NULL), l AS (SELECT scrape_id, list_transform(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_full_match(x, '[{_BLANK}]*')), lambda x: regexp_replace(regexp_replace(x, '^[# ]+|[# ]+$', '', 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')) AS l FROM s)
SELECT scrape_id, l[1] AS title, substr(l[2], 1, 200) AS opening, NULL::VARCHAR AS code FROM l""",
)
def q_extract(spark, sf):
    """Structured data of records by the offline extractor, read from its JSON."""
    s = table(spark, sf, "scrapes").where("content IS NOT NULL").select("scrape_id", "content").distinct()
    x = X.extract(s, "content", '{"title": "string", "opening": "string"}', X.first_sentences)
    return x.select("scrape_id", F.get_json_object("data", "$.title").alias("title"), F.get_json_object("data", "$.opening").alias("opening"), "extract_error.code")


@query(
    "q_chat_response",
    """SELECT DISTINCT scrape_id, CASE WHEN k = 0 THEN concat('{"n": ', scrape_id, '}') END AS data, CASE WHEN k = 0 THEN (scrape_id % 1000 + 7)::INTEGER END AS total_tokens,
  CASE k WHEN 1 THEN 'LLM_FAILURE' WHEN 2 THEN 'LLM_FAILURE' WHEN 3 THEN 'LLM_RATE_LIMITED' WHEN 4 THEN 'LLM_AUTH_FAILURE' WHEN 5 THEN 'LLM_FAILURE' END AS code,
  CASE k WHEN 1 THEN 'LLM returned no choices' WHEN 2 THEN 'LLM returned invalid JSON' WHEN 3 THEN concat('slow down ', scrape_id) WHEN 4 THEN 'LLM API error' WHEN 5 THEN 'failed to parse LLM response' END AS message FROM (SELECT scrape_id, scrape_id % 6 AS k FROM scrapes)""",
)
def q_chat_response(spark, sf):
    """What answers of a chat completion API hold, from bodies made for each record."""
    i = F.col("scrape_id").cast("string")
    content = F.when(F.col("k") == 0, F.concat(F.lit('{"n": '), i, F.lit("}"))).otherwise(F.lit("{not json"))
    usage = F.struct(F.lit(7).alias("prompt_tokens"), (F.col("scrape_id") % 1000 + 7).cast("int").alias("total_tokens"))
    whole = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"), usage.alias("usage")))
    body = F.when(F.col("k").isin(0, 2), whole).when(F.col("k") == 1, '{"choices": []}').when(F.col("k") == 3, F.concat(F.lit('{"error": {"message": "slow down '), i, F.lit('"}}'))).when(F.col("k") == 4, "{}").otherwise("<html>")
    status = F.when(F.col("k") == 3, 429).when(F.col("k") == 4, 403).otherwise(200)
    s = table(spark, sf, "scrapes").select("scrape_id", (F.col("scrape_id") % 6).alias("k")).distinct()
    return s.select("scrape_id", X.chat_response(status, body).alias("r")).select("scrape_id", "r.data", F.col("r.usage.total_tokens").alias("total_tokens"), "r.error.code", "r.error.message")


# --- requests, look-ups, sinks ----------------------------------------------------------------------------------

_ASKED = "SELECT DISTINCT scrape_id, final_url, scrape_id % 150 AS t, CASE scrape_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN '' ELSE 'text' END AS f FROM scrapes WHERE final_url IS NOT NULL"


@query(
    "q_scrape_requests",
    f"""SELECT scrape_id, CASE WHEN t = 0 THEN 30 ELSE t END::INTEGER AS timeout, CASE WHEN f = '' THEN 'markdown' ELSE f END AS output_format, CASE WHEN scrape_id % 3 = 0 THEN 'raw' ELSE 'readability' END AS extract_mode,
  CASE WHEN len(w) > 0 THEN concat('invalid ', array_to_string(w, ', ')) END AS message FROM (SELECT *, list_filter([CASE WHEN f = 'pdf' THEN 'output_format' END, CASE WHEN t > 120 THEN 'timeout' END, CASE WHEN NOT regexp_matches(final_url, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#\\s]+|[^/\\s])\\S*$') THEN 'url' END], lambda x: x IS NOT NULL) AS w FROM ({_ASKED}))""",
)
def q_scrape_requests(spark, sf):
    """Requests bound from JSON bodies, with defaults and the fields that are not valid."""
    s = table(spark, sf, "scrapes").where("final_url IS NOT NULL").select("scrape_id", "final_url").distinct()
    f = F.when(F.col("scrape_id") % 4 == 0, "markdown").when(F.col("scrape_id") % 4 == 1, "pdf").when(F.col("scrape_id") % 4 == 2, "").otherwise("text")
    body = F.to_json(F.struct(F.col("final_url").alias("url"), (F.col("scrape_id") % 150).alias("timeout"), f.alias("output_format"), (F.col("scrape_id") % 3 != 0).alias("only_main_content")))
    got = Q.bind(s.select("scrape_id", body.alias("body")), "scrape")
    return got.select("scrape_id", "request.timeout", "request.output_format", "request.extract_mode", "error.message")


@query(
    "q_responses",
    """SELECT DISTINCT scrape_id, concat('{"success":', coalesce(success, FALSE), ',"status_code":', coalesce(status_code, 0), ',"links":', len(links.internal) + len(links.external), CASE WHEN error.code IS NOT NULL THEN concat(',"error":{"code":"', error.code, '"}') ELSE '' END, '}') AS json FROM scrapes WHERE links.internal IS NOT NULL AND links.external IS NOT NULL""",
)
def q_responses(spark, sf):
    """Responses as JSON text, without what is null."""
    s = table(spark, sf, "scrapes").where("links.internal IS NOT NULL AND links.external IS NOT NULL")
    rows = s.select("scrape_id", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("status_code", F.lit(0)).alias("status_code"), (F.size("links.internal") + F.size("links.external")).alias("links"), F.when(F.col("error.code").isNotNull(), F.struct("error.code")).alias("error"))
    return D.responses(rows, "scrape_id").distinct()


@query(
    "q_batch_urls",
    """WITH j AS (SELECT job_id, list(DISTINCT scrape_id ORDER BY scrape_id) AS l FROM job_rows WHERE scrape_id IS NOT NULL AND job_id IS NOT NULL GROUP BY job_id)
SELECT job_id, (i - 1)::INTEGER AS idx, concat('https://x.example/', l[i]) AS url FROM j, range(1, 101) r(i) WHERE len(l) <= 100 AND i <= len(l)""",
)
def q_batch_urls(spark, sf):
    """The URLs of batch requests of at most 100, each with its place."""
    j = table(spark, sf, "job_rows").where("scrape_id IS NOT NULL AND job_id IS NOT NULL").groupBy("job_id").agg(F.sort_array(F.collect_set("scrape_id")).alias("l"))
    body = F.to_json(F.struct(F.transform("l", lambda x: F.concat(F.lit("https://x.example/"), x.cast("string"))).alias("urls")))
    return Q.batch_urls(Q.bind(j.select("job_id", body.alias("body")), "batch")).select("job_id", "idx", "url")


@query(
    "q_api_keys",
    """SELECT DISTINCT job_id, k IN ('key-1', 'key-2') AS allowed, CASE WHEN k IS NULL THEN 'missing API key: provide X-API-Key header or Authorization: Bearer <key>' WHEN k NOT IN ('key-1', 'key-2') THEN 'invalid API key' END AS message
FROM (SELECT job_id, CASE length(job_id) % 4 WHEN 0 THEN 'key-1' WHEN 1 THEN 'key-2' WHEN 2 THEN 'other' END AS k FROM job_rows WHERE job_id IS NOT NULL)""",
)
def q_api_keys(spark, sf):
    """Requests with a key in either header, a wrong one, or none."""
    j = table(spark, sf, "job_rows").where("job_id IS NOT NULL").select("job_id").distinct()
    n = F.length("job_id") % 4
    asked = j.select("job_id", F.when(n == 0, "key-1").when(n == 2, "other").otherwise("").alias("x_api_key"), F.when(n == 1, "Bearer key-2").when(n == 0, "Bearer other").alias("authorization"))
    got = Q.authorised(asked, ["key-1", "key-2", ""])
    return got.select("job_id", F.coalesce("allowed", F.lit(False)).alias("allowed"), "error.message")


@query(
    "q_cache_join",
    """WITH e AS (SELECT sha256(concat_ws('|', final_url, 'markdown', 'readability')) AS key, scraped_at AS t, content FROM scrapes WHERE final_url IS NOT NULL AND content IS NOT NULL AND scraped_at IS NOT NULL),
  l AS (SELECT key, t, content FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, content DESC) AS k FROM e) WHERE k = 1),
  q AS (SELECT DISTINCT scrape_id, final_url, (scrape_id % 3 * 3600000)::BIGINT AS max_age, ingested_at FROM scrapes WHERE final_url IS NOT NULL),
  j AS (SELECT q.*, l.content, coalesce(max_age > 0 AND epoch_us(ingested_at) - epoch_us(t) >= 0 AND (epoch_us(ingested_at) - epoch_us(t)) / 1000.0 <= max_age, FALSE) AS hit FROM q LEFT JOIN l ON l.key = sha256(concat_ws('|', final_url, 'markdown', 'readability')))
SELECT scrape_id, ingested_at AS asked_at, CASE WHEN max_age <= 0 THEN 'off' WHEN hit THEN 'hit' ELSE 'miss' END AS cache_status, CASE WHEN hit THEN length(content) END AS n FROM j""",
)
def q_cache_join(spark, sf):
    """Requests joined to what a cache has: records as entries, their deliveries as requests."""
    s = table(spark, sf, "scrapes").where("final_url IS NOT NULL")
    entries = s.where("content IS NOT NULL AND scraped_at IS NOT NULL").select(N.cache_key(F.col("final_url"), F.lit("markdown"), F.lit("readability")).alias("key"), F.col("scraped_at").alias("created_at"), "content")
    asked = s.select("scrape_id", F.col("final_url").alias("url"), F.lit("markdown").alias("output_format"), F.lit("readability").alias("extract_mode"), (F.col("scrape_id") % 3 * 3_600_000).alias("max_age"), F.col("ingested_at").alias("asked_at")).distinct()
    return Q.looked_up(asked, entries).select("scrape_id", "asked_at", "cache_status", F.length("content").cast("bigint").alias("n"))


@query(
    "q_event_streams",
    """WITH s AS (SELECT scrape_id, bool_or(coalesce(success, FALSE)) AS ok, bool_or(coalesce(cache_status = 'hit', FALSE)) AS hit FROM scrapes GROUP BY scrape_id), e AS (SELECT scrape_id, CASE WHEN hit THEN ['started', 'completed'] WHEN ok THEN ['started', 'navigated', 'completed'] ELSE ['started', 'error'] END AS l FROM s)
SELECT scrape_id, array_to_string(list_transform(l, lambda x: concat('event: scrape.', x, chr(10), 'data: {"scrape_id":', scrape_id, '}', chr(10), chr(10))), '') AS text FROM e""",
)
def q_event_streams(spark, sf):
    """The event stream of each request as text."""
    e = q_progress_events(spark, sf).withColumn("data", F.to_json(F.struct("scrape_id")))
    return D.event_stream(e, "scrape_id", "seq")


_LATEST = """WITH d AS (SELECT job_id, idx, coalesce(success, FALSE) AS ok, scrape_id, row_number() OVER (PARTITION BY job_id, idx ORDER BY ingested_at DESC, coalesce(success, FALSE) DESC, scrape_id DESC NULLS LAST) AS k FROM job_rows WHERE job_id IS NOT NULL AND idx IS NOT NULL),
  l AS (SELECT job_id, idx, ok, scrape_id FROM d WHERE k = 1), t AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE ok) AS g, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'partial' ELSE 'completed' END AS status FROM l GROUP BY job_id)"""


def _results(spark, sf):
    """Each result of a job once, its last delivery."""
    j = table(spark, sf, "job_rows").where("job_id IS NOT NULL AND idx IS NOT NULL")
    best = F.max(F.struct("ingested_at", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("scrape_id", F.lit(-1)).alias("s"))).alias("r")
    return j.groupBy("job_id", "idx").agg(best).select("job_id", "idx", "r.success", F.nullif(F.col("r.s"), F.lit(-1)).alias("scrape_id"))


@query(
    "q_crawl_events",
    f"""{_LATEST} SELECT job_id, idx::BIGINT AS seq, concat('{{"type":"crawl.page","job_id":"', job_id, '","data":', coalesce(scrape_id::VARCHAR, 'null'), '}}') AS body FROM l
UNION ALL SELECT job_id, n::BIGINT, concat('{{"type":"crawl.', status, '","job_id":"', job_id, '","data":{{"completed":', g, ',"total":', n, '}}}}') FROM t""",
)
def q_crawl_events(spark, sf):
    """Webhook events of jobs: one a page and the final one."""
    return D.page_events(_results(spark, sf).withColumn("data", F.col("scrape_id").cast("string"))).select("job_id", "seq", "body")


@query(
    "q_batch_report",
    f"""{_LATEST} SELECT job_id, -1::BIGINT AS idx, concat('Batch ', job_id, ': ', status, ' (', g, '/', n, ' completed)', chr(10), chr(10)) AS part FROM t
UNION ALL SELECT job_id, idx::BIGINT, CASE WHEN ok THEN concat('--- [', row_number() OVER (PARTITION BY job_id ORDER BY idx), '] record ', scrape_id, ' ---', chr(10), chr(10), chr(10)) ELSE concat('--- [', row_number() OVER (PARTITION BY job_id ORDER BY idx), '] FAILED: unknown error ---', chr(10), chr(10)) END FROM l""",
)
def q_batch_report(spark, sf):
    """Reports of batch jobs, in the order of their results."""
    r = _results(spark, sf).withColumn("title", F.concat(F.lit("record "), F.coalesce(F.col("scrape_id").cast("string"), F.lit(""))))
    none = F.lit(None).cast("string")
    return D.job_report(r.withColumns({"source_url": none, "content": none, "message": none}))


@query(
    "q_url_report",
    f"""WITH u AS (SELECT DISTINCT lower({_host('src')}) AS key, dst AS url FROM crawl_edges WHERE src IS NOT NULL AND dst IS NOT NULL)
SELECT key, 0::BIGINT AS idx, concat('Found ', count(*), ' URLs:', chr(10), chr(10)) AS part FROM u GROUP BY key UNION ALL SELECT key, 1, concat(url, chr(10)) FROM u""",
)
def q_url_report(spark, sf):
    """Reports of the URLs that each site links to."""
    e = table(spark, sf, "crawl_edges").where("src IS NOT NULL AND dst IS NOT NULL")
    return D.url_report(e.select(F.lower(N.url_host(F.col("src"))).alias("key"), F.col("dst").alias("url")))


@query(
    "q_benchmark_lines",
    """WITH a AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM race_attempts), g AS (SELECT url, count(*) FILTER (WHERE success) AS ok, floor(avg(latency_ms) FILTER (WHERE success AND latency_ms >= 0))::BIGINT AS ms, count(*) AS n FROM a WHERE url IS NOT NULL GROUP BY url), x AS (SELECT *, CASE WHEN length(url) > 40 THEN concat(substr(url, 1, 37), '...') ELSE url END AS short FROM g)
SELECT url, CASE WHEN ok > 0 THEN concat(short, chr(9), ms, 'ms', chr(9), n % 100, '.5%', chr(9), format('{:,}', n * 1000), chr(9), '200') ELSE concat(short, chr(9), 'FAILED', chr(9), '-', chr(9), '-', chr(9), '-') END AS line FROM x WHERE ok = 0 OR ms IS NOT NULL""",
)
def q_benchmark_lines(spark, sf):
    """The rows of a benchmark table, from the attempts at each URL."""
    a = table(spark, sf, "race_attempts").drop("ingested_at").distinct().withColumn("latency_ms", F.when(F.col("latency_ms") >= 0, F.col("latency_ms")))
    r = J.run_averages(a.where("url IS NOT NULL"), "url", ["latency_ms"]).where("ok = 0 OR avg_latency_ms IS NOT NULL")
    n = F.col("runs")
    return D.benchmark_lines(r.select("url", "ok", F.floor("avg_latency_ms").alias("total_ms"), (n % 100 + 0.5).alias("savings_percent"), (n * 1000).alias("content_length"), F.lit(200).alias("status_code")))


@query("q_pool_health", "SELECT count(*) FILTER (WHERE success) AS active_pages, count(*) AS max_pages, CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE success) > floor(count(*) * 0.8) THEN 'degraded' ELSE 'healthy' END AS status FROM race_attempts")
def q_pool_health(spark, sf):
    """Health of a pool whose pages are the attempts, those that succeeded being in use."""
    return J.health(table(spark, sf, "race_attempts").select(F.col("success").alias("in_use")))


@query(
    "q_rollup",
    f"""WITH s AS (SELECT DISTINCT scrape_id, lower({_host('final_url')}) AS host, engine_used AS engine, coalesce(success, FALSE) AS ok FROM scrapes)
SELECT host, engine, count(*) AS records, count(*) FILTER (WHERE ok) AS ok, grouping(host, engine)::BIGINT AS level FROM s GROUP BY ROLLUP (host, engine)""",
)
def q_rollup(spark, sf):
    """Records by host and engine with subtotals (an extension on top of the service's own reports)."""
    s = table(spark, sf, "scrapes").select("scrape_id", F.lower(N.url_host(F.col("final_url"))).alias("host"), F.col("engine_used").alias("engine"), F.coalesce("success", F.lit(False)).alias("ok")).distinct()
    return s.rollup("host", "engine").agg(F.count("*").alias("records"), F.count_if("ok").alias("ok"), F.grouping_id().alias("level"))


# --- streams ----------------------------------------------------------------------------------------------------


@query(
    "q_rate_limit",
    f"""WITH RECURSIVE d AS (SELECT DISTINCT lower({_host('url')}) AS identity, url, engine, started_at AS ts FROM race_attempts), r AS (SELECT *, row_number() OVER o AS k, (epoch_us(ts) - lag(epoch_us(ts)) OVER o) / 1e6 AS gap FROM d WINDOW o AS (PARTITION BY identity ORDER BY ts, url, engine)),
  s(identity, k, kept, allowed) AS (SELECT identity, k, 9.0::DOUBLE, TRUE FROM r WHERE k = 1 UNION ALL SELECT identity, k, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM (SELECT r.identity, r.k, least(10.0::DOUBLE, s.kept + greatest(0.0::DOUBLE, r.gap) * 5.0::DOUBLE) AS t FROM s JOIN r ON r.identity = s.identity AND r.k = s.k + 1))
SELECT identity, url, engine, ts, allowed FROM r JOIN s USING (identity, k)""",
)
def q_rate_limit(spark, sf):
    """Token-bucket verdict of each request of a host's pages, in order of time."""
    r = table(spark, sf, "race_attempts").select("url", "engine", "started_at").distinct()
    return S.rate_limited(r.select(F.lower(N.url_host(F.col("url"))).alias("identity"), "url", "engine", F.col("started_at").alias("ts")), "identity", "ts")


@query(
    "q_stream_hourly",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, sum(value) AS total FROM (SELECT ts, event_type, round(value * 100)::BIGINT AS value FROM events WHERE ts IS NOT NULL) GROUP BY ALL",
)
def q_stream_hourly(spark, sf):
    """Events by hour and type, as a stream with a watermark run over the whole table."""
    return S.hourly_counts(spark, f"{sf}/events.parquet")


@query(
    "q_stream_cache",
    """WITH r AS (SELECT *, max(CASE WHEN created_at <= asked_at THEN created_at END) OVER (PARTITION BY key ORDER BY asked_at, created_at NULLS LAST, max_age NULLS LAST ROWS UNBOUNDED PRECEDING) AS entry FROM cache_rows WHERE key IS NOT NULL AND asked_at IS NOT NULL)
SELECT key, asked_at, CASE WHEN coalesce(max_age, 0) <= 0 THEN 'off' WHEN (epoch_us(asked_at) - epoch_us(coalesce(created_at, entry))) / 1000.0 <= max_age THEN 'hit' ELSE 'miss' END AS status FROM r""",
)
def q_stream_cache(spark, sf):
    """Cache look-ups as a stateful stream with time to live."""
    return S.cached_stream(spark, f"{sf}/cache_rows.parquet").withColumn("asked_at", F.col("asked_at").cast("timestamp_ntz"))
