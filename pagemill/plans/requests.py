"""Requests as rows: JSON bodies bound to columns, defaults, validation, keys, and what the cache already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import cache_key

# Names, types, limits and words of the request bodies (fixed values).
COMMON = "output_format string, extract_mode string, wait_for_network_idle boolean, timeout int, stealth boolean"
BODIES = {
    "scrape": f"url string, {COMMON}, proxy_url string, css_selector string, include_tags array<string>, exclude_tags array<string>, only_main_content boolean, remove_overlays boolean, block_ads boolean, cdp_url string, max_age bigint, headers map<string, string>, cookies array<struct<name: string, value: string, domain: string, path: string>>, actions array<struct<type: string, selector: string, milliseconds: int, direction: string, amount: int, code: string>>",
    "batch": f"urls array<string>, options struct<{COMMON.replace(' ', ': ').replace(',:', ',')}>, webhook_url string, webhook_secret string",
    "crawl": "url string, max_depth int, max_pages int, scope string, exclude_patterns array<string>, options struct<output_format: string, extract_mode: string>, webhook_url string, webhook_secret string",
    "extract": f"url string, schema string, llm_api_key string, llm_model string, llm_base_url string, {COMMON}, proxy_url string, css_selector string",
}
FORMATS = ("markdown", "html", "text")
MODES = ("readability", "raw")
ALL_FORMATS = (*FORMATS, "markdown_citations")
ALL_MODES = (*MODES, "pruning", "auto")
SCOPES = ("domain", "subdomain", "page")
ACTIONS = ("wait", "click", "scroll", "execute_js", "scrape")
MAX_TIMEOUT, MAX_ACTIONS, MAX_URLS, MAX_DEPTH, MAX_PAGES = 120, 50, 100, 10, 500


def is_url(text: Column) -> Column:
    """Whether a text is a URL with a scheme and something behind it."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#\s]+|[^/\s])\S*$"), F.lit(False))


def _unset(c: Column) -> Column:
    return c.isNull() | (c == "")


def _one_of(c: Column, words: tuple[str, ...]) -> Column:
    return _unset(c) | c.isin(*words)


def _between(c: Column, low: int, high: int | None) -> Column:
    """A number that is unset (zero counts as that) or within its limits."""
    return c.isNull() | (c == 0) | (c >= low) & (c <= high if high is not None else F.lit(True))


def checks(kind: str, r: Column) -> dict[str, Column]:
    """By field whether a bound body ``r`` of a kind may be served as it is."""
    options = r["options"] if kind in ("batch", "crawl") else r
    wide = kind in ("scrape", "extract")
    out = {
        "output_format": _one_of(options["output_format"], ALL_FORMATS if wide else FORMATS),
        "extract_mode": _one_of(options["extract_mode"], ALL_MODES if wide else MODES),
    }
    if kind == "batch":
        out["urls"] = F.coalesce(F.size(r["urls"]).between(1, MAX_URLS), F.lit(False))
    else:
        out["url"] = is_url(r["url"])
    if kind != "crawl":
        out["timeout"] = _between(options["timeout"], 1, MAX_TIMEOUT)
    if wide:
        out["proxy_url"] = _unset(r["proxy_url"]) | is_url(r["proxy_url"])
    else:
        out["webhook_url"] = _unset(r["webhook_url"]) | is_url(r["webhook_url"])
    if kind == "scrape":
        out["max_age"] = _between(r["max_age"], 0, None)
        good = lambda a: F.coalesce(a["type"].isin(*ACTIONS), F.lit(False)) & _one_of(a["direction"], ("up", "down"))
        out["actions"] = r["actions"].isNull() | (F.size(r["actions"]) <= MAX_ACTIONS) & F.forall(r["actions"], good)
        out["cookies"] = r["cookies"].isNull() | F.forall(r["cookies"], lambda c: ~_unset(c["name"]) & ~_unset(c["value"]))
    if kind == "crawl":
        out["max_depth"] = _between(r["max_depth"], 1, MAX_DEPTH)
        out["max_pages"] = _between(r["max_pages"], 1, MAX_PAGES)
        out["scope"] = _one_of(r["scope"], SCOPES)
    if kind == "extract":
        out["schema"] = ~_unset(r["schema"])
        out["llm_api_key"] = ~_unset(r["llm_api_key"])
    return out


def bind(df: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """``df`` with ``request`` (the JSON ``body`` as a struct, its defaults filled in) and ``error``: null, or the code and
    the fields that are not valid. A body that is no JSON object is an error, never an exception."""
    raw = F.from_json(F.col(body), BODIES[kind])
    got = df.withColumn("_r", raw)
    r = F.col("_r")
    wrong = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(checks(kind, r).items())]), lambda x: x.isNotNull())
    broken = F.get_json_object(F.col(body), "$").isNull() | ~F.trim(F.col(body)).startswith("{")
    message = F.when(F.coalesce(broken, F.lit(True)), "not a JSON object").when(F.size(wrong) > 0, F.concat(F.lit("invalid "), F.array_join(wrong, ", ")))
    error = F.when(message.isNotNull(), F.struct(F.lit("INVALID_INPUT").alias("code"), message.alias("message")))
    return got.select(*df.columns, filled(kind, r).alias("request"), error.alias("error"))


def filled(kind: str, r: Column) -> Column:
    """A bound body with its defaults."""
    text = lambda c, value: F.when(_unset(c), F.lit(value)).otherwise(c)
    number = lambda c, value: F.when(c.isNull() | (c == 0), F.lit(value)).otherwise(c)

    def common(x: Column) -> Column:
        x = x.withField("output_format", text(x["output_format"], "markdown")).withField("extract_mode", text(x["extract_mode"], "readability"))
        return x if kind == "crawl" else x.withField("timeout", number(x["timeout"], 30)).withField("wait_for_network_idle", F.coalesce(x["wait_for_network_idle"], F.lit(True)))

    if kind in ("batch", "crawl"):
        names = "output_format extract_mode" + (" wait_for_network_idle timeout stealth" if kind == "batch" else "")
        options = F.struct(*[r["options"][n].alias(n) for n in names.split()])
        r = r.withField("options", common(options))
        if kind == "crawl":
            r = r.withField("max_depth", number(r["max_depth"], 3)).withField("max_pages", number(r["max_pages"], 100)).withField("scope", text(r["scope"], "subdomain"))
        return r
    r = common(r)
    if kind == "scrape":
        return r.withField("extract_mode", F.when(r["only_main_content"] == F.lit(False), "raw").otherwise(r["extract_mode"])).withField("max_age", F.coalesce(r["max_age"], F.lit(0).cast("bigint")))
    return r.withField("llm_model", text(r["llm_model"], "gpt-4o-mini")).withField("llm_base_url", text(r["llm_base_url"], "https://api.openai.com/v1"))


def batch_urls(bound: DataFrame) -> DataFrame:
    """(…, idx, url) of valid batch requests: a row a URL, with its place, by which results are ordered again."""
    kept = [c for c in bound.columns if c not in ("request", "error")]
    return bound.where("error IS NULL").select(*kept, F.posexplode("request.urls").alias("idx", "url"))


def job_id(prefix: str = "") -> Column:
    """A prefix and 16 hex digits by chance."""
    return F.concat(F.lit(prefix), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 16))


def authorised(df: DataFrame, keys: list[str], api_key: str = "x_api_key", authorization: str = "authorization") -> DataFrame:
    """``df`` with ``allowed`` and ``error``: the key of the first header that gives one must be among ``keys``; without
    configured keys everything is allowed."""
    bearer = F.when(F.col(authorization).startswith("Bearer "), F.substring(authorization, 8, 1 << 20))
    key = F.coalesce(F.nullif(F.col(api_key), F.lit("")), F.nullif(bearer, F.lit("")))
    known = [k for k in keys if k]
    good = F.lit(True) if not keys else F.coalesce(key.isin(*known), F.lit(False)) if known else F.lit(False)
    said = F.when(key.isNull(), "missing API key: provide X-API-Key header or Authorization: Bearer <key>").otherwise("invalid API key")  # fixed texts
    return df.select("*", good.alias("allowed"), F.when(~good, F.struct(F.lit("UNAUTHORIZED").alias("code"), said.alias("message"))).alias("error"))


def looked_up(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``requests`` (url, output_format, extract_mode, max_age in ms, asked_at, ...) with ``cache_status`` and ``content``,
    from ``entries`` (key, created_at, content): the key's last entry is a hit if it was there by then and is no older
    than a positive max_age. Entries are combined by key before they meet the requests, so that a hot key has one."""
    last = entries.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("created_at", "content")).alias("_e"))
    asked = requests.withColumn("_key", cache_key(F.col("url"), F.col("output_format"), F.col("extract_mode")))
    age = (F.unix_micros(F.col("asked_at").cast("timestamp")) - F.unix_micros(F.col("_e.created_at").cast("timestamp"))) / 1000
    hit = F.coalesce((F.col("max_age") > 0) & (age >= 0) & (age <= F.col("max_age")), F.lit(False))
    status = F.when(F.coalesce("max_age", F.lit(0)) <= 0, "off").when(hit, "hit").otherwise("miss")
    return asked.join(last, "_key", "left").select(*requests.columns, status.alias("cache_status"), F.when(hit, F.col("_e.content")).alias("content"))


def kept_entries(entries: DataFrame, now: Column, most: int = 1000, hours: int = 1) -> DataFrame:
    """The entries (key, created_at, ...) that a cache keeps: those not older than ``hours``, and of these at most ``most``,
    which ones by chance (a hash of the key)."""
    fresh = entries.where(F.col("created_at").cast("timestamp") >= now.cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return fresh.orderBy(F.xxhash64("key"), "key").limit(most)


def live_jobs(jobs: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Jobs (created_at, ...) that are still known: a job is forgotten ``hours`` after its creation."""
    return jobs.where(F.col("created_at").cast("timestamp") >= now.cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))
