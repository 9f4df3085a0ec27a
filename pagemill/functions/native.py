"""Column functions: everything here stays in the JVM (no Python at run time)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- tokens and savings -----------------------------------------------------------------------------------------


def estimate_tokens(text: Column) -> Column:
    """Token estimate: code points div 3, at least 1 for a non-empty text, 0 for an empty or null one."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 3))).otherwise(F.lit(0)).cast("bigint")


def savings_percent(original: Column, cleaned: Column) -> Column:
    """Percentage saved, rounded to two places half away from zero; 0 where nothing was there; may be negative."""
    share = (original - cleaned).cast("double") / original.cast("double") * 100
    return F.when(original > 0, F.round(share * 100) / 100).otherwise(F.lit(0.0))


# --- URLs -------------------------------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    """Host without user and port, in the case it is written; the URL itself where it has none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(h != "", h).otherwise(url)


def url_netloc(url: Column) -> Column:
    """Host with port."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def base_domain(netloc: Column) -> Column:
    """The last two labels of a host, cut at its last colon; hosts of two labels or fewer as they are."""
    return F.substring_index(F.regexp_replace(netloc, r":[^:]*$", ""), ".", -2)


def same_host(a: Column, b: Column) -> Column:
    """Hosts with ports are equal whatever their case."""
    return F.lower(url_netloc(a)) == F.lower(url_netloc(b))


def in_scope(link: Column, base: Column, scope: str = "domain") -> Column:
    """Whether a crawl of ``base`` may follow ``link``: ``page`` never, ``domain`` on its host, ``subdomain`` on its
    base domain; any other word is ``domain``. Only http and https links are in scope."""
    web = url_scheme(link).isin("http", "https")
    if scope == "page":
        return F.lit(False)
    if scope == "subdomain":
        return web & (F.lower(base_domain(url_netloc(link))) == F.lower(base_domain(url_netloc(base))))
    return web & same_host(link, base)


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a path glob (``*`` and ``?`` stop at ``/``, ``[..]`` classes, ``\\`` escapes); None if
    the pattern is malformed."""
    out, k, n = [], 0, len(pattern)
    specials = set(r".^$+{}()|[]\*?")
    while k < n:
        c = pattern[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k == n:
                return None
            out.append("\\" + pattern[k] if pattern[k] in specials else pattern[k])
        elif c == "[":
            end = k + 1 + (pattern[k + 1 : k + 2] == "^")
            first, items = end, []
            while end < n and (pattern[end] != "]" or end == first):
                if pattern[end] == "\\":
                    end += 1
                    if end >= n:
                        return None
                items.append(pattern[end] if pattern[end] in "-" else ("\\" + pattern[end] if pattern[end] in specials else pattern[end]))
                end += 1
            if end >= n or not items:
                return None
            out.append("[" + ("^" if pattern[k + 1] == "^" else "") + "".join(items) + "]")
            k = end
        else:
            out.append("\\" + c if c in specials else c)
        k += 1
    return "^" + "".join(out) + "$"


def excluded(url: Column, patterns: list[str]) -> Column:
    """Whether any glob matches the URL's path or the whole URL; malformed globs match nothing."""
    out = F.lit(False)
    for p in patterns:
        r = glob_regex(p)
        if r is not None:
            out = out | url_path(url).rlike(r) | url.rlike(r)
    return out


def host_suffixes(host: Column) -> Column:
    """A host and all its parent domains, as an array."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, 1000), "."))


def redact_proxy(url: Column) -> Column:
    """A proxy URL without its credentials."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@]*@", r"$1***@")


def search_referer(url: Column) -> Column:
    """The referer of a visit that came from a search for the host."""
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(url_host(url)))


# --- keys and signatures ----------------------------------------------------------------------------------------


def cache_key(url: Column, output_format: Column, mode: Column) -> Column:
    return F.sha2(F.concat_ws("|", url, output_format, mode), 256)


def hmac_sha256(body: Column, secret: str) -> Column:
    """``sha256=`` and the hex HMAC of a text under a secret; null for an empty secret."""
    if not secret:
        return F.lit(None).cast("string")
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), F.encode(body, "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(F.unhex(F.lit(outer.hex())), first), 256))


# --- fingerprints -----------------------------------------------------------------------------------------------

#: 64-bit FNV-1a: offset basis (as signed) and the low part of the prime 2**40 + 435 (fixed values).
FNV_BASIS = -3750763034362895579
FNV_LOW = 435


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def fnv1a64(word: Column) -> Column:
    """64-bit FNV-1a of a word's UTF-8 bytes, as a signed bigint."""
    digits = F.hex(F.encode(word, "UTF-8"))
    mask = F.lit(0xFFFFFFFF)
    octets = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.length(digits) / 2 - 1, F.lit(0)).cast("int")), lambda k: F.length(digits) > 0),
        lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("bigint"),
    )

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        low, high = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        product = low * FNV_LOW
        top = (high * FNV_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(mask))

    return F.aggregate(octets, F.lit(FNV_BASIS).cast("bigint"), step)


def simhash_bits(hashes: Column) -> Column:
    """SimHash of an array of hashes: a bit is set if more of them have it than not; 0 for none."""

    def bit(k: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.call_function("shiftright", h, k).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))

    raw = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(hashes) > 0, raw).otherwise(F.lit(0).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similar(a: Column, b: Column, threshold: int) -> Column:
    return hamming(a, b) <= threshold


def shingles(items: Column, n: int = 3) -> Column:
    """Each n consecutive items joined by ``_``; none for fewer."""
    return F.when(
        F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda k: F.array_join(F.slice(items, k, n), "_"))
    ).otherwise(F.array().cast("array<string>"))


# --- scoring of page parts --------------------------------------------------------------------------------------

# Words of class and id names that speak for and against content (fixed values).
POSITIVE_NAMES = ["content", "article", "post", "entry", "body", "main", "text"]
NEGATIVE_NAMES = ["sidebar", "ad", "widget", "nav", "menu", "comment", "footer", "header", "banner", "popup", "modal", "cookie", "social", "share", "related", "recommend", "promo"]


def tag_weight(tag: Column) -> Column:
    return F.when(F.lower(tag).isin("article", "main", "section"), 5.0).when(F.lower(tag).isin("nav", "footer", "aside", "header"), -5.0).otherwise(0.0)


def name_weight(class_name: Column, element_id: Column) -> Column:
    names = F.lower(F.concat(F.coalesce(class_name, F.lit("")), F.lit(" "), F.coalesce(element_id, F.lit(""))))
    up = F.when(names.rlike("|".join(POSITIVE_NAMES)), 3.0).otherwise(0.0)
    return up - F.when(names.rlike("|".join(NEGATIVE_NAMES)), 3.0).otherwise(0.0)


def element_score(tag: Column, class_name: Column, element_id: Column, text_len: Column, html_len: Column, link_len: Column) -> Column:
    """Score of a page part from its tag, names and byte lengths of its trimmed text, HTML and links."""
    density = F.when(html_len > 0, text_len.cast("double") / html_len).otherwise(0.0)
    links = F.when(text_len > 0, link_len.cast("double") / text_len).otherwise(0.0)
    return 3.0 * density - 2.0 * links + 1.5 * tag_weight(tag) + 1.0 * name_weight(class_name, element_id) + 0.5 * F.log10(text_len.cast("double") + 1.0)


def choose_extraction(readable_len: Column, pruned_len: Column) -> Column:
    """``readability`` or ``pruning`` from the byte lengths of their trimmed texts: the longer, unless it is more
    than ten times a usable other (then it has kept the whole page)."""
    r, p = readable_len, pruned_len
    return F.when(r >= p, F.when((p > 50) & (r > p * 10), "pruning").otherwise("readability")).otherwise(F.when((r > 50) & (p > r * 10), "readability").otherwise("pruning"))


# --- small formats and lookups ----------------------------------------------------------------------------------

# HTTP status of each error code (fixed values); any other code is 500.
ERROR_STATUS = {
    "SCRAPE_TIMEOUT": 504,
    "NAVIGATION_FAILED": 502,
    "INVALID_INPUT": 400,
    "RATE_LIMITED": 429,
    "UNAUTHORIZED": 401,
}
EXTRACT_ERROR_STATUS = ERROR_STATUS | {"LLM_RATE_LIMITED": 429, "LLM_AUTH_FAILURE": 401, "LLM_FAILURE": 502}


def error_status(code: Column, extract: bool = False) -> Column:
    table = F.create_map(*[F.lit(x) for pair in (EXTRACT_ERROR_STATUS if extract else ERROR_STATUS).items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.lit(500)))


def error_text(code: Column, message: Column, cause: Column) -> Column:
    """``code: message[: cause]``."""
    return F.concat_ws(": ", F.coalesce(code, F.lit("INTERNAL_ERROR")), message, cause)


def navigation_error(reason: Column) -> Column:
    """Error code of a failed navigation."""
    return F.when(F.lower(reason).rlike("deadline exceeded|context canceled|timeout"), "SCRAPE_TIMEOUT").otherwise("NAVIGATION_FAILED")


def llm_error(status: Column, body: Column) -> Column:
    """(code, message) of a failed extraction call; the texts are fixed."""
    said = F.get_json_object(body, "$.error.message")
    message = F.when(F.coalesce(said, F.lit("")) != "", said).otherwise("LLM API error")
    return F.struct(
        F.when(status.isin(401, 403), "LLM_AUTH_FAILURE").when(status == 429, "LLM_RATE_LIMITED").otherwise("LLM_FAILURE").alias("code"),
        F.when(status.isin(401, 403, 429), message).otherwise(F.concat(F.lit("LLM API returned "), status.cast("string"), F.lit(": "), message)).alias("message"),
    )


def is_html_type(content_type: Column) -> Column:
    return F.lower(content_type).contains("text/html") | F.lower(content_type).contains("application/xhtml+xml")


def blocked_resource(kind: Column, blocked: list[str] | None = None) -> Column:
    return kind.isin(*(blocked if blocked is not None else ["Image", "Stylesheet", "Font", "Media"]))


def title_fallback(title: Column, fetched: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(fetched)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def shorten(url: Column, most: int) -> Column:
    return F.when(F.length(url) > most, F.concat(F.substring(url, 1, most - 3), F.lit("..."))).otherwise(url)


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def pool_degraded(active: Column, most: Column) -> Column:
    return F.when((most > 0) & (active > F.floor(most * 0.8)), "degraded").otherwise("healthy")


def job_status(ok: Column, failed: Column, empty_is_complete: bool = True) -> Column:
    """completed, partial or failed, from counts of results."""
    total = ok + failed
    none = F.when(total == 0, "completed" if empty_is_complete else "failed")
    return none.when(failed == total, "failed").when(failed > 0, "partial").otherwise("completed")
