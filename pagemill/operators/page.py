"""Raw pages parsed in one Arrow function into what the cleaning plan needs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dom, readability
from .dom import TEXT, Node
from .markdown import to_markdown, with_citations
from .selectors import SelectorError, compile_selector, select
from .urls import netloc, resolve

LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
LINKS = T.StructType([T.StructField("internal", T.ArrayType(LINK)), T.StructField("external", T.ArrayType(LINK))])
IMAGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("alt", T.StringType())])
OG = T.StructType([T.StructField(k, T.StringType()) for k in ("title", "description", "image", "type")])
PART = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("text_len", T.LongType()),
        T.StructField("html_len", T.LongType()),
        T.StructField("link_len", T.LongType()),
        T.StructField("html", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
META = T.StructType([T.StructField(k, T.StringType()) for k in ("title", "description", "site_name", "author", "language")])
PARSED = T.StructType(
    [
        T.StructField("filtered", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("fetched_title", T.StringType()),
        T.StructField("meta", META),
        T.StructField("readable", T.BooleanType()),
        T.StructField("article_html", T.StringType()),
        T.StructField("article_text", T.StringType()),
        T.StructField("parts", T.ArrayType(PART)),
        T.StructField("body_html", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("links", LINKS),
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("og", OG),
    ]
)


@dataclass(frozen=True)
class Filters:
    """What of a page is looked at: a selector, and tags to keep and to drop."""

    css_selector: str = ""
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())

    def apply(self, html: str) -> str:
        """The filtered HTML; raises SelectorError for a bad ``css_selector`` only."""
        if self.css_selector:
            hits = select(dom.parse(html), self.css_selector)
            html = "".join(dom.serialize(n) for n in hits) if hits else html
        if not self.include and not self.exclude:
            return html
        root = dom.parse(html)
        for source in self.exclude:
            for n in _matches(root, source):
                n.remove()
        if self.include:
            hits = _matches(root, ", ".join(self.include))
            if hits:
                return "".join(dom.serialize(n) for n in hits)
        return dom.serialize(root)


def _matches(root: Node, source: str) -> list[Node]:
    try:
        return select(root, source)
    except SelectorError:
        return []


def links(root: Node, url: str) -> dict:
    """Internal and external web links, each absolute URL once with its first text."""
    out: dict[str, list] = {"internal": [], "external": []}
    home = netloc(url)
    if not home:
        return out
    seen: set[str] = set()
    for a in root.elements():
        if a.tag != "a" or not a.attrs.get("href"):
            continue
        full = resolve(a.attrs["href"], url)
        if full is None or not full.lower().startswith(("http://", "https://")) or full in seen:
            continue
        seen.add(full)
        out["internal" if netloc(full) == home else "external"].append({"href": full, "text": a.text().strip()})
    return out


def images(root: Node, url: str) -> list[dict]:
    """Images by absolute URL, each once with its first description; data URLs are left out."""
    out: dict[str, str] = {}
    for n in root.elements():
        if n.tag == "img" and n.attrs.get("src"):
            full = resolve(n.attrs["src"], url)
            if full and not full.lower().startswith("data:"):
                out.setdefault(full, n.attrs.get("alt", "").strip())
    return [{"src": s, "alt": a} for s, a in out.items()]


def open_graph(root: Node) -> dict:
    """The four Open Graph fields; the last non-empty value wins."""
    out = dict.fromkeys(("title", "description", "image", "type"), "")
    for n in root.elements():
        if n.tag == "meta" and n.attrs.get("content"):
            key = n.attrs.get("property", "")
            if key.startswith("og:") and key[3:] in out:
                out[key[3:]] = n.attrs["content"]
    return out


def fetched_title(html: str) -> str:
    """Text of the first title element, without building a tree."""
    inside = False
    for token in dom.tokens(html):
        if token[0] == "start" and token[1] == "title":
            inside = True
        elif inside:
            return token[1].strip() if token[0] == "text" else ""
    return ""


def parts(root: Node) -> list[dict]:
    """The elements right below the body, with what their score needs (lengths in bytes)."""
    out = []
    for c in dom.body(root).children:
        if c.tag == TEXT:
            continue
        html, text = dom.serialize(c), c.text()
        out.append(
            {
                "tag": c.tag,
                "class": c.attrs.get("class", ""),
                "id": c.attrs.get("id", ""),
                "text_len": len(text.strip().encode()),
                "html_len": len(html.encode()),
                "link_len": sum(len(a.text().strip().encode()) for a in c.elements() if a.tag == "a"),
                "html": html,
                "text": text,
            }
        )
    return out


def visible_text(html: str) -> str:
    """Trimmed runs of text in the body outside scripts, styles and noscripts, a space after each."""
    out, body, hidden = [], False, 0
    for token in dom.tokens(html):
        if token[0] == "start":
            body = body or token[1] == "body"
            hidden += token[1] in ("script", "style", "noscript") and not token[3]
        elif token[0] == "end":
            hidden = max(0, hidden - (token[1] in ("script", "style", "noscript")))
        elif body and not hidden and (t := token[1].strip()):
            out.append(t + " ")
    return "".join(out)


def tag_sequence(html: str) -> list[str]:
    """Names of start tags in order, as written."""
    return [t[1] for t in dom.tokens(html or "") if t[0] == "start"]


_NOSCRIPT = re.compile(r"<noscript[^>]*>[^<]*(?:enable|activate|turn on|requires?)\s+javascript")


def needs_browser(html: str) -> bool:
    """Whether fetched HTML is likely a shell that scripts must fill."""
    seen = len(visible_text(html).encode())
    lower = html.lower()
    shells = ('<div id="root"></div>', '<div id="app"></div>', '<div id="__next"></div>')
    return seen < 50 or any(s in lower for s in shells) or _NOSCRIPT.search(lower) is not None or (lower.count("<script") > 10 and seen < 200)


def strip_tags(html: str) -> str:
    """All text of a page, scripts and styles too, trimmed."""
    return dom.parse(html).text().strip()


#: What a cleaning mode needs of a page besides its links, images and metadata.
ARTICLE, PARTS = "article", "parts"
ALL = frozenset([ARTICLE, PARTS])


def _failed(html: str | None, error: str) -> dict:
    return dict.fromkeys(PARSED.names) | {"filtered": html, "error": error, "parts": [], "images": [], "links": {"internal": [], "external": []}}


def parse_one(html: str | None, url: str | None, filters: Filters, need: frozenset[str] = ALL) -> dict:
    """The fields of :data:`PARSED` of a page; what is not in ``need`` is null."""
    html, url = html or "", url or ""
    try:
        filtered = filters.apply(html)
    except SelectorError as e:
        return _failed(html, f"INVALID_INPUT: {e}")
    root = dom.parse(filtered)
    out = dict.fromkeys(PARSED.names) | {"filtered": filtered, "fetched_title": fetched_title(html), "links": links(root, url), "images": images(root, url), "og": open_graph(root), "parts": []}
    if ARTICLE in need:
        article = readability.extract(root, filtered)
        meta = {"title": article.title, "description": article.excerpt, "site_name": article.site_name, "author": article.byline, "language": article.language}
        out |= {"meta": meta, "readable": article.found, "article_html": article.content, "article_text": article.text}
    if PARTS in need:
        body = dom.body(root)
        out |= {"parts": parts(root), "body_html": dom.serialize(body, inner=True), "body_text": body.text()}
    return out


def parse(html: Column, url: Column, filters: Filters | None = None, need: frozenset[str] = ALL) -> Column:
    """The struct of :data:`PARSED` of each page, by one Arrow function. It never raises: what cannot be parsed has
    ``error``."""
    chosen = filters or Filters()
    if chosen.css_selector:
        try:
            compile_selector(chosen.css_selector)
        except SelectorError:
            pass  # every row says so in ``error``

    @F.pandas_udf(PARSED)
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(h, u):
            try:
                rows.append(parse_one(x, y, chosen, need))
            except Exception as e:  # noqa: BLE001 - one bad page must not end the job
                rows.append(_failed(x, f"INTERNAL_ERROR: {e}"))
        return pd.DataFrame(rows, columns=PARSED.names)

    return run(html, url)


@F.pandas_udf(T.StringType())
def markdown_of(h: pd.Series, base: pd.Series) -> pd.Series:
    """HTML as Markdown."""
    return pd.Series([to_markdown(dom.body(dom.parse(x)), b or "") for x, b in zip(h, base)], dtype=object)


@F.pandas_udf(T.StringType())
def citations_of(markdown: pd.Series) -> pd.Series:
    """Markdown with numbered citations."""
    return markdown.map(lambda x: None if x is None else with_citations(x))


@F.pandas_udf(T.StringType())
def text_of(h: pd.Series) -> pd.Series:
    """All text of HTML, trimmed."""
    return h.map(lambda x: strip_tags(x or ""))


@F.pandas_udf(T.StringType())
def title_of(h: pd.Series) -> pd.Series:
    """Title of fetched HTML."""
    return h.map(lambda x: fetched_title(x or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tags_of(h: pd.Series) -> pd.Series:
    """Start tags of HTML in order."""
    return h.map(lambda x: tag_sequence(x or ""))


@F.pandas_udf(T.StringType())
def visible_of(h: pd.Series) -> pd.Series:
    """Visible text of HTML."""
    return h.map(lambda x: visible_text(x or ""))


@F.pandas_udf(T.BooleanType())
def needs_browser_of(h: pd.Series) -> pd.Series:
    """Whether HTML is a shell for scripts."""
    return h.map(lambda x: needs_browser(x or ""))


@F.pandas_udf(LINKS)
def links_of(h: pd.Series, url: pd.Series) -> pd.DataFrame:
    """Internal and external links of HTML."""
    return pd.DataFrame([links(dom.parse(x), u or "") for x, u in zip(h, url)], columns=LINKS.names)


@F.pandas_udf(T.ArrayType(IMAGE))
def images_of(h: pd.Series, url: pd.Series) -> pd.Series:
    """Images of HTML."""
    return pd.Series([images(dom.parse(x), u or "") for x, u in zip(h, url)])


@F.pandas_udf(OG)
def open_graph_of(h: pd.Series) -> pd.DataFrame:
    """Open Graph fields of HTML."""
    return pd.DataFrame([open_graph(dom.parse(x)) for x in h], columns=OG.names)


@F.pandas_udf(T.ArrayType(PART))
def parts_of(h: pd.Series) -> pd.Series:
    """Elements below the body with what their scores need."""
    return h.map(lambda x: parts(dom.parse(x)))
