"""The cleaning plan: measure, filter, extract, render, measure again, harvest.

HTML is parsed in one Arrow function, which makes what the mode needs and no more; the choice between extraction modes, the
scores of page parts, tokens and savings are native expressions over its result. Markdown is made from the chosen HTML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import choose_extraction, element_score, estimate_tokens, savings_percent, title_fallback
from ..operators.page import ALL, ARTICLE, Filters, citations_of, markdown_of, parse

MODES = ("readability", "raw", "pruning", "auto")
FORMATS = ("markdown", "markdown_citations", "html", "text")


@dataclass(frozen=True)
class Options:
    """What one cleaning job does; unknown modes are readability and unknown formats Markdown."""

    mode: str = "readability"
    output_format: str = "markdown"
    only_main_content: bool | None = None
    filters: Filters = field(default_factory=Filters)

    @property
    def extract_mode(self) -> str:
        if self.only_main_content is False:
            return "raw"
        return self.mode if self.mode in MODES else "readability"


#: What each mode needs of a page.
NEEDS = {"raw": frozenset(), "readability": frozenset([ARTICLE]), "pruning": ALL, "auto": ALL}


def pruned(parsed: Column) -> tuple[Column, Column]:
    """HTML and text of the parts of a page with a positive score, or of its whole body if none has one."""
    kept = F.filter(parsed["parts"], lambda p: element_score(p["tag"], p["class"], p["id"], p["text_len"], p["html_len"], p["link_len"]) > 0)
    some = F.size(kept) > 0
    html = F.when(some, F.array_join(F.transform(kept, lambda p: p["html"]), "\n")).otherwise(parsed["body_html"])
    text = F.when(some, F.array_join(F.transform(kept, lambda p: p["text"]), "\n")).otherwise(parsed["body_text"])
    return html, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(pages: DataFrame, options: Options | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` cleaned: its columns without the HTML, and ``content``, ``metadata``, ``links``, ``images``,
    ``og_metadata``, ``tokens``, ``error`` and ``success``. Null HTML is an empty page."""
    o = options or Options()
    mode = o.extract_mode
    others = [c for c in pages.columns if c not in (html, url)]
    raw = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(*others, F.col(url).alias("source_url"), estimate_tokens(raw).alias("original"), parse(raw, F.col(url), o.filters, NEEDS[mode]).alias("p"))
    p = F.col("p")
    raw_html, article = p["filtered"], p["article_html"]
    if mode == "raw":
        base = base.withColumns({"body": raw_html, "plain": raw_html, "meta_used": F.lit(False)})
    elif mode == "readability":
        base = base.withColumns({"body": article, "plain": p["article_text"], "meta_used": p["readable"]})
    else:
        html_of, text_of = pruned(p)
        base = base.withColumns({"pruned": html_of, "pruned_text": text_of})
        if mode == "pruning":
            base = base.withColumns({"body": F.col("pruned"), "plain": F.col("pruned_text"), "meta_used": p["readable"]})
        else:
            pick = choose_extraction(F.octet_length(F.trim(p["article_text"])), F.octet_length(F.trim(F.col("pruned_text"))))
            base = base.withColumn("pick", pick).withColumns(
                {
                    "body": F.when(F.col("pick") == "pruning", F.col("pruned")).otherwise(article),
                    "plain": F.when(F.col("pick") == "pruning", F.col("pruned_text")).otherwise(p["article_text"]),
                    "meta_used": p["readable"],
                }
            )
    if o.output_format == "html":
        content = F.col("body")
    elif o.output_format == "text":
        content = F.col("plain")
    else:
        content = markdown_of(F.col("body"), F.col("source_url"))
        if o.output_format == "markdown_citations":
            content = citations_of(content)
    base = base.withColumn("content", F.when(p["error"].isNull(), content))
    cleaned = estimate_tokens(F.col("content"))
    meta = p["meta"]

    def known(name: str) -> Column:
        return F.when(F.col("meta_used"), meta[name]).otherwise(F.lit(""))

    code = F.substring_index(p["error"], ": ", 1)
    return base.select(
        *others,
        p["error"].isNull().alias("success"),
        F.col("source_url"),
        F.col("content"),
        F.struct(
            title_fallback(known("title"), p["fetched_title"]).alias("title"),
            known("description").alias("description"),
            known("site_name").alias("site_name"),
            known("author").alias("author"),
            known("language").alias("language"),
            F.col("source_url").alias("source_url"),
        ).alias("metadata"),
        p["links"].alias("links"),
        p["images"].alias("images"),
        p["og"].alias("og_metadata"),
        F.struct(
            F.col("original").alias("original_estimate"), cleaned.alias("cleaned_estimate"), savings_percent(F.col("original"), cleaned).alias("savings_percent")
        ).alias("tokens"),
        F.when(p["error"].isNotNull(), F.struct(code.alias("code"), p["error"].alias("message"))).alias("error"),
    )


def scored_parts(pages: DataFrame) -> DataFrame:
    """(page_id, position, tag, class, id, text_len, html_len, link_len, score, kept) of the parts of each page."""
    from ..operators.page import parts_of

    x = F.col("part")
    score = element_score(x["tag"], x["class"], x["id"], x["text_len"], x["html_len"], x["link_len"])
    rows = pages.select("page_id", F.posexplode(parts_of("html")).alias("position", "part"))
    return rows.select("page_id", "position", *[x[k].alias(k) for k in ("tag", "class", "id", "text_len", "html_len", "link_len")], score.alias("score")).withColumn("kept", F.col("score") > 0)
