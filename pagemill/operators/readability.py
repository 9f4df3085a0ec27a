"""Main content of a page by the published readability heuristic: paragraphs vote for their parents, link-heavy and
unlikely parts lose, the best candidate and its good siblings are kept and cleaned."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import dom
from .dom import TEXT, Node

# Words of class and id names, as published with the heuristic (fixed values).
UNLIKELY = re.compile(
    r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote",
    re.I,
)
MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
POSITIVE = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(
    r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|foot|footer|footnote|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|tool|widget",
    re.I,
)
BYLINE = re.compile(r"byline|author|dateline|writtenby|p-author", re.I)
DROP = frozenset("script style noscript iframe template".split())
#: Elements that an article never keeps.
NEVER = frozenset("object embed form button input select textarea footer aside link".split())
VOTES = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
#: Byte length below which the content counts as not found.
LEAST = 50


@dataclass
class Article:
    content: str = ""
    text: str = ""
    title: str = ""
    byline: str = ""
    excerpt: str = ""
    site_name: str = ""
    language: str = ""
    found: bool = False


def _names(n: Node) -> str:
    return f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"


def _class_weight(n: Node) -> int:
    out = 0
    for key in ("class", "id"):
        v = n.attrs.get(key, "")
        if v:
            out += 25 * bool(POSITIVE.search(v)) - 25 * bool(NEGATIVE.search(v))
    return out


def _text_length(n: Node) -> int:
    return len(n.text().strip())


def link_density(n: Node) -> float:
    total = _text_length(n)
    return sum(_text_length(a) for a in n.elements() if a.tag == "a") / total if total else 0.0


def metadata(root: Node) -> Article:
    """Title, byline, excerpt, site name and language, from the head and common marks."""
    out = Article(language=root.attrs.get("lang", "").strip())
    props: dict[str, str] = {}
    for m in root.elements():
        if m.tag == "meta":
            key = (m.attrs.get("property") or m.attrs.get("name") or "").strip().lower()
            value = m.attrs.get("content", "").strip()
            if key and value:
                props.setdefault(key, value)
    title = root.find("title")
    out.title = props.get("og:title") or props.get("twitter:title") or (re.sub(r"\s+", " ", title.text()).strip() if title else "")
    out.excerpt = props.get("og:description") or props.get("description") or props.get("twitter:description") or ""
    out.site_name = props.get("og:site_name") or props.get("application-name") or ""
    out.byline = props.get("author") or props.get("article:author") or ""
    if not out.byline:
        for n in root.elements():
            if (n.attrs.get("rel") == "author" or BYLINE.search(_names(n))) and 0 < len(t := n.text().strip()) < 100:
                out.byline = re.sub(r"\s+", " ", t)
                break
    return out


def _candidates(body: Node, strict: bool) -> Node | None:
    drop = []
    for n in body.elements():
        if n is body:
            continue
        if n.tag in DROP or n.attrs.get("hidden") is not None or "display:none" in n.attrs.get("style", "").replace(" ", ""):
            drop.append(n)
        elif strict and n.tag not in ("a", "article", "body", "main") and UNLIKELY.search(names := _names(n)) and not MAYBE.search(names):
            drop.append(n)
    for n in drop:
        n.remove()
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}

    def vote(n: Node | None, amount: float) -> None:
        if n is None or n.tag in (TEXT, "html"):
            return
        if id(n) not in scores:
            nodes[id(n)] = n
            scores[id(n)] = VOTES.get(n.tag, 0) + (_class_weight(n) if strict else 0)
        scores[id(n)] += amount

    for n in body.elements():
        if n.tag not in ("p", "td", "pre", "section", "h2", "h3", "h4", "h5", "h6") and not (n.tag == "div" and not any(c.tag in dom.CLOSES_P for c in n.children)):
            continue
        text = n.text().strip()
        if len(text) < 25:
            continue
        amount = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        parent, level = n.parent, 0
        while parent is not None and level < 5:
            vote(parent, amount / (1 if level == 0 else 2 if level == 1 else level * 3))
            parent, level = parent.parent, level + 1
    best, top = None, 0.0
    for k, n in nodes.items():
        scores[k] *= 1 - link_density(n)
        if best is None or scores[k] > top:
            best, top = n, scores[k]
    if best is None:
        return None
    # siblings of the best candidate that are good themselves
    box = Node("div", {"id": "readability-page-1", "class": "page"})
    if best.tag == "body" or best.parent is None:
        box.children = [c for c in best.children]
        return box
    limit = max(10.0, top * 0.2)
    kept = []
    for s in best.parent.children:
        if s is best:
            kept.append(s)
            continue
        if s.tag == TEXT:
            continue
        same = bool(best.attrs.get("class")) and s.attrs.get("class") == best.attrs.get("class")
        if scores.get(id(s), -1e9) + (top * 0.2 if same else 0) >= limit:
            kept.append(s)
        elif s.tag == "p":
            text, density = s.text().strip(), link_density(s)
            if len(text) > 80 and density < 0.25 or 0 < len(text) <= 80 and density == 0 and re.search(r"\.( |$)", text):
                kept.append(s)
    box.children = kept
    return box


def _clean(box: Node) -> None:
    for n in list(box.elements()):
        if n is box or n.parent is None:
            continue
        if n.tag in NEVER or n.tag in ("h1", "h2") and _class_weight(n) < 0:
            n.remove()
        elif n.tag in ("ul", "ol", "div", "table", "fieldset"):
            if _class_weight(n) < 0:
                n.remove()
                continue
            text = n.text()
            if text.count(",") >= 10:
                continue
            tags = [x.tag for x in n.elements()]
            paragraphs, images, items, inputs = tags.count("p"), tags.count("img"), tags.count("li") - 100, tags.count("input")
            density, length = link_density(n), len(text.strip())
            is_list = n.tag in ("ul", "ol")
            if (
                images > 1 and paragraphs / images < 0.5
                or not is_list and items > paragraphs
                or inputs > paragraphs // 3
                or not is_list and length < 25 and images == 0 and not paragraphs
                or density > 0.5 and length > 0
            ):
                n.remove()


def extract(root: Node, raw: str) -> Article:
    """The article of a page; its content and text are the raw HTML, and all else is empty, where none is found."""
    out = metadata(root)
    for strict in (True, False):
        work = root.clone()
        box = _candidates(dom.body(work), strict)
        if box is None:
            continue
        for c in box.children:
            c.parent = box
        _clean(box)
        text = box.text()
        if len(text.strip().encode()) >= LEAST:
            out.content, out.text, out.found = dom.serialize(box), text, True
            if not out.excerpt:
                first = next((p.text().strip() for p in box.elements() if p.tag == "p" and p.text().strip()), "")
                out.excerpt = first
            return out
    return Article(content=raw, text=raw)
