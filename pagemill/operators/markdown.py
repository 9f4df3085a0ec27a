"""HTML trees as Markdown, and citation-style Markdown."""

from __future__ import annotations

import re

from .dom import TEXT, Node
from .urls import resolve

#: Elements that leave nothing in Markdown.
DROPPED = frozenset("script style iframe noscript head meta link input textarea template title".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table ul summary tr td th tbody thead tfoot caption".split())
_SPACE = re.compile(r"[ \t\r\n\f]+")
_LEADS = re.compile(r"^(\s*)([#>+\-]|\d+[.)])(?=\s)")


class _Writer:
    def __init__(self, base: str):
        self.base = base

    def inline(self, node: Node) -> str:
        return "".join(self.one(c) for c in node.children)

    def one(self, n: Node) -> str:
        if n.tag == TEXT:
            return re.sub(r"([\\`*_\[\]])", r"\\\1", _SPACE.sub(" ", n.data))
        if n.tag in DROPPED:
            return ""
        if n.tag == "br":
            return "  \n"
        if n.tag == "img":
            src = n.attrs.get("src", "").strip()
            return f"![{_SPACE.sub(' ', n.attrs.get('alt', '')).strip()}]({resolve(src, self.base) or src})" if src else ""
        if n.tag == "code" or n.tag in ("kbd", "samp", "tt"):
            text = n.text()
            fence = "``" if "`" in text else "`"
            return f"{fence}{text}{fence}" if text.strip() else text
        inner = self.inline(n)
        if n.tag == "a":
            href = n.attrs.get("href", "").strip()
            label = inner.strip()
            if not href or not label:
                return inner
            title = n.attrs.get("title", "").strip()
            target = resolve(href, self.base) or href
            return f"[{label}]({target}" + (f' "{title}"' if title else "") + ")"
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}.get(n.tag)
        if mark and (core := inner.strip()):
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            return f"{lead}{mark}{core}{mark}{tail}"
        return inner

    def blocks(self, node: Node) -> list[str]:
        """Markdown blocks of the children of ``node``."""
        out: list[str] = []
        run: list[Node] = []

        def flush() -> None:
            if run:
                text = "".join(self.one(x) for x in run)
                text = "\n".join(x.strip() if k else x.lstrip() for k, x in enumerate(text.split("\n"))).strip()
                text = re.sub(r" {3,}\n", "  \n", text)
                if text:
                    out.append(_LEADS.sub(r"\1\\\2", text))
                run.clear()

        for c in node.children:
            if c.tag in DROPPED:
                continue
            if c.tag in BLOCKS or c.tag not in (TEXT,) and any(x.tag in BLOCKS for x in c.elements() if x is not c):
                flush()
                out += self.block(c)
            else:
                run.append(c)
        flush()
        return out

    def block(self, n: Node) -> list[str]:
        tag = n.tag
        if tag[0] == "h" and tag[1:].isdigit():
            text = _SPACE.sub(" ", self.inline(n)).strip()
            return [f"{'#' * int(tag[1])} {text}"] if text else []
        if tag == "hr":
            return ["* * *"]
        if tag == "pre":
            code = next((c for c in n.children if c.tag == "code"), n)
            language = next((x[9:] for x in code.attrs.get("class", "").split() if x.startswith("language-")), "")
            text = n.text().strip("\n")
            fence = "````" if "```" in text else "```"
            return [f"{fence}{language}\n{text}\n{fence}"]
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(n))
            return ["\n".join("> " + x if x else ">" for x in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol"):
            return self.items(n)
        if tag == "table":
            return self.table(n)
        return self.blocks(n)

    def items(self, n: Node) -> list[str]:
        lines = []
        start = n.attrs.get("start", "1")
        number = int(start) if start.lstrip("-").isdigit() else 1
        for c in n.children:
            if c.tag == TEXT and not c.data.strip() or c.tag in DROPPED:
                continue
            mark = f"{number}. " if n.tag == "ol" else "- "
            parts = self.blocks(c) if c.tag == "li" else self.blocks(_wrap(c))
            if not parts:
                continue
            nested = [p for p in parts[1:]]
            text = parts[0] + "".join(("\n" if re.match(r"(?:- |\d+\. )", p) else "\n\n") + p for p in nested)
            lines.append(mark + text.replace("\n", "\n" + " " * len(mark)).replace("\n" + " " * len(mark) + "\n", "\n\n"))
            number += 1
        return ["\n".join(lines)] if lines else []

    def table(self, n: Node) -> list[str]:
        rows = [[_SPACE.sub(" ", " ".join(self.blocks(c))).replace("|", r"\|").strip() for c in r.children if c.tag in ("td", "th")] for r in n.elements() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return self.blocks(_wrap(*[c for c in n.children if c.tag == "caption"]))
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        head = next((r for r in n.elements() if r.tag == "tr"), None)
        if head is not None and not any(c.tag == "th" for c in head.children):
            rows.insert(0, [""] * width)
        out = ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * width, *("| " + " | ".join(r) + " |" for r in rows[1:])]
        return ["\n".join(out)]


def _wrap(*nodes: Node) -> Node:
    box = Node("div")
    box.children = list(nodes)
    return box


def to_markdown(root: Node, base: str = "") -> str:
    """A tree as Markdown; relative links become absolute by ``base``."""
    return "\n\n".join(_Writer(base).blocks(root)).strip()


_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")


def with_citations(markdown: str) -> str:
    """Links as ``[text][n]`` with a numbered list of their targets at the end; a target keeps its first number.
    Images are links too; a text without links comes back as it is."""
    numbers: dict[str, int] = {}

    def mark(m: re.Match) -> str:
        return f"[{m.group(1)}][{numbers.setdefault(m.group(2), len(numbers) + 1)}]"

    body = _LINK.sub(mark, markdown)
    if not numbers:
        return markdown
    return body + "\n\n---\n" + "\n".join(f"[{n}]: {url}" for url, n in numbers.items())
