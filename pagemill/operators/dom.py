"""A small HTML tree builder after the public WHATWG parsing rules, and its serializer.

One parse gives one tree; every HTML operator works on that tree. The builder never raises: unclosed elements end
with the document, stray end tags are ignored (``</p>`` makes an empty paragraph), blocks close an open paragraph,
items and cells close their siblings, and open formatting elements are opened again in the next block.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

# Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("title textarea".split())
HEAD = frozenset("title meta link style script base noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_ENDS = frozenset("html table td th caption marquee object template applet".split())
SPECIAL = CLOSES_P | HEAD | frozenset("body html li dt dd td th tr tbody thead tfoot caption head button select option object".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = {"tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])} | {k: frozenset("tbody thead tfoot tr td th caption colgroup".split()) for k in ("tbody", "thead", "tfoot")}

TEXT = "#text"
_OPEN = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|[!?]([^>]*)(?:>|\Z)|/([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|([A-Za-z][^\s/>]*))", re.S)
_ATTR = re.compile(r"[\s/]*(?:(>)|([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?|\Z)", re.S)


class Node:
    """An element, or a text node (tag ``#text``) with ``data``."""

    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.children, self.parent, self.data = tag, attrs or {}, [], None, data

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag != TEXT)

    def clone(self) -> Node:
        """A copy of this node and all below it; attributes are shared."""
        out = Node(self.tag, self.attrs, self.data)
        stack = [(self, out)]
        while stack:
            old, new = stack.pop()
            for c in old.children:
                d = Node(c.tag, c.attrs, c.data)
                d.parent = new
                new.children.append(d)
                if c.children:
                    stack.append((c, d))
        return out

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if n.tag == TEXT)

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.elements() if n.tag == tag), None)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None


def tokens(source: str) -> Iterator[tuple]:
    """("text", data), ("start", name, attributes, self-closing) and ("end", name) of ``source``, in order;
    names in lower case, comments and declarations left out, no repair of the tree."""
    at, n = 0, len(source)
    while at < n:
        m = _OPEN.search(source, at)
        if m is None:
            yield "text", _html.unescape(source[at:])
            return
        if m.start() > at:
            yield "text", _html.unescape(source[at : m.start()])
        at = m.end()
        if m.group(3):
            yield "end", m.group(3).lower()
        elif m.group(4):
            name, attrs, closed, done = m.group(4).lower(), {}, False, False
            while at < n:
                a = _ATTR.match(source, at)
                if a is None:
                    at += 1
                    continue
                if a.group(1) or a.group(2) is None:
                    closed = source[max(at - 1, a.end() - 2) : a.end()] == "/>"
                    done = bool(a.group(1))
                    at = a.end()
                    break
                at = a.end()
                value = next((g for g in a.group(3, 4, 5) if g is not None), "")
                attrs.setdefault(a.group(2).lower(), _html.unescape(value) if "&" in value else value)
            if not done:
                return  # the input ends inside the tag
            yield "start", name, attrs, closed
            if name in RAW or name in RCDATA:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "text", source[at:stop] if name in RAW else _html.unescape(source[at:stop])
                at = stop


class _Builder:
    def __init__(self) -> None:
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.html.append(self.head)
        self.html.append(self.body)
        self.stack = [self.html, self.head]
        self.active: list[Node] = []
        self.in_body = False

    def enter_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            self.stack = [self.html, self.body]

    def open(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.stack[-1].append(node)
        if tag not in VOID:
            self.stack.append(node)
        return node

    def in_scope(self, tags: frozenset[str] | set[str], extra: tuple[str, ...] = ()) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in SCOPE_ENDS or node.tag in extra:
                return False
        return False

    def pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def close_p(self) -> None:
        if self.in_scope({"p"}, ("button",)):
            self.pop_to({"p"})

    def reopen(self) -> None:
        """Open again the formatting elements that a closed block cut off."""
        on = set(map(id, self.stack))
        for k, node in enumerate(self.active):
            if id(node) not in on:
                self.active[k] = self.open(node.tag, dict(node.attrs))

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.enter_body()
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            return
        if not self.in_body:
            if tag in HEAD:
                self.open(tag, attrs)
                return
            self.enter_body()
        if tag in CLOSES_P:
            self.close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
        elif tag == "li":
            if self.in_scope({"li"}, ("ul", "ol")):
                self.pop_to({"li"})
            self.close_p()
        elif tag in ("dd", "dt"):
            if self.in_scope({"dd", "dt"}, ("dl",)):
                self.pop_to({"dd", "dt"})
            self.close_p()
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
        elif tag in TABLE_PARTS:
            while len(self.stack) > 2 and self.stack[-1].tag in TABLE_PARTS[tag] | FORMATTING | IMPLIED:
                self.stack.pop()
            top = self.stack[-1].tag
            if tag == "tr" and top == "table":
                self.open("tbody", {})
            elif tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
                if top == "table":
                    self.open("tbody", {})
                self.open("tr", {})
            if self.stack[-1].tag not in ("table", "tbody", "thead", "tfoot", "tr"):
                return  # a table part outside any table is ignored
        if tag == "a" and any(n.tag == "a" for n in self.active):
            self.end("a")
            self.active = [n for n in self.active if n.tag != "a"]
        if tag not in CLOSES_P and tag not in TABLE_PARTS and tag not in ("li", "dd", "dt"):
            self.reopen()
        node = self.open(tag, attrs)
        if tag in FORMATTING:
            self.active.append(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            if tag == "head":
                self.stack = self.stack[:2]
            return
        if not self.in_body and tag not in HEAD:
            self.enter_body()
        if tag == "p":
            if not self.in_scope({"p"}, ("button",)):
                self.open("p", {})
            self.pop_to({"p"})
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            for k in range(len(self.stack) - 1, 1, -1):
                if self.stack[k].tag == tag:
                    node = self.stack[k]
                    self.active = [n for n in self.active if n is not node]
                    if not any(n.tag in SPECIAL for n in self.stack[k + 1 :]):
                        del self.stack[k:]
                    return
                if self.stack[k].tag in SCOPE_ENDS:
                    return
        elif tag in ("li",):
            if self.in_scope({"li"}, ("ul", "ol")):
                self.pop_to({"li"})
        elif tag == "br":
            self.reopen()
            self.open("br", {})
        else:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag and k > 1 - (not self.in_body):
                    del self.stack[k:]
                    return
                if self.stack[k].tag in SPECIAL and tag not in SPECIAL or self.stack[k].tag in ("td", "th") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
                    return

    def text(self, data: str) -> None:
        if self.stack[-1].tag in RAW or self.stack[-1].tag in RCDATA:
            self.stack[-1].append(Node(TEXT, data=data))
            return
        if not self.in_body:
            if not data.strip():
                return
            self.enter_body()
        self.reopen() if data.strip() else None
        top = self.stack[-1]
        if top.children and top.children[-1].tag == TEXT:
            top.children[-1].data += data
        else:
            top.append(Node(TEXT, data=data))


def parse(source: str | None) -> Node:
    """The tree of ``source``: always an ``html`` element with ``head`` and ``body``."""
    b = _Builder()
    for token in tokens((source or "").replace("\r\n", "\n").replace("\0", "")):
        if token[0] == "text":
            b.text(token[1])
        elif token[0] == "start":
            b.start(token[1], token[2], token[3])
        else:
            b.end(token[1])
    return b.html


def body(root: Node) -> Node:
    return root.children[-1] if root.tag == "html" else root


_ESCAPES = {"&": "&amp;", "'": "&#39;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "\r": "&#13;"}
_ESCAPE = re.compile("[&'<>\"\r]")


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m.group()], s)


def serialize(node: Node, inner: bool = False) -> str:
    """Outer (or inner) HTML; attributes in source order, raw text unescaped."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.children)) if inner else [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == TEXT:
            out.append(x.data if x.parent is not None and x.parent.tag in RAW else escape(x.data))
        else:
            out.append(f"<{x.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()) + (">" if x.tag not in VOID else "/>"))
            if x.tag not in VOID:
                stack.append(f"</{x.tag}>")
                stack.extend(reversed(x.children))
    return "".join(out)
