"""CSS selectors over the tree of :mod:`dom`: tags, ids, classes, attributes, the four combinators, groups, and
``:not``, ``:first-child``, ``:last-child``, ``:only-child``, ``:nth-child``, ``:empty``, ``:contains``, ``:has``."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .dom import TEXT, Node

Test = Callable[[Node], bool]
_NAME = re.compile(r"-?(?:[_a-zA-Z\u0080-\U0010ffff]|\\.)(?:[\w\-\u0080-\U0010ffff]|\\.)*")
_ATTRIBUTE = re.compile(r"\[\s*([\w\-:]+)\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*([iI])?\s*)?\]")
_NTH = re.compile(r"^\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


class SelectorError(ValueError):
    """The selector cannot be read."""


def siblings(node: Node) -> list[Node]:
    return [c for c in node.parent.children if c.tag != TEXT] if node.parent is not None else [node]


class _Reader:
    def __init__(self, source: str):
        self.s, self.at = source, 0

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1
        return self.at > start

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def name(self) -> str:
        m = _NAME.match(self.s, self.at)
        if m is None:
            raise SelectorError(f"a name is expected at {self.at} of {self.s!r}")
        self.at = m.end()
        return re.sub(r"\\(.)", r"\1", m.group())

    def group(self) -> Test:
        tests = [self.chain()]
        while self.peek() == ",":
            self.at += 1
            tests.append(self.chain())
        return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)

    def chain(self) -> Test:
        self.space()
        test = self.compound()
        while True:
            gap = self.space()
            c = self.peek()
            if c and c in ">+~":
                self.at += 1
                self.space()
                test = _combine(c, test, self.compound())
            elif gap and c and c not in ",)":
                test = _combine(" ", test, self.compound())
            else:
                return test

    def compound(self) -> Test:
        tests: list[Test] = []
        if self.peek() == "*":
            self.at += 1
            tests.append(lambda n: True)
        elif _NAME.match(self.s, self.at):
            tag = self.name().lower()
            tests.append(lambda n: n.tag == tag)
        while True:
            c = self.peek()
            if c == "#":
                self.at += 1
                tests.append(lambda n, v=self.name(): n.attrs.get("id") == v)
            elif c == ".":
                self.at += 1
                tests.append(lambda n, v=self.name(): v in n.attrs.get("class", "").split())
            elif c == "[":
                tests.append(self.attribute())
            elif c == ":":
                tests.append(self.pseudo())
            else:
                break
        if not tests:
            raise SelectorError(f"nothing to select at {self.at} of {self.s!r}")
        return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)

    def attribute(self) -> Test:
        m = _ATTRIBUTE.match(self.s, self.at)
        if m is None:
            raise SelectorError(f"an attribute test is expected at {self.at} of {self.s!r}")
        self.at = m.end()
        key, op = m.group(1).lower(), m.group(2)
        want = next((g for g in m.group(3, 4, 5) if g is not None), "")
        fold = str.lower if m.group(6) else str
        want = fold(want)
        checks = {
            None: lambda v: True,
            "=": lambda v: v == want,
            "~=": lambda v: bool(want) and want in v.split(),
            "|=": lambda v: v == want or v.startswith(want + "-"),
            "^=": lambda v: bool(want) and v.startswith(want),
            "$=": lambda v: bool(want) and v.endswith(want),
            "*=": lambda v: bool(want) and want in v,
        }
        if op == "!=":
            return lambda n: fold(n.attrs.get(key, "")) != want or key not in n.attrs
        check = checks[op]
        return lambda n: key in n.attrs and check(fold(n.attrs[key]))

    def argument(self) -> str:
        depth, start = 1, self.at + 1
        for k in range(start, len(self.s)):
            depth += (self.s[k] == "(") - (self.s[k] == ")")
            if not depth:
                self.at = k + 1
                return self.s[start:k]
        raise SelectorError(f"an open bracket in {self.s!r}")

    def pseudo(self) -> Test:
        self.at += 1
        name = self.name().lower()
        arg = self.argument() if self.peek() == "(" else None
        if arg is None:
            plain = {
                "first-child": lambda n: siblings(n)[0] is n,
                "last-child": lambda n: siblings(n)[-1] is n,
                "only-child": lambda n: len(siblings(n)) == 1,
                "empty": lambda n: not n.children,
                "root": lambda n: n.parent is None,
            }
            if name in plain:
                return plain[name]
        elif name == "not":
            inner = compile_selector(arg)
            return lambda n: not inner(n)
        elif name == "has":
            inner = compile_selector(arg)
            return lambda n: any(x is not n and inner(x) for x in n.elements())
        elif name == "contains":
            want = arg.strip().strip("\"'")
            return lambda n: want in n.text()
        elif name == "nth-child":
            return _nth(arg)
        raise SelectorError(f"unknown pseudo-class :{name}")


def _nth(arg: str) -> Test:
    m = _NTH.match(arg)
    if m is None:
        raise SelectorError(f"bad nth-child: {arg!r}")
    if m.group(1):
        a, b = 2, int(m.group(1).lower() == "odd")
    elif m.group(5):
        a, b = 0, int(m.group(5))
    else:
        a = int({"": "1", "+": "1", "-": "-1"}.get(m.group(2), m.group(2)))
        b = int((m.group(3) or "+") + (m.group(4) or "0"))

    def test(n: Node) -> bool:
        k = next(i for i, s in enumerate(siblings(n), 1) if s is n)
        return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0

    return test


def _combine(how: str, left: Test, right: Test) -> Test:
    def ancestors(n: Node):
        n = n.parent
        while n is not None:
            yield n
            n = n.parent

    def before(n: Node) -> list[Node]:
        s = siblings(n)
        return s[: next(i for i, x in enumerate(s) if x is n)]

    if how == " ":
        return lambda n: right(n) and any(left(a) for a in ancestors(n))
    if how == ">":
        return lambda n: right(n) and n.parent is not None and left(n.parent)
    if how == "+":
        return lambda n: right(n) and bool(b := before(n)) and left(b[-1])
    return lambda n: right(n) and any(left(b) for b in before(n))


@lru_cache(maxsize=256)
def compile_selector(source: str) -> Test:
    reader = _Reader(source)
    test = reader.group()
    reader.space()
    if reader.at < len(reader.s):
        raise SelectorError(f"{reader.s[reader.at:]!r} is left over")
    return test


def select(root: Node, source: str) -> list[Node]:
    """Elements below ``root`` that match, in document order; nested matches each count."""
    test = compile_selector(source)
    return [n for n in root.elements() if test(n)]
