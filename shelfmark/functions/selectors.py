"""Selectors compiled to tests of one element, read from right to left.

Supported: tags and ``*``, ``#id``, ``.class``, ``[a]`` and ``[a=v]`` with ``~= |= ^= $=
*=``, ``:first-child``, ``:last-child``, ``:only-child``, ``:empty``, ``:nth-child(an+b,
odd, even)``, ``:not(...)``, the combinators space, ``>``, ``+`` and ``~``, and lists by
commas.  Anything else is a SelectorError.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from .html import Element

Test = Callable[[Element], bool]


class SelectorError(ValueError):
    """A selector or locator outside the supported forms."""


_NAME = r"-?[A-Za-z_\u0080-￿][\w\u0080-￿-]*"
_TOKEN = re.compile(
    rf"""(?P<comma>\s*,\s*)|(?P<join>\s*[>+~]\s*|\s+)|(?P<tag>\*|{_NAME})|\#(?P<id>[\w\u0080-￿-]+)|\.(?P<kind>{_NAME})
    |\[\s*(?P<attribute>[\w:.-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\s"'\]]+))\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?P<open>\()?""",
    re.VERBOSE,
)
_HOW: dict[str, Callable[[str, str], bool]] = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: bool(want) and want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
}
_NTH = re.compile(r"\s*(?:(?P<odd>odd)|(?P<even>even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*")


def _family(e: Element) -> list[Element]:
    return e.parent.elements if e.parent is not None else [e]


def _nth(text: str) -> Test:
    m = _NTH.fullmatch(text.lower())
    if not m:
        raise SelectorError(f"not a place among children: {text!r}")
    if m["only"]:
        step, start = 0, int(m["only"])
    elif m["odd"] or m["even"]:
        step, start = 2, 1 if m["odd"] else 0
    else:
        step, start = int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"]), int((m["sign"] or "+") + (m["b"] or "0"))
    return lambda e: (e.place + 1 - start) % step == 0 and (e.place + 1 - start) // step >= 0 if step else e.place + 1 == start


_PLAIN: dict[str, Test] = {
    "first-child": lambda e: e.place == 0,
    "last-child": lambda e: e.place == len(_family(e)) - 1,
    "only-child": lambda e: len(_family(e)) == 1,
    "empty": lambda e: not any(isinstance(c, Element) or c for c in e.children),
}


def _argument(text: str, at: int) -> int:
    """Where the bracket that was opened before ``at`` closes."""
    depth = 1
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            return i
    raise SelectorError(f"an open bracket in {text!r}")


def _reach(join: str, left: Test) -> Test:
    """Whether an element's neighbour by ``join`` passes ``left``."""
    if join == ">":
        return lambda e: e.parent is not None and bool(e.parent.tag) and left(e.parent)
    if join == "+":
        return lambda e: e.place > 0 and left(_family(e)[e.place - 1])
    if join == "~":
        return lambda e: any(left(x) for x in _family(e)[: e.place])

    def above(e: Element) -> bool:
        up = e.parent
        while up is not None and up.tag:
            if left(up):
                return True
            up = up.parent
        return False

    return above


class _Reader:
    """Reads one selector list; what has been read of the selector in hand is a test."""

    def __init__(self, text: str):
        self.text, self.done = text, []
        self.left: Test | None = None
        self.tests: list[Test] = []
        self.tag_allowed = True

    def fail(self) -> SelectorError:
        return SelectorError(f"unsupported selector: {self.text!r}")

    def simple(self, test: Test) -> None:
        self.tests.append(test)
        self.tag_allowed = False

    def whole(self) -> Test:
        """The test of the compound just read, with what must be to its left."""
        if not self.tests:
            raise self.fail()
        tests, left = tuple(self.tests), self.left
        self.tests, self.left, self.tag_allowed = [], None, True
        return lambda e: all(t(e) for t in tests) and (left is None or left(e))

    def read(self) -> Test:
        text, at = self.text.strip(), 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise self.fail()
            at = m.end()
            if m["comma"]:
                self.done.append(self.whole())
            elif m["join"]:
                self.left = _reach(m["join"].strip(), self.whole())
            elif m["tag"]:
                if not self.tag_allowed:
                    raise self.fail()
                self.simple(lambda e, t=m["tag"].lower(): t in ("*", e.tag))
            elif m["id"]:
                self.simple(lambda e, n=m["id"]: e.attributes.get("id") == n)
            elif m["kind"]:
                self.simple(lambda e, k=m["kind"]: k in e.attributes.get("class", "").split())
            elif m["attribute"]:
                name, how = m["attribute"].lower(), m["how"]
                want = next((m[g] for g in ("double", "single", "bare") if m[g] is not None), "")
                self.simple((lambda e, n=name, f=_HOW[how], w=want: n in e.attributes and f(e.attributes[n], w)) if how else (lambda e, n=name: n in e.attributes))
            else:
                at = self.pseudo(m, text, at)
        self.done.append(self.whole())
        tests = tuple(self.done)
        return lambda e: any(t(e) for t in tests)

    def pseudo(self, m: re.Match, text: str, at: int) -> int:
        if not m["open"]:
            if m["pseudo"] not in _PLAIN:
                raise self.fail()
            self.simple(_PLAIN[m["pseudo"]])
            return at
        end = _argument(text, at)
        inside = text[at:end]
        if m["pseudo"] == "nth-child":
            self.simple(_nth(inside))
        elif m["pseudo"] == "not":
            self.simple(lambda e, t=_Reader(inside).read(): not t(e))
        else:
            raise self.fail()
        return end + 1


@lru_cache(256)
def compiled(selector: str) -> Test:
    """The test that a selector makes."""
    return _Reader(selector).read()


def select(root: Element, selector: str) -> Iterator[Element]:
    """Elements that match, in document order."""
    test = compiled(selector)
    return (e for e in root.walk() if test(e))
