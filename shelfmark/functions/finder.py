"""What locators find on one page: the page is parsed and its assignments are read once for all of them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

from . import html, selectors
from .selectors import SelectorError

#: Every assignment to a member of ``window``.
_ASSIGNMENT = re.compile(r"\bwindow\.(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?=[\"\[{\d\-tfn])", re.ASCII)
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*", re.ASCII)
_JSON = json.JSONDecoder()


@lru_cache(256)
def steps(path: str) -> tuple[str, ...]:
    """The steps of a dotted path."""
    return tuple(x for x in path.split(".") if x)


def members(value: object, step: str) -> list:
    """What a step leads to: all members for ``*``, else the one of that name or index."""
    match value:
        case dict():
            return [*value.values()] if step == "*" else [value[step]] if step in value else []
        case list():
            return value if step == "*" else value[int(step) :][:1] if step.isdecimal() else []
    return []


def reached(value: object, way: tuple[str, ...]) -> Iterator:
    """Values at the end of a way."""
    if not way:
        yield value
        return
    for inner in members(value, way[0]):
        yield from reached(inner, way[1:])


class Page:
    """One page, read as far as locators ask for."""

    def __init__(self, body: str):
        self.body = body
        self._values: dict[str, object] = {}

    @cached_property
    def tree(self) -> html.Element:
        return html.parse(self.body)

    @cached_property
    def assigned(self) -> dict[str, int]:
        """Where the value of each variable starts, at its first assignment."""
        found: dict[str, int] = {}
        for m in _ASSIGNMENT.finditer(self.body):
            found.setdefault(m["name"], m.end())
        return found

    def variable(self, name: str) -> object:
        """The JSON value of a variable, unwrapped once if it is a text that holds JSON; None if there is none."""
        if name not in self._values:
            value = None
            if name in self.assigned:
                value = _read(_JSON.raw_decode, self.body, self.assigned[name], default=(None, 0))[0]
                if isinstance(value, str):
                    value = _read(json.loads, value, default=value)
            self._values[name] = value
        return self._values[name]

    def raw(self, kind: str, expression: str, attribute: str | None, path: str | None) -> Iterator:
        """Values that a locator reaches, as they are."""
        if kind == "js_variable":
            if not _IDENTIFIER.fullmatch(expression):
                raise SelectorError(f"not an identifier: {expression!r}")
            return reached(self.variable(expression), steps(path or ""))
        if kind == "css_text":
            return (e.text() for e in selectors.select(self.tree, expression))
        if kind == "css_attribute" and attribute:
            return (e.attributes.get(attribute) for e in selectors.select(self.tree, expression))
        raise SelectorError("an attribute name is needed" if kind == "css_attribute" else f"unknown kind: {kind!r}")

    def find(self, kind: str, expression: str, attribute: str | None = None, path: str | None = None) -> list[str]:
        """Distinct texts that a locator finds, in document order."""
        found: dict[str, None] = {}
        for value in self.raw(kind, expression, attribute, path):
            if value is not None and not isinstance(value, (dict, list)):
                found[str(value).strip()] = None
        found.pop("", None)
        return list(found)


def _read(decode, *args, default):
    try:
        return decode(*args)
    except ValueError:
        return default
