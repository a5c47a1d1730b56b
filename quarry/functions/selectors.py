"""CSS selectors over a page's tree: one walk down, in which each element knows how far each selector has come."""

from __future__ import annotations

import re
from collections.abc import Callable

_NAME = r"-?[A-Za-z_ -￿][\w -￿-]*"
_TOKEN = re.compile(
    rf"""(?P<any>\*)|(?P<tag>{_NAME})|\#(?P<id>[\w -￿-]+)|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w -￿-]+))\s*(?P<fold>[iI])?\s*)?\]
    |:not\((?P<not>[^()]*)\)|:nth-child\(\s*(?P<nth>\d+|odd|even)\s*\)|:(?P<pseudo>first-child|last-child|only-child|empty)""",
    re.X,
)
_GLUE = re.compile(r"\s*([>+~,])\s*|\s+")
Test = Callable[[object, int, int], bool]


class SelectorError(ValueError):
    pass


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    def has(n, at, of) -> bool:
        own = n.attrs.get(name)
        if own is None or op is None:
            return own is not None
        a, b = (own.lower(), value.lower()) if fold else (own, value)
        if op == "=":
            return a == b
        if op == "|=":
            return a == b or a.startswith(f"{b}-")
        if op == "~=":
            return b in a.split()
        return bool(b) and (a.startswith(b) if op == "^=" else a.endswith(b) if op == "$=" else b in a)

    return has


def _test(m: re.Match) -> Test:
    if m["any"]:
        return lambda n, at, of: True
    if m["tag"]:
        tag = m["tag"].lower()
        return lambda n, at, of: n.tag == tag
    if m["id"]:
        return _attribute("id", "=", m["id"], False)
    if m["cls"]:
        return _attribute("class", "~=", m["cls"], False)
    if m["attr"]:
        return _attribute(m["attr"].lower(), m["op"], next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), ""), bool(m["fold"]))
    if m["not"] is not None:
        inner = [_compound(s.strip()) for s in m["not"].split(",")]
        return lambda n, at, of: not any(all(t(n, at, of) for t in one) for one in inner)
    if m["nth"]:
        nth = m["nth"]
        return lambda n, at, of: at % 2 == (nth == "odd") if nth in ("odd", "even") else at == int(nth)
    return {"first-child": lambda n, at, of: at == 1, "last-child": lambda n, at, of: at == of, "only-child": lambda n, at, of: of == 1, "empty": lambda n, at, of: not n.children}[m["pseudo"]]


def _compound(text: str) -> list[Test]:
    at, out = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m["tag"] and out:
            raise SelectorError(text)
        out.append(_test(m))
        at = m.end()
    if not out:
        raise SelectorError(text)
    return out


def parse(selector: str) -> list[list[tuple[str, list[Test]]]]:
    """Chains of (how it stands to the part before, tests): ' ' below, '>' a child, '+' next, '~' later beside."""
    chains, chain, glue, at = [], [], " ", 0
    text = selector.strip()
    while True:
        end = at
        while end < len(text) and not _GLUE.match(text, end):
            m = _TOKEN.match(text, end)
            if not m:
                raise SelectorError(selector)
            end = m.end()
        chain.append((glue, _compound(text[at:end])))
        m = _GLUE.match(text, end)
        if m is None:
            return [*chains, chain]
        glue, at = m[1] or " ", m.end()
        if glue == ",":
            chains.append(chain)
            chain, glue = [], " "


def first(root, selector: str):
    """The first element, in the page's order, that a selector fits. For each element a set of bits says which parts of
    which chains it fits; ``above`` gathers those of its ancestors, ``beside`` of the elements before it."""
    parts, last = [], 0
    for chain in parse(selector):
        for i, (glue, tests) in enumerate(chain):
            parts.append((glue, tests, 1 << len(parts) - 1 if i else 0))
        last |= 1 << len(parts) - 1
    walk = [_Level(root, 0, 0)]
    while walk:
        level = walk[-1]
        n = next(level.rest, None)
        if n is None:
            walk.pop()
            continue
        level.at += 1
        sides = {" ": level.above, ">": level.parent, "+": level.before, "~": level.beside}
        fits = 0
        for bit, (glue, tests, needs) in enumerate(parts):
            if (not needs or needs & sides[glue]) and all(t(n, level.at, level.of) for t in tests):
                fits |= 1 << bit
        if fits & last:
            return n
        level.before, level.beside = fits, level.beside | fits
        walk.append(_Level(n, fits, level.above | fits))
    return None


class _Level:
    """Where a walk is among the children of an element: its own bits, those of it and its ancestors, of the child before
    and of all children before."""

    def __init__(self, n, parent: int, above: int):
        own = n.elements()
        self.rest, self.of, self.at = iter(own), len(own), 0
        self.parent, self.above, self.before, self.beside = parent, above, 0, 0
