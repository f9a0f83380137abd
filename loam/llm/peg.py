"""A small packrat parser: parsing expressions over a source text, memoised by rule and place.

An expression is a function ``(run, at) -> end`` that answers -1 where it doesn't match.
Terminals are compiled regular expressions, so a run of characters costs one step.
``capture`` keeps the source offsets of what its expression matched; ``rule`` gives an
expression a memo, which makes every place cost it at most one attempt.
"""

from __future__ import annotations

import re
from collections.abc import Callable


class Run:
    """One parse: the source, the memo and the captured offsets."""

    __slots__ = ("found", "memo", "src")

    def __init__(self, src: str):
        self.src, self.memo, self.found = src, {}, {}


Expression = Callable[[Run, int], int]


def term(pattern: str) -> Expression:
    match = re.compile(pattern).match

    def parse(run: Run, at: int) -> int:
        m = match(run.src, at)
        return m.end() if m else -1

    return parse


def seq(*parts: Expression | str) -> Expression:
    parts = tuple(term(p) if isinstance(p, str) else p for p in parts)

    def parse(run: Run, at: int) -> int:
        for p in parts:
            at = p(run, at)
            if at < 0:
                return -1
        return at

    return parse


def choice(*parts: Expression | str) -> Expression:
    parts = tuple(term(p) if isinstance(p, str) else p for p in parts)

    def parse(run: Run, at: int) -> int:
        for p in parts:
            end = p(run, at)
            if end >= 0:
                return end
        return -1

    return parse


def many(part: Expression | str) -> Expression:
    part = term(part) if isinstance(part, str) else part

    def parse(run: Run, at: int) -> int:
        while True:
            end = part(run, at)
            if end <= at:
                return at
            at = end

    return parse


def maybe(part: Expression | str) -> Expression:
    part = term(part) if isinstance(part, str) else part

    def parse(run: Run, at: int) -> int:
        end = part(run, at)
        return at if end < 0 else end

    return parse


def rule(name: str, part: Expression | None = None) -> Expression:
    """A named, memoised expression; without ``part`` a forward reference, to be set as ``.is_``."""

    def parse(run: Run, at: int) -> int:
        key = (name, at)
        end = run.memo.get(key)
        if end is None:
            end = run.memo[key] = parse.is_(run, at)
        return end

    parse.is_ = part
    return parse


def capture(name: str, part: Expression | str) -> Expression:
    part = term(part) if isinstance(part, str) else part

    def parse(run: Run, at: int) -> int:
        end = part(run, at)
        if end >= 0:
            run.found[name] = (at, end)
        return end

    return parse
