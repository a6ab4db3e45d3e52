"""Boolean trigram queries that follow from a regular expression.

``trigram_query`` walks the parsed pattern. Every part of it is described by the
strings it may stand for, where these are few, and otherwise by how its matches
may begin and end and by a query that each match satisfies. Parts in a row are
joined at their ends, which gives the trigrams across them. Whatever is not
understood (large character classes, repeats from zero on, references, constructs
that Spark's expressions read in another way than this parser) stands for any
string, so a query may ask for too little but never for too much.

Queries speak of texts whose A-Z are lowered, so that they hold for rules that
ignore case as well.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser

from cohortwise.llm.common import ascii_lowered

#: Beyond so many strings a part is described by its ends; beyond so many characters a class stands for anything.
_STRINGS, _CHARACTERS = 64, 16

# read in another way by Spark, or not as plainly: nested and intersected classes, flags, white space and references
_UNLIKE = re.compile(r"\\[vQ]|\\[1-9]\d|\\b\{|\(\?[a-zA-Z]*[dLuUx]|&&|\[\^?\]?[^\]\\]*(?:\\.[^\]\\]*)*\[", re.DOTALL)


@dataclass(frozen=True)
class Query:
    """All ``trigrams``, and of each group of ``choices`` at least one; the empty query admits every text."""

    trigrams: frozenset[str] = frozenset()
    choices: frozenset[frozenset[Query]] = frozenset()

    def __bool__(self) -> bool:
        return bool(self.trigrams or self.choices)

    def __and__(self, other: Query) -> Query:
        return Query(self.trigrams | other.trigrams, self.choices | other.choices)

    def follows_from(self, other: Query) -> bool:
        return self.trigrams <= other.trigrams and self.choices <= other.choices

    def all_trigrams(self) -> set[str]:
        return set(self.trigrams).union(*(q.all_trigrams() for group in self.choices for q in group))


def any_of(queries: Iterable[Query]) -> Query:
    """At least one of the queries; those that another one follows from add nothing."""
    different = set(queries)
    least = frozenset(q for q in different if not any(p != q and p.follows_from(q) for p in different))
    if len(least) == 1:
        return next(iter(least))
    return Query(choices=frozenset([least]))


def _of_string(text: str) -> Query:
    return Query(frozenset(text[i : i + 3] for i in range(len(text) - 2)))


_ANYTHING = frozenset([""])


@dataclass(frozen=True)
class _Part:
    """What a part of a pattern stands for: ``strings`` where they are few, else begins, ends and a query."""

    strings: frozenset[str] | None = None
    begins: frozenset[str] = _ANYTHING
    ends: frozenset[str] = _ANYTHING
    query: Query = Query()

    def loose(self) -> _Part:
        if self.strings is None:
            return self
        return _Part(None, _few(s[:2] for s in self.strings), _few(s[-2:] for s in self.strings), any_of(_of_string(s) for s in self.strings))


def _few(strings: Iterable[str]) -> frozenset[str]:
    found = frozenset(strings)
    return found if len(found) <= _STRINGS else _ANYTHING


_ANY = _Part()
_EMPTY = _Part(_ANYTHING)


def _then(a: _Part, b: _Part) -> _Part:
    if a.strings is not None and b.strings is not None and len(a.strings) * len(b.strings) <= _STRINGS:
        return _Part(frozenset(x + y for x in a.strings for y in b.strings))
    left, right = a.loose(), b.loose()
    begins, ends = left.begins, right.ends
    if a.strings is not None:
        begins = _few((x + y)[:2] for x in a.strings for y in right.begins)
    if b.strings is not None:
        ends = _few((x + y)[-2:] for x in left.ends for y in b.strings)
    across = any_of(_of_string(x + y) for x in left.ends for y in right.begins)
    return _Part(None, begins, ends, left.query & right.query & across)


def _either(a: _Part, b: _Part) -> _Part:
    if a.strings is not None and b.strings is not None and len(a.strings | b.strings) <= _STRINGS:
        return _Part(a.strings | b.strings)
    a, b = a.loose(), b.loose()
    return _Part(None, _few(a.begins | b.begins), _few(a.ends | b.ends), any_of([a.query, b.query]))


def _class(items: list) -> _Part:
    characters = set()
    for kind, value in items:
        if kind is op.LITERAL:
            characters.add(ascii_lowered(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < 4 * _CHARACTERS:
            characters.update(ascii_lowered(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return _ANY
    return _Part(frozenset(characters)) if len(characters) <= _CHARACTERS else _ANY


def _repeat(least: int, most: int, part: _Part) -> _Part:
    if least == 0:
        return _either(part, _EMPTY) if most == 1 else _ANY
    written = min(least, 4)
    whole = reduce(_then, [part] * written)
    return whole if most == written else _then(whole, _ANY)


def _part(kind, value) -> _Part:
    if kind is op.LITERAL:
        return _Part(frozenset([ascii_lowered(chr(value))]))
    if kind is op.IN:
        return _class(value)
    if kind is op.BRANCH:
        return reduce(_either, [_sequence(x) for x in value[1]])
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        return _repeat(int(value[0]), int(value[1]), _sequence(value[2]))
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return _EMPTY
    return _ANY


def _sequence(items) -> _Part:
    return reduce(_then, [_part(kind, value) for kind, value in items], _EMPTY)


def trigram_query(pattern: str) -> Query:
    """What the lowered trigrams of any text with a match satisfy; the empty query where nothing is mandatory."""
    if _UNLIKE.search(pattern):
        return Query()
    named = re.sub(r"(?<!\\)\(\?<(?![=!])", "(?P<", pattern)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(named)
    except (re.error, Warning, OverflowError, RecursionError):
        return Query()
    return _sequence(parsed).loose().query
