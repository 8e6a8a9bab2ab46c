"""Boolean trigram queries of regular expressions, and an inverted index that answers them for a block of texts.

Both look at UTF-8 bytes with A-Z in lower case, so that a query holds for matches in either case.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser
from typing import Any

import numpy as np

#: A query: None (any text), a trigram, or ("and" | "or", queries).
Query = None | bytes | tuple[str, tuple["Query", ...]]
#: Strings that are followed as such: their number and length; letters of a class that are told apart.
MOST_STRINGS, MOST_BYTES, MOST_CLASS = 64, 24, 16


def _join(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and None in parts:
        return None
    found = tuple(dict.fromkeys(p for p in parts if p is not None))
    return None if not found else found[0] if len(found) == 1 else (kind, found)


def _all_of(strings: set[bytes]) -> Query:
    """What a text holds that contains one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _product(left: set[bytes], right: set[bytes]) -> set[bytes] | None:
    found = {a + b for a in left for b in right}
    return found if len(found) <= MOST_STRINGS and max(map(len, found)) <= MOST_BYTES else None


def _letter(code: int, fold: bool) -> set[bytes] | None:
    return None if code > 127 and fold else {chr(code).encode().lower()}


def _node(op: Any, arg: Any, fold: bool) -> tuple[set[bytes] | None, Query]:
    """The strings that it matches if they are few, else what a text with a match holds."""
    if op is K.LITERAL:
        return _letter(arg, fold), None
    if op is K.IN and arg[0][0] is not K.NEGATE:
        codes = [c for kind, x in arg for c in ([x] if kind is K.LITERAL else range(x[0], x[1] + 1) if kind is K.RANGE else range(MOST_CLASS + 1))]
        if len(codes) <= MOST_CLASS and not any(c > 127 for c in codes):
            return {chr(c).encode().lower() for c in codes}, None
        return None, None
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner, fold)
        if not least:
            return (strings | {b""}, None) if strings is not None and most == 1 else (None, None)
        if strings is None:
            return None, query
        times: set[bytes] | None = strings
        for _ in range(least - 1):
            times = times and _product(times, strings)
        return (times, None) if times is not None and most == least else (None, _all_of(times or strings))
    if op is K.SUBPATTERN:
        return _sequence(arg[-1], fold)
    if op is K.ATOMIC_GROUP:
        return _sequence(arg, fold)
    if op is K.BRANCH:
        sides = [_sequence(x, fold) for x in arg[1]]
        if all(s is not None for s, _ in sides) and len(union := set().union(*(s for s, _ in sides))) <= MOST_STRINGS:
            return union, None
        return None, _join("or", [q if s is None else _all_of(s) for s, q in sides])
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {b""}, None
    return None, None


def _sequence(items: Any, fold: bool) -> tuple[set[bytes] | None, Query]:
    run, parts, plain = {b""}, [], True
    for op, arg in items:
        strings, query = _node(op, arg, fold)
        if strings is not None and (longer := _product(run, strings)):
            run = longer
            continue
        plain = False
        parts += [_all_of(run), query]
        run = strings if strings is not None else {b""}
    return (run, None) if plain else (None, _join("and", [*parts, _all_of(run)]))


def query_of(pattern: str, flags: int = 0) -> Query:
    """The trigrams that a text must hold to match; None if none is mandatory."""
    strings, query = _sequence(_parser.parse(pattern, flags), bool(flags & re.IGNORECASE))
    return query if strings is None else _all_of(strings)


def trigrams_in(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


class TrigramIndex:
    """Postings of the given trigrams over a block of texts."""

    def __init__(self, trigrams: set[bytes]) -> None:
        self.known = np.zeros(1 << 24, bool)
        for t in trigrams:
            self.known[int.from_bytes(t, "big")] = True

    def build(self, texts: list[bytes]) -> TrigramIndex:
        self.texts = len(texts)
        whole = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", np.uint8).astype(np.uint32)
        ends = np.cumsum([len(x) + 2 for x in texts])
        codes = whole[:-2] << 16 | whole[1:-1] << 8 | whole[2:]
        at = np.flatnonzero(self.known[codes])
        pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        code, text = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(code)) + 1
        self.postings = {int(c[0]).to_bytes(3, "big"): t for c, t in zip(np.split(code, cuts), np.split(text, cuts), strict=True) if len(c)}
        return self

    def ask(self, query: Query) -> np.ndarray:
        """Positions of the texts that may match, in ascending order."""
        if query is None:
            return np.arange(self.texts)
        if isinstance(query, bytes):
            return self.postings.get(query, np.zeros(0, np.int64))
        kind, parts = query
        found = [self.ask(p) for p in parts]
        if kind == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        for more in found[1:]:
            found[0] = np.intersect1d(found[0], more, assume_unique=True)
        return found[0]
