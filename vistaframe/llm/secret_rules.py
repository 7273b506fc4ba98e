"""Rules of the secret scan, and the trigram query that each regex implies."""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product


@dataclass(frozen=True)
class Rule:
    """``pattern``: the same language in Java, Python and RE2. A match stays if its
    ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds come first. Spans at one start are listed in this order.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # runs are whole: the same as runs of any length, then the length
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)

#: A query is an OR of ANDs of trigrams; ALL holds for every text.
Query = frozenset
ALL: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_CLAUSES, MOST_CHARACTERS = 64, 128, 16


def _absorbed(clauses) -> Query:
    least: list[frozenset] = []
    for c in sorted(clauses, key=len):
        if not any(x <= c for x in least):
            least.append(c)
    return frozenset(least)


def _and(a: Query, b: Query) -> Query:
    out = _absorbed(x | y for x in a for y in b)
    return out if len(out) <= MOST_CLAUSES else min(a, b, key=len)  # either half alone is still implied


def _or(queries) -> Query:
    out = _absorbed(c for q in queries for c in q)
    return out if len(out) <= MOST_CLAUSES else ALL


def _of_strings(strings) -> Query:
    return _or([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _characters(members) -> set[str] | None:
    out: set[str] = set()
    for op, av in members:
        if op is C.LITERAL:
            out.add(chr(av).lower())
        elif op is C.RANGE and av[1] - av[0] < MOST_CHARACTERS:
            out |= {chr(x).lower() for x in range(av[0], av[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARACTERS else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """All strings that the items match, if few, and the query that they imply."""
    exact, query, whole = {""}, ALL, True

    def flush() -> None:
        nonlocal exact, query, whole
        query, exact, whole = _and(query, _of_strings(exact)), {""}, False

    def append(strings) -> None:
        nonlocal exact
        if len(exact) * len(strings) > MOST_STRINGS:
            flush()
        exact = {a + b for a, b in product(exact, strings)} if len(strings) <= MOST_STRINGS else exact

    for op, av in items:
        strings, implied, ends = None, ALL, False
        if op is C.LITERAL:
            strings = {chr(av).lower()}
        elif op is C.IN:
            strings = _characters(av)
        elif op is C.SUBPATTERN:
            strings, implied = _walk(av[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in av[1]]
            implied = _or([q if s is None else _of_strings(s) for s, q in parts])
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = av
            strings, implied = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                strings = strings | {""}
            elif low == 0:
                strings, implied = None, ALL
            elif strings is not None and (low, high) != (1, 1):
                strings, ends = {"".join(p) for p in product(strings, repeat=min(low, 3))} if len(strings) ** min(low, 3) <= MOST_STRINGS else strings, True
        if strings is None:
            flush()
            query = _and(query, implied)
        else:
            append(strings)
            if ends:
                flush()
    if whole:
        return exact, _of_strings(exact)
    return None, _and(query, _of_strings(exact))


def trigram_query(pattern: str) -> Query:
    """Trigrams, of the text in lower case, that a match of ``pattern`` implies:
    an OR of ANDs. ``ALL`` if there are none to rely on."""
    return _walk(parser.parse(pattern))[1]
