"""A trigram index over text chunks and the boolean trigram queries that regular expressions imply.

The index is partitioned by document: each Arrow batch of a partition gets its own postings, which are intersected
there, so nothing is shuffled. Only trigrams that some query asks for are indexed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

MOST_EXACT = 96
ANY = ("any",)


def _all(parts: Iterable[tuple]) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _some(parts: Iterable[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of(strings: set[str]) -> tuple:
    """The query that a text must meet to hold one of the strings."""
    coded = [s.encode().decode("latin-1") for s in strings]  # the index is over UTF-8 bytes
    return _some(_all(("gram", s[i : i + 3]) for i in range(len(s) - 2)) for s in coded)


def _walk(items) -> tuple[set[str] | None, tuple]:
    """(all strings that the items can match, or None if they aren't few; a necessary trigram query)."""
    run: set[str] | None = {""}
    needs: list[tuple] = []
    exact = True

    def end_run() -> None:
        nonlocal run
        if run is not None:
            needs.append(_of(run))
        run = None

    for op, arg in items:
        got, query = _one(op, arg)
        if got is not None:
            base = run if run is not None else {""}
            both = {a + b for a in base for b in got}
            if len(both) > MOST_EXACT:
                needs.append(_of(base))
                both, exact = got, False
            run = both
            continue
        exact = False
        end_run()
        needs.append(query)
    if exact:
        return run, ANY
    end_run()
    return None, _all(needs)


def _one(op, arg) -> tuple[set[str] | None, tuple]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN:
        chars: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                chars.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < 4:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
        least, most, inner = arg
        got, query = _walk(inner)
        if most == 1 and got is not None:
            return (got if least else got | {""}), ANY
        if not least:
            return None, ANY
        return None, (_of(got) if got is not None else query)
    if op is sre.SUBPATTERN:
        got, query = _walk(arg[3])
        return got, query
    if op is sre.BRANCH:
        gots = [_walk(b) for b in arg[1]]
        if all(g is not None for g, _ in gots) and sum(len(g) for g, _ in gots) <= MOST_EXACT:
            return set().union(*(g for g, _ in gots)), ANY
        return None, _some(_of(g) if g is not None else q for g, q in gots)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> tuple:
    """The trigrams, as and/or tree, that every (lower-cased) text matched by the pattern must hold."""
    got, query = _walk(parser.parse(pattern, re.IGNORECASE))
    return _of(got) if got is not None else query


def grams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*(grams_of(q) for q in query[1:])) if len(query) > 1 else set()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER &= 127


class TrigramIndex:
    """Postings of the wanted trigrams over the lines of a batch of texts."""

    def __init__(self, queries: list[tuple]):
        for q in queries:
            if q == ANY:
                raise ValueError("a pattern without required trigrams can't be indexed")
        self.queries = queries
        self.grams = sorted(set().union(*(grams_of(q) for q in queries)))
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.table = np.full(1 << 21, -1, np.int16)
        for g, i in self.number.items():
            a, b, c = (x & 127 for x in g.encode("latin-1"))
            # Several trigrams may share a slot once the eighth bit is dropped: they then share postings.
            slot = a << 14 | b << 7 | c
            if self.table[slot] >= 0:
                self.number[g] = int(self.table[slot])
            else:
                self.table[slot] = i

    def candidates(self, data: np.ndarray, line_starts: np.ndarray) -> list[np.ndarray]:
        """For each query the sorted numbers of the lines that may match."""
        b = _LOWER[data].astype(np.uint32)
        codes = (b[:-2] << 14) | (b[1:-1] << 7) | b[2:]
        gram = self.table[codes]
        at = np.flatnonzero(gram >= 0)
        line = np.searchsorted(line_starts, at, "right") - 1
        keys = np.unique(gram[at].astype(np.int64) << 40 | line)
        lines = keys & ((1 << 40) - 1)
        cut = np.searchsorted(keys, np.arange(len(self.grams) + 1, dtype=np.int64) << 40)
        postings = [lines[cut[i] : cut[i + 1]] for i in range(len(self.grams))]

        def run(q: tuple) -> np.ndarray:
            if q[0] == "gram":
                return postings[self.number[q[1]]]
            parts = sorted((run(x) for x in q[1:]), key=len)
            if q[0] == "or":
                return np.unique(np.concatenate(parts))
            out = parts[0]
            for p in parts[1:]:
                if not len(out):
                    break
                out = out[np.searchsorted(p, out, "right") > np.searchsorted(p, out, "left")]
            return out

        return [run(q) for q in self.queries]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offset of each value in them (nulls are empty)."""
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batch_rows: int, offsets: np.ndarray, most_bytes: int) -> Iterable[tuple[int, int]]:
    """Ranges of rows of about most_bytes each; a longer text is a range of its own."""
    lo = 0
    while lo < batch_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), batch_rows)
        yield lo, hi
        lo = hi
