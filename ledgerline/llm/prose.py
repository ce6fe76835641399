"""Running prose told from the rest: statistics of every segment of a text, fixed thresholds over them, a reason per failure.

A text is cut into segments: sentences where it has closing punctuation, else lines, and the items of lists. For all
segments of an Arrow batch at once the statistics are computed as arrays over code points: size, symbols, letters,
words, common words, different words. A segment that keeps every threshold counts as prose with all its characters; the
others name the threshold they fail. A document is prose if at least half of its non-blank characters stand in the former.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import COMMON_WORDS

#: Thresholds of a segment, in the order in which they are tried. The published ones for documents (a tenth of symbols,
#: four fifths of words with letters, two function words) are put for a sentence.
LEAST_WORDS, MOST_SYMBOLS, LEAST_LETTERS, MOST_GLUED, LEAST_COMMON, LEAST_DISTINCT = 4, 0.06, 0.75, 1.5, 0.12, 0.3
#: Words of a list item, and of a line that stands for a sentence without closing punctuation.
LISTED_WORDS, LINE_WORDS = 9, 7
#: One closing mark to at most so many words makes a text punctuated.
WORDS_PER_END = 30
REASONS = ("too_few_words", "symbols", "letters", "glued_words", "few_common_words", "repeated_words", "list", "short_lines")
_LIST, _SHORT = REASONS.index("list") + 1, REASONS.index("short_lines") + 1

_BLOCKS = re.compile(r"\n[ \t]*\n")
_BULLET = re.compile(r"\s*(?:[-*•+·‣▪◦–—]|\(?\d{1,3}[.)]|\[[ xX]\]|\(?[a-zA-Z][.)])\s+", re.ASCII)
_PREFIX = re.compile(r"\s*(?:>+|//+|#+|\*|--|;|%)\s*", re.ASCII)
_CUT = re.compile(r"(?<=[.!?;…])\s+", re.ASCII)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_LINK = re.compile(r"(?:https?|ftp)://\S+", re.ASCII)
_PAD = ""  # takes the place of a link's characters beyond the word that stands for it: they count as size only
_SPACES = str.maketrans({"\r": None, " ": " ", " ": " ", " ": " "})
_CHUNK = 1 << 19  # characters measured at once

_BLANK, _SYMBOL, _LETTER, _APOSTROPHE, _FILL = 1, 2, 4, 8, 16
_WIDTH = 0x3000
_BASE = 0x9E3779B97F4A7C15


def _classes(codes: np.ndarray) -> np.ndarray:
    return np.array([_class(chr(c)) if not 0xD800 <= c < 0xE000 else 0 for c in codes], np.uint8)


def _class(c: str) -> int:
    if c in " \t\n\x0b\f\r":
        return _BLANK
    if c in "{}[]()=<>_/\\|@#$%^&*+~`\"":
        return _SYMBOL
    if c in "'’":
        return _APOSTROPHE
    return _FILL if c == _PAD else _LETTER if c.isalpha() else 0


class _Tables:
    def __init__(self) -> None:
        self.kinds = _classes(np.arange(_WIDTH))
        n = _CHUNK + (1 << 16)
        self.up, self.down = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.need(n)
        self.common = np.sort(np.array([self._hash(w) for w in sorted(set(COMMON_WORDS))], np.uint64))

    def need(self, n: int) -> None:
        """Powers of the base and of its inverse modulo 2**64 up to n."""
        if n <= len(self.up):
            return
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(n, np.uint64)
            have = 1
            while have < n:
                step = min(have, n - have)
                p[have : have + step] = p[:step] * np.uint64(pow(base, have, 1 << 64))
                have += step
            out.append(p)
        self.up, self.down = out

    @staticmethod
    def _hash(word: str) -> int:
        return sum((ord(c) + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(word)) & ((1 << 64) - 1)


_TABLES: list[_Tables] = []


def _measure(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece its non-blank characters, its words and the number of the first threshold that it fails (0: none)."""
    if not _TABLES:
        _TABLES.append(_Tables())
    table = _TABLES[0]
    n = len(pieces)
    text = "\n".join(pieces).lower() + "\n"
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table.kinds[np.minimum(u, _WIDTH - 1)]
    far = u >= _WIDTH
    if far.any():
        codes, back = np.unique(u[far], return_inverse=True)
        kind[far] = _classes(codes)[back]
    starts = np.concatenate([[0], np.flatnonzero(u == 10)[:-1] + 1]) if n > 1 else np.zeros(1, np.int64)
    per = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    blank, letter, fill = kind == _BLANK, kind == _LETTER, kind == _FILL
    whole = per(~blank)
    size = whole - per(fill)
    symbols = per(kind == _SYMBOL)
    letters = per(letter)
    solid = ~blank
    tokens = per(solid & np.concatenate([[True], blank[:-1]]))
    # A word is a run of letters, or two of them with an apostrophe between.
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(first) > 1:
        tied = (first[1:] == last[:-1] + 1) & (kind[last[:-1]] == _APOSTROPHE)
        at = np.flatnonzero(tied)
        if len(at):
            keep, before = [], -2
            for i in at.tolist():
                if i != before + 1:  # a run joined to the one before can't be joined again
                    keep.append(i)
                    before = i
            keep = np.array(keep)
            drop = np.ones(len(first), bool)
            drop[keep + 1] = False
            stay = np.ones(len(last), bool)
            stay[keep] = False
            first, last = first[drop], last[stay]
    piece = np.searchsorted(starts, first, "right") - 1
    words = np.bincount(piece, minlength=n)
    table.need(len(u) + 1)
    sums = np.zeros(len(u) + 1, np.uint64)
    np.cumsum((u.astype(np.uint64) + np.uint64(1)) * table.up[: len(u)], out=sums[1:])
    hashes = (sums[last] - sums[first]) * table.down[first]
    spot = np.minimum(np.searchsorted(table.common, hashes), len(table.common) - 1)
    common = np.bincount(piece, weights=table.common[spot] == hashes, minlength=n)
    marked = np.sort((piece.astype(np.uint64) << np.uint64(40)) | ((hashes * np.uint64(0x7FB5D329728EA185)) >> np.uint64(24)))
    fresh = np.ones(len(marked), bool)
    fresh[1:] = marked[1:] != marked[:-1]
    distinct = np.bincount((marked[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    failed = np.select(
        [words < LEAST_WORDS, symbols > MOST_SYMBOLS * size, letters < LEAST_LETTERS * size, words > MOST_GLUED * tokens, common < LEAST_COMMON * words, distinct < np.minimum(10.0, np.maximum(3.0, LEAST_DISTINCT * words))],
        [1, 2, 3, 4, 5, 6],
        0,
    )
    return whole, words, failed


def _pieces(text: str) -> Iterator[tuple[list[str], list[str], int]]:
    """Per block of a text (lines without a blank one between): the items of its lists, its other lines without the
    marks before them, and the size of these marks."""
    for block in _BLOCKS.split(text) if "\n" in text else (text,):
        items, rest, marks = [], [], 0
        for line in block.split("\n"):
            if not line.strip(" "):
                continue
            if _BULLET.match(line):
                items.append(line)
            else:
                m = _PREFIX.match(line)
                rest.append(line[m.end() :] if m else line)
                marks += len(m.group().strip()) if m else 0
        if items or rest:
            yield items, rest, marks


def _is_ended(piece: str) -> bool:
    x = piece.rstrip(" \t\n\x0b\f\r").rstrip("\"'’”»)")
    y = x.rstrip(".!?;…")
    return len(y) < len(x) and y.rstrip("\"'’”»)]")[-1:].isalnum()


def measure_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of prose and the number of the reason with the most characters (0: none; -1: nothing there)."""
    total = np.zeros((len(texts), len(REASONS) + 2), np.int64)  # prose, each reason, marks before lines
    pieces: list[str] = []
    jobs: list[tuple] = []  # (document, kind, first piece, one past the last, lines)
    held = 0

    def flush() -> None:
        nonlocal pieces, jobs, held
        if not pieces:
            return
        size, words, failed = _measure(pieces)
        again: list[str] = []
        later: list[tuple[int, int]] = []
        for doc, kind, lo, hi, extra in jobs:
            if kind == "item":
                why = _LIST if words[lo] < LISTED_WORDS else failed[lo]
                total[doc, why] += size[lo] + extra
                continue
            ended, lines = extra
            n = int(words[lo:hi].sum())
            if ended * WORDS_PER_END >= n:
                np.add.at(total[doc], failed[lo:hi], size[lo:hi])
            elif n >= LINE_WORDS * len(lines):
                later.append((doc, len(lines)))
                again += lines
            else:
                total[doc, _SHORT] += size[lo:hi].sum()
        if again:
            size, words, failed = _measure(again)
            at = 0
            for doc, k in later:
                np.add.at(total[doc], failed[at : at + k], size[at : at + k])
                at += k
        pieces, jobs, held = [], [], 0

    for doc, text in enumerate(texts):
        if not text:
            continue
        text = text.translate(_SPACES) if not text.isascii() or "\r" in text else text
        if "<" in text:
            text = _TAG.sub("", text)
        if "://" in text:
            text = _LINK.sub(lambda m: "link" + _PAD * (len(m.group()) - 4), text)
        for items, rest, marks in _pieces(text):
            total[doc, -1] += marks
            for x in items:
                bare = x[_BULLET.match(x).end() :]
                mark = len(x) - len(bare)
                jobs.append((doc, "item", len(pieces), len(pieces) + 1, mark - sum(map(x[:mark].count, " \t\n\x0b\f"))))
                pieces.append(bare.replace("\n", " "))
                held += len(x)
            if rest:
                cut = _CUT.split(" ".join(rest))
                jobs.append((doc, "run", len(pieces), len(pieces) + len(cut), (sum(map(_is_ended, cut)), rest)))
                pieces += cut
                held += sum(map(len, rest))
        if held >= _CHUNK:
            flush()
    flush()
    whole = total.sum(axis=1)
    share = np.where(whole > 0, total[:, 0] / np.maximum(whole, 1), 0.0)
    worst = np.where(total[:, 1:-1].max(axis=1) > 0, total[:, 1:-1].argmax(axis=1) + 1, 0)
    return share, np.where(whole > 0, worst, -1)


def prose_share(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, prose_share and reason per row: the share of non-blank characters in segments that keep every threshold, and the
    threshold that the most characters fail (null where none does, "empty" where there are no characters).

    Null, blank and one-word texts have a share of 0. Repeated rows give repeated results; texts are read whole.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*REASONS, "empty", ""], object)
        for b in batches:
            share, worst = measure_texts(b.column(1).to_pylist())
            reason = names[np.where(worst > 0, worst - 1, np.where(worst < 0, len(REASONS), len(REASONS) + 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share, pa.float64()), pa.array([r or None for r in reason], pa.string())], ["k", "prose_share", "reason"])

    out = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, f"k {kind}, prose_share double, reason string")
    return out.withColumnRenamed("k", key)


def not_prose(df: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """key, prose_share and reason of the documents of which less than ``least`` is running prose."""
    return prose_share(df, key, text).where(F.col("prose_share") < least)
