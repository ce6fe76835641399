"""Evaluation items found in a corpus, whole or in part, by pigeonhole pieces and bit-parallel verification.

An item of n words may lose e of them (the error budget) and still count, so when it is split into e + 1 pieces one of
them keeps all its words, in their order, in every passage that counts. The pieces are cut around the e + 1 rarest words
of the item: a hit is such a word with the rest of its piece in order around it, as other words may be put between.
In the same way every run of 12 words of an item covers a piece of six that stands together. Hits are looked up for an
Arrow batch at once, as arrays of word codes, and verified: runs word by word, loose passages by the bit-vector
recurrence of Myers in its form for insertions and deletions, which gives the longest common word sequence of item and
passage.

The items are a query set that every executor holds; it goes out in blocks of bounded size, one after another, each
against all rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace
from .quality import COMMON_WORDS
from .words import words

#: Bytes of item text sent to the executors at once; a larger item set takes several passes over the corpus.
BLOCK_BYTES = 4_000_000
_COMMON = frozenset(COMMON_WORDS)


def common_length(masks: dict[int, int], n: int, passage: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words, given as bit masks, and a passage."""
    full = (1 << n) - 1
    v = full
    for w in passage:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def cut_around(n: int, anchors: list[int]) -> list[tuple[int, int]]:
    """Pieces of a sequence of n, one around each of the anchors, halfway between them."""
    cuts = [0, *((x + y + 1) // 2 for x, y in zip(anchors, anchors[1:])), n]
    return list(zip(cuts, cuts[1:]))


class Matcher:
    """The items as an index of pieces."""

    def __init__(self, items: list[tuple[object, str]], run: int, share: float, stretch: float):
        self.run, self.half = run, run // 2
        self.ids = [i for i, _ in items]
        texts = [words(t or "") for _, t in items]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
        spread = Counter(w for t in texts for w in set(t))
        self.items = [np.array([self.vocab[w] for w in t], np.int64) for t in texts]
        self.need = [-(-len(t) * round(share * 1000) // 1000) for t in texts]
        self.reach = np.array([int(len(t) * stretch) for t in texts], np.int64)
        self.masks: list[dict[int, int]] = []
        self.marked = np.zeros(len(self.vocab) + 1, bool)  # the words of the item being verified
        codes, places = [], []
        pieces: list[tuple[int, int, list[int], list[int]]] = []  # anchor, item, words before it (nearest first), after it
        for k, t in enumerate(texts):
            seq = self.items[k]
            masks: dict[int, int] = {}
            for p, w in enumerate(seq.tolist()):
                masks[w] = masks.get(w, 0) | 1 << p
            self.masks.append(masks)
            if t:
                budget = len(t) - self.need[k]
                rarest = sorted(range(len(t)), key=lambda p: (t[p] in _COMMON, spread[t[p]], -len(t[p]), p))
                anchors = sorted(rarest[: budget + 1])
                for (lo, hi), at in zip(cut_around(len(t), anchors), anchors):
                    pieces.append((int(seq[at]), k, seq[lo:at][::-1].tolist(), seq[at + 1 : hi].tolist()))
            for p in range(0, len(t) - self.half + 1, self.half) if len(t) >= run else ():
                codes.append(self._code(seq[p : p + self.half])[0])
                places.append((k, p))
        order = np.argsort(np.array(codes, np.uint64), kind="stable") if codes else np.zeros(0, np.int64)
        self.codes = np.array(codes, np.uint64)[order] if codes else np.zeros(0, np.uint64)
        self.places = [places[i] for i in order]
        pieces.sort(key=lambda x: x[:2])
        self.piece_item = np.array([x[1] for x in pieces], np.int64)
        self.before, self.after = (self._table([x[c] for x in pieces]) for c in (2, 3))
        anchors = np.array([x[0] for x in pieces], np.int64)
        self.first = np.searchsorted(anchors, np.arange(len(self.vocab) + 2))

    @staticmethod
    def _table(rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def _code(self, seq: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(seq) - self.half + 1), np.uint64)
        for j in range(self.half):
            out = out * np.uint64(0x9E3779B97F4A7C15) + seq[j : j + len(out)].astype(np.uint64)
        return out

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text number, item number, most words in common) of the items in the texts."""
        get = self.vocab.get
        parts = [[get(w, 0) for w in words(t)] for t in texts]
        # A word that no item has stands between two texts.
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        seq = np.fromiter(chain.from_iterable(chain(p, (0,)) for p in parts), np.int64, int(ends[-1]) + 1 if len(ends) else 0)
        found: dict[tuple[int, int], int] = {}
        for at, k, p in self._together(seq):
            n = self._extend(seq, at, self.items[k], p)
            if n >= self.run:
                doc = int(np.searchsorted(ends, at))
                found[doc, k] = max(found.get((doc, k), 0), n)
        for doc, k in self._apart(seq, ends):
            if (doc, k) not in found:
                lo = int(ends[doc - 1]) + 1 if doc else 0
                if n := self._loose(seq[lo : ends[doc]], k):
                    found[doc, k] = n
        return sorted((d, k, n) for (d, k), n in found.items())

    def _together(self, seq: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, item, place in the item) of the six-word pieces that stand together."""
        if len(seq) < self.half or not len(self.codes):
            return
        codes = self._code(seq)
        lo, hi = np.searchsorted(self.codes, codes, "left"), np.searchsorted(self.codes, codes, "right")
        for at in np.flatnonzero(hi > lo).tolist():
            for x in range(int(lo[at]), int(hi[at])):
                yield at, *self.places[x]

    def _apart(self, seq: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) where all words of some piece of the item stand in order, within the reach of a passage."""
        place = np.flatnonzero(self.first[seq + 1] > self.first[seq])
        if not len(place):
            return []
        width = self.first[seq[place] + 1] - self.first[seq[place]]
        at = np.repeat(place, width)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.first[seq[place]], width)
        known = np.flatnonzero(seq)
        total = len(seq) + 1
        keys = np.sort(seq[known] * total + known)  # of each word its places in order
        low, high = at.copy(), at.copy()
        for table, step in ((self.after, 1), (self.before, -1)):
            for j in range(table.shape[1]):
                w = table[piece, j]
                go = np.flatnonzero(w)
                if not len(go):
                    break
                # The next place of the word beyond what was matched so far: the greedy choice leaves most room.
                if step > 0:
                    spot = np.searchsorted(keys, w[go] * total + high[go] + 1)
                    ok = spot < len(keys)
                else:
                    spot = np.searchsorted(keys, w[go] * total + low[go]) - 1
                    ok = spot >= 0
                key = keys[np.clip(spot, 0, len(keys) - 1)]
                got = key - w[go] * total
                ok &= key // total == w[go]
                if step > 0:
                    high[go] = np.where(ok, got, high[go])
                else:
                    low[go] = np.where(ok, got, low[go])
                stay = np.ones(len(at), bool)
                stay[go] = ok & (high[go] - low[go] < self.reach[self.piece_item[piece[go]]])
                at, piece, low, high = at[stay], piece[stay], low[stay], high[stay]
        doc = np.searchsorted(ends, low)
        same = doc == np.searchsorted(ends, high)
        pairs = np.unique(doc[same] * len(self.items) + self.piece_item[piece[same]])
        return [(int(p) // len(self.items), int(p) % len(self.items)) for p in pairs]

    @staticmethod
    def _extend(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
        s = 0
        while i - s > 0 and j - s > 0 and a[i - s - 1] == b[j - s - 1]:
            s += 1
        e = 0
        while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
            e += 1
        return s + e

    def _loose(self, seq: np.ndarray, k: int) -> int:
        need, reach = self.need[k], int(self.reach[k])
        self.marked[self.items[k]] = True
        hits = np.flatnonzero(self.marked[seq])
        self.marked[self.items[k]] = False
        if not need or len(hits) < need:
            return 0
        # Starts after which enough of the item's words follow within the allowed length.
        dense = hits[: len(hits) - need + 1][hits[need - 1 :] - hits[: len(hits) - need + 1] < reach]
        n = len(self.items[k])
        for s in dense.tolist():
            common = common_length(self.masks[k], n, seq[s : s + reach].tolist())
            if common >= need:
                return common
        return 0


#: Characters of documents looked at together.
CHUNK = 1_000_000


def leaked_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12, share: float = 0.7, stretch: float = 1.5) -> DataFrame:
    """doc, item, matched: documents that hold ``run`` consecutive words of an item, or at least ``share`` of its words
    in their order within a passage of at most ``stretch`` times its length.

    Case, punctuation, layout, invisible characters and markup don't matter. Null and empty texts on either side match
    nothing; repeated rows are searched once per row. Documents are read whole. ``matched`` is the number of words of
    the longest run, or else of the first loose passage that suffices.
    """
    kinds = dict(docs.dtypes)[doc], dict(items.dtypes)[item]
    items = items.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    corpus = docs.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    schema = f"d {kinds[0]}, i {kinds[1]}, matched int"

    def searched(number: int) -> DataFrame:
        block = sorted((r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == number).collect())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, run, share, stretch)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                lo, held = 0, 0
                for hi in range(1, len(texts) + 1):
                    held += len(texts[hi - 1])
                    if held >= CHUNK or hi == len(texts):
                        if out := matcher.find(texts[lo:hi]):
                            rows, which, matched = zip(*out)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + r for r in rows])), pa.array([matcher.ids[k] for k in which]), pa.array(matched, pa.int32())], ["d", "i", "matched"])
                        lo, held = hi, 0

        return corpus.mapInArrow(search, schema)

    if blocks == 1:
        out = searched(0)
    else:
        # One block at a time: the driver never holds more of the items than that.
        space = Workspace(docs.sparkSession, "leakage")
        out = functools.reduce(DataFrame.unionByName, (space.write(searched(b), f"block{b}") for b in range(blocks)))
    return out.select(F.col("d").alias(doc), F.col("i").alias(item), "matched")
