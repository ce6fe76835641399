"""Items packed into containers of fixed capacity: bounded-space best-fit per partition, leftovers merged at the end.

A task keeps a fixed number of windows open. An item goes into the window that it fills best; if it fits in none and
no more windows may be opened, the fullest is closed. Only the windows still open at the end of a partition, a few per
task, meet in a last step, which joins them without taking them apart.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace

# Fixed value: the published pattern by which this byte-level vocabulary cuts a text into pieces.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: So many leftover windows are merged in one task; more are merged in several groups, and what these leave again.
MERGED_AT_ONCE = 200_000
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with a public vocabulary file: ranks of a byte-level BPE, a tokenizer JSON or a sentence-piece model."""
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            one = tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(one.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def with_token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, n_tokens; a null text has 0 tokens. Texts are encoded whole."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count([t or "" for t in b.column(1).to_pylist()]), pa.int64())], ["k", "n_tokens"])

    out = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint")
    return out.withColumnRenamed("k", key)


class Windows:
    """Open windows of one partition."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: dict[int, int] = {}
        self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset in it) for an item of at most the capacity."""
        if size == self.capacity:
            self.next += 1
            return self.next - 1, 0
        best = min((w for w, f in self.free.items() if f >= size), key=self.free.__getitem__, default=None)
        if best is None:
            if len(self.free) >= self.most:
                del self.free[min(self.free, key=self.free.__getitem__)]
            best, self.next = self.next, self.next + 1
            self.free[best] = self.capacity
        at = self.capacity - self.free[best]
        self.free[best] -= size
        if not self.free[best]:
            del self.free[best]
        return best, at


def _merge(fills: list[tuple[object, int]], capacity: int) -> dict[object, tuple[int, int]]:
    """Leftover windows (name, tokens in it) joined best-fit, fullest first -> (number of the new container, base)."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    out = {}
    for name, n in sorted(fills, key=lambda x: (-x[1], x[0])):
        room = next((f for f in range(n, capacity + 1) if by_free[f]), None)
        if room is None:
            c, room = len(used), capacity
            used.append(0)
        else:
            c = by_free[room].pop()
        out[name] = (c, used[c])
        used[c] += n
        by_free[room - n].append(c)
    return out


def _merger(capacity: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        used = dict(zip(frame["name"], frame["used"].tolist()))
        to = _merge(list(used.items()), capacity)
        full: dict[int, int] = {}
        for name, (c, _) in to.items():
            full[c] = full.get(c, 0) + used[name]
        return pd.DataFrame([(name, f"m{level}-{frame['g'].iloc[0]}-{c}", base, full[c]) for name, (c, base) in to.items()], columns=["name", "merged", "base", "total"])

    return merge


def pack(items: DataFrame, key: str, size: str, capacity: int, open_windows: int = 32, merged_at_once: int = MERGED_AT_ONCE) -> DataFrame:
    """container_id, position, key, piece, piece_start, piece_size; every item once, split only if larger than ``capacity``.

    position is the offset of the piece in its container, piece_start its offset in the item. An item that is larger
    than the capacity is cut into full pieces and a rest. Items of size 0 or null take no room: they come out with a
    null container. Items that repeat a key are packed each on their own. Negative sizes raise.
    """
    space = Workspace(items.sparkSession, "packing")
    kind = dict(items.dtypes)[key]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows = Windows(capacity, open_windows)
        names = ["k", "part", "win", "position", "piece", "piece_start", "piece_size"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        k_type = None
        for b in batches:
            k_type = b.schema.field(0).type
            rows, cols = [], [[] for _ in kinds]
            for r, n in enumerate(b.column(1).to_pylist()):
                n = n or 0
                if n < 0:
                    raise ValueError("an item has a negative size")
                for piece, start in enumerate(range(0, n, capacity)) if n else [(0, 0)]:
                    size_ = min(capacity, n - start)
                    win, at = windows.place(size_) if size_ else (None, None)
                    rows.append(r)
                    for c, v in zip(cols, (part if size_ else None, win, at, piece, start, size_)):
                        c.append(v)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)
        if windows.free:
            left = [(part, w, None, -1, capacity - f, None) for w, f in windows.free.items()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(left), k_type), *(pa.array(c, t) for c, t in zip(zip(*left), kinds))], names)

    rows = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{size}`").cast("bigint").alias("n"))
    placed = space.write(rows.mapInArrow(fill, f"k {kind}, part int, win int, position int, piece int, piece_start bigint, piece_size int"), "placed")
    # One row per window left open, at most open_windows for each task.
    left = placed.where("piece = -1").select("part", "win", F.col("piece_start").alias("used"))
    left = left.select(F.concat_ws("-", "part", "win").alias("name"), "used")
    now, moved, level = space.write(left, "left"), None, 0
    count = now.count()
    while True:
        groups = max(1, -(-count // merged_at_once))
        step = now.withColumn("g", F.pmod(F.xxhash64("name", F.lit(level)), F.lit(groups)).cast("int"))

        done = space.write(step.groupBy("g").applyInPandas(_merger(capacity, level), "name string, merged string, base int, total bigint"), f"merged{level}")
        if moved is None:
            moved = done.drop("total")
        else:
            again = done.select(F.col("name").alias("merged"), F.col("merged").alias("next"), F.col("base").alias("more"))
            moved = moved.join(again, "merged", "left").select("name", F.coalesce("next", "merged").alias("merged"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
            moved = space.write(moved, f"moved{level}")
        # What several groups left with room in it meets once more; each round has fewer containers.
        now = done.where(F.col("total") < capacity).select(F.col("merged").alias("name"), F.col("total").alias("used")).distinct()
        before, count, level = count, now.count(), level + 1
        if groups == 1 or count >= before:
            break
    out = placed.where("piece >= 0").withColumn("name", F.when(F.col("part").isNotNull(), F.concat_ws("-", "part", "win"))).join(moved, "name", "left")
    return out.select(
        F.coalesce("merged", "name").alias("container_id"),
        (F.col("position") + F.coalesce("base", F.lit(0))).alias("position"),
        F.col("k").alias(key),
        "piece",
        "piece_start",
        "piece_size",
    )
