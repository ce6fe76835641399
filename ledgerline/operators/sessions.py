"""Activity sessions by keyed timers.

Each key has at most one open session and one timer. An event that arrives before the timer fires updates the open
session and resets the timer to ``event time + gap``; an event after it finds the timer expired, which emits the
session and opens the next one. On bounded input the events are put in order first, so that no row is late.

Keys are cut into time slices: a key that holds a third of all rows is spread over as many tasks as it has slices.
Only sessions that reach the border of a slice can continue in the next, and these alone meet again in a second pass
of the same timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def _changed(col: pa.ChunkedArray) -> np.ndarray:
    """True where a value differs from the one before it."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return pc.not_equal(col[1:], col[:-1]).fill_null(True).to_numpy(zero_copy_only=False)


def timer_machine(gap_us: int, drop_copies: bool):
    """A function over ordered batches with the columns k, grp, ident, first, last, n; one row a session comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None  # the session whose timer is running, with the ident of its last event
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if open_ is not None:
                t = pa.concat_tables([open_, t])
            first, last, n = (t.column(c).to_numpy() for c in ("first", "last", "n"))
            n = n.copy()
            other = np.concatenate([[True], _changed(t.column("k")) | _changed(t.column("grp"))])
            if drop_copies:
                same = np.concatenate([[False], ~(other[1:] | _changed(t.column("ident"))) & (first[1:] == last[:-1])])
                n[same] = 0
            expired = other.copy()
            expired[1:] |= first[1:] - last[:-1] > gap_us
            at = np.flatnonzero(expired)
            ends = np.concatenate([at[1:], [t.num_rows]]) - 1
            done = pa.table(
                {"k": t.column("k").take(pa.array(at)), "grp": t.column("grp").take(pa.array(at)), "ident": t.column("ident").take(pa.array(ends)), "first": first[at], "last": last[ends], "n": np.add.reduceat(n, at)}
            ).cast(t.schema)
            open_ = done.slice(done.num_rows - 1)
            yield from done.slice(0, done.num_rows - 1).combine_chunks().to_batches()
        if open_ is not None:
            yield from open_.combine_chunks().to_batches()

    return run


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: float = 90, ident: str | None = None, slice_days: int = 7) -> DataFrame:
    """One row per session: key, session_start, session_end (timestamp_ntz), duration_s, n_events.

    A session ends when more than ``gap_minutes`` pass without an event of its key; a pause of exactly that length
    doesn't end it. Rows with a null key or time belong to no session and are left out. With ``ident``, rows that
    agree in key, time and ident are one event (a null ident equals no other). Ties in time are separate events
    of one session. Empty input gives no rows; further columns of any name are ignored.
    """
    gap, width = int(gap_minutes * 60_000_000), slice_days * DAY
    if gap <= 0 or width <= gap:
        raise ValueError("the gap must be positive and shorter than a slice")
    micros = F.unix_micros(F.col(f"`{ts}`").cast("timestamp")) if dict(df.dtypes)[ts] != "bigint" else F.col(f"`{ts}`")
    events = df.select(F.col(f"`{key}`").alias("k"), micros.alias("first"), (F.col(f"`{ident}`") if ident else F.lit(None)).cast("string").alias("ident")).where("k is not null and first is not null")
    slot: Column = F.floor(F.col("first") / F.lit(width)).cast("bigint")
    events = events.select("k", slot.alias("grp"), "ident", "first", F.col("first").alias("last"), F.lit(1).cast("bigint").alias("n"))
    kind = dict(events.dtypes)["k"]
    schema = f"k {kind}, grp bigint, ident string, first bigint, last bigint, n bigint"
    pieces = events.repartition("k", "grp").sortWithinPartitions("k", "grp", "first", "ident").mapInArrow(timer_machine(gap, ident is not None), schema)
    # A piece that can't reach over the border of its slice stays alone: its own group in the second pass.
    begin = F.col("grp") * width
    touches = (F.col("first") - begin <= gap) | (begin + width - F.col("last") <= gap)
    pieces = pieces.withColumn("grp", F.when(touches, F.lit(-(2**62)).cast("bigint")).otherwise(F.col("grp")))
    whole = pieces.repartition("k", "grp").sortWithinPartitions("k", "grp", "first").mapInArrow(timer_machine(gap, False), schema)
    at = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return whole.select(F.col("k").alias(key), at("first").alias("session_start"), at("last").alias("session_end"), ((F.col("last") - F.col("first")) / 1e6).alias("duration_s"), F.col("n").alias("n_events"))
