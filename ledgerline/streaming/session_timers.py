"""Sessions over an unbounded stream: one event-time timer per key in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merge_open(spans: list[tuple[int, int, int]], gap_ms: int) -> list[tuple[int, int, int]]:
    """Join (start, last, count) spans that lie at most ``gap_ms`` apart."""
    out: list[tuple[int, int, int]] = []
    for s, e, n in sorted(spans):
        if out and s - out[-1][1] <= gap_ms:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + n)
        else:
            out.append((s, e, n))
    return out


def session_stream(df: DataFrame, key: str, ts: str, gap_minutes: float = 90, lateness: str = "1 day") -> DataFrame:
    """Final sessions of a stream in append mode; ``lateness`` bounds how far events may be out of order.

    The timer of a key stands at the end of its earliest open session plus the gap. When the watermark passes it, no
    further event can belong to that session, which is then emitted and forgotten. Nulls in key or time are left out.
    """
    gap_ms = int(gap_minutes * 60_000)
    kind = dict(df.dtypes)[key]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = list(zip(*state.get)) if state.exists else []
        for f in frames:
            ms = f["event_time"].astype("datetime64[us]").astype("int64") // 1000
            spans += [(int(m), int(m), 1) for m in ms]
        spans = merge_open(spans, gap_ms)
        mark = state.getCurrentWatermarkMs()
        done = [s for s in spans if s[1] + gap_ms < mark]
        rest = [s for s in spans if s[1] + gap_ms >= mark]
        if rest:
            state.update(tuple(list(x) for x in zip(*rest)))
            state.setTimeoutTimestamp(max(min(s[1] for s in rest) + gap_ms + 1, mark + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"k": [k[0]] * len(done), "first": [s[0] for s in done], "last": [s[1] for s in done], "n_events": [s[2] for s in done]})

    rows = df.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("event_time")).where("k is not null and event_time is not null")
    out = rows.withWatermark("event_time", lateness).groupBy("k").applyInPandasWithState(update, f"k {kind}, first bigint, last bigint, n_events bigint", "starts array<bigint>, lasts array<bigint>, counts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: F.timestamp_millis(F.col(c)).cast("timestamp_ntz")
    return out.select(F.col("k").alias(key), at("first").alias("session_start"), at("last").alias("session_end"), ((F.col("last") - F.col("first")) / 1e3).alias("duration_s"), "n_events")
