"""Sessions by timers against a plain loop, and their odd cases."""

import random
from datetime import datetime, timedelta

import pytest

from ledgerline.operators.sessions import sessions
from ledgerline.streaming.session_timers import merge_open

T0 = datetime(2024, 1, 7, 23, 0)
SCHEMA = "who int, at timestamp_ntz, h string, k string, first int"


def brute(rows, gap):
    out = []
    seen = sorted({(w, t, h) for w, t, h in rows if w is not None and t is not None})
    for w, t, _ in seen:
        if out and out[-1][0] == w and t - out[-1][2] <= gap:
            out[-1][2], out[-1][3] = t, out[-1][3] + 1
        else:
            out.append([w, t, t, 1])
    return sorted(map(tuple, out))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(w, t, h, "x", 1) for w, t, h in rows], SCHEMA)
    r = sessions(df, "who", "at", 90, ident="h", **kw).collect()
    return sorted((x.who, x.session_start, x.session_end, x.n_events) for x in r)


@pytest.mark.parametrize("slice_days", [1, 7])
def test_as_a_plain_loop(spark, slice_days):
    rnd = random.Random(slice_days)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 9), T0 + timedelta(minutes=rnd.randrange(0, 60 * 24 * 20)), str(i)) for i in range(3000)]
    rows += rows[:200]
    assert run(spark, rows, slice_days=slice_days) == brute(rows, timedelta(minutes=90))


def test_limits_nulls_copies_and_ties(spark):
    m = lambda x: T0 + timedelta(minutes=x)
    rows = [(1, m(0), "a"), (1, m(90), "b"), (1, m(181), "c"), (1, m(181), "c"), (1, m(181), "d"), (None, m(0), "e"), (2, None, "f")]
    assert run(spark, rows) == [(1, m(0), m(90), 2), (1, m(181), m(181), 2)]
    assert run(spark, []) == []


def test_open_spans_merge():
    assert merge_open([(10, 20, 1), (0, 5, 2), (26, 30, 1)], 5) == [(0, 20, 3), (26, 30, 1)]
