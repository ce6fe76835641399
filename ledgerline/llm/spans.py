"""Long exact spans shared between records, over a log-structured index of window fingerprints.

A window of ``span`` units is named by its minimizer: the k-gram of smallest hash inside it. Windows that follow one
another and have the same minimizer form a run, and a run is stored as one posting: the hash of its k-gram and its place. Equal windows have equal minimizers, so only postings whose k-gram stands
in two records can hold shared windows.

Postings live in immutable runs of the index, bucketed and sorted by k-gram hash in the shared folder. A new batch is
merge-joined with them without a shuffle, which tells the k-grams that stand in two records by now; many small runs are
compacted into one. The hits are verified on the records: postings of one k-gram whose content has one digest (128 bits,
cryptographic) are shared as a whole, and where contents differ (the borders of a shared span) the single windows are
compared by theirs. Nothing is ever paired: every step counts by key.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Workspace

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_BLOCK = 1 << 20  # units hashed at once
_PLACE = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.size = 0
        self.up = self.down = np.empty(0, np.uint64)

    def need(self, n: int) -> None:
        if n <= self.size:
            return
        n = max(n, _BLOCK + 4096)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(n, np.uint64)
            have = 1
            while have < n:
                step = min(have, n - have)
                p[have : have + step] = p[:step] * np.uint64(pow(base, have, 1 << 64))
                have += step
            made.append(p)
        self.up, self.down = made
        self.size = n


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram of a sequence, from prefix sums of a polynomial."""
    _POWERS.need(len(units) + 1)
    u = _mix(units.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    sums = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(u * _POWERS.up[: len(u)], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _POWERS.down[: len(sums) - k])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(rows, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def runs_of(units: np.ndarray, starts: np.ndarray, span: int, k: int):
    """For sequences laid end to end (starts has one more entry than there are sequences): of each run of windows the
    sequence, first window, number of windows and k-gram hash, as arrays."""
    n = len(units)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none.view(np.uint64)
    gram = gram_hashes(units, k)
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    place = (_sliding_min(key, span - k + 1) & _PLACE).astype(np.int64)
    # A window is whole if no sequence begins inside it.
    begins = np.zeros(n + 1, np.int32)
    np.add.at(begins, starts[:-1], 1)
    seq_at = np.cumsum(begins[:n])
    whole = seq_at[: n - span + 1] == seq_at[span - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none.view(np.uint64)
    p = place[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    a = at[first]
    count = np.diff(np.append(first, len(at)))
    seq = np.searchsorted(starts, a, "right") - 1
    return seq, a - starts[seq], count, gram[p[first]]


def _text_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return units, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def _groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > _BLOCK:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths)


def _pieces(seq, span: int) -> Iterator[tuple[int, object]]:
    """A very long sequence in overlapping blocks, each window in one of them."""
    step = 8 * _BLOCK
    for s in range(0, max(1, len(seq) - span + 1), step):
        yield s, seq[s : s + step + span - 1]


POSTING = "m bigint, a int, n int"


def postings(records: DataFrame, span: int, k: int, text: bool) -> DataFrame:
    """records(id, seq) -> id, m (k-gram hash), a (first window), n (windows of the run)."""
    kind = dict(records.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            seqs = batch.column(1).to_pylist()
            for lo, hi in _groups([len(s) for s in seqs]):
                for off, part in _pieces(seqs[lo], span) if hi - lo == 1 else [(0, None)]:
                    part = seqs[lo:hi] if part is None else [part]
                    if text:
                        units, starts = _text_units(part)
                    else:
                        units = np.concatenate([np.asarray(x, np.int64) for x in part]).view(np.uint64) if part else np.zeros(0, np.uint64)
                        starts = np.concatenate([[0], np.cumsum([len(x) for x in part])])
                    seq, a, n, m = runs_of(units, starts, span, k)
                    if len(seq):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(seq + lo)), pa.array(m.view(np.int64)), pa.array((a + off).astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "m", "a", "n"])

    return records.mapInArrow(run, f"id {kind}, {POSTING}")


class FingerprintIndex:
    """Immutable runs of postings, each a table bucketed and sorted by k-gram hash, and the keys that are alive so far.

    A key is alive once it stands in two records. A batch is written as a run of its own and merge-joined, bucket by
    bucket and without a shuffle, with the runs of the history; the keys that come alive by it are kept. When there are
    more than ``fan_in`` runs they are compacted into one.
    """

    def __init__(self, spark: SparkSession, space: Workspace, buckets: int | None = None, fan_in: int = 4):
        self.spark, self.space, self.fan_in = spark, space, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.alive: list[str] = []
        self.compactions = 0

    def _write(self, df: DataFrame) -> str:
        name = f"ledgerline_run_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "m").write.format("parquet").bucketBy(self.buckets, "m").sortBy("m").option("path", f"{self.space.root}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _keys(self, run: str) -> DataFrame:
        return self.spark.table(run).groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))

    def hits(self, run: str, history: list[str]) -> DataFrame:
        """The keys of a new run that stand in two records of it, or in one of it and another of the history."""
        found = self._keys(run)
        for old in history:
            known = self._keys(old).select("m", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
            found = found.join(known.hint("merge"), "m", "left").select("m", F.least("lo", "old_lo").alias("lo"), F.greatest("hi", "old_hi").alias("hi"))
        return found.where("lo <> hi").select("m")

    def add(self, batch: DataFrame) -> None:
        """Match a batch with the history and with itself, then make it part of the history."""
        run = self._write(batch)
        self.alive.append(self._write(self.hits(run, self.runs)))
        self.runs.append(run)
        if len(self.runs) > self.fan_in:
            self.compact()

    def compact(self) -> None:
        old, keys = self.runs, self.alive
        both = lambda names: functools.reduce(DataFrame.unionByName, map(self.spark.table, names))
        self.runs = [self._write(both(old))]
        self.alive = [self._write(both(keys).distinct())]
        self.compactions += 1
        for r in (*old, *keys):
            self._drop(r)

    def shared(self) -> DataFrame:
        """All postings of the history under keys that are alive: id, m, a, n."""
        live = None
        for k in self.alive:
            one = self.spark.table(k).select("m", F.lit(True).alias("one"))
            live = one if live is None else live.join(one.withColumnRenamed("one", "other").hint("merge"), "m", "full").select("m", F.coalesce("one", "other").alias("one"))
        parts = [self.spark.table(r).join(live.hint("merge"), "m").drop("one") for r in self.runs]
        return functools.reduce(DataFrame.unionByName, parts)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.space.forget(f"{self.space.root}/{name}")

    def drop(self) -> None:
        for r in (*self.runs, *self.alive):
            self._drop(r)
        self.runs, self.alive = [], []


def _content(units, text: bool):
    """bytes of any stretch of a record, for digests of what really stands there."""
    raw = units.encode("utf-32-le", "surrogatepass") if text else np.asarray(units, np.int64).tobytes()
    width = 4 if text else 8
    return lambda start, end: hashlib.blake2b(raw[start * width : end * width], digest_size=16).digest()


#: Records with a hit are fetched through a broadcast of their ids up to so many (tens of MB), else by a shuffled join.
BROADCAST_IDS = 500_000


def shared_spans(records: DataFrame, span: int, k: int, text: bool, batches: int = 3, fan_in: int = 2) -> DataFrame:
    """id, shared_len for the records of which some stretch of at least ``span`` units stands in another record.

    records has the columns id (a unique key) and seq: a string (``text``, its units are characters as stored) or an
    array of bigint. shared_len counts the units inside such stretches, each once. Records that are null or shorter
    than ``span`` share nothing, and a stretch repeated only inside its own record doesn't count. Repeated rows of an
    id count as one record. Records that are wholly equal share their whole length. The records go through the index in
    ``batches``; their number doesn't alter the result.
    """
    spark = records.sparkSession
    space = Workspace(spark, "spans")
    kind = dict(records.dtypes)["id"]
    size = F.char_length("seq") if text else F.size("seq")
    records = records.select("id", "seq").where(F.col("id").isNotNull() & (size >= span))
    # One scan of the texts, laid out by batch; each batch then goes to the index by itself.
    staged = space.write(postings(records, span, k, text).withColumn("batch", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(batches)).cast("int")), "staged", partition_by="batch")
    index = FingerprintIndex(spark, space, fan_in=fan_in)
    for i in range(batches):
        index.add(staged.where(F.col("batch") == i).drop("batch"))
    hits = space.write(index.shared(), "hits")
    index.drop()
    space.drop("staged")
    # Verification on the records themselves: what a posting covers is named by a digest of its content from here on.
    ids = hits.select("id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = space.write(records.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"]), "found")
    asked = found.join(hits.groupBy("id").agg(F.collect_list(F.struct("m", "a", "n")).alias("p")), "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (seq, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                digest = _content(seq, text)
                col = lambda c, t: pa.array([x[c] for x in p], t)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(p))), col("m", pa.int64()), pa.array([digest(x["a"], x["a"] + x["n"] + span - 1) for x in p], pa.binary()), col("a", pa.int32()), col("n", pa.int32())], ["id", "m", "e", "a", "n"])

    live = space.write(asked.select("id", "seq", "p").mapInArrow(verify, f"id {kind}, m bigint, e binary, a int, n int"), "live")
    groups = live.groupBy("m", "e").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.struct("id", "a", "n")).alias("rep"))
    groups = space.write(groups, "groups")
    mixed = groups.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m")
    full = groups.where("lo <> hi").select("m", "e", F.lit(0).alias("from"), (F.col("rep.n") - 1).alias("to"))
    # Where contents differ under one k-gram, one posting of each content has its windows compared one by one.
    reps = groups.join(mixed, "m", "left_semi").groupBy("rep.id").agg(F.collect_list(F.struct("m", "e", F.col("rep.a").alias("a"), F.col("rep.n").alias("n"), "lo", "hi")).alias("reps"))
    asked = found.join(reps, "id").select("seq", "reps")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident = batch.schema.field(1).type.value_type.field("lo").type
            for seq, rep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest = _content(seq, text)
                n = np.array([r["n"] for r in rep])
                row = np.repeat(np.arange(len(rep)), n)
                rel = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = (np.array([r["a"] for r in rep])[row] + rel).tolist()
                col = lambda c, t: pa.array([r[c] for r in rep], t).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array([digest(i, i + span) for i in start], pa.binary()), col("m", pa.int64()), col("e", pa.binary()), pa.array(rel.astype(np.int32)), col("lo", ident), col("hi", ident)], ["h", "m", "e", "rel", "lo", "hi"])

    dense = space.write(asked.mapInArrow(windows, f"h binary, m bigint, e binary, rel int, lo {kind}, hi {kind}"), "windows")
    twice = dense.groupBy("h").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most").select("h")
    # Windows of contents that are shared as a whole are settled already.
    single = dense.where("lo = hi").join(twice, "h", "left_semi").select("m", "e", F.col("rel").alias("from"), F.col("rel").alias("to"))
    step = F.col("from") - F.row_number().over(_by_place("m", "e"))
    single = single.withColumn("island", step).groupBy("m", "e", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("island")
    marks = full.unionByName(single)
    covered = live.join(marks, ["m", "e"]).select("id", (F.col("a") + F.col("from")).cast("bigint").alias("s"), (F.col("a") + F.col("to") + span).cast("bigint").alias("t"))
    # Union of a record's stretches: each adds what lies beyond the furthest end before it.
    before = F.max("t").over(Window.partitionBy("id").orderBy("s", "t").rowsBetween(Window.unboundedPreceding, -1))
    added = covered.withColumn("done", F.coalesce(before, F.lit(-1))).select("id", F.greatest(F.lit(0), F.col("t") - F.greatest("s", "done")).alias("add"))
    return added.groupBy("id").agg(F.sum("add").cast("bigint").alias("shared_len"))


def _by_place(*cols: str):
    return Window.partitionBy(*cols).orderBy("from")
