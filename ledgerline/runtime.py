"""Durable intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "ledgerline-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one if the master is local (tests).

    On a cluster an unset folder is an error: executors that each write to a disk of their own would lose rows.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/{LOCAL_DEFAULT}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def home(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/ledgerline/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_KEPT: dict[tuple, object] = {}
#: Results are kept only for inputs of at most so many files, as each is looked at before a result is taken again.
KEPT_FILES = 1_000


def _input_state(df: DataFrame) -> tuple | None:
    """What a plan reads and when it was written; None if that isn't a moderate number of files."""
    files = sorted(df.inputFiles())
    if not 0 < len(files) <= KEPT_FILES:
        return None
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for f in files:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        state.append((f, s.getModificationTime(), s.getLen()))
    return (spark.sparkContext.applicationId, df.semanticHash(), tuple(state))


def kept_steps(df: DataFrame, purpose: str, make: Callable[[DataFrame], object]) -> object:
    """make(df), whose tables are written ones, made once per application for a plan over unchanged files."""
    key = _input_state(df)
    if key is None:
        return make(df)
    if (purpose, key) not in _KEPT:
        _KEPT[purpose, key] = make(df)
    return _KEPT[purpose, key]


def kept(df: DataFrame, purpose: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(df), written once per application for a plan over unchanged files and read again by whoever asks for it next."""
    return kept_steps(df, purpose, lambda x: Workspace(x.sparkSession, purpose).write(make(x), "kept"))


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that were not written elsewhere go with them."""
    for t in spark.catalog.listTables():
        if t.name.startswith("ledgerline_run_"):
            spark.sql(f"drop table if exists {t.name}")
    remove(spark, home(spark))
    _KEPT.clear()


class Workspace:
    """Tables written once and read back, so that lineage ends there and lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{home(spark)}/{purpose}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, sort_by: list[str] | None = None, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        writer = (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("error").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, path: str) -> None:
        remove(self.spark, path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        self.forget(self._paths.pop(name))

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """Write a new version of ``name`` and remove the one before, which nothing reads any more."""
        old = self._paths.get(name)
        new = self.write(df, name)
        if old:
            self.forget(old)
        return new
