"""Streams over the project's tables: daily counts under a watermark, deduplication, incremental sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Workspace


def read_table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the project as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    # Written as a pattern, the path may be a folder of files or a single one.
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def run_available(df: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Process what is there, and give the written result as a table; progress and state live in the shared folder."""
    space = Workspace(df.sparkSession, purpose)
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{space.root}/progress").format("parquet").option("path", f"{space.root}/result").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{space.root}/result")


def daily_counts(events: DataFrame, ts: str, lateness: str = "1 day") -> DataFrame:
    """Events per day; a day comes out once the watermark has passed it."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return e.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def deduplicated(rows: DataFrame, key: str, ts: str, lateness: str = "30 days") -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def sync(stream: DataFrame, path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the rows whose key isn't stored; a repeated batch changes nothing."""
    from ..sources.ingest import new_rows

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        new_rows(batch, old, key).write.mode("append").parquet(path)

    return step
