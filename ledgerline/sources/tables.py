"""The project's tables, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Commits once per hash; of the times a commit was synced, the latest row that still names its committer."""
    c = table(spark, d, "commits").where("hash is not null")
    best = F.max(F.struct(F.col("committer_email").isNotNull().alias("named"), "synced_at", "project_id", "author_id", "commit_ts", "message", "insertions", "deletions", "is_squash_suspected", "committer_email", "committer_name"))
    return c.groupBy("hash").agg(best.alias("r")).select("hash", "r.project_id", "r.author_id", "r.commit_ts", "r.message", "r.insertions", "r.deletions", "r.is_squash_suspected", "r.committer_email", "r.committer_name", "r.synced_at")


def _one(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One whole row per key: the smallest by its values in this order, nulls first."""
    return df.groupBy(*key).agg(F.min(F.struct(*values)).alias("_r")).select(*key, *(F.col(f"_r.{v}").alias(v) for v in values))


def authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").where("id is not null").transform(_one, ["id"], ["name", "email", "name_variants", "canonical_author_id"])


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").where("id is not null").dropDuplicates(["id"])


def courses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "courses").where("id is not null").dropDuplicates(["id"])


def file_changes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Named columns of the file changes, each id once; a column that isn't named is never read.

    For short columns only, as they are shuffled: what is derived from a diff is derived from ``file_rows`` first.
    """
    cols = [c for c in columns if c != "id"]
    return _one(file_rows(spark, d, *cols), ["id"], cols)


def file_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Named columns of the file changes as delivered, an id perhaps more than once."""
    return table(spark, d, "file_changes").select("id", *columns).where("id is not null")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key of rows that are copies of one another."""
    return _one(df, [key], [c for c in df.columns if c != key])


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints once per place: a rescanned position counts once."""
    return table(spark, d, "project_fingerprints").where("project_id is not null and file_path is not null and token_pos is not null and hash_value is not null").transform(_one, ["project_id", "file_path", "token_pos", "hash_value"], ["line_number", "raw_ident"])


def issues(spark: SparkSession, d: str) -> DataFrame:
    kind = F.regexp_replace(F.lower(F.trim("kind")), "-", "_")
    return table(spark, d, "identity_issues").select("issue_id", "project_id", kind.alias("kind"), F.lower(F.trim("confidence")).alias("confidence"), "author_ids", "members", "recommended_action")
