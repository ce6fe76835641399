"""Pacing, deadlines and activity over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def daily(commits: DataFrame) -> DataFrame:
    c = commits.where("project_id is not null and commit_ts is not null")
    return c.groupBy("project_id", F.to_date("commit_ts").alias("day")).agg(F.count("*").alias("n_commits"), F.sum(F.coalesce("insertions", F.lit(0))).alias("lines_added"))


def pacing(commits: DataFrame) -> DataFrame:
    """Peak day (the earliest of equals), commits on it, mean per active day, days from first to last, active days."""
    d = daily(commits)
    return d.groupBy("project_id").agg(
        F.min_by("day", F.struct(-F.col("n_commits"), F.col("day"))).alias("peak_day"),
        F.max("n_commits").alias("peak_commits"),
        F.round(F.avg("n_commits"), 6).alias("per_active_day"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"),
        F.count("*").alias("active_days"),
    )


def zero_filled_weeks(commits: DataFrame) -> DataFrame:
    """Commits per project and week (from Sunday), weeks without commits included. Wrong clocks widen the range of a
    project, so weeks are generated per project from its own first and last."""
    c = commits.where("project_id is not null and commit_ts is not null").withColumn("week", F.date_sub(F.to_date("commit_ts"), F.dayofweek(F.to_date("commit_ts")) - 1))
    n = c.groupBy("project_id", "week").agg(F.count("*").alias("n"))
    span = n.groupBy("project_id").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    weeks = span.select("project_id", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    return weeks.join(n, ["project_id", "week"], "left").select("project_id", "week", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_commits"))


def with_deadline(commits: DataFrame, projects: DataFrame, courses: DataFrame) -> DataFrame:
    p = projects.select(F.col("id").alias("project_id"), "course_id").join(courses.select(F.col("id").alias("course_id"), "deadline"), "course_id", "left")
    return commits.join(p, "project_id", "left")


def flags(commits: DataFrame) -> DataFrame:
    """Timing of each commit against its deadline: hours before it (one place) and the band."""
    c = commits.where("deadline is not null and commit_ts is not null")
    return c.select("hash", "project_id", F.round(T.hours_before(F.col("commit_ts"), F.col("deadline")), 1).alias("hours"), T.timing(F.col("commit_ts"), F.col("deadline")).alias("timing"))


def last_days_share(commits: DataFrame, days: int = 3) -> DataFrame:
    """Share of a project's commits of some size that came in the last days before the deadline, or after it."""
    c = commits.where("deadline is not null and commit_ts is not null").withColumn("big", F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0)) >= 50)
    late = F.col("big") & (T.hours_before(F.col("commit_ts"), F.col("deadline")) <= 24 * days)
    r = c.groupBy("project_id").agg(F.count_if("big").alias("n_big"), F.count_if(late).alias("n_last"))
    share = F.col("n_last") / F.col("n_big")
    return r.where("n_big > 0").select("project_id", "n_big", "n_last", F.when(share >= 0.4, "rushed").when(share >= 0.2, "late push").otherwise("steady").alias("pace"))


def first_and_last(commits: DataFrame) -> DataFrame:
    w = Window.partitionBy("project_id", "author_id")
    c = commits.where("commit_ts is not null and author_id is not null")
    a, b = F.row_number().over(w.orderBy("commit_ts", "hash")), F.row_number().over(w.orderBy(F.desc("commit_ts"), F.desc("hash")))
    return c.withColumn("a", a).withColumn("b", b).where("a = 1 or b = 1").select("project_id", "author_id", "hash", (F.col("a") == 1).alias("is_first"), (F.col("b") == 1).alias("is_last"))
