"""Stratified samples of a project's commits, with reproducible chance: the order of a hash of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Shares of a group that are ranked apart: a window never holds more than one of them.
SALTS = 64


def top_rows(df: DataFrame, group: list[str], n: int, key: str, *order: Column) -> DataFrame:
    """The first n rows of every group, by way of the first n of its shares, so that a large group isn't one task."""
    salted = Window.partitionBy(*group, F.pmod(F.xxhash64(key), F.lit(SALTS))).orderBy(*order)
    some = df.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def drawn(df: DataFrame, group: list[str], quota: Column, key: str, seed: str) -> DataFrame:
    """The rows of every group with the smallest hashes of key and seed, ``quota`` of them (a column of the group).

    Hashes are counted by their first three digits; whole stretches below the quota are taken, and only the one in which
    it falls is ranked.
    """
    x = df.withColumn("_h", F.md5(F.concat(key, F.lit(seed)))).withColumn("_b", F.substring("_h", 1, 3))
    n = x.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(n.withColumn("_before", before).drop("_n"), [*group, "_b"]).withColumn("_quota", quota)
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    return x.where("_before < _quota").withColumn("_rank", F.col("_before") + rank).where("_rank <= _quota").drop("_h", "_b", "_before", "_quota", "_rank")


def _ends(c: DataFrame) -> DataFrame:
    """Per project and author the number of commits, the first and the last by time (unknown ones first), ties by hash."""
    at = F.struct(F.col("commit_ts").isNotNull().alias("known"), "commit_ts", "hash")
    return c.groupBy("project_id", "author_id").agg(F.count("*").alias("n"), F.min(at)["hash"].alias("first"), F.max(F.struct(F.col("commit_ts").isNotNull().alias("known"), "commit_ts", "hash"))["hash"].alias("last"))


def stratified(commits: DataFrame, pct: float = 0.1, seed: str = "s") -> DataFrame:
    """hash, project_id and the rule that took each commit.

    0 all of authors with up to three commits; 1 first and last of every author; 2 from 48 hours before the deadline on;
    3 the ten largest of the others; 4 suspected squashes; 5 vague messages; 6 a share of what is left of each author.
    Commits without author or project are left out. Ties are broken by hash.
    """
    group = ["project_id", "author_id"]
    c = commits.where("author_id is not null and project_id is not null")
    c = c.join(_ends(c), group)
    near = F.coalesce(T.hours_before(F.col("commit_ts"), F.col("deadline")) <= 48, F.lit(False))
    early = F.when(F.col("n") <= 3, 0).when((F.col("hash") == F.col("first")) | (F.col("hash") == F.col("last")), 1).when(near, 2)
    c = c.withColumn("early", early).withColumn("size", F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0)))
    large = top_rows(c.where("early is null"), ["project_id"], 10, "hash", F.desc("size"), F.col("hash")).select("hash", F.lit(True).alias("large"))
    c = c.join(large, "hash", "left")
    c = c.withColumn("rule", F.coalesce("early", F.when(F.col("large"), 3).when(F.coalesce("is_squash_suspected", F.lit(False)), 4).when(T.vague(F.col("message")), 5)))
    rest = c.where("rule is null").select("hash", *group)
    quota = rest.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(pct))).alias("quota"))
    taken = drawn(rest.join(quota, group), group, F.col("quota"), "hash", seed).select("hash", "project_id", F.lit(6).alias("rule"))
    return c.where("rule is not null").select("hash", "project_id", "rule").unionByName(taken)


def seeded(commits: DataFrame, pct: float = 0.1, seed: str = "s") -> DataFrame:
    """A share of every project's commits by chance; authors with up to three commits come whole, others at least once."""
    group = ["project_id", "author_id"]
    c = commits.where("author_id is not null and project_id is not null").select("hash", "commit_ts", *group)
    quota = c.groupBy("project_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(pct))).alias("quota"))
    taken = drawn(c.join(quota, "project_id"), ["project_id"], F.col("quota"), "hash", seed).select("hash", F.lit(True).alias("taken"), *group)
    mine = taken.groupBy(*group).agg(F.count("*").alias("mine"))
    c = c.join(_ends(c), group).join(mine, group, "left").join(taken.select("hash", "taken"), "hash", "left")
    ends = (F.col("hash") == F.col("first")) | (F.col("hash") == F.col("last"))
    return c.where(F.coalesce("taken", F.lit(False)) | (F.col("n") <= 3) | (F.col("mine").isNull() & ends)).select("hash", "project_id")


def statistics(sample: DataFrame, commits: DataFrame) -> DataFrame:
    """Of a sample per project: commits, those after the deadline, those in the 48 hours before it, first and last day."""
    j = sample.select("hash").join(commits, "hash")
    h = T.hours_before(F.col("commit_ts"), F.col("deadline"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return j.groupBy("project_id").agg(F.count("*").alias("n_sampled"), F.count_if(h < 0).alias("n_after_deadline"), F.count_if((h >= 0) & (h <= 48)).alias("n_within_48h"), day(F.min("commit_ts")).alias("first_day"), day(F.max("commit_ts")).alias("last_day"))
