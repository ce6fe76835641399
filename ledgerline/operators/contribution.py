"""Contribution shares, inequality, ownership and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import kept
from .hierarchy import roots


def canonical_map(authors: DataFrame) -> DataFrame:
    """author_id, root_id; an author whose chain never ends stands for itself."""
    return kept(authors, "author-roots", _canonical_map)


def _canonical_map(authors: DataFrame) -> DataFrame:
    r = roots(authors, "id", "canonical_author_id")
    return r.select(F.col("id").alias("author_id"), F.when(F.col("root_id") < 0, F.col("id")).otherwise(F.col("root_id")).alias("root_id"))


def folded(commits: DataFrame, canon: DataFrame) -> DataFrame:
    """Commits with the root of their author; an author that isn't listed stands for itself."""
    return commits.join(canon, "author_id", "left").withColumn("root_id", F.coalesce("root_id", "author_id"))


def gini(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """group, n, gini of value (4 places); 0 for one member or no sum. The rank is a window inside a group."""
    w = Window.partitionBy(group).orderBy(value, tie)
    x = F.col(value).cast("double")
    r = df.withColumn("i", F.row_number().over(w)).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("i") * x).alias("ix"), F.sum(x).alias("sx"))
    g = 2 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n")
    return r.select(group, F.col("n").cast("int").alias("n"), F.round(F.when((F.col("n") <= 1) | (F.col("sx") == 0), 0.0).otherwise(F.greatest(g, F.lit(0.0))), 4).alias("gini"))


def rollup(commits: DataFrame) -> DataFrame:
    """Commits, lines added and removed per project and folded author, with the share of the project's added lines."""
    c = commits.where("project_id is not null and root_id is not null")
    r = c.groupBy("project_id", "root_id").agg(F.count("*").alias("commit_count"), F.sum(F.coalesce("insertions", F.lit(0))).alias("lines_added"), F.sum(F.coalesce("deletions", F.lit(0))).alias("lines_removed"))
    total = F.sum("lines_added").over(Window.partitionBy("project_id"))
    return r.withColumn("share_pct", F.when(total > 0, F.round(100.0 * F.col("lines_added") / total, 6)).otherwise(0.0))


def lorenz(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """Running share of people and of value, from the smallest up."""
    w = Window.partitionBy(group).orderBy(value, tie)
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(group)
    return df.select(group, tie, F.row_number().over(w).alias("rank"), F.round(F.row_number().over(w) / F.count("*").over(whole), 6).alias("people_share"), F.round(F.sum(value).over(run) / F.sum(value).over(whole), 6).alias("value_share"))


def top_n(df: DataFrame, group: list[str] | str, n: int, *order: Column) -> DataFrame:
    groups = [group] if isinstance(group, str) else group
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)


def languages(changes: DataFrame) -> DataFrame:
    """Share of added lines per project and display language (one place), without those below 0.05 %."""
    x = changes.withColumn("language", T.language(F.col("filename"))).where("language is not null")
    x = x.groupBy("project_id", "language").agg(F.sum(F.coalesce("lines_added", F.lit(0))).alias("lines"))
    total = F.sum("lines").over(Window.partitionBy("project_id"))
    return x.withColumn("pct", F.round(100.0 * F.col("lines") / F.when(total > 0, total), 1)).where("pct > 0")


def tech_stack(changes: DataFrame, projects: DataFrame, n: int = 4) -> DataFrame:
    """The most frequent languages of a project, joined by commas; names of projects without files give a guess."""
    x = changes.withColumn("language", T.language(F.col("filename"))).where("language is not null").groupBy("project_id", "language").count()
    top = top_n(x, "project_id", n, F.desc("count"), F.col("language"))
    top = top.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "language"))), lambda s: s["language"]), ",").alias("stack"))
    name = F.lower("name")
    guess = F.when(name.rlike("react|web|node|js"), "JavaScript").when(name.rlike(r"structure|c\+\+|cpp|tree"), "C++").when(name.rlike("android|kotlin|mobile|app"), "Kotlin").otherwise("Python")
    return projects.select(F.col("id").alias("project_id"), "name").join(top, "project_id", "left").select("project_id", F.coalesce("stack", guess).alias("stack"))


def file_evidence(changes: DataFrame, n: int = 6) -> DataFrame:
    """Each author's most changed files of a project, with complexity and functions."""
    x = changes.where("filename is not null and root_id is not null").withColumn("path", T.path(F.col("filename")))
    x = x.groupBy("project_id", "root_id", "path").agg(F.count("*").alias("n_changes"), F.sum(F.coalesce("complexity_score", F.lit(0))).alias("complexity"), F.sum(F.coalesce("function_count", F.lit(0))).alias("functions"))
    return top_n(x, ["project_id", "root_id"], n, F.desc("n_changes"), F.desc("complexity"), F.col("path"))


def ownership(changes: DataFrame, n: int = 4) -> DataFrame:
    x = changes.where("filename is not null and root_id is not null").withColumn("folder", T.top_folder(F.col("filename")))
    return top_n(x.groupBy("project_id", "root_id", "folder").agg(F.count("*").alias("n_changes")), ["project_id", "root_id"], n, F.desc("n_changes"), F.col("folder"))


def coauthors_only(commits: DataFrame, authors: DataFrame) -> DataFrame:
    """Addresses in co-author trailers of a project that aren't those of its committing authors; automation left out."""
    named = commits.where("project_id is not null").select("project_id", F.explode(T.trailers(F.col("message"))).alias("t")).select("project_id", "t.name", "t.email")
    named = named.where(~T.is_bot(F.col("name"), F.col("email")) & (F.col("email") != ""))
    direct = commits.select("project_id", "author_id").distinct().join(authors.select(F.col("id").alias("author_id"), F.lower(F.trim("email")).alias("email")), "author_id").select("project_id", "email")
    return named.groupBy("project_id", "email").agg(F.min("name").alias("name"), F.count("*").alias("n_trailers")).join(direct, ["project_id", "email"], "left_anti")
