"""Searches, listings and checks over the project's entities; structure of file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def search(query: str, *, students: DataFrame, projects: DataFrame, commits: DataFrame, courses: DataFrame) -> DataFrame:
    """kind, key, label of what holds the words: up to 5 students, projects and commits, 3 courses; under two letters nothing."""
    like = f"%{query}%"

    def part(df: DataFrame, kind: str, key: str, label: str, on: list[str], n: int) -> DataFrame:
        hit = F.lit(False)
        for c in on:
            hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
        return df.where(hit if len(query) >= 2 else F.lit(False)).orderBy(key).limit(n).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(label).alias("label"))

    return part(students, "student", "id", "name", ["name", "email"], 5).unionByName(part(projects, "project", "id", "name", ["name", "description"], 5)).unionByName(part(commits, "commit", "hash", "message", ["message"], 5)).unionByName(part(courses, "course", "id", "name", ["name"], 3))


def availability(projects: DataFrame) -> DataFrame:
    """Groups, names or addresses of a course that more than one project claims, compared as they would be on entry."""
    forms = F.array(F.struct(F.lit("name").alias("field"), F.lower(F.trim("name")).alias("value")), F.struct(F.lit("group").alias("field"), F.when(F.upper(F.trim("group_no")) != rules.DEFAULT_GROUP, F.lower(F.trim("group_no"))).alias("value")), F.struct(F.lit("url").alias("field"), T.git_url(F.col("git_url")).alias("value")))
    x = projects.select("course_id", "id", F.explode(forms).alias("f")).select("course_id", "id", "f.field", "f.value").where("value <> ''")
    return x.groupBy("course_id", "field", "value").agg(F.count("*").alias("n_projects"), F.min("id").alias("first_id")).where("n_projects > 1")


def structure(files: DataFrame, key: str, path: str) -> DataFrame:
    """Per repository: files, directories, top directories (first eight), tests, modularity."""
    p = files.select(F.col(key).alias("k"), T.path(F.col(path)).alias("p")).where("p <> ''").distinct()
    parts = F.split(F.regexp_extract("p", r"^(.*)/[^/]*$", 1), "/")
    dirs = F.when(F.col("p").contains("/"), parts).otherwise(F.array().cast("array<string>"))
    p = p.withColumn("dirs", dirs).where(~F.exists("dirs", lambda x: x.startswith(".")) & ~F.arrays_overlap("dirs", F.array(*map(F.lit, rules.INSPECTOR_IGNORED))))
    every = p.select("k", F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size("dirs"), F.lit(1))), lambda i: F.array_join(F.slice("dirs", 1, i), "/"))).alias("dir"), F.size("dirs").alias("n")).where("n > 0").select("k", "dir").distinct()
    d = every.groupBy("k").agg(F.count("*").alias("n_dirs"), F.count_if(~F.col("dir").contains("/")).alias("n_top"), F.bool_or(F.lower(F.regexp_extract("dir", r"([^/]*)$", 1)).isin(rules.TEST_DIRS)).alias("has_tests"))
    top = every.where(~F.col("dir").contains("/")).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("dir"))).where("r <= 8").groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("dir")), ",").alias("top_dirs"))
    n = p.groupBy("k").agg(F.count("*").alias("n_files"))
    j = n.join(d, "k", "left").join(top, "k", "left")
    tests, tops = F.coalesce("has_tests", F.lit(False)), F.coalesce("n_top", F.lit(0))
    return j.select(F.col("k").alias(key), "n_files", F.coalesce("n_dirs", F.lit(0)).cast("bigint").alias("n_dirs"), F.coalesce("top_dirs", F.lit("")).alias("top_dirs"), tests.alias("has_tests"), F.when((tops >= 3) | tests, "high").when(tops >= 1, "moderate").otherwise("flat").alias("modularity"))


def readme_quality(texts: DataFrame, key: str, text: str) -> DataFrame:
    t = F.lower(F.coalesce(text, F.lit("")))
    kb = F.octet_length(F.coalesce(text, F.lit(""))) / 1024.0
    setup, arch = t.rlike(rules.README_SETUP), t.rlike(rules.README_ARCHITECTURE)
    return texts.select(key, F.round(kb, 2).alias("size_kb"), setup.alias("has_setup"), arch.alias("has_architecture"), F.when((kb > 2) & setup & arch, 9).when((kb > 0.5) | setup, 5).otherwise(3).alias("score"))


def directory(commits: DataFrame, authors: DataFrame) -> DataFrame:
    """People by address: projects, commits, lines; real deletions, not an estimate."""
    a = authors.select(F.col("id").alias("author_id"), F.lower(F.trim("email")).alias("email"), "name").where("email <> ''")
    return commits.join(a, "author_id").groupBy("email").agg(F.min("name").alias("name"), F.count_distinct("project_id").alias("n_projects"), F.count("*").alias("n_commits"), F.sum(F.coalesce("insertions", F.lit(0))).alias("lines_added"), F.sum(F.coalesce("deletions", F.lit(0))).alias("lines_removed"))
