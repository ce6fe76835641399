"""Queries for the general problems: sessions (1) and hierarchies (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import descendants, hierarchy
from ..operators.sessions import sessions


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    commits = spark.read.parquet(f"{d}/commits.parquet").select("hash", "author_id", "commit_ts")
    s = sessions(commits, "author_id", "commit_ts", 90, ident="hash")
    text = lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")
    return s.select("author_id", text("session_start").alias("session_start"), text("session_end").alias("session_end"), F.col("n_events").alias("n_commits"))


def p1_session_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per author: sessions, commits, seconds of work, longest session."""
    commits = spark.read.parquet(f"{d}/commits.parquet").select("hash", "author_id", "commit_ts")
    s = sessions(commits, "author_id", "commit_ts", 90, ident="hash")
    seconds = F.col("duration_s").cast("bigint")
    return s.groupBy("author_id").agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_commits"), F.sum(seconds).alias("work_s"), F.max(seconds).alias("longest_s"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    a = spark.read.parquet(f"{d}/authors.parquet").select("id", "canonical_author_id")
    return hierarchy(a, "id", "canonical_author_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).withColumnRenamed("id", "author_id")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_tree(spark, d), "id")


QUERIES = {"p1_found": p1_found, "p1_session_stats": p1_session_stats, "p6_found": p6_found, "p6_descendants": p6_descendants}

_SESSIONS = """
with e as (select distinct author_id, hash, commit_ts from commits where author_id is not null and commit_ts is not null),
f as (select *, case when commit_ts - lag(commit_ts) over (partition by author_id order by commit_ts, hash) <= interval 90 minute then 0 else 1 end as fresh from e),
g as (select *, sum(fresh) over (partition by author_id order by commit_ts, hash rows unbounded preceding) as s from f),
h as (select author_id, min(commit_ts) as a, max(commit_ts) as b, count(*) as n from g group by author_id, s)
"""
_TREE = """
with recursive n as (select id, min(canonical_author_id) as link from authors where id is not null group by id),
m as (select a.id, b.id as parent from n a left join n b on a.link = b.id),
up as (select id, id as root_id, 0 as depth, cast(id as varchar) as id_path from m where parent is null
       union all select m.id, up.root_id, up.depth + 1, up.id_path || '/' || m.id from m join up on m.parent = up.id),
anc as (select id, unnest(string_split(id_path, '/')) as a from up),
below as (select cast(a as integer) as id, count(*) - 1 as n from anc group by a)
"""
ORACLES = {
    "p1_found": _SESSIONS + "select author_id, strftime(a, '%Y-%m-%d %H:%M:%S') as session_start, strftime(b, '%Y-%m-%d %H:%M:%S') as session_end, cast(n as bigint) as n_commits from h",
    "p1_session_stats": _SESSIONS + "select author_id, count(*) as n_sessions, cast(sum(n) as bigint) as n_commits, cast(sum(floor((epoch_us(b) - epoch_us(a)) / 1000000.0)) as bigint) as work_s, cast(max(floor((epoch_us(b) - epoch_us(a)) / 1000000.0)) as bigint) as longest_s from h group by author_id",
    "p6_found": _TREE + "select m.id as author_id, coalesce(up.root_id, -1) as root_id, cast(coalesce(up.depth, -1) as integer) as depth, coalesce(up.id_path, '') as id_path, cast(case when up.id is null then -1 else coalesce(below.n, 0) end as integer) as n_descendants from m left join up on m.id = up.id left join below on below.id = m.id",
    "p6_descendants": _TREE + "select cast(u.a as integer) as ancestor, u.id as descendant, cast(len(string_split(p.id_path, '/')) - list_position(string_split(p.id_path, '/'), u.a) as integer) as distance from anc u join up p on p.id = u.id where cast(u.a as integer) <> u.id",
}
