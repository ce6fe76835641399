"""Rows and documents of a project's report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contribution as cb
from ..sources import tables as t
from . import contribution_queries as cq
from . import sql as q


def contributor_rows(s: SparkSession, d: str) -> DataFrame:
    """Every contributor of a project; people who are only named in co-author trailers follow with negative ids and nothing to their name."""
    r = cb.rollup(cq._folded(s, d)).select("project_id", F.col("root_id").alias("contributor_id"), "commit_count", "lines_added")
    a = t.authors(s, d).select(F.col("id").alias("contributor_id"), F.lower(F.trim("email")).alias("email"))
    silent = cb.coauthors_only(t.commits(s, d), t.authors(s, d))
    number = (-F.row_number().over(Window.partitionBy("project_id").orderBy("email"))).cast("int")
    silent = silent.select("project_id", number.alias("contributor_id"), F.lit(0).cast("bigint").alias("commit_count"), F.lit(0).cast("bigint").alias("lines_added"), "email")
    return r.join(a, "contributor_id", "left").select("project_id", "contributor_id", "commit_count", "lines_added", "email").unionByName(silent)


def project_risk(s: SparkSession, d: str) -> DataFrame:
    """Projects whose name or description holds "a", ordered by how unequal the work is."""
    g = cq.contribution_gini(s, d)
    p = t.projects(s, d).where(F.col("name").ilike("%a%") | F.coalesce(F.col("description").ilike("%a%"), F.lit(False)))
    risk = F.when(F.col("gini") >= 0.5, "high").when(F.col("gini") >= 0.3, "medium").otherwise("low")
    return p.select(F.col("id").alias("project_id"), "name").join(g, "project_id").select("project_id", "name", "gini", risk.alias("risk"))


def students_of_projects(s: SparkSession, d: str) -> DataFrame:
    """People with "ar" in name or address who committed to a project, by course."""
    p = t.projects(s, d).select(F.col("id").alias("project_id"), "course_id")
    ids = t.commits(s, d).select("project_id", F.col("author_id").alias("id")).distinct().join(p, "project_id").select("course_id", "id").distinct()
    return t.authors(s, d).where(F.col("name").ilike("%ar%") | F.coalesce(F.col("email").ilike("%ar%"), F.lit(False))).join(ids, "id").select("course_id", "id", "name")


def merged_aliases(s: SparkSession, d: str) -> DataFrame:
    """Root authors with the commits of all accounts merged into them."""
    c = cq._folded(s, d).where("root_id is not null")
    return c.groupBy("root_id").agg(F.count("*").alias("n_commits"), F.count_distinct("author_id").alias("n_accounts"))


def project_report_json(s: SparkSession, d: str) -> DataFrame:
    """One nested document per project: inequality, pace, languages and people."""
    g = cq.contribution_gini(s, d)
    lang = cq.language_distribution(s, d).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("lines")).alias("order"), "language", "lines"))).alias("l"))
    people = cb.top_n(cb.rollup(cq._folded(s, d)), "project_id", 10, F.desc("lines_added"), F.col("root_id")).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("rank", "root_id", "commit_count", "share_pct"))).alias("people"))
    j = g.join(lang, "project_id", "left").join(people, "project_id", "left").join(cq.pacing_summary(s, d), "project_id", "left")
    return j.select("project_id", F.to_json(F.struct("gini", "status", "peak_day", "span_days", F.transform("l", lambda x: F.struct(x["language"].alias("language"), x["lines"].alias("lines"))).alias("languages"), "people")).alias("report"))


def syntax_tree(s: SparkSession, d: str) -> DataFrame:
    """Nodes of the syntax trees of added Python code, by kind."""
    from ..operators.tokens import SyntaxTree
    from .listing_queries import _added

    s.udtf.register("ledgerline_syntax_tree", SyntaxTree)
    _added(s, d, r"\.py$").createOrReplaceTempView("ledgerline_code")
    return s.sql("select c.id, n.kind, count(*) as n_nodes, max(n.depth) as depth from ledgerline_code c, lateral ledgerline_syntax_tree(c.code) n group by c.id, n.kind")


def share_deviation(s: SparkSession, d: str) -> DataFrame:
    b = cq.share_bands(s, d)
    return b.groupBy("project_id", "band").agg(F.count("*").alias("n_authors"))


QUERIES = {f.__name__: f for f in (contributor_rows, project_risk, students_of_projects, merged_aliases, project_report_json, syntax_tree, share_deviation)}
ORACLES = {
    "contributor_rows": cq._ROLL + f", {q.A}, {cq._TRAIL} select r.project_id, r.root_id as contributor_id, commit_count, lines_added, lower(trim(a.email)) as email from r left join a on a.id = r.root_id union all select project_id, cast(-row_number() over (partition by project_id order by email) as integer), 0, 0, email from silent",
    "project_risk": cq._ROLL + f", {q.P}, g as (" + cq._GINI.format(g="project_id", v="lines_added", t="root_id", f="r") + ") select p.id as project_id, name, round(gini, 4) as gini, case when round(gini, 4) >= 0.5 then 'high' when round(gini, 4) >= 0.3 then 'medium' else 'low' end as risk from g join p on p.id = g.project_id where name ilike '%a%' or description ilike '%a%'",
    "students_of_projects": f"with {q.C}, {q.A}, {q.P} select distinct course_id, a.id, a.name from a join c on c.author_id = a.id join p on p.id = c.project_id where a.name ilike '%ar%' or a.email ilike '%ar%'",
    "merged_aliases": q.FOLD + " select root_id, count(*) as n_commits, count(distinct author_id) as n_accounts from cr where root_id is not null group by root_id",
    "share_deviation": cq.ORACLES["share_bands"].replace(" select project_id, root_id, case", ", b as (select project_id, root_id, case") + ") select project_id, band, count(*) as n_authors from b group by all",
}
