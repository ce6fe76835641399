"""Contribution, ownership, languages, timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import contribution as op
from ..operators import timeline as tl
from ..sources import tables as t
from . import sql as q


def _folded(s: SparkSession, d: str) -> DataFrame:
    return op.folded(t.commits(s, d), op.canonical_map(t.authors(s, d)))


def _changes(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Named columns of file changes with project and folded author; commits are the small side only by their key columns."""
    f = t.file_changes(s, d, "commit_hash", *cols)
    c = _folded(s, d).select(F.col("hash").alias("commit_hash"), "project_id", "root_id")
    return f.join(c, "commit_hash")


def _deadlines(s: SparkSession, d: str) -> DataFrame:
    return tl.with_deadline(t.commits(s, d), t.projects(s, d), t.courses(s, d))


def canonical_resolution(s: SparkSession, d: str) -> DataFrame:
    return op.canonical_map(t.authors(s, d))


def contribution_share(s: SparkSession, d: str) -> DataFrame:
    return op.rollup(_folded(s, d))


def contribution_gini(s: SparkSession, d: str) -> DataFrame:
    g = op.gini(op.rollup(_folded(s, d)), "project_id", "lines_added", "root_id")
    return g.select("project_id", F.col("n").alias("n_authors"), "gini", T.gini_status(F.col("gini")).alias("status"))


def gini_with_silent(s: SparkSession, d: str) -> DataFrame:
    """Inequality with a row of nothing for everyone who appears only in co-author trailers; none for lone authors."""
    r = op.rollup(_folded(s, d)).select("project_id", F.col("root_id").cast("string").alias("who"), "lines_added")
    silent = op.coauthors_only(t.commits(s, d), t.authors(s, d)).select("project_id", F.col("email").alias("who"), F.lit(0).cast("bigint").alias("lines_added"))
    g = op.gini(r.unionByName(silent), "project_id", "lines_added", "who")
    return g.select("project_id", F.col("n").alias("n_people"), F.when(F.col("n") > 1, F.col("gini")).alias("gini"))


def lorenz_curve(s: SparkSession, d: str) -> DataFrame:
    return op.lorenz(op.rollup(_folded(s, d)), "project_id", "commit_count", "root_id")


def share_bands(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    r = op.rollup(_folded(s, d)).withColumn("n", F.count("*").over(Window.partitionBy("project_id")))
    return r.select("project_id", "root_id", T.share_band(F.col("share_pct"), F.col("n")).alias("band"))


def language_distribution(s: SparkSession, d: str) -> DataFrame:
    f = t.file_changes(s, d, "commit_hash", "filename", "lines_added")
    c = t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id")
    x = op.languages(f.join(c, "commit_hash"))
    return x.select("project_id", "language", "lines")


def tech_stack_top4(s: SparkSession, d: str) -> DataFrame:
    f = t.file_changes(s, d, "commit_hash", "filename").join(t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id"), "commit_hash")
    return op.tech_stack(f, t.projects(s, d))


def file_evidence_top6(s: SparkSession, d: str) -> DataFrame:
    return op.file_evidence(_changes(s, d, "filename", "complexity_score", "function_count"))


def ownership_top4(s: SparkSession, d: str) -> DataFrame:
    return op.ownership(_changes(s, d, "filename"))


def ast_complexity_summary(s: SparkSession, d: str) -> DataFrame:
    f = t.file_changes(s, d, "commit_hash", "complexity_score", "function_count").join(t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id"), "commit_hash")
    r = f.groupBy("project_id").agg(F.round(F.avg("complexity_score"), 6).alias("avg_complexity"), F.sum(F.coalesce("function_count", F.lit(0))).alias("n_functions"))
    return r.withColumn("band", T.complexity_band(F.col("avg_complexity")))


def squash_suspects(s: SparkSession, d: str) -> DataFrame:
    c = t.commits(s, d)
    return c.groupBy("project_id").agg(F.count_if(T.squashed(F.col("insertions"), F.col("message"))).alias("n_squashed"), F.count_if("is_squash_suspected").alias("n_flagged"))


def blame_rollup(s: SparkSession, d: str) -> DataFrame:
    """Lines per project and address, from the blame maps."""
    f = t.file_changes(s, d, "commit_hash", "blame_snapshot").join(t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id"), "commit_hash")
    e = f.select("project_id", F.explode(F.from_json("blame_snapshot", "map<string,bigint>")).alias("email", "lines"))
    return e.groupBy("project_id", F.lower("email").alias("email")).agg(F.sum("lines").alias("n_lines"), F.count("*").alias("n_files"))


def kept_changes(s: SparkSession, d: str) -> DataFrame:
    """Lines of a commit in files that aren't ignored at ingest."""
    f = t.file_changes(s, d, "commit_hash", "filename", "lines_added", "lines_removed").where(~T.ingest_ignored(F.col("filename")))
    return f.groupBy("commit_hash").agg(F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"), F.count("*").alias("n_files"))


def file_collector_rules(s: SparkSession, d: str) -> DataFrame:
    f = t.file_changes(s, d, "filename").where("filename is not null").select(T.path(F.col("filename")).alias("path")).distinct()
    return f.where(T.compared(F.col("path"))).select("path", T.lookup(T.extension(F.col("path")), rules.GRAMMARS).alias("grammar"))


def branch_counts(s: SparkSession, d: str) -> DataFrame:
    """Commits per branch, with a branch that has none; branches are derived from the lines of a commit, as the tables have no branches."""
    c = t.commits(s, d).where("project_id is not null").select("project_id", F.explode(F.array(F.lit("main"), F.concat(F.lit("feature/"), (F.col("insertions") % 6).cast("string")))).alias("branch"))
    branches = c.select("project_id", "branch").distinct().unionByName(t.projects(s, d).select(F.col("id").alias("project_id"), F.lit("release/empty").alias("branch")))
    n = c.groupBy("project_id", "branch").agg(F.count("*").alias("n"))
    return branches.join(n, ["project_id", "branch"], "left").select("project_id", T.short_branch(F.col("branch")).alias("branch"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_commits"))


def coauthors_only(s: SparkSession, d: str) -> DataFrame:
    return op.coauthors_only(t.commits(s, d), t.authors(s, d)).select("project_id", "email", "n_trailers")


def pacing_summary(s: SparkSession, d: str) -> DataFrame:
    return tl.pacing(t.commits(s, d)).withColumn("peak_day", F.col("peak_day").cast("string"))


def commit_timeline_daily(s: SparkSession, d: str) -> DataFrame:
    return tl.daily(t.commits(s, d)).withColumn("day", F.col("day").cast("string"))


def activity_weekly_zero_filled(s: SparkSession, d: str) -> DataFrame:
    return tl.zero_filled_weeks(t.commits(s, d)).withColumn("week", F.col("week").cast("string"))


def activity_monthly(s: SparkSession, d: str) -> DataFrame:
    c = t.commits(s, d).where("commit_ts is not null")
    return c.groupBy(F.date_format("commit_ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_commits"), F.count_distinct("author_id").alias("n_authors"))


def late_commits(s: SparkSession, d: str) -> DataFrame:
    c = _deadlines(s, d).where("commit_ts > deadline and author_id is not null")
    return c.groupBy("project_id", "author_id").agg(F.count("*").alias("n_late"))


def timing_flags(s: SparkSession, d: str) -> DataFrame:
    return tl.flags(_deadlines(s, d)).groupBy("project_id", "timing").agg(F.count("*").alias("n_commits"), F.round(F.min("hours"), 1).alias("least_hours"))


def pacing_note(s: SparkSession, d: str) -> DataFrame:
    return tl.last_days_share(_deadlines(s, d))


def first_last_commits(s: SparkSession, d: str) -> DataFrame:
    return tl.first_and_last(t.commits(s, d))


QUERIES = {f.__name__: f for f in (canonical_resolution, contribution_share, contribution_gini, gini_with_silent, lorenz_curve, share_bands, language_distribution, tech_stack_top4, file_evidence_top6, ownership_top4, ast_complexity_summary, squash_suspects, blame_rollup, kept_changes, file_collector_rules, branch_counts, coauthors_only, pacing_summary, commit_timeline_daily, activity_weekly_zero_filled, activity_monthly, late_commits, timing_flags, pacing_note, first_last_commits)}

_ROLL = f"{q.FOLD}, r as (select project_id, root_id, count(*) as commit_count, cast(sum(coalesce(insertions, 0)) as bigint) as lines_added, cast(sum(coalesce(deletions, 0)) as bigint) as lines_removed from cr where project_id is not null and root_id is not null group by all)"
_GINI = "select {g}, n, case when n <= 1 or sx = 0 then 0 else greatest(2 * ix / (n * sx) - (n + 1) / n, 0) end as gini from (select {g}, count(*) as n, sum(i * x) as ix, sum(x) as sx from (select {g}, cast({v} as double) as x, row_number() over (partition by {g} order by {v}, {t}) as i from {f}) group by {g})"
_TRAIL = r"""tr as (select project_id, lower(trim(regexp_extract(line, '<([^>]*)>', 1))) as email, regexp_extract(line, '(?i)co-authored-by:[ \t]*([^<]*?)[ \t]*<', 1) as name from (select project_id, unnest(regexp_extract_all(message, '(?i)co-authored-by:[ \t]*[^<\n]*?[ \t]*<[^>\n]*>')) as line from c where project_id is not null)),
direct as (select distinct c.project_id, lower(trim(a.email)) as email from c join a on a.id = c.author_id where a.email is not null),
silent as (select project_id, email, count(*) as n_trailers from tr where email <> '' and not contains(lower(name), '[bot]') and not contains(email, '[bot]') and (project_id, email) not in (select project_id, email from direct where project_id is not null) group by all)"""
_F = lambda *c: q.changes("commit_hash", *c)
_LANG = q.case(rules.LANGUAGES, q.EXT.format("filename"))
_GLOB = "|".join("(" + g.replace(".", r"\.").replace("*", ".*") + ")" for g in rules.EXCLUDED_GLOBS)
ORACLES = {
    "canonical_resolution": f"with recursive {q.TREE} select author_id, root_id from canon",
    "contribution_share": _ROLL + " select *, case when sum(lines_added) over (partition by project_id) > 0 then round(100.0 * lines_added / sum(lines_added) over (partition by project_id), 6) else 0 end as share_pct from r",
    "contribution_gini": _ROLL + ", g as (" + _GINI.format(g="project_id", v="lines_added", t="root_id", f="r") + ") select project_id, cast(n as integer) as n_authors, round(gini, 4) as gini, case when round(gini, 4) < 0.3 then 'Low' when round(gini, 4) < 0.5 then 'Medium' else 'High' end as status from g",
    "gini_with_silent": _ROLL + f", {q.A}, {_TRAIL}, u as (select project_id, cast(root_id as varchar) as who, lines_added from r union all select project_id, email, 0 from silent), g as (" + _GINI.format(g="project_id", v="lines_added", t="who", f="u") + ") select project_id, cast(n as integer) as n_people, case when n > 1 then round(gini, 4) end as gini from g",
    "lorenz_curve": _ROLL + " select project_id, root_id, cast(row_number() over w as integer) as rank, round(row_number() over w / count(*) over (partition by project_id), 6) as people_share, round(sum(commit_count) over (w rows unbounded preceding) / sum(commit_count) over (partition by project_id), 6) as value_share from r window w as (partition by project_id order by commit_count, root_id)",
    "share_bands": _ROLL + ", s as (select *, case when sum(lines_added) over (partition by project_id) > 0 then round(100.0 * lines_added / sum(lines_added) over (partition by project_id), 6) else 0 end as pct, count(*) over (partition by project_id) as n from r) select project_id, root_id, case when abs(pct - 100 / n) / (100 / n) < 0.35 then 'good' when abs(pct - 100 / n) / (100 / n) < 0.65 then 'warning' else 'danger' end as band from s",
    "language_distribution": f"with {q.C}, {_F('filename', 'lines_added')}, x as (select project_id, {_LANG} as language, cast(sum(coalesce(lines_added, 0)) as bigint) as lines from f join c on c.hash = f.commit_hash group by all) select project_id, language, lines from (select *, sum(lines) over (partition by project_id) as total from x where language is not null) where round(100.0 * lines / total, 1) > 0",
    "tech_stack_top4": f"with {q.C}, {q.P}, {_F('filename')}, x as (select project_id, {_LANG} as language, count(*) as n from f join c on c.hash = f.commit_hash group by all), r as (select *, row_number() over (partition by project_id order by n desc, language) as rank from x where language is not null), s as (select project_id, string_agg(language, ',' order by rank) as stack from r where rank <= 4 group by project_id) select p.id as project_id, coalesce(stack, case when regexp_matches(lower(name), 'react|web|node|js') then 'JavaScript' when regexp_matches(lower(name), 'structure|c\\+\\+|cpp|tree') then 'C++' when regexp_matches(lower(name), 'android|kotlin|mobile|app') then 'Kotlin' else 'Python' end) as stack from p left join s on s.project_id = p.id",
    "file_evidence_top6": q.FOLD + f", {_F('filename', 'complexity_score', 'function_count')}, x as (select project_id, root_id, {q.PATH.format('filename')} as path, count(*) as n_changes, cast(sum(coalesce(complexity_score, 0)) as bigint) as complexity, cast(sum(coalesce(function_count, 0)) as bigint) as functions from f join cr on cr.hash = f.commit_hash where filename is not null and root_id is not null group by all) select * from (select *, cast(row_number() over (partition by project_id, root_id order by n_changes desc, complexity desc, path) as integer) as rank from x) where rank <= 6",
    "ownership_top4": q.FOLD + f", {_F('filename')}, x as (select project_id, root_id, case when contains({q.PATH.format('filename')}, '/') then split_part({q.PATH.format('filename')}, '/', 1) else '(root)' end as folder, count(*) as n_changes from f join cr on cr.hash = f.commit_hash where filename is not null and root_id is not null group by all) select * from (select *, cast(row_number() over (partition by project_id, root_id order by n_changes desc, folder) as integer) as rank from x) where rank <= 4",
    "ast_complexity_summary": f"with {q.C}, {_F('complexity_score', 'function_count')}, r as (select project_id, round(avg(complexity_score), 6) as avg_complexity, cast(sum(coalesce(function_count, 0)) as bigint) as n_functions from f join c on c.hash = f.commit_hash group by project_id) select *, case when avg_complexity <= 5 then 'low' when avg_complexity <= 10 then 'moderate' when avg_complexity <= 20 then 'high' else 'very high' end as band from r",
    "squash_suspects": f"with {q.C} select project_id, cast(count(*) filter (coalesce(insertions, 0) > 1000 or contains(coalesce(message, ''), 'Co-authored-by:') or regexp_matches(trim(split_part(coalesce(message, ''), chr(10), 1)), '\\(#\\d+\\)$')) as bigint) as n_squashed, cast(count(*) filter (is_squash_suspected) as bigint) as n_flagged from c group by project_id",
    "blame_rollup": f"with {q.C}, {_F('blame_snapshot')}, e as (select project_id, blame_snapshot as j, unnest(json_keys(blame_snapshot)) as email from f join c on c.hash = f.commit_hash where blame_snapshot is not null) select project_id, lower(email) as email, cast(sum(cast(json_extract_string(j, '$.\"' || email || '\"') as bigint)) as bigint) as n_lines, count(*) as n_files from e group by project_id, lower(email)",
    "kept_changes": f"with {_F('filename', 'lines_added', 'lines_removed')} select commit_hash, cast(sum(lines_added) as bigint) as lines_added, cast(sum(lines_removed) as bigint) as lines_removed, count(*) as n_files from f where not coalesce(regexp_matches(filename, '{rules.INGEST_IGNORED}'), false) group by commit_hash",
    "file_collector_rules": f"with f as (select distinct {q.PATH.format('filename')} as path from file_changes where filename is not null), g as (select path, {q.BASE.format('path')} as b, {q.EXT.format('path')} as e, string_split(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '/') as ds from f) select path, {q.case(rules.GRAMMARS, 'e')} as grammar from g where e in {q.strings(rules.COMPARED_EXTENSIONS)} and lower(b) not in {q.strings(rules.EXCLUDED_FILES)} and not list_has_any(ds, [{', '.join(repr(x) for x in rules.EXCLUDED_DIRS)}]) and not regexp_full_match(lower(b), '{_GLOB}')",
    "branch_counts": f"with {q.C}, {q.P}, b as (select project_id, unnest(['main', 'feature/' || (insertions % 6)]) as branch from c where project_id is not null), n as (select project_id, branch, count(*) as n_commits from b group by all) select project_id, branch, n_commits from n union all select id, 'release/empty', 0 from p",
    "coauthors_only": f"with {q.C}, {q.A}, {_TRAIL} select * from silent",
    "pacing_summary": f"with {q.C}, d as (select project_id, cast(commit_ts as date) as day, count(*) as n from c where project_id is not null and commit_ts is not null group by all) select project_id, cast(arg_min(day, (-n, day)) as varchar) as peak_day, max(n) as peak_commits, round(avg(n), 6) as per_active_day, cast(max(day) - min(day) + 1 as integer) as span_days, count(*) as active_days from d group by project_id",
    "commit_timeline_daily": f"with {q.C} select project_id, cast(cast(commit_ts as date) as varchar) as day, count(*) as n_commits, cast(sum(coalesce(insertions, 0)) as bigint) as lines_added from c where project_id is not null and commit_ts is not null group by all",
    "activity_weekly_zero_filled": f"with {q.C}, w as (select project_id, cast(commit_ts as date) - cast(dayofweek(commit_ts) as integer) as week, count(*) as n from c where project_id is not null and commit_ts is not null group by all), s as (select project_id, cast(unnest(generate_series(min(week), max(week), interval 7 day)) as date) as week from w group by project_id) select s.project_id, cast(s.week as varchar) as week, coalesce(w.n, 0) as n_commits from s left join w on w.project_id = s.project_id and w.week = s.week",
    "activity_monthly": f"with {q.C} select strftime(commit_ts, '%Y-%m') as month, count(*) as n_commits, count(distinct author_id) as n_authors from c where commit_ts is not null group by 1",
    "late_commits": f"with {q.D} select project_id, author_id, count(*) as n_late from d where commit_ts > deadline and author_id is not null group by all",
    "timing_flags": f"with {q.D}, h as (select project_id, (epoch_us(deadline) - epoch_us(commit_ts)) / 3.6e9 as h from d where deadline is not null and commit_ts is not null) select project_id, case when h < 0 then 'after_deadline' when h <= 48 then 'before_deadline_close' else 'normal' end as timing, count(*) as n_commits, round(min(h), 1) as least_hours from h group by 1, 2",
    "pacing_note": f"with {q.D}, r as (select project_id, cast(count(*) filter (coalesce(insertions, 0) + coalesce(deletions, 0) >= 50) as bigint) as n_big, cast(count(*) filter (coalesce(insertions, 0) + coalesce(deletions, 0) >= 50 and (epoch_us(deadline) - epoch_us(commit_ts)) / 3.6e9 <= 72) as bigint) as n_last from d where deadline is not null and commit_ts is not null group by project_id) select project_id, n_big, n_last, case when n_last / n_big >= 0.4 then 'rushed' when n_last / n_big >= 0.2 then 'late push' else 'steady' end as pace from r where n_big > 0",
    "first_last_commits": f"with {q.C}, r as (select *, row_number() over (partition by project_id, author_id order by commit_ts, hash) as x, row_number() over (partition by project_id, author_id order by commit_ts desc, hash desc) as y from c where commit_ts is not null and author_id is not null) select project_id, author_id, hash, x = 1 as is_first, y = 1 as is_last from r where x = 1 or y = 1",
}
