"""Code tokens, searches, listings, ingest and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import listing as op
from ..operators import tokens as tk
from ..sources import ingest
from ..sources import tables as t
from ..streaming import streams
from ..streaming.session_timers import session_stream
from . import sql as q


def _added(s: SparkSession, d: str, pattern: str) -> DataFrame:
    f = t.file_rows(s, d, "filename", "raw_diff").where(F.col("filename").rlike(pattern) & F.col("raw_diff").isNotNull())
    lines = F.transform(F.filter(F.split("raw_diff", "\r?\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substr(x, F.lit(2)))
    return f.select("id", "filename", F.array_join(lines, "\n").alias("code"))


def script_tokens(s: SparkSession, d: str) -> DataFrame:
    x = tk.tokenize(_added(s, d, r"\.(js|jsx|ts|tsx)$"), "id", "filename", "code")
    return t.once(x.select("id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct(F.filter(F.transform("tokens", lambda x: x["ident"]), lambda x: x.isNotNull()))).alias("n_idents")), "id")


def python_tokens(s: SparkSession, d: str) -> DataFrame:
    x = tk.tokenize(_added(s, d, r"\.py$"), "id", "filename", "code")
    return t.once(x.select("id", F.size("tokens").alias("n_tokens")), "id")


def python_metrics(s: SparkSession, d: str) -> DataFrame:
    return t.once(tk.metrics(_added(s, d, r"\.py$"), "id", "code").where("complexity is not null"), "id")


def global_search(s: SparkSession, d: str) -> DataFrame:
    return op.search("ra", students=t.authors(s, d), projects=t.projects(s, d), commits=t.commits(s, d), courses=t.courses(s, d))


def availability_check(s: SparkSession, d: str) -> DataFrame:
    return op.availability(t.projects(s, d))


def student_directory(s: SparkSession, d: str) -> DataFrame:
    return op.directory(t.commits(s, d), t.authors(s, d))


def project_listing(s: SparkSession, d: str) -> DataFrame:
    """Projects with commits, people, last activity, whether their address is acceptable, and their sampling mode."""
    p, k = t.projects(s, d), t.courses(s, d).select(F.col("id").alias("course_id"), "default_sampling_mode")
    c = t.commits(s, d).groupBy("project_id").agg(F.count("*").alias("n_commits"), F.count_distinct("author_id").alias("n_authors"))
    j = p.join(k, "course_id", "left").join(c, F.col("id") == F.col("project_id"), "left")
    return j.select("id", T.git_url(F.col("git_url")).alias("url"), T.https_url(F.col("git_url")).alias("is_https"), F.coalesce("group_no", F.lit(rules.DEFAULT_GROUP)).alias("group_no"), F.lower(F.coalesce("sampling_mode", "default_sampling_mode", F.lit("sample"))).alias("mode"), F.coalesce("n_commits", F.lit(0)).cast("bigint").alias("n_commits"), F.coalesce("n_authors", F.lit(0)).cast("bigint").alias("n_authors"))


def projects_by_author(s: SparkSession, d: str) -> DataFrame:
    p = t.projects(s, d).select(F.col("id").alias("project_id"))
    c = t.commits(s, d).where("author_id is not null")
    return c.select("author_id", "project_id").distinct().join(p, "project_id", "left_semi").groupBy("author_id").agg(F.count("*").alias("n_projects"))


def authors_with_commits(s: SparkSession, d: str) -> DataFrame:
    return t.authors(s, d).join(t.commits(s, d).select(F.col("author_id").alias("id")), "id", "left_semi").select("id", "email")


def largest_commits(s: SparkSession, d: str) -> DataFrame:
    from ..operators.contribution import top_n

    c = t.commits(s, d).where("project_id is not null").withColumn("size", F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0)))
    return top_n(c, "project_id", 10, F.desc("size"), F.col("hash")).select("project_id", "hash", "size", "rank")


def repository_structure(s: SparkSession, d: str) -> DataFrame:
    f = t.file_changes(s, d, "commit_hash", "filename").join(t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id"), "commit_hash")
    return op.structure(f.where("filename is not null"), "project_id", "filename")


def readme_quality(s: SparkSession, d: str) -> DataFrame:
    return op.readme_quality(t.table(s, d, "documents").where("doc_type = 'readme'"), "doc_id", "text")


def incremental_sync(s: SparkSession, d: str) -> DataFrame:
    """Commits that a sync after the middle of the time range adds to those stored before it."""
    c = t.table(s, d, "commits").where("hash is not null")
    cut = F.lit("2024-10-01 00:00:00").cast("timestamp_ntz")
    return ingest.new_rows(c.where(F.col("synced_at") >= cut).select("hash", "project_id", "author_id"), c.where(F.col("synced_at") < cut), "hash")


def dedupe_commits(s: SparkSession, d: str) -> DataFrame:
    return t.commits(s, d).select("hash", "project_id", "author_id", "committer_email", F.date_format("synced_at", "yyyy-MM-dd HH:mm:ss").alias("synced"))


def author_upsert(s: SparkSession, d: str) -> DataFrame:
    return ingest.author_upsert(t.commits(s, d).where("commit_ts is not null"))


def mailmap_applied(s: SparkSession, d: str) -> DataFrame:
    """Addresses of merged authors mapped to those of their link, as a mailmap would."""
    a = t.authors(s, d)
    lines = a.join(a.select(F.col("id").alias("canonical_author_id"), F.col("email").alias("proper"), F.col("name").alias("proper_name")), "canonical_author_id").where("email is not null and proper is not null")
    m = ingest.mailmap(lines.select(F.concat("proper_name", F.lit(" <"), "proper", F.lit("> <"), "email", F.lit(">")).alias("value")))
    return ingest.apply_mailmap(a.select("id", "name", "email"), m, "email", "name")


def stream_daily_window(s: SparkSession, d: str) -> DataFrame:
    return streams.run_available(streams.daily_counts(streams.read_table_stream(s, d, "events"), "ts"), "stream-daily")


def stream_dedupe(s: SparkSession, d: str) -> DataFrame:
    c = streams.read_table_stream(s, d, "commits").select("hash", "project_id", "synced_at")
    return streams.run_available(streams.deduplicated(c, "hash", "synced_at", "60 days"), "stream-dedupe").select("hash", "project_id")


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream that its watermark has closed."""
    x = streams.run_available(session_stream(streams.read_table_stream(s, d, "events"), "user_id", "ts", 90), "stream-sessions")
    text = lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)
    return x.select("user_id", text("session_start"), text("session_end"), F.round("duration_s", 3).alias("duration_s"), "n_events")


QUERIES = {f.__name__: f for f in (script_tokens, python_tokens, python_metrics, global_search, availability_check, student_directory, project_listing, projects_by_author, authors_with_commits, largest_commits, repository_structure, readme_quality, incremental_sync, dedupe_commits, author_upsert, mailmap_applied, stream_daily_window, stream_dedupe, stream_sessions)}

_URL = r"lower(regexp_replace(regexp_replace(trim(coalesce(git_url, '')), '/+$', ''), '\.git$', ''))"
_IGN = "[" + ", ".join(repr(x) for x in rules.INSPECTOR_IGNORED) + "]"
ORACLES = {
    "global_search": f"with {q.C}, {q.A}, {q.P}, {q.K}, (s as (select 'student' as kind, cast(id as varchar) as key, name as label from a where name ilike '%ra%' or email ilike '%ra%' order by id limit 5))".replace("(s as (", "s as (").replace("limit 5))", "limit 5)") + ", j as (select 'project' as kind, cast(id as varchar) as key, name as label from p where name ilike '%ra%' or description ilike '%ra%' order by id limit 5), m as (select 'commit' as kind, hash as key, message as label from c where message ilike '%ra%' order by hash limit 5), u as (select 'course' as kind, cast(id as varchar) as key, name as label from k where name ilike '%ra%' order by id limit 3) select * from s union all select * from j union all select * from m union all select * from u",
    "availability_check": f"with {q.P}, x as (select course_id, id, 'name' as field, lower(trim(name)) as value from p union all select course_id, id, 'group', case when upper(trim(group_no)) <> 'G-00' then lower(trim(group_no)) end from p union all select course_id, id, 'url', {_URL} from p) select course_id, field, value, count(*) as n_projects, min(id) as first_id from x where value <> '' group by all having count(*) > 1",
    "student_directory": f"with {q.C}, {q.A} select lower(trim(a.email)) as email, min(a.name) as name, count(distinct project_id) as n_projects, count(*) as n_commits, cast(sum(coalesce(insertions, 0)) as bigint) as lines_added, cast(sum(coalesce(deletions, 0)) as bigint) as lines_removed from c join a on a.id = c.author_id where lower(trim(a.email)) <> '' group by 1",
    "project_listing": f"with {q.C}, {q.P}, {q.K}, n as (select project_id, count(*) as n_commits, count(distinct author_id) as n_authors from c group by 1) select p.id, {_URL} as url, coalesce(regexp_matches(trim(git_url), '(?i)^https://[^\\s-][^\\s]*$'), false) as is_https, coalesce(group_no, 'G-00') as group_no, lower(coalesce(sampling_mode, default_sampling_mode, 'sample')) as mode, coalesce(n_commits, 0) as n_commits, coalesce(n_authors, 0) as n_authors from p left join k on k.id = p.course_id left join n on n.project_id = p.id",
    "projects_by_author": f"with {q.C}, {q.P} select author_id, count(distinct project_id) as n_projects from c where author_id is not null and project_id in (select id from p) group by 1",
    "authors_with_commits": f"with {q.C}, {q.A} select id, email from a where id in (select author_id from c)",
    "largest_commits": f"with {q.C} select project_id, hash, size, rank from (select project_id, hash, coalesce(insertions, 0) + coalesce(deletions, 0) as size, cast(row_number() over (partition by project_id order by coalesce(insertions, 0) + coalesce(deletions, 0) desc, hash) as integer) as rank from c where project_id is not null) where rank <= 10",
    "repository_structure": f"with {q.C}, {q.changes('commit_hash', 'filename')}, x as (select distinct project_id, {q.PATH.format('filename')} as p from f join c on c.hash = f.commit_hash where filename is not null), y as (select project_id, p, case when contains(p, '/') then string_split(regexp_extract(p, '^(.*)/[^/]*$', 1), '/') else cast([] as varchar[]) end as ds from x where p <> ''), z as (select * from y where len(list_filter(ds, lambda v: starts_with(v, '.'))) = 0 and not list_has_any(ds, {_IGN})), e as (select distinct project_id, array_to_string(ds[1:i], '/') as dir from (select project_id, ds, unnest(range(1, len(ds) + 1)) as i from z)), g as (select project_id, count(*) as n_dirs, count(*) filter (not contains(dir, '/')) as n_top, bool_or(lower(regexp_extract(dir, '([^/]*)$', 1)) in {q.strings(rules.TEST_DIRS)}) as has_tests from e group by 1), tp as (select project_id, string_agg(dir, ',' order by dir) as top_dirs from (select project_id, dir, row_number() over (partition by project_id order by dir) as r from e where not contains(dir, '/')) where r <= 8 group by 1), n as (select project_id, count(*) as n_files from z group by 1) select n.project_id, n_files, coalesce(n_dirs, 0) as n_dirs, coalesce(top_dirs, '') as top_dirs, coalesce(has_tests, false) as has_tests, case when coalesce(n_top, 0) >= 3 or coalesce(has_tests, false) then 'high' when coalesce(n_top, 0) >= 1 then 'moderate' else 'flat' end as modularity from n left join g using (project_id) left join tp using (project_id)",
    "readme_quality": f"with r as (select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) / 1024.0 as kb from documents where doc_type = 'readme') select doc_id, round(cast(kb as double), 2) as size_kb, regexp_matches(lower(t), '{rules.README_SETUP}') as has_setup, regexp_matches(lower(t), '{rules.README_ARCHITECTURE}') as has_architecture, case when kb > 2 and regexp_matches(lower(t), '{rules.README_SETUP}') and regexp_matches(lower(t), '{rules.README_ARCHITECTURE}') then 9 when kb > 0.5 or regexp_matches(lower(t), '{rules.README_SETUP}') then 5 else 3 end as score from r",
    "incremental_sync": "select distinct hash, project_id, author_id from commits where hash is not null and synced_at >= '2024-10-01' and hash not in (select hash from commits where hash is not null and synced_at < '2024-10-01')",
    "dedupe_commits": f"with {q.C} select hash, project_id, author_id, committer_email, strftime(synced_at, '%Y-%m-%d %H:%M:%S') as synced from c",
    "author_upsert": f"with {q.C}, n as (select lower(trim(committer_email)) as email, trim(committer_name) as name, min(commit_ts) as since from c where commit_ts is not null and committer_email is not null and committer_name is not null group by 1, 2) select email, arg_min(name, (since, name)) as name, string_agg(name, '|' order by since, name) as variants from n group by email",
    "mailmap_applied": f"with {q.A}, m as (select lower(trim(x.email)) as ce, lower(trim(y.email)) as email, trim(y.name) as name from a x join a y on y.id = x.canonical_author_id where x.email is not null and y.email is not null) select a.id, coalesce(m.name, a.name) as name, coalesce(m.email, a.email) as email from a left join m on m.ce = lower(trim(a.email))",
    "stream_daily_window": "with e as (select date_trunc('day', ts) as day, ts from events where ts is not null) select strftime(day, '%Y-%m-%d') as day, count(*) as n from e group by e.day having e.day + interval 1 day <= (select max(ts) from events) - interval 1 day",
    "stream_sessions": "with e as (select user_id, date_trunc('millisecond', ts) as ts from events where user_id is not null and ts is not null), f as (select *, case when ts - lag(ts) over w <= interval 90 minute then 0 else 1 end as fresh from e window w as (partition by user_id order by ts)), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from f), h as (select user_id, min(ts) as a, max(ts) as b, count(*) as n from g group by user_id, s) select user_id, strftime(a, '%Y-%m-%d %H:%M:%S') as session_start, strftime(b, '%Y-%m-%d %H:%M:%S') as session_end, round((epoch_ms(b) - epoch_ms(a)) / 1000.0, 3) as duration_s, n as n_events from h where b + interval 90 minute < date_trunc('millisecond', (select max(ts) from events)) - interval 1 day",
    "stream_dedupe": "select hash, min(project_id) as project_id from commits group by hash",
}
