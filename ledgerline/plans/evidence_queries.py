"""Evidence rows, summaries and upkeep of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import contribution as cb
from ..operators import evidence as op
from ..operators import similarity as sim
from ..operators import tokens as tk
from ..runtime import Workspace
from ..sources import ingest
from ..sources import tables as t
from . import contribution_queries as cq
from . import listing_queries as lq
from . import people_queries as pq
from . import similarity_queries as sq
from . import sql as q


def language_shares(s: SparkSession, d: str) -> DataFrame:
    f = t.file_changes(s, d, "commit_hash", "filename", "lines_added").join(t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id"), "commit_hash")
    lines = f.withColumn("language", T.language(F.col("filename"))).where("language is not null").groupBy("project_id", "language").agg(F.sum(F.coalesce("lines_added", F.lit(0))).alias("lines"))
    return op.language_shares(lines, cq.tech_stack_top4(s, d))


def branch_summary(s: SparkSession, d: str) -> DataFrame:
    """Per project its number of branches and the ten with most commits."""
    b = cq.branch_counts(s, d)
    top = cb.top_n(b, "project_id", 10, F.desc("n_commits"), F.col("branch"))
    total = b.groupBy("project_id").agg(F.count("*").alias("n_branches"))
    return top.join(total, "project_id").select("project_id", "branch", "n_commits", "rank", "n_branches")


def branch_filter(s: SparkSession, d: str) -> DataFrame:
    """Commits of the branch that is called feature/3, by its whole or its short name."""
    b = t.commits(s, d).where("project_id is not null").select("hash", "project_id", F.explode(F.array(F.lit("main"), F.concat(F.lit("origin/team/feature/"), (F.col("insertions") % 6).cast("string")))).alias("branch"))
    return b.where((F.col("branch") == "feature/3") | (T.short_branch(F.col("branch")) == "feature/3")).select("project_id", "hash")


def recent_commits(s: SparkSession, d: str) -> DataFrame:
    """The twenty newest commits of every project, newest first."""
    c = t.commits(s, d).where("project_id is not null and commit_ts is not null")
    return cb.top_n(c, "project_id", 20, F.desc("commit_ts"), F.col("hash")).select("project_id", "hash", "rank").orderBy("project_id", "rank")


def most_similar_project(s: SparkSession, d: str) -> DataFrame:
    return op.most_similar(sq._compare(s, d).reports, t.projects(s, d))


def plagiarism_blocks(s: SparkSession, d: str) -> DataFrame:
    c = sq._compare(s, d)
    runs = sim.runs(sim.matched(c.kept, c.reports.select("scope", "pa", "pb"), "fidx"), sq.LIMITS)
    return op.top_blocks(runs, c.reports, sim.clusters(c.reports, t.projects(s, d), least_score=0.0, least_size=2))


def _scored(s: SparkSession, d: str) -> DataFrame:
    a = t.authors(s, d)
    shares = op.human_shares(pq._rates(s, d), a.select(F.col("id").alias("author_id"), T.is_bot(F.col("name"), F.col("email")).alias("is_bot")))
    return shares.join(pq.quality_score(s, d).select("project_id", "author_id", "score", "free_rider", "band"), ["project_id", "author_id"])


def contributor_evidence(s: SparkSession, d: str) -> DataFrame:
    """Every human contributor with shares, counts, score and band, then the people whom only trailers name."""
    return op.with_silent(_scored(s, d), cb.coauthors_only(t.commits(s, d), t.authors(s, d)).select("project_id", "email"))


def human_bot_counts(s: SparkSession, d: str) -> DataFrame:
    a = t.authors(s, d).select(F.col("id").alias("author_id"), T.is_bot_extended(F.col("name"), F.col("email")).alias("bot"))
    c = t.commits(s, d).where("project_id is not null").select("project_id", "author_id").join(a, "author_id")
    per = c.groupBy("project_id", "author_id", "bot").agg(F.count("*").alias("n"))
    return per.groupBy("project_id").agg(F.count_if(~F.col("bot")).alias("n_humans"), F.count_if("bot").alias("n_bots"), F.sum("n").alias("n_commits"))


def commit_examples(s: SparkSession, d: str) -> DataFrame:
    return op.examples(pq._labels(s, d), pq._deadlines(s, d))


def peer_reviews(s: SparkSession, d: str) -> DataFrame:
    return op.peer_reviews(t.commits(s, d))


def tenant_projects(s: SparkSession, d: str) -> DataFrame:
    """Per user what belongs to them by their courses: projects, commits, authors."""
    p = t.projects(s, d).select(F.col("id").alias("project_id"), "course_id").join(t.courses(s, d).select(F.col("id").alias("course_id"), "user_id"), "course_id")
    c = t.commits(s, d).select("project_id", "hash", "author_id").join(p.select("project_id", "user_id"), "project_id", "right")
    return c.groupBy("user_id").agg(F.count_distinct("project_id").alias("n_projects"), F.count("hash").alias("n_commits"), F.count_distinct("author_id").alias("n_authors"))


def severity_bands(s: SparkSession, d: str) -> DataFrame:
    """Reports by the severity of their score."""
    return sq._compare(s, d).reports.groupBy(op.similarity_severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n_reports"))


def report_texts_parsed(s: SparkSession, d: str) -> DataFrame:
    """Figures read back from the texts that a report shows for quality."""
    x = pq.quality_score(s, d).select("project_id", "author_id", F.concat(F.col("score").cast("string"), F.lit("/10 ("), "band", F.lit(")")).alias("text"))
    return x.select("project_id", "author_id", op.quality_meta(F.col("text")).alias("m")).select("project_id", "author_id", "m.*")


def gini_texts_parsed(s: SparkSession, d: str) -> DataFrame:
    g = cq.contribution_gini(s, d)
    x = g.select("project_id", F.concat(F.format_string("%.4f", "gini"), F.when(F.col("project_id") % 2 == 0, F.concat(F.lit(" ("), "status", F.lit(")"))).otherwise("")).alias("text"))
    return x.select("project_id", op.gini_meta(F.col("text")).alias("m")).select("project_id", "m.*")


def contribution_summaries(s: SparkSession, d: str) -> DataFrame:
    """A sentence per contributor from the files changed, what substantial commits say, and their number."""
    files = cq.file_evidence_top6(s, d).groupBy("project_id", "root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "n_changes"))), lambda x: F.struct(x["path"].alias("path"), x["n_changes"].alias("n_changes"))).alias("files"))
    c = cq._folded(s, d).where("project_id is not null and root_id is not null").join(pq._labels(s, d).select("hash", "substance"), "hash")
    big = F.col("substance") == "substantial"
    rank = F.row_number().over(Window.partitionBy("project_id", "root_id", "substance").orderBy(F.asc_nulls_last("commit_ts"), "hash"))
    c = c.withColumn("r", rank).groupBy("project_id", "root_id").agg(F.count("*").alias("n"), F.count_if(big).alias("n_big"), F.array_sort(F.collect_list(F.when(big & (F.col("r") <= 3), F.struct("r", "message")))).alias("said"))
    j = c.join(files, ["project_id", "root_id"], "left")
    none = F.array().cast("array<struct<path:string,n_changes:bigint>>")
    sentence = op.contribution_sentence(F.coalesce("files", none), F.transform("said", lambda x: x["message"]), F.col("n_big"), F.col("n"))
    return j.select("project_id", F.col("root_id").alias("author_id"), sentence.alias("summary"))


def verdicts_reconciled(s: SparkSession, d: str) -> DataFrame:
    """Verdicts written for authors by name, brought in line with their bands; every third name carries the address."""
    a = t.authors(s, d).select(F.col("id").alias("author_id"), "name", "email").where("trim(name) <> ''")
    people = pq.quality_score(s, d).join(a, "author_id").select("project_id", "author_id", "name", "email", "band")
    said = people.groupBy("project_id", "name").agg(F.min(F.struct("author_id", "email")).alias("m")).select("project_id", F.when(F.col("m.author_id") % 3 == 0, F.concat(F.upper("name"), F.lit(" ("), "m.email", F.lit(")"))).otherwise(F.col("name")).alias("student_name"), F.lit("High Risk - steady work").alias("verdict"))
    silent = cb.coauthors_only(t.commits(s, d), t.authors(s, d)).select("project_id", "name")
    return op.reconciled(said, people.select("project_id", "name", "band"), silent)


def reports_filled(s: SparkSession, d: str) -> DataFrame:
    """Stored report rows of which every second lacks a section, completed from what is computed now."""
    stack, gini = cq.tech_stack_top4(s, d), cq.contribution_gini(s, d).select("project_id", F.col("status").alias("inequality"))
    now = stack.join(gini, "project_id", "left")
    stored = now.select("project_id", F.when(F.col("project_id") % 2 == 0, F.lit("as stored")).alias("stack"), F.when(F.col("project_id") % 3 == 0, F.lit("")).otherwise("as stored").alias("inequality"))
    return op.filled(stored, now, "project_id", ["stack", "inequality"])


def course_reset(s: SparkSession, d: str) -> DataFrame:
    """Rows left in every table once the projects of the first course are deleted with all that hangs on them."""
    p = t.projects(s, d)
    tables = {"projects": p, "commits": t.commits(s, d), "file_changes": t.file_changes(s, d, "commit_hash"), "project_fingerprints": t.fingerprints(s, d), "identity_issues": t.table(s, d, "identity_issues").select("issue_id", "project_id").distinct()}
    left = op.without_projects(tables, p.where(F.col("course_id") == 1).select("id"))
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def mode_updates(s: SparkSession, d: str) -> DataFrame:
    """Sampling modes after updates of which every third isn't valid."""
    p = t.projects(s, d).select("id", "sampling_mode")
    new = p.select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "everything").when(F.col("id") % 3 == 1, " FULL").otherwise("Random").alias("value"))
    return op.updated(p, "id", "sampling_mode", new, op.SAMPLING_MODES)


def status_updates(s: SparkSession, d: str) -> DataFrame:
    r = sq._compare(s, d).reports.select(F.concat_ws("-", "pa", "pb").alias("pair"), F.lit("Needs Review").alias("status"), "pa")
    new = r.select(F.col("pair").alias("key"), F.when(F.col("pa") % 2 == 0, "confirmed ").otherwise("closed").alias("value"))
    return op.updated(r.drop("pa"), "pair", "status", new, op.REPORT_STATES)


def fingerprints_replaced(s: SparkSession, d: str) -> DataFrame:
    """Stored fingerprints after those of every even project were replaced by its first hundred positions of each file."""
    space = Workspace(s, "replaced")
    fp = t.fingerprints(s, d).select("project_id", "file_path", "token_pos", "hash_value")
    path = f"{space.root}/stored"
    ingest.replace_partitions(fp, path, "project_id")
    ingest.replace_partitions(fp.where("project_id % 2 = 0 and token_pos < 100"), path, "project_id")
    stored = s.read.schema(fp.schema).parquet(path)
    return stored.groupBy("project_id").agg(F.count("*").alias("n_positions"), F.max("token_pos").alias("last_pos"))


def directory_tree(s: SparkSession, d: str) -> DataFrame:
    f = t.file_changes(s, d, "commit_hash", "filename").join(t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id"), "commit_hash")
    return op.tree_nodes(f.where("filename is not null and project_id is not null"), "project_id", "filename", rules.TREE_IGNORED)


def safe_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths of files as they would be opened; none for those that lead out of their directory."""
    f = t.file_changes(s, d, "filename").where("filename is not null").select("filename").distinct()
    return f.select("filename", op.safe_path(F.col("filename")).alias("opened"))


def stream_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all texts of a project as one stream, in order of their ids."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}0-9]+)"), F.lit(1))
    tokens = F.transform(words, lambda x: F.struct(x.alias("token"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("ident")))
    docs = t.table(s, d, "documents").select("project_id", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("file_path"), tokens.alias("tokens"))
    return sim.fingerprints_of(docs).select("project_id", "hash_value", "token_pos")


def code_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints of the code that a project's changes added, file by file and change by change."""
    code = lq._added(s, d, r"\.(py|js|jsx|ts|tsx)$")
    tokens = t.once(tk.tokenize(code, "id", "filename", "code"), "id")
    where = t.file_changes(s, d, "commit_hash", "filename").join(t.commits(s, d).select(F.col("hash").alias("commit_hash"), "project_id"), "commit_hash")
    files = tokens.join(where.select("id", "project_id", F.concat_ws("#", T.path(F.col("filename")), F.lpad(F.col("id").cast("string"), 12, "0")).alias("file_path")), "id")
    return sim.fingerprints_of(files)


def script_metrics(s: SparkSession, d: str) -> DataFrame:
    return t.once(tk.metrics(lq._added(s, d, r"\.(js|jsx|ts|tsx)$"), "id", "code", tk.script_metrics).where("complexity is not null"), "id")


QUERIES = {f.__name__: f for f in (language_shares, branch_summary, branch_filter, recent_commits, most_similar_project, plagiarism_blocks, contributor_evidence, human_bot_counts, commit_examples, peer_reviews, tenant_projects, severity_bands, report_texts_parsed, gini_texts_parsed, contribution_summaries, verdicts_reconciled, reports_filled, course_reset, mode_updates, status_updates, fingerprints_replaced, directory_tree, safe_paths, stream_fingerprints, code_fingerprints, script_metrics)}

_GINI_ALL = cq.ORACLES["contribution_gini"]
_SCORES = pq.ORACLES["quality_score"]
_ENDS = "select pa as id, pb as partner, score, surviving from rep union all select pb, pa, score, surviving from rep"
_SHARES = f"""hs as (select rt.*, count(*) over w as members, sum(n_commits) over w as ac, sum(n_lines) over w as al, min(n_commits) over w as least_commits from rt left join a on a.id = rt.author_id where not coalesce({pq._BOT}, false) window w as (partition by rt.project_id)),
ev as (select hs.project_id, hs.author_id, n_commits, n_lines, n_substantial, n_moderate, n_trivial, n_vague, n_mismatch, n_security, n_late, n_near, case when ac > 0 then round_even(100.0 * n_commits / ac, 1) else 0 end as commit_pct, case when al > 0 then round_even(100.0 * n_lines / al, 1) else 0 end as line_pct, round_even(100.0 / members, 1) as expected_pct, n_commits = least_commits as fewest, sb.score, sb.free_rider, sb.band from hs join sb on sb.project_id = hs.project_id and sb.author_id = hs.author_id)"""
_TREE = f"""with {q.C}, {q.changes('commit_hash', 'filename')}, x as (select distinct project_id, list_filter(string_split({q.PATH.format('filename')}, '/'), lambda v: v <> '') as ps from f join c on c.hash = f.commit_hash where filename is not null and project_id is not null),
y as (select * from x where len(ps) > 0 and len(list_filter(ps, lambda v: starts_with(v, '.'))) = 0 and not list_has_any(ps, [{', '.join(repr(x) for x in rules.TREE_IGNORED)}])),
z as (select project_id, ps, unnest(range(1, len(ps) + 1)) as i from y)
select project_id, array_to_string(ps[1:i], '/') as path, ps[i] as name, cast(i as integer) as depth, array_to_string(ps[1:i - 1], '/') as parent, case when bool_or(i < len(ps)) then 'directory' else 'file' end as kind from z group by all"""
ORACLES = {
    "language_shares": f"with {q.C}, {cq._F('filename', 'lines_added')}, x as (select project_id, {cq._LANG} as language, cast(sum(coalesce(lines_added, 0)) as bigint) as lines from f join c on c.hash = f.commit_hash group by all), y as (select *, sum(lines) over (partition by project_id) as total from x where language is not null), z as (select project_id, language, round_even(100.0 * lines / total, 1) as pct from y where total > 0), st as (" + cq.ORACLES["tech_stack_top4"].replace(f"with {q.C}, {q.P}, ", f"with {q.P}, ", 1) + ") select project_id, language, pct from z where pct > 0 union all select project_id, split_part(stack, ',', 1), 100.0 from st where project_id not in (select project_id from z where project_id is not null)",
    "branch_summary": "with bc as (" + cq.ORACLES["branch_counts"] + ") select * from (select project_id, branch, n_commits, cast(row_number() over (partition by project_id order by n_commits desc, branch) as integer) as rank, count(*) over (partition by project_id) as n_branches from bc) where rank <= 10",
    "branch_filter": f"with {q.C} select project_id, hash from c where project_id is not null and insertions % 6 = 3",
    "recent_commits": f"with {q.C} select * from (select project_id, hash, cast(row_number() over (partition by project_id order by commit_ts desc, hash) as integer) as rank from c where project_id is not null and commit_ts is not null) where rank <= 20",
    "most_similar_project": f"with {sq._REP}, ends as ({_ENDS}), b as (select *, row_number() over (partition by id order by score desc, partner) as r from ends) select p.id as project_id, b.score is not null as has_scan, case when b.score is null then 0 when b.score <= 1 then round_even(b.score * 100, 1) else round_even(b.score, 1) end as max_score, case when b.score is not null then coalesce(o.name, 'Project #' || partner) end as partner_name, cast(coalesce(surviving, 0) as integer) as n_hashes from p left join b on b.id = p.id and b.r = 1 left join p o on o.id = b.partner",
    "plagiarism_blocks": f"with recursive {sq._CLU}, tb as (select * from (select r1.*, rep.score, cast(row_number() over (partition by r1.scope, r1.pa, r1.pb order by n desc, file_a, line_a, file_b, line_b) as integer) as rank from r1 join rep on rep.scope = r1.scope and rep.pa = r1.pa and rep.pb = r1.pb) where rank <= 5), sd as (select pa as project_id, pb as partner, score, rank, file_a as own_file, line_a as own_line, file_b as other_file, line_b as other_line, n as run_length from tb union all select pb, pa, score, rank, file_b, line_b, file_a, line_a, n from tb) select sd.*, clu.cluster from sd left join clu on clu.project_id = sd.project_id",
    "contributor_evidence": f"with {pq._SCORE}, {q.A}, {_SHARES}, {cq._TRAIL} select * from ev union all select project_id, cast(-row_number() over (partition by project_id order by email) as integer), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, false, 0, false, 'Unverified' from silent",
    "human_bot_counts": f"with {q.C}, {q.A}, b as (select id, case when {pq._BOT} then true when {pq._rx(rules.KNOWN_BOTS)} then true when regexp_matches(lower(coalesce(email, '')), '{rules.PERSONAL_MAIL}') then false else {pq._rx(rules.BOT_WORD)} end as bot from a), x as (select project_id, author_id, bot, count(*) as n from c join b on b.id = c.author_id where project_id is not null group by all) select project_id, cast(count(*) filter (not bot) as bigint) as n_humans, cast(count(*) filter (bot) as bigint) as n_bots, cast(sum(n) as bigint) as n_commits from x group by project_id",
    "commit_examples": f"with {pq._LAB}, {q.P}, {q.K}, d as (select c.*, k.deadline from c left join p on p.id = c.project_id left join k on k.id = p.course_id), x as (select lab.project_id, lab.author_id, lab.hash, d.commit_ts, substance as kind from lab join d on d.hash = lab.hash where substance in ('substantial', 'trivial') and lab.project_id is not null and lab.author_id is not null union all select d.project_id, d.author_id, d.hash, d.commit_ts, 'late' from d where commit_ts > deadline and project_id is not null and author_id is not null) select * from (select project_id, author_id, kind, cast(row_number() over (partition by project_id, author_id, kind order by commit_ts nulls last, hash) as integer) as rank, hash from x) where rank <= 3 or kind = 'late'",
    "peer_reviews": f"with {q.C}, x as (select project_id, lower({pq._STRIP}) as m, row_number() over (partition by project_id, author_id order by commit_ts nulls last, hash) as r from c where project_id is not null and author_id is not null), y as (select project_id, case when regexp_matches(m, '{op.REASONED}') then 'constructive_review' when len(list_filter(regexp_split_to_array(m, '\\s+'), lambda v: v <> '')) <= 3 then 'rubber_stamp' else 'minor_feedback' end as kind from x where r = 1) select project_id, round_even(avg(case kind when 'constructive_review' then 8 when 'rubber_stamp' then 3 else 5 end), 1) as avg_score, count(*) as n_reviews, cast(count(*) filter (kind = 'constructive_review') as bigint) as n_constructive, cast(count(*) filter (kind = 'rubber_stamp') as bigint) as n_rubber_stamps from y group by project_id",
    "tenant_projects": f"with {q.C}, {q.P}, {q.K} select k.user_id, count(distinct p.id) as n_projects, count(c.hash) as n_commits, count(distinct c.author_id) as n_authors from p join k on k.id = p.course_id left join c on c.project_id = p.id group by k.user_id",
    "severity_bands": f"with {sq._REP} select case when score > 50 then 'danger' when score > 25 then 'warn' else 'ok' end as severity, count(*) as n_reports from rep group by 1",
    "report_texts_parsed": f"with qs as ({_SCORES}) select project_id, author_id, cast(score as integer) as score, case when score >= 8 then 'High' when score >= 5 then 'Moderate' else 'Poor' end as band, case when score >= 8 then 'ok' when score >= 5 then 'warn' else 'danger' end as severity from qs",
    "gini_texts_parsed": f"with g0 as ({_GINI_ALL}) select project_id, cast(gini as double) as value, case when project_id % 2 = 0 then status when gini < 0.3 then 'Balanced' when gini < 0.5 then 'Uneven' else 'Highly uneven' end as label, case when gini < 0.3 then 'ok' when gini < 0.5 then 'warn' else 'danger' end as severity from g0",
    "reports_filled": "with st as (" + cq.ORACLES["tech_stack_top4"] + f"), g0 as ({_GINI_ALL}) select st.project_id, case when st.project_id % 2 = 0 then 'as stored' else stack end as stack, case when st.project_id % 3 = 0 then g0.status else 'as stored' end as inequality from st left join g0 on g0.project_id = st.project_id",
    "course_reset": f"with {q.C}, {q.P}, gone as (select id from p where course_id = 1), {q.changes('commit_hash')}, fq as (select distinct project_id, file_path, token_pos, hash_value from project_fingerprints where project_id is not null and file_path is not null and token_pos is not null and hash_value is not null) select 'projects' as table_name, count(*) as n_rows from p where id not in (select id from gone) union all select 'commits', count(*) from c where project_id is null or project_id not in (select id from gone) union all select 'file_changes', count(*) from f where commit_hash not in (select hash from c where project_id in (select id from gone)) union all select 'project_fingerprints', count(*) from fq where project_id not in (select id from gone) union all select 'identity_issues', count(*) from (select distinct issue_id, project_id from identity_issues) where project_id is null or project_id not in (select id from gone)",
    "mode_updates": f"with {q.P} select id, case id % 3 when 0 then sampling_mode when 1 then 'full' else 'random' end as sampling_mode from p",
    "status_updates": f"with {sq._REP} select pa || '-' || pb as pair, case when pa % 2 = 0 then 'Confirmed' else 'Needs Review' end as status from rep",
    "fingerprints_replaced": "with fq as (select distinct project_id, file_path, token_pos, hash_value from project_fingerprints where project_id is not null and file_path is not null and token_pos is not null and hash_value is not null) select project_id, count(*) as n_positions, max(token_pos) as last_pos from fq where project_id % 2 <> 0 or token_pos < 100 or project_id not in (select project_id from fq where project_id % 2 = 0 and token_pos < 100) group by project_id",
    "directory_tree": _TREE,
    # Without a reduction over .. as in the query: a path with such a step inside its directory would differ here.
    "safe_paths": "with f as (select distinct filename, replace(filename, chr(92), '/') as p from file_changes where id is not null and filename is not null), g as (select filename, p, list_filter(string_split(p, '/'), lambda v: v not in ('', '.')) as ps from f) select filename, case when not starts_with(p, '/') and not regexp_matches(p, '^[A-Za-z]:') and not list_contains(ps, '..') and len(ps) > 0 then array_to_string(ps, '/') end as opened from g",
    "stream_fingerprints": f"with tk as (select project_id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}0-9]+') as ts from documents where project_id is not null), st as (select project_id, token, row_number() over (partition by project_id order by doc_id, i) - 1 as p from (select project_id, doc_id, unnest(ts) as token, unnest(range(1, len(ts) + 1)) as i from tk)), gr as (select project_id, p, list(token) over (partition by project_id order by p rows between current row and {rules.K - 1} following) as g from st), h as (select project_id, p, cast('0x' || substr(sha256(array_to_string(g, '-')), 1, 15) as bigint) as h from gr where len(g) = {rules.K}), w as (select project_id, min({{'h': h, 'p': -p}}) over o as b, count(*) over o as n from h window o as (partition by project_id order by p rows between current row and {rules.W - 1} following)) select distinct project_id, b.h as hash_value, -b.p as token_pos from w where n = {rules.W}",
}
