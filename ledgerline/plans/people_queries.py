"""Identity signals, samples, labels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import contribution as cb
from ..operators import identity as op
from ..operators import sampling as sm
from ..operators import scoring as sc
from ..operators import timeline as tl
from ..sources import tables as t
from . import sql as q


def _people(s: SparkSession, d: str) -> DataFrame:
    a = t.authors(s, d)
    return op.members(t.commits(s, d), a, cb.canonical_map(a))


def _deadlines(s: SparkSession, d: str) -> DataFrame:
    return tl.with_deadline(t.commits(s, d), t.projects(s, d), t.courses(s, d))


def _labels(s: SparkSession, d: str) -> DataFrame:
    # Repeated rows of a change don't alter what is asked of it, so no diff is shuffled.
    return sc.labels(t.commits(s, d), t.file_rows(s, d, "commit_hash", "filename", "raw_diff"))


def _rates(s: SparkSession, d: str) -> DataFrame:
    return sc.rates(_labels(s, d), _deadlines(s, d))


def bot_filter(s: SparkSession, d: str) -> DataFrame:
    a = t.authors(s, d)
    n, e = F.col("name"), F.col("email")
    return a.select("id", T.is_bot(n, e).alias("is_bot"), T.is_bot_extended(n, e).alias("is_bot_extended"))


def email_local_parts(s: SparkSession, d: str) -> DataFrame:
    return t.authors(s, d).select("id", T.mail_local(F.col("email")).alias("local"))


def name_tokens(s: SparkSession, d: str) -> DataFrame:
    return t.authors(s, d).select("id", T.plain_name(F.col("name")).alias("plain"), F.array_join(F.array_sort(T.name_tokens(F.col("name"))), " ").alias("tokens"))


def split_identity_pairs(s: SparkSession, d: str) -> DataFrame:
    return op.split_identities(_people(s, d))


def shared_accounts(s: SparkSession, d: str) -> DataFrame:
    return op.shared_accounts(t.authors(s, d))


def pushed_by_other(s: SparkSession, d: str) -> DataFrame:
    return op.pushed_by_other(t.commits(s, d), t.authors(s, d))


def cross_submission(s: SparkSession, d: str) -> DataFrame:
    return op.cross_submissions(t.commits(s, d), t.authors(s, d))


def team_kinds(s: SparkSession, d: str) -> DataFrame:
    return op.team_kinds(_people(s, d), cb.coauthors_only(t.commits(s, d), t.authors(s, d)))


def unmerged_issues(s: SparkSession, d: str) -> DataFrame:
    return op.unmerged_issues(t.issues(s, d), cb.canonical_map(t.authors(s, d)))


def issue_kinds(s: SparkSession, d: str) -> DataFrame:
    return t.issues(s, d).select("issue_id", "kind", "confidence").distinct().groupBy("kind", "confidence").agg(F.count("*").alias("n_issues"))


def sample_full(s: SparkSession, d: str) -> DataFrame:
    return t.commits(s, d).groupBy("project_id").agg(F.count("*").alias("n_commits"), F.count("commit_ts").alias("n_timed"))


def sample_stratified(s: SparkSession, d: str) -> DataFrame:
    return sm.stratified(_deadlines(s, d))


def sample_random_seeded(s: SparkSession, d: str) -> DataFrame:
    return sm.seeded(t.commits(s, d))


def sampling_stats(s: SparkSession, d: str) -> DataFrame:
    c = _deadlines(s, d)
    return sm.statistics(sm.stratified(c), c)


def commit_labels(s: SparkSession, d: str) -> DataFrame:
    return _labels(s, d)


def label_distributions(s: SparkSession, d: str) -> DataFrame:
    return sc.distributions(_labels(s, d))


def label_reliability(s: SparkSession, d: str) -> DataFrame:
    return sc.reliability(_labels(s, d))


def contributor_rates(s: SparkSession, d: str) -> DataFrame:
    return _rates(s, d)


def quality_score(s: SparkSession, d: str) -> DataFrame:
    r = _rates(s, d)
    return sc.scores(r, cb.gini(r, "project_id", "n_added", "author_id"))


def verdict_bands(s: SparkSession, d: str) -> DataFrame:
    return quality_score(s, d).groupBy("project_id", "band").agg(F.count("*").alias("n_authors"))


def verdict_rewrite(s: SparkSession, d: str) -> DataFrame:
    """The recommended actions of issues as free text, each given the band of its confidence."""
    i = t.issues(s, d).select("confidence", "recommended_action").distinct()
    new = F.when(F.col("confidence") == "high", "Poor").otherwise("Moderate")
    return i.select("confidence", "recommended_action", sc.rewritten(F.concat(F.lit("Low Risk - "), "recommended_action"), new, F.lit("No reason given.")).alias("verdict"))


def project_red_flags(s: SparkSession, d: str) -> DataFrame:
    return sc.red_flags(_rates(s, d), code_resurrection_exact(s, d))


def code_resurrection_exact(s: SparkSession, d: str) -> DataFrame:
    return sc.resurrections(t.file_rows(s, d, "commit_hash", "raw_diff"), t.commits(s, d))


QUERIES = {f.__name__: f for f in (bot_filter, email_local_parts, name_tokens, split_identity_pairs, shared_accounts, pushed_by_other, cross_submission, team_kinds, unmerged_issues, issue_kinds, sample_full, sample_stratified, sample_random_seeded, sampling_stats, commit_labels, label_distributions, label_reliability, contributor_rates, quality_score, verdict_bands, verdict_rewrite, project_red_flags, code_resurrection_exact)}

_PLAIN = "trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(coalesce({0}, '')), '[\u0300-\u036f]', '', 'g'), '" + T.MARKED + "', '" + T.PLAIN_ + "'), '[^a-z]+', ' ', 'g'), ' +', ' ', 'g'))"
_TOK = "list_distinct(list_filter(string_split(" + _PLAIN + ", ' '), lambda x: length(x) >= 2))"
_LOCAL = r"regexp_replace(case when contains(lower(trim(coalesce({0}, ''))), 'noreply') then regexp_replace(regexp_extract(lower(trim(coalesce({0}, ''))), '^([^@]*)', 1), '^\d+\+', '') else regexp_extract(regexp_extract(lower(trim(coalesce({0}, ''))), '^([^@]*)', 1), '^([^+]*)', 1) end, '[^a-z0-9]', '', 'g')"
_BOT = "(contains(lower(coalesce(name, '')), '[bot]') or contains(lower(coalesce(email, '')), '[bot]'))"
_rx = lambda r: f"(regexp_matches(lower(coalesce(name, '')), '{r}') or regexp_matches(lower(coalesce(email, '')), '{r}'))"
_PEOPLE = f"{q.FOLD}, {q.A}, pe as (select distinct cr.project_id, a.*, cr.root_id from cr join a on a.id = cr.author_id where cr.project_id is not null)"
_SPLIT = f"""{_PEOPLE}, x as (select project_id, id, root_id, {_PLAIN.format('name')} as plain, {_TOK.format('name')} as toks, {_LOCAL.format('email')} as loc, contains(lower(coalesce(email, '')), 'noreply') as hid from pe),
o as (select a.project_id, least(a.root_id, b.root_id) as root_a, greatest(a.root_id, b.root_id) as root_b,
 a.plain <> '' and a.plain = b.plain as c1,
 a.hid and length(a.loc) >= 3 and (contains(b.loc, a.loc) or list_contains(b.toks, a.loc)) as c2,
 len(list_filter(a.toks, lambda t: length(t) >= 4 and contains(b.loc, t))) > 0 as c3,
 len(list_filter(a.toks, lambda t: length(t) >= 6 and contains(b.loc, t))) > 0 as c3h,
 case when len(a.toks) = 0 or len(b.toks) = 0 then 0 else len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) end as j
 from x a join x b on a.project_id = b.project_id and a.root_id <> b.root_id),
g as (select project_id, root_a, root_b, bool_or(c1) as c1, bool_or(c2) as c2, bool_or(c3) as c3, bool_or(c3h) as c3h, max(j) as j from o group by all)
select project_id, root_a, root_b, case when c1 or c2 or c3h or j >= 0.75 then 'HIGH' else 'MEDIUM' end as confidence,
 array_to_string(list_filter([case when c2 then 'login' end, case when c1 then 'name' end, case when c3 then 'token' end, case when j >= 0.5 then 'tokens' end], lambda v: v is not null), ',') as checks from g where c1 or c2 or c3 or j >= 0.5"""
_STRIP = r"regexp_replace(coalesce(message, ''), '^\s+|\s+$', '', 'g')"
_STRAT = f"""{q.D}, s1 as (select *, count(*) over w as n, row_number() over (w order by commit_ts nulls first, hash) as x, row_number() over (w order by commit_ts desc nulls last, hash desc) as y, coalesce(insertions, 0) + coalesce(deletions, 0) as size from d where author_id is not null and project_id is not null window w as (partition by project_id, author_id)),
s2 as (select *, case when n <= 3 then 0 when x = 1 or y = 1 then 1 when coalesce((epoch_us(deadline) - epoch_us(commit_ts)) / 3.6e9 <= 48, false) then 2 end as early from s1),
s3 as (select *, row_number() over (partition by project_id order by (early is not null), size desc, hash) as big from s2),
s4 as (select *, case when early is not null then early when big <= 10 then 3 when coalesce(is_squash_suspected, false) then 4 when length({_STRIP}) < 15 then 5 end as r from s3),
s5 as (select *, sum(case when r is null then 1 else 0 end) over (partition by project_id, author_id) as lft, row_number() over (partition by project_id, author_id order by (r is not null), md5(hash || 's'), hash) as drawn from s4),
st as (select hash, project_id, cast(case when r is not null then r when drawn <= least(lft, greatest(1, ceil(lft * cast(0.1 as double)))) then 6 end as integer) as rule from s5)"""
_KIND = "case " + " ".join(f"when regexp_matches(lower(coalesce(message, '')), '{p}') then '{k}'" for k, p in sc.TYPES) + " else 'other' end"
_q = lambda x: x.replace("'", "''")
_LAB = f"""{q.C}, {q.changes('commit_hash', 'filename', 'raw_diff')}, fx as (select commit_hash, bool_or(regexp_matches(lower({q.PATH.format('filename')}), '(^|/)tests?/|test')) as has_test, bool_or(regexp_matches(lower({q.PATH.format('filename')}), '\\.(md|rst|txt)$|(^|/)docs?/')) as has_doc,
 max(case when regexp_matches(coalesce(raw_diff, ''), '{_q(sc.SECRET)}') then 3 when regexp_matches(coalesce(raw_diff, ''), '{_q(sc.UNSAFE)}') then 2 when regexp_matches(coalesce(raw_diff, ''), '{_q(sc.INJECTION)}') then 1 else 0 end) as risk from f group by commit_hash),
lb as (select hash, project_id, author_id, {_KIND} as type, case when coalesce(insertions, 0) + coalesce(deletions, 0) < 10 then 'trivial' when coalesce(insertions, 0) + coalesce(deletions, 0) < 100 then 'moderate' else 'substantial' end as substance, case when length({_STRIP}) < 15 then 'vague' else 'descriptive' end as quality, has_test, has_doc, risk from c left join fx on fx.commit_hash = c.hash),
lab as (select hash, project_id, author_id, type, substance, quality, case when (type = 'test' and not has_test) or (type = 'docs' and not has_doc) then 'mismatch' else 'consistent' end as consistency, case risk when 3 then 'hardcoded_secret' when 2 then 'unsafe_eval' when 1 then 'sql_injection' else 'none' end as security from lb)"""
_DIST = "lx as (select project_id, author_id, unnest(['type', 'substance', 'quality', 'consistency', 'security']) as dimension, unnest([type, substance, quality, consistency, security]) as label from lab where project_id is not null), ld as (select project_id, author_id, dimension, label, count(*) as n from lx where label <> 'none' and author_id is not null group by grouping sets ((project_id, author_id, dimension, label), (project_id, dimension, label)))"
_RATES = f"""{_LAB}, {q.P}, {q.K}, d as (select c.*, k.deadline from c left join p on p.id = c.project_id left join k on k.id = p.course_id),
rt as (select lab.project_id, lab.author_id, count(*) as n_commits, cast(sum(coalesce(insertions, 0) + coalesce(deletions, 0)) as bigint) as n_lines, cast(sum(coalesce(insertions, 0)) as bigint) as n_added,
 cast(count(*) filter (substance = 'substantial') as bigint) as n_substantial, cast(count(*) filter (substance = 'moderate') as bigint) as n_moderate, cast(count(*) filter (substance = 'trivial') as bigint) as n_trivial, cast(count(*) filter (quality = 'vague') as bigint) as n_vague, cast(count(*) filter (consistency = 'mismatch') as bigint) as n_mismatch, cast(count(*) filter (security <> 'none') as bigint) as n_security,
 cast(count(*) filter ((epoch_us(deadline) - epoch_us(commit_ts)) / 3.6e9 < 0) as bigint) as n_late, cast(count(*) filter ((epoch_us(deadline) - epoch_us(commit_ts)) / 3.6e9 between 0 and 48) as bigint) as n_near, bool_or(deadline is not null) as tracked
 from lab join d on d.hash = lab.hash where lab.project_id is not null and lab.author_id is not null group by all)"""
_SCORE = f"""{_RATES}, gi as (select project_id, round(case when n <= 1 or sx = 0 then 0 else greatest(2 * ix / (n * sx) - (n + 1) / n, 0) end, 4) as gini from (select project_id, count(*) as n, sum(i * x) as ix, sum(x) as sx from (select project_id, cast(n_added as double) as x, row_number() over (partition by project_id order by n_added, author_id) as i from rt) group by project_id)),
y as (select rt.*, gini, count(*) over w as members, sum(n_commits) over w as ac, sum(n_lines) over w as al, min(n_commits) over w as fewest from rt left join gi on gi.project_id = rt.project_id window w as (partition by rt.project_id)),
z as (select *, 100.0 / members as fair, 100.0 * n_commits / ac as cs, case when al > 0 then 100.0 * n_lines / al else 0 end as ls, n_substantial + n_moderate + n_trivial as rated, 100.0 * n_vague / ac as vg, 100.0 * n_mismatch / ac as mm from y),
v as (select project_id, author_id, members > 1 and (cs < fair / 2 or ls < fair / 2) as by_share, members > 1 and coalesce(gini, 0) >= 0.5 and n_commits = fewest as by_gini,
 cast(case when members <= 1 then 0 when greatest(cs, ls) / fair < 0.15 then 3 when greatest(cs, ls) / fair < 0.4 then 2 when greatest(cs, ls) / fair < 0.75 then 1 else 0 end as integer) as workload,
 cast(case when rated = 0 then 0 when n_trivial = rated then 6 when n_trivial / rated >= 0.75 then 3 when n_trivial / rated >= 0.5 then 1 else 0 end as integer) as meaningful,
 cast(case when vg > 50 then 3 when vg > 30 then 2 when vg > 10 then 1 else 0 end + case when mm > 30 then 4 when mm > 15 then 2 else 0 end + least(3, n_security) as integer) as quality,
 cast(case when tracked then least(2, n_late) else 0 end as integer) as timing from z),
sc as (select project_id, author_id, workload, meaningful, quality, timing, greatest(0, 10 - workload - meaningful - quality - timing) as score, by_share or by_gini as free_rider,
 array_to_string(list_filter([case when by_share then 'share' end, case when by_gini and not by_share then 'gini' end, case when meaningful = 6 then 'only_trivial' end, case when meaningful = 3 then 'mostly_trivial' end], lambda t: t is not null), ',') as flags from v),
sb as (select *, case when score >= 8 and not free_rider then 'High Quality' when score >= 5 then 'Moderate' else 'Poor' end as band from sc)"""
_RES = f"""rl as (select project_id, author_id, commit_ts, unnest(string_split(raw_diff, chr(10))) as l from f join c on c.hash = f.commit_hash where project_id is not null and author_id is not null and commit_ts is not null and raw_diff is not null),
gone as (select project_id, trim(substr(l, 2), ' ') as line, author_id, min(commit_ts) as ts from rl where l like '-%' and l not like '---%' and length(trim(substr(l, 2), ' ')) >= 20 group by all),
back as (select project_id, trim(substr(l, 2), ' ') as line, author_id, max(commit_ts) as ts from rl where l like '+%' and l not like '+++%' and length(trim(substr(l, 2), ' ')) >= 20 group by all),
res as (select g.project_id, cast(count(distinct g.line) as integer) as n_resurrected from gone g join back b on b.project_id = g.project_id and b.line = g.line where b.author_id <> g.author_id and b.ts > g.ts group by g.project_id)"""
ORACLES = {
    "bot_filter": f"with {q.A} select id, {_BOT} as is_bot, case when {_BOT} then true when {_rx(rules.KNOWN_BOTS)} then true when regexp_matches(lower(coalesce(email, '')), '{rules.PERSONAL_MAIL}') then false else {_rx(rules.BOT_WORD)} end as is_bot_extended from a",
    "email_local_parts": f"with {q.A} select id, {_LOCAL.format('email')} as local from a",
    "name_tokens": f"with {q.A} select id, {_PLAIN.format('name')} as plain, array_to_string(list_sort({_TOK.format('name')}), ' ') as tokens from a",
    "split_identity_pairs": _SPLIT,
    "shared_accounts": f"with {q.A}, n as (select id, list_distinct(list_filter(list_transform(list_concat([name], coalesce(cast(json(name_variants) as varchar[]), [])), lambda v: {_PLAIN.format('v')}), lambda v: v <> '')) as names from a) select id, cast(len(names) as integer) as n_names from n where len(names) >= 2",
    "pushed_by_other": f"with {q.C}, {q.A}, e as (select author_id, lower(trim(committer_email)) as committer, lower(trim(a.email)) as email from c join a on a.id = c.author_id where committer_email is not null and a.email is not null), n as (select author_id, email, committer, count(*) as n from e group by all), w as (select *, sum(n) over (partition by author_id) as total from n), r as (select author_id, cast(max(total) as bigint) as n_commits, cast(sum(n) as bigint) as n_other, arg_min(committer, (-n, committer)) as top_committer from w where committer <> email group by author_id) select * from r where n_commits >= 3 and n_other > 0.5 * n_commits",
    "cross_submission": f"with {q.C}, {q.A} select lower(trim(a.email)) as email, count(distinct project_id) as n_projects, min(project_id) as first_project, max(project_id) as last_project from c join a on a.id = c.author_id where project_id is not null and lower(trim(a.email)) <> '' group by 1 having count(distinct project_id) > 1",
    "team_kinds": _PEOPLE + r""", tr as (select project_id, lower(trim(regexp_extract(line, '<([^>]*)>', 1))) as email, regexp_extract(line, '(?i)co-authored-by:[ \t]*([^<]*?)[ \t]*<', 1) as name from (select project_id, unnest(regexp_extract_all(message, '(?i)co-authored-by:[ \t]*[^<\n]*?[ \t]*<[^>\n]*>')) as line from c where project_id is not null)), dr as (select distinct c.project_id, lower(trim(a.email)) as email from c join a on a.id = c.author_id where a.email is not null), sl as (select distinct tr.project_id, tr.email from tr left join dr on dr.project_id = tr.project_id and dr.email = tr.email where dr.email is null and tr.email <> '' and not contains(lower(tr.name), '[bot]') and not contains(tr.email, '[bot]')), n as (select project_id, count(distinct root_id) as n_people from pe group by 1), s as (select project_id, count(*) as n_silent from sl group by 1) select n.project_id, n_people, coalesce(n_silent, 0) as n_silent, case when n_people > 1 then 'team' when coalesce(n_silent, 0) > 0 then 'proxy' else 'solo' end as kind from n left join s on s.project_id = n.project_id""",
    "unmerged_issues": f"with recursive {q.TREE}, i as (select distinct issue_id, replace(lower(trim(kind)), '-', '_') as kind, author_ids from identity_issues), x as (select distinct issue_id, kind, author_id, root_id from (select issue_id, kind, unnest(author_ids) as author_id from i) join canon using (author_id)), m as (select issue_id, kind from x group by all having count(distinct author_id) >= 2 and count(distinct root_id) = 1) select distinct i.issue_id, i.kind from i left join m on m.issue_id = i.issue_id and m.kind = i.kind where m.issue_id is null",
    "issue_kinds": "select kind, confidence, count(*) as n_issues from (select distinct issue_id, replace(lower(trim(kind)), '-', '_') as kind, lower(trim(confidence)) as confidence from identity_issues) group by all",
    "sample_full": f"with {q.C} select project_id, count(*) as n_commits, count(commit_ts) as n_timed from c group by project_id",
    "sample_stratified": f"with {_STRAT} select * from st where rule is not null",
    "sample_random_seeded": f"with {q.C}, s1 as (select *, row_number() over (partition by project_id order by md5(hash || 's'), hash) as dr, count(*) over (partition by project_id) as pn, count(*) over w as n, row_number() over (w order by commit_ts nulls first, hash) as x, row_number() over (w order by commit_ts desc nulls last, hash desc) as y from c where author_id is not null and project_id is not null window w as (partition by project_id, author_id)), s2 as (select *, dr <= greatest(1, ceil(pn * cast(0.1 as double))) as taken from s1), s3 as (select *, sum(case when taken then 1 else 0 end) over (partition by project_id, author_id) as mine from s2) select hash, project_id from s3 where taken or n <= 3 or (mine = 0 and (x = 1 or y = 1))",
    "sampling_stats": f"with {_STRAT} select d.project_id, count(*) as n_sampled, cast(count(*) filter ((epoch_us(deadline) - epoch_us(commit_ts)) / 3.6e9 < 0) as bigint) as n_after_deadline, cast(count(*) filter ((epoch_us(deadline) - epoch_us(commit_ts)) / 3.6e9 between 0 and 48) as bigint) as n_within_48h, strftime(min(commit_ts), '%Y-%m-%d') as first_day, strftime(max(commit_ts), '%Y-%m-%d') as last_day from st join d on d.hash = st.hash where rule is not null group by d.project_id",
    "commit_labels": f"with {_LAB} select * from lab",
    "label_distributions": f"with {_LAB}, {_DIST} select * from ld",
    "label_reliability": f"with {_LAB}, {_DIST} select project_id, dimension, round(max(n) / sum(n), 6) as top_share, max(n) / sum(n) > 0.9 as low from ld where author_id is null group by all",
    "contributor_rates": f"with {_RATES} select * from rt",
    "quality_score": f"with {_SCORE} select * from sb",
    "verdict_bands": f"with {_SCORE} select project_id, band, count(*) as n_authors from sb group by all",
    "verdict_rewrite": "with i as (select distinct lower(trim(confidence)) as confidence, recommended_action from identity_issues) select confidence, recommended_action, case when confidence = 'high' then 'Poor' else 'Moderate' end || ' - ' || coalesce(nullif(trim(recommended_action), ''), case when recommended_action = '' then 'Low Risk -' else 'No reason given.' end) as verdict from i",
    "project_red_flags": f"with {_RATES}, {_RES}, s as (select rt.project_id, sum(n_commits) as n, sum(n_late) as la, sum(n_trivial) as tr, sum(n_vague) as va, sum(n_security) as se, sum(n_substantial) as su, bool_or(tracked) as tracked from rt group by 1) select s.project_id, array_to_string(list_filter([case when tracked and la > 0 then 'late' end, case when tr > 0.5 * n then 'trivial' end, case when va > 0.3 * n then 'vague' end, case when se > 0 then 'security' end, case when coalesce(n_resurrected, 0) > 0 then 'resurrection' end], lambda t: t is not null), ',') as flags, case when su > 0 or tr > 0 then round(su / greatest(tr, 1), 6) end as substantial_to_trivial from s left join res on res.project_id = s.project_id",
    "code_resurrection_exact": f"with {q.C}, {q.changes('commit_hash', 'raw_diff')}, {_RES} select * from res",
}
