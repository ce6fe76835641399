"""Fingerprints and similarity of projects within courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import similarity as op
from ..runtime import kept_steps
from ..sources import tables as t
from . import sql as q

LIMITS = op.Limits(score=1.0, run_tokens=25, total_tokens=25, overlap=0.0)


def _fp(s: SparkSession, d: str) -> DataFrame:
    scope = t.projects(s, d).select(F.col("id").alias("project_id"), F.col("course_id").alias("scope"))
    return t.fingerprints(s, d).join(scope, "project_id")


def _compare(s: SparkSession, d: str) -> op.Comparison:
    return kept_steps(_fp(s, d), "comparison", lambda fp: op.compare(fp, LIMITS))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}0-9]+)"), F.lit(1)).alias("tokens"))


def kgram_hashes(s: SparkSession, d: str) -> DataFrame:
    x = _tokens(s, d).select("doc_id", F.explode_outer(op.gram_hashes(F.col("tokens"))).alias("h")).where("h is not null")
    return x.groupBy("doc_id").agg(F.count("*").alias("n_grams"), F.count_distinct("h").alias("n_distinct"), F.min("h").alias("least"), F.max("h").alias("most"))


def winnow_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return op.winnowed(_tokens(s, d).select("doc_id", op.gram_hashes(F.col("tokens")).alias("hashes")), "doc_id")


def candidate_pairs(s: SparkSession, d: str) -> DataFrame:
    return op.candidate_pairs(_fp(s, d), 3)


def protected_hashes(s: SparkSession, d: str) -> DataFrame:
    return op.protected_hashes(op.ordered(_fp(s, d)))


def stopword_hashes(s: SparkSession, d: str) -> DataFrame:
    fp = op.ordered(_fp(s, d))
    return op.stop_hashes(fp, op.protected_hashes(fp))


def match_runs(s: SparkSession, d: str) -> DataFrame:
    fp = op.ordered(_fp(s, d))
    r = op.runs(op.matched(fp, op.candidate_pairs(fp), "fidx"), LIMITS)
    return r.select("scope", "pa", "pb", "file_a", "line_a", "end_line_a", "file_b", "line_b", "end_line_b", F.col("n").alias("run_length"), F.round("overlap", 6).alias("overlap"))


def similarity_reports(s: SparkSession, d: str) -> DataFrame:
    return _compare(s, d).reports


def similarity_clusters(s: SparkSession, d: str) -> DataFrame:
    return op.clusters(_compare(s, d).reports, t.projects(s, d), least_score=0.0, least_size=2)


def cluster_pass2(s: SparkSession, d: str) -> DataFrame:
    c = _compare(s, d)
    return op.second_pass(c, op.clusters(c.reports, t.projects(s, d), least_score=0.0, least_size=2), op.Limits(score=0.0, run_tokens=15, total_tokens=15))


def comparison_coverage(s: SparkSession, d: str) -> DataFrame:
    return op.coverage(_compare(s, d).reports, t.projects(s, d))


def plagiarism_detail(s: SparkSession, d: str) -> DataFrame:
    r = _compare(s, d).reports
    status = r.select("pa", "pb", F.when((F.col("pa") + F.col("pb")) % 3 == 0, " Dismissed").otherwise("Confirmed").alias("status"))
    return op.plagiarism_detail(r, status)


def status_carry_over(s: SparkSession, d: str) -> DataFrame:
    r = _compare(s, d).reports
    old = r.where("pa % 2 = 0").select(F.col("pb").alias("project_a_id"), F.col("pa").alias("project_b_id"), F.lit("Confirmed").alias("status"))
    return op.carried_status(r.select("pa", "pb", "score"), old)


QUERIES = {f.__name__: f for f in (kgram_hashes, winnow_fingerprints, candidate_pairs, protected_hashes, stopword_hashes, match_runs, similarity_reports, similarity_clusters, cluster_pass2, comparison_coverage, plagiarism_detail, status_carry_over)}

_TOK = f"tk as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}0-9]+') as tokens from documents), gh as (select doc_id, case when len(tokens) >= {rules.K} then list_transform(range(1, len(tokens) - {rules.K} + 2), lambda i: cast('0x' || substr(sha256(array_to_string(tokens[i:i + {rules.K} - 1], '-')), 1, 15) as bigint)) else [] end as h from tk)"
_FP = f"{q.P}, fp0 as (select distinct on (fp.project_id, file_path, token_pos, hash_value) fp.project_id, p.course_id as scope, file_path, token_pos, hash_value, line_number, raw_ident from project_fingerprints fp join p on p.id = fp.project_id where file_path is not null and token_pos is not null and hash_value is not null order by fp.project_id, file_path, token_pos, hash_value, line_number nulls first, raw_ident nulls first), fp as (select *, row_number() over (partition by project_id, file_path order by token_pos, hash_value) - 1 as fidx, row_number() over (partition by project_id order by file_path, token_pos, hash_value) - 1 as pidx from fp0)"


def _cand(name: str, fp: str, least: int) -> str:
    return f"{name} as (select a.scope, a.project_id as pa, b.project_id as pb, count(*) as shared from (select distinct scope, project_id, hash_value from {fp}) a join (select distinct scope, project_id, hash_value from {fp}) b on a.scope = b.scope and a.hash_value = b.hash_value and a.project_id < b.project_id group by all having count(*) >= {least})"


def _match(name: str, fp: str, cand: str, idx: str) -> str:
    return f"{name} as (select *, ia - row_number() over (partition by scope, pa, pb, file_a, file_b, diag order by ia) as island from (select c.scope, pa, pb, a.file_path as file_a, b.file_path as file_b, a.hash_value, a.{idx} as ia, b.{idx} as ib, b.{idx} - a.{idx} as diag, a.line_number as line_a, b.line_number as line_b, a.raw_ident as ident_a, b.raw_ident as ident_b from {cand} c join {fp} a on a.scope = c.scope and a.project_id = c.pa join {fp} b on b.scope = c.scope and b.project_id = c.pb and b.hash_value = a.hash_value))"


def _runs(name: str, m: str, lim: op.Limits) -> str:
    return f"{name} as (select * from (select *, case when least(len(ids_a), len(ids_b)) = 0 then 100.0 else 100.0 * len(list_intersect(ids_a, ids_b)) / least(len(ids_a), len(ids_b)) end as overlap from (select scope, pa, pb, file_a, file_b, diag, island, count(*) as n, list(distinct hash_value) as hashes, min(line_a) as line_a, max(line_a) as end_line_a, min(line_b) as line_b, max(line_b) as end_line_b, coalesce(list(distinct ident_a) filter (ident_a is not null), []) as ids_a, coalesce(list(distinct ident_b) filter (ident_b is not null), []) as ids_b from {m} group by all)) where n * {lim.k} >= {lim.run_tokens} and (overlap >= {lim.overlap} or least(len(ids_a), len(ids_b)) = 0))"


def _evaluate(name: str, fp: str, m: str, r: str, lim: op.Limits) -> str:
    return f"""{name}_f as (select scope, project_id, file_path, count(distinct hash_value) as n from {fp} group by all), {name}_p as (select scope, project_id, count(distinct hash_value) as n from {fp} group by all),
{name}_c as (select m.scope, pa, pb, file_a, file_b, 100.0 * count(distinct hash_value) / least(any_value(a.n), any_value(b.n)) as pct from {m} m join {name}_f a on a.project_id = pa and a.file_path = file_a join {name}_f b on b.project_id = pb and b.file_path = file_b group by all),
{name}_b as (select scope, pa, pb, max(pct) as file_pct from {name}_c group by all), {name}_t as (select scope, pa, pb, cast(len(list_distinct(flatten(list(hashes)))) as integer) as surviving, count(*) as n_runs, max(n) as longest, avg(overlap) as overlap from {r} group by all),
{name} as (select t.scope, t.pa, t.pb, round(greatest(100.0 * surviving / least(a.n, b.n), file_pct), 6) as score, round(file_pct, 6) as file_pct, surviving, n_runs, longest * {lim.k} as longest_run_tokens, round(overlap, 6) as avg_overlap, case when round(greatest(100.0 * surviving / least(a.n, b.n), file_pct), 6) >= {rules.HIGH_CONFIDENCE} then 'HIGH' else 'MEDIUM' end as confidence from {name}_t t join {name}_b b0 on b0.pa = t.pa and b0.pb = t.pb and b0.scope = t.scope join {name}_p a on a.project_id = t.pa join {name}_p b on b.project_id = t.pb
 where least(a.n, b.n) >= 5 and round(greatest(100.0 * surviving / least(a.n, b.n), file_pct), 6) >= {lim.score} and longest * {lim.k} >= {lim.run_tokens} and surviving * {lim.k} >= {lim.total_tokens})"""


_PROT = f"{_FP}, {_cand('c0', 'fp', rules.MIN_SHARED)}, {_match('m0', 'fp', 'c0', 'pidx')}, pr as (select distinct scope, hash_value from m0 join (select scope, pa, pb, file_a, file_b, diag, island from m0 group by all having count(*) >= {rules.PROTECTED_RUN}) using (scope, pa, pb, file_a, file_b, diag, island))"
_STOP = f"{_PROT}, st as (select scope, hash_value, n from (select scope, hash_value, count(distinct project_id) as n from fp group by all) join (select scope, count(distinct project_id) as units from fp group by all) using (scope) where n > greatest(2, floor(units * cast({rules.STOP_SHARE} as double))) and (scope, hash_value) not in (select scope, hash_value from pr))"
_REP = f"{_STOP}, kp as (select scope, project_id, file_path, token_pos, hash_value, line_number, raw_ident, row_number() over (partition by project_id, file_path order by token_pos, hash_value) - 1 as fidx from fp where (scope, hash_value) not in (select scope, hash_value from st)), {_cand('c1', 'kp', rules.MIN_SHARED)}, {_match('m1', 'kp', 'c1', 'fidx')}, {_runs('r1', 'm1', LIMITS)}, {_evaluate('rep', 'kp', 'm1', 'r1', LIMITS)}"
_CLU = _REP + ", ed as (select pa as x, pb as y from rep union all select pb, pa from rep), reach(x, y) as (select x, y from ed union select reach.x, ed.y from reach join ed on reach.y = ed.x), co as (select x as node, least(x, min(y)) as component from reach group by x), cs as (select component, count(*) as size from co group by 1 having count(*) >= 2), mn as (select a.component, round(avg(score), 6) as avg_score from rep join co a on a.node = pa join co b on b.node = pb where a.component = b.component group by 1), clu as (select co.component as cluster, co.node as project_id, cast(row_number() over (partition by co.component order by created_at nulls last, co.node) as integer) as origin_rank, cast(size as integer) as size, avg_score from co join cs on cs.component = co.component join mn on mn.component = co.component left join p on p.id = co.node)"
_P2 = op.Limits(score=0.0, run_tokens=15, total_tokens=15)
_ENDS = "select pa as project_id, pb as other, score from rep union all select pb, pa, score from rep"
ORACLES = {
    "kgram_hashes": f"with {_TOK} select doc_id, count(*) as n_grams, count(distinct g) as n_distinct, min(g) as least, max(g) as most from (select doc_id, unnest(h) as g from gh) group by doc_id",
    "winnow_fingerprints": f"with {_TOK}, e as (select doc_id, unnest(h) as g, cast(unnest(range(0, len(h))) as integer) as pos from gh), w as (select doc_id, min((g, -pos)) over (partition by doc_id order by pos rows between current row and {rules.W - 1} following) as best, count(*) over (partition by doc_id order by pos rows between current row and {rules.W - 1} following) as n from e) select distinct doc_id, best[1] as hash_value, cast(-best[2] as integer) as pos from w where n = {rules.W}",
    "candidate_pairs": f"with {_FP}, {_cand('c0', 'fp', 3)} select * from c0",
    "protected_hashes": f"with {_PROT} select * from pr",
    "stopword_hashes": f"with {_STOP} select * from st",
    "match_runs": f"with {_FP}, {_cand('c0', 'fp', rules.MIN_SHARED)}, {_match('m0', 'fp', 'c0', 'fidx')}, {_runs('r0', 'm0', LIMITS)} select scope, pa, pb, file_a, line_a, end_line_a, file_b, line_b, end_line_b, n as run_length, round(overlap, 6) as overlap from r0",
    "similarity_reports": f"with {_REP} select * from rep",
    "similarity_clusters": f"with recursive {_CLU} select * from clu",
    "cluster_pass2": f"with recursive {_CLU}, {_cand('c2', 'fp', 1)}, pq as (select c2.scope, c2.pa, c2.pb from c2 join clu a on a.project_id = pa join clu b on b.project_id = pb and a.cluster = b.cluster where (c2.pa, c2.pb) not in (select pa, pb from rep)), {_match('m2', 'fp', 'pq', 'fidx')}, {_runs('r2', 'm2', _P2)}, {_evaluate('rp2', 'fp', 'm2', 'r2', _P2)} select * from rp2",
    "comparison_coverage": f"with {_REP}, ends as ({_ENDS}), fl as (select project_id, count(distinct other) as flagged from ends group by 1), nd as (select course_id, count(*) - 1 as required from p group by 1) select p.id as project_id, required, coalesce(flagged, 0) as flagged, case when required = 0 then 'none' when coalesce(flagged, 0) >= required then 'complete' when coalesce(flagged, 0) > 0 then 'partial' else 'pending' end as state from p join nd on nd.course_id = p.course_id left join fl on fl.project_id = p.id",
    "plagiarism_detail": f"with {_REP}, ends as ({_ENDS}) select project_id, count(*) as n_matches, max(score) as max_score, arg_min(other, (-score, other)) as partner from ends where (project_id + other) % 3 <> 0 group by 1",
    "status_carry_over": f"with {_REP} select pa, pb, score, case when pa % 2 = 0 then 'Confirmed' else 'Needs Review' end as status from rep",
}
