"""Core operators on small inputs, and every query with SQL on the smallest tables."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import contribution, scoring, similarity, timeline, tokens
from ledgerline.operators.graph import connected
from ledgerline.sources import ingest

SF = "/root/testdata/sf0.001"


def test_gini(spark):
    df = spark.createDataFrame([(1, 3352, 1), (1, 1260, 2), (2, 5, 1), (3, 0, 1), (3, 0, 2)], "p int, v int, k int")
    assert {r.p: (r.n, r.gini) for r in contribution.gini(df, "p", "v", "k").collect()} == {1: (2, 0.2268), 2: (1, 0.0), 3: (2, 0.0)}


def test_scalars(spark):
    r = spark.sql("select 'A\\\\B/c.tar.GZ' as p, ' https://X.y/z.git/ ' as u, 'feature/a/b' as b, '12+Neo@users.noreply.example' as m, 'Élise  O''Brien-Ng' as n, 'x\\n\\nCo-Authored-By: Bo <B@x.y>' as t")
    row = r.select(T.path("p"), T.extension("p"), T.top_folder("p"), T.git_url("u"), T.short_branch("b"), T.mail_local("m"), T.plain_name("n"), T.trailers(F.col("t"))).first()
    assert list(row)[:7] == ["A/B/c.tar.GZ", ".gz", "A", "https://x.y/z", "a/b", "neo", "elise o brien ng"]
    assert [(x.name, x.email) for x in row[7]] == [("Bo", "b@x.y")]


def test_timing_is_strict(spark):
    d = datetime(2024, 1, 3)
    df = spark.createDataFrame([("a", 1, datetime(2024, 1, 3, 0, 0, 1), d), ("b", 1, datetime(2024, 1, 1), d), ("c", 1, datetime(2023, 12, 31, 23), d)], "hash string, project_id int, commit_ts timestamp_ntz, deadline timestamp_ntz")
    assert {r.hash: r.timing for r in timeline.flags(df).collect()} == {"a": "after_deadline", "b": "before_deadline_close", "c": "normal"}


def test_line_removed_by_two_authors(spark):
    """Who adds a line again was also the first to remove it; another author removed it in between."""
    a, b, c = (f"{x} = compute_the_total(items)" for x in "abc")
    day = lambda n: datetime(2024, 1, n)
    rows = [(1, 1, day(1), "-" + a), (1, 2, day(2), "-" + a), (1, 1, day(3), "+" + a), (1, 2, day(4), "+" + a)]
    rows += [(2, 1, day(1), "-" + a), (2, 2, day(2), "-" + a), (2, 1, day(3), "+" + a)]
    rows += [(3, 1, day(1), "-" + b), (3, 1, day(3), "+" + b), (3, 1, day(1), "-" + c), (3, 2, day(3), "-" + c), (3, 1, day(2), "+" + c)]
    commits = spark.createDataFrame([(str(i), *r[:3]) for i, r in enumerate(rows)], "hash string, project_id int, author_id int, commit_ts timestamp_ntz")
    changes = spark.createDataFrame([(str(i), r[3]) for i, r in enumerate(rows)] + [("0", rows[0][3]), ("x", "-" + a), ("1", None)], "commit_hash string, raw_diff string")
    assert {r.project_id: r.n_resurrected for r in scoring.resurrections(changes, commits).collect()} == {1: 1, 2: 1}


def test_connected(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)], "a int, b int")
    assert {r.node: r.component for r in connected(e, "a", "b").collect()} == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8}


def test_renaming_leaves_tokens_alone():
    a = "function add(a, b) { return a.total + b; } // sum"
    b = "function plus(x, y) { return x.total + y; }"
    assert [t[0] for t in tokens.script_tokens(a)] == [t[0] for t in tokens.script_tokens(b)]
    assert [t[0] for t in tokens.python_tokens("def f(x):\n    return x + 1")] == [t[0] for t in tokens.python_tokens("def g(y):\n    return y + 1")]
    assert tokens.python_tokens("def (") == [] and tokens.python_metrics("if x:\n    pass")[0] == 2
    assert tokens.script_tokens("x = `a\nb`")[-1][:2] == ("STR", 2)


def test_winnow_as_a_loop(spark):
    h = [77, 74, 42, 17, 98, 50, 17, 98, 8, 88, 67, 39, 77, 74, 42, 17, 98]
    df = spark.createDataFrame([(1, h), (2, h[:3])], "k int, hashes array<bigint>")
    want = {(1, h[p], p) for p in (max((i for i in range(s, s + 4) if h[i] == min(h[s : s + 4]))) for s in range(len(h) - 3))}
    assert {tuple(r) for r in similarity.winnowed(df, "k").collect()} == want


def test_copied_projects_are_reported(spark):
    rows = []
    for p in range(4):
        rows += [(1, p, "a.py", i, (1000 + i) if p < 3 else 5000 + i, i, f"v{i}") for i in range(40)]
        rows += [(1, p, "b.py", i, 10_000 * (p + 1) + i, i, None) for i in range(20)]
    fp = spark.createDataFrame(rows, "scope int, project_id int, file_path string, token_pos int, hash_value bigint, line_number int, raw_ident string")
    c = similarity.compare(fp, similarity.Limits(30.0, 60, 100))
    got = {(r.pa, r.pb): (r.score, r.n_runs, r.longest_run_tokens) for r in c.reports.collect()}
    assert got == {k: (100.0, 1, 200) for k in ((0, 1), (0, 2), (1, 2))}
    projects = spark.createDataFrame([(i, datetime(2024, 1, 5 - i)) for i in range(4)], "id int, created_at timestamp_ntz")
    g = similarity.clusters(c.reports, projects).collect()
    assert {(r.project_id, r.origin_rank) for r in g} == {(2, 1), (1, 2), (0, 3)}


def test_mailmap_and_sync(spark):
    lines = spark.createDataFrame([("# note",), ("Ann <A@x.y> <old@x.y>",), ("<b@x.y> <bb@x.y>",), ("broken",)], "value string")
    assert {tuple(r) for r in ingest.mailmap(lines).collect()} == {("old@x.y", "a@x.y", "Ann"), ("bb@x.y", "b@x.y", None)}
    new, old = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in ingest.new_rows(new, old, "k").collect()] == [1]
    links = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id int, canonical_author_id int")
    assert {r.id: r.canonical_author_id for r in ingest.checked_merge(links, 3, 2).collect()} == {1: None, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        ingest.checked_merge(links, 1, 2)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_queries_as_their_sql(spark):
    import __spark_entry__ as e
    from tests.oracle import compare

    queries, sql = e.queries(), e.oracle_sql()
    core = ["contribution_gini", "tech_stack_top4", "activity_weekly_zero_filled", "split_identity_pairs", "sample_stratified", "quality_score", "match_runs", "repository_structure", "author_upsert", "contributor_rows"]
    bad = {k: r for k in core if not (r := compare(spark, SF, k, queries[k], sql[k])).startswith("ok")}
    assert not bad
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_plans(spark):
    """No pair of sides without an equal key, and wide columns are read only where they are needed."""
    from ledgerline.plans import contribution_queries, people_queries

    for q in (contribution_queries.QUERIES["file_evidence_top6"], people_queries.QUERIES["pushed_by_other"], contribution_queries.QUERIES["late_commits"]):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "raw_diff" not in plan


def test_intermediate_tables_are_removed(spark):
    from pathlib import Path as P

    from ledgerline import runtime

    space = runtime.Workspace(spark, "x")
    df = space.write(spark.range(3), "t")
    assert df.count() == 3 and P(runtime.home(spark).removeprefix("file://")).exists()
    runtime.clean(spark)
    assert not P(runtime.home(spark).removeprefix("file://")).exists()
