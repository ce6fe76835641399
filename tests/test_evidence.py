"""Texts, verdicts and upkeep of reports; fingerprints of whole projects from code to score."""

import hashlib
import random

from pyspark.sql import functions as F

from ledgerline.operators import evidence as op
from ledgerline.operators import similarity as sim
from ledgerline.operators import tokens as tk


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_texts_of_a_report(spark):
    assert tuple(one(spark, op.quality_meta(F.lit("8/10 (High Quality)")))) == (8, "High", "ok")
    assert tuple(one(spark, op.quality_meta(F.lit(None).cast("string")))) == (5, "Moderate", "warn")
    assert tuple(one(spark, op.gini_meta(F.lit("0.42 (Uneven)")))) == (0.42, "Uneven", "warn")
    assert tuple(one(spark, op.gini_meta(F.lit("none")))) == (0.0, "Balanced", "ok")
    assert [one(spark, op.similarity_severity(F.lit(x))) for x in (51.0, 50.0, 25.5, None)] == ["danger", "warn", "warn", "ok"]


def test_contribution_sentence(spark):
    rows = [
        ([("src/a<b>.py", 2), ("x.py", 1), ("", 4)], ["Fix & test\nmore", "y" * 90, None], 2, 5),
        ([], [], 0, 3),
        ([], [], 0, 0),
    ]
    df = spark.createDataFrame(rows, "files array<struct<path:string,n_changes:bigint>>, said array<string>, big long, n long")
    got = [r.v for r in df.select(op.contribution_sentence(F.col("files"), F.col("said"), F.col("big"), F.col("n")).alias("v")).collect()]
    assert got == [
        "Changed src/a&lt;b&gt;.py (2 edits), x.py (1 edit); including Fix &amp; test; " + "y" * 77 + "...; 2 substantial commits sampled.",
        "Limited sampled detail (3 commit(s) recorded; see contribution share above).",
        "No sampled contribution detail available.",
    ]


def test_paths_stay_inside(spark):
    want = {"a/b.py": "a/b.py", "a/../b.py": "b.py", "./a//b": "a/b", "a\\b": "a/b", "../a": None, "a/../../b": None, "/etc/passwd": None, "C:\\x": None, "": None, "a/..": None}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.v for r in df.select("p", op.safe_path(F.col("p")).alias("v")).collect()} == want


def test_verdicts_are_reconciled(spark):
    said = spark.createDataFrame([(1, " ANA ", "High Risk - idle"), (1, "Bo (bo@x.example)", "Strong"), (1, "Cy", "good work"), (1, None, None)], "project_id int, student_name string, verdict string")
    people = spark.createDataFrame([(1, "Ana", "High Quality"), (1, "bo", "Poor"), (2, "Cy", "Poor")], "project_id int, name string, band string")
    silent = spark.createDataFrame([(1, "Di"), (1, "ana"), (2, "di")], "project_id int, name string")
    got = {(r.project_id, r.student_name): (r.verdict, r.quality_rank) for r in op.reconciled(said, people, silent).collect()}
    assert got[1, " ANA "] == ("High Quality - idle", 1) and got[1, "Bo (bo@x.example)"][0].startswith("Poor") and got[1, "Cy"] == ("good work", 1)
    assert got[1, "Di"] == got[2, "di"] == (op.CO_AUTHOR_VERDICT, 3) and len(got) == 6


def test_filled_and_updated(spark):
    stored = spark.createDataFrame([(1, "x", None), (2, "", "b"), (3, None, None)], "id int, a string, b string")
    now = spark.createDataFrame([(1, "n", "n"), (2, "n", "n")], "id int, a string, b string")
    assert sorted(tuple(r) for r in op.filled(stored, now, "id", ["a", "b"]).collect()) == [(1, "x", "n"), (2, "n", "b"), (3, None, None)]
    new = spark.createDataFrame([(1, " confirmed"), (2, "nonsense"), (3, None)], "key int, value string")
    assert sorted((r.id, r.a) for r in op.updated(stored, "id", "a", new, op.REPORT_STATES).collect()) == [(1, "Confirmed"), (2, ""), (3, None)]


def brute(files, k, w):
    stream = [(t, p) for p in sorted(files) for t in files[p]]
    h = [int(hashlib.sha256("-".join(t for t, _ in stream[i : i + k]).encode()).hexdigest()[:15], 16) for i in range(len(stream) - k + 1)]
    picked = set()
    for i in range(len(h) - w + 1):
        least = min(h[i : i + w])
        j = max(x for x in range(i, i + w) if h[x] == least)
        picked.add((h[j], j, stream[j][1]))
    return picked


def test_windows_cross_files_and_chunks(spark):
    rnd = random.Random(2)
    projects = {1: {f"f{i}.py": [rnd.choice("abcd") for _ in range(rnd.randrange(0, 9))] for i in range(12)}, 2: {"only.js": list("ab")}, 3: {}}
    rows = [(p, f, [(t, 1, None) for t in ts]) for p, fs in projects.items() for f, ts in fs.items()] + [(3, "n.py", None), (None, "x.py", [("a", 1, None)])]
    df = spark.createDataFrame(rows, "project_id int, file_path string, tokens array<struct<token:string,line:int,ident:string>>")
    for chunk in (7, 1000):
        got = {(r.project_id, r.hash_value, r.token_pos, r.file_path) for r in sim.fingerprints_of(df, 3, 4, chunk).collect()}
        assert got == {(p, *x) for p, fs in projects.items() for x in brute(fs, 3, 4)}


def program(rnd, names, n):
    out = []
    for i in range(n):
        a, b, c = (names[rnd.randrange(len(names))] for _ in range(3))
        out.append(rnd.choice([f"const {a} = {b} + {i % 7};", f"if ({a} > {b}) {{ return {c}; }}", f"for (let {a} = 0; {a} < {b}; {a}++) {{ {c}({a}); }}", f"{a} = [{b} * {c}];", f"while ({a} && !{b}) {{ {c} = {a} - 1; }}", f"function {a}({b}, {c}) {{ return {b} / {c}; }}"]))
    return "\n".join(out)


def test_copied_code_with_other_names_is_reported_at_the_default_limits(spark):
    """From code to report: two projects share a program, the others only its kinds of statements."""
    plain, other = [f"alpha{i}" for i in range(9)], [f"other{i}" for i in range(9)]
    rows = [(1, "a/x.js", program(random.Random(5), plain, 120)), (2, "b/y.js", program(random.Random(5), other, 120))]
    rows += [(p, f"m{p}.js", program(random.Random(50 + p), plain, 120)) for p in range(3, 6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, project_id int, path string, code string")
    tokens = tk.tokenize(df, "id", "path", "code").join(df, "id").select("project_id", F.col("path").alias("file_path"), "tokens")
    # Names differ, so the identifiers of the copies have nothing in common: the limit on their overlap is what lets them off.
    fp = sim.fingerprints_of(tokens).withColumn("scope", F.lit(1))
    assert sim.compare(fp).reports.where("pa = 1 and pb = 2").count() == 0
    same = fp.withColumn("raw_ident", F.regexp_replace("raw_ident", "^other", "alpha"))
    reports = {(r.pa, r.pb): r for r in sim.compare(same).reports.collect()}
    assert reports[1, 2].score > 95 and reports[1, 2].confidence == "HIGH" and reports[1, 2].score == max(r.score for r in reports.values())


def test_kept_results_follow_their_input(spark, tmp_path):
    from ledgerline import runtime

    made = []

    def make(df):
        made.append(1)
        return df.groupBy().agg(F.sum("id").alias("s"))

    path = str(tmp_path / "t")
    ask = lambda: runtime.kept(spark.read.parquet(path), "kept-test", make).first()["s"]
    spark.range(5).write.parquet(path)
    assert (ask(), ask(), len(made)) == (10, 10, 1)
    spark.range(6).write.mode("overwrite").parquet(path)
    assert (ask(), len(made)) == (15, 2)
    assert runtime.kept(spark.range(3), "kept-test", make).first()["s"] == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from ledgerline import runtime

    conf = SimpleNamespace(get=lambda *_: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(RuntimeError):
        runtime.shared_dir(fake)


def test_second_pass_finds_the_short_run_inside_a_cluster(spark):
    files = {1: list(range(100, 130)) + [7, 8, 9, 10], 2: list(range(100, 130)) + [1, 2] + list(range(200, 230)), 3: [7, 8, 9, 10] + list(range(200, 230)), 4: list(range(300, 340))}
    rows = [(1, p, "f", i, h, i, None) for p, hs in files.items() for i, h in enumerate(hs)]
    fp = spark.createDataFrame(rows, "scope int, project_id int, file_path string, token_pos int, hash_value bigint, line_number int, raw_ident string")
    projects = spark.createDataFrame([(i, i) for i in files], "id int, created_at int")
    c = sim.compare(fp, sim.Limits(10.0, 60, 60, 0.0))
    assert {(r.pa, r.pb) for r in c.reports.collect()} == {(1, 2), (2, 3)}
    groups = sim.clusters(c.reports, projects, least_score=0.0, least_size=3)
    assert {r.project_id for r in groups.collect()} == {1, 2, 3}
    found = sim.second_pass(c, groups, sim.Limits(0.0, 15, 15, 0.0)).collect()
    assert [(r.pa, r.pb, r.longest_run_tokens) for r in found] == [(1, 3, 20)]


def test_protected_runs_against_pairs(spark):
    """Shared stretches of ten against every pair of projects, with repeated hashes inside some runs."""
    rnd = random.Random(6)
    runs = [[rnd.randrange(1000, 9999) for _ in range(12)], [5, 5, 6, 6, 5, 5, 6, 6, 5, 5, 6]]
    files = {p: {f: sum((rnd.choice([*runs, [rnd.randrange(50)]]) for _ in range(rnd.randrange(2, 7))), []) for f in "ab"} for p in range(1, 7)}
    rows = [(p % 2, p, f, i, h, i, None) for p, fs in files.items() for f, hs in fs.items() for i, h in enumerate(hs)]
    fp = sim.ordered(spark.createDataFrame(rows, "scope int, project_id int, file_path string, token_pos int, hash_value bigint, line_number int, raw_ident string"))
    want = set()
    for p in files:
        for r in files:
            if p < r and p % 2 == r % 2 and len({h for x in files[p].values() for h in x} & {h for x in files[r].values() for h in x}) >= 10:
                for x in files[p].values():
                    for y in files[r].values():
                        grams = {tuple(y[j : j + 10]) for j in range(len(y) - 9)}
                        want |= {(p % 2, h) for i in range(len(x) - 9) if tuple(x[i : i + 10]) in grams for h in x[i : i + 10]}
    assert {(r.scope, r.hash_value) for r in sim.protected_hashes(fp).collect()} == want
