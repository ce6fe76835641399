"""Attribute files, their precedence, and what is mined from them for other repositories."""

from ledgerline.llm import generated as G

ATTR = ".gitattributes"
ROWS = [
    (1, ATTR, "@@ -0,0 +1,2 @@\n+thirdlib/** linguist-vendored\n+*.out.ts linguist-generated\n", "c1"),
    (2, ATTR, "@@ -0,0 +1 @@\n+/thirdlib/** linguist-vendored=true\n", "c2"),
    (3, "thirdlib/own/" + ATTR, "@@ -0,0 +1 @@\n+*.js -linguist-vendored\n", "c2"),
    (4, "thirdlib/a.js", "+function a() { return 1; }\n", "c1"),
    (5, "thirdlib/own/b.js", None, "c2"),
    (6, "thirdlib/b.js", None, "c2"),
    (7, "src/thirdlib/c.js", None, "c3"),
    (8, "src/main.js", None, "c3"),
    (9, "src/x.out.ts", None, "c3"),
    (10, "x.out.ts", None, "c1"),
    (11, "vendor/d.js", None, "c1"),
    (12, "deep/one/two/three/four/e.py", None, "c3"),
]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, filename string, diff string, commit string, reason string")
    repos = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3), ("c3", 3)], "link string, repo int")
    return {r.id: r.reason for r in G.generated_files(df, "id", "filename", "diff", "commit", repos, **kw).collect()}


def test_declared_and_mined_from_declarations(spark):
    generated = [(20 + i, f"deep/one/two/three/four/g{i}.py", "+# Code generated by tool. DO NOT EDIT.\n+x = 1\n", "c3") for i in range(9)]
    got = found(spark, [*ROWS, *generated, *ROWS[3:5]])
    # Declared by the own repository, by the nearest file; nothing for one that unsets the mark.
    assert (got.get(4), got.get(5), got.get(6), got.get(10)) == ("declared", None, "declared", "declared")
    # Two repositories declare thirdlib, so the third one's copy is marked; one alone declares *.out.ts.
    assert (got.get(7), got.get(8), got.get(9)) == ("mined", None, None)
    # A directory at any depth is mined from the texts under it; conventions hold where nothing is declared of a path.
    assert got[12] == "mined" and got[11] == "convention" and {got[20 + i] for i in range(9)} == {"mined"}


def test_patterns_of_rules():
    assert [G.pattern_of_rule(g) for g in ("vendor/**", "/lib/", "**/gen/*", "*.pb.go", "*.js", "go.sum", "a/b/**", "[ab]/")] == ["**/vendor/**", "**/lib/**", "**/gen/**", "*.pb.go", None, "=go.sum", None, None]


def test_later_text_of_an_attribute_file_counts(spark):
    rows = [(1, ATTR, "+lib/** linguist-vendored\n", "c1"), (2, ATTR, "+lib/** -linguist-vendored\n", "c1"), (3, "lib/a.py", None, "c1"), (4, None, None, "c1"), (5, "lib/b.py", "", None)]
    assert found(spark, rows) == {}
