"""Components, names, spans, packing, leakage and text quality against plain models."""

import random

import pytest

from ledgerline.llm.components import components, groups_from_lists
from ledgerline.llm.leakage import Matcher, common_length, leaked_items
from ledgerline.llm.names import Lexicon, edits, fold, pairs_of, read_record, same_names
from ledgerline.llm.packing import Windows, _merge, pack
from ledgerline.llm.prose import not_prose, prose_share
from ledgerline.llm.quality import text_statistics
from ledgerline.llm.spans import FingerprintIndex, shared_spans
from ledgerline.runtime import Workspace
from ledgerline.llm.words import words


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(None, 1), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up}
    df = spark.createDataFrame([(*e, "x") for e in edges], "a int, b int, component string")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == want
    known = spark.createDataFrame([(i,) for i in range(5)], "id int")
    lists = spark.createDataFrame([([3, None, 1, 99],), ([99, 4],), (None,), ([2, 2],)], "ids array<int>")
    assert {r.node: r.component for r in groups_from_lists(lists, "ids", known, "id").collect()} == {3: 1, 1: 1}


def test_names(spark):
    lex = Lexicon({"joaquin"}, {"quino": "joaquin"})
    assert fold("SÃ¸ren Ñandú") == "Soren Nandu" and edits("wormenodal", "wromenodal") == 1
    assert read_record("Quino Føllaludt", "j.follaludt54@x.example", None, lex)["given"] == "joaquin"
    assert read_record("deps[bot]", "1+deps[bot]@users.noreply.forge.example", None, lex)["kind"] is None
    rows = [
        (1, "Boris Bardazoquist", "bbardazoquist@a.example", None),
        (2, "Bardazoquist, Boris", None, ["B. Bardazoquist"]),
        (3, "Boris Bardazoqusit", "team8@groups.example", None),
        (4, "Margaret Bardazoquist", "team8@groups.example", None),
        (5, "B. Bardazoquist", "9+bbardazoquist@users.noreply.forge.example", []),
        (6, "Your Name", "you@mail.example", None), (7, "Your Name", "you@mail.example", None),
        (8, "Boris", None, None), (9, None, None, None), (10, "", "", []),
        (11, "Werzedanas Labs", "werzedanas@m.example", None), (12, "Werzednas labs", "werzedanas1@m.example", None),
        (1, "Boris Bardazoquist", "bbardazoquist@a.example", None),
    ]
    df = spark.createDataFrame(rows, "id int, name string, email string, name_variants array<string>")
    e = same_names(df, "id", "name", "email", "name_variants")
    assert {r.id: r.entity for r in e.collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 11: 11, 12: 11}
    assert sorted(tuple(r) for r in pairs_of(e, "id", "entity").collect()) == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5), (11, 12)]


def test_spellings_are_followed_to_the_end(spark):
    """A spelling whose better-known one is itself a variant, and one of a record with only an initial."""
    rows = [(i, "Bernard Hoffmann", "bernard.hoffmann@a.example", None) for i in (1, 2, 3)]
    rows += [(i, "Bernard Hofmann", None, None) for i in (4, 5)] + [(6, "Bernard Hofman", None, None)]
    rows += [(7, "Gregory Werzedanas", "gregory.werzedanas@a.example", None), (8, "G. Werzednas", None, None), (9, "H. Werzednas", None, None)]
    rows += [(100 + i, f"Anton {a}{b}", None, None) for i, (a, b) in enumerate((a, b) for a in ("Kral", "Dron", "Pumi", "Sott") for b in ("bexi", "gudo", "vyck", "jaru"))]
    df = spark.createDataFrame(rows, "id int, name string, email string, name_variants array<string>")
    got = {r.id: r.entity for r in same_names(df, "id", "name", "email", "name_variants").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7}


def test_common_family_name_is_no_given_name(spark):
    """A family name with as many companions as a given name, now and then written first without a comma."""
    first = "ana rosa luis pablo carmen diego ines marta jorge raul".split()
    last = "garcia lopezal morando sarvent quirozal vintero balmor cendral dorvane".split()
    rows = [(1, "Ana Garcia", "ana.garcia@a.example", None), (2, "Garcia Ana", "ana.garcia@b.example", None), (3, "Garcia Luis", None, None)]
    rows += [(100 + 10 * i + j, f"{g} {f}".title(), None, None) for i, g in enumerate(first) for j, f in enumerate(last) if (g, f) != ("ana", "garcia")]
    df = spark.createDataFrame(rows, "id int, name string, email string, name_variants array<string>")
    got = {r.id: r.entity for r in same_names(df, "id", "name", "email", "name_variants").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 120: 3}


def spans_brute(recs, n):
    places = {}
    for i, s in recs.items():
        for j in range(len(s) - n + 1):
            places.setdefault(tuple(s[j : j + n]), set()).add(i)
    out = {}
    for i, s in recs.items():
        on = set()
        for j in range(len(s) - n + 1):
            if len(places[tuple(s[j : j + n])]) > 1:
                on |= set(range(j, j + n))
        if on:
            out[i] = len(on)
    return out


@pytest.mark.parametrize("text", [True, False])
def test_spans(spark, text):
    rnd = random.Random(3)
    base = [rnd.randrange(4) for _ in range(300)]
    recs = {}
    for i in range(25):
        a, b = sorted(rnd.sample(range(300), 2))
        recs[i] = [rnd.randrange(50) for _ in range(rnd.randrange(60))] + base[a:b] + [rnd.randrange(50) for _ in range(rnd.randrange(60))]
    recs |= {90: recs[0], 91: [1] * 80, 92: [], 93: [5, 6] * 40}
    seq = (lambda s: "".join(chr(0x1F600 + x) for x in s)) if text else (lambda s: s)
    rows = [(i, seq(s), "x") for i, s in recs.items()] + [(200, None, "x"), (0, seq(recs[0]), "x")]
    df = spark.createDataFrame(rows, "id int, seq " + ("string" if text else "array<bigint>") + ", shared_len string")
    for batches, fan_in in ((1, 4), (5, 2)):
        assert {r.id: r.shared_len for r in shared_spans(df, 20, 10, text, batches, fan_in).collect()} == spans_brute(recs, 20)


def test_fingerprint_index_matches_each_batch_with_the_history(spark):
    space = Workspace(spark, "index-test")
    index = FingerprintIndex(spark, space, buckets=2, fan_in=2)
    batch = lambda *rows: spark.createDataFrame(rows, "id long, m long, a int, n int")
    alive = lambda: {r.m for k in index.alive for r in spark.table(k).collect()}
    index.add(batch((1, 10, 0, 1), (1, 10, 5, 1), (1, 11, 0, 1), (2, 12, 0, 1), (3, 12, 0, 1)))
    assert alive() == {12}
    index.add(batch((4, 11, 0, 1), (5, 13, 0, 1)))
    assert alive() == {12, 11} and index.compactions == 0
    index.add(batch((6, 13, 0, 1), (1, 10, 9, 1)))
    assert alive() == {12, 11, 13} and index.compactions == 1 and len(index.runs) == 1
    assert sorted((r.id, r.m) for r in index.shared().collect()) == [(1, 11), (2, 12), (3, 12), (4, 11), (5, 13), (6, 13)]
    plan = spark.table(index.runs[0]).groupBy("m").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]
    index.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ledgerline_run_")]


def test_packing(spark):
    w = Windows(10, 2)
    assert [w.place(n)[0] for n in (6, 7, 4, 10, 3, 5)] == [0, 1, 0, 2, 1, 3]
    to = _merge([(("a",), 6), (("b",), 5), (("c",), 4)], 10)
    assert to[("a",)][0] == to[("c",)][0] != to[("b",)][0] and to[("c",)] == (0, 6)
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([0, 3, 40, 90, 100, 250, None])) for i in range(300)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "id int, n int, piece string").repartition(3)
    for at_once in (1000, 5):
        rows = pack(df, "id", "n", 100, 4, at_once).collect()
        got, fill = {}, {}
        for r in rows:
            got[r.id] = got.get(r.id, 0) + r.piece_size
            if r.container_id:
                fill.setdefault(r.container_id, []).append((r.position, r.piece_size))
        assert got == {i: n or 0 for i, n in sizes}
        for parts in fill.values():
            at = 0
            for p, n in sorted(parts):
                assert p == at
                at += n
            assert at <= 100
        assert len(fill) <= 1.15 * sum(n or 0 for _, n in sizes) / 100
    assert pack(df.limit(0), "id", "n", 100).count() == 0


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(q[j], p[j + 1]))
        p = q
    return p[-1]


def test_bit_parallel_length():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 90))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert common_length(masks, len(a), b) == lcs(a, b)


def test_leakage(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    item = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 40)))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for k in range(150):
        t = rnd.choice(item[:12])[1].split()
        a = rnd.randrange(len(t))
        t = [w for w in t[a:] if rnd.random() > 0.2]
        for _ in range(rnd.randrange(6)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice(vocab))
        docs.append((k, " ".join(rnd.choice(vocab) for _ in range(20)) + ". " + ", ".join(t).upper()))
    docs += [(900, None), (901, ""), (902, "<b>x</b>​ ­" * 50)]
    want = set()
    for i, t in item[:12]:
        v = t.split()
        for k, d in docs[:150]:
            w = words(d)
            run = any(w[p : p + 12] == v[q : q + 12] for q in range(len(v) - 11) for p in range(len(w) - 11))
            need, reach = -(-len(v) * 7 // 10), int(1.5 * len(v))
            if run or any(lcs(v, w[p : p + reach]) >= need for p in range(len(w))):
                want.add((k, i))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    its = spark.createDataFrame(item, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_items(df, "doc_id", "text", its, "item_id", "text").collect()} == want
    assert leaked_items(df, "doc_id", "text", its.limit(0), "item_id", "text").count() == 0
    assert Matcher([(1, "the <i>quick</i> fo­x")], 12, 0.7, 1.5).find(["", "// the\n// quick fox"]) == [(1, 0, 3)]


def test_quality(spark):
    prose = "The maintainer said that the report had been split before the deadline. It was late, so nobody read it."
    rows = [(1, prose), (2, None), (3, "word"), (4, "- a list\n- of things\n- and more"), (5, "for i in range(3):\n    x[i] = f(i)"), (6, prose.lower().replace(".", "").replace(",", "") + "\n"), (7, "upload form " * 40), (8, prose.replace(" ", "\n")), (9, "die Liste: klar\nden Test\ndie Suche (am Sonntag)\nden Zweig"), (10, (prose + "\n") * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, prose_share string")
    share = {r.doc_id: r.prose_share for r in prose_share(df, "doc_id", "text").collect()}
    assert share[1] == 1.0 and share[2] == 0.0
    assert sorted(r.doc_id for r in not_prose(df, "doc_id", "text").collect()) == [2, 3, 4, 5, 7, 9]
    s = {r.doc_id: r for r in text_statistics(df, "doc_id", "text").collect()}
    assert s[2].n_words == 0 and s[4].bullet_line_share == 1.0 and s[1].punctuated_line_share == 1.0 and s[3].mean_word_length == 4.0
