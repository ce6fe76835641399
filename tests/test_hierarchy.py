"""Trees by contraction against walking every chain."""

import random

import pytest

from ledgerline.operators.hierarchy import descendants, hierarchy


def brute(links):
    out = {}
    for i in links:
        path, at = [], i
        while at is not None and at not in path:
            path.append(at)
            at = links.get(at) if links.get(at) in links else None
        out[i] = (-1, -1, "", -1) if at is not None else (path[-1], len(path) - 1, "/".join(map(str, reversed(path))), 0)
    n = {}
    for _, _, p, _ in out.values():
        for a in p.split("/")[:-1]:
            n[int(a)] = n.get(int(a), 0) + 1
    return {i: v if v[1] < 0 else (*v[:3], n.get(i, 0)) for i, v in out.items()}


def run(spark, links, copies=0, **kw):
    rows = list(links.items())
    rows += rows[:copies]
    df = spark.createDataFrame([(i, p, "x") for i, p in rows], "id int, up int, root_id string")
    return {r.id: (r.root_id, r.depth, r.id_path, r.n_descendants) for r in hierarchy(df, "id", "up", **kw).collect()}


@pytest.mark.parametrize("seed", [1])
def test_random_forests_with_cycles(spark, seed):
    rnd = random.Random(seed)
    links = {i: rnd.choice([None, rnd.randrange(max(0, i - 30), i + 1), rnd.randrange(0, 450)]) if i % 3 else max(0, i - 1) or None for i in range(300)}
    assert run(spark, links, copies=20, local_rows=40, partitions=3) == brute(links)


def test_long_chain_over_many_levels(spark):
    links = {i: i - 1 if i else None for i in range(60)}
    assert run(spark, links, local_rows=20, partitions=4) == brute(links)


def test_hot_parent_keeps_its_children_apart(spark):
    links = {1: None} | {i: 1 for i in range(2, 120)} | {200 + i: i for i in range(2, 120)} | {500: 320, 501: 500}
    links[320] = 119
    assert run(spark, links, local_rows=30, partitions=4, hot_children=20) == brute(links)


def test_table_is_never_solved_by_one_task(spark):
    links = {i: i // 2 or None for i in range(1, 40)}
    df = spark.createDataFrame(list(links.items()), "id int, up int")
    tree = hierarchy(df, "id", "up", partitions=5)
    assert {r.id: r.id_path for r in tree.collect()} == {i: v[2] for i, v in brute(links).items()}
    from ledgerline.runtime import home

    fragments = spark.read.parquet(f"{home(spark)}/hierarchy-*/fragments0-*")
    assert fragments.where("exit is not null").count() > 0


def test_odd_cases(spark):
    assert run(spark, {}) == {}
    assert run(spark, {1: 1, 2: 1, 3: 99, 4: None}) == {1: (-1, -1, "", -1), 2: (-1, -1, "", -1), 3: (3, 0, "3", 0), 4: (4, 0, "4", 0)}


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, up int")
    assert sorted(tuple(r) for r in descendants(hierarchy(df, "id", "up"), "id").collect()) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
