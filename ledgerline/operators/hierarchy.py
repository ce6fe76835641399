"""Parent-child links to full hierarchies by contraction.

A partition follows every chain of parents as far as its own rows reach; what is left of a chain is its exit, the
first ancestor that lies elsewhere. Exits form a smaller quotient forest, which is solved the same way, and the
solved exits then extend the paths of the fragments. Chains that close on themselves are found where they close:
in a fragment, or in the quotient at any level.

Descendants are counted the other way round, without spelling out any path: an exit carries into the quotient the number
of rows whose chains end at it, and the sums that come back for the exits are added up inside each fragment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace

#: A quotient, never the table itself, of at most so many rows is solved by one task (some tens of MB).
LOCAL_ROWS = 200_000
#: Children of a parent with more of them than this stay where they are: they leave the quotient once they are leaves.
HOT_CHILDREN = 10_000
FRAGMENT = "id bigint, exit bigint, cyclic boolean, root bigint, seg string"


def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fragment of one partition: for each row its exit, or its root, or that its chain never ends."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    parent = {i: (None if pd.isna(p) else int(p)) for i, p in zip(rows["id"].tolist(), rows["parent"].tolist())}
    seg, root, bad = (dict(zip(rows["id"], rows[c])) for c in ("seg", "root", "cyclic"))
    done: dict[int, tuple] = {}  # id -> (exit, cyclic, root, path below the exit)
    for start in parent:
        chain, seen, at = [], set(), start
        while at not in done and at in parent and at not in seen:
            seen.add(at)
            chain.append(at)
            if bad[at] or parent[at] is None:
                break
            at = parent[at]
        else:
            if at in done:
                base = done[at]
            elif at in seen:
                base = (None, True, None, "")
            else:
                base = (at, False, None, "")
            for i in reversed(chain):
                base = (base[0], base[1], base[2], "" if base[1] else f"{base[3]}/{seg[i]}" if base[3] else seg[i])
                done[i] = base
            continue
        top = chain[-1]
        base = (None, True, None, "") if bad[top] else (None, False, int(root[top]), seg[top])
        done[top] = base
        for i in reversed(chain[:-1]):
            base = (None, base[1], base[2], "" if base[1] else f"{base[3]}/{seg[i]}")
            done[i] = base
    ids = list(done)
    cols = list(zip(*done.values()))
    for lo in range(0, len(ids), 50_000):
        part = slice(lo, lo + 50_000)
        yield pd.DataFrame({"id": ids[part], "exit": pd.array(cols[0][part], "Int64"), "cyclic": cols[1][part], "root": pd.array(cols[2][part], "Int64"), "seg": cols[3][part]})


def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, below: the weights of a row and of everything under it in its partition; rows on or above no end keep their own."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    n = len(rows)
    up = pd.Index(rows["id"]).get_indexer(rows["parent"].astype("Int64").fillna(-1).to_numpy(np.int64))
    up = np.where(rows["parent"].isna().to_numpy(), -1, up)
    depth, jump = (up >= 0).astype(np.int64), up.copy()
    for _ in range(n.bit_length() + 1):  # doubling: depth of a row inside its partition
        live = jump >= 0
        if not live.any():
            break
        depth[live] += depth[jump[live]]
        jump[live] = jump[jump[live]]
    total = rows["weight"].to_numpy(np.int64).tolist()
    parents = np.where(jump >= 0, -1, up).tolist()  # what still jumps never ends
    for i in np.argsort(-depth, kind="stable").tolist():
        if parents[i] >= 0:
            total[parents[i]] += total[i]
    yield pd.DataFrame({"id": rows["id"].to_numpy(), "below": total})


def _placed(nodes: DataFrame, level: int, hot_children: int) -> DataFrame:
    """nodes with the key of the partition they are solved in.

    Above the first level by random mates: a tail moves to the partition of a parent that is a head, so that a fixed
    share of the links becomes local whatever the number of partitions is. The children of a hot parent don't move, as
    they would all meet in one task.
    """
    if level == 0:
        return nodes.withColumn("place", F.col("id"))
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2))
    hot = nodes.where("parent is not null").groupBy("parent").count().where(F.col("count") > hot_children).select("parent", F.lit(True).alias("hot"))
    moves = (coin("id") == 0) & F.col("parent").isNotNull() & F.col("hot").isNull() & (coin("parent") == 1)
    return nodes.join(hot, "parent", "left").withColumn("place", F.when(moves, F.col("parent")).otherwise(F.col("id"))).drop("hot")


def _solve(nodes: DataFrame, space: Workspace, level: int, local_rows: int, width: int, counts: bool, hot_children: int) -> DataFrame:
    """nodes(id, parent, cyclic, root, seg, weight), ids unique, each parent null or among the ids
    -> id, cyclic, root, path and, with ``counts``, below: the weights of the node and of all under it."""
    single = level > 0 and nodes.limit(local_rows + 1).count() <= local_rows
    if single:
        apart = lambda df: df.coalesce(1)
    else:
        nodes = _placed(nodes, level, hot_children)
        nodes = space.write(nodes, f"placed{level}") if level else nodes
        apart = lambda df: df.repartition(width, "place").drop("place")
    fragments = space.write(apart(nodes.drop("weight")).mapInPandas(contract, FRAGMENT), f"fragments{level}")
    ended = fragments.where("exit is null").select("id", "cyclic", "root", F.col("seg").alias("path"))
    links = nodes.select("id", "parent", "weight", *([] if single else ["place"]))
    if single:
        return ended.join(apart(links).mapInPandas(add_up, "id bigint, below bigint"), "id") if counts else ended
    exits = fragments.where("exit is not null").join(nodes.select("id", "weight"), "id").groupBy(F.col("exit").alias("id")).agg(F.sum("weight").alias("weight"))
    quotient = fragments.join(exits, "id").select("id", F.col("exit").alias("parent"), "cyclic", "root", "seg", "weight")
    quotient = space.write(quotient, f"quotient{level}")
    solved = _solve(quotient, space, level + 1, local_rows, width, counts, hot_children)
    solved = space.write(solved, f"solved{level}")
    above = solved.select(F.col("id").alias("exit"), F.col("cyclic").alias("up_cyclic"), F.col("root").alias("up_root"), F.col("path").alias("up_path"))
    rest = fragments.where("exit is not null").join(above, "exit")
    rest = rest.select("id", F.col("up_cyclic").alias("cyclic"), F.col("up_root").alias("root"), F.when(F.col("up_cyclic"), "").otherwise(F.concat_ws("/", "up_path", "seg")).alias("path"))
    out = ended.unionByName(rest)
    if not counts:
        return out
    hanging = solved.select("id", F.col("below").alias("hanging"))
    weighed = links.join(hanging, "id", "left").withColumn("weight", F.col("weight") + F.coalesce("hanging", F.lit(0))).drop("hanging")
    return out.join(apart(weighed).mapInPandas(add_up, "id bigint, below bigint"), "id")


def _forest(df: DataFrame, node: str, parent: str, counts: bool, local_rows: int, partitions: int | None, hot_children: int) -> DataFrame:
    space = Workspace(df.sparkSession, "hierarchy")
    rows = df.select(F.col(f"`{node}`").cast("bigint").alias("id"), F.col(f"`{parent}`").cast("bigint").alias("parent")).where("id is not null")
    rows = rows.groupBy("id").agg(F.min("parent").alias("parent"))
    known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    rows = rows.select("id", "parent", F.lit(False).alias("cyclic"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), F.col("id").cast("string").alias("seg"), F.lit(1).cast("bigint").alias("weight"))
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return space.write(_solve(space.write(rows, "nodes"), space, 0, local_rows, width, counts, hot_children), "solved")


def roots(df: DataFrame, node: str, parent: str, local_rows: int = LOCAL_ROWS, partitions: int | None = None) -> DataFrame:
    """Per distinct node its root_id alone, -1 where the way up never ends; otherwise as ``hierarchy``."""
    kind = dict(df.dtypes)[node]
    solved = _forest(df, node, parent, False, local_rows, partitions, HOT_CHILDREN)
    return solved.select(F.col("id").cast(kind).alias(node), F.when(F.col("cyclic"), -1).otherwise(F.col("root")).cast(kind).alias("root_id"))


def hierarchy(df: DataFrame, node: str, parent: str, local_rows: int = LOCAL_ROWS, partitions: int | None = None, hot_children: int = HOT_CHILDREN) -> DataFrame:
    """One row per distinct node: id, root_id, depth, id_path, n_descendants.

    A parent that is null or isn't a node counts as none. Where repeated rows of a node name different parents, the
    smallest is taken. A node whose way up never ends (its chain reaches a cycle) gets root_id -1, depth -1, an empty
    path and -1 descendants. Null nodes are left out; empty input gives no rows; further columns are ignored.
    """
    kind = dict(df.dtypes)[node]
    solved = _forest(df, node, parent, True, local_rows, partitions, hot_children)
    bad = F.col("cyclic")
    return solved.select(
        F.col("id").cast(kind).alias(node),
        F.when(bad, -1).otherwise(F.col("root")).cast(kind).alias("root_id"),
        F.when(bad, -1).otherwise(F.size(F.split("path", "/")) - 1).cast("int").alias("depth"),
        F.when(bad, "").otherwise(F.col("path")).alias("id_path"),
        F.when(bad, -1).otherwise(F.col("below") - 1).cast("int").alias("n_descendants"),
    )


def descendants(tree: DataFrame, node: str) -> DataFrame:
    """ancestor, descendant and their distance, from the result of ``hierarchy``; its size is that of all paths."""
    kind = dict(tree.dtypes)[node]
    up = tree.where("depth > 0").select(F.col(node).alias("descendant"), F.posexplode(F.split("id_path", "/")).alias("level", "a"), "depth")
    return up.where("level < depth").select(F.col("a").cast(kind).alias("ancestor"), "descendant", (F.col("depth") - F.col("level")).alias("distance"))
