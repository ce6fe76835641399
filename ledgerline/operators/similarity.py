"""Similarity of projects by winnowed fingerprints: shared hashes, runs of them, stop hashes, scores, clusters.

Pairs are only formed on a common hash inside a scope (a course). Hashes that many projects of the scope hold are
dropped before projects are paired for scoring, unless they belong to a long run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..runtime import Workspace
from .graph import connected


@dataclass(frozen=True)
class Limits:
    score: float = 30.0
    run_tokens: int = 60
    total_tokens: int = 150
    overlap: float = rules.IDENT_OVERLAP
    k: int = rules.K


STRICT = Limits(25.0, 500, 500)
LOOSE = Limits()


def hash_of(tokens: Column) -> Column:
    """60-bit hash of a gram of tokens: the first 15 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.array_join(tokens, "-"), 256), 1, 15), 16, 10).cast("bigint")


def gram_hashes(tokens: Column, k: int = rules.K) -> Column:
    n = F.size(tokens)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: hash_of(F.slice(tokens, i, k)))).otherwise(F.array().cast("array<bigint>"))


def winnowed(grams: DataFrame, key: str, w: int = rules.W) -> DataFrame:
    """key, hash_value, pos from rows of key and an array of hashes: the smallest hash of each window of w, the rightmost
    of equals, each position once; sequences shorter than w give none."""
    # The outer form: for the inner one the optimizer adds a filter that evaluates the hashes once more, per element.
    e = grams.select(key, F.posexplode_outer("hashes").alias("at", "h")).where("h is not null")
    frame = Window.partitionBy(key).orderBy("at").rowsBetween(0, w - 1)
    best = e.select(key, F.min(F.struct("h", (-F.col("at")).alias("p"))).over(frame).alias("b"), F.count("*").over(frame).alias("n")).where(F.col("n") == w)
    return best.select(key, F.col("b.h").alias("hash_value"), (-F.col("b.p")).alias("pos")).distinct()


def fingerprints_of(files: DataFrame, k: int = rules.K, w: int = rules.W, chunk: int = 100_000) -> DataFrame:
    """project_id, hash_value, token_pos, file_path, line_number, raw_ident of the winnowed fingerprints of whole projects.

    files has project_id, file_path and tokens (array of token, line, ident). A project is one stream of its files in order
    of path, so grams and windows run across the borders of files; a fingerprint belongs to the file of its first token.
    Streams are cut into chunks that overlap by what a window reaches over, so a large project isn't one task. Files
    without tokens add nothing, and a stream with fewer than w grams gives none.
    """
    f = files.where("project_id is not null").select("project_id", F.coalesce("file_path", F.lit("")).alias("file_path"), "tokens").withColumn("n", F.greatest(F.size("tokens"), F.lit(0)).cast("bigint"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("project_id").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = f.withColumn("before", before)
    x = f.select("project_id", "file_path", "before", F.posexplode_outer("tokens").alias("i", "t")).where("t is not null").select("project_id", "file_path", (F.col("before") + F.col("i")).alias("pos"), "t.token", "t.line", "t.ident")
    own = F.floor(F.col("pos") / chunk)
    shared = F.when((own > 0) & (F.col("pos") % chunk < k + w - 2), own - 1)
    x = x.withColumn("chunk", F.explode_outer(F.array_compact(F.array(own, shared))))
    order = Window.partitionBy("project_id", "chunk").orderBy("pos")
    gram = F.collect_list("token").over(order.rowsBetween(0, k - 1))
    x = x.withColumn("gram", gram).withColumn("h", F.when(F.size("gram") == k, hash_of(F.col("gram"))))
    ahead = order.rowsBetween(0, w - 1)
    best = x.select("project_id", "chunk", "pos", F.count("h").over(ahead).alias("n"), F.min(F.struct("h", (-F.col("pos")).alias("p"), "file_path", "line", "ident")).over(ahead).alias("b")).where((F.col("n") == w) & (F.floor(F.col("pos") / chunk) == F.col("chunk")))
    return best.select("project_id", F.col("b.h").alias("hash_value"), (-F.col("b.p")).alias("token_pos"), F.col("b.file_path").alias("file_path"), F.col("b.line").alias("line_number"), F.col("b.ident").alias("raw_ident")).distinct()


def ordered(fp: DataFrame) -> DataFrame:
    """fp with fidx, the index in its file, and pidx, the index in the project's stream of files. A project is numbered
    file by file, so that a large one isn't one task."""
    f = fp.withColumn("fidx", F.row_number().over(Window.partitionBy("project_id", "file_path").orderBy("token_pos", "hash_value")) - 1)
    sizes = fp.groupBy("project_id", "file_path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("project_id").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return f.join(sizes.select("project_id", "file_path", before.alias("before")), ["project_id", "file_path"]).withColumn("pidx", F.col("before") + F.col("fidx")).drop("before")


def candidate_pairs(fp: DataFrame, least: int = rules.MIN_SHARED) -> DataFrame:
    """scope, pa < pb, shared: pairs of projects with at least ``least`` different hashes in common."""
    u = fp.select("scope", "project_id", "hash_value").distinct()
    a, b = u.select("scope", "hash_value", F.col("project_id").alias("pa")), u.select("scope", "hash_value", F.col("project_id").alias("pb"))
    return a.join(b, ["scope", "hash_value"]).where("pa < pb").groupBy("scope", "pa", "pb").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def matched(fp: DataFrame, pairs: DataFrame, index: str) -> DataFrame:
    """Occurrences of common hashes of the pairs, numbered by island: consecutive matches on one diagonal of a file pair."""
    side = lambda s: fp.select("scope", "hash_value", F.col("project_id").alias(f"p{s}"), F.col("file_path").alias(f"file_{s}"), F.col(index).alias(f"i{s}"), F.col("line_number").alias(f"line_{s}"), F.col("raw_ident").alias(f"ident_{s}"))
    m = pairs.select("scope", "pa", "pb").join(side("a"), ["scope", "pa"]).join(side("b"), ["scope", "pb", "hash_value"])
    group = ["scope", "pa", "pb", "file_a", "file_b"]
    m = m.withColumn("diag", F.col("ib") - F.col("ia"))
    return m.withColumn("island", F.col("ia") - F.row_number().over(Window.partitionBy(*group, "diag").orderBy("ia")))


RUN = ["scope", "pa", "pb", "file_a", "file_b", "diag", "island"]


def shared_windows(fp: DataFrame, length: int) -> DataFrame:
    """scope, project_id, digest, hashes of every stretch of ``length`` hashes of a file that stands in several projects.

    A run of matches of at least that length between two projects is made of such stretches, so runs are found by
    counting stretches, whatever number of projects holds a hash.
    """
    frame = Window.partitionBy("project_id", "file_path").orderBy("fidx").rowsBetween(0, length - 1)
    w = fp.select("scope", "project_id", F.collect_list("hash_value").over(frame).alias("hashes")).where(F.size("hashes") == length)
    w = w.withColumn("digest", F.struct(F.xxhash64("hashes").alias("x"), F.hash("hashes").alias("y")))
    several = w.groupBy("scope", "digest").agg(F.min("project_id").alias("lo"), F.max("project_id").alias("hi")).where("lo <> hi").select("scope", "digest")
    return w.join(several, ["scope", "digest"], "left_semi")


def protected_hashes(fp: DataFrame, least: int = rules.PROTECTED_RUN, shared: int = rules.MIN_SHARED) -> DataFrame:
    """scope, hash_value in any run of at least ``least`` matches between two projects with ``shared`` hashes in common."""
    w = shared_windows(fp, least).withColumn("rich", F.size(F.array_distinct("hashes")) >= shared)
    # A stretch of that many different hashes shows that the projects have enough in common. Where hashes repeat inside
    # it, the projects that share it are looked up.
    poor = w.where("not rich").select("scope", "digest", "project_id", "hashes").distinct()
    pairs = poor.select("scope", "digest", F.col("project_id").alias("pa")).join(poor.select("scope", "digest", F.col("project_id").alias("pb")), ["scope", "digest"]).where("pa < pb").select("scope", "pa", "pb").distinct()
    u = fp.select("scope", "project_id", "hash_value").distinct()
    held = pairs.join(u.withColumnRenamed("project_id", "pa"), ["scope", "pa"]).join(u.withColumnRenamed("project_id", "pb"), ["scope", "pb", "hash_value"])
    enough = held.groupBy("scope", "pa", "pb").agg(F.count("*").alias("n")).where(F.col("n") >= shared)
    both = poor.join(enough.select("scope", F.col("pa").alias("project_id"), "pb"), ["scope", "project_id"]).join(poor.select("scope", "digest", F.col("project_id").alias("pb")), ["scope", "digest", "pb"], "left_semi")
    return w.where("rich").select("scope", "hashes").unionByName(both.select("scope", "hashes")).select("scope", F.explode_outer("hashes").alias("hash_value")).distinct()


def stop_hashes(fp: DataFrame, protected: DataFrame, share: float = rules.STOP_SHARE) -> DataFrame:
    units = fp.groupBy("scope").agg(F.count_distinct("project_id").alias("units"))
    n = fp.select("scope", "hash_value", "project_id").distinct().groupBy("scope", "hash_value").agg(F.count("*").alias("n"))
    many = n.join(units, "scope").where(F.col("n") > F.greatest(F.lit(2), F.floor(F.col("units") * F.lit(share))))
    return many.select("scope", "hash_value", "n").join(protected, ["scope", "hash_value"], "left_anti")


def runs(m: DataFrame, limits: Limits) -> DataFrame:
    """Runs that are long enough and whose identifiers overlap enough."""
    r = m.groupBy(*RUN).agg(
        F.count("*").alias("n"),
        F.collect_set("hash_value").alias("hashes"),
        F.min("line_a").alias("line_a"), F.max("line_a").alias("end_line_a"), F.min("line_b").alias("line_b"), F.max("line_b").alias("end_line_b"),
        F.collect_set("ident_a").alias("ids_a"), F.collect_set("ident_b").alias("ids_b"),
    )
    small = F.least(F.size("ids_a"), F.size("ids_b"))
    r = r.withColumn("overlap", F.when(small == 0, 100.0).otherwise(100.0 * F.size(F.array_intersect("ids_a", "ids_b")) / small))
    return r.where((F.col("n") * limits.k >= limits.run_tokens) & ((F.col("overlap") >= limits.overlap) | (small == 0))).drop("ids_a", "ids_b")


def evaluate(fp: DataFrame, pairs: DataFrame, limits: Limits, space: Workspace) -> DataFrame:
    """Score and figures of each pair that passes the limits."""
    m = space.write(matched(fp, pairs, "fidx"), "matches")
    r = runs(m, limits)
    distinct = lambda by, n: fp.groupBy(*by).agg(F.count_distinct("hash_value").alias(n))
    files = distinct(["scope", "project_id", "file_path"], "n")
    common = m.groupBy("scope", "pa", "pb", "file_a", "file_b").agg(F.count_distinct("hash_value").alias("common"))
    for s in "ab":
        common = common.join(files.select("scope", F.col("project_id").alias(f"p{s}"), F.col("file_path").alias(f"file_{s}"), F.col("n").alias(f"n{s}")), ["scope", f"p{s}", f"file_{s}"])
    best = common.groupBy("scope", "pa", "pb").agg(F.max(100.0 * F.col("common") / F.least("na", "nb")).alias("file_pct"))
    total = r.groupBy("scope", "pa", "pb").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hashes")))).alias("surviving"), F.count("*").alias("n_runs"), F.max("n").alias("longest"), F.avg("overlap").alias("overlap"))
    own = distinct(["scope", "project_id"], "n")
    for s in "ab":
        total = total.join(own.select("scope", F.col("project_id").alias(f"p{s}"), F.col("n").alias(f"n{s}")), ["scope", f"p{s}"])
    least = F.least("na", "nb")
    out = total.join(best, ["scope", "pa", "pb"]).where(least >= 5)
    out = out.withColumn("score", F.round(F.greatest(100.0 * F.col("surviving") / least, F.col("file_pct")), 6))
    out = out.where((F.col("score") >= limits.score) & (F.col("longest") * limits.k >= limits.run_tokens) & (F.col("surviving") * limits.k >= limits.total_tokens))
    return out.select("scope", "pa", "pb", "score", F.round("file_pct", 6).alias("file_pct"), "surviving", "n_runs", (F.col("longest") * limits.k).alias("longest_run_tokens"), F.round("overlap", 6).alias("avg_overlap"), F.when(F.col("score") >= rules.HIGH_CONFIDENCE, "HIGH").otherwise("MEDIUM").alias("confidence"))


@dataclass
class Comparison:
    """The steps of a comparison, each usable on its own."""

    fp: DataFrame
    protected: DataFrame
    stop: DataFrame
    kept: DataFrame
    reports: DataFrame


def compare(fp: DataFrame, limits: Limits = LOOSE) -> Comparison:
    """fp has scope, project_id, file_path, token_pos, hash_value, line_number, raw_ident."""
    space = Workspace(fp.sparkSession, "similarity")
    fp = space.write(ordered(fp), "fingerprints")
    protected = space.write(protected_hashes(fp), "protected")
    stop = space.write(stop_hashes(fp, protected), "stop")
    kept = space.write(ordered(fp.drop("fidx", "pidx").join(stop.select("scope", "hash_value"), ["scope", "hash_value"], "left_anti")), "kept")
    reports = space.write(evaluate(kept, candidate_pairs(kept), limits, space), "reports")
    return Comparison(fp, protected, stop, kept, reports)


def clusters(reports: DataFrame, projects: DataFrame, least_score: float = 30.0, least_size: int = 3) -> DataFrame:
    """cluster, project_id and origin rank (earliest first) of groups of at least three projects; mean score of its pairs."""
    e = reports.where(F.col("score") >= least_score)
    c = connected(e, "pa", "pb")
    big = c.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    c = c.join(big, "component")
    mean = reports.join(c.select(F.col("node").alias("pa"), F.col("component").alias("ca")), "pa").join(c.select(F.col("node").alias("pb"), F.col("component").alias("cb")), "pb").where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.round(F.avg("score"), 6).alias("avg_score"))
    j = c.join(mean, "component").join(projects.select(F.col("id").alias("node"), "created_at"), "node", "left")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.asc_nulls_last("created_at"), "node"))
    return j.select(F.col("component").alias("cluster"), F.col("node").alias("project_id"), rank.alias("origin_rank"), F.col("size").cast("int").alias("size"), "avg_score")


def second_pass(c: Comparison, groups: DataFrame, limits: Limits = LOOSE) -> DataFrame:
    """Pairs inside a cluster that the first pass didn't report, compared on all fingerprints."""
    g = groups.select("cluster", "project_id")
    scope = c.fp.select("project_id", "scope").distinct()
    # Only projects with a run of matches in common can be reported: they meet at its stretches, those of a cluster at most.
    fp = c.fp.join(g.select("cluster", "project_id"), "project_id")
    w = shared_windows(fp.withColumn("scope", F.col("cluster")), -(-limits.run_tokens // limits.k)).select(F.col("scope").alias("cluster"), "project_id", "digest").distinct()
    pairs = w.select("cluster", "digest", F.col("project_id").alias("pa")).join(w.select("cluster", "digest", F.col("project_id").alias("pb")), ["cluster", "digest"]).where("pa < pb").select("pa", "pb").distinct()
    pairs = pairs.join(scope.select(F.col("project_id").alias("pa"), "scope"), "pa").select("scope", "pa", "pb")
    pairs = pairs.join(c.reports, ["pa", "pb"], "left_anti")
    return evaluate(c.fp, pairs, limits, Workspace(c.fp.sparkSession, "second-pass"))


def coverage(reports: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project of a course: pairs required, pairs flagged, state."""
    p = projects.select("course_id", F.col("id").alias("project_id"))
    need = p.groupBy("course_id").agg((F.count("*") - 1).alias("required"))
    ends = reports.select(F.col("pa").alias("project_id"), F.col("pb").alias("other")).unionByName(reports.select(F.col("pb").alias("project_id"), F.col("pa").alias("other")))
    done = ends.groupBy("project_id").agg(F.count_distinct("other").alias("flagged"))
    j = p.join(need, "course_id").join(done, "project_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)).cast("bigint"))
    return j.select("project_id", "required", "flagged", F.when(F.col("required") == 0, "none").when(F.col("flagged") >= F.col("required"), "complete").when(F.col("flagged") > 0, "partial").otherwise("pending").alias("state"))


def plagiarism_detail(reports: DataFrame, status: DataFrame) -> DataFrame:
    """Per project its unresolved matches: partners, highest score and the partner with it. status has pa, pb, status."""
    r = reports.join(status, ["pa", "pb"], "left").withColumn("status", F.coalesce("status", F.lit("Needs Review"))).where(~F.lower(F.trim("status")).isin(rules.RESOLVED_STATUSES))
    ends = r.select(F.col("pa").alias("project_id"), F.col("pb").alias("other"), "score").unionByName(r.select(F.col("pb").alias("project_id"), F.col("pa").alias("other"), "score"))
    return ends.groupBy("project_id").agg(F.count("*").alias("n_matches"), F.max("score").alias("max_score"), F.min_by("other", F.struct(-F.col("score"), F.col("other"))).alias("partner"))


def carried_status(new: DataFrame, old: DataFrame) -> DataFrame:
    """New reports with the review status that the pair had before, in whichever order it was stored."""
    key = lambda df, a, b: df.withColumn("pa", F.least(a, b)).withColumn("pb", F.greatest(a, b))
    o = key(old, "project_a_id", "project_b_id").groupBy("pa", "pb").agg(F.max("status").alias("was"))
    return new.join(o, ["pa", "pb"], "left").withColumn("status", F.coalesce("was", F.lit("Needs Review"))).drop("was")
