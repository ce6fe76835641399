"""Labels of commits by rule, and scores of contributors from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the rule labeler: the first pattern that fits the message names its type.
TYPES = [("merge", r"\bmerge\b"), ("test", r"\btests?\b"), ("docs", r"\b(docs?|document|readme)\b"), ("bugfix", r"\b(fix|bug|repair|restore|hotfix)"), ("refactor", r"\b(refactor|rename|cleanup|move|simplify)"), ("style", r"\b(style|format|lint)"), ("config", r"\b(config|bump|setup|build|ci|wire)\b"), ("feature", r"\b(feat|add|implement|support|cache)")]
SECRET = r"""(?i)(password|secret|token|api_?key)\s*[:=]\s*["'][^"'$<{ ]{8,}["']"""
UNSAFE = r"\beval\s*\("
INJECTION = r"(?i)execute\(\s*(f[\"']|[\"'][^\"']*[\"']\s*[+%])"
WORSE = 3


def labels(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """hash, type, substance, quality, consistency, security of each commit; changes has commit_hash, filename, raw_diff."""
    message = F.lower(F.coalesce("message", F.lit("")))
    kind: Column = F.lit("other")
    for name, pattern in reversed(TYPES):
        kind = F.when(message.rlike(pattern), name).otherwise(kind)
    size = F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    substance = F.when(size < 10, "trivial").when(size < 100, "moderate").otherwise("substantial")
    path = F.lower(T.path(F.col("filename")))
    d = F.coalesce("raw_diff", F.lit(""))
    f = changes.groupBy("commit_hash").agg(
        F.bool_or(path.rlike(r"(^|/)tests?/|test")).alias("has_test"),
        F.bool_or(path.rlike(r"\.(md|rst|txt)$|(^|/)docs?/")).alias("has_doc"),
        F.max(F.when(d.rlike(SECRET), 3).when(d.rlike(UNSAFE), 2).when(d.rlike(INJECTION), 1).otherwise(0)).alias("risk"),
    )
    c = commits.select("hash", "project_id", "author_id", kind.alias("type"), substance.alias("substance"), F.when(T.vague(F.col("message")), "vague").otherwise("descriptive").alias("quality"))
    c = c.join(f.withColumnRenamed("commit_hash", "hash"), "hash", "left")
    off = ((F.col("type") == "test") & ~F.col("has_test")) | ((F.col("type") == "docs") & ~F.col("has_doc"))
    risk = F.when(F.col("risk") == 3, "hardcoded_secret").when(F.col("risk") == 2, "unsafe_eval").when(F.col("risk") == 1, "sql_injection").otherwise("none")
    return c.select("hash", "project_id", "author_id", "type", "substance", "quality", F.when(off, "mismatch").otherwise("consistent").alias("consistency"), risk.alias("security"))


def distributions(labelled: DataFrame) -> DataFrame:
    """Counts of every label per project and per author in one pass; author null marks the project's own row."""
    dims = ["type", "substance", "quality", "consistency", "security"]
    x = labelled.where("project_id is not null").select("project_id", "author_id", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("label")) for k in dims))).alias("l")).select("project_id", "author_id", "l.dimension", "l.label").where("label <> 'none' and author_id is not null")
    g = x.groupingSets([["project_id", "author_id", "dimension", "label"], ["project_id", "dimension", "label"]], "project_id", "author_id", "dimension", "label")
    return g.agg(F.count("*").alias("n"))


def rates(labelled: DataFrame, timed: DataFrame) -> DataFrame:
    """Counts per project and author that scores are made of. timed has hash, commit_ts, deadline, insertions, deletions."""
    h = T.hours_before(F.col("commit_ts"), F.col("deadline"))
    j = labelled.where("project_id is not null and author_id is not null").join(timed.select("hash", "commit_ts", "deadline", "insertions", "deletions"), "hash")
    one = lambda c: F.count_if(c)
    return j.groupBy("project_id", "author_id").agg(
        F.count("*").alias("n_commits"),
        F.sum(F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("n_lines"),
        F.sum(F.coalesce("insertions", F.lit(0))).alias("n_added"),
        one(F.col("substance") == "substantial").alias("n_substantial"),
        one(F.col("substance") == "moderate").alias("n_moderate"),
        one(F.col("substance") == "trivial").alias("n_trivial"),
        one(F.col("quality") == "vague").alias("n_vague"),
        one(F.col("consistency") == "mismatch").alias("n_mismatch"),
        one(F.col("security") != "none").alias("n_security"),
        one(h < 0).alias("n_late"),
        one((h >= 0) & (h <= 48)).alias("n_near"),
        F.bool_or(F.col("deadline").isNotNull()).alias("tracked"),
    )


def scores(r: DataFrame, inequality: DataFrame) -> DataFrame:
    """Score from 10 down, with its deductions, suspicion of free riding and band. inequality has project_id, gini."""
    p = Window.partitionBy("project_id")
    x = r.join(inequality.select("project_id", "gini"), "project_id", "left")
    x = x.withColumn("members", F.count("*").over(p)).withColumn("all_commits", F.sum("n_commits").over(p)).withColumn("all_lines", F.sum("n_lines").over(p)).withColumn("fewest", F.min("n_commits").over(p))
    fair = 100.0 / F.col("members")
    cs = 100.0 * F.col("n_commits") / F.col("all_commits")
    ls = F.when(F.col("all_lines") > 0, 100.0 * F.col("n_lines") / F.col("all_lines")).otherwise(0.0)
    several = F.col("members") > 1
    by_share = several & ((cs < fair / 2) | (ls < fair / 2))
    by_gini = several & (F.coalesce("gini", F.lit(0.0)) >= 0.5) & (F.col("n_commits") == F.col("fewest"))
    ratio = F.greatest(cs, ls) / fair
    work = F.when(~several, 0).when(ratio < 0.15, 3).when(ratio < 0.4, 2).when(ratio < 0.75, 1).otherwise(0)
    rated = F.col("n_substantial") + F.col("n_moderate") + F.col("n_trivial")
    trivial = F.col("n_trivial") / rated
    meaning = F.when(rated == 0, 0).when(F.col("n_trivial") == rated, 6).when(trivial >= 0.75, 3).when(trivial >= 0.5, 1).otherwise(0)
    vague, off = 100.0 * F.col("n_vague") / F.col("all_commits"), 100.0 * F.col("n_mismatch") / F.col("all_commits")
    quality = F.when(vague > 50, 3).when(vague > 30, 2).when(vague > 10, 1).otherwise(0) + F.when(off > 30, 4).when(off > 15, 2).otherwise(0) + F.least(F.lit(WORSE), F.col("n_security"))
    time = F.when(F.col("tracked"), F.least(F.lit(2), F.col("n_late"))).otherwise(0)
    x = x.select("project_id", "author_id", by_share.alias("by_share"), by_gini.alias("by_gini"), work.cast("int").alias("workload"), meaning.cast("int").alias("meaningful"), quality.cast("int").alias("quality"), time.cast("int").alias("timing"))
    x = x.withColumn("score", F.greatest(F.lit(0), 10 - F.col("workload") - F.col("meaningful") - F.col("quality") - F.col("timing"))).withColumn("free_rider", F.col("by_share") | F.col("by_gini"))
    flags = F.array_compact(F.array(F.when(F.col("by_share"), "share"), F.when(F.col("by_gini") & ~F.col("by_share"), "gini"), F.when(F.col("meaningful") == 6, "only_trivial"), F.when(F.col("meaningful") == 3, "mostly_trivial")))
    return x.withColumn("flags", F.array_join(flags, ",")).withColumn("band", band(F.col("score"), F.col("free_rider"), F.lit(False))).drop("by_share", "by_gini")


def band(score: Column, free_rider: Column, unverified: Column) -> Column:
    return F.when(unverified, "Unverified").when((score >= 8) & ~free_rider, "High Quality").when(score >= 5, "Moderate").otherwise("Poor")


# Separators between a band and its reason, in order of precedence, and words that mark a band.
SEPARATORS = [" - ", " — ", " – ", ": "]
BAND_WORDS = "high|moderate|poor|low|medium|quality|risk|verified|unverified"


def rewritten(text: Column, new_band: Column, default: Column) -> Column:
    """A free-text verdict with its band replaced: what stands before the first separator goes if it looks like a band."""
    t = F.trim(F.coalesce(text, F.lit("")))
    head: Column = t
    tail: Column = F.lit("")
    for sep in reversed(SEPARATORS):
        at = F.instr(t, F.lit(sep))
        head = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(head)
        tail = F.when(at > 0, F.substr(t, at + len(sep))).otherwise(tail)
    parts = F.filter(F.split(F.trim(head), r"\s+"), lambda x: x != "")
    like = (F.size(parts) <= 5) & (F.size(parts) > 0) & F.lower(head).rlike(BAND_WORDS) & (head != t)
    reason = F.when(like, F.trim(tail)).otherwise(t)
    return F.concat(new_band, F.when(F.coalesce(F.nullif(reason, F.lit("")), default) != "", F.concat(F.lit(" - "), F.coalesce(F.nullif(reason, F.lit("")), default))).otherwise(""))


def red_flags(r: DataFrame, resurrected: DataFrame | None = None) -> DataFrame:
    """Project-wide warnings from the counts of its authors."""
    s = r.groupBy("project_id").agg(*(F.sum(c).alias(c) for c in ("n_commits", "n_late", "n_trivial", "n_vague", "n_security", "n_substantial")), F.bool_or("tracked").alias("tracked"))
    s = s.join(resurrected, "project_id", "left") if resurrected is not None else s.withColumn("n_resurrected", F.lit(0))
    n = F.col("n_commits")
    flags = F.array_compact(F.array(F.when(F.col("tracked") & (F.col("n_late") > 0), "late"), F.when(F.col("n_trivial") > 0.5 * n, "trivial"), F.when(F.col("n_vague") > 0.3 * n, "vague"), F.when(F.col("n_security") > 0, "security"), F.when(F.col("n_resurrected") > 0, "resurrection")))
    ratio = F.when((F.col("n_substantial") > 0) | (F.col("n_trivial") > 0), F.round(F.col("n_substantial") / F.greatest(F.col("n_trivial"), F.lit(1)), 6))
    return s.select("project_id", F.array_join(flags, ",").alias("flags"), ratio.alias("substantial_to_trivial"))


def reliability(labelled: DataFrame, worst: float = 0.9) -> DataFrame:
    """Per project the largest share that one label of a dimension has; above ``worst`` the labels say little."""
    n = distributions(labelled).where("author_id is null").groupBy("project_id", "dimension").agg((F.max("n") / F.sum("n")).alias("top"))
    return n.select("project_id", "dimension", F.round("top", 6).alias("top_share"), (F.col("top") > worst).alias("low"))


def resurrections(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Lines that one author removed and another added later in the same project, compared exactly and counted by line.

    changes has commit_hash and raw_diff, commits hash, project_id, author_id, commit_ts; a line is known by its digest from
    the scan on, so that no diff is shuffled. Only the earliest removal and the latest addition of a line
    and author matter, and of the authors who removed it the first two, as whoever adds it can be only one of them.
    """
    who = commits.where("project_id is not null and author_id is not null and commit_ts is not null").select(F.col("hash").alias("commit_hash"), "project_id", "author_id", "commit_ts")
    long = lambda sign: F.transform(F.filter(T.diff_lines(F.col("raw_diff"), sign), lambda l: F.length(l) >= 20), F.md5)  # noqa: E731, E741
    marked = lambda sign: F.transform(F.array_distinct(long(sign)), lambda l: F.struct(F.lit(sign).alias("sign"), l.alias("line")))  # noqa: E731, E741
    lines = changes.where("raw_diff is not null").select("commit_hash", F.explode_outer(F.concat(marked("-"), marked("+"))).alias("l")).where("l is not null").select("commit_hash", "l.sign", "l.line").distinct()
    x = lines.join(who, "commit_hash")
    one = lambda sign, pick, name: x.where(F.col("sign") == sign).groupBy("project_id", "line", "author_id").agg(pick("commit_ts").alias(name))
    first = Window.partitionBy("project_id", "line").orderBy("gone", "author_id")
    gone = one("-", F.min, "gone").withColumn("rank", F.row_number().over(first)).where("rank <= 2")
    back = one("+", F.max, "back").withColumnRenamed("author_id", "by")
    j = gone.join(back, ["project_id", "line"]).where("by <> author_id and back > gone")
    return j.groupBy("project_id").agg(F.count_distinct("line").cast("int").alias("n_resurrected"))
