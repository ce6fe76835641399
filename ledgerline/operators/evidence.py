"""Evidence rows of reports: shares over people, examples, similar partners, verdicts, upkeep of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scoring as sc

# What a contributor's row says who is only named in co-author trailers.
CO_AUTHOR_VERDICT = "Unverified (Co-author, 0 direct commits pushed)"
# States that a stored report may be given, and modes of sampling.
REPORT_STATES = ["Needs Review", "Confirmed", "Dismissed"]
SAMPLING_MODES = ["full", "sample", "random"]


def language_shares(lines: DataFrame, stacks: DataFrame) -> DataFrame:
    """project_id, language, pct of added lines to one place (ties to even), shares of 0 left out.

    A project without counted lines has its most likely language with 100.0; stacks has project_id, stack.
    """
    total = F.sum("lines").over(Window.partitionBy("project_id"))
    shares = lines.withColumn("total", total).where("total > 0").select("project_id", "language", F.bround(100.0 * F.col("lines") / F.col("total"), 1).alias("pct"))
    guess = stacks.join(shares.select("project_id").distinct(), "project_id", "left_anti").select("project_id", F.split("stack", ",")[0].alias("language"), F.lit(100.0).alias("pct"))
    return shares.where("pct > 0").unionByName(guess)


def human_shares(rates: DataFrame, people: DataFrame) -> DataFrame:
    """Rates per project and author with the shares of commits and lines over its active humans, to one place.

    people has author_id, is_bot. expected_pct is an equal share; fewest marks whoever has the least commits.
    """
    p = Window.partitionBy("project_id")
    r = rates.join(people, "author_id", "left").where(~F.coalesce("is_bot", F.lit(False))).drop("is_bot")
    pct = lambda part, whole: F.when(whole > 0, F.bround(100.0 * part / whole, 1)).otherwise(0.0)
    n = F.count("*").over(p)
    return r.select(
        "project_id", "author_id", "n_commits", "n_lines", "n_substantial", "n_moderate", "n_trivial", "n_vague", "n_mismatch", "n_security", "n_late", "n_near",
        pct(F.col("n_commits"), F.sum("n_commits").over(p)).alias("commit_pct"),
        pct(F.col("n_lines"), F.sum("n_lines").over(p)).alias("line_pct"),
        F.bround(100.0 / n, 1).alias("expected_pct"),
        (F.col("n_commits") == F.min("n_commits").over(p)).alias("fewest"),
    )


def with_silent(rows: DataFrame, silent: DataFrame) -> DataFrame:
    """Contributor rows and, with negative ids and zeros, the people whom only trailers name (project_id, email)."""
    number = (-F.row_number().over(Window.partitionBy("project_id").orderBy("email"))).cast("int")
    extra = silent.select("project_id", number.alias("author_id"))
    for name, kind in rows.dtypes:
        if name not in ("project_id", "author_id"):
            value = F.lit(False) if kind == "boolean" else F.lit("Unverified") if name == "band" else F.lit("") if kind == "string" else F.lit(0)
            extra = extra.withColumn(name, value.cast(kind))
    return rows.unionByName(extra)


def examples(labelled: DataFrame, timed: DataFrame, n: int = 3) -> DataFrame:
    """project_id, author_id, kind, rank, hash: of every author the first substantial and trivial commits, and all late ones.

    timed has hash, commit_ts, deadline; first means earliest, unknown times last, ties by hash.
    """
    x = labelled.where("project_id is not null and author_id is not null").join(timed.select("hash", "commit_ts", "deadline"), "hash")
    late = F.when(F.col("commit_ts") > F.col("deadline"), F.lit("late"))
    kinds = F.array_compact(F.array(F.when(F.col("substance").isin("substantial", "trivial"), F.col("substance")), late))
    x = x.select("project_id", "author_id", "hash", "commit_ts", F.explode_outer(kinds).alias("kind")).where("kind is not null")
    rank = F.row_number().over(Window.partitionBy("project_id", "author_id", "kind").orderBy(F.asc_nulls_last("commit_ts"), "hash"))
    return x.withColumn("rank", rank).where((F.col("kind") == "late") | (F.col("rank") <= n)).select("project_id", "author_id", "kind", "rank", "hash")


def most_similar(reports: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project the report with the highest score: partner, score to one place (fractions as percent), hashes in common."""
    ends = reports.select(F.col("pa").alias("id"), F.col("pb").alias("partner"), "score", "surviving").unionByName(reports.select(F.col("pb").alias("id"), F.col("pa").alias("partner"), "score", "surviving"))
    best = ends.groupBy("id").agg(F.min_by(F.struct("partner", "score", "surviving"), F.struct(-F.col("score"), F.col("partner"))).alias("b")).select("id", "b.*")
    names = projects.select(F.col("id").alias("partner"), F.col("name").alias("partner_name"))
    j = projects.select("id").join(best, "id", "left").join(names, "partner", "left")
    score = F.when(F.col("score") <= 1, F.bround(F.col("score") * 100, 1)).otherwise(F.bround("score", 1))
    return j.select(F.col("id").alias("project_id"), F.col("score").isNotNull().alias("has_scan"), F.coalesce(score, F.lit(0.0)).alias("max_score"), F.when(F.col("score").isNotNull(), F.coalesce("partner_name", F.concat(F.lit("Project #"), "partner"))).alias("partner_name"), F.coalesce("surviving", F.lit(0)).cast("int").alias("n_hashes"))


def top_blocks(runs: DataFrame, reports: DataFrame, clusters: DataFrame, n: int = 5) -> DataFrame:
    """The longest common blocks of every reported pair, seen from both sides, with the cluster of the project."""
    order = Window.partitionBy("scope", "pa", "pb").orderBy(F.desc("n"), "file_a", "line_a", "file_b", "line_b")
    r = runs.join(reports.select("scope", "pa", "pb", "score"), ["scope", "pa", "pb"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    side = lambda me, other: r.select(F.col(f"p{me}").alias("project_id"), F.col(f"p{other}").alias("partner"), "score", "rank", F.col(f"file_{me}").alias("own_file"), F.col(f"line_{me}").alias("own_line"), F.col(f"file_{other}").alias("other_file"), F.col(f"line_{other}").alias("other_line"), F.col("n").alias("run_length"))
    return side("a", "b").unionByName(side("b", "a")).join(clusters.select("project_id", "cluster"), "project_id", "left")


# Words of a review that gives a reason, and the marks of the three kinds of review.
REASONED = r"\b(because|since|instead|should|so that|therefore|avoid|handle|validate|fix)\b"


def review_kind(message: Column) -> Column:
    """Rule for a review remark: one that gives a reason is constructive, one of up to three words a rubber stamp."""
    m = F.lower(T.stripped(message))
    return F.when(m.rlike(REASONED), "constructive_review").when(F.size(F.filter(F.split(m, r"\s+"), lambda w: w != "")) <= 3, "rubber_stamp").otherwise("minor_feedback")


def peer_reviews(commits: DataFrame) -> DataFrame:
    """Per project the mean score of the first remark of every author, and how many were constructive or rubber stamps."""
    first = F.row_number().over(Window.partitionBy("project_id", "author_id").orderBy(F.asc_nulls_last("commit_ts"), "hash"))
    x = commits.where("project_id is not null and author_id is not null").withColumn("r", first).where("r = 1").select("project_id", review_kind(F.col("message")).alias("kind"))
    score = F.when(F.col("kind") == "constructive_review", 8).when(F.col("kind") == "rubber_stamp", 3).otherwise(5)
    return x.groupBy("project_id").agg(F.bround(F.avg(score), 1).alias("avg_score"), F.count("*").alias("n_reviews"), F.count_if(F.col("kind") == "constructive_review").alias("n_constructive"), F.count_if(F.col("kind") == "rubber_stamp").alias("n_rubber_stamps"))


# --- texts of a report -----------------------------------------------------------------------------------------


def quality_meta(text: Column) -> Column:
    """score, band and severity of a text like "8/10 (High Quality)"; 5 where it holds no number."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1)
    score = F.when(found == "", 5).otherwise(found.cast("int"))
    return F.struct(score.alias("score"), F.when(score >= 8, "High").when(score >= 5, "Moderate").otherwise("Poor").alias("band"), F.when(score >= 8, "ok").when(score >= 5, "warn").otherwise("danger").alias("severity"))


def gini_meta(text: Column) -> Column:
    """value, label and severity of a text like "0.42 (Uneven)"; a label is made up where none stands in parentheses."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract(t, r"([0-9]*\.?[0-9]+)", 1)
    value = F.when(found == "", 0.0).otherwise(found.cast("double"))
    label = F.regexp_extract(t, r"\(([^)]+)\)", 1)
    made = F.when(value < 0.3, "Balanced").when(value < 0.5, "Uneven").otherwise("Highly uneven")
    return F.struct(value.alias("value"), F.when(label == "", made).otherwise(label).alias("label"), F.when(value < 0.3, "ok").when(value < 0.5, "warn").otherwise("danger").alias("severity"))


def similarity_severity(score: Column) -> Column:
    s = F.coalesce(score.cast("double"), F.lit(0.0))
    return F.when(s > 50, "danger").when(s > 25, "warn").otherwise("ok")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def contribution_sentence(files: Column, notes: Column, n_substantial: Column, total: Column) -> Column:
    """A sentence of what a contributor did, for markup: files (array of path, n_changes), what commits say, how many count."""
    plural = lambda n: F.when(n != 1, "s").otherwise("")
    named = F.transform(F.slice(F.filter(files, lambda f: F.trim(f["path"]) != ""), 1, 4), lambda f: F.when(f["n_changes"] > 0, F.concat(f["path"], F.lit(" ("), f["n_changes"].cast("string"), F.lit(" edit"), plural(f["n_changes"]), F.lit(")"))).otherwise(f["path"]))
    first_line = F.transform(F.slice(notes, 1, 3), lambda x: F.trim(F.split(F.trim(F.coalesce(x, F.lit(""))), "\n")[0]))
    said = F.transform(F.filter(first_line, lambda x: x != ""), lambda x: F.when(F.length(x) <= 80, x).otherwise(F.concat(F.substring(x, 1, 77), F.lit("..."))))
    parts = F.array_compact(
        F.array(
            F.when(F.size(named) > 0, F.concat(F.lit("Changed "), F.array_join(named, ", "))),
            F.when(F.size(said) > 0, F.concat(F.lit("including "), F.array_join(said, "; "))),
            F.when(n_substantial > 0, F.concat(n_substantial.cast("string"), F.lit(" substantial commit"), plural(n_substantial), F.lit(" sampled"))),
        )
    )
    text = F.array_join(parts, "; ")
    none = F.when(total > 0, F.concat(F.lit("Limited sampled detail ("), total.cast("string"), F.lit(" commit(s) recorded; see contribution share above)."))).otherwise("No sampled contribution detail available.")
    return escaped(F.when(F.size(parts) > 0, F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)), F.lit("."))).otherwise(none))


def reconciled(evaluations: DataFrame, people: DataFrame, silent: DataFrame) -> DataFrame:
    """Verdicts of a report brought in line with computed scores.

    evaluations has project_id, student_name, verdict; people project_id, name, band; silent project_id, name. Names meet
    without case and outer blanks; one that meets nothing is tried again without what stands in parentheses behind it.
    Verdicts of people who aren't known stay. Co-authors without commits who have no row get one. Ordered by quality.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = people.select("project_id", key(F.col("name")).alias("k"), "band").where("k <> ''").groupBy("project_id", "k").agg(F.max("band").alias("band"))
    e = evaluations.withColumn("k", key(F.col("student_name"))).withColumn("k2", F.trim(F.split("k", r" \(")[0]))
    j = e.join(known.withColumnRenamed("band", "b1"), ["project_id", "k"], "left").join(known.select("project_id", F.col("k").alias("k2"), F.col("band").alias("b2")), ["project_id", "k2"], "left")
    band = F.coalesce("b1", F.when(F.col("k").contains(" ("), F.col("b2")))
    rows = j.select("project_id", "student_name", F.when(band.isNull(), F.col("verdict")).otherwise(sc.rewritten(F.col("verdict"), band, F.lit(""))).alias("verdict"))
    there = e.select("project_id", "k").distinct()
    extra = silent.withColumn("k", key(F.col("name"))).where("k <> ''").join(there, ["project_id", "k"], "left_anti").groupBy("project_id", "k").agg(F.min("name").alias("student_name"))
    out = rows.unionByName(extra.select("project_id", "student_name", F.lit(CO_AUTHOR_VERDICT).alias("verdict")))
    return out.withColumn("quality_rank", quality_rank(F.col("verdict")))


def quality_rank(verdict: Column) -> Column:
    v = F.lower(F.coalesce(verdict, F.lit("")))
    return F.when(v.rlike("high quality|low risk|strong|solid|good"), 1).when(v.rlike("moderate|medium|fair|minor"), 2).otherwise(3)


def filled(stored: DataFrame, computed: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """Stored reports with the sections that they lack (null or empty) taken from computed ones; what is there stays."""
    c = computed.select(key, *(F.col(s).alias(f"_{s}") for s in sections))
    lacks = lambda s: F.col(s).isNull() | (F.col(s).cast("string").isin("", "[]", "{}"))
    return stored.join(c, key, "left").select(key, *(F.when(lacks(s), F.col(f"_{s}")).otherwise(F.col(s)).alias(s) for s in sections))


# --- upkeep of stored tables -----------------------------------------------------------------------------------


def without_projects(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without some projects (column id) and all that hangs on them: commits, changes, fingerprints, issues, and
    reports on either side."""
    out = dict(tables)
    drop = lambda df, c: df.join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti")
    out["projects"] = drop(tables["projects"], "id")
    lost = tables["commits"].join(gone.select(F.col("id").alias("project_id")).distinct(), "project_id", "left_semi").select(F.col("hash").alias("commit_hash")).distinct()
    for name in ("commits", "project_fingerprints", "identity_issues", "documents"):
        if name in tables:
            out[name] = drop(tables[name], "project_id")
    if "file_changes" in tables:
        out["file_changes"] = tables["file_changes"].join(lost, "commit_hash", "left_anti")
    if "reports" in tables:
        out["reports"] = drop(drop(tables["reports"], "pa"), "pb")
    return out


def updated(rows: DataFrame, key: str, column: str, changes: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows with a column set anew from changes (key, value), where the value, in any case, is one of those allowed."""
    valid = F.create_map(*(F.lit(x) for a in allowed for x in (a.lower(), a)))
    c = changes.select(F.col("key").alias(key), valid[F.lower(F.trim("value"))].alias("_new")).where("_new is not null").groupBy(key).agg(F.max("_new").alias("_new"))
    return rows.join(c, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def tree_nodes(paths: DataFrame, key: str, path: str, ignored: list[str]) -> DataFrame:
    """Nodes of the directory trees under ``key``: path, name, kind, depth, parent; hidden and ignored entries are left out
    with all below them."""
    parts = F.filter(F.split(T.path(F.col(path)), "/"), lambda x: x != "")
    p = paths.select(F.col(key).alias("k"), parts.alias("parts")).where(F.size("parts") > 0).distinct()
    p = p.where(~F.exists("parts", lambda x: x.startswith(".")) & ~F.arrays_overlap("parts", F.array(*map(F.lit, ignored))))
    n = p.select("k", "parts", F.posexplode_outer("parts").alias("i", "name"))
    n = n.select("k", F.array_join(F.slice("parts", F.lit(1), F.col("i") + 1), "/").alias("path"), "name", (F.col("i") + 1).alias("depth"), (F.col("i") + 1 < F.size("parts")).alias("inner"), F.array_join(F.slice("parts", F.lit(1), F.col("i")), "/").alias("parent"))
    return n.groupBy("k", "path", "name", "depth", "parent").agg(F.max("inner").alias("inner")).select(F.col("k").alias(key), "path", "name", "depth", "parent", F.when(F.col("inner"), "directory").otherwise("file").alias("kind"))


def safe_path(path: Column) -> Column:
    """A relative path with its . and .. resolved, or null where it would leave the directory or is absolute."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(True).alias("ok"))
    step = lambda a, x: F.struct(F.when(x == "..", F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0)))).otherwise(F.concat(a["done"], F.array(x))).alias("done"), (a["ok"] & ((x != "..") | (F.size(a["done"]) > 0))).alias("ok"))
    out = F.aggregate(parts, start, step)
    return F.when(out["ok"] & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & (F.size(out["done"]) > 0), F.array_join(out["done"], "/"))
