"""Signals about who is behind an account. Pairs come from equality on names, tokens and pieces of addresses, never from
comparing everyone of a project with everyone else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def members(commits: DataFrame, authors: DataFrame, canon: DataFrame) -> DataFrame:
    """project_id, id, root_id, name, email of every account that committed to a project."""
    a = authors.join(canon.select(F.col("author_id").alias("id"), "root_id"), "id")
    return commits.where("project_id is not null and author_id is not null").select("project_id", F.col("author_id").alias("id")).distinct().join(a, "id")


def _grams(c: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3)))


def _inside(needles: DataFrame, addresses: DataFrame) -> DataFrame:
    """project_id, ra, rb, key for every needle (project_id, root_id, key; three letters or more) that stands inside an address
    (project_id, rb, local) of its project. They meet at the needle's rarest group of three letters."""
    hay = addresses.select("project_id", "rb", "local", F.explode_outer(_grams("local")).alias("gram"))
    spread = hay.groupBy("gram").agg(F.count("*").alias("n"))
    each = needles.select("project_id", F.col("root_id").alias("ra"), "key", F.explode_outer(_grams("key")).alias("gram")).join(spread, "gram", "left")
    rarest = each.groupBy("project_id", "ra", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return rarest.join(hay, ["project_id", "gram"]).where(F.contains("local", "key")).select("project_id", "ra", "rb", "key")


def split_identities(people: DataFrame) -> DataFrame:
    """Pairs of different roots of a project that may be one person: root_a < root_b, confidence and the checks met.

    Checks: equal names; the login of a no-reply address inside the other's address; a name token of four letters or
    more inside the other's address; half of the name tokens in common.
    """
    p = people.select("project_id", "id", "root_id", T.plain_name(F.col("name")).alias("plain"), T.name_tokens(F.col("name")).alias("tokens"), T.mail_local(F.col("email")).alias("local"), F.lower(F.coalesce("email", F.lit(""))).contains("noreply").alias("hidden"))

    def meet(a: DataFrame, b: DataFrame, check: str, level) -> DataFrame:
        left = a.select("project_id", "key", F.col("root_id").alias("ra"), *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in ("project_id", "key", "root_id")])
        right = b.select("project_id", "key", F.col("root_id").alias("rb"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in ("project_id", "key", "root_id")])
        j = left.join(right, ["project_id", "key"]).where("ra <> rb")
        return j.select("project_id", F.least("ra", "rb").alias("root_a"), F.greatest("ra", "rb").alias("root_b"), F.lit(check).alias("check"), level.alias("level"))

    named = p.where("plain <> ''").select("project_id", "root_id", F.col("plain").alias("key")).distinct()
    same = meet(named, named, "name", F.lit(2))
    addresses = p.where("length(local) >= 3").select("project_id", F.col("root_id").alias("rb"), "local").distinct()
    token = p.select("project_id", "root_id", F.explode("tokens").alias("key")).distinct()
    login = p.where("hidden and length(local) >= 3").select("project_id", "root_id", F.col("local").alias("key")).distinct()
    pair = lambda j, check, level: j.where("ra <> rb").select("project_id", F.least("ra", "rb").alias("root_a"), F.greatest("ra", "rb").alias("root_b"), F.lit(check).alias("check"), level.alias("level"))
    by_login = meet(login, token.where("length(key) >= 3"), "login", F.lit(2)).unionByName(pair(_inside(login, addresses), "login", F.lit(2)))
    by_token = pair(_inside(token.where("length(key) >= 4"), addresses), "token", F.when(F.length("key") >= 6, 2).otherwise(1))
    each = p.select("project_id", "id", "root_id", F.size("tokens").alias("size"), F.explode("tokens").alias("key"))
    left = each.select("project_id", "key", F.col("id").alias("ia"), F.col("root_id").alias("ra"), F.col("size").alias("sa"))
    right = each.select("project_id", "key", F.col("id").alias("ib"), F.col("root_id").alias("rb"), F.col("size").alias("sb"))
    common = left.join(right, ["project_id", "key"]).where("ra < rb").groupBy("project_id", "ia", "ib", "ra", "rb", "sa", "sb").count()
    j = F.col("count") / (F.col("sa") + F.col("sb") - F.col("count"))
    by_common = common.where(j >= 0.5).select("project_id", F.col("ra").alias("root_a"), F.col("rb").alias("root_b"), F.lit("tokens").alias("check"), F.when(j >= 0.75, 2).otherwise(1).alias("level"))
    found = same.unionByName(by_login).unionByName(by_token).unionByName(by_common)
    return found.groupBy("project_id", "root_a", "root_b").agg(F.when(F.max("level") == 2, "HIGH").otherwise("MEDIUM").alias("confidence"), F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))


def shared_accounts(authors: DataFrame) -> DataFrame:
    """Accounts under at least two different names."""
    forms = F.array_union(F.array(F.col("name")), F.coalesce(F.from_json("name_variants", "array<string>"), F.array().cast("array<string>")))
    a = authors.select("id", F.array_distinct(F.filter(F.transform(forms, T.plain_name), lambda x: x != "")).alias("names"))
    return a.where("size(names) >= 2").select("id", F.size("names").alias("n_names"))


def pushed_by_other(commits: DataFrame, authors: DataFrame) -> DataFrame:
    """Authors of at least three commits of which most were committed from another address; the most frequent of these."""
    c = commits.where("author_id is not null and committer_email is not null").select("author_id", F.lower(F.trim("committer_email")).alias("committer"))
    c = c.join(authors.select(F.col("id").alias("author_id"), F.lower(F.trim("email")).alias("email")), "author_id").where("email is not null")
    n = c.groupBy("author_id", "email", "committer").agg(F.count("*").alias("n"))
    w = Window.partitionBy("author_id")
    n = n.withColumn("total", F.sum("n").over(w)).where("committer <> email")
    r = n.groupBy("author_id").agg(F.max("total").alias("n_commits"), F.sum("n").alias("n_other"), F.min_by("committer", F.struct(-F.col("n"), F.col("committer"))).alias("top_committer"))
    return r.where("n_commits >= 3 and n_other > 0.5 * n_commits")


def cross_submissions(commits: DataFrame, authors: DataFrame) -> DataFrame:
    """Addresses whose accounts committed to more than one project."""
    a = authors.select(F.col("id").alias("author_id"), F.lower(F.trim("email")).alias("email")).where("email <> ''")
    c = commits.where("project_id is not null").select("author_id", "project_id").distinct().join(a, "author_id")
    return c.groupBy("email").agg(F.count_distinct("project_id").alias("n_projects"), F.min("project_id").alias("first_project"), F.max("project_id").alias("last_project")).where("n_projects > 1")


def team_kinds(people: DataFrame, silent: DataFrame) -> DataFrame:
    """solo: one contributor and no co-author; proxy: one who names others; team."""
    n = people.groupBy("project_id").agg(F.count_distinct("root_id").alias("n_people"))
    s = silent.groupBy("project_id").agg(F.count("*").alias("n_silent"))
    j = n.join(s, "project_id", "left").withColumn("n_silent", F.coalesce("n_silent", F.lit(0)).cast("bigint"))
    return j.withColumn("kind", F.when(F.col("n_people") > 1, "team").when(F.col("n_silent") > 0, "proxy").otherwise("solo"))


def unmerged_issues(issues: DataFrame, canon: DataFrame) -> DataFrame:
    """Issues without those whose accounts (two or more of them known) have all been merged into one."""
    i = issues.select("issue_id", "kind", F.array_distinct(F.filter("author_ids", lambda x: x.isNotNull())).alias("ids")).distinct()
    x = i.select("issue_id", "kind", F.explode("ids").alias("author_id")).join(canon, "author_id")
    merged = x.groupBy("issue_id", "kind").agg(F.count_distinct("author_id").alias("n"), F.count_distinct("root_id").alias("roots")).where("n >= 2 and roots = 1")
    return i.select("issue_id", "kind").distinct().join(merged, ["issue_id", "kind"], "left_anti")
