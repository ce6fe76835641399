"""Bringing tables in and keeping them in step: mailmaps, blame text, author upserts, incremental writes, atomic replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def mailmap(lines: DataFrame, column: str = "value") -> DataFrame:
    """commit_email, email, name from the lines of a mailmap: the first address is the proper one; later lines win."""
    t = F.trim(column)
    x = lines.select(F.monotonically_increasing_id().alias("n"), t.alias("t")).where("t <> '' and not startswith(t, '#')")
    m = F.regexp_extract_all("t", F.lit(r"<([^>]+)>"), F.lit(1))
    x = x.withColumn("m", m).where("size(m) >= 2").select("n", F.lower(F.trim(F.col("m")[1])).alias("commit_email"), F.lower(F.trim(F.col("m")[0])).alias("email"), F.nullif(F.trim(F.regexp_extract("t", r"^([^<]+)", 1)), F.lit("")).alias("name"))
    return x.groupBy("commit_email").agg(F.max_by(F.struct("email", "name"), "n").alias("v")).select("commit_email", "v.email", "v.name")


def apply_mailmap(people: DataFrame, mapping: DataFrame, email: str, name: str) -> DataFrame:
    m = mapping.select(F.col("commit_email").alias("_key"), F.col("email").alias("_email"), F.col("name").alias("_name"))
    j = people.join(m, F.lower(F.trim(F.col(email))) == F.col("_key"), "left")
    return j.withColumn(email, F.coalesce("_email", email)).withColumn(name, F.coalesce("_name", name)).drop("_key", "_email", "_name")


def blame(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines per address from blame text, one ``(<address> ...)`` a line."""
    x = texts.select(key, F.explode(F.split(text, "\n")).alias("l")).select(key, F.lower(F.regexp_extract("l", r"<([^>]+)>", 1)).alias("email")).where("email <> ''")
    return x.groupBy(key, "email").agg(F.count("*").alias("lines"))


def new_rows(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of a batch that aren't stored yet, each key once."""
    return batch.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def author_upsert(commits: DataFrame, first: str = "commit_ts") -> DataFrame:
    """One row per address: the name first seen and all names seen, in order."""
    c = commits.where("committer_email is not null").select(F.lower(F.trim("committer_email")).alias("email"), F.trim("committer_name").alias("name"), first)
    n = c.where("name is not null").groupBy("email", "name").agg(F.min(first).alias("since"))
    return n.groupBy("email").agg(F.min_by("name", F.struct("since", "name")).alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("since", "name"))), lambda x: x["name"]), "|").alias("variants"))


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def checked_merge(links: DataFrame, source: int, target: int) -> DataFrame:
    """Author links with ``source`` merged into the root of ``target``; refuses a merge with itself or into its own tree."""
    from ..operators.contribution import canonical_map

    canon = {r["author_id"]: r["root_id"] for r in canonical_map(links).where(F.col("author_id").isin([source, target])).collect()}
    if source == target or canon.get(target) is None or canon.get(target) == source:
        raise ValueError("an author can't be merged into itself or its own aliases")
    return links.withColumn("canonical_author_id", F.when(F.col("id") == source, canon[target]).otherwise(F.col("canonical_author_id")).cast("int"))


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the source files of a checkout that take part in comparisons."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace("path", "^.*?" + path.strip("/").replace(".", r"\.") + "/", "")
    return f.select(rel.alias("path"), F.translate(F.decode("content", F.lit("UTF-8")), "\0", "").alias("text")).where(T.compared(F.col("path")))


def directory_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size of all files under a directory, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace("path", "^.*?" + path.strip("/").replace(".", r"\.") + "/", "")
    return f.select(rel.alias("path"), F.col("length").alias("size"))


def file_content(spark: SparkSession, root: str, path: str) -> DataFrame:
    """path, text of one file below a directory; refuses a path that leads out of it."""
    from ..operators.evidence import safe_path

    inside = spark.range(1).select(safe_path(F.lit(path)).alias("p")).first()["p"]
    if inside is None:
        raise PermissionError("the path leads out of the directory")
    f = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{inside}")
    return f.select(F.lit(inside).alias("path"), F.decode("content", F.lit("UTF-8")).alias("text"))
