"""Queries of the training-data problems over the project's tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import groups_from_lists
from .generated import generated_files
from .leakage import leaked_items
from .names import pairs_of, same_names
from .packing import pack, with_token_counts
from .prose import not_prose, prose_share
from .quality import COMMON_WORDS, rule_failures, text_statistics
from .secrets import find_secrets, redact
from .spans import shared_spans


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """Each file change once; repeated rows of an id are copies."""
    return _table(spark, d, "file_changes").select("id", "filename", "raw_diff")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    hits = find_secrets(_diffs(spark, d), "id", "raw_diff")
    return hits.select(F.col("id").alias("file_change_id"), "line_no").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The diffs that held credentials, with these blanked out."""
    return redact(_diffs(spark, d), "id", "raw_diff").where("n_redacted > 0").distinct().withColumnRenamed("id", "file_change_id")


def _by_hand(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "file_changes").select("id", "filename", "raw_diff", "commit_hash")
    repos = _table(spark, d, "commits").select(F.col("hash").alias("link"), F.col("project_id").cast("string").alias("repo"))
    return generated_files(files, "id", "filename", "raw_diff", "commit_hash", repos)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _by_hand(spark, d).select(F.col("id").alias("file_change_id"))


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _by_hand(spark, d).groupBy("reason").agg(F.count("*").alias("n_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kind = F.regexp_replace(F.lower(F.trim("kind")), "-", "_")
    issues = _table(spark, d, "identity_issues").where(kind.isin("split_identity", "cross_submission"))
    groups = groups_from_lists(issues, "author_ids", _table(spark, d, "authors"), "id")
    return groups.select(F.col("node").alias("author_id"), F.col("component").alias("group_id"))


def p5_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_authors"))


def _fingerprinted_files(spark: SparkSession, d: str) -> DataFrame:
    """id (project:path), seq: the hashes of each fingerprinted file in order of their places, each place once."""
    prints = _table(spark, d, "project_fingerprints").select("project_id", "file_path", "token_pos", "hash_value").where("file_path is not null and token_pos is not null and hash_value is not null")
    files = prints.groupBy("project_id", "file_path", "token_pos").agg(F.min("hash_value").alias("hash_value"))
    return files.groupBy(F.concat_ws(":", "project_id", "file_path").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "hash_value"))), lambda x: x["hash_value"]).alias("seq"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    diffs = _table(spark, d, "file_changes").select("id", F.col("raw_diff").alias("seq"))
    # The two kinds of records share nothing: their jobs run side by side.
    with ThreadPoolExecutor(2) as pool:
        by_text = pool.submit(shared_spans, diffs, span=200, k=100, text=True)
        by_hash = pool.submit(shared_spans, _fingerprinted_files(spark, d), span=20, k=10, text=False)
        diffs, files = by_text.result(), by_hash.result()
    diffs = diffs.select(F.lit("diff").alias("record_kind"), F.col("id").cast("string").alias("record_key"), "shared_len")
    return diffs.unionByName(files.select(F.lit("file").alias("record_kind"), F.col("id").alias("record_key"), "shared_len"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leaked_items(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "text")
    return hits.select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that fail, by the statistics of their segments; their reasons are in p10_prose."""
    return not_prose(_table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_prose(spark: SparkSession, d: str) -> DataFrame:
    """Per document the share of its characters in prose and the threshold that most of the others fail."""
    s = prose_share(_table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.round("prose_share", 6).alias("prose_share"), "reason")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = text_statistics(_table(spark, d, "documents"), "doc_id", "text")
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("doc_id", "n_words", r("mean_word_length"), r("symbol_share"), r("punctuated_line_share"), r("bullet_line_share"), r("ellipsis_line_share"), r("common_word_share"), r("alpha_word_share"))


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Per document the published rules that it fails, joined by commas."""
    s = text_statistics(_table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.array_join(rule_failures(s), ",").alias("reasons"))


#: A public vocabulary; the queries take the path from the session if it is set there.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _packed(spark: SparkSession, d: str) -> DataFrame:
    path = spark.conf.get("ledgerline.tokenizer", TOKENIZER)
    sizes = with_token_counts(_table(spark, d, "documents"), "doc_id", "text", path)
    return pack(sizes, "doc_id", "n_tokens", 2048)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens in them, the fewest containers that could hold these tokens, and the share of room used."""
    p = _packed(spark, d).where("container_id is not null")
    s = p.agg(F.count_distinct("container_id").alias("n_containers"), F.sum("piece_size").alias("n_tokens"))
    return s.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / 2048).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * 2048), 6).alias("used_share"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return same_names(_table(spark, d, "identity_records"), "id", "name", "email", "name_variants")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(_entities(spark, d), "id", "entity")


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Per record its entity and the number of records linked to it."""
    e = _entities(spark, d)
    return e.join(e.groupBy("entity").agg((F.count("*") - 1).alias("n_links")), "entity").select("id", "entity", "n_links")


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities, "p8_packed": p8_packed, "p8_utilisation": p8_utilisation, "p10_found": p10_found, "p10_prose": p10_prose, "p10_statistics": p10_statistics, "p10_reasons": p10_reasons, "p9_found": p9_found, "p7_found": p7_found, "p5_found": p5_found, "p5_group_sizes": p5_group_sizes, "p4_found": p4_found, "p4_reasons": p4_reasons, "p2_found": p2_found, "p2_redacted": p2_redacted}
_GROUPS = """
with recursive k as (select distinct id from authors where id is not null),
l as (select row_number() over () as r, author_ids from identity_issues where replace(lower(trim(kind)), '-', '_') in ('split_identity', 'cross_submission')),
x as (select distinct r, i from (select r, unnest(author_ids) as i from l) where i in (select id from k)),
e as (select distinct a.i as a, b.i as b from x a join x b on a.r = b.r where a.i <> b.i),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
g as (select a as author_id, least(a, min(b)) as group_id from reach group by a)
"""
_COMMON = ", ".join("'" + w + "'" for w in sorted(set(COMMON_WORDS)))
_STATS = f"""
with t as (select doc_id, replace(coalesce(text, ''), chr(13), '') as t from documents),
p as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\x{{00A0}}]+'), lambda w: w <> '') as w, list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) > 0) as l from t),
q as (select *, len(w) as n, len(l) as m, length(regexp_replace(t, '[ \\t\\n\\x0B\\f]', '', 'g')) as size from p),
s as (select doc_id, cast(n as integer) as n_words,
  case when n > 0 then list_sum(list_transform(w, lambda x: length(x))) / n else 0 end as mean_word_length,
  case when size > 0 then len(regexp_extract_all(t, '[{{}}\\[\\]()=<>_/\\\\|@#$%^&*+~`"]')) / size else 0 end as symbol_share,
  case when m > 0 then len(list_filter(l, lambda x: regexp_matches(x, '[.!?;:…]["''’”»)]*\\s*$'))) / m else 0 end as punctuated_line_share,
  case when m > 0 then len(list_filter(l, lambda x: regexp_matches(x, '^\\s*(?:[-*•+·‣▪◦–—]|\\(?\\d{{1,3}}[.)]|\\[[ xX]\\]|\\(?[a-zA-Z][.)])\\s+'))) / m else 0 end as bullet_line_share,
  case when m > 0 then len(list_filter(l, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)\\s*$'))) / m else 0 end as ellipsis_line_share,
  case when n > 0 then len(list_filter(w, lambda x: lower(regexp_replace(x, '^[^\\p{{L}}\\d]+|[^\\p{{L}}\\d]+$', '', 'g')) in ({_COMMON}))) / n else 0 end as common_word_share,
  case when n > 0 then len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) / n else 0 end as alpha_word_share,
  len(list_distinct(list_filter(list_transform(w, lambda x: lower(regexp_replace(x, '^[^\\p{{L}}\\d]+|[^\\p{{L}}\\d]+$', '', 'g'))), lambda x: x in ({_COMMON})))) as n_common from q)
"""
ORACLES: dict[str, str] = {
    "p10_statistics": _STATS + "select doc_id, n_words, " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in ("mean_word_length", "symbol_share", "punctuated_line_share", "bullet_line_share", "ellipsis_line_share", "common_word_share", "alpha_word_share")) + " from s",
    "p10_reasons": _STATS + "select doc_id, array_to_string(list_filter([case when n_words < 50 then 'too_few_words' end, case when n_words > 100000 then 'too_many_words' end, case when mean_word_length < 3 or mean_word_length > 10 then 'mean_word_length' end, case when symbol_share > 0.1 then 'symbols' end, case when bullet_line_share > 0.9 then 'bullet_lines' end, case when ellipsis_line_share > 0.3 then 'ellipsis_lines' end, case when alpha_word_share < 0.8 then 'words_without_letters' end, case when n_common < 2 then 'few_common_words' end, case when punctuated_line_share < 0.1 then 'lines_without_punctuation' end], lambda x: x is not null), ',') as reasons from s",
    "p5_found": _GROUPS + "select author_id, group_id from g",
    "p5_group_sizes": _GROUPS + "select group_id, count(*) as n_authors from g group by group_id",
}
