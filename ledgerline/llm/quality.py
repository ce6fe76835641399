"""Text statistics of documents and fixed-threshold rules over them, all as built-in expressions of the JVM.

The thresholds are those published for web-text filtering: 50 to 100,000 words, a mean word length of 3 to 10, at most
one symbol per ten words, at most 90 % bullet lines and 30 % lines ending in an ellipsis, 80 % of words with a letter,
and two stop words (Gopher); lines that end in punctuation (C4). They judge fitness for training. Whether a document
is mainly running prose is a question of its own, answered by ``prose`` with statistics and thresholds per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common function words of English, German, Spanish, French, Italian and Portuguese.
COMMON_WORDS = """
the of and to in a is that it for on was with as be by at this are from or an which not but have had were has after
before because so until while since although when if can there more what who they we i you he she his her their our
your its all most some nobody everybody does do did over into about than between during though whereas my me us no will
would could should also just only now then here how why where whom whose been being them these those such both each any
der die das und ist nicht ein eine einen einem einer es den dem des sich mit auf für von zu im am an als auch wurde war
hat haben wird dass weil wenn aber oder nach vor bei aus noch nur wie wir ich sie er ihr uns alle man kann mehr sehr
hier da dann doch über unter zwischen während bevor obwohl seit bis zum zur ohne um keine kein niemand
el la los las de que y en un una no se con por para su al del lo como más pero sus le ya este sí porque esta entre
cuando muy sin sobre también hasta hay donde quien desde todo nos durante ni contra ese eso antes después tras fue era
ha si aunque nadie está ser así les et est une dans pour pas qui ce sur il au avec plus ne je son sa ses mais ou nous
vous di che è per con del della non sono ma come più anche e o os da uma um não mas foi ao dos das
""".split()

_SYMBOL = r"[{}\[\]()=<>_/\\|@#$%^&*+~`\"]"
_BULLET = r"^\s*(?:[-*•+·‣▪◦–—]|\(?\d{1,3}[.)]|\[[ xX]\]|\(?[a-zA-Z][.)])\s+"


def _size(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\s", ""))


def text_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and, per document: n_words, mean_word_length, symbol_share (symbols per non-blank character), punctuated_line_share,
    bullet_line_share, ellipsis_line_share, common_word_share, alpha_word_share, n_common (distinct).

    Words are stretches without white space; lines are those that aren't blank. A null text counts as empty: all
    figures are 0. Repeated rows give repeated results.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias(key), F.regexp_replace(t, "\r", "").alias("_t"))
    rows = rows.select(key, "_t", F.filter(F.split("_t", r"[ \t\n\x0B\f ]+"), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("_l"))
    n, m, size = F.size("_w"), F.size("_l"), _size(F.col("_t"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    bare = F.transform("_w", lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\d]+|[^\p{L}\d]+$", "")))
    rows = rows.withColumn("_c", F.filter(bare, lambda w: w.isin(COMMON_WORDS)))
    return rows.select(
        key,
        n.alias("n_words"),
        share(F.aggregate("_w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)), n).alias("mean_word_length"),
        share(F.regexp_count("_t", F.lit(_SYMBOL)), size).alias("symbol_share"),
        share(F.size(F.filter("_l", lambda x: x.rlike(r"[.!?;:…][\"'’”»)]*\s*$"))), m).alias("punctuated_line_share"),
        share(F.size(F.filter("_l", lambda x: x.rlike(_BULLET))), m).alias("bullet_line_share"),
        share(F.size(F.filter("_l", lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))), m).alias("ellipsis_line_share"),
        share(F.size("_c"), n).alias("common_word_share"),
        share(F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))), n).alias("alpha_word_share"),
        F.size(F.array_distinct("_c")).alias("n_common"),
    )


def rule_failures(stats: DataFrame) -> Column:
    """The names of the published rules that a document fails, in a fixed order."""
    rules = [
        ("too_few_words", F.col("n_words") < 50),
        ("too_many_words", F.col("n_words") > 100_000),
        ("mean_word_length", ~F.col("mean_word_length").between(3, 10)),
        ("symbols", F.col("symbol_share") > 0.1),
        ("bullet_lines", F.col("bullet_line_share") > 0.9),
        ("ellipsis_lines", F.col("ellipsis_line_share") > 0.3),
        ("words_without_letters", F.col("alpha_word_share") < 0.8),
        ("few_common_words", F.col("n_common") < 2),
        ("lines_without_punctuation", F.col("punctuated_line_share") < 0.1),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))
