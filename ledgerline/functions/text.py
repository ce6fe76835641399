"""Scalar expressions over paths, messages, names and times; all run inside the JVM."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def path(c: Column) -> Column:
    """Forward slashes, nothing in front."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^/+", "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(path(c), r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    """Lower-case extension with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(c), r"^.+(\.[^.]*)$", 1))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null if absent."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def language(c: Column) -> Column:
    return lookup(extension(c), rules.LANGUAGES)


def ingest_ignored(c: Column) -> Column:
    return F.coalesce(c.rlike(rules.INGEST_IGNORED), F.lit(False))


def compared(c: Column) -> Column:
    """Whether a source file takes part in comparisons."""
    p, base = path(c), F.lower(base_name(c))
    dirs = F.split(F.lower(F.regexp_extract(p, r"^(.*)/[^/]*$", 1)), "/")
    globs = "|".join(translate(g).replace(r"\z", r"\Z") for g in rules.EXCLUDED_GLOBS)
    return ~F.arrays_overlap(dirs, F.array(*map(F.lit, rules.EXCLUDED_DIRS))) & ~base.isin(rules.EXCLUDED_FILES) & ~base.rlike(globs) & extension(c).isin(rules.COMPARED_EXTENSIONS)


def top_folder(c: Column) -> Column:
    return F.when(path(c).contains("/"), F.split(path(c), "/")[0]).otherwise("(root)")


def git_url(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", ""), r"\.git$", ""))


def https_url(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"(?i)^https://[^\s-][^\s]*$"), F.lit(False))


def short_branch(c: Column) -> Column:
    """Last two non-empty parts of a branch name."""
    return F.array_join(F.reverse(F.slice(F.reverse(F.filter(F.split(c, "/"), lambda x: F.trim(x) != "")), 1, 2)), "/")


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def vague(message: Column) -> Column:
    return F.length(stripped(message)) < 15


def squashed(insertions: Column, message: Column) -> Column:
    first = F.split(F.coalesce(message, F.lit("")), "\n")[0]
    return (F.coalesce(insertions, F.lit(0)) > 1000) | F.coalesce(message, F.lit("")).contains("Co-authored-by:") | F.trim(first).rlike(r"\(#\d+\)$")


def hours_before(ts: Column, deadline: Column) -> Column:
    return (F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(3.6e9)


def timing(ts: Column, deadline: Column) -> Column:
    h = hours_before(ts, deadline)
    return F.when(h < 0, "after_deadline").when(h <= 48, "before_deadline_close").otherwise("normal")


def is_bot(name: Column, email: Column) -> Column:
    n, e = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(email, F.lit("")))
    return n.contains("[bot]") | e.contains("[bot]")


def is_bot_extended(name: Column, email: Column) -> Column:
    n, e = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(email, F.lit("")))
    return (
        F.when(is_bot(name, email), True)
        .when(n.rlike(rules.KNOWN_BOTS) | e.rlike(rules.KNOWN_BOTS), True)
        .when(e.rlike(rules.PERSONAL_MAIL), False)
        .otherwise(n.rlike(rules.BOT_WORD) | e.rlike(rules.BOT_WORD))
    )


# Letters with marks and what they are without, one to one.
MARKED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįłñńňòóôõöøōőŕřśşšťùúûüūůűųýÿźżž"
PLAIN_ = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz"


def plain_name(c: Column) -> Column:
    """Lower-case letters only, words parted by one blank; Latin letters lose their marks."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(bare, MARKED, PLAIN_), "[^a-z]+", " "), " +", " "))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain_name(c), " "), lambda x: F.length(x) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def mail_local(c: Column) -> Column:
    """Letters and digits of the local part; of a no-reply address the login, without a plus tag otherwise."""
    e = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    local = F.regexp_extract(e, r"^([^@]*)", 1)
    login = F.regexp_replace(local, r"^\d+\+", "")
    return F.regexp_replace(F.when(e.contains("noreply"), login).otherwise(F.regexp_extract(local, r"^([^+]*)", 1)), "[^a-z0-9]", "")


def trailers(message: Column) -> Column:
    """array of (name, email) of the co-author trailers of a message."""
    p = F.lit(r"(?i)co-authored-by:[ \t]*([^<\n]*?)[ \t]*<([^>\n]*)>")
    names, mails = F.regexp_extract_all(message, p, F.lit(1)), F.regexp_extract_all(message, p, F.lit(2))
    return F.zip_with(names, mails, lambda n, m: F.struct(n.alias("name"), F.lower(F.trim(m)).alias("email")))


def diff_lines(diff: Column, sign: str) -> Column:
    """Added or removed lines of a diff, without the sign, of at least five characters."""
    mark = sign * 3
    return F.filter(F.transform(F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith(sign) & ~x.startswith(mark)), lambda x: F.trim(F.substr(x, F.lit(2)))), lambda x: F.length(x) >= 5)


def gini_status(g: Column) -> Column:
    return F.when(g < 0.3, "Low").when(g < 0.5, "Medium").otherwise("High")


def complexity_band(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 10, "moderate").when(c <= 20, "high").otherwise("very high")


def share_band(pct: Column, n: Column) -> Column:
    """How far a share lies from 100 / n, as a part of that."""
    off = F.abs(pct - 100 / n) / (100 / n)
    return F.when(off < 0.35, "good").when(off < 0.65, "warning").otherwise("danger")
