"""Generated, minified, vendored and data files told from hand-written source.

Attribute files of a repository declare paths as generated or vendored, with the usual precedence: the file nearest to
the path first, in it the last matching line. They are parsed once, and meet the files of their repository by directory.
Patterns equivalent to such declarations are mined and applied to the repositories without any: globs that several
repositories declare, and directories, suffixes and names under which nearly every visible file shows by its text that
no member wrote it. A visible file under a mined pattern must show it too. Conventional globs, given below as an
attribute file, hold unless what is visible under them says otherwise. What no pattern covers is judged by its text
alone: a generator's remark, a foreign licence, packed lines, tables of data.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace

# The conventional patterns, in the syntax of attribute files.
CONVENTIONS = """
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/vendor/** linguist-vendored
**/vendors/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/3rdparty/** linguist-vendored
**/external/** linguist-vendored
**/externals/** linguist-vendored
**/deps/** linguist-vendored
**/Pods/** linguist-vendored
**/Carthage/** linguist-vendored
**/venv/** linguist-vendored
**/.venv/** linguist-vendored
**/site-packages/** linguist-vendored
**/Godeps/** linguist-vendored
**/jspm_packages/** linguist-vendored
**/.yarn/** linguist-vendored
**/dist/** linguist-generated
**/__generated__/** linguist-generated
**/generated/** linguist-generated
**/gen/** linguist-generated
**/*.pb.go linguist-generated
**/*.pb.cc linguist-generated
**/*.pb.h linguist-generated
**/*_pb2.py linguist-generated
**/*_pb2_grpc.py linguist-generated
**/*.designer.cs linguist-generated
**/*.designer.java linguist-generated
**/*.generated.ts linguist-generated
**/*.generated.js linguist-generated
**/*.g.js linguist-generated
**/*.g.dart linguist-generated
**/*.min.js linguist-generated
**/*.min.css linguist-generated
**/*.bundle.js linguist-generated
**/*.bundle.css linguist-generated
**/*.prod.js linguist-generated
**/*.prod.css linguist-generated
**/*.js.map linguist-generated
**/*.css.map linguist-generated
**/package-lock.json linguist-generated
**/npm-shrinkwrap.json linguist-generated
**/yarn.lock linguist-generated
**/pnpm-lock.yaml linguist-generated
**/poetry.lock linguist-generated
**/Pipfile.lock linguist-generated
**/Cargo.lock linguist-generated
**/composer.lock linguist-generated
**/Gemfile.lock linguist-generated
**/go.sum linguist-generated
"""
_DIRS = re.findall(r"^\*\*/([\w.-]+)/\*\* (\S+)$", CONVENTIONS, re.MULTILINE)
MARKER_DIRS = {d.lower(): a for d, a in _DIRS}
_NAMES = re.findall(r"^\*\*/(\*?[\w.-]+) (\S+)$", CONVENTIONS, re.MULTILINE)

#: A pattern is mined from at least so many different files, of which at least this share shows evidence,
MINED_FILES, MINED_SHARE = 8, 0.9
#: or from the declarations of at least so many repositories, of which at least the same share agrees.
MINED_REPOS = 2
#: A conventional directory is set aside where less than this share of its visible files shows evidence.
CONVENTION_SHARE = 0.2

_COMMENT = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+|--+|;+|<!--|\"\"\"|'''|%+|')\s?(.*)$")
_MADE = re.compile(
    r"(?i)^\W{0,6}(?:(?:this|the) (?:file|code|class|module)\s+(?:is|was|has been)\s+)?(?:@generated\b|<auto-?generated|auto-?\s?generated\b|code generated (?:by|from|with)\b|generated (?:automatically\s+)?(?:by|from|with|using)\b|machine[- ](?:made|generated)\b|automatically generated\b|built by \S+ (?:out of|from)\b|compiled (?:by|from)\b|produced by\b)"
    r"|(?i:\bautomatisch (?:erzeugt|generiert|erstellt)\b|\b(?:produit|généré|genere) (?:automatiquement )?par\b|\b(?:generado|producido) (?:automáticamente )?por\b|\bgenerado automáticamente\b|\bgeneriert (?:von|aus|mit)\b|\bgerado (?:automaticamente )?por\b|\bgenerato (?:automaticamente )?da\b)"
    r"|(?i:\bhand edits (?:are|will be) lost\b|\bchanges will be (?:lost|overwritten)\b|\bdo not (?:edit|modify)(?: (?:this|the) file)?\s*[.!]?\s*\*?/?\s*$|\bne pas modifier\b|\bnicht (?:bearbeiten|ändern)\b|\bno (?:editar|modificar)\b)"
)
_FOREIGN = re.compile(
    r"(?i)copyright\s+(?:\(c\)\s*|©\s*)?\d{4}(?:\s*[-–,]\s*\d{4})*,?\s+(?:by\s+)?(?:the\s+)?.{0,60}?\b(?:authors|developers|contributors|project|foundation|inc|ltd|llc|gmbh|team|maintainers)\b"
    r"|\(c\)\s*\d{4}.{0,60}\b(?:authors|developers|contributors|project|foundation)\b|released under the \S+ licen[sc]e|\blicensed under the\b|spdx-license-identifier:|\bupstream version:|\bv\d+\.\d+(?:\.\d+)?\s*\|.{0,80}\b(?:mit|bsd|apache|isc|l?gpl|mpl)\b|governed by (?:a )?[\w.-]*(?:mit|bsd|apache|isc|gpl|mpl)|@(?:license|preserve)\b"
)
_OWN = re.compile(r"(?i)\b(?:group\s+\S{0,6}\d+|this course|our team|the students)\b")
_CODE = set("py js jsx mjs cjs ts tsx java go c h cc cpp hpp cs rb php rs kt swift scala css scss less sql lua pl r m dart vue".split())
_SETTINGS = set("json yml yaml toml ini cfg conf env xml md rst txt properties lock csv html svg".split())
_HEAD_LINES = 12
_PACKED = 250


def normal_path(name: str) -> str:
    return re.sub(r"/+", "/", name.replace("\\", "/")).strip().lstrip("/")


def extension(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[-1].lower() if "." in base else ""


def evidence(path: str, diff: str) -> str | None:
    """What the text itself shows: generated, vendored, minified, data, or nothing."""
    ext = extension(path)
    lines = [x[1:].rstrip("\r") for x in diff.split("\n") if x[:1] in "+ -" and not x.startswith(("+++", "---"))] if "@@" in diff[:4] or diff[:1] in "+ -" else diff.split("\n")
    body = [x for x in lines if x.strip()]
    if not body:
        return None
    if ext not in ("md", "rst", "txt"):
        for n, line in enumerate(body):
            if n >= _HEAD_LINES and not _COMMENT.match(line):
                break  # the comment that opens the file is read to its end
            if len(line) < 4000 and (m := _COMMENT.match(line)):
                said = m.group(1)
                if _MADE.search(said):
                    return "generated"
                if _FOREIGN.search(said) and not _OWN.search(said):
                    return "vendored"
        if any(len(x) < 300 and "sourceMappingURL=" in x for x in (*body[-3:], body[0])):
            return "minified"
    if ext in _CODE or not ext:
        total = sum(map(len, body))
        packed = [x for x in body if len(x) >= _PACKED and sum(map(str.isspace, x)) < 0.09 * len(x)]
        if sum(map(len, packed)) > 0.6 * total:
            x = max(packed, key=len)
            return "minified" if sum(x.count(c) for c in "{};()") > 0.02 * len(x) else "data"
    if ext in _SETTINGS and ext != "svg":
        return None
    if len(body) >= 5:
        top = Counter(re.sub(r"\d+", "0", x.strip()) for x in body).most_common(1)[0]
        if top[1] >= 0.8 * len(body) and "0" in top[0] and len(top[0]) > 8:
            return "generated"
        inserts = sum(bool(re.match(r"\s*INSERT\s+INTO\b.*\bVALUES\b|\s*\(.*\),?$", x, re.IGNORECASE)) for x in body)
        if ext == "sql" and inserts >= 0.9 * len(body):
            return "data"
        if ext in _CODE and ext not in ("css", "scss", "less", "sql"):
            numbers = sum(bool(re.fullmatch(r"\s*[\[({]?\s*(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:e[-+]?\d+)?)[uUlLfF]?\s*,?\s*){4,}[\])}]*[;,]?\s*", x)) for x in body)
            if numbers >= 0.7 * len(body):
                return "data"
            shapes = Counter(re.sub(r"[-+]?\d+(?:\.\d+)?", "0", re.sub(r"\"[^\"]*\"|'[^']*'", "S", x.strip())) for x in body).most_common(1)[0]
            if shapes[1] >= 0.75 * len(body) and re.match(r"[{\[(]", shapes[0]) and ("0" in shapes[0] or "S" in shapes[0]) and len(body) >= 8:
                return "data"
    return None


def patterns_of(path: str) -> list[str]:
    """The patterns that a file stands under: its directories from the top, the name of each anywhere, suffix and name."""
    parts = path.split("/")
    dirs, base = parts[:-1], parts[-1]
    out = []
    for i in range(len(dirs)):
        out.append("/".join(dirs[: i + 1]) + "/**")
        out.append(f"**/{dirs[i]}/**")
    low = base.lower()
    if low.count(".") >= 2 and not low.startswith("."):
        out.append("*." + low.split(".", 1)[1])
    if (m := re.fullmatch(r".+?(_[a-z0-9]+)(\.\w+)", base)) and re.search(r"\d", m.group(1)):
        out.append(f"*{m.group(1)}{m.group(2)}")
    out.append("=" + base)
    return out


def pattern_of_rule(glob: str) -> str | None:
    """A declared glob as one of the patterns that ``patterns_of`` gives, wherever in a repository it may apply."""
    g = glob.strip().lstrip("/").removeprefix("**/")
    if (m := re.fullmatch(r"([\w.-]+)/(?:\*\*?(?:/\*)?)?", g)) is not None:
        return f"**/{m.group(1)}/**"
    if re.fullmatch(r"\*(?:\.[\w-]+){2,}", g):
        return g.lower()
    return "=" + g if re.fullmatch(r"[\w.-]+", g) else None


def conventional(path: str) -> tuple[str, str] | None:
    """(pattern, attribute) of the convention that the path meets; directories give the prefix up to their marker."""
    parts = path.split("/")
    for i, p in enumerate(parts[:-1]):
        if (a := MARKER_DIRS.get(p.lower())) is not None:
            return "/".join(parts[: i + 1]) + "/**", a
    base = parts[-1].lower()
    for glob, a in _NAMES:
        if base == glob.lower() or glob.startswith("*") and base.endswith(glob[1:].lower()) and len(base) >= len(glob):
            return "name:" + glob, a
    return None


# --- attribute files -------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=20_000)
def glob_regex(pattern: str) -> re.Pattern:
    """A pattern of an attribute file as a regular expression over paths relative to its directory."""
    anchored = "/" in pattern.rstrip("/")
    p = pattern.strip("/") + ("/**" if pattern.endswith("/") else "")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            inner = p[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out)


@functools.lru_cache(maxsize=5_000)
def parse_attributes(text: str) -> tuple[tuple[str, str, bool | None], ...]:
    """(pattern, attribute, set / unset / unspecified) for the attributes that mark files, in the order of the lines."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        pattern, *attrs = line.split()
        for a in attrs:
            name, _, value = a.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored"):
                out.append((pattern, name, None if a.startswith("!") else not (a.startswith("-") or value.lower() in ("false", "0", "no", "off"))))
    return tuple(out)


def last_words(rest: str, rules) -> dict[str, bool | None]:
    """What one attribute file says of a path relative to its directory: of the lines that match, the last per attribute."""
    return {name: value for pattern, name, value in rules if glob_regex(pattern).fullmatch(rest)}


def resolve(path: str, files: list[tuple[str, tuple]]) -> dict[str, bool]:
    """The declared attributes of a path; ``files`` holds (directory, rules) of the repository's attribute files.

    Rules of a deeper directory override those above it, later lines of a file the earlier ones.
    """
    out: dict[str, bool | None] = {}
    for where, rules in sorted(files, key=lambda f: f[0].count("/") + bool(f[0])):
        if not where or path.startswith(where + "/"):
            out |= last_words(path[len(where) + 1 :] if where else path, rules)
    return {k: v for k, v in out.items() if v is not None}


def _attribute_files(rows: DataFrame, repos: DataFrame, space: Workspace) -> DataFrame:
    """repo, at, rules: the latest text of each attribute file of a repository, by the order of the ids."""
    lines = rows.where("path rlike '(^|/)[.]gitattributes$' and diff is not null")
    body = F.array_join(F.transform(F.filter(F.split("diff", "\r?\n"), lambda x: x.rlike("^[+ ]")), lambda x: F.substr(x, F.lit(2))), "\n")
    lines = lines.select("link", F.regexp_replace("path", "/?[.]gitattributes$", "").alias("at"), body.alias("rules"), "id")
    return space.write(lines.join(repos, "link").groupBy("repo", "at").agg(F.max_by("rules", "id").alias("rules")), "attributes")


def _declared(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """id, declared for the files (id, path, repo) of which an attribute file above them says something.

    A file meets the attribute files of its own directories only, by equality on repository and directory.
    """
    dirs = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(dirs) - 1), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))
    met = files.select("id", "path", "repo", F.explode_outer(above).alias("at")).join(attributes, ["repo", "at"]).select("id", "path", "at", "rules")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, path, at, rules in zip(f["id"], f["path"], f["at"], f["rules"]):
                said = last_words(path[len(at) + 1 :] if at else path, parse_attributes(rules))
                out += [(i, k, at.count("/") + bool(at), {True: 1, False: 0, None: -1}[v]) for k, v in said.items()]
            yield pd.DataFrame(out, columns=["id", "attribute", "depth", "value"])

    kind = dict(files.dtypes)["id"]
    said = met.mapInPandas(run, f"id {kind}, attribute string, depth int, value int")
    nearest = said.groupBy("id", "attribute").agg(F.max(F.struct("depth", "value"))["value"].alias("value")).where("value >= 0")
    return nearest.groupBy("id").agg((F.max("value") == 1).alias("declared"))


def _declared_patterns(attributes: DataFrame) -> DataFrame:
    """pattern: globs that several repositories declare, nearly all of them in the same sense."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(repo, p, bool(v)) for repo, rules in zip(f["repo"], f["rules"]) for g, _, v in parse_attributes(rules) if v is not None and (p := pattern_of_rule(g))]
            yield pd.DataFrame(out, columns=["repo", "pattern", "set"])

    said = attributes.select("repo", "rules").mapInPandas(run, "repo string, pattern string, set boolean")
    votes = said.groupBy("repo", "pattern").agg(F.max("set").alias("set")).groupBy("pattern").agg(F.count("*").alias("n"), F.avg(F.col("set").cast("int")).alias("share"))
    return votes.where((F.col("n") >= MINED_REPOS) & (F.col("share") >= MINED_SHARE)).select("pattern")


# --- the operator ----------------------------------------------------------------------------------------------


def generated_files(df: DataFrame, key: str, name: str, diff: str, link: str | None = None, repos: DataFrame | None = None, mined_files: int = MINED_FILES) -> DataFrame:
    """key and reason for every file that was not written by hand; reasons: declared, mined, convention, generated, vendored, minified, data.

    ``repos`` (columns link, repo) gives the repository of a row by its column ``link``, for the rules of attribute
    files; rows without a repository are judged without them. Rows that repeat a key give one result. A row without a
    name is judged by its text, one without text by its name; one without both is no case. Binary files are judged by
    name and directory only. Whole texts are read, whatever their length. A declaration of the own repository, for or
    against, overrides everything else.
    """
    space = Workspace(df.sparkSession, "generated")
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{name}`").alias("path"), F.col(f"`{diff}`").alias("diff"), (F.col(f"`{link}`").cast("string") if link else F.lit(None).cast("string")).alias("link"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, diffs, links = (b.column(i) for i in range(4))
            shown, visible, pats, conv, paths = [], [], [], [], []
            for n, d in zip(names.to_pylist(), diffs.to_pylist()):
                path = normal_path(n or "")
                text = d or ""
                blank = not text.strip() or text.startswith("Binary files")
                shown.append(None if blank else evidence(path, text))
                visible.append(not blank)
                pats.append(patterns_of(path) if path else [])
                c = conventional(path) if path else None
                conv.append(c[0] if c else None)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([ids, pa.array(paths, pa.string()), pa.array(shown, pa.string()), pa.array(visible, pa.bool_()), pa.array(pats, pa.list_(pa.string())), pa.array(conv, pa.string()), links.cast(pa.string())], ["id", "path", "shown", "visible", "patterns", "convention", "link"])

    seen = rows.select("id", "path", "diff", "link").mapInArrow(look, f"id {kind}, path string, shown string, visible boolean, patterns array<string>, convention string, link string")
    seen = space.write(seen, "seen")
    # Mining counts different paths, so that one much-changed file doesn't decide.
    files = seen.where("visible and path <> ''").groupBy("path").agg(F.max(F.col("shown").isNotNull().cast("int")).alias("hit"), F.first("patterns").alias("patterns"), F.first("convention").alias("convention"))
    stats = files.select("hit", F.explode_outer(F.array_distinct(F.concat("patterns", F.when(F.col("convention").isNotNull(), F.array("convention")).otherwise(F.array().cast("array<string>"))))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    stats = space.write(stats.where(f"n >= {mined_files}").select("pattern", (F.col("hits") / F.col("n")).alias("share")), "patterns")
    mined = stats.where(f"share >= {MINED_SHARE}").select("pattern")
    declared = undeclared = None
    if repos is not None:
        normal = rows.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "^/+", ""))
        links = repos.select(F.col("link").cast("string").alias("link"), F.col("repo").cast("string").alias("repo")).distinct()
        attributes = _attribute_files(normal, links, space)
        if attributes.take(1):
            placed = seen.where("path <> ''").select("id", "path", "link").join(links, "link")
            declared = _declared(placed.select("id", "path", "repo"), attributes)
            mined = mined.unionByName(_declared_patterns(attributes)).distinct()
            # Patterns speak for the repositories that declare nothing themselves.
            undeclared = attributes.select("repo").distinct().join(links, "repo").select("link").distinct()
    binary = F.col("path").rlike("(?i)[.](png|jpe?g|gif|ico|bmp|webp|svg|woff2?|ttf|otf|eot|mp3|mp4|wav|pdf)$")
    asked = seen.where("path <> ''").where(F.col("shown").isNotNull() | (~F.col("visible") & F.col("convention").isNull() & ~binary))
    asked = asked.join(undeclared, "link", "left_anti") if undeclared is not None else asked
    by_pattern = asked.select("id", F.explode_outer("patterns").alias("pattern")).join(mined, "pattern").select("id", F.lit(1).alias("rank"), F.lit("mined").alias("reason"))
    # The convention holds unless enough visible files under it say otherwise.
    silent = seen.where("path <> '' and convention is not null")
    by_convention = silent.select("id", F.col("convention").alias("pattern"), "shown").join(stats, "pattern", "left").where(f"shown is not null or share is null or share >= {CONVENTION_SHARE}").select("id", F.lit(2).alias("rank"), F.lit("convention").alias("reason"))
    by_text = seen.where("shown is not null").select("id", F.lit(3).alias("rank"), F.col("shown").alias("reason"))
    found = by_pattern.unionByName(by_convention).unionByName(by_text).groupBy("id").agg(F.min(F.struct("rank", "reason"))["reason"].alias("reason"))
    if declared is not None:
        both = found.join(declared, "id", "full").select("id", F.when(F.col("declared"), "declared").when(~F.col("declared"), None).otherwise(F.col("reason")).alias("reason"))
        found = both.where("reason is not null")
    return found.withColumnRenamed("id", key)
