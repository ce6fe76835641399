"""Credentials in source code: found by an indexed set of detection patterns and blanked out in place.

Every pattern implies a boolean query over trigrams. A chunk is one line, read together with the line below where a name
ends it without its value; the postings of a batch of texts are intersected, and the patterns run only on the lines that
remain. A private key is found at its BEGIN marker, if key material follows it or the text ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .credential_rules import NEXT_QUOTED, NEXT_VALUE, OPEN_COMPILED, OPEN_NAME, RULES, Rule, judge, spans_of
from .trigrams import TrigramIndex, blocks, text_bytes, trigram_query

BLOCK_BYTES = 4_000_000
MASK = "***REDACTED***"
_OPEN, _JOIN = len(RULES), len(RULES) + 1
_INDEX: list[TrigramIndex] = []


def _index() -> TrigramIndex:
    if not _INDEX:
        joins = ("or", *(("gram", g) for g in ('" +', "' +", '"+"', "'+'", '"."', "'.'", '" .', "' .", '"..', "'..")))
        _INDEX.append(TrigramIndex([*(trigram_query(r.pattern) for r in RULES), trigram_query(OPEN_NAME.pattern), joins]))
    return _INDEX[0]


# --- private keys ----------------------------------------------------------------------------------------------

_END = re.compile(r"-----END (?:[A-Z0-9]{2,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----", re.IGNORECASE)
_KEY_HEADER = re.compile(r"^[\s+\-#/*>|\"'`]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Key-Type)\s*:", re.IGNORECASE)
_KEY_LINE = re.compile(r"^(?P<head>(?:[\s+\-#*>|\"'`]|//(?=[\s+\"'`]))*)(?P<body>[A-Za-z0-9+/=]+)(?P<tail>(?:\\[rn])*[\"'`,;+\\.\s]*)$")


def key_body(line: str, last: bool) -> re.Match | None:
    """The key material that fills a line but for the marks of a diff, a remark or a literal; ``last``: the END marker follows."""
    m = _KEY_LINE.match(line)
    if m is None or MASK in line:
        return None
    body = m.group("body")
    mixed = re.search(r"\d", body) and re.search(r"[A-Za-z]", body)
    return m if last or len(body) >= 40 or len(body) >= 16 and mixed else None


def key_rest(rest: str) -> tuple[int, int] | None:
    """Where key material stands behind a BEGIN marker on its own line, up to the END marker or the end of the literal."""
    end = _END.search(rest)
    within = rest[: end.start()] if end else rest
    m = re.match(r"^((?:\\[rn]|\s|[\"'`+])*)(.*?)((?:\\[rn]|[\s\"'`,;+)\\])*)$", within, re.DOTALL)
    body = m.group(2)
    bare = re.sub(r"\\[rn]|[\s\"'`+]", "", body)
    if MASK in body or len(bare) < 16 or len(re.findall(r"[A-Za-z0-9+/=]", bare)) < 0.97 * len(bare) or " " in body.strip() and not end:
        return None
    return m.span(2)


def _is_live_key(line: str, at: int, below: list[str]) -> bool:
    """Whether a BEGIN marker that ends at ``at`` opens a key: material follows, or the text breaks off there."""
    rest = line[at:]
    if MASK in rest or _END.search(rest):
        return key_rest(rest) is not None
    if key_rest(rest):
        return True
    if not below or below[0].startswith("@@"):
        return True
    for n, x in enumerate(below):
        if _KEY_HEADER.match(x) or not x.strip(" +-\r\t#*/|\"'"):
            continue
        return key_body(x, n + 1 < len(below) and bool(_END.search(below[n + 1]))) is not None
    return False


# --- search ----------------------------------------------------------------------------------------------------


def _hits(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
    """(row, line number from 1, spans of (start, end, rule) on the line) where a credential stands."""
    data_all, offsets_all = text_bytes(texts)
    for lo, hi in blocks(len(texts), offsets_all, BLOCK_BYTES):
        data = data_all[offsets_all[lo] : offsets_all[hi]]
        if len(data) < 3:
            continue
        starts = offsets_all[lo : hi + 1] - offsets_all[lo]
        breaks = np.flatnonzero(data == 10) + 1
        lines = np.unique(np.concatenate([starts[:-1], breaks]))
        lines = lines[lines < len(data)]
        wanted: dict[int, list[int]] = {}
        for k, found in enumerate(_index().candidates(data, lines)):
            for n in found.tolist():
                wanted.setdefault(n, []).append(k)
        raw = data.tobytes()

        def line_at(n: int) -> str:
            s, e = int(lines[n]), int(lines[n + 1]) if n + 1 < len(lines) else len(raw)
            return raw[s:e].rstrip(b"\n").decode("utf-8", "replace")

        found_at: dict[int, list] = {}
        for n, rules in wanted.items():
            line = line_at(n)
            row_end = int(starts[np.searchsorted(starts, lines[n], "right")]) if rules[0] == 0 or _OPEN in rules else 0
            spans = spans_of(line, [k for k in rules if k < _OPEN], _JOIN in rules)
            if rules[0] == 0:  # only the rule of private keys needs the lines below
                below = [line_at(j) for j in range(n + 1, min(n + 6, len(lines))) if lines[j] < row_end]
                spans = [x for x in spans if x[2] != "private_key" or _is_live_key(line, x[1], below)]
            if spans:
                found_at.setdefault(n, []).extend(spans)
            if _OPEN in rules and n + 1 < len(lines) and lines[n + 1] < row_end and (m := OPEN_COMPILED.search(line.rstrip("\r"))) is not None:
                below = line_at(n + 1)
                if (v := NEXT_VALUE.match(below.rstrip("\r"))) is not None:
                    opened = re.search(r"[=:(|]\s*\\?$", line.rstrip("\r")) or NEXT_QUOTED.match(below)
                    rule = OPEN_NAME if v.group(1) is None else Rule("named_bare", "", "bare")
                    value = v.group(v.lastindex)
                    if opened and judge(Rule(rule.name, "", "either" if v.group(1) is not None else "bare"), value, m.group()):
                        found_at.setdefault(n + 1, []).append((*v.span(v.lastindex), "open_name"))
        for n in sorted(found_at):
            s = int(lines[n])
            row = int(np.searchsorted(starts, s, "right")) - 1
            number = n - int(np.searchsorted(lines, starts[row], "left")) + 1
            yield lo + row, number, _disjoint(found_at[n])


def _disjoint(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for s, e, r in sorted(set(spans)):
        if out and s < out[-1][1] and "private_key" not in (r, out[-1][2]):
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2])
        else:
            out.append((s, e, r))
    return out


def find_secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per credential: key, line_no (from 1, lines end at LF), first and last character on the line, rule.

    Null and empty texts have none; repeated rows are searched once per row; the text is searched whole whatever its
    length. A BEGIN marker that no key material follows is no credential. Further columns are ignored.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r, n, s, e, rule) for r, n, spans in _hits(batch.column(1)) for s, e, rule in spans]
            if out:
                rows, no, s, e, rule = zip(*out)
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(rule, pa.string())], ["k", "line_no", "start", "end", "rule"])

    out = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").mapInArrow(run, f"k {kind}, line_no int, start int, end int, rule string")
    return out.withColumnRenamed("k", key)


# --- redaction -------------------------------------------------------------------------------------------------


def blank_out(text: str, hits: list[tuple[int, list]]) -> tuple[str, int]:
    """The text with the values at ``hits`` (line number, spans) masked, and how many were.

    The lines are read once from top to bottom. A BEGIN marker opens a key: what follows on its line is masked, then the
    lines below, up to the END marker or the first line that isn't key material. The markers themselves stay.
    """
    by_line = dict(hits)
    lines = text.split("\n")
    count, in_key, opened = 0, False, False  # opened: a key of which nothing was masked yet
    for at, line in enumerate(lines):
        if in_key:
            last = at + 1 < len(lines) and bool(_END.search(lines[at + 1]))
            if (m := key_body(line, last)) is not None:
                lines[at] = line[: m.start("body")] + MASK + line[m.end("body") :]
                count, opened = count + opened, False
                continue
            if (h := _KEY_HEADER.match(line)) is not None:
                if "dek-info" in h.group().lower():
                    lines[at] = line[: h.end()] + " " + MASK + ("\r" if line.endswith("\r") else "")
                continue
            if not line.strip(" +-\r\t#*/|\"'"):
                continue
            if (end := _END.search(line)) is not None and re.fullmatch(r"[\s+\-#/*>|\"'`]*[A-Za-z0-9+/=]{4,}(?:\\[rn])*", line[: end.start()]):
                m = re.search(r"[A-Za-z0-9+/=]{4,}", line)
                line = lines[at] = line[: m.start()] + MASK + line[m.end() :]
                count, opened = count + opened, False
            in_key = False
        cuts: list[tuple[int, int]] = []
        for s, e, rule in by_line.get(at + 1, ()):
            if rule == "private_key":
                body = key_rest(line[e:])
                if body:
                    cuts.append((e + body[0], e + body[1]))
                in_key, opened = _END.search(line[e:]) is None, body is None
            else:
                cuts.append((s, e))
        taken: list[tuple[int, int]] = []
        for s, e in sorted(cuts):
            if taken and s < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        count += len(taken)
        for s, e in reversed(taken):
            lines[at] = lines[at][:s] + MASK + lines[at][e:]
    return "\n".join(lines), count


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, the text with every credential's value replaced by a mask, and the number of values replaced.

    All other characters stay as they are. Of a private key its material is blanked, on the line of the BEGIN marker and
    below, up to the END marker or the first line that is none; the markers stay. Null texts stay null.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [0] * len(texts)
            by_row: dict[int, list] = {}
            for row, n, spans in _hits(batch.column(1)):
                by_row.setdefault(row, []).append((n, spans))
            for row, hits in by_row.items():
                texts[row], counts[row] = blank_out(texts[row], hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["k", "t", "n"])

    out = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, f"k {kind}, t string, n int")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), F.col("n").alias("n_redacted"))
