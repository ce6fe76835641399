"""Records that name the same person or organisation in different spellings.

Every record is read into a profile: given name, family name, initial, the number in its mail address. Profiles that
agree in full meet at a common key, so that copies cost nothing. Distinct keys that are spelled differently are found
by a set-similarity join on the q-grams of their tokens with prefix filtering, and verified by a soft token similarity
in which rare tokens count more: a shared family name says much, a shared given name little. Profiles without a full
given name are joined to a key only if it is the one that fits. All links run through keys, and their connected
components are the entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace
from .components import components

# Short forms of common English, German and Spanish given names that stand for one name only. All other
# given names and short forms are learnt from the records.
SHORT_FORMS = """
abigail: abby; alexander: alex sasha; andrew: andy drew; anthony: tony; barbara: barb babs; beatrice: bea trixie; benjamin: ben benji benny
bernard: bernie; boris: borya; caroline: carrie; carolina: caro; catherine: cathy
charles: charlie chuck; charlotte: lottie; christopher: chris kit; daniel: dan danny; david: dave; deborah: deb debbie; dimitri: dima
dominic: dom; edward: ed eddie ted ned; eleanor: nell; elizabeth: liz beth betty; ernesto: neto; eugene: gene
florian: flo; francisco: paco pancho; frank: frankie; frederick: fred freddie; friedrich: fritz
gabriel: gabe; george: georgie; gerald: gerry; giovanni: gianni; giuseppe: beppe; gregory: greg; gustav: gus; gwendolyn: gwen
harold: hal; heinrich: heinz; helena: lena; henry: hank; ignacio: nacho; isabel: isa; jacob: jake; jacqueline: jackie
james: jim jimmy; jeffrey: jeff; jennifer: jen jenny; jessica: jess; johannes: hannes; john: jack johnny; jonathan: jon
joseph: joe; joshua: josh; josephine: josie; judith: judy; katharina: kathi; katherine: kate kathy katie kitty
kenneth: ken; kimberly: kim; konstantin: kostya; lawrence: larry; leonard: len lenny; manuel: manolo; margaret: maggie meg peggy
matthew: matt; maximilian: max; michael: mike mick; nathaniel: nate; nicholas: nick nicky; pamela: pam; patricia: patty trish
peter: pete; philip: phil; raymond: ray; rebecca: becky; richard: rick rich; robert: bob rob bobby; ronald: ron; samuel: sam sammy
sebastian: basti; stephanie: steph steffi; stephen: steve; susan: sue susie; theodore: theo; theresa: tess; thomas: tom tommy
timothy: tim; ulrich: uli; victoria: vicky; vincent: vince; vladimir: vlad; walter: walt; wilhelm: willi; william: will bill billy
zachary: zach
"""
# Titles, particles, words of organisations and names that stand for nobody.
TITLES = set("dr prof professor msc bsc phd mag ing eng dipl mr mrs ms miss herr frau sr sra srta sir".split())
PARTICLES = set("von van ter de la el da der den di del du le al dos das zu zum zur bin ben_ af av".split())
ORG_KINDS = {"lab": "labs", "labs": "labs", "laboratory": "labs", "laboratories": "labs", "institute": "institute", "institut": "institute", "inst": "institute", "instituto": "institute", "study": "group", "group": "group", "studygroup": "group", "sg": "group", "software": "software", "sw": "software", "softwares": "software", "ltd": "legal", "limited": "legal", "gmbh": "legal", "inc": "legal", "llc": "legal", "corp": "legal", "company": "legal", "university": "university", "universität": "university", "college": "university", "foundation": "foundation", "association": "association", "systems": "systems", "solutions": "solutions", "studio": "studio", "studios": "studio", "consulting": "consulting"}
NOBODY = set("unknown user student students root admin administrator your name you test tester guest anonymous nobody none null undefined default git github gitlab localhost dev developer developers owner me someone somebody team default noname na ubuntu vagrant jenkins system service ci build runner actions dependabot renovate".split())
BOT = re.compile(r"(?i)\[bot\]|(?:^|[\W_])bots?(?:$|[\W_])|noreply@|automation|autobot|dependabot|renovate|github-actions|deploy(?:er)?[-_ ]?key")

SHORT = {s: full.strip() for full, _, shorts in (x.partition(":") for x in re.split(r"[;\n]", SHORT_FORMS) if x.strip()) for s in shorts.split()}
FULL = set(SHORT.values())
#: A token with at least so many different companions in names counts as a given name if more than this share of what
#: is known of its place in them says so.
GIVEN_COMPANIONS, GIVEN_SHARE = 8, 0.5
#: A nickname is learnt from at least so many records that agree to this share.
NICK_RECORDS, NICK_SHARE = 4, 0.8
_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "Ae", "œ": "oe", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i"})


_MISREAD = re.compile("[\u00c2-\u00c5][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]")


def _mend(m: re.Match) -> str:
    for code in ("latin-1", "cp1252"):
        try:
            return m.group().encode(code).decode("utf-8")
        except ValueError:
            continue
    return m.group()


def fold(s: str) -> str:
    """Letters without marks; two-byte letters that were decoded one byte at a time are mended first."""
    s = _MISREAD.sub(_mend, s).translate(_LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two strings; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            now.append(v)
        if min(now) > most and i > 1 and min(one) > most:
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


_NEVER_GIVEN = TITLES | PARTICLES | set(ORG_KINDS) | NOBODY


class Lexicon:
    """The given names and short forms that may occur in one record."""

    def __init__(self, given: set[str], nick: dict[str, str]):
        self.nick = {**SHORT, **nick}
        self.given = (set(given) | FULL | set(self.nick)) - _NEVER_GIVEN
        self.full = sorted((g for g in self.given if len(g) >= 4 and g not in self.nick), key=len, reverse=True)
        self.long = [g for g in self.given if len(g) >= 5 and g not in self.nick]

    def canonical(self, t: str) -> str:
        return self.nick.get(t, t)

    def near(self, t: str) -> str | None:
        """The given name that a token is, perhaps with one slip."""
        if t in self.given:
            return self.canonical(t)
        near = [g for g in self.long if abs(len(g) - len(t)) <= 1 and edits(t, g, 1) <= 1] if len(t) >= 4 else []
        return self.canonical(near[0]) if len(near) == 1 else None


def split_name(name: str) -> tuple[list[str], set[str], bool]:
    """(tokens, those written as abbreviations, whether the family name stands first for certain)."""
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", " ", name)
    s = fold(s).replace(" ", " ")
    turned = False
    if (m := re.match(r"^\s*([^,]+),\s*([^,]+)$", s)) and m.group(2).strip().lower().rstrip(".") not in TITLES:
        s, turned = f"{m.group(2)} {m.group(1)}", True
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    raw = re.findall(r"[A-Za-z]+\.?", s)
    caps = [t for t in raw if t.rstrip(".").lower() not in TITLES | PARTICLES]
    if not turned and len(caps) >= 2 and len(caps[0]) > 2 and caps[0].isupper() and not caps[-1].rstrip(".").isupper():
        turned = True
        raw = raw[1:] + raw[:1] if raw[0] == caps[0] else raw
    tokens, short = [], set()
    for t in raw:
        low = t.rstrip(".").lower()
        if low in TITLES:
            continue
        if t.endswith(".") and len(low) <= 4:
            short.add(low)
        tokens.append(low)
    bare = [t for t in tokens if t not in PARTICLES]
    return bare or tokens, short, turned


def read_handle(local: str, noreply: bool, hints: list[str], lex: Lexicon) -> dict:
    """What a mail address or login says: given, initial, family name (sure if it agrees with a hint), number, guesses."""
    local = fold(local).lower().strip()
    if noreply and (m := re.match(r"^\d+\+(.*)$", local)):
        local = m.group(1)
    local = local.split("+")[0]
    m = re.match(r"^(.*?)(\d*)$", local)
    base, num = m.group(1), m.group(2)
    out = {"given": None, "initial": None, "family": None, "sure": False, "num": num or None, "guesses": []}
    segs = [x for x in re.split(r"[._\-\s]+", base) if x]
    if not segs or any(not x.isalpha() for x in segs):
        return out

    def fits(x: str) -> str | None:
        """The hint that a piece spells."""
        return next((h for h in hints if h == x), None) or next((h for h in hints if len(x) >= 4 and edits(x, h, 2) <= (2 if len(h) >= 8 else 1)), None)

    if len(segs) >= 2:
        rest = []
        for x in segs:
            if len(x) == 1:
                out["initial"] = out["initial"] or x
            elif out["given"] is None and x in lex.given and not any(h == x for h in hints):
                out["given"] = lex.canonical(x)
            elif x not in PARTICLES:
                rest.append(x)
        if rest:
            known = [x for x in rest if fits(x)]
            pick = known[0] if known else rest[-1] if len(rest) == 1 or out["given"] or out["initial"] else None
            if pick is None:
                out["guesses"] = rest
            else:
                out["family"], out["sure"] = pick, bool(known)
                others = [x for x in rest if x != pick]
                if out["given"] is None and others and (known or len(others) == 1):
                    out["given"] = lex.near(others[0]) or others[0]
        return out
    x = segs[0]
    if len(x) < 3:
        return out
    # One piece: family name alone, or with an initial or a given name at either end.
    cuts = [(x, None, None)]
    for g in lex.full:
        if len(x) - len(g) >= 4:
            if x.startswith(g):
                cuts.append((x[len(g) :], lex.canonical(g), None))
            elif x.endswith(g):
                cuts.append((x[: -len(g)], lex.canonical(g), None))
    with_given = cuts[1:]
    cuts += [(x[1:], None, x[0]), (x[:-1], None, x[-1])]
    best = None
    for at, (piece, g, i) in enumerate((*with_given, *cuts[:1], *cuts[-2:])):
        for h in hints if len(piece) >= 4 else ():
            d = edits(piece, h, 2)
            if d <= (2 if len(h) >= 8 else 1) and (best is None or (d, at) < best[0]):
                best = ((d, at), piece, g, i)
    if best is not None:
        out.update(family=best[1], given=best[2], initial=best[3] or (best[2][0] if best[2] else None), sure=True)
        return out
    if x in lex.given:
        out["given"] = lex.canonical(x)
    elif with_given:
        out.update(family=with_given[0][0], given=with_given[0][1])
    else:
        out["guesses"] = [c for c, _, _ in cuts if len(c) >= 4]
    return out


EMPTY = {"kind": None, "given": None, "initial": None, "prefix": None, "family": None, "sure": False, "num": None, "guesses": []}


def read_record(name: str | None, email: str | None, variants: list[str] | None, lex: Lexicon) -> dict:
    """The profile of a record. kind is None where it names nobody: automation, placeholders, nothing at all."""
    name, email = (name or "").strip(), (email or "").strip()
    out = dict(EMPTY, guesses=[])
    if BOT.search(name) or "[bot]" in email.lower():
        return out
    tokens, _, _ = split_name(name)
    if all(t in NOBODY or not t for t in tokens) and not re.search(r"[a-z]{3}", "".join(t for t in tokens if t not in NOBODY)):
        return out
    local, _, domain = email.partition("@")
    noreply = "noreply" in domain.lower()
    kinds = {ORG_KINDS[t] for t in tokens if t in ORG_KINDS}
    core = "".join(t for t in tokens if t not in ORG_KINDS)
    if kinds and core:
        kind = next(iter(sorted(kinds - {"legal"}) or ["legal"]))
        base = re.sub(r"\d+$", "", fold(local.split("+")[-1 if noreply else 0]).lower())
        base = re.sub(r"[^a-z]", "", base)
        sure = len(base) >= 4 and edits(base, core, 2) <= 2
        return out | {"kind": "org:" + kind, "given": kind, "family": base if sure else core, "sure": sure}
    out["kind"] = "person"
    givens, families, initials, prefixes, handles = [], [], [], [], []
    for form in dict.fromkeys([name, *(v for v in variants or [] if v)]):
        tokens, short, turned = split_name(form)
        tokens = [t for t in tokens if t not in NOBODY]
        longs = [t for t in tokens if len(t) > 1 and t not in short]
        for t in tokens:
            if len(t) == 1:
                initials.append(t)
            elif t in short:
                prefixes.append(t)
        if len(longs) == 1 and len(tokens) == 1:
            if longs[0] in lex.given or lex.near(longs[0]):
                givens.append(lex.near(longs[0]))
            else:
                handles.append(form)
        elif len(longs) == 1:
            (givens if longs[0] in lex.given else families).append(lex.canonical(longs[0]) if longs[0] in lex.given else longs[0])
        elif len(longs) >= 2:
            known = [t for t in longs if t in lex.given] or [t for t in longs if lex.near(t)]
            first, last = longs[0], longs[-1]
            if known and not (len(known) == len(longs)):
                rest = [t for t in longs if t not in known]
                # The family name stands at one end; names between are middle names.
                family = last if last in rest else first if first in rest else rest[-1]
                mine = [t for t in known if t != family]
                g = mine[0] if family == last or len(mine) == 1 or turned else mine[0]
                givens.append(lex.near(g) or g)
                families.append(family)
            else:
                givens.append(lex.canonical(first))
                families.append(last)
    hints = list(dict.fromkeys(families))
    mail = read_handle(local, noreply, hints, lex) if local and domain and domain.lower() not in ("none", "unknown", "localhost") else dict(EMPTY, guesses=[])
    for h in handles:
        base = re.sub(r"\s+", "", h)
        got = read_handle(base, False, [*hints, *([mail["family"]] if mail["family"] else [])], lex)
        if got["given"]:
            givens.append(got["given"])
        if got["initial"]:
            initials.append(got["initial"])
        if got["family"]:
            families.append(got["family"])
        elif not hints:
            out["guesses"] += got["guesses"]
        if got["num"]:
            out["num"] = got["num"]
    if not mail["sure"] and mail["family"] and mail["family"] in (*families, *out["guesses"]):
        mail["sure"] = True
    # Does the address belong to this person at all? It must spell the family name, or the given name or its initial.
    named = [g for g in dict.fromkeys(givens) if g]
    agrees = mail["sure"] or (not families and (mail["family"] or mail["guesses"]) and (mail["given"] in named if mail["given"] else True))
    if not families and not mail["sure"] and mail["family"] and mail["initial"] and named and not any(g[0] == mail["initial"] for g in named) and mail["given"] is None:
        agrees = False
    if agrees:
        out["family"], out["sure"] = mail["family"], bool(mail["sure"] or mail["family"])
        out["num"] = mail["num"] or out["num"]
        if mail["given"]:
            named = [mail["given"]]
        elif mail["initial"]:
            initials.insert(0, mail["initial"])
        if not mail["family"] and not families and mail["guesses"]:
            # Family name with a number, or with the initial of the given name at one end.
            base, first = max(mail["guesses"], key=len), {g[0] for g in named} | set(initials)
            ends = [base[1:]] * (base[:1] in first) + [base[:-1]] * (base[-1:] in first and not mail["num"])
            if mail["num"] and len(mail["num"]) <= 2 and named:
                out["family"], out["sure"] = base, True
            elif len(ends) == 1 and named:
                out["family"], out["sure"] = ends[0], True
            else:
                out["guesses"] += ends + mail["guesses"]
    if out["family"] is None and families:
        out["family"] = max(dict.fromkeys(families), key=lambda f: (families.count(f), -families.index(f)))
    counted = {g: givens.count(g) + 5 * (g in FULL or g in lex.given) for g in named}
    if mail["given"] and agrees:
        out["given"] = mail["given"]
    elif named:
        out["given"] = max(named, key=lambda g: (counted[g], -named.index(g)))
    if out["given"] and initials and agrees and mail["initial"] and not mail["given"] and out["given"] not in FULL and out["given"][0] != mail["initial"] and not out["given"].startswith(mail["initial"]):
        out["given"] = None  # a short form that isn't known: the address gives the initial of the full name
    out["initial"] = out["given"][0] if out["given"] else (initials or [p[0] for p in prefixes] or [None])[0]
    out["prefix"] = None if out["given"] else next((p for p in prefixes if p[0] == out["initial"]), None)
    if out["family"]:
        out["guesses"] = []
    return out


def _cuts(t: str) -> set[str]:
    """A word and what is left of it without one letter: two words one slip apart have one of these in common."""
    return {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}


def lookup_keys(name: str | None, email: str | None, variants: list[str] | None, slips: bool = True) -> set[str]:
    """The keys under which a given name that may occur in a record is found: "=" whole and, with ``slips``, "~" with one."""
    out: set[str] = set()
    words: set[str] = set()
    for form in [name, *(variants or [])]:
        tokens = split_name(form or "")[0]
        words |= set(tokens)
        if len(tokens) == 1:
            words.add(re.sub(r"\d+$", "", re.sub(r"[^a-z0-9]", "", fold(form or "").lower())))
    local = re.sub(r"^\d+\+", "", fold((email or "").split("@")[0]).lower()).split("+")[0]
    pieces = {x for x in re.split(r"[._\-\s]+", re.sub(r"\d*$", "", local)) if x.isalpha()} | {re.sub(r"[^a-z]", "", local)}
    for w in words | pieces:
        out.add("=" + w)
        if slips and 4 <= len(w) <= 40:
            out |= {"~" + c for c in _cuts(w)}
        # A given name may be run together with the rest of a login.
        out |= {"=" + w[:i] for i in range(4, min(len(w), 20))} | {"=" + w[i:] for i in range(max(1, len(w) - 20), len(w) - 3)}
    return out - {"=", "~"}


def _with_lexicon(rows: DataFrame, given: DataFrame, nick: DataFrame, space: Workspace, name: str, slips: bool = True) -> DataFrame:
    """rows with the entries (t, canon) of given(t) and nick(t, canon) that may occur in them, found by equality of keys."""

    def record_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(i, k) for i, n, e, v in zip(f["id"], f["name"], f["email"], f["variants"]) for k in lookup_keys(n, e, list(v) if v is not None else None, slips)]
            yield pd.DataFrame(got, columns=["id", "key"])

    def entry_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(t, c, k) for t, c in zip(f["t"], f["canon"]) for k in ["=" + t, *(["~" + x for x in _cuts(t)] if slips and len(t) >= 5 and not c else [])]]
            yield pd.DataFrame(got, columns=["t", "canon", "key"])

    kind = dict(rows.dtypes)["id"]
    entries = given.select("t", F.lit("").alias("canon")).unionByName(nick.select("t", "canon")).mapInPandas(entry_keys, "t string, canon string, key string")
    keys = rows.select("id", "name", "email", "variants").mapInPandas(record_keys, f"id {kind}, key string")
    met = keys.join(entries, "key").select("id", "t", "canon").distinct().groupBy("id").agg(F.collect_list(F.struct("t", "canon")).alias("lexicon"))
    return space.write(rows.join(met, "id", "left"), name)


def _local(entries) -> Lexicon:
    entries = [] if entries is None else list(entries)
    return Lexicon({x["t"] for x in entries if not x["canon"]}, {x["t"]: x["canon"] for x in entries if x["canon"]})


def _learn(rows: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """given(t) and nick(t, canon): given names by their many companions and their place, short forms by the full name
    that stands with them.

    A family name that many bear has many companions too. It differs by the place, whatever the number of records: a
    given name stands first or after the comma, and an address that cuts one name to its initial cuts the given name.
    """

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = set()
            for name, email, variants in zip(f["name"], f["email"], f["variants"]):
                local = re.sub(r"[^a-z]", "", re.sub(r"^\d+\+", "", fold((email or "").split("@")[0]).lower()).split("+")[0])
                for form in [name, *(variants if variants is not None else [])]:
                    tokens, short, _ = split_name(form or "")
                    tokens = [t for t in tokens if len(t) > 2 and t not in short and t not in ORG_KINDS and t not in NOBODY]
                    if len(tokens) == 2 and not any(t in ORG_KINDS for t in split_name(form or "")[0]):
                        a, b = tokens
                        out |= {(a, b, "place", True), (b, a, "place", False)}
                        for given, family in ((a, b), (b, a)):
                            if local in (given[0] + family, family + given[0]):
                                out |= {(given, family, "mail", True), (family, given, "mail", False)}
            yield pd.DataFrame(sorted(out), columns=["t", "with", "by", "given"])

    seen = rows.select("name", "email", "variants").mapInPandas(pairs, "t string, with string, by string, given boolean").distinct()
    top = seen.groupBy("t").agg(F.count_distinct("with").alias("n"), F.avg(F.col("given").cast("int")).alias("share"))
    given = space.write(top.where((F.col("n") >= GIVEN_COMPANIONS) & (F.col("share") > GIVEN_SHARE)).select("t"), "given")
    none = given.select("t", F.lit("").alias("canon")).where("false")

    def nicks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, email, variants, lexicon in zip(f["name"], f["email"], f["variants"], f["lexicon"]):
                base = _local(lexicon)
                wide = FULL | ({x["t"] for x in lexicon} if lexicon is not None else set())
                firsts, fulls = set(), set()
                for form in [name, *(variants if variants is not None else [])]:
                    tokens, short, turned = split_name(form or "")
                    if tokens and tokens[0] not in short and 2 < len(tokens[0]) < 8:
                        firsts.add(tokens[0])
                    fulls |= {t for t in tokens if t in wide and len(t) >= 5}
                local = re.sub(r"^\d+\+", "", fold((email or "").split("@")[0]).lower()).split("+")[0].rstrip("0123456789")
                fulls |= {g for g in base.full if len(g) >= 5 and (local.startswith(g) or local.endswith(g))}
                out += [(a, b) for a in firsts for b in fulls if a != b and len(a) < len(b)]
            yield pd.DataFrame(out, columns=["nick", "full"])

    known = _with_lexicon(rows, given, none, space, "with_given", slips=False)
    counts = known.select("name", "email", "variants", "lexicon").mapInPandas(nicks, "nick string, full string").groupBy("nick", "full").agg(F.count("*").alias("n"))
    w = Window.partitionBy("nick")
    best = counts.withColumn("all", F.sum("n").over(w)).where((F.col("n") >= NICK_RECORDS) & (F.col("n") >= NICK_SHARE * F.col("all")))
    best = best.where(~F.col("nick").isin(sorted(FULL)) & ~F.col("full").isin(sorted(SHORT)))
    # A token with a full name of its own among the given names isn't a short form unless it begins or ends that name.
    own = given.select(F.col("t").alias("nick"), F.lit(True).alias("own"))
    ends = F.col("full").startswith(F.substring("nick", 1, 2)) | F.col("full").endswith(F.substring("nick", -2, 2))
    best = best.join(own, "nick", "left").where(F.col("own").isNull() | ends)
    return given, space.write(best.select(F.col("nick").alias("t"), F.col("full").alias("canon")), "nicks")


PROFILE = "spelling string, kind string, given string, initial string, prefix string, family string, sure boolean, num string, guesses array<string>"


def profiles(records: DataFrame, key: str, name: str, email: str, variants: str, space: Workspace) -> DataFrame:
    """id, how the name is spelled (its tokens in order of the alphabet), and what the record says of its person."""
    kind = dict(records.dtypes)[key]
    rows = records.select(F.col(f"`{key}`").alias("id"), F.col(f"`{name}`").alias("name"), F.col(f"`{email}`").alias("email"), F.col(f"`{variants}`").alias("variants")).where("id is not null").dropDuplicates(["id"])
    rows = space.write(rows, "records")
    rows = _with_lexicon(rows, *_learn(rows, space), space, "with_lexicon")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [read_record(n, e, list(v) if v is not None else None, _local(x)) for n, e, v, x in zip(f["name"], f["email"], f["variants"], f["lexicon"])]
            out = pd.DataFrame(got, columns=list(EMPTY))
            out.insert(0, "spelling", [" ".join(sorted(split_name(n or "")[0])) for n in f["name"]])
            out.insert(0, "id", f["id"].to_numpy())
            yield out

    return space.write(rows.mapInPandas(read, f"id {kind}, {PROFILE}"), "profiles")


#: The verified similarity of given and family name.
SAME = 0.9


def _alike(nodes: DataFrame, others: DataFrame, by: str) -> DataFrame:
    """nodes(by, family, node, n) x others(by, family, node, n) -> a, b: every two verified as spellings of one name.

    Set-similarity join on the two-letter grams of the tokens by prefix filter. Two names that may be one differ by at most
    one slip (two from ten letters on), which touches at most three (four) grams; so with grams in order of rarity, one of
    the first four (five) is common to both. Verified by soft token similarity in which rare tokens count more: ``by`` is
    the token that both share, and the family name is weighed by its frequency and how near the two are.
    """
    padded = F.concat(F.lit("^"), F.col("family"), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2)))
    families = others.select(by, "family").distinct()
    rarity = families.select(F.explode_outer(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    first = F.when(F.length("family") >= 9, 5).otherwise(4)  # one of nine letters may be a slip of one of ten

    def prefix(k: DataFrame) -> DataFrame:
        names = k.select(by, "family").distinct().withColumn("grams", grams)
        long = names.select(by, "family", first.alias("first"), F.explode_outer("grams").alias("gram"))
        # Grams that no other name has come first, as the rarest.
        long = long.join(rarity, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        order = Window.partitionBy(by, "family").orderBy("df", "gram")
        kept = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("first")).select(by, "family", "gram")
        return kept.join(k, [by, "family"])

    one = prefix(nodes).select(by, "gram", F.col("family").alias("f"), F.col("node").alias("a"), F.col("n").alias("fn"))
    other = prefix(others).select(by, "gram", F.col("family").alias("g"), F.col("node").alias("b"), F.col("n").alias("gn"))
    pairs = one.join(other, [by, "gram"]).where("a <> b and abs(length(f) - length(g)) <= 2").drop("gram").distinct()
    total = others.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weight = lambda n: F.log(1 + F.lit(float(total)) / n)
    pairs = pairs.join(others.groupBy(by).agg(F.sum("n").alias("common_n")), by)
    slips = F.levenshtein("f", "g")
    swapped = slips - F.when((slips == 2) & (F.length("f") == F.length("g")) & (F.array_join(F.array_sort(F.split("f", "")), "") == F.array_join(F.array_sort(F.split("g", "")), "")), 1).otherwise(0)
    wg, wf = weight(F.col("common_n")), weight(F.greatest("fn", "gn"))
    near = 1 - swapped / F.greatest(F.length("f"), F.length("g"))
    allowed = F.when(F.greatest(F.length("f"), F.length("g")) >= 10, 2).otherwise(1)
    alike = (swapped == 0) | ((swapped <= allowed) & (F.least(F.length("f"), F.length("g")) >= 5))
    return pairs.withColumn("sim", (wg + wf * near) / (wg + wf)).where((F.col("sim") >= SAME) & alike)


def same_names(records: DataFrame, key: str, name: str, email: str, variants: str) -> DataFrame:
    """key, entity for every record linked to another one; entity is the smallest key of its person or organisation.

    Null and empty names, placeholders and automation accounts link to nothing; a mailbox that several names share
    links nobody, nor does a given name alone. Repeated rows of a key are one record. Empty input gives no rows.
    """
    space = Workspace(records.sparkSession, "names")
    kind = dict(records.dtypes)[key]
    p = profiles(records, key, name, email, variants, space).where("kind is not null")
    # Guessed family names count where some other record has the name for certain.
    known = p.where("family is not null").groupBy("family").agg(F.count("*").alias("n"))
    guessed = p.where("family is null and size(guesses) > 0").select("id", F.posexplode("guesses").alias("at", "family")).join(known, "family")
    guessed = guessed.groupBy("id").agg(F.min(F.struct("at", "family"))["family"].alias("guess"))
    p = p.join(guessed, "id", "left").withColumn("family", F.coalesce("family", "guess")).withColumn("sure", F.col("sure") | F.col("guess").isNotNull()).where("family is not null").drop("guess", "guesses")
    p = space.write(p, "named")
    org = F.col("kind").startswith("org")
    at = lambda *c: F.concat_ws("|", *c)
    p = p.withColumn("node", F.when(F.col("given").isNotNull(), at("given", "family", "spelling")))
    # Copies of a spelling are one node; every verified pair of nodes is a link, and what they connect is one name,
    # however many links away. Two names that are both certain are one only if they agree.
    known = p.where("given is not null").groupBy("given", "family").agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
    full = space.write(p.where("given is not null").select("given", "family", "node").distinct().join(known, ["given", "family"]), "keys")
    linked = _alike(full.drop("sure"), full.drop("sure"), "given")
    certain = full.where("sure").select("node")
    unsure = linked.where("f <> g and a < b").join(certain.withColumnRenamed("node", "a"), "a", "left_semi").join(certain.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    linked = linked.where("a < b").select("a", "b").join(unsure, ["a", "b"], "left_anti")
    groups = components(space.write(linked, "links"), "a", "b")
    p = p.join(groups, "node", "left")
    p = space.write(p.withColumn("one", F.coalesce("component", "node")).drop("node", "component"), "respelled")
    strong = p.where("given is not null").select("id", at(F.when(org, "o").otherwise("p"), "one").alias("hub"))
    # Who has only an initial may be any name of that family and initial, or one that shares a spelling with such a name.
    mine = p.where(~org & F.col("given").isNotNull()).groupBy("family", "initial", "one").agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
    mine = space.write(mine, "spelled")
    several = mine.join(mine.groupBy("one").agg(F.count("*").alias("c")).where("c > 1").select("one"), "one", "left_semi")
    spelled = several.select("one", F.col("family").alias("other"))
    over = several.select("family", "initial", "one").join(spelled, "one").where("other <> family").select("family", "initial", "other")
    over = over.distinct().join(mine.select(F.col("family").alias("other"), "initial", "one"), ["other", "initial"]).select("family", "initial", "one")
    names = mine.select("family", "initial", at(F.lit("p"), "one").alias("hub")).unionByName(over.select("family", "initial", at(F.lit("p"), "one").alias("hub"))).distinct()
    weak = p.where(~org & F.col("given").isNull() & F.col("initial").isNotNull())
    bare = weak.groupBy("family", "initial").agg(F.count("*").alias("n"), F.max("sure").alias("sure")).join(mine, ["family", "initial"], "left_anti")
    bare = space.write(bare, "bare")
    own = bare.select("family", "initial", at(F.lit("w"), "family", "initial").alias("hub"))
    # A spelling that no other record confirms, without a given name: the family that it nearly is, if it is the only one.
    known = mine.groupBy("family", "initial").agg(F.sum("n").alias("n"), F.max("sure").alias("sure")).unionByName(bare.where("sure"))
    keyed = lambda df: df.select("initial", "family", "n", F.col("family").alias("node"))
    close = _alike(keyed(bare.where("not sure")), keyed(known), "initial").select("initial", "f", F.col("g").alias("family"))
    close = close.join(names.unionByName(own), ["family", "initial"]).select(F.col("f").alias("family"), "initial", "hub")
    may = names.unionByName(close).groupBy("family", "initial").agg(F.min("hub").alias("a"), F.max("hub").alias("b")).where("a = b").select("family", "initial", F.col("a").alias("hub"))
    may = space.write(may, "fitting")
    fits = F.col("prefix").isNull() | F.col("hub").startswith("w|") | F.col("hub").startswith(F.concat(F.lit("p|"), F.col("prefix")))
    joined = weak.join(may, ["family", "initial"]).where(fits).select("id", "hub")
    alone = weak.join(own, ["family", "initial"]).select("id", "hub")
    # The number that a person's addresses carry, whole or its last two digits, under every family that the record may have.
    tail = F.lpad(F.substring("num", -2, 2), 2, "0")
    last = F.element_at(F.split("one", r"\|"), 2)
    counted = p.where(~org & F.col("num").isNotNull() & F.col("initial").isNotNull()).select("id", "family", "initial", "given", "one", tail.alias("tail"))
    called = names.unionByName(may).where("hub like 'p|%'").select("family", "initial", F.element_at(F.split("hub", r"\|"), 3).alias("called")).distinct()
    numbered = counted.select("id", "initial", "tail", "family").unionByName(counted.where("given is not null").select("id", "initial", "tail", last.alias("family")))
    numbered = numbered.unionByName(counted.where("given is null").join(called, ["family", "initial"]).select("id", "initial", "tail", F.col("called").alias("family")))
    numbered = numbered.select("id", at(F.lit("n"), "family", "initial", "tail").alias("hub")).distinct()
    numbered = numbered.join(numbered.groupBy("hub").agg(F.count("*").alias("c")).where("c > 1").select("hub"), "hub", "left_semi")
    hubs = space.write(strong.unionByName(numbered).unionByName(joined).unionByName(alone), "hubs")
    # Each record is linked to the smallest of its hub: a star, however many share the hub.
    least = hubs.groupBy("hub").agg(F.min("id").alias("m"), F.count("*").alias("c")).where("c > 1")
    stars = hubs.join(least, "hub").where("id <> m").select("id", "m")
    return components(stars, "id", "m").select(F.col("node").cast(kind).alias(key), F.col("component").cast(kind).alias("entity"))


def pairs_of(groups: DataFrame, key: str, entity: str) -> DataFrame:
    """id_a < id_b for every pair of a group, as the result asks for all pairs; groups are joined with themselves by entity."""
    a = groups.select(F.col(entity).alias("e"), F.col(key).alias("id_a"))
    b = groups.select(F.col(entity).alias("e"), F.col(key).alias("id_b"))
    return a.join(b, "e").where("id_a < id_b").select("id_a", "id_b")
