"""Source code as token sequences and metrics: Arrow batches into Python, as no built-in expression parses code."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Words of the script languages and the tokens that stand for them.
WORDS = {
    "if": "IF", "else": "ELSE", "for": "FOR", "while": "WHILE", "do": "DO", "switch": "SWITCH", "case": "CASE",
    "default": "DEFAULT", "function": "FUNC", "return": "RETURN", "const": "VAR_DECL", "let": "VAR_DECL",
    "var": "VAR_DECL", "class": "CLASS", "import": "IMPORT", "export": "EXPORT", "async": "ASYNC", "await": "AWAIT",
    "try": "TRY", "catch": "CATCH", "finally": "FINALLY", "throw": "THROW", "new": "NEW", "this": "THIS", "yield": "YIELD",
}
# Operators that are tokens of their own; any other mark that is kept stands for itself.
OPERATORS = "=== !== == != => <= >= ++ -- && || + - * / % & = > < !".split()
MARKS = frozenset("{}()[];,.")
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Assert)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
Token = tuple[str, int, str | None]


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


_NAME_START = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_NAME_CHARS = _NAME_START | frozenset("0123456789$")
_BY_FIRST = {c: sorted((o for o in OPERATORS if o[0] == c), key=len, reverse=True) for c in {o[0] for o in OPERATORS}}


class Scanner:
    """Reads script code from left to right; each ``read_`` method says where a token of its class ends, or None."""

    def __init__(self, code: str):
        self.code, self.end = code, len(code)

    def breaks(self, at: int) -> bool:
        """Whether a word begins or ends between two characters."""
        left = at > 0 and _is_word(self.code[at - 1])
        return left != (at < self.end and _is_word(self.code[at]))

    def read_blank(self, at: int) -> int | None:
        code = self.code
        if code[at].isspace():
            return at + 1
        two = code[at : at + 2]
        if two == "//":
            stop = code.find("\n", at)
            return self.end if stop < 0 else stop
        if two == "/*" and (stop := code.find("*/", at + 2)) >= 0:
            return stop + 2
        return None

    def read_text(self, at: int) -> int | None:
        """One past the quote that closes a literal; a backslash guards the character after it."""
        quote, i = self.code[at], at + 1
        while i < self.end:
            c = self.code[i]
            if c == quote:
                return i + 1
            if c == "\\":
                if self.code[i + 1 : i + 2] in ("", "\n"):
                    return None
                i += 1
            i += 1
        return None

    def _digits(self, at: int) -> int:
        while at < self.end and self.code[at].isdecimal():
            at += 1
        return at

    def read_number(self, at: int) -> int | None:
        whole = self._digits(at)
        part = self._digits(whole + 1) if self.code[whole : whole + 1] == "." else whole
        return next((e for e in (part, whole) if e > at and self.code[e - 1] != "." and self.breaks(e)), None)

    def read_name(self, at: int) -> int | None:
        stop = at
        while stop < self.end and self.code[stop] in _NAME_CHARS:
            stop += 1
        while stop > at and not self.breaks(stop):
            stop -= 1
        return stop if stop > at else None


def script_tokens(code: str) -> list[Token]:
    """(token, line, identifier) of script code: names become VAR or, after a point, PROP:name; a text counts at its last line.

    Remarks and blanks are passed over, and so is what fits no class; a literal or a remark that never ends is no token.
    """
    scan = Scanner(code)
    out: list[Token] = []
    at, line = 0, 1
    while at < scan.end:
        c = code[at]
        begins = scan.breaks(at)
        ident = token = None
        if (stop := scan.read_blank(at)) is not None:
            pass
        elif c in "\"'`" and (stop := scan.read_text(at)) is not None:
            token = "STR"
        elif begins and c.isdecimal() and (stop := scan.read_number(at)) is not None:
            token = "NUM"
        elif begins and (c in _NAME_START or c == "$") and (stop := scan.read_name(at)) is not None:
            word = code[at:stop]
            token = WORDS.get(word)
            if token is None:
                ident = word
                token = f"PROP:{word}" if out and out[-1][0] == "." else "VAR"
        elif (op := next((o for o in _BY_FIRST.get(c, ()) if code.startswith(o, at)), None)) is not None:
            token, stop = f"OP:{op}", at + len(op)
        elif c in MARKS:
            token, stop = c, at + 1
        else:
            stop = at + 1
        line += code.count("\n", at, stop)
        at = stop
        if token is not None:
            out.append((token, line, ident))
    return out


_SILENT = (ast.Module, ast.Pass, ast.Load, ast.Store, ast.Del)


def python_tokens(code: str) -> list[Token]:
    """Tokens of Python code in the order of a walk through its tree; code that doesn't parse has none."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[Token] = []
    stack: list[tuple[ast.AST, int]] = [(tree, 1)]
    while stack:
        node, line = stack.pop()
        line = getattr(node, "lineno", line)
        if isinstance(node, ast.Name):
            out.append(("VAR", line, node.id))
        elif isinstance(node, ast.arg):
            out.append(("VAR", line, node.arg))
        elif isinstance(node, ast.Attribute):
            out.append((f"PROP:{node.attr}", line, node.attr))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("FUNC_DEF", line, node.name))
        elif isinstance(node, ast.ClassDef):
            out.append(("CLASS_DEF", line, node.name))
        elif isinstance(node, (ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
            out.append((f"OP:{type(node).__name__}", line, None))
        elif isinstance(node, ast.Constant):
            v = node.value
            out.append(("STR" if isinstance(v, (str, bytes)) else "NUM" if isinstance(v, (bool, int, float, complex)) else "CONST", line, None))
        if not isinstance(node, (*_SILENT, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
            out.append((type(node).__name__, line, None))
        stack.extend((c, line) for c in reversed(list(ast.iter_child_nodes(node))))
    return out


def python_metrics(code: str) -> tuple[int, int, str] | None:
    """(complexity, functions, fingerprint of the structure); None where nothing parses."""
    if not code.strip():
        return None
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    nodes = list(ast.walk(tree))
    shape = " ".join(type(n).__name__ for n in nodes if not isinstance(n, (ast.Name, ast.Constant, ast.arg, ast.Load, ast.Store, ast.Del)))
    return 1 + sum(isinstance(n, _BRANCHES) for n in nodes), sum(isinstance(n, _FUNCTIONS) for n in nodes), hashlib.sha256(shape.encode()).hexdigest()[:32]


# Tokens of script code at which its flow branches, and those that open a function.
SCRIPT_BRANCHES = {"IF", "FOR", "WHILE", "CASE", "CATCH", "OP:&&", "OP:||"}
SCRIPT_FUNCTIONS = {"FUNC", "OP:=>"}


def script_metrics(code: str) -> tuple[int, int, str] | None:
    """(complexity, functions, fingerprint of the structure) of script code by its tokens; None where there are none."""
    kinds = [t for t, _, _ in script_tokens(code)]
    if not kinds:
        return None
    shape = " ".join(t for t in kinds if t not in ("VAR", "STR", "NUM") and not t.startswith("PROP:"))
    return 1 + sum(t in SCRIPT_BRANCHES for t in kinds), sum(t in SCRIPT_FUNCTIONS for t in kinds), hashlib.sha256(shape.encode()).hexdigest()[:32]


TOKENS = "array<struct<token:string,line:int,ident:string>>"
_TYPE = pa.list_(pa.struct([("token", pa.string()), ("line", pa.int32()), ("ident", pa.string())]))


def tokenize(df: DataFrame, key: str, path: str, code: str) -> DataFrame:
    """key and the tokens of each source text: Python by its tree, everything else by the script lexer. Null texts have none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                f = python_tokens if (p or "").lower().endswith(".py") else script_tokens
                out.append([dict(zip(("token", "line", "ident"), t)) for t in f((text or "").replace("\0", ""))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _TYPE)], ["k", "tokens"])

    return df.select(F.col(key).alias("k"), F.col(path), F.col(code)).mapInArrow(run, f"k {kind}, tokens {TOKENS}").withColumnRenamed("k", key)


def metrics(df: DataFrame, key: str, code: str, of=python_metrics) -> DataFrame:
    """key, complexity, functions, fingerprint by one of the measures above; null where nothing parses."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [of(c or "") for c in f.iloc[:, 1]]
            yield pd.DataFrame({"k": f.iloc[:, 0], "complexity": pd.array([g and g[0] for g in got], "Int32"), "functions": pd.array([g and g[1] for g in got], "Int32"), "fingerprint": [g and g[2] for g in got]})

    return df.select(F.col(key).alias("k"), code).mapInPandas(run, f"k {kind}, complexity int, functions int, fingerprint string").withColumnRenamed("k", key)


@udtf(returnType="node int, parent int, depth int, kind string, line int, text string")
class SyntaxTree:
    """The tree of a Python source as flat rows, to a depth of 12; texts of leaves up to 120 characters."""

    def eval(self, code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        todo, n = [(tree, -1, 0)], 0
        while todo:
            node, parent, depth = todo.pop(0)
            me, n = n, n + 1
            leaf = getattr(node, "id", None) or getattr(node, "attr", None) or (repr(node.value) if isinstance(node, ast.Constant) else None)
            yield me, parent, depth, type(node).__name__, getattr(node, "lineno", None), leaf[:120] if leaf else None
            if depth < 12:
                todo.extend((c, me, depth + 1) for c in ast.iter_child_nodes(node))
