"""Per-file extraction that needs a parser: Python syntax and brace-delimited blocks.

Each function here turns the text of one file into a few small lists. Spark decides
which files reach it, moves the text in Arrow batches, and does everything that
joins, groups or compares. A file that cannot be handled yields an error text
instead of failing the job.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..rules import MIN_FUNCTION_LINES, holds

PYTHON_TYPE = (
    "struct<functions:array<struct<name:string,line:int,fp:string,n_lines:int>>,"
    "imports:array<struct<name:string,line:int>>,used:array<string>,"
    "toplevel:array<struct<name:string,line:int,elsewhere:boolean>>,error:string>"
)
JS_TYPE = "struct<blocks:array<struct<name:string,line:int,block:string,n_lines:int>>,error:string>"

_SITE = pa.struct([("name", pa.string()), ("line", pa.int32())])
_PYTHON_ARROW = pa.struct(
    [
        ("functions", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("fp", pa.string()), ("n_lines", pa.int32())]))),
        ("imports", pa.list_(_SITE)),
        ("used", pa.list_(pa.string())),
        ("toplevel", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("elsewhere", pa.bool_())]))),
        ("error", pa.string()),
    ]
)
_JS_ARROW = pa.struct(
    [
        ("blocks", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("block", pa.string()), ("n_lines", pa.int32())]))),
        ("error", pa.string()),
    ]
)


def guarded(extract: Callable[[str], dict | None]) -> Callable[[str | None], dict | None]:
    """Turn an exception for one text into ``{"error": ...}`` for that text."""

    def run(text: str | None) -> dict | None:
        if not text:
            return None
        try:
            return extract(text)
        except Exception as problem:
            return {"error": f"{type(problem).__name__}: {problem}"}

    return run


def with_quarantine(extract: Callable[[str], dict | None], arrow_type: pa.DataType, spark_type: str):
    """A vectorised column function for ``extract`` in which a bad row cannot fail the job."""
    one = guarded(extract)

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], type=arrow_type)

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, returnType=spark_type)


# Which parts of a syntax node count for its shape, in visiting order. Node types
# not listed contribute all their children.
SHAPE = {
    "FunctionDef": ("args.args", "body"),
    "AsyncFunctionDef": ("args.args", "body"),
    "Attribute": ("value",),
    "Call": ("func", "args"),
    "Assign": ("targets", "value"),
    "Return": ("value",),
    "If": ("test", "body", "orelse"),
    "For": ("target", "iter", "body"),
    "While": ("test", "body"),
    "BinOp": ("left", "op", "right"),
    "Compare": ("left", "ops", "comparators"),
    "BoolOp": ("op", "values"),
    "Expr": ("value",),
    "Dict": ("keys", "values"),
    "List": ("elts",),
    "Subscript": ("value", "slice"),
    "Try": ("body", "handlers"),
}


def python_shape(root: ast.AST) -> str:
    """Digest of a function's structure; names only count by order of appearance."""
    seen: dict[str, int] = {}
    digest = hashlib.md5()
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            digest.update(item.encode())
            continue
        kind = type(item).__name__
        if kind == "Name" or isinstance(item, _Argument):
            name = item.id if kind == "Name" else item.name
            digest.update(f"<{seen.setdefault(name, len(seen))}>".encode())
            continue
        if kind == "Constant":
            digest.update(f"<{type(item.value).__name__}>".encode())
            continue
        label = {"AsyncFunctionDef": "FunctionDef"}.get(kind, kind)
        if kind == "Attribute":
            label += "." + item.attr
        parts: list = [label, "("]
        if kind in SHAPE:
            for field in SHAPE[kind]:
                if field == "args.args":
                    parts.extend(_Argument(a.arg) for a in item.args.args)
                else:
                    value = getattr(item, field)
                    members = value if isinstance(value, list) else [value]
                    parts.extend("-" if m is None else m for m in members)
                parts.append("|")
        else:
            parts.extend(ast.iter_child_nodes(item))
        parts.append(")")
        todo.extend(reversed(parts))
    return digest.hexdigest()


class _Argument:
    def __init__(self, name: str):
        self.name = name


def read_python(source: str) -> dict | None:
    """Functions, imports, used names and unreferenced top-level functions of one file."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return None
    functions, imports, used = [], [], set()
    for node in ast.walk(tree):
        kind = type(node).__name__
        if kind in ("FunctionDef", "AsyncFunctionDef"):
            length = node.end_lineno - node.lineno
            if length >= MIN_FUNCTION_LINES:
                functions.append(
                    {"name": node.name, "line": node.lineno, "fp": python_shape(node), "n_lines": length}
                )
        elif kind in ("Import", "ImportFrom"):
            imports.extend(
                {"name": a.asname or a.name, "line": node.lineno}
                for a in node.names
                if kind == "Import" or a.name != "*"
            )
        elif kind == "Name":
            used.add(node.id)
        elif kind == "Constant" and isinstance(node.value, str):
            used.add(node.value)
    candidates = {
        n.name: n.lineno
        for n in tree.body
        if type(n).__name__ in ("FunctionDef", "AsyncFunctionDef")
        and not n.name.startswith(("__", "test_"))
        and not n.decorator_list
    }
    toplevel = []
    if candidates:
        words = [set(re.findall(r"\w+", row)) for row in source.split("\n")]
        lines_with = Counter(w for row in words for w in row)
        for name, line in candidates.items():
            others = lines_with[name] - (name in words[line - 1])
            toplevel.append({"name": name, "line": line, "elsewhere": others > 0})
    # Only names that could match an import are worth sending back.
    wanted = {i["name"] for i in imports} | {i["name"].split(".")[0] for i in imports}
    return {
        "functions": functions,
        "imports": imports,
        "used": [n.encode("utf-8", "ignore").decode() for n in sorted(used & wanted)],
        "toplevel": toplevel,
    }


# How a named function or arrow function starts.
JS_FUNCTION = re.compile(
    r"(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_$]\w*)\s*=>)"
)
_BRACE_OR_QUOTE = re.compile("[{}'\"`]")
# More text than this in the blocks of one file, nested ones counted again, is an error.
MAX_BLOCK_CHARS = 64_000_000


def block_ends(source: str) -> dict[int, int]:
    """Where the block of each opening brace ends, for all that close.

    A quote skips to its next occurrence, escaped or not; a lone quote is ignored. So what
    follows a sign does not depend on where one began to read, and one pass from the last
    sign to the first gives for each the closing brace that is reached from it with no
    block open: for an opening brace that is what is reached behind its own end.
    """
    places = [m.start() for m in _BRACE_OR_QUOTE.finditer(source)]
    behind = len(places)
    reached = [-1] * (behind + 1)
    later: dict[str, int] = {}
    ends = {}
    for i in range(behind - 1, -1, -1):
        sign = source[places[i]]
        if sign == "}":
            reached[i] = i
        elif sign == "{":
            own = reached[i + 1]
            if own >= 0:
                ends[places[i]] = places[own] + 1
                reached[i] = reached[own + 1]
        else:
            reached[i] = reached[later.get(sign, i) + 1]
            later[sign] = i
    return ends


# One of these is in every match of JS_FUNCTION.
JS_NEEDLES = ("function", "=>")


def may_hold_functions(source: str) -> bool:
    return "{" in source and any(needle in source for needle in JS_NEEDLES)


def read_js(source: str) -> dict | None:
    """Brace blocks of named functions that span enough lines."""
    if not may_hold_functions(source):
        return None
    blocks, held = [], 0
    ends = block_ends(source)
    breaks = [m.start() for m in re.finditer("\n", source)]
    for match in JS_FUNCTION.finditer(source):
        opening = source.find("{", match.end())
        end = ends.get(opening, -1)
        if end < 0:
            continue
        before = bisect_left(breaks, match.start())
        length = bisect_left(breaks, end) - before
        if length >= MIN_FUNCTION_LINES:
            held += end - opening
            if held > MAX_BLOCK_CHARS:
                raise ValueError(f"nested functions hold more than {MAX_BLOCK_CHARS} characters")
            blocks.append(
                {
                    "name": match.group(1) or match.group(2),
                    "line": before + 1,
                    "block": (opening, end),
                    "n_lines": length,
                }
            )
    # The texts are cut out once it is known that they are not too much.
    for block in blocks:
        block["block"] = source[slice(*block["block"])]
    return {"blocks": blocks} if blocks else None


def python_facts(text: Column) -> Column:
    return with_quarantine(read_python, _PYTHON_ARROW, PYTHON_TYPE)(text)


def js_facts(text: Column) -> Column:
    return with_quarantine(read_js, _JS_ARROW, JS_TYPE)(text)


def worth_reading_js(text: str) -> Column:
    """Whether a text may hold a named brace block; others are not sent to the workers."""
    test = F.lit(False)
    for needle in JS_NEEDLES:
        test = test | F.expr(holds(text, needle))
    return F.contains(F.col(text), F.lit("{")) & test


def small_batches(spark: SparkSession, max_bytes: int = 16 * 1024 * 1024) -> None:
    """Bound Arrow batches by size: source files vary from bytes to half a megabyte."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))
