"""Facts of captured compiler syntax trees: function definitions, calls, type declarations, type uses.

A location names its file and line only where they change, so both are carried along in document order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.strict_json import loads

AST_SCHEMA = (
    "graph_name string, ast_id bigint, entry_index int, compiler_id string, record string, kind string, name string, owner string, target string,"
    " qual_type string, file string, line bigint, col bigint, byte_offset bigint"
)
_NAMES = [f.split()[0] for f in AST_SCHEMA.split(", ")]
_TYPES = {"RecordDecl": "struct", "EnumDecl": "enum", "TypedefDecl": "typedef"}
_USES = {"FieldDecl": "field", "ParmVarDecl": "parameter", "VarDecl": "variable", "TypedefDecl": "typedef", "FunctionDecl": "return"}


def _number(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _callee(node: dict) -> str | None:
    """The name that a call's first operand refers to, through casts and parentheses."""
    inner = node.get("inner")
    first = inner[0] if isinstance(inner, list) and inner else None
    while isinstance(first, dict):
        if first.get("kind") == "DeclRefExpr":
            ref = first.get("referencedDecl")
            return ref.get("name") if isinstance(ref, dict) and isinstance(ref.get("name"), str) else None
        inner = first.get("inner")
        first = inner[0] if isinstance(inner, list) and inner else None
    return None


def ast_rows(root: dict) -> list[tuple]:
    out: list[tuple] = []
    stack: list[tuple[dict, str | None]] = [(root, None)]
    file, line = None, None
    while stack:
        node, owner = stack.pop()
        loc = node.get("loc") if isinstance(node.get("loc"), dict) else {}
        if isinstance(loc.get("file"), str):
            file = loc["file"]
        line = _number(loc.get("line")) if loc.get("line") is not None else line
        kind, name = node.get("kind"), node.get("name")
        kind, name = (v if isinstance(v, str) else None for v in (kind, name))
        quals = node.get("type") if isinstance(node.get("type"), dict) else {}
        qual = quals.get("qualType") if isinstance(quals.get("qualType"), str) else None
        spot = (file, line, _number(loc.get("col")), _number(loc.get("offset")))
        inner = node.get("inner")
        inner = inner if isinstance(inner, list) else [inner] if isinstance(inner, dict) else []
        children = [c for c in inner if isinstance(c, dict)]
        if kind == "FunctionDecl" and any(c.get("kind") == "CompoundStmt" for c in children):
            out.append(("definition", kind, name, None, None, qual, *spot))
        if kind == "CallExpr":
            out.append(("call", kind, None, owner, _callee(node), qual, *spot))
        if kind in _TYPES and name:
            out.append(("type", _TYPES[kind], name, None, None, qual, *spot))
        if kind in _USES and qual:
            out.append(("use", _USES[kind], name, owner, None, qual, *spot))
        inside = name if kind in ("FunctionDecl", "RecordDecl") and name else owner
        stack.extend((c, inside) for c in reversed(children))
    return out


def ast_facts(asts: DataFrame) -> DataFrame:
    """``asts``: graph_name, ast_id, entry_index, compiler_id, ast_json. One row per fact: see AST_SCHEMA."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int32()] + [pa.string()] * 8 + [pa.int64()] * 3
        for b in batches:
            rows = []
            for *head, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    root = loads(text)
                except ValueError:
                    continue
                if isinstance(root, dict):
                    rows += [(*head, *r) for r in ast_rows(root)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

    source = asts.where("ast_json is not null and ast_json <> ''").select(
        "graph_name", F.col("ast_id").cast("bigint"), F.col("entry_index").cast("int"), "compiler_id", "ast_json"
    )
    return source.mapInArrow(scan, AST_SCHEMA).distinct()
