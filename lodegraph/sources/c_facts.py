"""Facts of C source: functions, structs, enums, typedefs, calls and local includes, file by file.

A token scan, no front end: comments and literals are blanked, branches of ``#if 0`` are skipped, and
declarations are recognised by their shape at brace depth 0.  What several files decide (which function a
name means) is left to ``plans.index.c_graph_from_facts``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CFACT_SCHEMA = "graph_name string, source_file string, record string, kind string, name string, target string, first int, last int, is_static boolean"
_NAMES = [f.split()[0] for f in CFACT_SCHEMA.split(", ")]
_QUIET = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'", re.S)
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*"([^"\n]+)"', re.M)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)[ \t]*([^\n]*)", re.M)
_TOKEN = re.compile(r"[^\W\d]\w*|[{}()\[\];,=*]")
#: Words that a parenthesis may follow without being a call.
_NO_CALL = frozenset("if for while switch return sizeof do else case goto _Alignof _Generic _Static_assert defined struct union enum typedef".split())


def _blanked(text: str) -> str:
    """The text with comments, literals, directives and ``#if 0`` parts as blanks, line by line as long as before."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines, skip = text.split("\n"), []
    for i, line in enumerate(lines):
        m = _DIRECTIVE.match(line)
        if m:
            word = m[1]
            if word in ("if", "ifdef", "ifndef"):
                skip.append(bool(skip and skip[-1]) or (word == "if" and m[2].strip() == "0"))
            elif word in ("else", "elif") and skip:
                # of several branches one is read, so that braces stay balanced: the first that is not #if 0
                outer = len(skip) > 1 and skip[-2]
                skip[-1] = outer or not (skip[-1] and word == "else")
            elif word == "endif" and skip:
                skip.pop()
        if m or (skip and skip[-1]):
            lines[i] = ""
    return "\n".join(lines)


def c_rows(text: str) -> list[tuple]:
    """(record, kind, name, target, first line, last line, static) of one file."""
    out = [("include", "includes", None, m[1], text.count("\n", 0, m.start()) + 1, None, None) for m in _INCLUDE.finditer(text)]
    plain = _blanked(text)
    tokens = [(m[0], m.start()) for m in _TOKEN.finditer(plain)]
    line_starts = [0] + [m.end() for m in re.finditer("\n", plain)]
    from bisect import bisect_right

    line = lambda at: bisect_right(line_starts, at)
    depth = 0
    start = 0  # first token of the declaration at depth 0
    function: tuple[str, int, bool] | None = None
    for i, (t, at) in enumerate(tokens):
        if t == "{":
            if depth == 0 and function is None:
                head = [x for x, _ in tokens[start:i]]
                if head and head[-1] == ")" and "=" not in head:
                    k, level = len(head) - 1, 0
                    while k >= 0:
                        level += (head[k] == ")") - (head[k] == "(")
                        if level == 0:
                            break
                        k -= 1
                    if k > 0 and re.match(r"[^\W\d]", head[k - 1]) and head[k - 1] not in _NO_CALL:
                        function = (head[k - 1], line(tokens[start][1]), "static" in head[:k])
            depth += 1
        elif t == "}":
            depth = max(0, depth - 1)
            if depth == 0 and function is not None:
                out.append(("entity", "function", function[0], None, function[1], line(at), function[2]))
                function, start = None, i + 1
        elif t == ";" and depth == 0:
            head = [x for x, _ in tokens[start:i]]
            first, last = line(tokens[start][1]), line(at)
            tag = next((k for k, w in enumerate(head) if w in ("struct", "union", "enum")), None)
            if tag is not None and "{" in head and tag + 1 < len(head) and re.match(r"[^\W\d]", head[tag + 1]) and head[tag] != "union":
                out.append(("entity", head[tag], head[tag + 1], None, first, last, False))
            if head[:1] == ["typedef"]:
                pointer = re.search(r"\( \* (\w+) \) \(", " ".join(head))
                names = [w for w in head if re.match(r"[^\W\d]", w)]
                if pointer or names:
                    out.append(("entity", "typedef", pointer[1] if pointer else names[-1], None, first, last, False))
            start = i + 1
        elif t == "(" and function is not None and depth and i and re.match(r"[^\W\d]", tokens[i - 1][0]) and tokens[i - 1][0] not in _NO_CALL:
            out.append(("call", "calls", function[0], tokens[i - 1][0], line(tokens[i - 1][1]), None, None))
    return out


def c_facts(files: DataFrame) -> DataFrame:
    """``files``: graph_name, source_file, content. One row per fact: see CFACT_SCHEMA."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.bool_()]
        for b in batches:
            rows = [(g, f, *r) for g, f, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in c_rows(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

    source = files.where(r"content is not null and source_file rlike '\\.[ch]$'").select("graph_name", "source_file", "content").distinct()
    return source.mapInArrow(scan, CFACT_SCHEMA).distinct()
