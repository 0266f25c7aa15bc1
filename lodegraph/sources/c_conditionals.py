"""Conditional regions and macros of C source, and whether regions are live, dead or unknown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

REGION_SCHEMA = "graph_name string, source_file string, region_id int, kind string, condition string, first int, last int, depth int, is_guard boolean, liveness string, basis string"
_NAMES = [f.split()[0] for f in REGION_SCHEMA.split(", ")]
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif|define|undef)\b[ \t]*(.*?)[ \t]*$")
_TOKEN = re.compile(r"\s*(?:(defined)\b|([A-Za-z_]\w*)|(0[xX][0-9a-fA-F]+|\d+)[uUlL]*|(\|\||&&|==|!=|<=|>=|<<|>>|[-+*/%!<>()&|^~]))")


class Unknown(Exception):
    """The value of a condition cannot be known."""


def evaluate(condition: str, env: dict[str, str | None], closed: bool = False) -> bool | None:
    """Three-valued truth of an #if expression: names outside ``env`` are unknown, or 0 if ``closed``.

    A None value in ``env`` says that the macro is known not to be defined.
    """
    tokens, at = [], 0
    condition = condition.strip()
    while at < len(condition):
        m = _TOKEN.match(condition, at)
        if not m:
            return None
        tokens.append(m.group(m.lastindex))
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else None

    def take():
        nonlocal pos
        pos += 1
        return tokens[pos - 1] if pos <= len(tokens) else None

    def either():
        left = both()
        while peek() == "||":
            take()
            right = both()
            left = 1 if left or right else None if left is None or right is None else 0
        return left

    def both():
        left = compare()
        while peek() == "&&":
            take()
            right = compare()
            left = 0 if left == 0 or right == 0 else None if left is None or right is None else 1
        return left

    def compare():
        left = add()
        while peek() in ("==", "!=", "<", ">", "<=", ">="):
            op, right = take(), add()
            if left is None or right is None:
                left = None
            else:
                left = int({"==": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op])
        return left

    def add():
        left = unary()
        while peek() in ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>"):
            op, right = take(), unary()
            if left is None or right is None or (op in "/%" and right == 0):
                left = None
            else:
                left = {"+": left + right, "-": left - right, "*": left * right, "/": left // right if right else 0, "%": left % right if right else 0,
                        "&": left & right, "|": left | right, "^": left ^ right, "<<": left << (right & 63), ">>": left >> (right & 63)}[op]
        return left

    def unary():
        t = take()
        if t == "!":
            v = unary()
            return None if v is None else int(not v)
        if t == "-":
            v = unary()
            return None if v is None else -v
        if t == "(":
            v = either()
            if take() != ")":
                raise Unknown
            return v
        if t == "defined":
            name = take()
            if name == "(":
                name = take()
                take()
            return int(env[name] is not None) if name in env else 0 if closed else None
        if t is None or not re.match(r"\w", t):
            raise Unknown
        if t[0].isdigit():
            return int(t, 0) if not re.fullmatch(r"0[0-7]+", t) else int(t, 8)
        if t in env:
            v = env[t]
            return 0 if v is None else int(v, 0) if re.fullmatch(r"-?(0[xX][0-9a-fA-F]+|[1-9]\d*|0)", v) else None
        return 0 if closed else None

    try:
        value = either()
    except (Unknown, KeyError, ValueError, TypeError):
        return None
    return None if pos < len(tokens) or value is None else bool(value)


def regions(text: str, given: dict[str, str | None] | None = None, closed: bool = False) -> list[tuple]:
    """(region_id, kind, condition, first, last, depth, is_guard, liveness, basis) per branch of a file."""
    env = dict(given or {})
    out: list[list] = []
    stack: list[dict] = []
    plain = re.sub(r"/\*.*?\*/", lambda m: " " + "\n" * m[0].count("\n"), text.replace("\r\n", "\n"), flags=re.S)
    lines = plain.split("\n")

    def state(own: bool | None, earlier: list[bool | None]) -> tuple[str, str]:
        if any(e is True for e in earlier):
            return "dead", "earlier branch"
        if own is False:
            return "dead", "macro"
        if own is None or any(e is None for e in earlier):
            return "unknown", ""
        return "live", "macro"

    def around(live: str, basis: str) -> tuple[str, str]:
        outer = [out[f["open"]][7] for f in stack[:-1]]
        if "dead" in outer:
            return "dead", "enclosing"
        return ("unknown", "enclosing") if "unknown" in outer and live == "live" else (live, basis)

    def close(line: int) -> None:
        out[stack[-1]["open"]][4] = max(line, out[stack[-1]["open"]][3])

    for number, line in enumerate(lines, 1):
        m = _DIRECTIVE.match(line.split("//")[0])
        if not m:
            continue
        word, rest = m[1], m[2].strip()
        dead = any(out[f["open"]][7] == "dead" for f in stack)
        if word in ("if", "ifdef", "ifndef"):
            shown = rest if word == "if" else f"{'!' if word == 'ifndef' else ''}defined({rest})"
            own = evaluate(shown, env, closed)
            stack.append({"open": len(out), "earlier": [own]})
            guard = word == "ifndef" and len(stack) == 1 and any(re.match(rf"\s*#\s*define\s+{re.escape(rest)}\b", x) for x in lines[number : number + 2])
            out.append([len(out), word, rest, number, number, len(stack), guard, "", ""])
            out[-1][7:9] = ("live", "guard") if guard else around(*state(own, []))
        elif word in ("elif", "else") and stack:
            close(number - 1)
            top = stack[-1]
            own = evaluate(rest, env, closed) if word == "elif" else True
            live = state(own, top["earlier"])
            top["earlier"].append(own)
            top["open"] = len(out)
            out.append([len(out), word, rest, number, number, len(stack), False, "", ""])
            out[-1][7:9] = around(*live)
        elif word == "endif" and stack:
            close(number)
            stack.pop()
        elif word in ("define", "undef") and not dead and rest:
            name = re.match(r"\w+", rest)
            if name:
                sure = all(out[f["open"]][7] == "live" for f in stack)
                value = rest[name.end() :].strip()
                if sure:
                    env[name[0]] = None if word == "undef" else value
                else:
                    env.pop(name[0], None)
    while stack:
        close(len(lines))
        stack.pop()
    return [tuple(r) for r in out]


def conditional_regions(files: DataFrame, given: dict[str, str | None] | None = None, closed: bool = False) -> DataFrame:
    """``files``: graph_name, source_file, content. One row per branch: see REGION_SCHEMA."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 2 + [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
        for b in batches:
            rows = [(g, f, *r) for g, f, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in regions(t, given, closed)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

    source = files.where(r"content is not null and source_file rlike '\\.[ch]$'").select("graph_name", "source_file", "content").distinct()
    return source.mapInArrow(scan, REGION_SCHEMA)


def macro_census(files: DataFrame) -> DataFrame:
    """Object-like and function-like macros, and conditional directives, per graph."""
    from pyspark.sql import functions as F

    text = files.where(r"content is not null and source_file rlike '\\.[ch]$'").select("graph_name", "source_file", "content").distinct()
    n = lambda pattern: F.sum(F.regexp_count("content", F.lit(pattern)))
    return text.groupBy("graph_name").agg(
        F.count(F.lit(1)).alias("n_files"),
        n(r"(?m)^[ \t]*#[ \t]*define[ \t]+\w+\(").alias("n_function_macros"),
        n(r"(?m)^[ \t]*#[ \t]*define[ \t]+\w+(?![\w(])").alias("n_object_macros"),
        n(r"(?m)^[ \t]*#[ \t]*if(n?def)?\b").alias("n_conditionals"),
    )
