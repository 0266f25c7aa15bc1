"""Parsers and document functions that have no relational form, as plain functions over one value.

``vectorised`` turns any of them into a column function that works on Arrow batches.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import functions as F

from lodegraph.strict_json import loads as strict_loads


def vectorised(f: Callable, returns: str):
    """A column function from a function of plain values; an error or a null argument gives null."""
    import pandas as pd

    def apply(*series):
        def one(*args):
            if any(a is None for a in args):
                return None
            try:
                return f(*args)
            except (ValueError, KeyError, IndexError, TypeError, OverflowError):
                return None

        return pd.Series([one(*row) for row in zip(*series, strict=True)], dtype=object)

    n = f.__code__.co_argcount - len(f.__defaults__ or ())
    wrappers = {1: lambda a: apply(a), 2: lambda a, b: apply(a, b), 3: lambda a, b, c: apply(a, b, c)}
    chosen = wrappers[n]
    chosen.__annotations__ = {k: pd.Series for k in chosen.__code__.co_varnames[: chosen.__code__.co_argcount]} | {"return": pd.Series}
    return F.pandas_udf(chosen, returns)


# --- dates, times, durations ---------------------------------------------------------------------


def parse_date(text: str) -> date:
    """Calendar, ordinal and week dates, basic or extended; a year, a century or a month stands for its first day."""
    sign = -1 if text.startswith("-") else 1
    t = text.lstrip("+-")
    forms = [
        (r"(\d{4})-?(\d{2})-?(\d{2})", lambda y, m, d: date(y, m, d)), (r"(\d{4})-?W(\d{2})-?(\d)", lambda y, w, d: date.fromisocalendar(y, w, d)),
        (r"(\d{4})-?W(\d{2})", lambda y, w: date.fromisocalendar(y, w, 1)), (r"(\d{4})-?(\d{3})", lambda y, n: _day_of_year(y, n)),
        (r"(\d{4})-(\d{2})", lambda y, m: date(y, m, 1)), (r"(\d{4})", lambda y: date(y, 1, 1)), (r"(\d{2})", lambda c: date(c * 100 + 1, 1, 1)),
    ]
    for pattern, make in forms:
        if m := re.fullmatch(pattern, t):
            if sign < 0:
                raise ValueError("years before 1")
            return make(*map(int, m.groups()))
    raise ValueError(f"no date: {text!r}")


def _day_of_year(year: int, n: int) -> date:
    got = date(year, 1, 1) + timedelta(days=n - 1)
    if n < 1 or got.year != year:
        raise ValueError("day of the year")
    return got


def parse_time(text: str) -> dict:
    """Hours, minutes, seconds, microseconds and zone offset in minutes; the last unit may have a fraction."""
    m = re.fullmatch(r"T?(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?(?:[.,](\d+))?(Z|[+-]\d{2}(?::?\d{2})?)?", text)
    if not m:
        raise ValueError(f"no time: {text!r}")
    hour, minute, second = int(m[1]), int(m[2] or 0), int(m[3] or 0)
    unit = 1 if m[3] else 60 if m[2] else 3600
    extra = round(float("0." + m[4]) * unit * 1_000_000) if m[4] else 0
    total = (hour * 3600 + minute * 60 + second) * 1_000_000 + extra
    if hour > 24 or minute > 59 or second > 59 or total > 86_400_000_000:
        raise ValueError("out of range")
    zone = None
    if m[5]:
        zone = 0 if m[5] == "Z" else (1 if m[5][0] == "+" else -1) * (int(m[5][1:3]) * 60 + int(m[5][3:].lstrip(":") or 0))
    total %= 86_400_000_000
    return {"hour": total // 3_600_000_000, "minute": total // 60_000_000 % 60, "second": total // 1_000_000 % 60, "microsecond": total % 1_000_000, "zone_minutes": zone}


def parse_duration(text: str) -> dict:
    """Years and months apart from the exact rest: {years, months, days, seconds, microseconds}."""
    if m := re.fullmatch(r"([+-])?P(\d{4})-?(\d{2})-?(\d{2})T(\d{2}):?(\d{2}):?(\d{2})", text):
        sign, (years, months, days, hours, minutes, seconds) = -1 if m[1] == "-" else 1, map(int, m.groups()[1:])
        rest = sign * timedelta(days=days, hours=hours, minutes=minutes, seconds=seconds)
        return {"years": float(sign * years), "months": float(sign * months), "days": rest.days, "seconds": rest.seconds, "microseconds": 0}
    number = r"(\d+(?:[.,]\d+)?)"
    m = re.fullmatch(rf"([+-])?P(?!$)(?:{number}Y)?(?:{number}M)?(?:{number}W)?(?:{number}D)?(?:T(?:{number}H)?(?:{number}M)?(?:{number}S)?)?", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    years, months, weeks, days, hours, minutes, seconds = (float((g or "0").replace(",", ".")) for g in m.groups()[1:])
    rest = timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)
    sign = -1 if m[1] == "-" else 1
    rest *= sign
    return {"years": sign * years, "months": sign * months, "days": rest.days, "seconds": rest.seconds, "microseconds": rest.microseconds}


def format_duration(years: float, months: float, days: int, seconds: float) -> str:
    whole, hours = int(seconds), 0
    hours, whole = divmod(whole, 3600)
    minutes, whole = divmod(whole, 60)
    rest = seconds - int(seconds)
    second = f"{whole + rest:g}"
    day = "".join(f"{v:g}{u}" for v, u in ((years, "Y"), (months, "M"), (days, "D")) if v)
    time = "".join(f"{v}{u}" for v, u in ((hours, "H"), (minutes, "M")) if v) + (f"{second}S" if float(second) else "")
    return "P" + day + (f"T{time}" if time else "") if day or time else "P0D"


# --- JSON documents ------------------------------------------------------------------------------


def strict_json(text: str) -> str:
    """Canonical form of a JSON text; NaN and repeated keys are errors."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    strict_loads(text)
    return json.dumps(json.loads(text, object_pairs_hook=pairs), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def pointer_parts(pointer: str) -> list[str]:
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer starts with /")
    if re.search(r"~(?![01])", pointer):
        raise ValueError("escape")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def _step(node, key: str, append: bool = False):
    if isinstance(node, list):
        if append and key == "-":
            return len(node)
        if not re.fullmatch(r"0|[1-9][0-9]*", key) or int(key) > len(node) - (not append):
            raise IndexError(key)
        return int(key)
    if not isinstance(node, dict) or (not append and key not in node):
        raise KeyError(key)
    return key


def resolve_pointer(document: str, pointer: str) -> str:
    node = json.loads(document)
    for key in pointer_parts(pointer):
        node = node[_step(node, key)]
    return json.dumps(node, sort_keys=True)


def _patched(doc, operations: list[dict]):
    def parent(parts):
        node = doc
        for key in parts[:-1]:
            node = node[_step(node, key)]
        return node

    def get(path):
        node = doc
        for key in pointer_parts(path):
            node = node[_step(node, key)]
        return node

    def add(path, value):
        nonlocal doc
        parts = pointer_parts(path)
        if not parts:
            doc = value
            return
        node = parent(parts)
        key = _step(node, parts[-1], append=True)
        if isinstance(node, list):
            node.insert(key, value)
        else:
            node[key] = value

    def remove(path):
        nonlocal doc
        parts = pointer_parts(path)
        if not parts:
            old, doc = doc, None
            return old
        node = parent(parts)
        return node.pop(_step(node, parts[-1]))

    for op in operations:
        kind, path = op["op"], op["path"]
        if kind == "add":
            add(path, copy.deepcopy(op["value"]))
        elif kind == "remove":
            remove(path)
        elif kind == "replace":
            value = copy.deepcopy(op["value"])
            if pointer_parts(path):
                node = parent(pointer_parts(path))
                node[_step(node, pointer_parts(path)[-1])] = value
            else:
                doc = value
        elif kind == "move":
            if path != op["from"]:
                if path.startswith(op["from"] + "/"):
                    raise ValueError("into itself")
                add(path, remove(op["from"]))
        elif kind == "copy":
            add(path, copy.deepcopy(get(op["from"])))
        elif kind == "test":
            if json.dumps(get(path), sort_keys=True) != json.dumps(op["value"], sort_keys=True):
                raise ValueError("test failed")
        else:
            raise ValueError(f"operation {kind!r}")
    return doc


def apply_patch(document: str, patch: str) -> str:
    """The document after the operations, all or nothing."""
    return json.dumps(_patched(json.loads(document), json.loads(patch)), sort_keys=True)


def make_patch(before: str, after: str) -> str:
    """Operations that turn one document into the other."""
    out: list[dict] = []
    escape = lambda k: str(k).replace("~", "~0").replace("/", "~1")

    def walk(a, b, path):
        if isinstance(a, dict) and isinstance(b, dict):
            out.extend({"op": "remove", "path": f"{path}/{escape(k)}"} for k in a if k not in b)
            for k in b:
                if k in a:
                    walk(a[k], b[k], f"{path}/{escape(k)}")
                else:
                    out.append({"op": "add", "path": f"{path}/{escape(k)}", "value": b[k]})
        elif isinstance(a, list) and isinstance(b, list):
            n = min(len(a), len(b))
            for i in range(n):
                walk(a[i], b[i], f"{path}/{i}")
            out.extend({"op": "remove", "path": f"{path}/{i}"} for i in range(len(a) - 1, n - 1, -1))
            out.extend({"op": "add", "path": f"{path}/{i}", "value": b[i]} for i in range(n, len(b)))
        elif type(a) is not type(b) or a != b:
            out.append({"op": "replace", "path": path, "value": b})

    walk(json.loads(before), json.loads(after), "")
    return json.dumps(out)


# --- versions ------------------------------------------------------------------------------------

_VERSION = re.compile(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?")


def version_key(text: str) -> tuple:
    """Sort key by precedence; build data does not count."""
    m = _VERSION.fullmatch(text)
    if not m:
        raise ValueError(f"no version: {text!r}")
    pre = m[4].split(".") if m[4] else []
    if any(not p or (p.isdigit() and len(p) > 1 and p[0] == "0") for p in pre):
        raise ValueError("prerelease")
    order = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre)
    return (int(m[1]), int(m[2]), int(m[3]), not pre, order)


def compare_versions(a: str, b: str) -> int | None:
    """-1, 0 or 1 by precedence; None for versions that differ in nothing but build data."""
    x, y = version_key(a), version_key(b)
    return None if x == y and a != b else (x > y) - (x < y)


def coerce_version(text: str) -> str:
    """The nearest version: missing parts are 0, what follows the third number becomes build data."""
    m = re.match(r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", text)
    if not m:
        raise ValueError(f"no version: {text!r}")
    head = ".".join(str(int(g or 0)) for g in m.groups())
    rest = text[m.end() :]
    if not rest:
        return head
    if rest[0] == "-" or rest[0] == "+":
        return head + rest
    return head + "+" + re.sub(r"[^0-9A-Za-z.-]", "-", rest.lstrip("."))


def _bounds(op: str, parts: list[int | None], pre: str) -> list[tuple[str, tuple]]:
    """Comparisons that a clause stands for; an open part covers all its values."""
    known = [p for p in parts if p is not None]
    low = tuple((known + [0, 0, 0])[:3])
    bump = lambda k: tuple([*low[:k], low[k] + 1, 0, 0][:3])
    key = lambda t, p="": version_key(".".join(map(str, t)) + (f"-{p}" if p else ""))
    full = len(known) == 3
    if op in ("", "=", "=="):
        return [("==", key(low, pre))] if full else [(">=", key(low))] + ([("<", key(bump(len(known) - 1)))] if known else [])
    if op == "!=":
        return [("!=", key(low, pre))] if full else [("outside", (key(low), key(bump(len(known) - 1))))]
    if op in ("^", "~", "~="):
        k = next((i for i, p in enumerate(known) if p), len(known) - 1) if op == "^" else max(len(known) - 2, 0) if op == "~=" else min(1, len(known) - 1)
        own_release = pre and not any(low[k + 1 :])  # what follows a prerelease first is its own release
        return [(">=", key(low, pre)), ("<", key(low if own_release else bump(k)))]
    if full:
        return [(op, key(low, pre))]
    return {">": [(">=", key(bump(len(known) - 1)))], ">=": [(">=", key(low))], "<": [("<", key(low))], "<=": [("<", key(bump(len(known) - 1)))]}[op] if known else [(">=", key((0, 0, 0)))]


def _clause(text: str) -> list[tuple[str, tuple]]:
    m = re.fullmatch(r"(==?|!=|<=?|>=?|\^|~=?)?\s*v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", text.strip())
    if not m:
        raise ValueError(f"no clause: {text!r}")
    parts = [None if g is None or g in "xX*" else int(g) for g in m.groups()[1:4]]
    return _bounds(m[1] or "", parts, m[5] or "")


_TESTS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
          "outside": lambda a, b: a < b[0] or a >= b[1]}


def matches_spec(spec: str, version: str) -> bool:
    """Comma-separated clauses that all have to hold; a prerelease never satisfies an upper bound of its own release."""
    v = version_key(version)
    if not spec.strip():
        raise ValueError("empty specification")
    for block in spec.split(","):
        for op, bound in _clause(block) if block.strip() != "*" else []:
            if not _TESTS[op](v, bound) or (op == "<" and bound[3] and not v[3] and v[:3] == bound[:3]):
                return False
    return True


def matches_npm(spec: str, version: str) -> bool:
    """Alternatives by ||, clauses by blanks, hyphen ranges; prereleases only beside a clause of the same release."""
    v = version_key(version)
    for option in spec.split("||"):
        option = option.strip()
        if m := re.fullmatch(r"(\S+)\s+-\s+(\S+)", option):
            clauses = [_clause(">=" + m[1]), _clause("<=" + m[2])]
        else:
            option = re.sub(r"(==?|<=?|>=?|\^|~)\s+", r"\1", option)
            clauses = [_clause(c) for c in option.split()] if option not in ("", "*") else [[(">=", version_key("0.0.0"))]]
        tests = [t for c in clauses for t in c]
        if all(_TESTS[op](v, b) for op, b in tests) and (v[3] or any(op != "outside" and not b[3] and b[:3] == v[:3] for op, b in tests)):
            return True
    return False


# --- texts ---------------------------------------------------------------------------------------


def diff(a: str, b: str) -> list[tuple[int, str]]:
    """Shortest edit script by characters: (-1 removed, 0 kept, 1 added), neighbours of one kind joined."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    trace, v = [], {1: 0}
    n, m = len(x), len(y)
    found = False
    for d in range(n + m + 1):
        trace.append(dict(v))
        for k in range(-d, d + 1, 2):
            i = v[k + 1] if k == -d or (k != d and v[k - 1] < v[k + 1]) else v[k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            v[k] = i
            if i >= n and i - k >= m:
                found = True
                break
        if found:
            break
    steps: list[tuple[int, str]] = []
    i, j = n, m
    for d in range(len(trace) - 1, -1, -1):
        v, k = trace[d], i - j
        down = k == -d or (k != d and v[k - 1] < v[k + 1])
        pk = k + 1 if down else k - 1
        pi = v[pk] if d else 0
        pj = pi - pk if d else 0
        while i > pi and j > pj:
            i, j = i - 1, j - 1
            steps.append((0, x[i]))
        if d:
            if down:
                j -= 1
                steps.append((1, y[j]))
            else:
                i -= 1
                steps.append((-1, x[i]))
    out = [(0, a[:head])] + steps[::-1] + [(0, a[len(a) - tail :] if tail else "")]
    joined: list[tuple[int, str]] = []
    for kind, text in out:
        if text and joined and joined[-1][0] == kind:
            joined[-1] = (kind, joined[-1][1] + text)
        elif text:
            joined.append((kind, text))
    return joined


def diff_distance(a: str, b: str) -> int:
    """Edits of a diff, where a removal beside an addition counts as replacements."""
    total = added = removed = 0
    for kind, text in diff(a, b) + [(0, "")]:
        if kind > 0:
            added += len(text)
        elif kind < 0:
            removed += len(text)
        else:
            total += max(added, removed)
            added = removed = 0
    return total


def fuzzy_find(text: str, pattern: str, near: int, threshold: float = 0.5, distance: int = 1000) -> int:
    """Best place of a pattern about a place, by errors and remoteness; -1 if all are worse than the threshold."""
    if text == pattern:
        return 0
    if text[near : near + len(pattern)] == pattern:
        return near
    if not pattern:
        return -1
    near = max(0, min(near, len(text)))
    best, where = threshold, -1
    for start in range(-len(pattern) + 1, len(text)):
        piece = text[max(0, start) : max(0, start) + 2 * len(pattern)]
        least = abs(near - max(0, start)) / distance
        if least >= best and where >= 0 or least > best:
            continue
        row = list(range(len(pattern) + 1))
        fewest = row[-1]
        for c in piece:
            prev, row[0] = row[0], row[0] + 1
            for q, p in enumerate(pattern, 1):
                prev, row[q] = row[q], min(row[q] + 1, row[q - 1] + 1, prev + (c != p))
            fewest = min(fewest, row[-1])
        score = fewest / len(pattern) + least
        if score < best or (score <= best and where < 0):
            best, where = score, max(0, start)
    return where


def split_statements(sql: str) -> list[str]:
    """Statements of a script; semicolons in quotes, comments, dollar quotes, brackets and BEGIN blocks do not end one."""
    token = re.compile(r"(?m:^GO(?:[ \t]+\d+)?[ \t]*$)|--[^\n]*|/\*.*?(?:\*/|$)|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\$(\w*)\$.*?\$\1\$|[A-Za-z_]\w*|.", re.S)
    out, start, depth, create, block = [], 0, 0, False, 0
    for m in token.finditer(sql):
        t = m[0]
        word = t.upper()
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif word == "CREATE":
            create = True
        elif create and word in ("BEGIN", "CASE", "IF", "LOOP"):
            block += 1
        elif create and word == "END" and block:
            block -= 1
        elif (t == ";" and not depth and not block) or re.fullmatch(r"GO(?:\s+\d+)?\s*", t):
            end = re.compile(r"[ \t]*--[^\n]*|").match(sql, m.end()).end()  # a comment behind it belongs to it
            if m.start() >= start:
                out.append(sql[start:end].strip())
                start, create = end, False
    out.append(sql[start:].strip())
    return [s for s in out if s]


def detect_charset(data: bytes) -> str | None:
    """The encoding that explains the bytes best: byte order marks, UTF-8, then the most plausible of common ones."""
    for mark, name in ((b"\xef\xbb\xbf", "utf_8"), (b"\xff\xfe\x00\x00", "utf_32"), (b"\x00\x00\xfe\xff", "utf_32"), (b"\xff\xfe", "utf_16"), (b"\xfe\xff", "utf_16")):
        if data.startswith(mark):
            return name
    if not data or all(c < 0x80 for c in data):
        return "ascii" if data else "utf_8"
    best, best_score = None, None
    for name in ("utf_8", "shift_jis", "gb18030", "big5", "euc_kr", "cp1251", "koi8_r", "cp1252", "cp1250", "iso8859_7", "cp1256"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if name == "utf_8":
            return name
        odd = sum(not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()-–—«»„“”’/&%") for c in text)
        mixed = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))
        score = (odd + 2 * mixed) / max(1, len(text)) + 0.02 * len(text) / len(data)
        if best_score is None or score < best_score:
            best, best_score = name, score
    return best


# --- patch texts ---------------------------------------------------------------------------------

_CONTEXT = 4


def _encoded(text: str) -> str:
    from urllib.parse import quote

    return quote(text, safe=" !~*'();/?:@&=+$,#")


def make_patches(a: str, b: str) -> str:
    """Edits with up to four characters of context on either side, in the unidiff-like text form."""
    hunks: list[list] = []  # [start in a, start in b, parts]
    at_a = at_b = 0
    script = diff(a, b)
    for n, (kind, text) in enumerate(script):
        if kind == 0:
            if hunks and n + 1 < len(script) and len(text) <= 2 * _CONTEXT and hunks[-1][2][-1][0] != 0:
                hunks[-1][2].append((0, text))
            elif hunks and hunks[-1][2][-1][0] != 0:
                hunks[-1][2].append((0, text[:_CONTEXT]))
                hunks[-1].append("closed")
            at_a += len(text)
            at_b += len(text)
            continue
        if not hunks or hunks[-1][-1] == "closed":
            before = a[max(0, at_a - _CONTEXT) : at_a]
            hunks.append([at_a - len(before), at_b - len(before), [(0, before)] if before else []])
        hunks[-1][2].append((kind, text))
        at_a += len(text) * (kind < 0)
        at_b += len(text) * (kind > 0)
    out = []
    for start_a, start_b, parts, *_ in hunks:
        sizes = [sum(len(t) for k, t in parts if k != sign) for sign in (1, -1)]
        place = [f"{s},0" if n == 0 else str(s + 1) if n == 1 else f"{s + 1},{n}" for s, n in zip((start_a, start_b), sizes, strict=True)]
        out.append(f"@@ -{place[0]} +{place[1]} @@\n" + "".join("-  +"[k + 1 + (k > 0)] + _encoded(t) + "\n" for k, t in parts))
    return "".join(out)


def read_patches(text: str) -> list[tuple[int, list[tuple[int, str]]]]:
    """(start in the old text, edits) of each hunk; ValueError for a text that is no patch."""
    from urllib.parse import unquote

    out: list[tuple[int, list[tuple[int, str]]]] = []
    for line in text.split("\n"):
        if not line:
            continue
        if m := re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", line):
            out.append((int(m[1]) - (m[2] != "0"), []))
        elif not out:
            raise ValueError(f"Invalid patch string: {line}")
        elif line[0] in "-+ ":
            out[-1][1].append(({"-": -1, "+": 1, " ": 0}[line[0]], unquote(line[1:])))
        else:
            raise ValueError(f"Invalid patch mode: {line[0]!r}")
    return out


def apply_patches(text: str, patch: str) -> str:
    """The text after every hunk whose old passage is found, exactly or nearly, about where it should be."""
    shift = 0
    for start, parts in read_patches(patch):
        old, new = ("".join(t for k, t in parts if k != sign) for sign in (1, -1))
        at = fuzzy_find(text, old, start + shift) if old else min(start + shift, len(text))
        if at < 0:
            shift -= len(new) - len(old)
            continue
        found = text[at : at + len(old)]
        if found != old:  # carry the edits over to what stands there now
            new = _carried(found, old, parts)
        text = text[:at] + new + text[at + len(found) :]
        shift = at - start + len(new) - len(found)
    return text


def _carried(found: str, old: str, parts: list[tuple[int, str]]) -> str:
    place, i, j = [], 0, 0  # where each old position lies in the found passage
    for kind, t in diff(old, found):
        if kind <= 0:
            place += [j + (k if kind == 0 else 0) for k in range(len(t))]
            i += len(t)
        if kind >= 0:
            j += len(t)
    place.append(len(found))
    out, at, last = [], 0, 0
    for kind, t in parts:
        if kind == 1:
            out += [found[last : place[at]], t]
            last = max(last, place[at])
        elif kind == -1:
            out.append(found[last : place[at]])
            at += len(t)
            last = max(last, place[at])
        else:
            at += len(t)
    return "".join(out) + found[last:]


# --- a small language ----------------------------------------------------------------------------

_PRECEDENCE = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}
#: Names of the kinds of token in messages.
_TOKEN_NAMES = {"+": "PLUS", "-": "MINUS", "*": "STAR", "/": "SLASH", "(": "LPAREN", ")": "RPAREN", "=": "EQUALS", ";": "SEMICOLON", "\n": "SEMICOLON", "let": "LET", "": "EOF"}


class ProgramError(ValueError):
    pass


def _program_tokens(source: str) -> list[str]:
    out, at = [], 0
    word = re.compile(r"[ \t\r]+|[^\W\d]\w*|[\d.]+|[-+*/()=;\n]")
    while at < len(source):
        m = word.match(source, at)
        if not m:
            raise ProgramError(f"LexError: unknown token {source[at]!r} at position {at}")
        t = m[0]
        if t[0] in "0123456789." and (t.count(".") > 1 or t == "."):
            raise ProgramError(f"LexError: malformed number at position {at}")
        if t[0] not in " \t\r":
            out.append(t)
        at = m.end()
    return [*out, ""]


def _kind(t: str) -> str:
    return _TOKEN_NAMES.get(t) or ("NUMBER" if t[0] in "0123456789." else "IDENT")


def compile_program(source: str) -> list[tuple[str | None, list]]:
    """Statements as (name or None, postfix code). Operators wait on a stack until a weaker one comes."""
    t = _program_tokens(source)
    i, out = 0, []

    def expect(kind: str) -> str:
        nonlocal i
        if _kind(t[i]) != kind:
            raise ProgramError(f"ParseError: expected {kind}, got {_kind(t[i])} {t[i]!r}")
        i += 1
        return t[i - 1]

    def expression() -> list:
        nonlocal i
        code, waiting, depth = [], [], 0
        while True:
            while t[i] == "-":
                waiting.append("neg")
                i += 1
            if t[i] == "(":
                waiting.append("(")
                depth += 1
                i += 1
                continue
            if _kind(t[i]) not in ("NUMBER", "IDENT"):
                raise ProgramError(f"ParseError: unexpected token {t[i]!r}" if t[i] else "ParseError: unexpected end of input")
            code.append(float(t[i]) if _kind(t[i]) == "NUMBER" else ("get", t[i]))
            i += 1
            while t[i] == ")" and depth:
                while waiting[-1] != "(":
                    code.append(("do", waiting.pop()))
                waiting.pop()
                depth -= 1
                i += 1
            if t[i] not in ("+", "-", "*", "/") or not t[i]:
                break
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[t[i]]:
                code.append(("do", waiting.pop()))
            waiting.append(t[i])
            i += 1
        if depth:
            expect("RPAREN")
        return code + [("do", w) for w in reversed(waiting)]

    while t[i]:
        if t[i] in (";", "\n"):
            i += 1
            continue
        name = None
        if t[i] == "let":
            i += 1
            name = expect("IDENT")
            expect("EQUALS")
        out.append((name, expression()))
        if t[i] and t[i] not in (";", "\n"):
            raise ProgramError(f"ParseError: unexpected token {t[i]!r} after statement")
    return out


def run_program(source: str) -> dict:
    """{stdout, error}: the values of bare expressions, or the first error and no output."""
    env: dict[str, float] = {}
    shown = []
    try:
        for name, code in compile_program(source):
            stack: list[float] = []
            for step in code:
                if isinstance(step, float):
                    stack.append(step)
                elif step[0] == "get":
                    if step[1] not in env:
                        raise ProgramError(f"UndefinedVariable: variable {step[1]!r} is not defined")
                    stack.append(env[step[1]])
                elif step[1] == "neg":
                    stack.append(-stack.pop())
                else:
                    b, a = stack.pop(), stack.pop()
                    if step[1] == "/" and b == 0:
                        raise ProgramError("DivisionByZero: division by zero")
                    stack.append({"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else 0.0}[step[1]])
            if name is None:
                x = stack[0]
                shown.append(str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10f}".rstrip("0").rstrip("."))
            else:
                env[name] = stack[0]
    except ProgramError as e:
        return {"stdout": [], "error": str(e)}
    return {"stdout": shown, "error": None}
