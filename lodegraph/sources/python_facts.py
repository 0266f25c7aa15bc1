"""Facts of Python source: entities, edges, weak calls and dynamic sites, file by file.

One pass of ``mapInArrow`` over (graph_name, source_file, content); what a file alone cannot decide
(titles in other files, unique bare names) is left to the joins of ``operators.construct``.  Files that
do not parse give no facts.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.operators.construct import CONFIDENCE

FACT_SCHEMA = (
    "graph_name string, source_file string, record string, type string, source string, target string, first int, last int,"
    " confidence double, is_deterministic boolean, detail string"
)
_NAMES = [f.split()[0] for f in FACT_SCHEMA.split(", ")]

#: Calls that make a name or a target at run time, by the name that is called.
DYNAMIC_CALLS = {
    "getattr": "getattr_dynamic", "setattr": "setattr_dynamic", "hasattr": "hasattr_dynamic", "delattr": "delattr_dynamic", "eval": "eval", "exec": "exec",
    "__import__": "dunder_import", "import_module": "import_module", "globals": "globals_access", "locals": "locals_access", "vars": "vars_access",
    "methodcaller": "methodcaller", "attrgetter": "attrgetter", "partial": "partial_call",
}
_CONTAINER_METHODS = frozenset("append extend insert pop remove clear sort reverse get items keys values update setdefault add discard join split strip format".split())
_OPERATORS = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__", ast.FloorDiv: "__floordiv__", ast.Pow: "__pow__"}
_COMPARES = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.Gt: "__gt__", ast.LtE: "__le__", ast.GtE: "__ge__"}


def annotation_types(node: ast.expr | None) -> list[str]:
    """Class names an annotation allows; containers stand for themselves, None does not count."""
    if node is None:
        return []
    if isinstance(node, ast.Constant):
        if isinstance(node.value, str):
            try:
                return annotation_types(ast.parse(node.value, mode="eval").body)
            except SyntaxError:
                return []
        return []
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Attribute):
        return [ast.unparse(node)]
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return annotation_types(node.left) + annotation_types(node.right)
    if isinstance(node, ast.Subscript):
        head = annotation_types(node.value)
        if head and head[0].split(".")[-1] in ("Optional", "Union", "Annotated", "Final", "ClassVar"):
            inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            if head[0].split(".")[-1] == "Annotated":
                inner = inner[:1]
            return [t for n in inner for t in annotation_types(n)]
        return head
    return []


class _Scan(ast.NodeVisitor):
    def __init__(self, module: str, tree: ast.Module, file_name: str):
        self.module, self.rows = module, []
        self.imports: dict[str, str] = {}
        self.defs: dict[str, str] = {}
        self.classes: dict[str, ast.ClassDef] = {}
        self.methods: dict[str, set[str]] = {}
        self.data: set[str] = set()
        self.registries: dict[str, list[tuple[str, str]]] = {}
        self.scope: list[str] = []
        self.owner: list[str] = []
        self.types: list[dict[str, list[tuple[int, str | None]]]] = [{}]
        self.seen: set[tuple] = set()
        end = max([getattr(n, "end_lineno", 1) or 1 for n in ast.walk(tree)] + [1])
        self.title = f"{module}:__module__"
        self.row("entity", "file", file_name, None, 1, end)
        self.row("entity", "module", self.title, None, 1, end)
        self.row("edge", "contains", file_name, self.title, 1, end, "structural", True)
        self.collect(tree.body, "")
        self.where = self.title
        self.visit(tree)

    def row(self, record, kind, source, target, first, last, tier=None, sure=None, detail=None):
        key = (record, kind, source, target, first, detail)
        if key not in self.seen:
            self.seen.add(key)
            self.rows.append((record, kind, source, target, first, last, CONFIDENCE.get(tier), sure, detail))

    def full(self, name: str) -> str:
        return f"{self.module}:{name}"

    def collect(self, body, prefix):
        """Definitions first, so that uses before them resolve."""
        for n in body:
            if isinstance(n, ast.ClassDef):
                name = prefix + n.name
                self.classes[name] = n
                self.defs[name] = "class"
                self.methods[name] = {m.name for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
                self.collect(n.body, name + ".")
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.defs[prefix + n.name] = "method" if prefix else "fn"
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                base = "." * getattr(n, "level", 0) + (getattr(n, "module", "") or "") if isinstance(n, ast.ImportFrom) else ""
                for a in n.names:
                    if isinstance(n, ast.Import):
                        self.imports[a.asname or a.name.split(".")[0]] = a.name
                    elif a.name != "*":
                        self.imports[a.asname or a.name] = f"{base}:{a.name}"
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and not prefix:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        self.data.add(t.id)
                        if isinstance(n.value, ast.Dict) and n.value.values and all(isinstance(v, (ast.Name, ast.Lambda, ast.Call)) for v in n.value.values):
                            self.registries[t.id] = [(k.value, v.id) for k, v in zip(n.value.keys, n.value.values) if isinstance(k, ast.Constant) and isinstance(v, ast.Name)]

    # definitions
    def define(self, node, kind):
        name = ".".join([*self.scope, node.name])
        parent = self.full(".".join(self.scope)) if self.scope else self.title
        first = min([d.lineno for d in node.decorator_list] + [node.lineno])
        self.row("entity", kind, self.full(name), None, first, node.end_lineno)
        self.row("edge", "contains", parent, self.full(name), node.lineno, node.end_lineno, "structural", True)
        return name

    def visit_ClassDef(self, node):
        name = self.define(node, "class")
        for base in node.bases:
            b = ast.unparse(base)
            if b in self.classes:
                self.row("edge", "inherits", self.full(name), self.full(b), node.lineno, node.lineno, "inherits", True)
                for m in sorted(self.methods[b] - self.methods.get(name, set())):
                    self.row("edge", "inherits", self.full(f"{name}.{m}"), self.full(f"{b}.{m}"), node.lineno, node.lineno, "inherits", True, "member")
        self.decorators(node, name)
        self.scope.append(node.name)
        self.owner.append(name)
        where, self.where = self.where, self.full(name)
        for n in node.body:
            self.visit(n)
        self.where = where
        self.owner.pop()
        self.scope.pop()

    def visit_FunctionDef(self, node):
        inside_class = bool(self.owner) and len(self.scope) == len(self.owner[-1].split("."))
        nested = bool(self.scope) and not inside_class
        name = ".".join([*self.scope, node.name])
        if not nested:
            self.define(node, "method" if inside_class else "fn")
        if node.name == "__getattr__":
            self.row("site", "def_getattr", self.where, name, node.lineno, node.end_lineno, detail="def_getattr")
        self.decorators(node, name)
        if any(isinstance(d, ast.Name) and d.id == "property" for d in node.decorator_list) and self.owner:
            self.row("edge", "property", self.full(self.owner[-1]), self.full(name), node.lineno, node.end_lineno, "property", True)
        self.types.append({})
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            kinds = annotation_types(a.annotation)
            for k in kinds:
                self.types[-1].setdefault(a.arg, []).append((node.lineno, k))
        where = self.where
        if not nested:
            self.where = self.full(name)
            self.scope.append(node.name)
        for n in node.body:
            self.visit(n)
        if not nested:
            self.scope.pop()
        self.where = where
        self.types.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def decorators(self, node, name):
        for d in node.decorator_list:
            f = d.func if isinstance(d, ast.Call) else d
            if isinstance(f, ast.Attribute) and f.attr in ("register", "route", "command", "add"):
                self.row("site", "decorator_registration", self.where, name, node.lineno, node.end_lineno, detail=f"decorator_registration:{ast.unparse(f.value)}")

    # imports and data
    def visit_Import(self, node):
        for a in node.names:
            self.row("edge", "imports", self.title, a.name, node.lineno, node.lineno, "typed_call", True)

    def visit_ImportFrom(self, node):
        self.row("edge", "imports", self.title, "." * node.level + (node.module or ""), node.lineno, node.lineno, "typed_call", True)

    def note(self, target, value, line):
        if isinstance(target, ast.Name):
            kind = None
            if isinstance(value, ast.Call):
                f = ast.unparse(value.func)
                kind = f if f in self.classes or f in self.imports else f.rsplit(".", 1)[0] if f.rsplit(".", 1)[0] in self.classes else None
            elif isinstance(value, (ast.List, ast.Dict, ast.Set, ast.Tuple, ast.ListComp, ast.DictComp)):
                kind = "builtin container"
            self.types[-1].setdefault(target.id, []).append((line, kind))

    def visit_Assign(self, node):
        for t in node.targets:
            self.note(t, node.value, node.lineno)
            if not self.scope and isinstance(t, ast.Name):
                self.row("entity", "data", self.full(t.id), None, node.lineno, node.end_lineno)
                self.row("edge", "contains", self.title, self.full(t.id), node.lineno, node.end_lineno, "structural", True)
                for n in ast.walk(node.value):
                    if isinstance(n, ast.Name) and n.id != t.id and (n.id in self.defs or n.id in self.data):
                        self.row("edge", "references", self.full(t.id), self.full(n.id), n.lineno, n.lineno, "reference", True)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name):
            for k in annotation_types(node.annotation) or [None]:
                self.types[-1].setdefault(node.target.id, []).append((node.lineno, k))
            if not self.scope:
                self.row("entity", "data", self.full(node.target.id), None, node.lineno, node.end_lineno)
        self.generic_visit(node)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load) and node.id in self.data and self.scope:
            self.row("edge", "uses_data", self.where, self.full(node.id), node.lineno, node.lineno, "data", True)

    # calls
    def call(self, target, line, tier, sure, detail=None):
        self.row("edge", "calls", self.where, target, line, line, tier, sure, detail)

    def weak(self, display, line, reason, tier):
        self.row("observation", "calls", self.where, display, line, line, tier, False, reason)

    def receiver(self, name, line):
        """What is known of a local name at a line: (types, some unknown, last known)."""
        facts = [(at, k) for scope in self.types for at, k in scope.get(name, []) if at <= line]
        kinds = sorted({k for _, k in facts if k})
        return kinds, any(k is None for _, k in facts), max(facts, key=lambda f: f[0], default=(0, None))[1]

    def visit_Call(self, node):
        f, line = node.func, node.lineno
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name in DYNAMIC_CALLS:
            constant = len(node.args) > 1 and isinstance(node.args[1], ast.Constant) and name.endswith("attr")
            if not constant:
                self.row("site", DYNAMIC_CALLS[name], self.where, None, line, node.end_lineno, detail=DYNAMIC_CALLS[name])
        if isinstance(f, ast.Name):
            if f.id in self.classes:
                self.call(self.full(f"{f.id}.__init__") if "__init__" in self.methods[f.id] else self.full(f.id), line, "typed_call", True, "constructor")
            elif f.id in self.defs:
                self.call(self.full(f.id), line, "local_name", False)
            elif f.id in self.imports:
                self.call(self.imports[f.id], line, "imported_name", False)
        elif isinstance(f, ast.Attribute):
            self.attribute_call(node, f, line)
        elif isinstance(f, ast.Subscript):
            table = ast.unparse(f.value)
            self.row("site", "call_through_subscript", self.where, None, line, node.end_lineno, detail=f"registry_lookup:{table}")
            for _, value in self.registries.get(table, []):
                self.row("candidate", "calls", self.where, self.full(value), line, line, "candidate", False, table)
        elif isinstance(f, ast.Call):
            inner = f.func.id if isinstance(f.func, ast.Name) else f.func.attr if isinstance(f.func, ast.Attribute) else ""
            if inner == "getattr":
                self.row("site", "call_through_getattr", self.where, None, line, node.end_lineno, detail="call_through_getattr")
            elif inner == "get":
                self.row("site", "call_through_dict_get", self.where, None, line, node.end_lineno, detail="call_through_dict_get")
        self.generic_visit(node)

    def attribute_call(self, node, f, line):
        base, attr, display = f.value, f.attr, ast.unparse(f)
        owner = self.owner[-1] if self.owner else None
        if isinstance(base, ast.Call):
            ctor = ast.unparse(base.func)
            if ctor == "super" and owner:
                for b in self.classes[owner].bases:
                    name = ast.unparse(b)
                    if attr in self.methods.get(name, ()):
                        self.call(self.full(f"{name}.{attr}"), line, "super_init", False, "super")
                        break
            elif ctor in self.classes and attr in self.methods[ctor]:
                self.call(self.full(f"{ctor}.{attr}"), line, "typed_call", True, "chained constructor")
            return
        if not isinstance(base, ast.Name):
            return
        if base.id in ("self", "cls") and owner:
            if attr in self.methods[owner]:
                self.call(self.full(f"{owner}.{attr}"), line, "typed_call", True, "self")
            else:
                self.weak(display, line, "unresolved receiver", "weak")
        elif base.id in self.classes:
            if attr in self.methods[base.id]:
                self.call(self.full(f"{base.id}.{attr}"), line, "typed_call", True, "class")
        elif base.id in self.imports:
            self.call(f"{self.imports[base.id].replace(':', '.')}:{attr}", line, "import_hint", True, "import")
        else:
            kinds, unknown, last = self.receiver(base.id, line)
            if "builtin container" in kinds or (not kinds and attr in _CONTAINER_METHODS):
                self.weak(display, line, "builtin/container call observation", "weak")
            elif len(kinds) == 1 and unknown:
                self.weak(display, line, "guarded by reassignment", "ambiguous")
            elif len(kinds) == 1 and last in self.classes and attr in self.methods[last]:
                self.call(self.full(f"{last}.{attr}"), line, "typed_call", True, "typed receiver")
            elif len(kinds) > 1:
                self.weak(display, line, "ambiguous constructors", "ambiguous")
            else:
                self.weak(display, line, "unresolved receiver", "weak")

    def visit_BinOp(self, node):
        self.operator(node.left, _OPERATORS.get(type(node.op)), node.lineno)
        self.generic_visit(node)

    def visit_Compare(self, node):
        self.operator(node.left, _COMPARES.get(type(node.ops[0])), node.lineno)
        self.generic_visit(node)

    def operator(self, left, member, line):
        if member and isinstance(left, ast.Name):
            kinds, unknown, last = self.receiver(left.id, line)
            if len(kinds) == 1 and not unknown and last in self.classes and member in self.methods[last]:
                self.call(self.full(f"{last}.{member}"), line, "typed_call", True, "operator")


def module_of(source_file: str) -> str:
    stem = source_file.rsplit("/", 1)[-1]
    return stem[:-3] if stem.endswith(".py") else stem


def facts_of(text: str, source_file: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return _Scan(module_of(source_file), tree, source_file.rsplit("/", 1)[-1]).rows


def python_facts(files: DataFrame) -> DataFrame:
    """``files``: graph_name, source_file, content. One row per fact: see FACT_SCHEMA."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.float64(), pa.bool_(), pa.string()]
        for b in batches:
            rows = [(g, f, *r) for g, f, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in facts_of(t, f)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

    source = files.where("content is not null and source_file like '%.py'").select("graph_name", "source_file", "content").distinct()
    return source.mapInArrow(scan, FACT_SCHEMA)
