import ast
import json
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import syntax as sx
from lodegraph.llm.peg import Grammar

warnings.simplefilter("ignore")

GOOD_PY = [
    "", "# only a comment", "x = 1\n", "if a:\n\tb\n", "def f(a, /, b=1, *c, d, e=2, **g): pass\n", "lambda *a, **k: (yield)\n", "f'{x!r:>{w}} {{}}'\n", "f'''{\nx\n}'''\n",
    "match x:\n  case [1, *_, {'a': b, **r}] | C(y=2) if z: pass\n  case _: pass\n", "type X[T: int, *U, **P] = list[T]\n", "async def f():\n  async with a as b, c: await d\n",
    "with (open(a) as b, c as d,): pass\n", "try: pass\nexcept* E as e: pass\n", "x: int = yield\n", "a = b = *c, d\n", "print(*a, k=1, **b)\n", "a[1:2, ::3, *b]\n", "return\n",
    "match = 1\nmatch.case(match)\n", "x = 0xFF_FF + 1_0.e5j + 0o7\n", "'\\N{BULLET}' b'\\x00'[0]\n".replace(" b", "; b"), "if x:\n  y\r\n  z\n", "\\\nx\n", "for x, *y in z: break\nelse: continue\n",
]
BAD_PY = [
    "x =", "def f(:", "if a:\nb", "  x", "f(a for b in c, d)", "f(**k, *a)", "None = 1", "x = 08", "'abc", "f'{'", "f'{a!z}'", "b'é'", "'a' b'b'", "'\\x1'", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b",
    "print 'x'", "def f(a=1, b): pass", "a + not b", "x = (1,\n", "if x:\n\ty\n        z", "del f()", "a = 1 2", "import a.b as c.d", "class C(: pass", "\0", "1a", "x = $", "try: pass", "else: pass",
]


@pytest.mark.parametrize("text", GOOD_PY + BAD_PY)
def test_python_agrees_with_the_language(text):
    try:
        ast.parse(text)
        want = True
    except (SyntaxError, ValueError):
        want = False
    assert sx.parses(text, "python") == want == (text in GOOD_PY)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["x", "(", ")", "[", "]", ":", ",", "=", " ", "\n", "\n  ", "if ", "else", "def f", "1", "'", "f'", "{", "}", "*", "not ", "in ", "lambda ", "for ", "yield", ".", "@", "#", "\\\n"]), max_size=14).map("".join))
def test_python_on_fragments(text):
    try:
        ast.parse(text)
        want = True
    except (SyntaxError, ValueError):
        want = False
    assert sx.parses(text, "python") == want


GOOD_C = [
    "", "int x;", "int f(void) { return 0; }", "typedef int (*fp)(const char *, int); fp g;", "#include <stddef.h>\nsize_t n = sizeof(size_t);", "struct s { int a : 3; union { int b; } u; };",
    "#define M(a, b) a##b\nint M(x, y) = 1;", "#if 0\n  broken ( {\n'\n#endif\nint y;", "int a[] = { [2] = 1, 3, };", "void f(int n) { for (int i = 0; i < n; ++i) { if (i) continue; else break; } }",
    "/* <<<<<<< HEAD\n======= */ int z;", "enum e { A, B = 2, };", "int f(a, b) int a, b; { return a; }", "#ifdef X\nint f(\n#else\nint g(\n#endif\nvoid);", "char *s = \"a\" \"b\\\"\";", "_Static_assert(1, \"x\");",
    "typedef struct t t; struct t { t *next; };", "void f(void) { l: ; goto l; }", "int x = (int){ 1 };", "#include <stdarg.h>\nvoid f(int n, ...) { va_list a; int k = va_arg(a, int); }", "int f(void)\r\n{ return 'a'; }\r\n",
    "#define EMPTY\nEMPTY int q EMPTY;", "int a = 1 ? 2 : 3, *b, c[3][4];", "void f(int (*cb)(int), int v[static 2]) { cb(v[0]); }",
]
BAD_C = [
    "int", "int f( {", "int x = ;", "struct s { int a }", "#if 1\nint x;", "#endif", "/* open", "int s = \"open;", "<<<<<<< HEAD\nint x;", "int f(void) { return 0;", "x y z;", "def f(): pass", "int 1x;", "#bogus\nint x;",
    "void f(void) { if x; }", "int a = 08;", "# Notes\n\nSome text", "foo bar;", "void f(void) { case: ; }", "int f(void) { return 0 }", "#define\nint x;", "#if (\nint x;\n#endif", "{\"a\": 1}",
]


@pytest.mark.parametrize("text", GOOD_C + BAD_C)
def test_c(text):
    assert sx.parses(text, "c") == (text in GOOD_C)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]",:1-.e0 ntrufalse\\\n', max_size=16))
def test_json_agrees_with_the_standard(text):
    try:
        json.loads(text, parse_constant=lambda c: int("x"))
        want = True
    except ValueError:
        want = False
    assert sx.parses(text, "json") == want


def test_deep_nesting_is_parsed_whole():
    assert sx.parses("[" * 50_000 + "]" * 50_000, "json") and not sx.parses("[" * 50_000 + "]" * 49_999, "json")
    assert sx.parses("int x = " + "(" * 5000 + "1" + ")" * 5000 + ";", "c")


def test_causes_and_positions():
    assert sx.judge("x = 1\n<<<<<<< ours\ny\n=======\nz\n>>>>>>> b\n", "python")[::3] == (2, "merge_conflict")
    assert sx.judge("def f():\n    return (1,\n", "python")[3] == "truncated"
    assert sx.judge('{"a": 1}', "c")[3] == "other_language"
    assert sx.judge("int f(void) { return 0 }", "c") == (1, 24, "}", "other")
    assert sx.judge("int f(void) {\n  return 0;\n", "c")[3] == "truncated"
    assert sx.judge("x = 1\n", "python") is None


FILES = "graph_name string, source_file string, lang string, content string, valid boolean, language string"
ENTS = "graph_name string, source_file string, type string"


def test_found_and_rates(spark, rows):
    data = [
        ("g", "a.py", "python", "x =", None, None), ("g", "a.py", "c", "x =", None, None), ("g", "b.py", None, "", None, None), ("g", "c.json", None, "", None, None), ("g", "d.c", "json", "int x;", None, None),
        ("g", "e.H", None, "int x", None, None), ("g", "f.py", None, None, None, None), ("g", "notes.txt", None, "(", None, None), ("g", "unlisted.py", None, "(", None, None), ("h", "b.py", None, "(", None, None), (None, "a.py", None, "(", None, None),
    ]
    named = [("g", f, "file") for f in ("a.py", "b.py", "c.json", "d.c", "e.H", "f.py", "notes.txt")] * 2 + [("g", "unlisted.py", "fn"), ("h", None, "file")]
    files, entities = spark.createDataFrame(data, FILES), spark.createDataFrame(named, ENTS)
    assert rows(sx.invalid_files(entities, files)) == [("g", "a.py"), ("g", "c.json"), ("g", "e.H")]
    rates = {(r["graph_name"], r["language"]): (r["n_files"], r["n_invalid"]) for r in sx.syntax_rates(sx.listed_verdicts(entities, files)).collect()}
    assert rates == {("g", "python"): (2, 1), ("g", "json"): (1, 1), ("g", "c"): (2, 1)}
    assert rows(sx.invalid_files(entities.limit(0), files)) == [] == rows(sx.invalid_files(entities, files.limit(0)))


def test_grammar_operators():
    g = Grammar("s <- a* ('x' / 'y')? !'z' &EOF EOF  a <- 'a' 'b'+", "s")
    ok = lambda t: g.accepts([*t, "EOF"], [*t, ""])
    assert ok("") and ok("abbab") and ok("abx") and not ok("a") and not ok("abz") and not ok("xy")
    assert g.furthest([*"abbq", "EOF"], [*"abbq", ""]) == 3


@pytest.mark.parametrize("text, language", [(t, "python") for t in GOOD_PY + BAD_PY] + [(t, "c") for t in GOOD_C + BAD_C] + [(t, "json") for t in ("[1, {}]", "[1,", "{\"a\": [true, null]}", "[[[}", "")])
def test_the_machine_agrees_with_the_functions(text, language):
    module = sx._module(language)
    try:
        kinds, texts, _ = module.tokens(text)
    except sx.SyntaxProblem:
        return
    end, far = module.GRAMMAR.run_machine(kinds, texts)
    assert (end == len(kinds)) == module.GRAMMAR.accepts(kinds, texts)
    if end != len(kinds):
        assert min(far, len(kinds) - 1) == module.GRAMMAR.furthest(kinds, texts)


@pytest.mark.parametrize("depth", [300_000])
def test_hostile_nesting_gets_a_verdict(depth):
    assert sx.judge("[" * depth + "]" * depth, "json") is None
    assert sx.judge("[" * depth, "json") == (1, depth + 1, "EOF", "truncated")
    assert sx.judge("void f(void) {" + "{" * depth + "}" * depth + "}", "c") is None
    assert sx.judge("#if " + "(" * depth + "1" + ")" * depth + "\nint x;\n#endif\n", "c") is None
    assert sx.judge("int x = " + "-" * 5 + "(" * 60_000 + "1" + ")" * 59_999 + ";", "c")[3] == "other"
    assert sx.judge("x = " + "not " * depth + "y", "python") is None
    assert sx.judge("x = " + "(" * depth + "y" + ")" * depth, "python")[2] == "nesting too deep"


def test_macros_without_end_get_a_verdict():
    doubling = "#define A0 1 1\n" + "".join(f"#define A{i} A{i - 1} A{i - 1}\n" for i in range(1, 60)) + "int x = A59;\n"
    assert sx.judge(doubling, "c")[2] == "macro expansion too large"
    nested = "#define M(x) x\nint x = " + "M(" * 20_000 + "1" + ")" * 20_000 + ";"
    assert sx.judge(nested, "c")[2] == "macro expansion too large"
    assert sx.judge("#define M(x) x\nint x = " + "M(" * 300 + "1" + ")" * 300 + ";", "c") is None


NUMBERS = st.sampled_from(["0", "1", "2", "7", "0x10", "010"])
EXPRESSIONS = st.recursive(
    NUMBERS,
    lambda e: st.one_of(
        st.builds("({} {} {})".format, e, st.sampled_from("+ - * < > == && || & | ^ <<".split()), e),
        st.builds("{}{}".format, st.sampled_from("!~-+"), e.map(lambda x: f"({x})")),
        st.builds("({} ? {} : {})".format, e, e, e),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(EXPRESSIONS)
def test_if_expressions(text):
    from lodegraph.llm.grammars.c_preprocess import condition, lines

    def value(t):
        t = t.strip()
        if not t.startswith("(") and t[0] not in "!~-+":
            return int(t, 8) if len(t) > 1 and t.isdigit() else int(t, 0)
        if t[0] != "(":
            v = value(t[1:])
            return {"!": int(not v), "~": ~v, "-": -v, "+": v}[t[0]]
        inner, depth, parts, last = t[1:-1], 0, [], 0
        if depth == 0 and _whole(inner):
            return value(inner)
        for k, c in enumerate(inner):
            depth += (c == "(") - (c == ")")
            if depth == 0 and c == " ":
                parts.append(inner[last:k])
                last = k + 1
        parts.append(inner[last:])
        if len(parts) == 1:
            return value(parts[0])
        if len(parts) == 5:
            return value(parts[2]) if value(parts[0]) else value(parts[4])
        a, op, b = value(parts[0]), parts[1], value(parts[2])
        if op in ("&&", "||"):
            return int(bool(a and b) if op == "&&" else bool(a or b))
        return int(eval(f"a {op} (b & 63)" if op == "<<" else f"a {op} b"))

    got = condition([t for t in lines(text)[0] if t[0] != "blank"])
    assert got == (value(text) + 2**63) % 2**64 - 2**63


def _whole(t):
    depth = 0
    for k, c in enumerate(t):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return k == len(t) - 1
    return False


@pytest.mark.parametrize("text, value", [("1 + 2 * 3", 7), ("1 - 2 - 3", -4), ("1 ? 2 : 0 ? 3 : 4", 2), ("0 ? 2 : 1 ? 3 : 4", 3), ("1 || 0 && 0", 1), ("- 7 / 2", -3), ("-7 % 3", -1), ("5 / 0", 0), ("'a' == 97", 1), ("!x", 1), ("~0 == -1", 1)])
def test_if_precedence(text, value):
    from lodegraph.llm.grammars.c_preprocess import condition, lines

    assert condition([t for t in lines(text)[0] if t[0] != "blank"]) == value


@pytest.mark.parametrize("text", ["", "(", "1 +", "1 2", ")", "1 ? 2", "1 : 2", "(1", "1)", "? 1 : 2", "1.5", "* 2", "\"a\""])
def test_if_refusals(text):
    assert not sx.parses(f"#if {text}\nint x;\n#endif\n", "c")
