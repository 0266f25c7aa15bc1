"""C translation phases 1 to 6: splices, comments, preprocessing tokens, conditionals, macro expansion.

No macro is defined beforehand and a local header is an empty file.  Of the standard headers only what
changes the syntax is known: the type names they declare and the macros that take types as arguments.
"""

from __future__ import annotations

import re

from lodegraph.llm.peg import SyntaxProblem

#: Type names by standard header.
HEADER_TYPES = {
    "stddef.h": "size_t ptrdiff_t wchar_t max_align_t",
    "stdio.h": "size_t FILE fpos_t va_list ssize_t off_t",
    "stdlib.h": "size_t wchar_t div_t ldiv_t lldiv_t",
    "string.h": "size_t",
    "time.h": "size_t time_t clock_t",
    "stdarg.h": "va_list",
    "stdbool.h": "bool",
    "setjmp.h": "jmp_buf",
    "signal.h": "sig_atomic_t",
    "wchar.h": "wchar_t wint_t mbstate_t size_t FILE va_list",
    "wctype.h": "wint_t wctrans_t wctype_t",
    "uchar.h": "char16_t char32_t mbstate_t size_t",
    "locale.h": "size_t",
    "fenv.h": "fenv_t fexcept_t",
    "math.h": "float_t double_t",
    "threads.h": "thrd_t mtx_t cnd_t tss_t once_flag thrd_start_t tss_dtor_t",
    "stdatomic.h": "atomic_bool atomic_char atomic_int atomic_uint atomic_long atomic_ulong atomic_size_t atomic_flag memory_order",
    "sys/types.h": "size_t ssize_t off_t pid_t uid_t gid_t mode_t time_t",
    "unistd.h": "size_t ssize_t off_t pid_t uid_t gid_t",
    "pthread.h": "pthread_t pthread_mutex_t pthread_cond_t pthread_attr_t",
    "complex.h": "",
}
_EXACT = " ".join(f"{u}int{k}{w}_t" for u in ("", "u") for k in ("", "_least", "_fast") for w in (8, 16, 32, 64)) + " intptr_t uintptr_t intmax_t uintmax_t"
HEADER_TYPES |= {"stdint.h": _EXACT, "inttypes.h": _EXACT + " imaxdiv_t"}
TYPE_MACROS = {"stddef.h": "offsetof", "stdarg.h": "va_arg", "stdio.h": "", "stdlib.h": ""}
HEADER_KEYWORDS = {
    "stdalign.h": {"alignas": "_Alignas", "alignof": "_Alignof"},
    "stdnoreturn.h": {"noreturn": "_Noreturn"},
    "assert.h": {"static_assert": "_Static_assert"},
    "threads.h": {"thread_local": "_Thread_local"},
    "complex.h": {"complex": "_Complex"},
}

_LEX = re.compile(
    r"(?P<blank>[ \t\f\v]+)|(?P<newline>\n)|(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<open>/\*)"
    r"|(?P<string>(?:u8|[LuU])?\"(?:[^\"\\\n]++|\\[^\n])*+\")|(?P<char>[LuU]?'(?:[^'\\\n]++|\\[^\n])++')"
    r"|(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<name>[^\W\d]\w*)"
    r"|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|\#\#|<:|:>|<%|%>|%:%:|%:|[-+*/%&|^~!<>=?:;,.(){}\[\]\#])|(?P<other>.)",
    re.S,
)
_DIGRAPH = {"<:": "[", ":>": "]", "<%": "{", "%>": "}", "%:": "#", "%:%:": "##"}
_INT = re.compile(r"(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9][0-9]*)(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?")
_FLOAT = re.compile(r"(?:[0-9]+[eE][+-]?[0-9]+|(?:[0-9]*\.[0-9]+|[0-9]+\.)(?:[eE][+-]?[0-9]+)?|0[xX](?:[0-9a-fA-F]*\.?[0-9a-fA-F]+|[0-9a-fA-F]+\.)[pP][+-]?[0-9]+)[fFlL]?")

Token = tuple[str, str, int]  # kind, text, offset


def valid_number(text: str) -> bool:
    return bool(_INT.fullmatch(text) or _FLOAT.fullmatch(text))


def lines(text: str) -> list[list[Token]]:
    """Logical lines of preprocessing tokens; a comment over several lines is one blank."""
    out: list[list[Token]] = [[]]
    at = 0
    while at < len(text):
        m = _LEX.match(text, at)
        kind = m.lastgroup
        if kind == "newline":
            out.append([])
        elif kind == "open":
            raise SyntaxProblem("unterminated comment", at)
        elif kind == "other":
            if m[0] in "\"'":  # to the end of the line; an error only where the line is not skipped
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                out[-1].append(("broken", m[0], at))
                at = end
                continue
            out[-1].append(("other", m[0], at))
        elif kind not in ("blank", "comment"):
            out[-1].append((kind, _DIGRAPH.get(m[0], m[0]) if kind == "op" else m[0], at))
        elif out[-1] and kind == "blank" or kind == "comment":
            out[-1].append(("blank", " ", at))
        at = m.end()
    return out


#: Precedence of the operators of an #if expression.
_PRECEDENCE = {op: k for k, ops in enumerate(["?", "|| ", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %"]) for op in ops.split()}
_UNARY, _TERNARY = 20, 0
_BINARY = {
    "||": lambda a, b: int(bool(a or b)), "&&": lambda a, b: int(bool(a and b)), "|": lambda a, b: a | b, "^": lambda a, b: a ^ b,
    "&": lambda a, b: a & b, "==": lambda a, b: int(a == b), "!=": lambda a, b: int(a != b), "<": lambda a, b: int(a < b),
    ">": lambda a, b: int(a > b), "<=": lambda a, b: int(a <= b), ">=": lambda a, b: int(a >= b), "<<": lambda a, b: a << (b & 63),
    ">>": lambda a, b: a >> (b & 63), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    # a division by zero is no question of syntax
    "/": lambda a, b: _quotient(a, b), "%": lambda a, b: a - b * _quotient(a, b),
}
_PREFIX = {"!": lambda v: int(not v), "-": lambda v: -v, "+": lambda v: v, "~": lambda v: ~v}


def _quotient(a: int, b: int) -> int:
    if not b:
        return 0
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def _wrapped(v: int) -> int:
    """As a signed number of 64 bits, so that values stay small."""
    return (v + 2**63) % 2**64 - 2**63


def condition(tokens: list[Token]) -> int:
    """Value of an #if expression: operator precedence with an explicit stack, so any nesting is read."""
    values: list[int] = []
    waiting: list[tuple[str, int]] = []  # (operator, precedence); "(" and "?" wait for ")" and ":"
    operand = True

    def fail(k: int):
        raise SyntaxProblem("#if expression", tokens[k][2] if k < len(tokens) else tokens[-1][2] if tokens else 0)

    def reduce(lowest: int) -> None:
        while waiting and waiting[-1][1] >= lowest and waiting[-1][0] not in ("(", "?"):
            op, level = waiting.pop()
            if level == _UNARY:
                values[-1] = _wrapped(_PREFIX[op](values[-1]))
            elif op == ":":
                c, a, b = values[-3:]
                values[-3:] = [a if c else b]
            else:
                right = values.pop()
                values[-1] = _wrapped(_BINARY[op](values[-1], right))

    for k, (kind, text, _) in enumerate(tokens):
        if operand:
            if kind == "op" and text in _PREFIX:
                waiting.append((text, _UNARY))
            elif kind == "op" and text == "(":
                waiting.append(("(", -1))
            else:
                values.append(_operand(kind, text, lambda k=k: fail(k)))
                operand = False
        elif kind == "op" and text == ")":
            reduce(-1)
            if not waiting or waiting.pop()[0] != "(":
                fail(k)
        elif kind == "op" and text == ":":
            reduce(-1)
            if not waiting or waiting.pop()[0] != "?":
                fail(k)
            waiting.append((":", _TERNARY))
            operand = True
        elif kind == "op" and text in _PRECEDENCE:
            level = _PRECEDENCE[text]
            reduce(level + 1 if text == "?" else level)
            waiting.append((text, level))
            operand = True
        else:
            fail(k)
    if operand:
        fail(len(tokens))
    reduce(-1)
    if waiting:
        fail(len(tokens))
    return values[0]


def _operand(kind: str, text: str, fail) -> int:
    if kind == "number":
        m = re.fullmatch(r"(0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+)[uUlL]*", text)
        if m and _INT.fullmatch(text):
            d = m[1]
            # digits beyond 64 bits change the value, not the syntax
            base = 16 if d[:2] in ("0x", "0X") else 2 if d[:2] in ("0b", "0B") else 8 if d[0] == "0" else 10
            return _wrapped(int(d[2:] if base in (2, 16) else d, base) if len(d) < 100 else 1)
    if kind == "char":
        return ord(text[-2])
    if kind == "name":
        return 0
    return fail()


#: Tokens that the macro calls of one text may collect and produce; doubling macros would have no end.
MAX_EXPANSION = 5_000_000


class Preprocessor:
    def __init__(self, text: str):
        self.text = text
        self.work = 0
        self.macros: dict[str, tuple[list[str] | None, bool, list[Token]]] = {}
        self.types: set[str] = set()
        self.type_macros: set[str] = set()
        self.keywords: dict[str, str] = {}
        self.out: list[Token] = []
        self.pending: list[Token] = []

    def run(self) -> list[Token]:
        stack: list[list] = []  # [active, a branch was taken, in #else, outer active]
        active = True
        for line in lines(self.text):
            first = next((k for k, t in enumerate(line) if t[0] != "blank"), None)
            if first is None:
                continue
            if line[first][1] == "#" and line[first][0] == "op":
                rest = [t for t in line[first + 1 :] if t[0] != "blank"]
                name = rest[0][1] if rest and rest[0][0] in ("name", "number") else ""
                at = line[first][2]
                if name in ("if", "ifdef", "ifndef"):
                    taken = active and self.test(name, rest, at)
                    stack.append([taken, taken, False, active])
                    active = taken
                elif name == "elif":
                    if not stack or stack[-1][2]:
                        raise SyntaxProblem("#elif without #if", at)
                    top = stack[-1]
                    if top[3] and not top[1]:
                        top[0] = top[1] = self.test("if", rest, at)
                    else:
                        top[0] = False
                    active = top[0]
                elif name == "else":
                    if not stack or stack[-1][2]:
                        raise SyntaxProblem("#else without #if", at)
                    top = stack[-1]
                    top[0], top[2] = top[3] and not top[1], True
                    active = top[0]
                elif name == "endif":
                    if not stack:
                        raise SyntaxProblem("#endif without #if", at)
                    active = stack.pop()[3]
                elif active and rest:
                    self.directive(name, line[first + 1 :], rest, at)
                continue
            if active:
                self.pending += line
                self.pending.append(("blank", " ", line[-1][2]))
        if stack:
            raise SyntaxProblem("#if without #endif", len(self.text))
        self.flush()
        return self.out

    def test(self, name: str, rest: list[Token], at: int) -> bool:
        self.flush()
        if name != "if":
            if len(rest) < 2 or rest[1][0] != "name":
                raise SyntaxProblem(f"#{name}", at)
            return (rest[1][1] in self.macros) == (name == "ifdef")
        given, k = [], 1
        while k < len(rest):
            if rest[k][1] == "defined":
                bracket = k + 1 < len(rest) and rest[k + 1][1] == "("
                n = k + 1 + bracket
                if n >= len(rest) or rest[n][0] != "name" or (bracket and (n + 1 >= len(rest) or rest[n + 1][1] != ")")):
                    raise SyntaxProblem("defined", at)
                given.append(("number", str(int(rest[n][1] in self.macros)), rest[n][2]))
                k = n + 1 + bracket
            else:
                given.append(rest[k])
                k += 1
        if not given:
            raise SyntaxProblem("#if with no expression", at)
        return condition([t for t in self.expand(given, frozenset()) if t[0] != "blank"]) != 0

    def directive(self, name: str, line: list[Token], rest: list[Token], at: int) -> None:
        if name == "define":
            self.flush()
            self.define(line, at)
        elif name == "undef":
            self.flush()
            if len(rest) != 2 or rest[1][0] != "name":
                raise SyntaxProblem("#undef", at)
            self.macros.pop(rest[1][1], None)
        elif name == "include":
            tail = [t for t in self.expand(rest[1:], frozenset()) if t[0] != "blank"]
            text = "".join(t[1] for t in tail)
            m = re.fullmatch(r'<([^>\n]+)>|"([^"\n]+)"', text)
            if not m:
                raise SyntaxProblem("#include", at)
            header = m[1] or m[2]
            self.types |= set(HEADER_TYPES.get(header, "").split())
            self.type_macros |= set(TYPE_MACROS.get(header, "").split())
            self.keywords |= HEADER_KEYWORDS.get(header, {})
        elif name not in ("pragma", "line", "error", "warning", "ident") and not name.isdigit():
            raise SyntaxProblem("directive", at)

    def define(self, line: list[Token], at: int) -> None:
        k = next((k for k, t in enumerate(line) if t[0] != "blank"), 0) + 1
        while k < len(line) and line[k][0] == "blank":
            k += 1
        if k >= len(line) or line[k][0] != "name" or line[k][1] == "defined":
            raise SyntaxProblem("#define", at)
        name, params, variadic = line[k][1], None, False
        k += 1
        if k < len(line) and line[k][1] == "(":
            params, expect = [], True
            k += 1
            while True:
                while k < len(line) and line[k][0] == "blank":
                    k += 1
                if k >= len(line):
                    raise SyntaxProblem("#define", at)
                kind, text, _ = line[k]
                k += 1
                if text == ")" and (not params or not expect):
                    break
                if expect and text == "..." and not variadic:
                    variadic, expect = True, False
                    params.append("__VA_ARGS__")
                elif expect and kind == "name" and text not in params and not variadic:
                    params.append(text)
                    expect = False
                elif text == "," and not expect and not variadic:
                    expect = True
                else:
                    raise SyntaxProblem("#define", at)
        body = line[k:]
        while body and body[0][0] == "blank":
            body = body[1:]
        while body and body[-1][0] == "blank":
            body = body[:-1]
        real = [t for t in body if t[0] != "blank"]
        if real and (real[0][1] == "##" or real[-1][1] == "##"):
            raise SyntaxProblem("##", at)
        self.macros[name] = (params, variadic, body)

    def flush(self) -> None:
        if self.pending:
            got = self.expand(self.pending, frozenset()) if self.macros else self.pending
            self.out += [t for t in got if t[0] != "blank"]
            self.pending = []

    def spend(self, n: int, at: int) -> None:
        self.work += n
        if self.work > MAX_EXPANSION:
            raise SyntaxProblem("macro expansion too large", at)

    def expand(self, tokens: list[Token], hidden: frozenset) -> list[Token]:
        out: list[Token] = []
        todo = [(t, hidden) for t in reversed(tokens)]
        while todo:
            t, hide = todo.pop()
            if t[0] != "name" or t[1] not in self.macros or t[1] in hide:
                out.append(t)
                continue
            params, variadic, body = self.macros[t[1]]
            if params is None:
                self.spend(len(body) + 1, t[2])
                todo += [((k, x, t[2]), hide | {t[1]}) for k, x, _ in reversed(self.paste(body))]
                continue
            k = len(todo) - 1
            while k >= 0 and todo[k][0][0] == "blank":
                k -= 1
            if k < 0 or todo[k][0][1] != "(":
                out.append(t)
                continue
            depth, args, k = 1, [[]], k - 1
            while k >= 0:
                u = todo[k][0]
                if u[1] == "(" and u[0] == "op":
                    depth += 1
                elif u[1] == ")" and u[0] == "op":
                    depth -= 1
                    if depth == 0:
                        break
                if u[1] == "," and u[0] == "op" and depth == 1 and not (variadic and len(args) == len(params)):
                    args.append([])
                else:
                    args[-1].append(u)
                k -= 1
            if k < 0:
                raise SyntaxProblem("unterminated macro call", t[2])
            self.spend(len(todo) - k + len(body), t[2])
            del todo[k:]
            if not params and len(args) == 1 and all(x[0] == "blank" for x in args[0]):
                args = []
            if variadic and len(args) == len(params) - 1:
                args.append([])
            if len(args) != len(params):
                raise SyntaxProblem("macro arguments", t[2])
            given = dict(zip(params, args, strict=True))
            got = self.substitute(body, given, hide)
            self.spend(len(got), t[2])
            todo += [((k2, x, t[2]), hide | {t[1]}) for k2, x, _ in reversed(got)]
        return out

    def substitute(self, body: list[Token], given: dict[str, list[Token]], hide: frozenset) -> list[Token]:
        out: list[Token] = []
        real = [t for t in body if t[0] != "blank"] if any(t[1] in ("#", "##") for t in body) else body
        for k, t in enumerate(real):
            if t[1] == "#" and t[0] == "op" and k + 1 < len(real) and real[k + 1][1] in given:
                continue
            if t[0] == "name" and t[1] in given:
                arg = given[t[1]]
                if k and real[k - 1][1] == "#":
                    out.append(("string", '"x"', t[2]))
                elif (k and real[k - 1][1] == "##") or (k + 1 < len(real) and real[k + 1][1] == "##"):
                    part = [a for a in arg if a[0] != "blank"]
                    out += part or [("placemarker", "", t[2])]
                else:
                    out += self.expand(arg, hide)
            else:
                out.append(t)
        return self.paste(out)

    @staticmethod
    def paste(body: list[Token]) -> list[Token]:
        if not any(t[1] == "##" for t in body):
            return [t for t in body if t[0] != "placemarker"]
        body = [t for t in body if t[0] != "blank"]
        out: list[Token] = []
        k = 0
        while k < len(body):
            if body[k][1] == "##" and out and k + 1 < len(body):
                text = out[-1][1] + body[k + 1][1]
                m = _LEX.fullmatch(text) if text else None
                out[-1] = (m.lastgroup if m else "placemarker" if not text else "other", text, out[-1][2])
                k += 2
            else:
                out.append(body[k])
                k += 1
        return [t for t in out if t[0] != "placemarker"]
