"""Packrat parsing: grammars of parsing expressions, compiled to recognisers over token lists.

Grammar text, one rule per ``name <- expression``:

    'x'      a token whose kind is x          "x"    a NAME token spelled x
    KIND     any token of that kind           rule   another rule
    a b      sequence      a / b   ordered choice    ( )  group
    e? e* e+ repetition    &e !e   look-ahead

Every rule is memoised per position, so parsing is linear in the number of tokens.  Alternatives are
entered only if the next token can start them; this does not change the language.  A recogniser must
consume the whole input.  ``furthest`` parses again with a recogniser that records the last position at
which a token was tested and did not fit, the usual error position of such parsers.

Each grammar is compiled twice: to nested Python functions, which are fast, and to instructions of a small
parsing machine whose stack and memo tables are flat arrays of numbers.  A text nested more deeply than
``MAX_FRAMES`` calls goes to the machine, which has no depth limit; both accept the same texts.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Nested calls of the compiled functions, beyond which the machine takes over.
MAX_FRAMES = 50_000

_TOKEN = re.compile(r"""\s*(?:(?P<rule>[a-z_][a-z_0-9]*)\s*<-|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|'(?P<kind>[^']+)'|"(?P<soft>[^"]+)"|(?P<op>[/()?*+&!]))""")


def _read(text: str) -> dict[str, tuple]:
    tokens, at = [], 0
    text = re.sub(r"#[^\n]*", "", text).rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar at {text[at : at + 30]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    rules: dict[str, tuple] = {}
    i = 0

    def choice():
        nonlocal i
        options = [sequence()]
        while i < len(tokens) and tokens[i] == ("op", "/"):
            i += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def sequence():
        nonlocal i
        items = []
        while i < len(tokens) and tokens[i][0] != "rule" and tokens[i] not in (("op", "/"), ("op", ")")):
            items.append(prefix())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefix():
        nonlocal i
        if tokens[i] in (("op", "&"), ("op", "!")):
            sign = tokens[i][1]
            i += 1
            return ("and" if sign == "&" else "not", prefix())
        kind, value = tokens[i]
        i += 1
        if (kind, value) == ("op", "("):
            node = choice()
            i += 1
        elif kind == "name":
            node = ("token", value) if value.isupper() else ("rule", value)
        else:
            node = ("token", value) if kind == "kind" else ("soft", value)
        while i < len(tokens) and tokens[i] in (("op", "?"), ("op", "*"), ("op", "+")):
            node = ({"?": "opt", "*": "star", "+": "plus"}[tokens[i][1]], node)
            i += 1
        return node

    while i < len(tokens):
        name = tokens[i][1]
        i += 1
        rules[name] = choice()
    return rules


class Grammar:
    def __init__(self, text: str, start: str):
        self.rules, self.start = _read(text), start
        self._analyse()
        self._fast = self._compile(tracking=False)
        self._slow = self._compile(tracking=True)
        self._code = _instructions(self)

    def _analyse(self) -> None:
        """Which expressions may match nothing, and the tokens that the others start with."""
        self.empty: dict[str, bool] = dict.fromkeys(self.rules, False)
        self.first: dict[str, frozenset] = dict.fromkeys(self.rules, frozenset())
        changed = True
        while changed:
            changed = False
            for name, body in self.rules.items():
                e, f = self._of(body)
                if e != self.empty[name] or f != self.first[name]:
                    self.empty[name], self.first[name], changed = e, f, True

    def _of(self, node) -> tuple[bool, frozenset]:
        kind, arg = node
        if kind == "token":
            return False, frozenset([arg])
        if kind == "soft":
            return False, frozenset(["NAME"])
        if kind == "rule":
            return self.empty[arg], self.first[arg]
        if kind in ("and", "not"):
            return True, frozenset()
        if kind in ("opt", "star"):
            return True, self._of(arg)[1]
        if kind == "plus":
            return self._of(arg)
        if kind == "choice":
            parts = [self._of(a) for a in arg]
            return any(e for e, _ in parts), frozenset().union(*[f for _, f in parts])
        first: frozenset = frozenset()
        for a in arg:
            e, f = self._of(a)
            first |= f
            if not e:
                return False, first
        return True, first

    def _compile(self, tracking: bool):
        sets: dict[frozenset, str] = {}
        lines: list[str] = []
        counter = 0

        def fresh() -> str:
            nonlocal counter
            counter += 1
            return f"v{counter}"

        def guard(node, at: str) -> str:
            e, f = self._of(node)
            if e or tracking:
                return ""
            if len(f) == 1:
                return f"K[{at}] == {next(iter(f))!r}"
            return f"K[{at}] in {sets.setdefault(f, f'S{len(sets)}')}"

        def emit(node, at: str, out: str, pad: str) -> None:
            kind, arg = node
            w = lines.append
            if kind in ("token", "soft"):
                test = f"K[{at}] == {arg!r}" if kind == "token" else f"K[{at}] == 'NAME' and T[{at}] == {arg!r}"
                w(f"{pad}if {test}: {out} = {at} + 1")
                w(f"{pad}else:")
                if tracking:
                    w(f"{pad} if {at} > far[0]: far[0] = {at}")
                w(f"{pad} {out} = -1")
            elif kind == "rule":
                w(f"{pad}{out} = M_{arg}.get({at})")
                w(f"{pad}if {out} is None: {out} = r_{arg}({at})")
            elif kind == "seq":
                cur = at
                for n, a in enumerate(arg):
                    nxt = out if n == len(arg) - 1 else fresh()
                    emit(a, cur, nxt, pad)
                    if n < len(arg) - 1:
                        w(f"{pad}if {nxt} < 0: {out} = -1")
                        w(f"{pad}else:")
                        pad += " "
                        cur = nxt
            elif kind == "choice":
                w(f"{pad}{out} = -1")
                for a in arg:
                    g = guard(a, at)
                    w(f"{pad}if {out} < 0{' and ' + g if g else ''}:")
                    t = fresh()
                    emit(a, at, t, pad + " ")
                    w(f"{pad} {out} = {t}")
            elif kind == "opt":
                g, t = guard(arg, at), fresh()
                w(f"{pad}{out} = {at}")
                w(f"{pad}if {g or 'True'}:")
                emit(arg, at, t, pad + " ")
                w(f"{pad} if {t} >= 0: {out} = {t}")
            elif kind in ("star", "plus"):
                t, cur = fresh(), fresh()
                w(f"{pad}{cur} = {at}")
                w(f"{pad}while {guard(arg, cur) or 'True'}:")
                emit(arg, cur, t, pad + " ")
                w(f"{pad} if {t} <= {cur}: break")
                w(f"{pad} {cur} = {t}")
                w(f"{pad}{out} = {cur}" + (f" if {cur} > {at} else -1" if kind == "plus" else ""))
            else:
                t = fresh()
                emit(arg, at, t, pad)
                w(f"{pad}{out} = {at} if {t} {'>=' if kind == 'and' else '<'} 0 else -1")

        for name, body in self.rules.items():
            lines += [f" M_{name} = {{}}"]
        for name, body in self.rules.items():
            lines += [f" def r_{name}(i):"]
            emit(body, "i", "o", "  ")
            lines += [f"  M_{name}[i] = o", "  return o"]
        head = ["def recognise(K, T, far):"] + [f" # {len(self.rules)} rules"]
        source = "\n".join(head + lines + [f" return r_{self.start}(0)"])
        space: dict = {name: s for s, name in sets.items()}
        exec(compile(source, "<grammar>", "exec"), space)
        return space["recognise"]

    def accepts(self, kinds: list[str], texts: list[str]) -> bool:
        """Whether the whole input is a sentence. The lists end with an 'EOF' token."""
        try:
            with deep():
                return self._fast(kinds, texts, [0]) == len(kinds)
        except RecursionError:
            return self.run_machine(kinds, texts)[0] == len(kinds)

    def furthest(self, kinds: list[str], texts: list[str]) -> int:
        """Index of the furthest token at which the input could not be continued."""
        far = [0]
        try:
            with deep():
                self._slow(kinds, texts, far)
        except RecursionError:
            far = [self.run_machine(kinds, texts)[1]]
        return min(far[0], len(kinds) - 1)

    def run_machine(self, kinds: list[str], texts: list[str]) -> tuple[int, int]:
        """(end of the match or -1, furthest failed position), whatever the depth.

        The stack holds (where to go, position, rule): of a call with the rule's number, of a choice with -1.
        """
        code, start = self._code
        n = len(kinds)
        memo: list[array | None] = [None] * len(self.rules)
        unknown = array("i", [-2]) * (n + 1)
        stack = array("i")
        pc, i, far = start, 0, 0
        while True:
            op, arg, to = code[pc]
            if op == TOKEN:
                if i < n and kinds[i] == arg:
                    i += 1
                    pc += 1
                    continue
                far = i if i > far else far
            elif op == GUARD:
                if i < n and kinds[i] in arg:
                    pc += 1
                    continue
                far = i if i > far else far
                if to >= 0:
                    pc = to
                    continue
            elif op == CALL:
                table = memo[arg]
                if table is None:
                    table = memo[arg] = unknown[:]
                end = table[i]
                if end == -2:
                    stack.extend((pc + 1, i, arg))
                    pc = to
                    continue
                if end >= 0:
                    i = end
                    pc += 1
                    continue
            elif op == RETURN:
                if not stack:
                    return i, far
                rule, at, pc = stack.pop(), stack.pop(), stack.pop()
                memo[rule][at] = i
                continue
            elif op == CHOICE:
                stack.extend((to, i, -1))
                pc += 1
                continue
            elif op == COMMIT:
                del stack[-3:]
                pc = to
                continue
            elif op == LOOP:  # an item that matched nothing ends the repetition
                pc = to if stack[-2] < i else pc + 1
                del stack[-3:]
                continue
            elif op == BACK:  # a look-ahead that holds consumes nothing
                i = stack[-2]
                del stack[-3:]
                pc = to
                continue
            elif op == SOFT:
                if i < n and kinds[i] == "NAME" and texts[i] == arg:
                    i += 1
                    pc += 1
                    continue
                far = i if i > far else far
            elif op == DROP:
                del stack[-3:]
            # failure: back to the last choice; the rules left on the way do not match where they were called
            while stack:
                rule, at, pc = stack.pop(), stack.pop(), stack.pop()
                if rule < 0:
                    i = at
                    break
                memo[rule][at] = -1
            else:
                return -1, far


TOKEN, SOFT, CALL, RETURN, CHOICE, COMMIT, LOOP, BACK, DROP, GUARD, FAIL = range(11)


def _instructions(grammar: Grammar) -> tuple[list[tuple], int]:
    """The rules as (operation, argument, target); the first instruction to run."""
    code: list[list] = []
    number = {name: k for k, name in enumerate(grammar.rules)}
    begins: dict[str, int] = {}

    def add(op, arg=None, to=-1) -> int:
        code.append([op, arg, to])
        return len(code) - 1

    def guarded(node) -> int | None:
        empty, first = grammar._of(node)
        return None if empty else add(GUARD, first)

    def emit(node) -> None:
        kind, arg = node
        if kind == "token":
            add(TOKEN, arg)
        elif kind == "soft":
            add(SOFT, arg)
        elif kind == "rule":
            add(CALL, arg)
        elif kind == "seq":
            for a in arg:
                emit(a)
        elif kind == "choice":
            ends = []
            for k, a in enumerate(arg):
                guard = guarded(a)
                if k == len(arg) - 1:
                    emit(a)
                    break
                choice = add(CHOICE)
                emit(a)
                ends.append(add(COMMIT))
                code[choice][2] = len(code)
                if guard is not None:
                    code[guard][2] = len(code)
            for e in ends:
                code[e][2] = len(code)
        elif kind in ("opt", "star"):
            begin = len(code)
            guard, choice = guarded(arg), add(CHOICE)
            emit(arg)
            add(COMMIT if kind == "opt" else LOOP, None, len(code) + 1 if kind == "opt" else begin)
            code[choice][2] = len(code)
            if guard is not None:
                code[guard][2] = len(code)
        elif kind == "plus":
            if grammar._of(arg)[0]:
                raise ValueError("a repeated item may match nothing")
            emit(arg)
            emit(("star", arg))
        else:
            choice = add(CHOICE)
            emit(arg)
            if kind == "and":
                add(BACK, None, len(code) + 2)
                code[choice][2] = add(FAIL)
            else:
                add(DROP)
                code[choice][2] = len(code)

    for name, body in grammar.rules.items():
        begins[name] = len(code)
        emit(body)
        add(RETURN)
    for c in code:
        if c[0] == CALL:
            c[1], c[2] = number[c[1]], begins[c[1]]
    return [tuple(c) for c in code], begins[grammar.start]


class deep:
    """Room for ``MAX_FRAMES`` nested calls; calls between Python functions use no C stack."""

    def __enter__(self):
        self.old = sys.getrecursionlimit()
        sys.setrecursionlimit(max(self.old, MAX_FRAMES))

    def __exit__(self, *_):
        sys.setrecursionlimit(self.old)


class SyntaxProblem(Exception):
    """The text is no token sequence: what is wrong, and at which offset."""

    def __init__(self, reason: str, offset: int):
        super().__init__(reason)
        self.reason, self.offset = reason, offset
