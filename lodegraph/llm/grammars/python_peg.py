"""Python 3.13: tokens with indentation and nested f-strings, and the grammar of a module.

Only what the parser itself refuses is an error; what later passes refuse (a return outside a function,
a repeated parameter) is valid here, as the language's own parser has it.
"""

from __future__ import annotations

import re
import unicodedata

from lodegraph.llm.peg import Grammar, SyntaxProblem

#: Fixed values of the language.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import"
    " in is lambda nonlocal not or pass raise return try while with yield".split()
)
MAX_NESTING, MAX_INDENTS, MAX_FSTRINGS = 200, 100, 150

GRAMMAR = Grammar(
    """
    file <- stmt* EOF
    stmt <- compound / simple_stmts
    simple_stmts <- simple (';' simple)* ';'? NEWLINE
    simple <- assignment / type_alias / star_expressions / return_stmt / import_stmt / raise_stmt / 'pass' / del_stmt
            / yield_expr / assert_stmt / 'break' / 'continue' / global_stmt
    compound <- function / if_stmt / class_def / with_stmt / for_stmt / try_stmt / while_stmt / match_stmt / decorated / async_stmt

    assignment <- NAME ':' expression ('=' rhs)?
                / ('(' single_target ')' / attribute_target) ':' expression ('=' rhs)?
                / (star_targets '=')+ rhs !'='
                / single_target AUGASSIGN rhs
    rhs <- yield_expr / star_expressions
    type_alias <- "type" NAME type_params? '=' expression
    return_stmt <- 'return' star_expressions?
    raise_stmt <- 'raise' (expression ('from' expression)?)?
    del_stmt <- 'del' del_targets &end_of_simple
    end_of_simple <- ';' / NEWLINE
    assert_stmt <- 'assert' expression (',' expression)?
    global_stmt <- ('global' / 'nonlocal') NAME (',' NAME)*
    import_stmt <- 'import' dotted_as (',' dotted_as)*
                 / 'from' ('.' / '...')* dotted 'import' from_names
                 / 'from' ('.' / '...')+ 'import' from_names
    dotted_as <- dotted ('as' NAME)?
    dotted <- NAME ('.' NAME)*
    from_names <- '*' / '(' name_as (',' name_as)* ','? ')' / name_as (',' name_as)* !','
    name_as <- NAME ('as' NAME)?

    block <- NEWLINE INDENT stmt+ DEDENT / simple_stmts
    decorated <- ('@' named NEWLINE)+ (class_def / function / 'async' function)
    async_stmt <- 'async' (function / with_stmt / for_stmt)
    class_def <- 'class' NAME type_params? ('(' args? ')')? ':' block
    function <- 'def' NAME type_params? '(' params? ')' ('->' expression)? ':' block
    type_params <- '[' type_param (',' type_param)* ','? ']'
    type_param <- NAME (':' expression)? ('=' expression)? / '*' NAME ('=' star_expression)? / '**' NAME ('=' expression)?
    if_stmt <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
    while_stmt <- 'while' named ':' block ('else' ':' block)?
    for_stmt <- 'for' star_targets 'in' star_expressions ':' block ('else' ':' block)?
    with_stmt <- 'with' '(' with_item (',' with_item)* ','? ')' ':' block / 'with' with_item (',' with_item)* ':' block
    with_item <- expression 'as' star_target &after_item / expression
    after_item <- ',' / ')' / ':'
    try_stmt <- 'try' ':' block 'finally' ':' block
              / 'try' ':' block (except_star+ / except_block+) ('else' ':' block)? ('finally' ':' block)?
    except_block <- 'except' (expression ('as' NAME)?)? ':' block
    except_star <- 'except' '*' expression ('as' NAME)? ':' block

    match_stmt <- "match" subject ':' NEWLINE INDENT case_block+ DEDENT
    subject <- star_named ',' star_nameds? / named
    case_block <- "case" patterns ('if' named)? ':' block
    patterns <- open_sequence / pattern
    open_sequence <- maybe_star ',' (maybe_star (',' maybe_star)* ','?)?
    maybe_star <- '*' NAME / pattern
    pattern <- or_pattern 'as' NAME / or_pattern
    or_pattern <- closed ('|' closed)*
    closed <- literal_pattern / class_pattern / value_pattern / capture / '(' pattern ')' / '(' open_sequence? ')'
            / '[' (maybe_star (',' maybe_star)* ','?)? ']' / mapping
    literal_pattern <- signed (('+' / '-') NUMBER)? / strings / 'None' / 'True' / 'False'
    signed <- '-'? NUMBER
    capture <- NAME !after_capture
    after_capture <- '.' / '(' / '='
    value_pattern <- NAME ('.' NAME)+ !after_capture
    class_pattern <- NAME ('.' NAME)* '(' (class_args ','?)? ')'
    class_args <- keyword_pattern (',' keyword_pattern)* / positional (',' positional)* (',' keyword_pattern (',' keyword_pattern)*)?
    positional <- pattern !'='
    keyword_pattern <- NAME '=' pattern
    mapping <- '{' (map_item (',' map_item)* (',' '**' NAME)? ','? / '**' NAME ','?)? '}'
    map_item <- (literal_pattern / NAME ('.' NAME)+) ':' pattern

    params <- plain_params
    plain_params <- param_no_default (',' param_no_default)* (',' '/' (',' params_after_slash)? / ',' defaulted / ',' star_etc)? ','?
                  / param_default_list
    params_after_slash <- param_no_default (',' param_no_default)* (',' defaulted / ',' star_etc)? / defaulted / star_etc
    param_default_list <- defaulted ','? / star_etc ','?
    defaulted <- param_default (',' param_default)* (',' '/' (',' param_default)*)? (',' star_etc)?
    star_etc <- '*' NAME (':' star_expression)? (',' keyword_param)* (',' double_star)?
              / '*' (',' keyword_param)+ (',' double_star)? / double_star
    double_star <- '**' NAME (':' expression)?
    param_no_default <- NAME (':' expression)? !'='
    param_default <- NAME (':' expression)? '=' expression
    keyword_param <- NAME (':' expression)? ('=' expression)?

    lambda <- 'lambda' lambda_params? ':' expression
    lambda_params <- lparam (',' lparam)* (',' '/' (',' l_after_slash)? / ',' ldefaulted / ',' lstar)? ','? / ldefaulted ','? / lstar ','?
    l_after_slash <- lparam (',' lparam)* (',' ldefaulted / ',' lstar)? / ldefaulted / lstar
    ldefaulted <- ldefault (',' ldefault)* (',' '/' (',' ldefault)*)? (',' lstar)?
    lstar <- '*' NAME (',' lkeyword)* (',' '**' NAME)? / '*' (',' lkeyword)+ (',' '**' NAME)? / '**' NAME
    lparam <- NAME !'='
    ldefault <- NAME '=' expression
    lkeyword <- NAME ('=' expression)?

    star_expressions <- star_expression (',' star_expression)* ','?
    star_expression <- '*' bitor / expression
    star_nameds <- star_named (',' star_named)* ','?
    star_named <- '*' bitor / named
    walrus <- NAME ':=' expression
    named <- walrus / expression !':='
    expression <- lambda / disjunction ('if' disjunction 'else' expression)?
    yield_expr <- 'yield' 'from' expression / 'yield' star_expressions?
    disjunction <- inversion (('and' / 'or') inversion)*
    inversion <- 'not' inversion / comparison
    comparison <- bitor (compare_op bitor)*
    compare_op <- COMPARE / 'not' 'in' / 'in' / 'is' 'not' / 'is'
    bitor <- factor (binary_op factor)*
    binary_op <- BINARY / '+' / '-' / '*' / '/' / '@' / '|'
    factor <- ('+' / '-' / '~') factor / power
    power <- await_primary ('**' factor)?
    await_primary <- 'await' primary / primary
    primary <- atom trailer*
    trailer <- '.' NAME / genexp / '(' args? ')' / '[' slices ']'
    slices <- slice !',' / (slice / '*' bitor) (',' (slice / '*' bitor))* ','?
    slice <- expression? ':' expression? (':' expression?)? / named
    atom <- NAME / NUMBER / strings / 'True' / 'False' / 'None' / '...' / paren / bracket / brace
    paren <- '(' ')' / '(' star_named ',' star_nameds? ')' / '(' (yield_expr / named) ')' / genexp
    genexp <- '(' (walrus / expression !':=') for_ifs ')'
    bracket <- '[' star_nameds? ']' / '[' named for_ifs ']'
    brace <- '{' (pair_item (',' pair_item)* ','?)? '}' / '{' star_nameds '}' / '{' expression ':' expression for_ifs '}' / '{' named for_ifs '}'
    pair_item <- '**' bitor / expression ':' expression
    for_ifs <- ('async'? 'for' star_targets 'in' disjunction ('if' disjunction)*)+
    strings <- BYTES+ / (STRING / fstring)+ !BYTES
    fstring <- FSTART (FMIDDLE / replacement)* FEND
    replacement <- '{' (yield_expr / star_expressions) '='? FCONV? (FSPEC (FMIDDLE / replacement)*)? '}'

    args <- argument_list ','? &')'
    argument_list <- positional_arg (',' positional_arg)* (',' kwargs)? / kwargs
    positional_arg <- '*' expression / (walrus / expression !':=') !'='
    kwargs <- kw_star (',' kw_star)* (',' kw_double (',' kw_double)*)? / kw_double (',' kw_double)*
    kw_star <- NAME '=' expression / '*' expression
    kw_double <- NAME '=' expression / '**' expression

    star_targets <- star_target !',' / star_target (',' star_target)* ','?
    star_target <- '*' !'*' star_target / plain_target
    plain_target <- attribute_target / star_atom
    star_atom <- NAME / '(' plain_target ')' / '(' (star_target (',' star_target)+ ','? / star_target ',')? ')' / '[' (star_target (',' star_target)* ','?)? ']'
    attribute_target <- atom &target_look (trailer &target_look)* ('.' NAME / '[' slices ']') !target_look
    target_look <- '(' / '[' / '.'
    single_target <- attribute_target / NAME / '(' single_target ')'
    del_targets <- del_target (',' del_target)* ','?
    del_target <- attribute_target / NAME / '(' del_target ')' / '(' del_targets? ')' / '[' del_targets? ']'
    """,
    "file",
)

_NUMBER = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
)
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)")
_OPERATOR = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|<<|>>|<=|>=|==|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_NAME = re.compile(r"[^\W\d]\w*|[A-Za-z_][A-Za-z_0-9]*")
_PREFIX = re.compile(r"(?i:([rbuf]|rb|br|rf|fr)?)(\"\"\"|'''|\"|')")
_BODY = {
    q: re.compile(rf"(?:[^\\{q[0]}{'' if len(q) == 3 else chr(92) + 'n'}]++|\\(?:.|\n){'|' + q[0] + '(?!' + q[0] * 2 + ')' if len(q) == 3 else ''})*+{q}", re.S)
    for q in ("'", '"', "'''", '"""')
}
_KIND = {"!=": "COMPARE", "==": "COMPARE", "<=": "COMPARE", ">=": "COMPARE", "<": "COMPARE", ">": "COMPARE"} | dict.fromkeys(
    ("&", "^", "<<", ">>", "//", "%"), "BINARY"
) | dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "<<=", ">>=", "**=", "//="), "AUGASSIGN")
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|[xuUN]|.)", re.S)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _check_escapes(body: str, is_bytes: bool, at: int) -> None:
    for m in _ESCAPE.finditer(body):
        e = m[1]
        if e[0] == "x" and len(e) == 1:
            raise SyntaxProblem("escape", at)
        if is_bytes or e[0] not in "uUN":
            continue
        if len(e) == 1 or (e[0] == "U" and int(e[1:], 16) > 0x10FFFF):
            raise SyntaxProblem("escape", at)
        if e[0] == "N":
            try:
                unicodedata.lookup(e[2:-1])
            except KeyError:
                raise SyntaxProblem("escape", at) from None


class _Lexer:
    def __init__(self, text: str):
        if "\0" in text:
            raise SyntaxProblem("null byte", text.index("\0"))
        self.s = text
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.offsets: list[int] = []
        self.fstrings = 1

    def put(self, kind: str, text: str, at: int) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.offsets.append(at)

    def run(self) -> tuple[list[str], list[str], list[int]]:
        s, n, at = self.s, len(self.s), 0
        indents, alternate = [0], [0]
        brackets: list[str] = []
        fresh = True
        while at < n:
            if fresh and not brackets:
                col = alt = continued = 0
                while at < n and s[at] in " \t\f\\":
                    if s[at] == " ":
                        col, alt = col + 1, alt + 1
                    elif s[at] == "\t":
                        col, alt = (col // 8 + 1) * 8, alt + 1
                    elif s[at] == "\f":
                        col = alt = 0
                    elif s[at + 1 : at + 2] == "\n" and at + 2 < n:
                        # a continued blank start: the indentation of the first part counts, if it has one
                        continued = continued or col
                        at += 1
                    else:
                        raise SyntaxProblem("continuation", at)
                    at += 1
                if continued:
                    col = alt = continued
                if at >= n:
                    break
                if s[at] == "#":
                    end = s.find("\n", at)
                    at = n if end < 0 else end
                    if at >= n:
                        break
                if s[at] == "\n":
                    at += 1
                    continue
                fresh = False
                if col == indents[-1]:
                    if alt != alternate[-1]:
                        raise SyntaxProblem("tabs", at)
                elif col > indents[-1]:
                    if alt <= alternate[-1]:
                        raise SyntaxProblem("tabs", at)
                    indents.append(col)
                    alternate.append(alt)
                    if len(indents) > MAX_INDENTS:
                        raise SyntaxProblem("indentation too deep", at)
                    self.put("INDENT", "", at)
                else:
                    while col < indents[-1]:
                        indents.pop()
                        alternate.pop()
                        self.put("DEDENT", "", at)
                    if col != indents[-1]:
                        raise SyntaxProblem("unindent", at)
                    if alt != alternate[-1]:
                        raise SyntaxProblem("tabs", at)
            c = s[at]
            if c == "\n":
                if not brackets:
                    self.put("NEWLINE", "", at)
                    fresh = True
                at += 1
                continue
            at = self.one(at, brackets)
        if brackets:
            raise SyntaxProblem("unclosed", n)
        if self.kinds and self.kinds[-1] not in ("NEWLINE", "DEDENT"):
            self.put("NEWLINE", "", n)
        for _ in indents[1:]:
            self.put("DEDENT", "", n)
        self.put("EOF", "", n)
        return self.kinds, self.texts, self.offsets

    def one(self, at: int, brackets: list[str]) -> int:
        """One token, blank, comment or continuation at a place inside a line."""
        s = self.s
        c = s[at]
        if c in " \t\f":
            return at + 1
        if c == "#":
            end = s.find("\n", at)
            return len(s) if end < 0 else end
        if c == "\\":
            if s[at + 1 : at + 2] == "\n" and at + 2 < len(s):
                return at + 2
            raise SyntaxProblem("continuation", at)
        m = _PREFIX.match(s, at)
        if m:
            return self.string(at, (m[1] or "").lower(), m[2], m.end(), brackets)
        if "0" <= c <= "9" or (c == "." and "0" <= s[at + 1 : at + 2] <= "9"):
            m = _NUMBER.match(s, at)
            end, num = m.end(), m[0]
            if re.fullmatch(r"0[_0]*[0-9_]*[1-9][0-9_]*", num):
                raise SyntaxProblem("leading zeros", at)
            if end < len(s) and (s[end].isalnum() or s[end] == "_") and not (_AFTER_NUMBER.match(s, end)):
                raise SyntaxProblem("number", end)
            self.put("NUMBER", num, at)
            return end
        m = _NAME.match(s, at)
        if m:
            word = m[0]
            if not word.isascii():
                if not unicodedata.normalize("NFKC", word).isidentifier():
                    raise SyntaxProblem("character", at)
            self.put(word if word in KEYWORDS else "NAME", word, at)
            return m.end()
        m = _OPERATOR.match(s, at)
        if not m:
            raise SyntaxProblem("character", at)
        op = m[0]
        if op in "([{":
            brackets.append(op)
            if len(brackets) >= MAX_NESTING:
                raise SyntaxProblem("nesting too deep", at)
        elif op in _CLOSES:
            if not brackets or brackets.pop() != _CLOSES[op]:
                raise SyntaxProblem("bracket", at)
        self.put(_KIND.get(op, op), op, at)
        return m.end()

    def string(self, at: int, prefix: str, quote: str, start: int, brackets: list[str]) -> int:
        if "f" in prefix:
            return self.fstring(at, prefix, quote, start, brackets)
        m = _BODY[quote].match(self.s, start)
        if not m:
            raise SyntaxProblem("unterminated string", at)
        body = m[0][: -len(quote)]
        is_bytes = "b" in prefix
        if is_bytes and not body.isascii():
            raise SyntaxProblem("bytes", at)
        if "r" not in prefix and "\\" in body:
            _check_escapes(body, is_bytes, at)
        self.put("BYTES" if is_bytes else "STRING", body[:20], at)
        return m.end()

    def fstring(self, at: int, prefix: str, quote: str, start: int, brackets: list[str]) -> int:
        self.put("FSTART", "", at)
        self.fstrings += 1
        if self.fstrings > MAX_FSTRINGS:
            raise SyntaxProblem("f-string: nested too deeply", at)
        end = self.literal_part(at, prefix, quote, start, False, 0)
        self.put("FEND", "", end)
        self.fstrings -= 1
        return end

    def literal_part(self, origin: int, prefix: str, quote: str, at: int, in_spec: bool, depth: int) -> int:
        """Literal text and replacement fields, to the closing quote (or, in a format spec, to the brace)."""
        s, n, raw = self.s, len(self.s), "r" in prefix
        begin = at

        def flush(end: int) -> None:
            part = s[begin:end]
            if part:
                if not raw and "\\" in part:
                    _check_escapes(part, False, origin)
                self.put("FMIDDLE", "", begin)

        while True:
            if at >= n:
                raise SyntaxProblem("unterminated f-string", origin)
            c = s[at]
            if c == "\\" and not (raw and s[at + 1 : at + 2] in "{}"):
                if not raw and s.startswith("\\N{", at):
                    close = s.find("}", at)
                    at = close + 1 if close > 0 else n
                elif s[at + 1 : at + 2] in "{}" and s[at + 1 : at + 2]:
                    at += 1
                else:
                    at += 2
            elif c == quote[0] and s.startswith(quote, at):
                if in_spec:
                    raise SyntaxProblem("f-string: expecting '}'", at)
                flush(at)
                return at + len(quote)
            elif c == "\n" and len(quote) == 1:
                raise SyntaxProblem("unterminated f-string", at)
            elif c == "{":
                if s.startswith("{{", at) and not in_spec:
                    at += 2
                    continue
                flush(at)
                at = begin = self.field(origin, prefix, quote, at, depth)
            elif c == "}":
                if in_spec:
                    flush(at)
                    return at
                if s.startswith("}}", at):
                    at += 2
                    continue
                raise SyntaxProblem("f-string: single '}'", at)
            else:
                at += 1

    def field(self, origin: int, prefix: str, quote: str, at: int, depth: int) -> int:
        s, n = self.s, len(self.s)
        if depth > 2:
            raise SyntaxProblem("f-string: nested too deeply", at)
        self.put("{", "{", at)
        at += 1
        inner: list[str] = []
        lambdas = 0
        while True:
            if at >= n:
                raise SyntaxProblem("unterminated f-string", origin)
            c = s[at]
            if not inner:
                if c == "}":
                    self.put("}", "}", at)
                    return at + 1
                if c == "!" and s[at + 1 : at + 2] != "=":
                    m = re.compile(r"!([^\W\d]\w*)").match(s, at)
                    if not m or m[1] not in "sra" or len(m[1]) != 1:
                        raise SyntaxProblem("f-string: conversion", at)
                    self.put("FCONV", m[0], at)
                    at = m.end()
                    continue
                if c == ":":
                    self.put("FSPEC", ":", at)
                    at = self.literal_part(origin, prefix, quote, at + 1, True, depth + 1)
                    continue
                if c == "=" and s[at + 1 : at + 2] != "=":
                    self.put("=", "=", at)
                    at += 1
                    continue
            if c == "\n":
                at += 1
                continue
            at = self.one(at, inner)


def tokens(text: str) -> tuple[list[str], list[str], list[int]]:
    return _Lexer(text.replace("\r\n", "\n").replace("\r", "\n")).run()
