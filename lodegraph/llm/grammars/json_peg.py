"""JSON: one value, strings and numbers exactly as the standard writes them."""

from __future__ import annotations

import re

from lodegraph.llm.peg import Grammar, SyntaxProblem

GRAMMAR = Grammar(
    """
    text <- value EOF
    value <- object / array / STRING / NUMBER / 'true' / 'false' / 'null'
    object <- '{' (pair (',' pair)*)? '}'
    pair <- STRING ':' value
    array <- '[' (value (',' value)*)? ']'
    """,
    "text",
)

_LEX = re.compile(
    r'[ \t\n\r]+|(?P<STRING>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(?P<NUMBER>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<op>[{}\[\]:,]|true|false|null)"
)


def tokens(text: str) -> tuple[list[str], list[str], list[int]]:
    kinds, texts, offsets, at = [], [], [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SyntaxProblem("no token", at)
        if m.lastgroup:
            kinds.append(m[0] if m.lastgroup == "op" else m.lastgroup)
            texts.append(m[0])
            offsets.append(at)
        at = m.end()
    return kinds + ["EOF"], texts + [""], offsets + [len(text)]
