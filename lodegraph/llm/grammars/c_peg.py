"""C11: the grammar of a translation unit over preprocessed tokens.

Which identifiers are type names is read off the typedef declarations of the unit and the standard
headers it includes; the grammar itself has no actions.
"""

from __future__ import annotations

from lodegraph.llm.grammars.c_preprocess import Preprocessor, Token, valid_number
from lodegraph.llm.peg import Grammar, SyntaxProblem

#: Fixed values of the language.
KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return"
    " short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex"
    " _Generic _Imaginary _Noreturn _Static_assert _Thread_local".split()
)

GRAMMAR = Grammar(
    """
    unit <- external* EOF
    external <- function / declaration / ';'
    function <- specifiers declarator declaration* compound
    declaration <- specifiers (init_declarator (',' init_declarator)*)? ';' / static_assert
    static_assert <- '_Static_assert' '(' conditional ',' STRING+ ')' ';'

    specifiers <- mark* (TYPENAME mark* / basic (basic / mark)*) / mark+
    mark <- 'typedef' / 'extern' / 'static' / '_Thread_local' / 'auto' / 'register' / qualifier / 'inline' / '_Noreturn'
          / '_Alignas' '(' (type_name / conditional) ')'
    qualifier <- 'const' / 'restrict' / 'volatile' / '_Atomic' !'('
    basic <- 'void' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned' / '_Bool' / '_Complex' / '_Imaginary'
           / '_Atomic' '(' type_name ')' / record / enumeration
    spec_quals <- (qualifier / align)* (TYPENAME (qualifier / align)* / basic (basic / qualifier / align)*)
    align <- '_Alignas' '(' (type_name / conditional) ')'
    record <- ('struct' / 'union') (ident? '{' member* '}' / ident)
    member <- spec_quals (member_declarator (',' member_declarator)*)? ';' / static_assert / ';'
    member_declarator <- declarator? ':' conditional / declarator
    enumeration <- 'enum' (ident? '{' enumerator (',' enumerator)* ','? '}' / ident)
    enumerator <- ident ('=' conditional)?

    ident <- NAME / TYPENAME
    declarator <- pointer? (ident / '(' declarator ')') suffix*
    pointer <- ('*' qualifier*)+
    suffix <- '[' array ']' / '(' parameters? ')' / '(' NAME (',' NAME)* ')'
    array <- ('static' / qualifier)* '*' &']' / ('static' / qualifier)* assignment / qualifier*
    parameters <- parameter (',' parameter)* (',' '...')?
    parameter <- specifiers (declarator / abstract)?
    abstract <- pointer abstract_direct? / abstract_direct
    abstract_direct <- ('(' abstract ')' / abstract_suffix) abstract_suffix*
    abstract_suffix <- '[' array ']' / '(' parameters? ')'
    type_name <- spec_quals abstract?
    init_declarator <- declarator ('=' initializer)?
    initializer <- assignment / braced
    braced <- '{' (init_item (',' init_item)* ','?)? '}'
    init_item <- (designator+ '=')? initializer
    designator <- '[' conditional ']' / '.' ident

    compound <- '{' (declaration / statement)* '}'
    statement <- ident ':' statement / 'case' conditional ':' statement / 'default' ':' statement / compound
               / 'if' '(' expression ')' statement ('else' statement)? / 'switch' '(' expression ')' statement
               / 'while' '(' expression ')' statement / 'do' statement 'while' '(' expression ')' ';'
               / 'for' '(' (declaration / expression? ';') expression? ';' expression? ')' statement
               / 'goto' ident ';' / 'continue' ';' / 'break' ';' / 'return' expression? ';' / expression? ';'

    expression <- assignment (',' assignment)*
    assignment <- unary ASSIGN assignment / unary '=' assignment / conditional
    conditional <- binary ('?' expression ':' conditional)?
    binary <- cast ((BINARY / '*' / '&' / '+' / '-') cast)*
    cast <- '(' type_name ')' !'{' cast / unary
    unary <- postfix / '++' unary / '--' unary / ('&' / '*' / '+' / '-' / '~' / '!') cast / 'sizeof' '(' type_name ')' !'{' / 'sizeof' unary
           / '_Alignof' '(' type_name ')'
    postfix <- ('(' type_name ')' braced / primary) postfix_part*
    postfix_part <- '[' expression ']' / '(' (assignment (',' assignment)*)? ')' / '.' ident / '->' ident / '++' / '--'
    primary <- NAME / NUMBER / CHAR / STRING+ / '(' expression ')' / TYPECALL '(' typed (',' typed)* ')'
             / '_Generic' '(' assignment (',' (type_name / 'default') ':' assignment)+ ')'
    typed <- type_name / assignment
    """,
    "unit",
)

_KIND = dict.fromkeys(("*=", "/=", "%=", "+=", "-=", "<<=", ">>=", "&=", "^=", "|="), "ASSIGN") | dict.fromkeys(
    ("/", "%", "<<", ">>", "<", ">", "<=", ">=", "==", "!=", "^", "|", "&&", "||"), "BINARY"
)


def declared_types(tokens: list[Token]) -> set[str]:
    """Names that the typedef declarations of the unit introduce, at any depth."""
    found: set[str] = set()
    i = 0
    while i < len(tokens):
        if tokens[i][1] != "typedef" or tokens[i][0] != "name":
            i += 1
            continue
        i += 1
        depth = braces = 0
        while i < len(tokens):
            kind, text, _ = tokens[i]
            if kind == "op":
                if text == "{":
                    braces += 1
                elif text == "}":
                    if braces == 0:
                        break
                    braces -= 1
                elif text == ";" and braces == 0:
                    break
                elif text in ("(", "["):
                    depth += 1
                elif text in (")", "]"):
                    depth -= 1
            elif kind == "name" and braces == 0 and text not in KEYWORDS and i + 1 < len(tokens):
                after, before = tokens[i + 1][1], tokens[i - 1][1]
                tag = before in ("struct", "union", "enum")
                if (depth == 0 and after in (",", ";", "[", "(") and not tag) or (
                    depth == 1 and before in ("*", "const") and after in (")", "[", "(") and _opened_by_star(tokens, i)
                ):
                    found.add(text)
            i += 1
    return found


def _opened_by_star(tokens: list[Token], i: int) -> bool:
    k = i - 1
    while k >= 0 and tokens[k][1] in ("*", "const", "volatile", "restrict"):
        k -= 1
    return k >= 0 and tokens[k][1] == "("


def tokens(text: str) -> tuple[list[str], list[str], list[int]]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\\\n" in text:
        text = text.replace("\\\n", "")
    pre = Preprocessor(text)
    stream = pre.run()
    types = declared_types(stream) | pre.types
    kinds, texts, offsets = [], [], []
    for kind, word, at in stream:
        if kind == "name":
            word = pre.keywords.get(word, word)
            kind = word if word in KEYWORDS else "TYPECALL" if word in pre.type_macros else "TYPENAME" if word in types else "NAME"
            kind = {"__FILE__": "STRING", "__DATE__": "STRING", "__TIME__": "STRING", "__LINE__": "NUMBER"}.get(word, kind)
        elif kind == "op":
            if word in ("#", "##"):
                raise SyntaxProblem("stray #", at)
            kind = _KIND.get(word, word)
        elif kind == "number":
            if not valid_number(word):
                raise SyntaxProblem("number", at)
            kind = "NUMBER"
        elif kind in ("string", "char"):
            kind = kind.upper()
        else:
            raise SyntaxProblem("unterminated literal" if kind == "broken" else "character", at)
        kinds.append(kind)
        texts.append(word)
        offsets.append(at)
    return kinds + ["EOF"], texts + [""], offsets + [len(text)]
