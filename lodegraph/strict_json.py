"""JSON texts as the standard defines them: one value, no NaN, any depth, numbers kept as written."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_refuse)


def loads(text: str):
    """The value of ``text``; ValueError unless the whole of it is exactly one JSON value."""
    try:
        start = _BLANK.match(text).end()
        value, end = _DECODER.raw_decode(text, start)
        if _BLANK.match(text, end).end() != len(text):
            raise ValueError("text after the value")
        return value
    except RecursionError:
        return _loads_deep(text)
    except StopIteration:
        raise ValueError("no value") from None


def _loads_deep(text: str):
    """The same with a stack of its own, for nesting beyond the interpreter's."""
    at, n = 0, len(text)
    stack: list = []
    result: list = []

    def put(value):
        if not stack:
            result.append(value)
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][stack[-1][1]] = value
        else:
            stack[-1][0].append(value)

    def key(at):
        if text[at : at + 1] != '"':
            raise ValueError("key")
        k, at = scanstring(text, at + 1, True)
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("colon")
        stack[-1][1] = k
        return _BLANK.match(text, at + 1).end()

    at = _BLANK.match(text).end()
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            stack.append([{} if c == "{" else [], None])
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                at = key(at) if c == "{" else at
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            put(value)
        elif m := _NUMBER.match(text, at):
            put(m[0])
            at = m.end()
        else:
            for word, value in (("true", True), ("false", False), ("null", None)):
                if text.startswith(word, at):
                    put(value)
                    at += len(word)
                    break
            else:
                raise ValueError(f"value at {at}")
        while True:  # after a value, or at the end of an empty container
            at = _BLANK.match(text, at).end()
            if not stack:
                if at != n:
                    raise ValueError("text after the value")
                return result[0]
            top = stack[-1][0]
            c = text[at : at + 1]
            if c == ("}" if isinstance(top, dict) else "]"):
                stack.pop()
                put(top)
                at += 1
            elif c == ",":
                at = _BLANK.match(text, at + 1).end()
                at = key(at) if isinstance(top, dict) else at
                break
            else:
                raise ValueError(f"comma at {at}")
