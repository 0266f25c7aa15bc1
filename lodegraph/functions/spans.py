"""Spans and displays as column expressions: no UDF, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(span: Column, pattern: str) -> Column:
    got = F.regexp_extract(span, pattern, 1)
    return F.when(got != "", got.try_cast("int"))


def first_line(span: Column) -> Column:
    """Start line of ``l:c-l:c`` or ``l:c``; null for any other form."""
    return _part(span, r"^([0-9]+):[0-9]+(?:-[0-9]+:[0-9]+)?$")


def last_line(span: Column) -> Column:
    return F.coalesce(_part(span, r"^[0-9]+:[0-9]+-([0-9]+):[0-9]+$"), first_line(span))


def call_line(span: Column) -> Column:
    """What stands before the first colon, if it is a number."""
    return _part(span, r"^\s*([0-9]+)\s*(?::|$)")


def overlaps(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    return (a_last >= b_first) & (a_first <= b_last)


def attribute_display(description: Column) -> tuple[Column, Column]:
    """(raw, resolved) of ``ast Attribute: raw -> resolved``; empty text where there is none."""

    def clean(c: Column) -> Column:
        head = F.trim(F.regexp_replace(c, r" \(.*$", ""))
        return F.regexp_replace(head, r"\s*\)$", "")

    tail = F.regexp_extract(description, r"ast Attribute:\s*(.*)$", 1)
    raw = clean(F.regexp_extract(tail, r"^(.*?)(?:\s*->|$)", 1))
    return raw, clean(F.regexp_extract(tail, r"->\s*(.*)$", 1))
