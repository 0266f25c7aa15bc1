"""Scalar functions over names, ids and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C type names that are never entities of a package.
PRIMITIVES = (
    "void", "char", "signed char", "unsigned char", "short", "unsigned short", "int", "unsigned int", "unsigned", "long", "unsigned long",
    "long long", "unsigned long long", "float", "double", "long double", "_Bool", "bool", "size_t", "ssize_t", "ptrdiff_t", "int8_t",
    "uint8_t", "int16_t", "uint16_t", "int32_t", "uint32_t", "int64_t", "uint64_t", "intptr_t", "uintptr_t", "FILE", "va_list", "wchar_t",
)


def slug(c: Column) -> Column:
    """Everything but letters, digits, ``_ . : -`` becomes one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.:\-]+", "_"), r"^_+|_+$", "")


def n_tokens(text: Column) -> Column:
    """Words between blanks, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")))


def module_key(path: Column) -> Column:
    """Dotted module of a relative path; a package initializer stands for its package."""
    stem = F.regexp_replace(path, r"\.py$", "")
    return F.translate(F.when(stem.endswith("/__init__"), F.regexp_replace(stem, r"/__init__$", "")).otherwise(stem), "/", ".")


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("ent"), kind, name)


def short_digest(*parts: Column) -> Column:
    """Twelve hex digits of the SHA-256 over the parts, separated by null characters."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 12)


def edge_id(kind: str, source: Column, target: Column) -> Column:
    return F.concat(F.lit(f"rel:{kind}:"), slug(source), F.lit(":"), slug(target), F.lit(":"), short_digest(F.lit(kind), source, target))


def core_type(qual: Column) -> Column:
    """A C type without qualifiers, pointers, arrays and tag words."""
    bare = F.regexp_replace(qual, r"\[[^\]]*\]|\*", " ")
    bare = F.regexp_replace(bare, r"\b(const|volatile|restrict|_Atomic|static|extern|register|inline)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(bare), r"^(struct|union|enum)\s+", ""), r"\s+", " "))


def is_external_primitive(core: Column) -> Column:
    return core.isin(*PRIMITIVES) | core.startswith("__")


def return_type(qual: Column) -> Column:
    """What stands before the parameter list of a function type."""
    return F.trim(F.regexp_extract(qual, r"^([^(]*)\(", 1))


def is_function_pointer(qual: Column) -> Column:
    return qual.contains("(*")


def published_id(c: Column) -> Column:
    """Whether a name may be a published snapshot: not blank, no leading dot, no separator."""
    return (F.trim(c) != "") & ~c.rlike(r"^\.|[/\\\s\x00]")


def fingerprint(records: Column) -> Column:
    """SHA-256 over an ordered array of texts, each behind its length in hex."""
    framed = F.transform(records, lambda r: F.concat(F.lpad(F.hex(F.octet_length(r)), 16, "0"), r))
    return F.sha2(F.array_join(framed, ""), 256)


def json_row(columns: list[str], types: dict[str, str]) -> Column:
    """Canonical JSON of a row: columns by name, NaN as null."""
    parts = []
    for c in sorted(columns):
        value = F.col(c)
        parts.append(F.when(F.isnan(value), None).otherwise(value).alias(c) if types[c] in ("double", "float") else value)
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
