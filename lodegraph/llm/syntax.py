"""Source files that do not parse in the language of their extension.

Every file is split into tokens and matched by a packrat recogniser of its language's grammar, which has
to consume the whole text.  A failure is reported with the furthest position reached and its likely cause.

Defined results
---------------
* The extension decides (.py, .c, .h, .json, without case); other files are not judged. ``lang`` is ignored.
* Null content is no case. Empty Python and C texts are valid, an empty JSON text is not.
* Repeated rows count once; of several contents of one file each is judged, one that fails makes a case.
* Texts of any length and nesting are parsed whole; the depth limits are the language's own (brackets, indents
  and f-strings in Python).
* A C text whose macro calls collect and produce more than ``c_preprocess.MAX_EXPANSION`` tokens is reported as
  not valid, with "macro expansion too large" as what was found: compilers give up on such texts, too.
* Files that no entity of type file names are not judged by ``invalid_files``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.peg import SyntaxProblem, deep
from lodegraph.session import shuffle_width

LANGUAGES = {"py": "python", "c": "c", "h": "c", "json": "json"}
_MARKER = re.compile(r"^(?:<{7}(?:[ \n]|$)|={7}(?:\n|$)|>{7}(?:[ \n]|$)|\|{7}(?:[ \n]|$))", re.M)


def _module(language: str):
    from lodegraph.llm.grammars import c_peg, json_peg, python_peg

    return {"python": python_peg, "c": c_peg, "json": json_peg}[language]


def _tokens(module, text: str) -> tuple[list[str], list[str], list[int]]:
    try:
        with deep():
            return module.tokens(text)
    except RecursionError:  # only macro calls nested in arguments, and long before this by their cost
        raise SyntaxProblem("macro expansion too large", 0) from None


def parses(text: str, language: str) -> bool:
    module = _module(language)
    try:
        kinds, texts, _ = _tokens(module, text)
    except SyntaxProblem:
        return False
    return module.GRAMMAR.accepts(kinds, texts)


def judge(text: str, language: str) -> tuple[int, int, str, str] | None:
    """None for a valid text, else (line, column from 1, what stood there, cause)."""
    module = _module(language)
    found = ""
    try:
        kinds, texts, offsets = _tokens(module, text)
        if module.GRAMMAR.accepts(kinds, texts):
            return None
        at = module.GRAMMAR.furthest(kinds, texts)
        offset, found = offsets[at], texts[at] or kinds[at]
        ended = kinds[at] in ("EOF", "DEDENT", "NEWLINE") and not text[offset:].strip()
    except SyntaxProblem as e:
        offset, found = e.offset, e.reason
        ended = offset >= len(text) or e.reason.startswith("un") and e.reason != "unindent"
    seen = text.replace("\r\n", "\n").replace("\r", "\n")[:offset]
    line, column = seen.count("\n") + 1, offset - (seen.rfind("\n") + 1) + 1
    if _MARKER.search(text.replace("\r\n", "\n")):
        cause = "merge_conflict"
    elif any(other != language and text.strip() and parses(text, other) for other in ("json", "python", "c")):
        cause = "other_language"
    elif ended:
        cause = "truncated"
    else:
        cause = "other"
    return line, column, found[:60], cause


VERDICT_SCHEMA = "graph_name string, source_file string, language string, valid boolean, line int, column int, found string, cause string"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in VERDICT_SCHEMA.split(", ")]
    for b in batches:
        got = [judge(t, k) for t, k in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
        rest = [pa.array([g and g[k] for g in got], pa.int32() if k < 2 else pa.string()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([g is None for g in got]), *rest], names=names)


def syntax_verdicts(source_files: DataFrame) -> DataFrame:
    """One verdict per distinct (graph_name, source_file, content): see VERDICT_SCHEMA."""
    extension = F.lower(F.regexp_extract("source_file", r"\.([A-Za-z]+)$", 1))
    language = F.coalesce(*[F.when(extension == e, F.lit(v)) for e, v in LANGUAGES.items()])
    # the grouping collapses copies before the shuffle; the second exchange spreads the costly parses evenly
    texts = (
        source_files.select("graph_name", "source_file", language.alias("language"), "content")
        .where("content is not null and language is not null")
        .distinct()
        .repartition(4 * shuffle_width(source_files.sparkSession))
    )
    return texts.mapInArrow(_verdicts, VERDICT_SCHEMA)


def listed_verdicts(entities: DataFrame, source_files: DataFrame) -> DataFrame:
    """Verdicts of the files that an entity of type file names."""
    named = entities.where("type = 'file' and source_file is not null").select("graph_name", "source_file").distinct()
    files = source_files.join(named, ["graph_name", "source_file"], "left_semi")
    return syntax_verdicts(files)


def invalid_files(entities: DataFrame, source_files: DataFrame) -> DataFrame:
    return listed_verdicts(entities, source_files).where("not valid").select("graph_name", "source_file").distinct()


def syntax_rates(verdicts: DataFrame) -> DataFrame:
    """Per graph and language: files, invalid files, their share, and how many of each cause."""
    per_file = verdicts.groupBy("graph_name", "source_file", "language").agg(
        F.min("valid").alias("valid"), F.min("cause").alias("cause")
    )
    causes = ("merge_conflict", "other_language", "truncated", "other")
    return per_file.groupBy("graph_name", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.avg((~F.col("valid")).cast("int")).alias("rate"),
        *[F.count_if(F.col("cause") == c).alias(f"n_{c}") for c in causes],
    )
