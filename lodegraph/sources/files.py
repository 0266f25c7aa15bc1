"""Source trees and JSON documents as DataFrames."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(source_file relative to the root, content) of every file of a tree whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = root.rstrip("/").split("://")[-1] + "/"
    return files.select(F.expr(f"substring(path, instr(path, '{base}') + {len(base)})").alias("source_file"), plain.alias("path"), F.decode("content", "UTF-8").alias("content"))


def has_public_definition(text: str | None) -> bool:
    """Whether a module defines a public function or class at its top level."""
    try:
        body = ast.parse(text or "").body
    except (SyntaxError, ValueError):
        return False
    return any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not n.name.startswith("_") for n in body)


def _public():
    """``has_public_definition`` of a batch of texts."""
    import pandas as pd

    def public(texts):
        return texts.map(has_public_definition)

    public.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(public, "boolean")


def python_sources(spark: SparkSession, root: str) -> DataFrame:
    """Python files of a package: no ``tests`` folders, initializers only if they define something public."""
    files = read_tree(spark, root, "*.py").where(~F.col("source_file").rlike(r"(^|/)tests/"))
    public = _public()
    initial = F.col("source_file").rlike(r"(^|/)__init__\.py$")
    return files.where(~initial).unionByName(files.where(initial).where(public("content")))


def c_sources(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root, "*.{c,h}").where(F.col("source_file").rlike(r"\.[ch]$"))


COMPILE_ENTRY = "array<struct<directory:string,file:string,command:string,arguments:array<string>,output:string>>"


def compile_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a compilation database in order, with the SHA-256 of its text."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", COMPILE_ENTRY, {"mode": "FAILFAST"})
    return text.select(F.sha2("value", 256).alias("digest"), F.posexplode(entries).alias("entry_index", "e")).select("digest", "entry_index", "e.*")


def defines(entries: DataFrame) -> DataFrame:
    """(file, name, value) of the -D flags of compile entries; without a value it is 1."""
    words = F.coalesce("arguments", F.split("command", r"\s+"))
    joined = F.concat(F.lit(" "), F.array_join(words, " "))
    flags = F.expr("regexp_extract_all(_t, ' -D ?([A-Za-z_][A-Za-z_0-9]*(?:=[^ ]*)?)', 1)")
    found = entries.withColumn("_t", joined).select("file", F.explode(flags).alias("flag"))
    value = F.when(F.instr("flag", "=") > 0, F.regexp_extract("flag", r"=(.*)$", 1)).otherwise("1")
    return found.select("file", F.substring_index("flag", "=", 1).alias("name"), value.alias("value"))


def json_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Result documents ``run_*.json`` of a folder, checked against a schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/run_*.json")
