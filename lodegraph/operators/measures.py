"""Aggregations, multisets, envelopes and votes over graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions.plain import vectorised
from lodegraph.strict_json import loads as strict_loads

BY = "graph_name"


def top_called(edges: DataFrame, entities: DataFrame, n: int = 3) -> DataFrame:
    """The most called entities of each graph; ties by title."""
    known = entities.select(BY, F.col("title").alias("target")).distinct()
    counts = edges.where("type = 'calls'").join(known, [BY, "target"], "left_semi").groupBy(BY, "target").agg(F.count(F.lit(1)).alias("n_calls"))
    rank = F.row_number().over(Window.partitionBy(BY).orderBy(F.desc("n_calls"), "target"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select(BY, "rank", F.col("target").alias("title"), "n_calls")


def bag_difference(expected: DataFrame, actual: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Missing and surplus rows as multisets: one more copy on a side is one row of difference."""
    e = expected.groupBy(*by, *fields).agg(F.count(F.lit(1)).alias("_e"))
    a = actual.groupBy(*by, *fields).agg(F.count(F.lit(1)).alias("_a"))
    keys = [*by, *fields]
    both = e.withColumn("_a", F.lit(0).cast("bigint")).unionByName(a.withColumn("_e", F.lit(0).cast("bigint")))
    net = both.groupBy(*keys).agg((F.sum("_e") - F.sum("_a")).alias("d"))
    return net.groupBy(*by).agg(
        F.sum(F.greatest(F.col("d"), F.lit(0))).alias("n_missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("n_extra")
    )


def envelope_counts(snapshots: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Snapshots whose stated row counts differ from the rows there are (repeats once).

    ``tables``: name -> one row per record with graph_name and snapshot_id.
    """
    stated = snapshots.groupBy(BY, "snapshot_id").agg(F.max("counts").alias("counts"))
    out = None
    for name, df in tables.items():
        got = df.groupBy(BY, "snapshot_id").agg(F.count(F.lit(1)).alias("actual"))
        part = stated.join(got, [BY, "snapshot_id"], "left").select(
            BY, "snapshot_id", F.lit(name).alias("table_name"), F.col(f"counts.{name}").alias("stated"), F.coalesce("actual", F.lit(0)).alias("actual")
        )
        out = part if out is None else out.unionByName(part)
    return out.where(~F.col("stated").eqNullSafe(F.col("actual")))


def envelope_anomalies(snapshots: DataFrame) -> DataFrame:
    """Manifest faults per snapshot: (graph_name, snapshot_id, code)."""
    hex40 = r"^[0-9a-f]{40}$"
    files = ["entities.parquet", "relationships.parquet", "text_units.parquet"]
    tests = {
        "invalid_schema_version": ~F.col("schema_version").eqNullSafe(F.lit(1)),
        "invalid_snapshot_id": F.col("snapshot_id").isNull() | F.col("snapshot_id").rlike(r"^\s*$|^\.|[/\\]"),
        "invalid_created_at": F.col("created_at").isNull(),
        "invalid_counts": F.col("counts").isNull() | (F.least("counts.entities", "counts.relationships", "counts.text_units", "counts.call_observations") < 0),
        "invalid_files": F.col("files").isNull(),
        "missing_required_file": F.size(F.array_except(F.array(*map(F.lit, files)), F.coalesce("files", F.array().cast("array<string>")))) > 0,
        "missing_observation_file": (F.col("counts.call_observations") > 0) & ~F.array_contains("files", "call_observations.parquet"),
        "zero_row_observation_file": (F.col("counts.call_observations") == 0) & F.array_contains("files", "call_observations.parquet"),
        "invalid_total_size_bytes": F.col("total_size_bytes").isNull() | (F.col("total_size_bytes") < 0),
        "invalid_corpus_hash": F.col("corpus_hash").isNotNull(),
        "invalid_git_commit": F.col("git_commit").isNotNull() & ~F.col("git_commit").rlike(hex40),
        "invalid_source_root": F.col("source_root").isNull() | (F.trim("source_root") == ""),
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))
    return snapshots.select(BY, "snapshot_id", F.explode(codes).alias("code")).distinct()


def aggregate_type_uses(uses: DataFrame) -> DataFrame:
    """Use rows per entity pair: sorted distinct kinds and entries, and a canonical JSON list of the rows."""
    row = F.to_json(F.struct("entry_index", "kind", "line"))
    return uses.groupBy(BY, "source", "target").agg(
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.sort_array(F.collect_set("entry_index")).alias("entries"),
        F.count(F.lit(1)).alias("n_uses"),
        F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(row)), ","), F.lit("]")).alias("observations_json"),
    )


def language_vote(entities: DataFrame) -> DataFrame:
    """Which language indexed each graph, by file suffix: python, c, mixed, or none."""
    votes = entities.groupBy(BY).agg(
        F.count_if(F.col("source_file").endswith(".py")).alias("n_python"),
        F.count_if(F.col("source_file").rlike(r"\.[ch]$")).alias("n_c"),
    )
    name = F.when((F.col("n_python") > 0) & (F.col("n_c") > 0), "mixed").when(F.col("n_python") > 0, "python").when(F.col("n_c") > 0, "c").otherwise("none")
    return votes.withColumn("language", name)


def back_references(edges: DataFrame) -> DataFrame:
    """Text unit -> the relationships that list it, sorted."""
    pairs = edges.select(BY, F.explode("text_unit_ids").alias("text_unit_id"), "id").distinct()
    return pairs.groupBy(BY, "text_unit_id").agg(F.sort_array(F.collect_set("id")).alias("relationship_ids"))


def arm_summary(runs: DataFrame, arm: str, value: str) -> DataFrame:
    """Exact median, least, greatest and number of runs per arm."""
    return runs.groupBy(arm).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def balanced(summary: DataFrame) -> bool:
    """Whether all arms have the same number of runs, which a comparison of medians needs."""
    return summary.select(F.count_distinct("n").alias("k")).first()["k"] <= 1


def json_cases(files: DataFrame) -> DataFrame:
    """Number of cases in each golden JSON file: (source_file, content) -> (source_file, n_cases); 0 if it does not parse."""

    # the built-in parsers accept text behind the value, so validity takes the strict one
    def count(text: str) -> int:
        value = strict_loads(text)
        cases = value.get("cases") if isinstance(value, dict) else None
        return len(cases) if isinstance(cases, list) else 0

    return files.select("source_file", F.coalesce(vectorised(count, "int")("content"), F.lit(0)).alias("n_cases"))


def cross_tab(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(by).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def region_census(entities: DataFrame) -> DataFrame:
    """Conditional regions per graph and liveness over the files of a graph."""
    branches = entities.where("type = 'file'").select(BY, "source_file", F.explode("preprocessor_branches").alias("b"))
    return branches.groupBy(BY, F.col("b.liveness").alias("liveness")).agg(
        F.count(F.lit(1)).alias("n_regions"), F.countDistinct("source_file").alias("n_files"), F.max(F.col("b.end_line") - F.col("b.start_line")).alias("longest")
    )


def claims_check(claims: DataFrame, derived: DataFrame) -> DataFrame:
    """(claim, expected, actual, holds) of stated values against derived ones; an unknown claim does not hold."""
    joined = claims.join(derived, "claim", "left")
    return joined.select("claim", "expected", "actual", F.col("expected").eqNullSafe(F.col("actual")).alias("holds"))
