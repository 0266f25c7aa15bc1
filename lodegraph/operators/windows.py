"""Ranks, caps with exact totals, as-of lookups and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BY = "graph_name"


def capped(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group with the group's exact total and whether rows were left out.

    The rank alone is limited, so each task keeps n rows of a group before the shuffle; the totals are a
    separate aggregation with map-side partial counts.  A group with a third of all rows costs no task more
    than its share.
    """
    shown, by = df.columns, by or ["_all"]
    df = df if by != ["_all"] else df.withColumn("_all", F.lit(1))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    totals = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("total"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranked.join(totals, same).select(*shown, "rank", "total", (F.col("total") > n).alias("truncated"))


def hash_sample(df: DataFrame, by: list[str], identity: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows per group in the order of a seeded hash of their identity; the same rows on every run."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *identity)), *identity)
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def history(snapshots: DataFrame, limit: int = 20) -> DataFrame:
    """Newest snapshots first, with the exact total; at most 200."""
    distinct = snapshots.groupBy(BY, "snapshot_id").agg(F.min("created_at").alias("created_at"))
    return capped(distinct, [BY], [F.desc("created_at"), F.desc("snapshot_id")], min(limit, 200))


def retention(snapshots: DataFrame, keep_last: int, pins: DataFrame | None = None) -> DataFrame:
    """(graph_name, snapshot_id, decision): current, pinned, newest or delete.

    The current snapshot (the last by created_at) and existing pins are kept; the newest of the rest by id
    fill up to ``keep_last`` (at least 1).
    """
    seen = snapshots.groupBy(BY, "snapshot_id").agg(F.min("created_at").alias("created_at"))
    pinned = (pins if pins is not None else seen.limit(0)).select(BY, "snapshot_id", F.lit(True).alias("pin")).distinct()
    per = Window.partitionBy(BY)
    is_current = F.row_number().over(per.orderBy(F.desc("created_at"), F.desc("snapshot_id"))) == 1
    flagged = seen.join(pinned, [BY, "snapshot_id"], "left").withColumn("is_current", is_current)
    flagged = flagged.withColumn("safe", F.col("is_current") | F.coalesce("pin", F.lit(False)))
    slots = F.greatest(F.lit(max(1, keep_last)) - F.count_if("safe").over(per), F.lit(0))
    nth = F.row_number().over(per.orderBy("safe", F.desc("snapshot_id")))
    decision = (
        F.when(F.col("is_current"), "current").when(F.col("safe"), "pinned").when(F.col("nth") <= F.col("slots"), "newest").otherwise("delete")
    )
    return flagged.withColumns({"slots": slots, "nth": nth}).select(BY, "snapshot_id", decision.alias("decision"))


def dangling_pins(snapshots: DataFrame, pins: DataFrame) -> DataFrame:
    return pins.join(snapshots.select(BY, "snapshot_id").distinct(), [BY, "snapshot_id"], "left_anti")


def priority_window(rows: DataFrame, by: list[str], first: Column, order: list[str], n: int = 15) -> DataFrame:
    """Rows with the flag first, the others behind them, n per group."""
    flagged = rows.withColumn("_first", F.coalesce(first, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_first"), *order))
    return flagged.withColumn("rank", rank).where(F.col("rank") <= n).drop("_first")


def last_assignment(calls: DataFrame, assignments: DataFrame, keys: list[str]) -> DataFrame:
    """As-of lookup: for each call the last assignment at or before its line.

    ``calls``: keys, call_id, line; ``assignments``: keys, at_line, type (null: unknown).
    Returns keys, call_id, last_type, all types seen so far, and whether one of them is unknown.  Calls and
    assignments are sorted together once per key; no call is paired with the assignments before it.  Of
    several on one line the greatest type is the last.  Rows with a null key or line meet nothing.
    """
    shape = [*keys, F.col("_line"), F.col("call_id"), F.col("_set")]
    made = assignments.dropna(subset=[*keys, "at_line"]).select(*keys, F.col("at_line").alias("_line"), F.struct("type").alias("_set"))
    made = made.withColumn("call_id", F.lit(None).cast(calls.schema["call_id"].dataType)).select(*shape)
    whole = F.lit(True)
    for c in [*keys, "line"]:
        whole = whole & F.col(c).isNotNull()
    asked = calls.withColumn("_set", F.lit(None).cast(made.schema["_set"].dataType)).withColumn("_line", F.col("line"))
    so_far = Window.partitionBy(*keys).orderBy("_line", F.col("_set").isNull(), F.coalesce("_set.type", F.lit(""))).rowsBetween(Window.unboundedPreceding, 0)
    seen = made.unionByName(asked.where(whole).select(*shape)).select(
        *keys, "call_id", F.col("_set").isNull().alias("_is_call"),
        F.last("_set", ignorenulls=True).over(so_far)["type"].alias("last_type"),
        F.sort_array(F.collect_set("_set.type").over(so_far)).alias("types"),
        F.coalesce(F.max(F.col("_set").isNotNull() & F.col("_set.type").isNull()).over(so_far), F.lit(False)).alias("any_unknown"),
    ).where("_is_call").drop("_is_call")
    none = asked.where(~whole).select(*keys, "call_id", F.lit(None).cast("string").alias("last_type"), F.array().cast("array<string>").alias("types"), F.lit(False).alias("any_unknown"))
    return seen.unionByName(none)


#: Who wins when a macro is defined in several places: later entries override earlier ones.
DEFINE_PRECEDENCE = ("builtin", "header", "package", "file_flag", "in_file")


def define_environment(defines: DataFrame, points: DataFrame) -> DataFrame:
    """The value of a macro before a line: (point_id, name, value), a row for each point that has one.

    ``defines``: file (null: everywhere), origin, line, name, value; ``points``: point_id, file, before_line,
    name (the macro asked for).  In-file definitions count only above the line; of equals the later line
    wins.  What holds everywhere and what holds for a file are one row per macro each, joined by equality;
    definitions in the file and points are sorted together, so no point is paired with all of them.
    """
    order = F.array_position(F.array(*map(F.lit, DEFINE_PRECEDENCE)), F.col("origin"))
    made = defines.where("name is not null").withColumn("_d", F.struct(order.alias("order"), F.col("line"), F.col("value")))
    everywhere = made.where("file is null and origin <> 'in_file'").groupBy("name").agg(F.max("_d").alias("_all"))
    by_file = made.where("file is not null and origin <> 'in_file'").groupBy("file", "name").agg(F.max("_d").alias("_file"))
    asked = points.where("name is not null").select("point_id", "file", F.col("before_line").alias("line"), "name").withColumn("_d", F.lit(None).cast(made.schema["_d"].dataType))
    inside = made.where("origin = 'in_file' and file is not null and line is not null").withColumn("point_id", F.lit(None).cast(points.schema["point_id"].dataType))
    above = Window.partitionBy("file", "name").orderBy("line", F.col("_d").isNotNull(), F.col("_d.value")).rowsBetween(Window.unboundedPreceding, 0)
    told = asked.unionByName(inside.select(*asked.columns)).withColumn("_above", F.last("_d", ignorenulls=True).over(above)).where("_d is null").drop("_d")
    told = told.withColumn("_above", F.when(F.col("line").isNotNull() & F.col("file").isNotNull(), F.col("_above")))
    joined = told.join(by_file, ["file", "name"], "left").join(everywhere, "name", "left")
    best = F.greatest("_above", "_file", "_all")
    return joined.where(best.isNotNull()).select("point_id", "name", best["value"].alias("value")).distinct()


def latest_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
