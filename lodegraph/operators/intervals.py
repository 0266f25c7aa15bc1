"""Interval joins on line ranges, and what they tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of rows with equal keys whose [first, last] ranges overlap.

    Both sides have ``first`` and ``last``; those of the right side come out as r_first and r_last.  Ranges
    are spread over blocks of lines, so the join is an equi-join even in a file with very many ranges, and
    a pair is kept only in the first block that both reach: no pair comes out twice.
    """
    blocks = lambda: F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block)))
    a = left.where("first <= last").withColumn("_b", blocks())
    b = right.where("first <= last").withColumn("_b", blocks()).withColumnsRenamed({"first": "r_first", "last": "r_last"})
    once = F.col("_b") == F.floor(F.greatest(F.col("first"), F.col("r_first")) / block)
    return a.join(b, [*keys, "_b"]).where((F.col("last") >= F.col("r_first")) & (F.col("first") <= F.col("r_last")) & once).drop("_b")


def branches_for_spans(facts: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """The conditional regions that each fact's lines touch, include guards left out, each region once.

    Regions of one kind on the same lines are one region; the least (condition, liveness, basis) describes it.

    ``facts``: keys, id, first, last; ``regions``: keys, first, last, kind, condition, liveness, basis, is_guard.
    """
    told = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("condition", "liveness", "basis")]
    least = regions.where("not is_guard").groupBy(*keys, "first", "last", "kind").agg(F.min(F.struct(*told)).alias("_r"))
    open_regions = least.select(*keys, "first", "last", "kind", "_r.*")
    return overlap_join(facts, open_regions, keys).select(*keys, "id", "kind", "condition", "r_first", "r_last", "liveness", "basis")


def region_reasons(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Reason tags of each fact, sorted and distinct."""
    place = F.concat(F.lit("inside_conditional:"), "kind", F.lit("("), F.substring(F.coalesce("condition", F.lit("")), 1, 40), F.lit(")"))
    state = F.concat(F.lit("branch_"), "liveness", F.lit(":"), "kind", F.lit("("), F.substring(F.coalesce("condition", F.lit("")), 1, 40), F.lit(")"))
    tags = branches.select(*keys, "id", F.explode(F.array(place, state)).alias("reason"))
    return tags.groupBy(*keys, "id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def dynamic_reasons(facts: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Reasons of the dynamic sites that lie in a fact's lines or name it as their enclosing definition.

    ``facts``: keys, id, title, type, first, last; ``sites``: keys, first, last, enclosing, reason.
    """
    by_line = overlap_join(facts, sites, keys).select(*keys, "id", "reason")
    bare = F.substring_index("title", ":", -1)
    named = facts.where("type in ('method', 'fn', 'function', 'class')").select(*keys, "id", bare.alias("enclosing"), "type", "first", "last")
    spots = sites.where("enclosing is not null").select(*keys, "enclosing", "reason", F.col("first").alias("line"))
    near = F.col("first").isNull() | F.col("line").between(F.col("first") - 1, F.col("last") + 1)
    by_name = named.join(spots, [*keys, "enclosing"]).where(near).select(*keys, "id", "reason")
    owners = spots.withColumn("owner", F.when(F.instr("enclosing", ".") > 0, F.regexp_replace("enclosing", r"\.[^.]*$", ""))).drop("enclosing")
    by_class = named.where("type = 'class'").join(owners.withColumnRenamed("owner", "enclosing"), [*keys, "enclosing"]).select(*keys, "id", "reason")
    every = by_line.unionByName(by_name).unionByName(by_class)
    return every.groupBy(*keys, "id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def region_liveness(regions: DataFrame, keys: list[str]) -> DataFrame:
    """A region's own state under the states of the regions around it: dead beats unknown beats live."""
    inner = regions.select(*keys, F.col("region_id").alias("inner_id"), "first", "last")
    outer = regions.select(*keys, F.col("liveness").alias("outer"), F.col("first"), F.col("last"), F.col("region_id").alias("outer_id"))
    pairs = overlap_join(inner, outer, keys).where("r_first <= first and r_last >= last")
    worst = F.max(F.when(F.col("outer") == "dead", 2).when(F.col("outer") == "unknown", 1).otherwise(0))
    return pairs.groupBy(*keys, F.col("inner_id").alias("region_id")).agg(worst.alias("_w")).select(
        *keys, "region_id", F.when(F.col("_w") == 2, "dead").when(F.col("_w") == 1, "unknown").otherwise("live").alias("liveness")
    )
