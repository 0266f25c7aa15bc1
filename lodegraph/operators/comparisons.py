"""Graph facts against independent evidence: owners of uses, registries, runtime names, liveness, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = "graph_name"


def resolve_owner(uses: DataFrame, functions: DataFrame, types: DataFrame) -> DataFrame:
    """The entity that a type use belongs to: (use_id, owner, owner_kind, resolver), outcome ok, unmatched or unowned.

    Uses of a function (return, parameter, local) go to the function at the exact site, else to the only
    static one of the file for a static owner, or the only external one of the name.  Fields go to the record
    or typedef at the exact site, a typedef's also to the only site on its line; typedefs to their exact site;
    global variables belong to nothing.
    ``uses``: use_id, use_kind, name, record_kind, storage, path, line, col; ``functions``: title, name,
    storage, path, line, col; ``types``: title, kind, name, path, line, col, site_line.
    """
    u = uses.withColumn("lane", F.when(F.col("use_kind").isin("function_return", "parameter", "local_variable"), "function").when(F.col("use_kind") == "field", "type").when(F.col("use_kind") == "typedef_underlying", "type"))
    u = u.withColumn("kind", F.when(F.col("use_kind") == "typedef_underlying", "typedef").when(F.col("record_kind") == "typedef", "typedef").otherwise("struct"))
    site = ["name", "path", "line", "col"]

    def one(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.max("title").alias(f"t_{tag}"))

    j = (
        u.join(one(functions, site, "fn_site"), site, "left")
        .join(one(functions.where("storage = 'static'"), ["name", "path"], "fn_static"), ["name", "path"], "left")
        .join(one(functions.where("storage is null or storage <> 'static'"), ["name"], "fn_external"), ["name"], "left")
        .join(one(types, ["kind", *site], "ty_site"), ["kind", *site], "left")
        .join(one(types.drop("line").withColumnRenamed("site_line", "line"), ["kind", "name", "path", "line"], "ty_line"), ["kind", "name", "path", "line"], "left")
    )
    static = F.coalesce(F.col("storage"), F.lit("")) == "static"
    fn, ty = F.col("lane") == "function", F.col("lane") == "type"
    steps = [
        ("exact_declaration_site", fn & (F.col("n_fn_site") == 1), "t_fn_site"),
        ("unique_internal_function_name_same_file", fn & static & (F.col("n_fn_static") == 1), "t_fn_static"),
        ("unique_external_function_name", fn & ~static & (F.col("n_fn_external") == 1), "t_fn_external"),
        ("exact_declaration_site", ty & (F.col("n_ty_site") == 1) & ~F.coalesce(F.col("record_kind") == "union", F.lit(False)), "t_ty_site"),
        ("owned_tag_typedef_site", ty & (F.col("use_kind") == "field") & (F.col("kind") == "typedef") & (F.col("n_ty_line") == 1), "t_ty_line"),
    ]
    owner, resolver = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, test, title in reversed(steps):
        owner, resolver = F.when(test, F.col(title)).otherwise(owner), F.when(test, F.lit(name)).otherwise(resolver)
    nobody = (F.col("use_kind") == "global_variable") | (fn & F.col("name").isNull())
    outcome = F.when(nobody, "unowned").when(resolver.isNotNull() & (owner != ""), "ok").otherwise("unmatched")
    ok = outcome == "ok"
    return j.select("use_id", F.when(ok, owner).alias("owner"), F.when(ok, F.when(fn, "function").otherwise(F.col("kind"))).alias("owner_kind"), F.when(ok, resolver).alias("resolver"), outcome.alias("outcome"))


def classify_uses(uses: DataFrame) -> DataFrame:
    """Uses by key with their provenance merged: (source, target, kind, n_entries, entries, bucket).

    ``uses``: source, target, kind, entry_index, owner_outcome, target_outcome.  What is owned and bound is
    configured; the rest is named by what failed first.
    """
    bucket = (
        F.when(F.col("owner_outcome") == "unowned", "unowned").when(F.col("owner_outcome") == "unmatched", "owner_unmatched")
        .when(F.col("target_outcome") == "bound", "configured").otherwise(F.concat(F.lit("target_"), F.regexp_replace("target_outcome", "^target_", "")))
    )
    return uses.withColumn("bucket", bucket).groupBy("source", "target", "kind", "bucket").agg(
        F.countDistinct("entry_index").alias("n_entries"), F.sort_array(F.collect_set("entry_index")).alias("entries")
    )


def registry_comparison(stated: DataFrame, runtime: DataFrame) -> DataFrame:
    """Static registry tables against what a run saw: (registry, key, bucket).

    agree, disagree (other value), missed (only at run time), false_positive (only stated), undetected (the
    whole registry is unknown to the analysis).
    """
    known = stated.select("registry").distinct().withColumn("known", F.lit(True))
    a = stated.groupBy("registry", "key").agg(F.max("value").alias("a"))
    b = runtime.groupBy("registry", "key").agg(F.max("value").alias("b"))
    j = a.join(b, ["registry", "key"], "full_outer").join(known, "registry", "left")
    bucket = (
        F.when(F.col("known").isNull(), "undetected").when(F.col("a").isNull(), "missed").when(F.col("b").isNull(), "false_positive")
        .when(F.col("a") == F.col("b"), "agree").otherwise("disagree")
    )
    return j.select("registry", "key", bucket.alias("bucket"))


def registry_promotions(sites: DataFrame, tables: DataFrame, titles: DataFrame) -> DataFrame:
    """Call edges through a registry: a labelled site, a table of that name, and a value that is an entity."""
    known = titles.select(BY, F.col("title").alias("target")).distinct()
    hit = sites.join(tables, [BY, "registry"]).join(known, [BY, "target"], "left_semi")
    return hit.select(BY, "source", "target", "registry", F.lit("calls").alias("type"), F.lit(0.75).alias("confidence"), F.lit(False).alias("is_deterministic")).distinct()


def liveness_comparison(regions: DataFrame, surviving: DataFrame) -> DataFrame:
    """Regions per state against the lines that a preprocessor kept: (bucket, n, rate of agreement).

    ``regions``: file, first, last, liveness; ``surviving``: file, line.  A region without a line that could
    survive is vacuous; an unknown one is not scored; the rate is null if nothing is scored.
    """
    lines = surviving.groupBy("file").agg(F.sort_array(F.collect_set("line")).alias("kept"))
    seen = F.exists("kept", lambda x: (x > F.col("first")) & (x < F.col("last")))
    j = regions.join(lines, "file", "left").withColumn("alive", F.coalesce(seen, F.lit(False)))
    bucket = (
        F.when(F.col("last") - F.col("first") < 2, "vacuous").when(F.col("liveness") == "unknown", "unknown")
        .when(F.col("alive") == (F.col("liveness") == "live"), "agree").otherwise("disagree")
    )
    n = j.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    scored = n.where("bucket in ('agree', 'disagree')").agg(F.sum("n").alias("scored"), F.sum(F.when(F.col("bucket") == "agree", F.col("n")).otherwise(0)).alias("agreed"))
    return n.withColumn("_k", F.lit(1)).join(scored.withColumn("_k", F.lit(1)), "_k").select("bucket", "n", F.try_divide("agreed", "scored").alias("rate"))


def unlisted_names(runtime: DataFrame, entities: DataFrame) -> DataFrame:
    """Public names of a running module that no entity has: (module, name)."""
    have = entities.select(F.substring_index("title", ":", 1).alias("module"), F.regexp_extract("title", r":(.*)$", 1).alias("name")).distinct()
    return runtime.where(~F.col("name").startswith("_")).select("module", "name").distinct().join(have, ["module", "name"], "left_anti")


def inherited_members(edges: DataFrame, runtime: DataFrame) -> DataFrame:
    """Inherited-member edges whose owner at run time is another: (source, target, owner)."""
    stated = edges.where("type = 'inherits' and instr(source, '.') > 0").select("source", "target").distinct()
    return stated.join(runtime.select(F.col("member").alias("source"), "owner"), "source", "left").where(~F.col("target").eqNullSafe(F.col("owner")))


def match_exports(exports: DataFrame, entities: DataFrame) -> DataFrame:
    """Re-exported names to entities: (export, title, outcome) with resolved, ambiguous, other_file, unknown.

    ``exports``: export, name, origin_file; ``entities``: title, source_file, and the name, else the last part of
    the title is the name.
    """
    suffix = entities.select("name", "title", "source_file").distinct() if "name" in entities.columns else entities.select(F.substring_index(F.regexp_extract("title", r":(.*)$", 1), ".", -1).alias("name"), "title", "source_file").where("name <> ''").distinct()
    j = exports.join(suffix, "name", "left")
    here = F.col("source_file") == F.col("origin_file")
    per = j.groupBy("export").agg(F.count_if(here).alias("n_here"), F.max(F.when(here, F.col("title"))).alias("title"), F.count("title").alias("n_any"))
    outcome = F.when(F.col("n_here") == 1, "resolved").when(F.col("n_here") > 1, "ambiguous").when(F.col("n_any") > 0, "other_file").otherwise("unknown")
    return per.select("export", F.when(outcome == "resolved", F.col("title")).alias("title"), outcome.alias("outcome"))


def health(expected: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """Per specification: rows as bags, missing and surplus, and whether the graph is as published."""
    from lodegraph.operators.measures import bag_difference

    return bag_difference(expected, actual, fields, ["spec"]).withColumn("status", F.when((F.col("n_missing") == 0) & (F.col("n_extra") == 0), "ok").otherwise("drift"))


def roll_up(reports: dict[str, DataFrame]) -> DataFrame:
    """Metric rows of several reports side by side, never blended: (report, metric, value)."""
    out = None
    for name, df in sorted(reports.items()):
        part = df.select(F.lit(name).alias("report"), "metric", F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def durability(claims: DataFrame) -> DataFrame:
    """Artifacts with the uses that rest on them and whether all of them can be replayed."""
    return claims.groupBy("artifact").agg(F.sort_array(F.collect_set("use")).alias("uses"), F.bool_and("replayable").alias("durable"))


def macro_seed_digest(defines: DataFrame) -> DataFrame:
    """SHA-256 per file over its ordered (origin, name, value) seed."""
    entry = F.concat_ws("\0", "origin", "name", F.coalesce("value", F.lit("")))
    return defines.groupBy("file").agg(F.sha2(F.to_json(F.sort_array(F.collect_set(entry))), 256).alias("digest"))


def byte_offsets(lines: DataFrame) -> DataFrame:
    """Offset of the first byte of each line: (file, line, byte_offset), for texts with ``\\n`` line ends."""
    cut = lines.select("file", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    from pyspark.sql.window import Window

    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))
    return cut.select("file", (F.col("pos") + 1).alias("line"), offset.cast("bigint").alias("byte_offset"))
