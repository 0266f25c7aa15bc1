"""Audits of call edges against entities, and scores against observed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions.spans import attribute_display, call_line, first_line, last_line
from lodegraph.operators.intervals import overlap_join

BY = "graph_name"


def _ranges(entities: DataFrame) -> DataFrame:
    """One line range per title; of several rows of a title the greatest span stands for it."""
    return entities.groupBy(BY, F.col("title").alias("source")).agg(F.max("span").alias("caller_span"), F.lit(True).alias("known"))


def structural_audit(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that do not lie in their caller: (graph_name, kind, source, target, span, caller_range).

    Kinds: no_caller_entity, caller_no_span, span_outside_caller.  A call whose own line cannot be read
    is not judged.
    """
    joined = calls.select(BY, "source", "target", "span").join(_ranges(entities), [BY, "source"], "left")
    first, last, line = first_line(F.col("caller_span")), last_line(F.col("caller_span")), call_line(F.col("span"))
    kind = (
        F.when(F.col("known").isNull(), "no_caller_entity")
        .when(first.isNull(), "caller_no_span")
        .when(line.isNotNull() & ~line.between(first, last), "span_outside_caller")
    )
    outside = F.when(kind == "span_outside_caller", F.concat_ws("-", first, last))
    return joined.select(BY, kind.alias("kind"), "source", "target", "span", outside.alias("caller_range")).where("kind is not null")


def dangling_targets(entities: DataFrame, calls: DataFrame) -> DataFrame:
    titles = entities.select(BY, F.col("title").alias("target")).distinct()
    return calls.select(BY, "source", "target", "span").join(titles, [BY, "target"], "left_anti").select(BY, "source", "target", "span")


def audit_report(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """Per graph: calls, anomalies, dangling targets and the pass rate, 1.0 for a graph without calls.

    A call that is both misplaced and dangling counts twice, so the rate may be below zero.
    """
    total = calls.groupBy(BY).agg(F.count(F.lit(1)).alias("n_calls"))
    bad = structural_audit(entities, calls).groupBy(BY).agg(F.count(F.lit(1)).alias("n_anomalies"))
    loose = dangling_targets(entities, calls).groupBy(BY).agg(F.count(F.lit(1)).alias("n_dangling"))
    every = entities.select(BY).distinct()
    joined = every.join(total, BY, "left").join(bad, BY, "left").join(loose, BY, "left").fillna(0)
    left = F.col("n_calls") - F.col("n_anomalies") - F.col("n_dangling")
    rate = F.when(F.col("n_calls") == 0, 1.0).otherwise(F.round(left / F.col("n_calls"), 4))
    return joined.withColumn("pass_rate", rate)


def semantic_suspicions(entities: DataFrame, calls: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Attribute calls that became a module-level function of the same name.

    Allowed are receivers that the file imports as that module (``imports``: graph_name, source_file,
    receiver, module) and displays that resolve to the target's module.
    """
    fns = entities.where("type = 'fn'").select(BY, F.col("title").alias("target")).distinct()
    raw, resolved = attribute_display(F.col("description"))
    seen = (
        calls.join(fns, [BY, "target"], "left_semi")
        .withColumns({"display": raw, "resolved_display": resolved})
        .where("instr(target, ':') > 0 and instr(display, '.') > 0")
        .withColumns({
            "module": F.substring_index("target", ":", 1),
            "symbol": F.regexp_extract("target", r":(.*)$", 1),
            "attr": F.substring_index("display", ".", -1),
            "receiver": F.regexp_replace("display", r"\.[^.]*$", ""),
            "base": F.element_at(F.split(F.regexp_replace("resolved_display", r"\.[^.]*$", ""), r"\."), -1),
        })
        .where("attr = symbol and (instr(resolved_display, '.') = 0 or base <> module)")
    )
    if imports is not None:
        seen = seen.join(imports.select(BY, "source_file", "receiver", "module").distinct(), [BY, "source_file", "receiver", "module"], "left_anti")
    return seen.select(BY, "source", "target", "span", "display", "resolved_display", "confidence", "is_deterministic")


def normalised_edges(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """Distinct (source, target) with constructor endpoints folded into their class; no empty ends, no self-edges.

    ``Cls.__init__``, ``__new__`` and ``__call__`` become ``Cls`` only where ``Cls`` is a title.
    """
    known = titles.select(BY, "title").distinct()
    out = edges.select(BY, "source", "target")
    for end in ("source", "target"):
        base = F.regexp_replace(end, r"\.(__init__|__new__|__call__)$", "")
        named = known.select(BY, F.col("title").alias("_base"), F.lit(True).alias("_known"))
        out = (
            out.withColumn("_base", F.when(base != F.col(end), base))
            .join(named, [BY, "_base"], "left")
            .withColumn(end, F.when(F.col("_known"), F.col("_base")).otherwise(F.col(end)))
            .select(BY, "source", "target")
        )
    return out.where("source <> '' and target <> '' and source <> target").distinct()


def edge_scores(stated: DataFrame, observed: DataFrame) -> DataFrame:
    """Per graph: confirmed, missed and unconfirmed edges; rates are null where nothing was there to score."""
    s = stated.select(BY, "source", "target").distinct().withColumn("s", F.lit(1))
    o = observed.select(BY, "source", "target").distinct().withColumn("o", F.lit(1))
    both = s.join(o, [BY, "source", "target"], "full_outer")
    n = both.groupBy(BY).agg(
        F.count(F.col("s") + F.col("o")).alias("n_confirmed"),
        F.count_if(F.col("s").isNull()).alias("n_missed"),
        F.count_if(F.col("o").isNull()).alias("n_unconfirmed"),
    )
    c = F.col("n_confirmed")
    return n.withColumns({
        "recall": F.round(F.try_divide(c, c + F.col("n_missed")), 4),
        "coverage": F.round(F.try_divide(c, c + F.col("n_unconfirmed")), 4),
    })


def miss_table(missed: DataFrame, classes: DataFrame, values: list[str]) -> DataFrame:
    """Missed edges per graph by class (``classes``: source, target, category); unclassified ones show as such."""
    named = missed.join(classes, ["source", "target"], "left").fillna({"category": "unclassified"})
    return named.groupBy(BY).pivot("category", [*values, "unclassified"]).agg(F.count(F.lit(1))).fillna(0)


def match_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Pair rows of equal keys one to one in their order; the rest come out with null on the other side.

    Both sides need ``row_id``.  Returns keys, left_id, right_id.
    """
    w = Window.partitionBy(*keys).orderBy(*order, "row_id")
    a = left.select(*keys, F.col("row_id").alias("left_id"), F.row_number().over(w).alias("_n"))
    b = right.select(*keys, F.col("row_id").alias("right_id"), F.row_number().over(w).alias("_n"))
    return a.join(b, [*keys, "_n"], "full_outer").select(*keys, "left_id", "right_id")


def match_calls(clang: DataFrame, stated: DataFrame) -> DataFrame:
    """Match compiler calls and stated calls: first by byte offset, then the rest by line and column.

    Both: row_id, caller, path, target, byte_offset, line, col.  Returns (left_id, right_id, bucket) with
    buckets matched_offset, matched_position, compiler_only and stated_only.
    """
    exact, near = ["caller", "path", "target", "byte_offset"], ["caller", "path", "target", "line", "col"]
    order = ["path", "caller", "target"]
    first = match_one_to_one(clang.where("byte_offset is not null"), stated.where("byte_offset is not null"), exact, order)
    hit = first.where("left_id is not null and right_id is not null").select("left_id", "right_id")
    rest_a = clang.join(hit, clang["row_id"] == hit["left_id"], "left_anti")
    rest_b = stated.join(hit, stated["row_id"] == hit["right_id"], "left_anti")
    second = match_one_to_one(rest_a, rest_b, near, order).select("left_id", "right_id")
    bucket = F.when(F.col("right_id").isNull(), "compiler_only").when(F.col("left_id").isNull(), "stated_only").otherwise("matched_position")
    return hit.withColumn("bucket", F.lit("matched_offset")).unionByName(second.withColumn("bucket", bucket))


#: Buckets of compiler calls that no stated edge can have as its internal call.
_OTHER_CLASSES = {"external_direct": "external_direct", "indirect": "indirect", "macro_location_unsupported": "macro_unsupported"}


def call_buckets(compiler: DataFrame, stated: DataFrame, scope: DataFrame) -> DataFrame:
    """Compiler calls by class against stated edges: (left_id, right_id, bucket).

    ``compiler`` and ``stated``: as for ``match_calls``, the compiler's rows with ``call_class``; ``scope``: path.
    Internal direct calls are matched one to one (matched_internal) or not (compiler_only_internal, also without
    caller or target); external_direct, indirect, macro_unsupported and ambiguous (any other class) stand alone.
    Stated edges outside the scope are out_of_scope; of the others, those at the place of such a call, whatever
    its target, are covered_by_other, the rest stated_only.
    """
    named = F.col("caller").isNotNull() & (F.col("caller") != "") & F.col("target").isNotNull() & (F.col("target") != "")
    internal = F.coalesce(F.col("call_class") == "internal_direct", F.lit(False))
    paths = scope.select("path").distinct()
    inside = stated.join(paths, "path", "left_semi")
    outside = stated.join(paths, "path", "left_anti").select(F.lit(None).cast("string").alias("left_id"), F.col("row_id").alias("right_id"), F.lit("out_of_scope").alias("bucket"))
    found = match_calls(compiler.where(internal & named), inside)
    hit = found.where("left_id is not null").select("left_id", "right_id", F.when(F.col("right_id").isNull(), "compiler_only_internal").otherwise("matched_internal").alias("bucket"))
    other_class = F.coalesce(*[F.when(F.col("call_class") == c, F.lit(b)) for c, b in _OTHER_CLASSES.items()], F.lit("ambiguous"))
    alone = compiler.where(~(internal & named)).select(
        F.col("row_id").alias("left_id"), F.lit(None).cast("string").alias("right_id"), F.when(internal, "compiler_only_internal").otherwise(other_class).alias("bucket")
    )
    left_over = inside.join(found.where("left_id is null").select(F.col("right_id").alias("row_id")), "row_id", "left_semi").withColumn("target", F.lit(""))
    again = match_calls(compiler.where(~internal).withColumn("target", F.lit("")), left_over.select(*stated.columns)).where("right_id is not null")
    rest = again.select(F.lit(None).cast("string").alias("left_id"), "right_id", F.when(F.col("left_id").isNull(), "stated_only").otherwise("covered_by_other").alias("bucket"))
    return hit.unionByName(alone).unionByName(rest).unionByName(outside)


def match_definitions(compiler: DataFrame, stated: DataFrame, max_gap: int = 2) -> DataFrame:
    """Function definitions by path and name: (path, name, bucket).

    matched needs one candidate on either side and a line gap of at most ``max_gap``; else ambiguous;
    compiler_only and stated_only have no partner.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("path", "name").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.min("line").alias(f"line_{tag}"))

    joined = side(compiler, "a").join(side(stated, "b"), ["path", "name"], "full_outer")
    bucket = (
        F.when(F.col("n_b").isNull(), "compiler_only")
        .when(F.col("n_a").isNull(), "stated_only")
        .when((F.col("n_a") > 1) | (F.col("n_b") > 1) | (F.abs(F.col("line_a") - F.col("line_b")) > max_gap), "ambiguous")
        .otherwise("matched")
    )
    return joined.select("path", "name", bucket.alias("bucket"))


def match_declarations(compiler: DataFrame, stated: DataFrame) -> DataFrame:
    """Type declarations by exact site (kind, name, path, line, col): matched, compiler_only, stated_only, alternate.

    A compiler site of a title that is matched elsewhere is an alternate, not a miss.
    """
    site = ["kind", "name", "path", "line", "col"]
    a, b = compiler.select(*site).distinct().withColumn("a", F.lit(1)), stated.select(*site).distinct().withColumn("b", F.lit(1))
    joined = a.join(b, site, "full_outer")
    per_title = Window.partitionBy("kind", "name")
    matched_title = F.max(F.col("a") + F.col("b")).over(per_title).isNotNull()
    bucket = (
        F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "matched")
        .when(F.col("a").isNotNull() & matched_title, "alternate")
        .when(F.col("a").isNotNull(), "compiler_only")
        .otherwise("stated_only")
    )
    return joined.select(*site, bucket.alias("bucket"))


def attach_overlay(entities: DataFrame, report: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of overlay columns on a composite key that must be unique on both sides; all or nothing."""
    if not report.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("an overlay row is not unique by its key")
    if not report.join(entities, keys, "left_anti").isEmpty():
        raise ValueError("an overlay row has no entity")
    wanted = entities.join(report.select(*keys), keys, "left_semi")
    if not wanted.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("an overlay row has several entities")
    return entities.join(report, keys, "left")


def resolve_type_use(uses: DataFrame, declarations: DataFrame, types: DataFrame) -> DataFrame:
    """Bind a type use to a package type: (use_id, type_id, outcome).

    A declaration id decides alone: bound or unresolved, without a look at the spelling. Without an id an
    exact ``struct X`` or ``enum X`` tag comes first, then a typedef spelling, each if unique; a bare tag
    name is ambiguous; unions and function pointers are unsupported.
    ``uses``: use_id, decl_id, spelling; ``declarations``: decl_id, type_id; ``types``: type_id, kind, name.
    """
    by_tag = types.where("kind in ('struct', 'enum')").groupBy(F.concat_ws(" ", "kind", "name").alias("spelling")).agg(
        F.count(F.lit(1)).alias("n_tag"), F.max("type_id").alias("tag_id"))
    by_name = types.where("kind = 'typedef'").groupBy(F.col("name").alias("spelling")).agg(
        F.count(F.lit(1)).alias("n_def"), F.max("type_id").alias("def_id"))
    bare = types.where("kind in ('struct', 'enum')").select(F.col("name").alias("spelling"), F.lit(True).alias("bare")).distinct()
    decl = declarations.groupBy("decl_id").agg(F.max("type_id").alias("decl_type"))
    j = uses.join(decl, "decl_id", "left").join(by_tag, "spelling", "left").join(by_name, "spelling", "left").join(bare, "spelling", "left")
    unsupported = F.col("spelling").startswith("union ") | F.col("spelling").contains("(*")
    outcome = (
        F.when(F.col("decl_id").isNotNull(), F.when(F.col("decl_type").isNotNull(), "bound").otherwise("target_unresolved"))
        .when(unsupported, "unsupported")
        .when(F.col("n_tag") == 1, "bound").when(F.col("n_tag") > 1, "ambiguous")
        .when(F.col("n_def") == 1, "bound").when(F.col("n_def") > 1, "ambiguous")
        .when(F.col("bare"), "ambiguous").otherwise("external")
    )
    bound = F.when(F.col("decl_id").isNotNull(), F.col("decl_type")).when(F.col("n_tag") == 1, F.col("tag_id")).otherwise(F.col("def_id"))
    return j.select("use_id", F.when(outcome == "bound", bound).alias("type_id"), outcome.alias("outcome"))


def merge_observations(rows: DataFrame, site: list[str], entry: str, claims: list[str]) -> DataFrame:
    """One row per physical site: the compile entries that saw it, and whether they agree on the claims."""
    agreed = [F.when(F.size(F.collect_set(c)) <= 1, F.max(c)).alias(c) for c in claims]
    conflict = F.array_max(F.array(*[F.size(F.collect_set(c)) for c in claims], F.lit(0))) > 1
    return rows.groupBy(*site).agg(F.sort_array(F.collect_set(entry)).alias("entries"), conflict.alias("ambiguous"), *agreed)


def innermost_owner(points: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """The innermost owner whose lines cover each point: the latest start, then the earliest end.

    ``points``: keys, point_id, line; ``owners``: keys, owner, first, last. Joined by blocks of lines: a point
    meets the owners near it, not all of its file.
    """
    at = points.select(*keys, "point_id", F.col("line").alias("first"), F.col("line").alias("last"))
    hit = overlap_join(at, owners.select(*keys, "owner", "first", "last"), keys)
    return hit.groupBy(*keys, "point_id").agg(F.max_by("owner", F.struct("r_first", -F.col("r_last"), "owner")).alias("owner"))


