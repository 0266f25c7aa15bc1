"""Bounded context records of a symbol: entity, neighbours, texts, data, types, weak facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.windows import capped
from lodegraph.tables import GraphTables

BY = "graph_name"
#: Bounds of the sections of a pack.
LIMITS = {"neighbors": 30, "texts": 10, "members": 50, "module_edges": 100, "observations": 15, "type_edges": 20}


def _section(name: str, df: DataFrame, order: list[str], item: Column, limit: int, cut: Column | None = None) -> DataFrame:
    """Rows of one section in the common shape; arrays of texts sort like their columns, nulls first."""
    cut = F.lit(None).cast("boolean") if cut is None else cut
    key = F.array(*[F.col(c).cast("string") for c in order])
    return df.select(BY, F.lit(name).alias("section"), key.alias("key"), item.alias("item"), cut.alias("cut"), F.lit(limit).alias("limit"))


def _listed(sections: list[DataFrame]) -> DataFrame:
    """All sections together: each item once, ranked, cut at the section's limit, with the section's exact total.

    One distinct, one ranking and one count for all sections; the largest limit bounds the ranks per task.
    """
    rows = sections[0]
    for s in sections[1:]:
        rows = rows.unionByName(s)
    shown = capped(rows.distinct(), [BY, "section"], ["key", "item"], max(LIMITS.values())).where(F.col("rank") <= F.col("limit"))
    return shown.select(BY, "section", "rank", "item", "total", (F.col("total") > F.col("limit")).alias("truncated"), "cut")


def context_sections(g: GraphTables, title: str, max_text_chars: int = 300) -> DataFrame:
    """(graph_name, section, rank, item, total, truncated, cut) for one title in all graphs.

    Sections: neighbors (title or id on either side), texts, data, types_out, types_in, observations.
    Caps cut the lists, never the totals; ``truncated`` speaks of the list, ``cut`` of a single text (null in other sections).
    """
    entity = g.entities.where(F.col("title") == title).select(BY, "id", "title", "text_unit_ids").distinct()
    named = entity.select(BY, F.explode(F.array("id", "title")).alias("name")).distinct()
    edges = g.relationships.select(BY, "id", "source", "target", "type")
    out = edges.join(named.withColumnRenamed("name", "source"), [BY, "source"], "left_semi").withColumn("other", F.col("target"))
    into = edges.join(named.withColumnRenamed("name", "target"), [BY, "target"], "left_semi").withColumn("other", F.col("source"))
    near = out.unionByName(into).where("other is not null")
    edge_text = F.concat_ws(" ", "source", "type", "target")
    unit_ids = entity.select(BY, F.explode("text_unit_ids").alias("id"))
    others = near.select(BY, F.col("other").alias("title")).distinct()
    unit_ids = unit_ids.unionByName(
        g.entities.join(others, [BY, "title"], "left_semi").select(BY, F.explode("text_unit_ids").alias("id"))
    ).distinct()
    units = g.text_units.select(BY, "id", "text").join(unit_ids, [BY, "id"], "left_semi").where("text is not null")
    observed = g.call_observations.where((F.col("source") == title) | F.col("source").startswith(title + "."))
    weak = observed.select(BY, "source", "display_target", "reason", "span").distinct()
    weak = weak.withColumn("behind", ~F.coalesce(F.col("reason").contains("registry"), F.lit(False)))
    sections = [
        _section("neighbors", near, ["other", "type", "id"], edge_text, LIMITS["neighbors"]),
        _section("texts", units, ["id"], F.substring("text", 1, max_text_chars), LIMITS["texts"], F.length("text") > max_text_chars),
        _section("data", near.where("type = 'uses_data'"), ["other", "id"], edge_text, LIMITS["neighbors"]),
        _section("types_out", out.where("type = 'uses_type'"), ["target", "id"], edge_text, LIMITS["type_edges"]),
        _section("types_in", into.where("type = 'uses_type'"), ["source", "id"], edge_text, LIMITS["type_edges"]),
        _section("observations", weak, ["behind", "source", "display_target", "span", "reason"], F.concat_ws(" ", "source", "display_target", "reason"), LIMITS["observations"]),
    ]
    return _listed(sections)


def context_pack(g: GraphTables, title: str, max_text_chars: int = 300) -> DataFrame:
    """(graph_name, pack_json): the sections of a title as one JSON record per graph; ``cut`` beside the items of texts."""
    s = context_sections(g, title, max_text_chars)
    item = F.struct("rank", "item", "cut")
    per = s.groupBy(BY, "section").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("total").alias("total"), F.max("truncated").alias("truncated"))
    body = F.struct("section", F.transform("items", lambda x: x["item"]).alias("items"), "total", "truncated", F.when(F.col("section") == "texts", F.transform("items", lambda x: x["cut"])).alias("cut"))
    packed = per.groupBy(BY).agg(F.array_sort(F.collect_list(body)).alias("sections"))
    return packed.select(BY, F.to_json(F.struct(F.lit(title).alias("title"), "sections")).alias("pack_json"))


def module_pack(g: GraphTables, module: str, max_text_chars: int = 300) -> DataFrame:
    """Members of a module, edges with a member at either end, the texts of both, and the members' weak facts.

    (graph_name, section, rank, item, total, truncated, cut), capped with exact totals.
    """
    inside = lambda c: F.col(c).startswith(module + ":")
    members = g.entities.where(inside("title"))
    edges = g.relationships.where(inside("source") | inside("target"))
    unit_ids = members.select(BY, F.explode("text_unit_ids").alias("id")).unionByName(edges.select(BY, F.explode("text_unit_ids").alias("id"))).distinct()
    units = g.text_units.select(BY, "id", "text").join(unit_ids, [BY, "id"], "left_semi").where("text is not null")
    weak = g.call_observations.where(inside("source"))
    weak = weak.withColumn("behind", ~F.coalesce(F.col("reason").contains("registry"), F.lit(False)))
    return _listed([
        _section("members", members, ["title"], F.concat_ws(" ", "type", "title"), LIMITS["members"]),
        _section("edges", edges, ["source", "target", "type", "id"], F.concat_ws(" ", "source", "type", "target"), LIMITS["module_edges"]),
        _section("texts", units, ["id"], F.substring("text", 1, max_text_chars), LIMITS["texts"], F.length("text") > max_text_chars),
        _section("observations", weak, ["behind", "source", "display_target", "span", "reason"], F.concat_ws(" ", "source", "display_target", "reason"), LIMITS["observations"]),
    ])


def closure_section(nodes: DataFrame, g: GraphTables, max_nodes: int = 50, max_text_chars: int = 300) -> DataFrame:
    """(graph_name, start, rank, title, depth, status, text, cut, total, truncated): the nodes of a closure with their texts.

    ``status``: present (one entity has the title), ambiguous (several) or missing (none).  The text is the
    one with the least id among those that the entities name.
    """
    held = g.entities.join(nodes.select(BY, "title").distinct(), [BY, "title"], "left_semi")
    counted = held.groupBy(BY, "title").agg(F.count_distinct("id").alias("n"))
    units = held.select(BY, "title", F.explode("text_unit_ids").alias("id")).distinct()
    texts = units.join(g.text_units.select(BY, "id", "text").where("text is not null"), [BY, "id"]).groupBy(BY, "title").agg(F.min(F.struct("id", "text"))["text"].alias("text"))
    shown = capped(nodes.select(BY, "start", "title", "depth").distinct(), [BY, "start"], ["depth", "title"], max_nodes)
    status = F.when(F.col("n") == 1, "present").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return shown.join(counted, [BY, "title"], "left").join(texts, [BY, "title"], "left").select(
        BY, "start", "rank", "title", "depth", status.alias("status"), F.substring("text", 1, max_text_chars).alias("text"), (F.length("text") > max_text_chars).alias("cut"), "total", "truncated"
    )


def type_context_gate(totals: DataFrame, require_edges: bool = True) -> DataFrame:
    """Graphs whose type closure is empty or cut: (graph_name, start, problem)."""
    problem = F.when(F.lit(require_edges) & (F.col("n_edges_total") == 0), "empty_closure").when(F.col("nodes_truncated") | F.col("edges_truncated"), "truncated_closure")
    return totals.select(BY, "start", problem.alias("problem")).where("problem is not null")
