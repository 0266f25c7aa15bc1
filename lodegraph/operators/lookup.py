"""Finding symbols and their direct neighbours, in all graphs of a table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BY = "graph_name"


def _stages(query: str) -> list[tuple[str, Column]]:
    t, kind = F.col("title"), F.col("type")
    alias = (t == query) | (t == f"{query}:{query}") | (t == f"{query}:__module__") | (t.endswith(f":{query}") & (kind == "module"))
    return [("exact", t == query), ("module", alias & (kind == "module")), ("pattern", t.rlike(f"(?i){query}"))]


def resolve(entities: DataFrame, queries: list[str], strict: bool = False) -> DataFrame:
    """(graph_name, query, title, stage, candidates) of each query in each graph.

    A stage decides if exactly one title fits: the exact title, then a module alias, then a
    case-insensitive pattern.  ``strict`` stops at the first stage that fits several titles; otherwise
    such a stage is passed over.  Without a decision the title is null; ``candidates`` is how many
    titles the deciding (or stopping, or last) stage had.  All queries share one aggregation.
    """
    titles = entities.select(BY, "title", "type").distinct()
    aggs = []
    for i, q in enumerate(queries):
        for name, fits in _stages(q):
            aggs += [F.count_if(fits).alias(f"n_{i}_{name}"), F.max(F.when(fits, F.col("title"))).alias(f"t_{i}_{name}")]
    counted = titles.groupBy(BY).agg(*aggs)
    rows = []
    for i, q in enumerate(queries):
        title, stage = F.lit(None).cast("string"), F.lit(None).cast("string")
        n = F.col(f"n_{i}_pattern")
        for name in ("pattern", "module", "exact"):
            count = F.col(f"n_{i}_{name}")
            decides = count >= 1 if strict else count == 1
            title = F.when(decides, F.when(count == 1, F.col(f"t_{i}_{name}"))).otherwise(title)
            stage = F.when(decides, F.lit(name)).otherwise(stage)
            n = F.when(decides, count).otherwise(n)
        rows.append(F.struct(F.lit(q).alias("query"), title.alias("title"), stage.alias("stage"), n.alias("candidates")))
    return counted.select(BY, F.explode(F.array(*rows)).alias("r")).select(BY, "r.*")


def get_entity(entities: DataFrame, title: str) -> DataFrame:
    return entities.where(F.col("title") == title)


def symbol_card(entities: DataFrame, title: str, snippet_chars: int = 200) -> DataFrame:
    return get_entity(entities, title).select(
        BY, "title", "type", "description", "source_file", "span", F.substring("snippet", 1, snippet_chars).alias("snippet")
    )


def _one_hop(edges: DataFrame, here: str, there: str, title: str, kinds: list[str] | None) -> DataFrame:
    picked = edges.where(F.col(here) == title)
    if kinds:
        picked = picked.where(F.col("type").isin(*kinds))
    return picked.where(F.col(there).isNotNull()).select(BY, F.col(there).alias("title")).distinct()


def callers(edges: DataFrame, title: str) -> DataFrame:
    return _one_hop(edges, "target", "source", title, ["calls"])


def callees(edges: DataFrame, title: str) -> DataFrame:
    return _one_hop(edges, "source", "target", title, ["calls"])


def types_used_by(edges: DataFrame, title: str) -> DataFrame:
    return _one_hop(edges, "source", "target", title, ["uses_type"])


def type_users(edges: DataFrame, title: str) -> DataFrame:
    return _one_hop(edges, "target", "source", title, ["uses_type"])


def neighbors(edges: DataFrame, title: str) -> DataFrame:
    """Both directions over all edge types; a self-edge shows in both."""
    come = _one_hop(edges, "target", "source", title, None).select(BY, F.lit("incoming").alias("direction"), "title")
    go = _one_hop(edges, "source", "target", title, None).select(BY, F.lit("outgoing").alias("direction"), "title")
    return come.unionByName(go)


subgraph = neighbors


def observations(observed: DataFrame, title: str, kind: str = "symbol") -> DataFrame:
    """Weak facts of a symbol (it or its members), a module (it or what it holds), or a raw prefix."""
    source = F.col("source")
    prefix = title.split(":", 1)[0]
    test = {
        "symbol": (source == title) | source.startswith(title + "."),
        "module": (source == title) | (source == prefix) | source.startswith(prefix + ":"),
        "prefix": source.startswith(title),
    }[kind]
    return observed.where(test).select(BY, "source", "display_target", "confidence", "reason", "source_file", "span")


def incident_edges(edges: DataFrame, title: str, entity_id: str) -> DataFrame:
    """Edges that name the entity by title or by id on either side."""
    return edges.where(F.col("source").isin(title, entity_id) | F.col("target").isin(title, entity_id))


def text_units_of(text_units: DataFrame, owners: DataFrame) -> DataFrame:
    """Text units that an owner lists in ``text_unit_ids``: a semi-join, units are not multiplied."""
    ids = owners.select(BY, F.explode("text_unit_ids").alias("id")).distinct()
    return text_units.join(ids, [BY, "id"], "left_semi")


def packable(entities: DataFrame) -> DataFrame:
    return entities.where(~F.col("type").isin("class", "module", "file"))


def sparse_edge(edges: DataFrame) -> DataFrame:
    """Each edge as one JSON text without null fields."""
    fields = [c for c in ("source", "target", "type", "confidence", "is_deterministic", "resolved_target_hint", "span") if c in edges.columns]
    return edges.select(BY, "id", F.to_json(F.struct(*fields)).alias("edge_json"))


def decode_observations(edges: DataFrame, column: str, limit: int) -> DataFrame:
    """A bounded sample of a JSON list column with its exact total and an error text for broken JSON."""
    items = F.from_json(F.col(column), "array<string>")
    return edges.select(
        BY,
        "id",
        F.slice(items, 1, limit).alias("sample"),
        F.coalesce(F.size(items), F.lit(0)).alias("total"),
        F.when(F.col(column).isNotNull() & items.isNull(), F.lit("malformed")).alias("error"),
    )
