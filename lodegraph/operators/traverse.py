"""Reachability, bounded closures and dependency order, for all graphs of a table at once.

Rounds expand a frontier by one join and drop what was seen by an anti-join.  After each round the
frontier is cut from its lineage by a checkpoint in the shared folder, so plans do not grow with the depth
and a lost executor costs no more than a round.  A frontier, or a seen set, of at most ``BROADCAST_ROWS``
counted rows goes to the edges instead of the edges to it, so most rounds shuffle only what they find;
larger ones are joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut_lineage

BY = "graph_name"
FOLLOWED = ("calls", "uses_data", "references", "imports", "inherits", "property", "dispatch")


#: Rows of a frontier or a seen set (about 150 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Rounds whose frontiers are kept side by side before they are written as one.
MERGE_AFTER = 4


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _merged(parts: list[DataFrame]) -> list[DataFrame]:
    """Checkpointed parts, written as one when there are many: no round writes again what it did not find."""
    return [cut_lineage(_together(parts))] if len(parts) > MERGE_AFTER else parts


def _sent(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def _hops(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(BY, F.col("source").alias("here"), F.col("target").alias("there"))
    if direction == "dependencies":
        return out
    back = out.select(BY, F.col("there").alias("here"), F.col("here").alias("there"))
    return back if direction == "users" else out.unionByName(back)


def reach(edges: DataFrame, starts: DataFrame, direction: str = "dependencies", max_depth: int | None = None) -> DataFrame:
    """(graph_name, start, title, depth): everything reached from each start, the start at depth 0.

    ``starts``: (graph_name, start).  Depths are minimal; cycles end by the anti-join.
    """
    hops = cut_lineage(_hops(edges, direction).where("here is not null and there is not null and here <> there").distinct())
    frontier = cut_lineage(starts.select(BY, "start", F.col("start").alias("title"), F.lit(0).alias("depth")).distinct())
    seen, depth = [frontier], 0
    n = total = frontier.count()
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        step = hops.join(_sent(frontier, n), (frontier[BY] == hops[BY]) & (frontier["title"] == hops["here"])).select(
            frontier[BY], frontier["start"], hops["there"].alias("title")
        )
        new = step.distinct().join(_sent(_together(seen), total), [BY, "start", "title"], "left_anti")
        frontier = cut_lineage(new.withColumn("depth", F.lit(depth)))
        n = frontier.count()
        if n:
            seen, total = _merged([*seen, frontier]), total + n
    return _together(seen)


def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Transitive callers of each start; the start itself is left out even inside a cycle."""
    calls = edges.where("type = 'calls'")
    return reach(calls, starts, "users").where("title <> start").select(BY, "start", "title")


class ClosureError(ValueError):
    """The edges do not have the form a closure needs."""


def check_closure_edges(edges: DataFrame) -> None:
    """Blank ids and endpoints and repeated ids are errors, not rows to drop."""
    bad = edges.agg(
        F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("id"),
        F.count_if(F.coalesce(F.trim("source"), F.lit("")) == "").alias("source"),
        F.count_if(F.coalesce(F.trim("target"), F.lit("")) == "").alias("target"),
    ).first()
    for field in ("id", "source", "target"):
        if bad[field]:
            raise ClosureError(f"{bad[field]} uses_type rows have an invalid {field}")
    if not edges.groupBy(BY, "id").count().where("count > 1").isEmpty():
        raise ClosureError("a uses_type id occurs twice")


def type_closure(edges: DataFrame, starts: DataFrame, direction: str = "dependencies", max_depth: int = 3, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_name, start, title, depth) and edges (.., id, source, target, depth) of the closure.

    An edge has the depth of the end that is expanded, the smaller one if both are; self-edges are
    edges and add no node; with ``max_depth`` 0 there is the root and no edge.
    """
    if direction not in ("dependencies", "users", "both"):
        raise ClosureError(f"unknown direction {direction!r}")
    if max_depth < 0:
        raise ClosureError("max_depth must not be negative")
    uses = edges.where("type = 'uses_type'").select(BY, "id", "source", "target")
    if check:
        check_closure_edges(uses)
    nodes = reach(uses, starts, direction, max_depth)
    inner = nodes.where(F.col("depth") < max_depth)
    ends = {"dependencies": ["source"], "users": ["target"], "both": ["source", "target"]}[direction]
    found = None
    for end in ends:
        part = uses.join(inner.withColumnRenamed("title", end), [BY, end]).select(BY, "start", "id", "source", "target", "depth")
        found = part if found is None else found.unionByName(part)
    return nodes, found.groupBy(BY, "start", "id", "source", "target").agg(F.min("depth").alias("depth"))


def closure_totals(nodes: DataFrame, edges: DataFrame, max_nodes: int = 50, max_edges: int = 100) -> DataFrame:
    """Exact totals, how many a capped answer returns, and whether it is truncated."""

    def of(df: DataFrame, what: str, cap: int) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy(BY, "start").agg(n.alias(f"n_{what}_total"), F.least(n, F.lit(cap)).alias(f"n_{what}_returned"), (n > cap).alias(f"{what}_truncated"))

    joined = of(nodes, "nodes", max_nodes).join(of(edges, "edges", max_edges), [BY, "start"], "left")
    return joined.fillna({"n_edges_total": 0, "n_edges_returned": 0, "edges_truncated": False})


def adequacy_closure(edges: DataFrame, entities: DataFrame, starts: DataFrame, follow: tuple[str, ...] = FOLLOWED) -> DataFrame:
    """Entities reached from the starts over the edge types a port has to carry."""
    reached = reach(edges.where(F.col("type").isin(*follow)), starts).select(BY, "start", "title", "depth")
    return reached.join(entities.select(BY, "title").distinct(), [BY, "title"], "left_semi").select(BY, "start", "title", "depth")


def adequacy(closure: DataFrame, must_reach: list[str], must_exclude: list[str]) -> DataFrame:
    """Per start: size, how many required titles are missing, how many excluded ones leaked in."""
    t = F.col("title")
    reached = F.countDistinct(F.when(t.isin(*must_reach), t)) if must_reach else F.lit(0)
    leaked = F.countDistinct(F.when(t.isin(*must_exclude), t)) if must_exclude else F.lit(0)
    return closure.groupBy(BY, "start").agg(
        F.count(F.lit(1)).alias("size"), (F.lit(len(set(must_reach))) - reached).alias("n_missing"), leaked.alias("n_leaked")
    )


def dependency_order(edges: DataFrame) -> DataFrame:
    """(graph_name, title, level) over ``contains``: parents before children, cycles and what hangs off them last.

    Every round peels the nodes whose parents are all peeled; only children of the last round's nodes are
    looked at. What cannot be peeled gets level null.
    """
    contains = cut_lineage(edges.where("type = 'contains' and source is not null and target is not null").select(BY, "source", "target").distinct())
    nodes = contains.select(BY, F.col("source").alias("title")).union(contains.select(BY, F.col("target"))).distinct()
    targets = contains.select(BY, F.col("target").alias("title")).distinct()
    free = cut_lineage(nodes.join(targets, [BY, "title"], "left_anti").withColumn("level", F.lit(0)))
    n, done, level, total = free.count(), [], 0, 0
    while n:
        done, level, total = _merged([*done, free]), level + 1, total + n
        freed = _sent(free.select(BY, F.col("title").alias("source")), n)
        children = cut_lineage(contains.join(freed, [BY, "source"], "left_semi").select(BY, F.col("target").alias("title")).distinct())
        n_children = children.count()
        peeled = _sent(_together(done).select(BY, F.col("title").alias("source")), total)
        still = (
            contains.join(_sent(children.withColumnRenamed("title", "target"), n_children), [BY, "target"], "left_semi")
            .join(peeled, [BY, "source"], "left_anti").select(BY, F.col("target").alias("title")).distinct()
        )
        free = cut_lineage(children.join(still, [BY, "title"], "left_anti").withColumn("level", F.lit(level)))
        n = free.count()
    rest = nodes.select(BY, "title")
    if done:
        rest = rest.join(_sent(_together(done).select(BY, "title"), total), [BY, "title"], "left_anti")
    return _together([*done, rest.withColumn("level", F.lit(None).cast("int"))])


def linearise(bases: dict[str, list[str]], start: str) -> list[str] | None:
    """C3 linearisation over known classes; None for an unknown base, a cycle or no consistent order."""
    visiting: set[str] = set()

    def order(name: str) -> list[str] | None:
        if name not in bases or name in visiting:
            return None
        visiting.add(name)
        tails = []
        for b in bases[name]:
            sub = order(b)
            if sub is None:
                return None
            tails.append(list(sub))
        visiting.discard(name)
        tails.append(list(bases[name]))
        out = [name]
        while tails := [t for t in tails if t]:
            head = next((t[0] for t in tails if not any(t[0] in u[1:] for u in tails)), None)
            if head is None:
                return None
            out.append(head)
            tails = [t[1:] if t[0] == head else t for t in tails]
        return out

    return order(start)


def linearisations(classes: DataFrame) -> DataFrame:
    """``classes``: (graph_name, source_file, title, bases array<string>) -> (.., title, mro array<string>).

    One group per file: the order is sequential and a file is small.
    """

    def per_file(table):
        import pyarrow as pa

        rows = table.to_pylist()
        bases = {r["title"]: list(dict.fromkeys(r["bases"] or [])) for r in rows}
        mro = [linearise(bases, t) for t in bases]
        return pa.table(
            {"graph_name": pa.array([rows[0]["graph_name"]] * len(bases)), "source_file": pa.array([rows[0]["source_file"]] * len(bases)),
             "title": pa.array(list(bases)), "mro": pa.array(mro, pa.list_(pa.string()))}
        )

    return classes.groupBy(BY, "source_file").applyInArrow(per_file, "graph_name string, source_file string, title string, mro array<string>")


def nearest_definition(inherits: DataFrame, members: DataFrame, starts: DataFrame) -> DataFrame:
    """The closest class up the bases that defines a member: (graph_name, start, member, owner, depth).

    ``inherits``: edges class -> base; ``members``: (graph_name, title of the class, member).
    """
    up = reach(inherits, starts)
    owned = up.join(members, [BY, "title"])
    return owned.groupBy(BY, "start", "member").agg(
        F.min_by("title", F.struct("depth", "title")).alias("owner"), F.min("depth").alias("depth")
    )


def include_edges(trace: DataFrame) -> DataFrame:
    """Direct includes from an indented trace: (unit, ord, depth, path) -> (unit, ord, parent, path, jump).

    The parent of a line is the last line before it that is one level up; depth 1 hangs off the unit.
    A line more than one level below its predecessor has no parent and is marked as a jump.
    One group per translation unit: the stack is sequential and a trace is one compiler run's output.
    """

    def per_unit(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
        stack: list[str] = []
        parents = []
        for r in rows:
            d = r["depth"]
            if 1 <= d <= len(stack) + 1:
                parents.append(stack[d - 2] if d > 1 else r["unit"])
                stack[d - 1 :] = [r["path"]]
            else:
                parents.append(None)
        return pa.table(
            {"unit": pa.array([r["unit"] for r in rows], pa.string()), "ord": pa.array([r["ord"] for r in rows], pa.int64()),
             "parent": pa.array(parents, pa.string()), "path": pa.array([r["path"] for r in rows], pa.string()),
             "jump": pa.array([p is None for p in parents])}
        )

    source = trace.select("unit", F.col("ord").cast("bigint").alias("ord"), F.col("depth").cast("int").alias("depth"), "path")
    return source.groupBy("unit").applyInArrow(per_unit, "unit string, ord bigint, parent string, path string, jump boolean")
