"""Command line: index, ask, audit and administer a graph.  ``python -m lodegraph.cli COMMAND --graph DIR``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import audit, contracts, diff, lookup, pack, traverse
from lodegraph.sources.snapshot_store import SnapshotError, SnapshotStore
from lodegraph.tables import GraphTables

BY = "graph_name"


def session() -> SparkSession:
    return SparkSession.builder.appName("lodegraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Graph:
    """One snapshot of one graph, asked by symbol."""

    def __init__(self, store: SnapshotStore, snapshot: str | None = None):
        self.store, self.snapshot = store, snapshot
        t = store.tables(snapshot)
        self.t = GraphTables(**{n: df.withColumn(BY, F.lit("graph")) for n, df in t.named().items()})

    def title(self, query: str) -> str:
        got = lookup.resolve(self.t.entities, [query]).first()
        if got is None or got["title"] is None:
            strict = lookup.resolve(self.t.entities, [query], strict=True).first()
            raise SnapshotError(f"{query!r} fits {strict['candidates'] if strict else 0} symbols")
        return got["title"]

    def _names(self, df: DataFrame) -> list[str]:
        return [r["title"] for r in df.select("title").distinct().orderBy("title").collect()]

    def query_symbol(self, symbol):
        return lookup.symbol_card(self.t.entities, self.title(symbol)).drop(BY).first().asDict()

    def callers(self, symbol):
        return self._names(lookup.callers(self.t.relationships, self.title(symbol)))

    def callees(self, symbol):
        return self._names(lookup.callees(self.t.relationships, self.title(symbol)))

    def types_used_by(self, symbol):
        return self._names(lookup.types_used_by(self.t.relationships, self.title(symbol)))

    def type_users(self, symbol):
        return self._names(lookup.type_users(self.t.relationships, self.title(symbol)))

    def neighbors(self, symbol):
        got = lookup.neighbors(self.t.relationships, self.title(symbol)).orderBy("direction", "title").collect()
        return {d: [r["title"] for r in got if r["direction"] == d] for d in ("incoming", "outgoing")}

    subgraph = neighbors

    def _start(self, symbol):
        return self.t.entities.where(F.col("title") == self.title(symbol)).select(BY, F.col("title").alias("start")).distinct()

    def impact(self, symbol):
        return self._names(traverse.impact(self.t.relationships, self._start(symbol)))

    def type_closure(self, symbol, direction="dependencies", max_depth=3, max_nodes=50, max_edges=100):
        nodes, edges = traverse.type_closure(self.t.relationships, self._start(symbol), direction, int(max_depth))
        n = [r.asDict() for r in nodes.select("title", "depth").orderBy("depth", "title").limit(int(max_nodes)).collect()]
        e = [r.asDict() for r in edges.select("id", "source", "target", "depth").orderBy("depth", "source", "target", "id").limit(int(max_edges)).collect()]
        return {"nodes": n, "edges": e, "n_nodes_total": nodes.count(), "n_edges_total": edges.count()}

    def dependency_order(self):
        return [r["title"] for r in traverse.dependency_order(self.t.relationships).orderBy(F.asc_nulls_last("level"), "title").collect()]

    def observations(self, symbol):
        got = lookup.resolve(self.t.entities, [symbol]).first()
        title = got["title"] if got else None
        if title is None:
            rows = lookup.observations(self.t.call_observations, symbol, "prefix")
        else:
            module = self.t.entities.where(F.col("title") == title).first()["type"] == "module"
            rows = lookup.observations(self.t.call_observations, title, "module" if module else "symbol")
        return [r.asDict() for r in rows.drop(BY).collect()]

    def context_pack(self, symbol, max_text_chars=300):
        got = pack.context_pack(self.t, self.title(symbol), int(max_text_chars)).first()
        return json.loads(got["pack_json"]) if got else {}

    def audit_graph(self):
        calls = self.t.relationships.where("type = 'calls'")
        return [r.asDict() for r in audit.audit_report(self.t.entities, calls).drop(BY).collect()]

    def doctor(self):
        return contracts.doctor(self.t.named(), self.store.manifest(self.snapshot))


def snapshot_diff(store: SnapshotStore, before: str, after: str, limit: int = 50) -> dict:
    a, b = store.tables(before), store.tables(after)
    out = {}
    for name in ("entities", "relationships", "text_units"):
        x, y = getattr(a, name), getattr(b, name)
        for df in (x, y):
            diff.check_ids(df, ["id"])
            diff.check_finite(df)
        found = diff.row_diff(x, y, ["id"])
        totals = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
        samples = diff.diff_samples(found, [], "id", limit).collect()
        out[name] = {c: {"total": totals.get(c, 0), "ids": [r["id"] for r in samples if r["change"] == c]} for c in ("added", "removed", "modified")}
    return out


#: command -> (arguments of the command line, what it does)
ASKS = ("query-symbol", "callers", "callees", "types-used-by", "type-users", "neighbors", "subgraph", "impact", "observations", "context-pack", "type-closure")
PLAIN = ("dependency-order", "audit-graph", "doctor")
ADMIN = {
    "snapshot-history": lambda s, a: s.history(a.limit), "snapshot-pins": lambda s, a: s.pins(), "snapshot-pin": lambda s, a: s.pin(a.snapshot, a.expected),
    "snapshot-unpin": lambda s, a: s.unpin(a.snapshot, a.expected), "snapshot-activate": lambda s, a: s.activate(a.snapshot, a.expected),
    "snapshot-retention-plan": lambda s, a: s.retention_plan(a.keep), "snapshot-prune": lambda s, a: s.prune(a.keep, a.expected), "snapshot-staging": lambda s, a: s.staging(),
    "snapshot-staging-cleanup-plan": lambda s, a: s.staging(), "snapshot-staging-cleanup": lambda s, a: s.clean_staging(a.expected),
    "snapshot-maintenance-plan": lambda s, a: s.maintenance_plan(a.keep), "snapshot-maintenance-apply": lambda s, a: s.maintenance_apply(a.keep, a.expected),
    "snapshot-maintenance-reconcile": lambda s, a: s.maintenance_reconcile(json.loads(a.expected)), "snapshot-export-plan": lambda s, a: s.export_plan(a.snapshot),
    "snapshot-export-apply": lambda s, a: s.export_apply(a.target, a.expected, a.snapshot), "snapshot-export-verify": lambda s, a: s.export_verify(a.target, a.expected),
    "snapshot-export-reconcile": lambda s, a: s.export_reconcile(a.target, a.snapshot), "snapshot-export-staging": lambda s, a: s.export_staging(a.target),
    "snapshot-export-staging-cleanup-plan": lambda s, a: s.export_cleanup_plan(a.target), "adopt-publication-lock": lambda s, a: s.adopt_lock(), "graph-status": lambda s, a: s.status(),
}
#: Commands that change files need this flag besides the revision.
CONFIRMED = {"snapshot-prune", "snapshot-staging-cleanup", "snapshot-maintenance-apply", "snapshot-export-apply"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "index-python", "index-c", *ASKS, *PLAIN, *ADMIN, "snapshot-diff", "mcp"):
        c = sub.add_parser(name)
        c.add_argument("--graph", required=True)
        c.add_argument("--snapshot")
        if name in ("index", "index-python", "index-c"):
            c.add_argument("--package", required=True)
            c.add_argument("--keep", type=int, default=5)
            c.add_argument("--reuse", action="store_true")
        elif name in ASKS:
            c.add_argument("symbol")
            if name == "type-closure":
                c.add_argument("--direction", default="dependencies")
                c.add_argument("--max-depth", type=int, default=3)
            if name == "context-pack":
                c.add_argument("--max-text-chars", type=int, default=300)
        elif name == "snapshot-diff":
            c.add_argument("before")
            c.add_argument("after")
            c.add_argument("--limit", type=int, default=50)
        elif name in ADMIN:
            c.add_argument("--expected", default="")
            c.add_argument("--keep", type=int, default=5)
            c.add_argument("--limit", type=int, default=20)
            c.add_argument("--target")
            c.add_argument("--yes", action="store_true")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None):
    name = args.command
    if name in ADMIN:
        if name in CONFIRMED and not args.yes:
            raise SnapshotError(f"{name} changes files; say --yes")
        return ADMIN[name](SnapshotStore(None, args.graph), args)
    spark = spark or session()
    store = SnapshotStore(spark, args.graph)
    if name in ("index", "index-python", "index-c"):
        from lodegraph.plans.index import index_c, index_python, input_fingerprint
        from lodegraph.sources.files import c_sources, python_sources

        in_c = name == "index-c" or (name == "index" and c_sources(spark, args.package).limit(1).count() > 0)
        sources, build = (c_sources, index_c) if in_c else (python_sources, index_python)
        mark = input_fingerprint(sources(spark, args.package))
        options = {"indexer": "c" if in_c else "python"}
        if args.reuse and (old := store.reusable(mark, options)):
            return {"snapshot": old, "reused": True}
        tables = build(spark, args.package)
        published = store.publish(tables, args.keep, {"input_fingerprint": mark, "options": options})
        if input_fingerprint(sources(spark, args.package)) != mark:
            raise SnapshotError("the source changed while it was indexed")
        return {"snapshot": published, "reused": False}
    if name == "snapshot-diff":
        return snapshot_diff(store, args.before, args.after, args.limit)
    if name == "mcp":
        from lodegraph.serve import serve

        return serve(store, sys.stdin, sys.stdout)
    g = Graph(store, args.snapshot)
    call = getattr(g, name.replace("-", "_"))
    if name == "type-closure":
        return call(args.symbol, args.direction, args.max_depth)
    if name == "context-pack":
        return call(args.symbol, args.max_text_chars)
    return call(args.symbol) if name in ASKS else call()


def main(argv: list[str] | None = None) -> int:
    """Exit code 0: done; 1: something does not hold; 2: usage."""
    args = parser().parse_args(argv)
    try:
        result = run(args)
    except (SnapshotError, traverse.ClosureError, diff.RowIndexError) as e:
        print(e, file=sys.stderr)
        return 1
    if result is not None:
        print(json.dumps(result, indent=1, default=str, ensure_ascii=False))
    failed = args.command == "doctor" and any(r["n_anomalies"] for r in result) or args.command == "snapshot-export-verify" and not result
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
