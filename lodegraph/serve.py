"""Read-only tools over standard input: one JSON request a line, one JSON answer a line."""

from __future__ import annotations

import inspect
import json

from lodegraph.sources.snapshot_store import SnapshotError, SnapshotStore

#: An answer larger than this is replaced by an error.
MAX_BYTES = 1_000_000
TOOLS = ("graph_status", "graph_doctor", "query_symbol", "callers", "callees", "neighbors", "impact", "type_closure", "context_pack", "snapshot_history", "snapshot_diff")


def truncated(items: list, n: int) -> dict:
    """The first n items with the exact total."""
    return {"items": items[:n], "total": len(items), "returned": min(n, len(items)), "truncated": len(items) > n}


def answer(store: SnapshotStore, request: dict) -> dict:
    from lodegraph.cli import Graph, snapshot_diff

    tool, arguments = request.get("tool"), dict(request.get("arguments") or {})
    if tool not in TOOLS:
        return {"tool": tool, "error": "unknown tool"}
    limit = min(max(int(arguments.pop("limit", 100)), 0), 500)
    snapshot = arguments.pop("snapshot", None)
    try:
        if tool == "graph_status":
            call = store.status
        elif tool == "snapshot_history":
            call = lambda: store.history(limit)
        elif tool == "snapshot_diff":
            call = lambda before, after: snapshot_diff(store, before, after, limit)
        else:
            call = getattr(Graph(store, snapshot), {"graph_doctor": "doctor"}.get(tool, tool))
        unknown = arguments.keys() - inspect.signature(call).parameters.keys()
        if unknown:
            return {"tool": tool, "error": f"unknown arguments: {', '.join(sorted(unknown))}"}
        data = call(**arguments)
    except (SnapshotError, ValueError, TypeError) as e:
        return {"tool": tool, "error": str(e)}
    out = {"tool": tool, "data": truncated(data, limit) if isinstance(data, list) else data}
    text = json.dumps(out, default=str)
    return out if len(text.encode()) <= MAX_BYTES else {"tool": tool, "error": f"the answer has more than {MAX_BYTES} bytes"}


def serve(store: SnapshotStore, source, sink) -> None:
    for line in source:
        if line.strip():
            try:
                request = json.loads(line)
                result = answer(store, request) if isinstance(request, dict) else {"error": "a request is an object"}
            except ValueError as e:
                result = {"error": str(e)}
            sink.write(json.dumps(result, default=str) + "\n")
            sink.flush()
