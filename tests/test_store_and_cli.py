import io
import json

import pytest

from lodegraph import cli
from lodegraph.serve import answer, serve, truncated
from lodegraph.sources.snapshot_store import SnapshotError, SnapshotStore, canonical, is_published_id, parse_ref, revision_of

SOURCE = {
    "pkg/core.py": 'LIMIT = 3\n\n\nclass Base:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        return LIMIT\n\n\nclass Child(Base):\n    def go(self):\n        return getattr(self, "x" + "y")()\n\n\ndef main():\n    c = Child()\n    c.go()\n    return helper()\n\n\ndef helper():\n    return 1\n',
    "pkg/other.py": "from pkg.core import main\n\n\ndef call():\n    return main()\n",
    "pkg/__init__.py": "",
    "pkg/tests/test_x.py": "def test():\n    pass\n",
    "pkg/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    for name, text in SOURCE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    out = tmp_path_factory.mktemp("graph")
    args = ["index-python", "--graph", str(out), "--package", str(root)]
    first = cli.run(cli.parser().parse_args(args), spark)
    again = cli.run(cli.parser().parse_args([*args, "--reuse"]), spark)
    assert again == {"snapshot": first["snapshot"], "reused": True}
    return out, root, first["snapshot"]


def ask(spark, graph, *argv):
    return cli.run(cli.parser().parse_args([argv[0], "--graph", str(graph[0]), *argv[1:]]), spark)


def test_questions(spark, graph):
    assert ask(spark, graph, "callers", "core:helper") == ["core:main"]
    assert ask(spark, graph, "callees", "core:Base.run") == ["core:Base.step"]
    assert set(ask(spark, graph, "impact", "core:helper")) == {"core:main", "other:call"}
    assert "core:Base" in ask(spark, graph, "neighbors", "core:Child")["outgoing"]
    assert ask(spark, graph, "query-symbol", "core:main")["type"] == "fn"
    assert ask(spark, graph, "dependency-order")[0] in ("core.py", "other.py")
    assert ask(spark, graph, "audit-graph")[0]["pass_rate"] == 1.0
    assert ask(spark, graph, "type-closure", "core:main")["n_nodes_total"] == 1
    sections = {s["section"]: s for s in ask(spark, graph, "context-pack", "core:main")["sections"]}
    assert sections["neighbors"]["total"] >= 3 and any("def main" in t for t in sections["texts"]["items"])
    with pytest.raises(SnapshotError):
        ask(spark, graph, "callers", "no such thing")
    assert all(r["n_anomalies"] == 0 for r in ask(spark, graph, "doctor") if r["component"] != "call")


def test_dynamic_stamps_and_excluded_files(spark, graph):
    e = {r["title"]: r for r in SnapshotStore(spark, graph[0]).tables().entities.collect()}
    assert e["core:Child.go"]["dynamic_dependent"] and not e["core:helper"]["dynamic_dependent"]
    assert not any("test_x" in t or "broken" in t for t in e)
    assert e["core:Base.run"]["span"] == "5:0-6:0" and e["core:Base.run"]["text_unit_ids"]


def test_snapshots_pins_prune_and_export(spark, graph, tmp_path):
    out, root, first = graph
    store = SnapshotStore(spark, out)
    (root / "pkg/other.py").write_text("def call():\n    return 2\n")
    second = cli.run(cli.parser().parse_args(["index", "--graph", str(out), "--package", str(root)]), spark)["snapshot"]
    d = ask(spark, graph, "snapshot-diff", first, second)
    assert d["relationships"]["removed"]["total"] >= 1 and d["entities"]["modified"]["total"] >= 1
    assert store.history()["total"] == 2 and store.current() == second
    pins = store.pin(first, store.pins()["revision"])
    with pytest.raises(SnapshotError):
        store.pin(second, "sha256:" + "0" * 64)
    assert store.retention_plan(1)["delete"] == []
    store.unpin(first, pins["revision"])
    plan = store.retention_plan(1)
    assert plan["delete"] == [first]
    copy = tmp_path / "copy"
    export = store.export_plan(first)
    store.export_apply(copy, export["revision"], first)
    assert store.export_verify(copy, export["revision"]) and store.export_reconcile(copy, first) == {"missing": [], "extra": [], "different": []}
    (copy / "manifest.json").write_text((copy / "manifest.json").read_text() + " ")
    assert not store.export_verify(copy, export["revision"])
    with pytest.raises(SnapshotError):
        ask(spark, graph, "snapshot-prune", "--keep", "1", "--expected", plan["revision"])
    maintenance = store.maintenance_plan(1)
    assert ask(spark, graph, "snapshot-prune", "--keep", "1", "--expected", plan["revision"], "--yes")["deleted_snapshots"] == [first]
    assert store.maintenance_reconcile(maintenance)["done"] == [first] and store.ids() == [second]
    with pytest.raises(SnapshotError):
        store.activate(second, "elsewhere")
    assert store.activate(second, second) == second


def test_staging_is_cleaned_only_when_free(spark, graph):
    import fcntl

    store = SnapshotStore(spark, graph[0])
    for k, name in enumerate((".staging-" + "a" * 32, ".staging-" + "b" * 32, ".staging-odd")):
        (store.snapshots / name).mkdir()
        (store.snapshots / name / ".writer").touch()
    with (store.snapshots / (".staging-" + "b" * 32) / ".writer").open() as held:
        fcntl.flock(held, fcntl.LOCK_EX)
        found = store.staging()
        assert [r["reason"] for r in found["staging"]] == [None, "held", "name"]
        assert store.clean_staging(found["revision"]) == [".staging-" + "a" * 32]
    with pytest.raises(SnapshotError):
        store.clean_staging(found["revision"])


def test_tools(spark, graph):
    store = SnapshotStore(spark, graph[0])
    assert answer(store, {"tool": "callers", "arguments": {"symbol": "core:helper"}})["data"] == truncated(["core:main"], 100)
    assert "unknown arguments" in answer(store, {"tool": "callers", "arguments": {"symbol": "x", "colour": 1}})["error"]
    assert answer(store, {"tool": "rm"})["error"] == "unknown tool"
    sink = io.StringIO()
    serve(store, io.StringIO('{"tool": "graph_status"}\nnot json\n\n[]\n'), sink)
    lines = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert lines[0]["data"]["current"] == store.current() and "error" in lines[1] and "error" in lines[2]


def test_references_and_revisions():
    assert parse_ref(None) is None and parse_ref("current") == "current" and parse_ref("20250101-1-a") == "20250101-1-a"
    for bad in ("", " ", ".staging-x", "a/b", "a b", "..", "x\0"):
        assert not is_published_id(bad)
        with pytest.raises(SnapshotError):
            parse_ref(bad)
    assert canonical({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}' and revision_of({}) == revision_of({})
    with pytest.raises(ValueError):
        canonical({"x": float("nan")})
