import json
from random import Random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import audit, construct, contracts, diff, intervals, lookup, measures, pack, traverse, windows
from lodegraph.tables import GraphTables

EDGE = "graph_name string, id string, source string, target string, type string"


def edges(spark, pairs, kind="calls", g="g"):
    return spark.createDataFrame([(g, f"r{i}", a, b, kind) for i, (a, b) in enumerate(pairs)], EDGE)


def starts(spark, *names):
    return spark.createDataFrame([("g", n) for n in names], "graph_name string, start string")


def titles(df):
    return sorted(r["title"] for r in df.collect())


# --- lookup


def test_resolve_cascade_and_strictness(spark):
    e = spark.createDataFrame([("g", t, k) for t, k in (("m:f", "fn"), ("m:__module__", "module"), ("a:x", "fn"), ("b:x", "fn"), ("Z:only", "fn"), ("a:x", "fn"))], "graph_name string, title string, type string")
    got = {r["query"]: (r["title"], r["stage"], r["candidates"]) for r in lookup.resolve(e, ["m:f", "m", "x", "ONLY", ":x$", "none"]).collect()}
    assert got["m:f"] == ("m:f", "exact", 1) and got["m"] == ("m:__module__", "module", 1) and got["ONLY"] == ("Z:only", "pattern", 1)
    assert got["x"][0] is None and got[":x$"] == (None, None, 2) and got["none"] == (None, None, 0)
    strict = {r["query"]: (r["title"], r["stage"], r["candidates"]) for r in lookup.resolve(e, [":x$"], strict=True).collect()}
    assert strict[":x$"] == (None, "pattern", 2)


def test_self_edges_show_in_both_directions(spark, rows):
    assert rows(lookup.neighbors(edges(spark, [("a", "a"), ("a", "b"), (None, "a")]), "a")) == [("g", "incoming", "a"), ("g", "outgoing", "a"), ("g", "outgoing", "b")]


# --- traversals


def test_impact_leaves_out_its_start_in_a_cycle(spark):
    assert titles(traverse.impact(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]), starts(spark, "a"))) == ["b", "c", "d"]


def test_closure_depths_self_edges_and_limits(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("x", "a"), ("b", "a")], "uses_type")
    nodes, found = traverse.type_closure(e, starts(spark, "a"), "dependencies", 2)
    assert {r["title"]: r["depth"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {(r["source"], r["target"]): r["depth"] for r in found.collect()} == {("a", "b"): 0, ("a", "a"): 0, ("b", "c"): 1, ("b", "a"): 1}
    nodes, found = traverse.type_closure(e, starts(spark, "a"), "dependencies", 0)
    assert titles(nodes) == ["a"] and found.count() == 0
    nodes, found = traverse.type_closure(e, starts(spark, "a"), "both", 1)
    assert titles(nodes) == ["a", "b", "x"] and {(r["source"], r["target"]): r["depth"] for r in found.collect()}[("b", "a")] == 0
    totals = traverse.closure_totals(*traverse.type_closure(e, starts(spark, "a"), "dependencies", 3), max_nodes=2, max_edges=9).first()
    assert (totals["n_nodes_total"], totals["n_nodes_returned"], totals["nodes_truncated"], totals["edges_truncated"]) == (4, 2, True, False)


def test_closure_refuses_malformed_edges(spark):
    for pair in ((" ", "b"), ("a", None)):
        with pytest.raises(traverse.ClosureError):
            traverse.type_closure(edges(spark, [pair], "uses_type"), starts(spark, "a"))
    twice = edges(spark, [("a", "b")], "uses_type").unionByName(edges(spark, [("c", "d")], "uses_type"))
    with pytest.raises(traverse.ClosureError):
        traverse.type_closure(twice, starts(spark, "a"))
    with pytest.raises(traverse.ClosureError):
        traverse.type_closure(edges(spark, []), starts(spark, "a"), "sideways")


def test_order_puts_cycles_and_what_hangs_off_them_last(spark):
    e = edges(spark, [("r", "a"), ("a", "b"), ("r", "b"), ("x", "y"), ("y", "x"), ("y", "z")], "contains")
    assert {r["title"]: r["level"] for r in traverse.dependency_order(e).collect()} == {"r": 0, "a": 1, "b": 2, "x": None, "y": None, "z": None}
    assert traverse.dependency_order(edges(spark, [], "contains")).count() == 0


def test_linearisation():
    bases = {"O": [], "A": ["O"], "B": ["O"], "C": ["A", "B"], "D": ["B", "A"], "E": ["C", "D"], "U": ["unknown"], "L": ["L"]}
    assert traverse.linearise(bases, "C") == ["C", "A", "B", "O"]
    assert traverse.linearise(bases, "E") is None and traverse.linearise(bases, "U") is None and traverse.linearise(bases, "L") is None


def test_nearest_definition_and_adequacy(spark, rows):
    up = edges(spark, [("C", "B"), ("B", "A")], "inherits")
    members = spark.createDataFrame([("g", "A", "f"), ("g", "B", "f"), ("g", "A", "h")], "graph_name string, title string, member string")
    assert rows(traverse.nearest_definition(up, members, starts(spark, "C"))) == [("g", "C", "f", "B", 1), ("g", "C", "h", "A", 2)]
    e = edges(spark, [("a", "b"), ("b", "external")])
    known = spark.createDataFrame([("g", "a"), ("g", "b")], "graph_name string, title string")
    closed = traverse.adequacy_closure(e, known, starts(spark, "a"))
    assert rows(traverse.adequacy(closed, ["b", "c"], ["a"])) == [("g", "a", 2, 1, 1)]


def test_include_trace(spark, rows):
    t = spark.createDataFrame([("u.c", ". a.h\n.. b.h\nnoise\n.. c.h\n. d.h\n... jump.h")], "unit string, text string")
    got = rows(traverse.include_edges(construct.include_trace(t)).select("parent", "path", "jump"))
    assert got == sorted([("u.c", "a.h", False), ("a.h", "b.h", False), ("a.h", "c.h", False), ("u.c", "d.h", False), (None, "jump.h", True)], key=repr)


# --- audits


def test_structural_audit_and_rates(spark, rows):
    ents = spark.createDataFrame([("g", "f", "10:0-20:1"), ("g", "m", "module"), ("g", "t", "1:0-2:0"), ("h", "q", None)], "graph_name string, title string, span string")
    calls = spark.createDataFrame([("g", "f", "t", "15:2"), ("g", "f", "t", "30:1"), ("g", "m", "t", "1:1"), ("g", "no", "gone", "1:1"), ("g", "f", "t", "module"), ("g", "f", "t", None)], "graph_name string, source string, target string, span string")
    assert rows(audit.structural_audit(ents, calls).select("kind", "source", "caller_range")) == sorted([("span_outside_caller", "f", "10-20"), ("caller_no_span", "m", None), ("no_caller_entity", "no", None)], key=repr)
    assert rows(audit.dangling_targets(ents, calls)) == [("g", "no", "gone", "1:1")]
    report = {r["graph_name"]: r["pass_rate"] for r in audit.audit_report(ents, calls).collect()}
    assert report == {"g": round((6 - 3 - 1) / 6, 4), "h": 1.0}


def test_suspicions(spark, rows):
    ents = spark.createDataFrame([("g", "physics:update", "fn"), ("g", "re:match", "fn")], "graph_name string, title string, type string")
    d = "x calls y (ast Attribute: {} -> {})"
    calls = spark.createDataFrame([
        ("g", "a", "re:match", "1:1", d.format("obj.match", "obj.match"), "f.py"), ("g", "a", "physics:update", "2:1", d.format("physics.update", "physics.update"), "f.py"),
        ("g", "a", "re:match", "3:1", d.format("obj.other", "x"), "f.py"), ("g", "a", "re:match", "4:1", "plain call", "f.py"), ("g", "b", "re:match", "5:1", d.format("rx.match", "unknown (guess)"), "f.py"),
    ], "graph_name string, source string, target string, span string, description string, source_file string").withColumns({"confidence": F.lit(0.8), "is_deterministic": F.lit(True)})
    assert [r[2] for r in rows(audit.semantic_suspicions(ents, calls).select("source", "target", "span"))] == ["1:1", "5:1"]
    imports = spark.createDataFrame([("g", "f.py", "rx", "re")], "graph_name string, source_file string, receiver string, module string")
    assert [r[0] for r in rows(audit.semantic_suspicions(ents, calls, imports).select("span"))] == ["1:1"]


def test_constructor_endpoints_and_scores(spark, rows):
    known = spark.createDataFrame([("g", "C")], "graph_name string, title string")
    e = edges(spark, [("a", "C.__init__"), ("a", "D.__new__"), ("C.__call__", "C"), ("", "x"), ("a", "C")])
    assert rows(audit.normalised_edges(e, known)) == [("g", "a", "C"), ("g", "a", "D.__new__")]
    s = audit.edge_scores(edges(spark, [("a", "b"), ("a", "c")]), edges(spark, [("a", "b"), ("x", "y")])).first()
    assert (s["n_confirmed"], s["n_missed"], s["n_unconfirmed"], s["recall"], s["coverage"]) == (1, 1, 1, 0.5, 0.5)
    only = audit.edge_scores(edges(spark, []), edges(spark, [("a", "b")])).first()
    assert only["recall"] == 0.0 and only["coverage"] is None


def test_calls_are_matched_one_to_one(spark, rows):
    schema = "row_id int, caller string, path string, target string, byte_offset int, line int, col int"
    a = spark.createDataFrame([(1, "f", "p", "t", 5, 1, 1), (2, "f", "p", "t", 5, 1, 1), (3, "f", "p", "t", None, 2, 2), (4, "f", "p", "q", 9, 9, 9)], schema)
    b = spark.createDataFrame([(10, "f", "p", "t", 5, 1, 1), (11, "f", "p", "t", 7, 2, 2), (12, "f", "p", "z", 1, 1, 1)], schema)
    assert rows(audit.match_calls(a, b)) == sorted([(1, 10, "matched_offset"), (3, 11, "matched_position"), (2, None, "compiler_only"), (4, None, "compiler_only"), (None, 12, "stated_only")], key=repr)


def test_definitions_declarations_and_type_uses(spark, rows):
    d = "path string, name string, line int"
    got = rows(audit.match_definitions(spark.createDataFrame([("p", "a", 1), ("p", "b", 1), ("p", "c", 1), ("p", "d", 1), ("p", "d", 9)], d), spark.createDataFrame([("p", "a", 3), ("p", "b", 9), ("p", "d", 1), ("p", "e", 1)], d)))
    assert {n: k for _, n, k in got} == {"a": "matched", "b": "ambiguous", "c": "compiler_only", "d": "ambiguous", "e": "stated_only"}
    t = "kind string, name string, path string, line int, col int"
    got = rows(audit.match_declarations(spark.createDataFrame([("struct", "s", "p", 1, 1), ("struct", "s", "q", 5, 1), ("enum", "x", "p", 1, 1)], t), spark.createDataFrame([("struct", "s", "p", 1, 1)], t)))
    assert sorted(r[-1] for r in got) == ["alternate", "compiler_only", "matched"]
    uses = spark.createDataFrame([(1, "d1", "struct s"), (2, "gone", "struct s"), (3, None, "struct s"), (4, None, "s"), (5, None, "alias"), (6, None, "union u"), (7, None, "int"), (8, None, "two")], "use_id int, decl_id string, spelling string")
    decls = spark.createDataFrame([("d1", "T9")], "decl_id string, type_id string")
    types = spark.createDataFrame([("T1", "struct", "s"), ("T2", "typedef", "alias"), ("T3", "typedef", "two"), ("T4", "typedef", "two")], "type_id string, kind string, name string")
    got = {r[0]: (r[1], r[2]) for r in rows(audit.resolve_type_use(uses, decls, types))}
    assert got == {1: ("T9", "bound"), 2: (None, "target_unresolved"), 3: ("T1", "bound"), 4: (None, "ambiguous"), 5: ("T2", "bound"), 6: (None, "unsupported"), 7: (None, "external"), 8: (None, "ambiguous")}


def test_overlay_is_all_or_nothing(spark):
    e = spark.createDataFrame([("a", 1), ("b", 2)], "title string, line int")
    assert audit.attach_overlay(e, spark.createDataFrame([("a", "x")], "title string, note string"), ["title"]).where("note = 'x'").count() == 1
    for bad in ([("a", "x"), ("a", "y")], [("zz", "x")]):
        with pytest.raises(ValueError):
            audit.attach_overlay(e, spark.createDataFrame(bad, "title string, note string"), ["title"])


# --- intervals


def test_overlap_join_against_brute_force(spark, rows):
    rnd = Random(1)
    make = lambda n: [("f", i, a := rnd.randint(1, 900), a + rnd.choice([0, 3, 40, 700])) for i in range(n)]
    a, b = make(60), make(50)
    x = spark.createDataFrame(a, "file string, id int, first int, last int")
    y = spark.createDataFrame(b, "file string, rid int, first int, last int")
    want = sorted((i, j) for _, i, s, t in a for _, j, u, v in b if t >= u and s <= v)
    for block in (16, 256):
        got = intervals.overlap_join(x, y, ["file"], block).select("id", "rid")
        assert rows(got) == sorted(want, key=repr)


def test_liveness_of_nested_regions(spark, rows):
    r = spark.createDataFrame([("f", 1, 1, 50, "live"), ("f", 2, 10, 20, "dead"), ("f", 3, 12, 15, "live"), ("f", 4, 30, 40, "unknown"), ("f", 5, 31, 32, "live")], "file string, region_id int, first int, last int, liveness string")
    assert {x[1]: x[2] for x in rows(intervals.region_liveness(r, ["file"]))} == {1: "live", 2: "dead", 3: "dead", 4: "unknown", 5: "unknown"}


def test_conditionals_of_a_file():
    from lodegraph.sources.c_conditionals import evaluate, regions

    assert evaluate("defined(A) && B > 2", {"A": "", "B": "3"}) is True and evaluate("A || 1", {}) is True and evaluate("A && 0", {}) is False
    assert evaluate("A", {}) is None and evaluate("A", {}, closed=True) is False and evaluate("1 +", {}) is None and evaluate("!defined X", {"X": None}) is True
    text = "#ifndef H\n#define H\n#define N 2\n#if N > 1\na\n#elif OTHER\nb\n#else\nc\n#endif\n#ifdef UNSURE\n#if 0\nd\n#endif\n#endif\n#endif\n"
    got = {(r[1], r[2]): (r[3], r[4], r[6], r[7]) for r in regions(text)}
    assert got[("ifndef", "H")] == (1, 16, True, "live") and got[("if", "N > 1")] == (4, 5, False, "live") and got[("elif", "OTHER")][3] == "dead"
    assert got[("ifdef", "UNSURE")][3] == "unknown" and got[("if", "0")][3] == "dead"


# --- windows


def test_retention_fills_up_with_the_newest(spark):
    from datetime import datetime

    s = spark.createDataFrame([("g", f"s{i}", datetime(2025, 1, 10 - i if i == 1 else i)) for i in range(1, 6)], "graph_name string, snapshot_id string, created_at timestamp")
    pins = spark.createDataFrame([("g", "s2"), ("g", "gone")], "graph_name string, snapshot_id string")
    got = {r["snapshot_id"]: r["decision"] for r in windows.retention(s, 3, pins).collect()}
    assert got == {"s1": "current", "s2": "pinned", "s5": "newest", "s3": "delete", "s4": "delete"}
    assert [r["snapshot_id"] for r in windows.dangling_pins(s, pins).collect()] == ["gone"]
    assert {r["decision"] for r in windows.retention(s, 0).collect()} == {"current", "delete"}


def test_as_of_lookups(spark, rows):
    calls = spark.createDataFrame([("f", "c1", 5), ("f", "c2", 1), ("f", "c3", 9)], "fn string, call_id string, line int")
    sets = spark.createDataFrame([("f", 2, "A"), ("f", 5, "B"), ("f", 8, None)], "fn string, at_line int, type string")
    assert rows(windows.last_assignment(calls, sets, ["fn"])) == [("f", "c1", "B", ["A", "B"], False), ("f", "c2", None, [], False), ("f", "c3", None, ["A", "B"], True)]
    d = spark.createDataFrame([(None, "builtin", 0, "X", "1"), ("a.c", "file_flag", 0, "X", "2"), ("a.c", "in_file", 4, "X", "3"), ("a.c", "in_file", 6, "X", "4"), ("b.c", "in_file", 1, "X", "9")], "file string, origin string, line int, name string, value string")
    p = spark.createDataFrame([(1, "a.c", 4, "X"), (2, "a.c", 5, "X"), (3, "a.c", 99, "X"), (4, "c.c", 9, "X"), (5, "a.c", 9, "Y"), (6, None, 9, "X"), (7, "a.c", None, "X")], "point_id int, file string, before_line int, name string")
    got = windows.define_environment(d, p)
    assert rows(got) == [(1, "X", "2"), (2, "X", "3"), (3, "X", "4"), (4, "X", "1"), (6, "X", "1"), (7, "X", "2")]
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_large_files_make_no_pairs(spark):
    """100,000 calls and 50,000 assignments or owners in one file."""
    n = 100_000
    calls = spark.range(n).select(F.lit("f").alias("k"), F.col("id").alias("call_id"), (F.col("id") * 2).cast("int").alias("line"))
    sets = spark.range(n // 2).select(F.lit("f").alias("k"), (F.col("id") * 4 + 1).cast("int").alias("at_line"), F.concat(F.lit("T"), F.col("id") % 7).alias("type"))
    got = windows.last_assignment(calls, sets, ["k"]).agg(F.count("last_type"), F.max(F.size("types")), F.max(F.when(F.col("call_id") == 50_000, F.col("last_type")))).first()
    assert tuple(got) == (n - 1, 7, f"T{(2 * 50_000 - 1) // 4 % 7}")
    owners = spark.range(n // 2).select(F.lit("f").alias("k"), F.concat(F.lit("o"), "id").alias("owner"), (F.col("id") * 4).cast("int").alias("first"), (F.col("id") * 4 + 2).cast("int").alias("last"))
    points = calls.withColumnRenamed("call_id", "point_id")
    got = audit.innermost_owner(points, owners, ["k"]).agg(F.count("owner"), F.max(F.when(F.col("point_id") == 501, F.col("owner")))).first()
    assert tuple(got) == (n, "o250")


def test_as_of_lookup_of_nulls_and_ties(spark, rows):
    calls = spark.createDataFrame([("f", 1, 5), ("f", 2, None), (None, 3, 5), ("g", 4, 5)], "fn string, call_id int, line int")
    sets = spark.createDataFrame([("f", 5, "A"), ("f", 5, "B"), ("f", None, "N"), (None, 1, "Z"), ("f", 6, "C"), ("g", 2, None)], "fn string, at_line int, type string")
    assert rows(windows.last_assignment(calls, sets, ["fn"])) == sorted([("f", 1, "B", ["A", "B"], False), ("f", 2, None, [], False), (None, 3, None, [], False), ("g", 4, None, [], True)], key=repr)


def test_caps_keep_exact_totals(spark, rows):
    df = spark.createDataFrame([("g", i) for i in range(7)], "g string, i int")
    for n, shown, cut in ((0, 0, None), (7, 7, False), (8, 7, False), (6, 6, True)):
        got = rows(windows.capped(df, ["g"], ["i"], n))
        assert len(got) == shown and all(r[3] == 7 and r[4] == cut for r in got)
    assert rows(windows.hash_sample(df, ["g"], ["i"], 3)) == rows(windows.hash_sample(df.orderBy(F.desc("i")).repartition(3), ["g"], ["i"], 3))


# --- differences and measures


def test_row_diff_is_strict_about_types_and_columns(spark, rows):
    a = spark.createDataFrame([("1", 1.0, "x"), ("2", float("nan"), "x"), ("3", 1.0, "x")], "id string, n double, t string")
    b = spark.createDataFrame([("1", 1.0, "x"), ("2", None, "y"), ("4", 1.0, "x")], "id string, n double, t string")
    assert rows(diff.row_diff(a, b, ["id"])) == sorted([("2", "modified", ["t"]), ("3", "removed", None), ("4", "added", None)], key=repr)
    assert rows(diff.row_diff(a, a.withColumn("extra", F.lit(1)), ["id"]))[0] == ("1", "modified", ["extra"])
    assert rows(diff.row_diff(a, a.withColumn("n", F.col("n").cast("float")), ["id"]))[0] == ("1", "modified", ["n"])
    assert rows(diff.row_diff(a, a, ["id"])) == []
    for bad in ([("1",), ("1",)], [(None,)], [(" ",)]):
        with pytest.raises(diff.RowIndexError):
            diff.check_ids(spark.createDataFrame(bad, "id string"), ["id"])
    with pytest.raises(ValueError):
        diff.check_finite(spark.createDataFrame([(float("inf"),)], "n double"))


def test_bags_and_merged_observations(spark, rows):
    e, a = (spark.createDataFrame([("g", v) for v in t], "g string, v string") for t in ("aabc", "abbd"))
    assert rows(measures.bag_difference(e, a, ["v"], ["g"])) == [("g", 2, 2)]
    o = spark.createDataFrame([("s", 1, "t"), ("s", 2, "t"), ("q", 1, "t"), ("q", 2, "u")], "site string, entry int, target string")
    assert rows(audit.merge_observations(o, ["site"], "entry", ["target"])) == [("q", [1, 2], True, None), ("s", [1, 2], False, "t")]


def test_edge_rules(spark, rows):
    e = spark.createDataFrame([("g", "ent:1", "m:f", 1), ("g", "ent:2", "n:f", 2), ("g", "ent:3", "m:C.x", 3)], "graph_name string, id string, title string, ordinal int")
    r = spark.createDataFrame([("g", x, "m") for x in ("m:f", "ent:2", "ent:fn:core:f", "other:f", "f", "ent:method:core:C_x", "nowhere", None)], "graph_name string, raw string, stem string")
    assert {x[1]: (x[3], x[4]) for x in rows(construct.resolve_titles(r, e))} == {
        "m:f": ("m:f", "title"), "ent:2": ("n:f", "id"), "ent:fn:core:f": ("m:f", "internal"), "other:f": ("m:f", "context"), "f": ("m:f", "bare"), "ent:method:core:C_x": ("m:C.x", "dotted"), "nowhere": ("nowhere", "raw"),
    }
    weak = spark.createDataFrame([("g", "calls", "x+ast", "d", 0.8, "h"), ("g", "calls", "x+ast", "unresolved receiver", 0.8, "h"), ("g", "calls", "x+ast", "d", 0.65, "h"), ("g", "calls", "x+ast", "d", 0.5, ""), ("g", "calls", "plain", "d", 0.1, None)], "graph_name string, type string, extractor string, description string, confidence double, resolved_target_hint string")
    got = [(r["observed"], r["reason"], r["kept"]) for r in construct.demote_weak_calls(weak).collect()]
    assert got == [(False, None, True), (True, "unresolved receiver", True), (True, "low confidence call observation", False), (True, "low confidence", False), (False, None, True)]
    assert construct.makefile_dependencies("a.o: a.c \\\n b\\ c.h c$$d.h\n\nx: y\n") == ["a.c", "b c.h", "c$d.h"]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"id": " "}, "empty_relationship_id"), ({"confidence": 1.5}, "confidence_boundary"), ({"confidence": float("nan")}, "nan_or_infinity"), ({"is_deterministic": False}, "field_mismatch"),
        ({"source": "gone"}, "dangling_source"), ({"target": "twice"}, "ambiguous_target_title"), ({"target": "fn"}, "invalid_target_kind"), ({"compiler": None}, "partial_payload"), ({"compile_commands_digest": "xyz"}, "digest_mismatch"),
    ],
)
def test_every_planted_defect_is_named(spark, change, code):
    schema = "graph_name string, id string, source string, target string, type string, confidence double, is_deterministic boolean, compile_commands_digest string, compiler string"
    good = {"graph_name": "g", "id": "r", "source": "a.c", "target": "b.h", "type": "depends_on", "confidence": 1.0, "is_deterministic": True, "compile_commands_digest": "0" * 64, "compiler": "cc"}
    ents = spark.createDataFrame([("g", "1", "a.c", "file"), ("g", "2", "b.h", "file"), ("g", "3", "twice", "file"), ("g", "4", "twice", "file"), ("g", "5", "fn", "function")], "graph_name string, id string, title string, type string")
    c = contracts.CONTRACTS["dependency"]
    found = lambda rows, state: {r["code"] for r in contracts.row_anomalies(c, spark.createDataFrame(rows, schema), ents, state).collect()}
    assert found([good], "enabled") == set() and found([good], "off") == {"off_with_decorated_rows"}
    assert code in found([good | change], "enabled")


def test_states_counts_and_coherence(spark):
    c = contracts.CONTRACTS["dependency"]
    assert [contracts.state_of(m, "dependency") for m in ({}, {"dependency": {"enabled": False}}, {"dependency": {"enabled": True}}, {"dependency": 3})] == ["legacy_absent", "off", "enabled", "invalid"]
    rows = spark.createDataFrame([("g", "r", "depends_on", "0" * 64)], "graph_name string, id string, type string, compile_commands_digest string")
    assert contracts.manifest_anomalies(c, rows, {"dependency": {"enabled": True, "count": 2, "compile_commands_digest": "0" * 64}}) == [("manifest_count_mismatch", "2 stated, 1 decorated")]
    m = {"dependency": {"enabled": True, "compile_commands_digest": "a"}, "include": {"enabled": True, "compile_commands_digest": "b"}}
    assert contracts.coherence_anomalies(m) == [("digest_mismatch", "dependency / include")]


# --- packs


def test_observations_of_a_pack_are_counted_before_they_are_cut(spark):
    calls = [("g", "m:f", f"t{i:02}", "registry_candidate:x" if i > 17 else None if i == 3 else "dynamic", f"1:{i}") for i in range(20)]
    g = GraphTables(
        spark.createDataFrame([("g", "e1", "m:f", "fn", [])], "graph_name string, id string, title string, type string, text_unit_ids array<string>"),
        edges(spark, []),
        spark.createDataFrame([], "graph_name string, id string, text string"),
        spark.createDataFrame(calls + calls[:5] + [("h", *c[1:]) for c in calls[:15]], "graph_name string, source string, display_target string, reason string, span string"),
    )
    got = pack.context_sections(g, "m:f").where("section = 'observations'").orderBy("graph_name", "rank").collect()
    assert [(r["rank"], r["total"], r["truncated"]) for r in got] == [(i, 20, True) for i in range(1, 16)] + [(i, 15, False) for i in range(1, 16)]
    assert [r["item"].split()[1] for r in got[:4]] == ["t18", "t19", "t00", "t01"]


def test_a_pack_says_which_texts_are_cut(spark):
    g = GraphTables(
        spark.createDataFrame([("g", "e1", "m:f", "fn", ["a", "b", "c"])], "graph_name string, id string, title string, type string, text_unit_ids array<string>"),
        edges(spark, [("m:f", "m:g")]),
        spark.createDataFrame([("g", "a", "x" * 10), ("g", "b", "x" * 11), ("g", "c", "")], "graph_name string, id string, text string"),
        spark.createDataFrame([], "graph_name string, source string, display_target string, reason string, span string"),
    )
    sections = {x["section"]: x for x in json.loads(pack.context_pack(g, "m:f", 10).first()["pack_json"])["sections"]}
    assert sections["texts"]["items"] == ["x" * 10, "x" * 10, ""] and sections["texts"]["cut"] == [False, True, False]
    assert "cut" not in sections["neighbors"] and sections["texts"]["truncated"] is False


def test_call_buckets_by_class_and_scope(spark, rows):
    shape = "row_id string, caller string, path string, target string, byte_offset int, line int, col int"
    compiler = [("c1", "f", "a.c", "g", 10, 1, 1, "internal_direct"), ("c2", "f", "a.c", "h", None, 2, 1, "internal_direct"), ("c3", "f", "a.c", "x", 30, 3, 1, "internal_direct"),
                ("c4", "f", "a.c", "puts", 40, 4, 1, "external_direct"), ("c5", None, "a.c", "g", 50, 5, 1, "internal_direct"), ("c6", "f", "a.c", None, 60, 6, 1, "indirect"), ("c7", "f", "a.c", "q", 70, 7, 1, None)]
    stated = [("s1", "f", "a.c", "g", 10, 9, 9), ("s2", "f", "a.c", "h", 20, 2, 1), ("s4", "f", "a.c", "other", 40, 4, 1), ("s8", "f", "a.c", "z", 80, 8, 1), ("s9", "f", "b.c", "g", 10, 1, 1)]
    got = rows(audit.call_buckets(spark.createDataFrame(compiler, shape + ", call_class string"), spark.createDataFrame(stated, shape), spark.createDataFrame([("a.c",)] * 2, "path string")))
    assert got == sorted([
        ("c1", "s1", "matched_internal"), ("c2", "s2", "matched_internal"), ("c3", None, "compiler_only_internal"), ("c4", None, "external_direct"), ("c5", None, "compiler_only_internal"),
        ("c6", None, "indirect"), ("c7", None, "ambiguous"), (None, "s4", "covered_by_other"), (None, "s8", "stated_only"), (None, "s9", "out_of_scope"),
    ], key=repr)


def test_closure_section_tells_the_state_of_each_node(spark, rows):
    from lodegraph.tables import GraphTables

    e = spark.createDataFrame([("g", "1", "m:a", ["t1", "t0"]), ("g", "2", "m:b", []), ("g", "3", "m:b", None)], "graph_name string, id string, title string, text_unit_ids array<string>")
    t = spark.createDataFrame([("g", "t0", "x" * 400), ("g", "t1", "y")], "graph_name string, id string, text string")
    n = spark.createDataFrame([("g", "m:a", "m:a", 0), ("g", "m:a", "m:b", 1), ("g", "m:a", "m:c", 2)], "graph_name string, start string, title string, depth int")
    got = rows(pack.closure_section(n, GraphTables(e, e, t, t), max_nodes=3).select("rank", "title", "status", F.length("text"), "cut", "total", "truncated"))
    assert got == [(1, "m:a", "present", 300, True, 3, False), (2, "m:b", "ambiguous", None, None, 3, False), (3, "m:c", "missing", None, None, 3, False)]


def test_rounds_of_traversals_beyond_the_broadcast_bound(spark, rows, monkeypatch):
    edges = spark.createDataFrame([("g", f"n{i}", f"n{(i * 7 + k) % 40}", "contains") for i in range(20) for k in (1, 2)], "graph_name string, source string, target string, type string")
    starts = spark.createDataFrame([("g", "n0"), ("g", "n3")], "graph_name string, start string")
    small = rows(traverse.reach(edges, starts)), rows(traverse.dependency_order(edges))
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", 0)
    assert (rows(traverse.reach(edges, starts)), rows(traverse.dependency_order(edges))) == small


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as N

    from lodegraph import session

    conf = N(get=lambda *a: None)
    spark = N(sparkContext=N(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(spark)
