import pytest

from lodegraph.functions import plain
from lodegraph.operators import comparisons as cp
from lodegraph.operators.simulation import simulate


def test_owners(spark, rows):
    u = "use_id int, use_kind string, name string, record_kind string, storage string, path string, line int, col int"
    uses = spark.createDataFrame([
        (1, "parameter", "f", None, None, "a.c", 1, 1), (2, "parameter", "f", None, "static", "b.c", 99, 9), (3, "local_variable", "g", None, None, "x.c", 9, 9), (4, "local_variable", "h", None, None, "x.c", 9, 9),
        (5, "field", "s", "struct", None, "a.h", 5, 1), (6, "field", "t", "typedef", None, "a.h", 7, 3), (7, "field", "s", "union", None, "a.h", 5, 1), (8, "typedef_underlying", "t", None, None, "a.h", 8, 1),
        (9, "global_variable", "v", None, None, "a.c", 1, 1), (10, "parameter", None, None, None, "a.c", 1, 1), (11, "field", None, "struct", None, "a.h", 5, 1),
    ], u)
    fns = spark.createDataFrame([("m:f", "f", None, "a.c", 1, 1), ("n:f", "f", "static", "b.c", 3, 1), ("m:g", "g", None, "g.c", 1, 1), ("m:h", "h", None, "1.c", 1, 1), ("n:h", "h", None, "2.c", 1, 1)], "title string, name string, storage string, path string, line int, col int")
    types = spark.createDataFrame([("m:s", "struct", "s", "a.h", 5, 1, 5), ("m:t", "typedef", "t", "a.h", 8, 1, 7)], "title string, kind string, name string, path string, line int, col int, site_line int")
    got = {r[0]: tuple(r)[1:] for r in cp.resolve_owner(uses, fns, types).collect()}
    assert got[1] == ("m:f", "function", "exact_declaration_site", "ok") and got[2] == ("n:f", "function", "unique_internal_function_name_same_file", "ok")
    assert got[3] == ("m:g", "function", "unique_external_function_name", "ok") and got[4][3] == "unmatched"
    assert got[5] == ("m:s", "struct", "exact_declaration_site", "ok") and got[6] == ("m:t", "typedef", "owned_tag_typedef_site", "ok") and got[7][3] == "unmatched"
    assert got[8] == ("m:t", "typedef", "exact_declaration_site", "ok") and got[9][3] == got[10][3] == "unowned" and got[11][3] == "unmatched"


def test_registries_exports_and_names(spark, rows):
    kv = "registry string, key string, value string"
    got = rows(cp.registry_comparison(spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], kv), spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "d", "4"), ("q", "x", "1")], kv)))
    assert got == [("q", "x", "undetected"), ("r", "a", "agree"), ("r", "b", "disagree"), ("r", "c", "false_positive"), ("r", "d", "missed")]
    e = spark.createDataFrame([("m:f", "m.py", "fn"), ("n:f", "n.py", "fn"), ("m:C.g", "m.py", "method"), ("m:D.g", "m.py", "method")], "title string, source_file string, type string")
    x = spark.createDataFrame([("p.f", "f", "m.py"), ("p.g", "g", "m.py"), ("p.h", "f", "z.py"), ("p.k", "k", "m.py")], "export string, name string, origin_file string")
    assert rows(cp.match_exports(x, e)) == [("p.f", "m:f", "resolved"), ("p.g", None, "ambiguous"), ("p.h", None, "other_file"), ("p.k", None, "unknown")]
    run = spark.createDataFrame([("m", "f"), ("m", "new"), ("m", "_hidden")], "module string, name string")
    assert rows(cp.unlisted_names(run, e)) == [("m", "new")]
    inh = spark.createDataFrame([("m:C.f", "m:B.f", "inherits"), ("m:D.f", "m:B.f", "inherits")], "source string, target string, type string")
    owners = spark.createDataFrame([("m:C.f", "m:B.f"), ("m:D.f", "m:A.f")], "member string, owner string")
    assert rows(cp.inherited_members(inh, owners)) == [("m:D.f", "m:B.f", "m:A.f")]
    sites = spark.createDataFrame([("g", "m:go", "ops")], "graph_name string, source string, registry string")
    tables = spark.createDataFrame([("g", "ops", "m:f"), ("g", "ops", "gone")], "graph_name string, registry string, target string")
    titles = e.selectExpr("'g' graph_name", "title")
    assert [r[:4] for r in rows(cp.registry_promotions(sites, tables, titles))] == [("g", "m:go", "m:f", "ops")]


def test_liveness_against_surviving_lines(spark):
    r = spark.createDataFrame([("f", 1, 5, "live"), ("f", 6, 9, "dead"), ("f", 10, 11, "live"), ("f", 12, 15, "unknown"), ("f", 16, 20, "dead")], "file string, first int, last int, liveness string")
    s = spark.createDataFrame([("f", 3), ("f", 18)], "file string, line int")
    got = {x["bucket"]: (x["n"], x["rate"]) for x in cp.liveness_comparison(r, s).collect()}
    assert {k: v[0] for k, v in got.items()} == {"agree": 2, "vacuous": 1, "unknown": 1, "disagree": 1} and got["agree"][1] == pytest.approx(2 / 3)
    none = cp.liveness_comparison(r.where("liveness = 'unknown'"), s).first()
    assert none["rate"] is None


def test_uses_reports_and_digests(spark, rows):
    u = spark.createDataFrame([("a", "T", "field", 1, "ok", "bound"), ("a", "T", "field", 2, "ok", "bound"), ("b", None, "field", 1, "unowned", "bound"), ("c", None, "field", 1, "ok", "target_unresolved")], "source string, target string, kind string, entry_index int, owner_outcome string, target_outcome string")
    assert rows(cp.classify_uses(u)) == sorted([("a", "T", "field", "configured", 2, [1, 2]), ("b", None, "field", "unowned", 1, [1]), ("c", None, "field", "target_unresolved", 1, [1])], key=repr)
    spec = "spec string, v string"
    h = cp.health(spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "x")], spec), spark.createDataFrame([("s", "a"), ("t", "x")], spec), ["v"])
    assert rows(h) == [("s", 1, 0, "drift"), ("t", 0, 0, "ok")]
    m = spark.createDataFrame([("n", 1)], "metric string, value int")
    assert rows(cp.roll_up({"b": m, "a": m})) == [("a", "n", 1.0), ("b", "n", 1.0)]
    c = spark.createDataFrame([("x", "one", True), ("x", "two", False), ("y", "one", True)], "artifact string, use string, replayable boolean")
    assert rows(cp.durability(c)) == [("x", ["one", "two"], False), ("y", ["one"], True)]
    d = "file string, origin string, name string, value string"
    a, b = (cp.macro_seed_digest(spark.createDataFrame(x, d)).first()["digest"] for x in ([("f", "file", "A", "1"), ("f", "file", "B", None)], [("f", "file", "B", None), ("f", "file", "A", "1"), ("f", "file", "A", "1")]))
    assert a == b and len(a) == 64
    lines = spark.createDataFrame([("f", "aé\nb\n")], "file string, content string")
    assert rows(cp.byte_offsets(lines)) == [("f", 1, 0), ("f", 2, 4), ("f", 3, 6)]


def test_simulation_and_programs(spark):
    got = {r["tick"]: r for r in simulate(spark.createDataFrame([("one", [3])], "run string, jumps array<int>")).collect()}
    assert len(got) == 50 and (got[3]["y"], got[3]["vy"], got[4]["y"], got[5]["score"]) == (0.4, 5.2, 4.8, 6)
    assert plain.run_program("let x = 1\nlet x = x + 9\nx; -x*-(2+3)/4") == {"stdout": ["10", "12.5"], "error": None}
    assert plain.run_program("1\n2+")["error"] == "ParseError: unexpected end of input" and plain.run_program("let y = 1/0\ny")["error"] == "DivisionByZero: division by zero"


def test_patches_round_trip():
    from random import Random

    rnd = Random(8)
    for _ in range(200):
        a = "".join(rnd.choice("abcdef\n%é") for _ in range(rnd.randint(0, 80)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 3)] = rnd.choice(["", "x", "yz\n"])
        b = "".join(b)
        assert plain.apply_patches(a, plain.make_patches(a, b)) == b
    assert plain.apply_patches("hello cruel world", "@@ -1,11 +1,17 @@\n hello \n+brave \n world\n") == "hello cruel brave world"
    for bad in ("Bad\n", "@@ -1,1 +1,1 @@\n*x\n"):
        with pytest.raises(ValueError):
            plain.read_patches(bad)
