from lodegraph import cli
from lodegraph.sources.c_facts import c_rows
from lodegraph.sources.snapshot_store import SnapshotStore

MAIN = """#include <stdio.h>
#include "util.h"
/* int ghost(void) { } */
typedef int (*handler)(const char *, int);
struct point { int x, y; };
enum color { RED, GREEN };
static int helper(int n)
{
    return n ? helper(n - 1) : shared(n); // call(1)
}
#if 0
int broken( {
#endif
#ifdef A
int main(int argc, char **argv) {
#else
int main(void) {
#endif
    struct point p = { helper(1), 2 };
    if (p.x) printf("helper(%d)\\n", twice(p.x));
    return 0;
}
"""
UTIL = "int shared(int);\nint shared(int n) { return n; }\nint twice(int n)\n{ return 2 * n; }\n"
OTHER = "static int helper(void) { return 3; }\nint twice(int n) { return helper(); }\n"


def test_facts_of_a_file():
    rows = c_rows(MAIN)
    assert [(r[1], r[2], r[4], r[5]) for r in rows if r[0] == "entity"] == [
        ("typedef", "handler", 4, 4), ("struct", "point", 5, 5), ("enum", "color", 6, 6), ("function", "helper", 7, 10), ("function", "main", 15, 22),
    ]
    assert {(r[2], r[3]) for r in rows if r[0] == "call"} == {("helper", "helper"), ("helper", "shared"), ("main", "helper"), ("main", "printf"), ("main", "twice")}
    assert [r[3] for r in rows if r[0] == "include"] == ["util.h"]
    assert c_rows("") == [] and c_rows("}}};;(((") == []


def test_index_and_questions(spark, tmp_path):
    src = tmp_path / "src"
    for name, text in (("a/main.c", MAIN), ("a/util.c", UTIL), ("a/util.h", "int shared(int);\n"), ("b/other.c", OTHER)):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    ask = lambda *a: cli.run(cli.parser().parse_args([a[0], "--graph", str(tmp_path / "g"), *a[1:]]), spark)
    assert ask("index", "--package", str(src))["reused"] is False
    assert ask("callees", "main:helper") == ["main:helper", "util:shared"] and ask("callers", "main:helper") == ["main:helper", "main:main"]
    t = SnapshotStore(spark, tmp_path / "g").tables()
    weak = {(r["source"], r["display_target"]): r["reason"] for r in t.call_observations.collect()}
    assert weak == {("main:main", "printf"): "external/undefined C call", ("main:main", "twice"): "ambiguous C call"}
    edges = {(r["type"], r["source"], r["target"]) for r in t.relationships.collect()}
    assert ("includes", "main.c", "util.h") in edges and ("contains", "ent:file:a/main.c", "main:point") in edges and ("calls", "other:twice", "other:helper") in edges
    assert ask("audit-graph")[0]["n_dangling"] == 0
