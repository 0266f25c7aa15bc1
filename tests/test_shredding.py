import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.pipeline import shredding as sh
from lodegraph.strict_json import _loads_deep, loads

node = st.recursive(
    st.one_of(st.none(), st.integers(), st.just({}), st.dictionaries(st.sampled_from(["kind", "loc", "x"]), st.one_of(st.text(max_size=3), st.just({"file": "f"}), st.just(3)), max_size=3)),
    lambda kids: st.dictionaries(st.just("inner"), st.one_of(st.lists(kids, max_size=4), kids), min_size=1).map(lambda d: d | {"kind": "K"}),
    max_leaves=30,
)


def brute(value):
    out = []

    def walk(n, path):
        inner = n.get("inner")
        inner = [inner] if isinstance(inner, dict) else inner if isinstance(inner, list) else []
        for i, c in enumerate(inner):
            if isinstance(c, dict):
                out.append((path, f"{path}.{i}"))
                walk(c, f"{path}.{i}")

    walk(value, "0")
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(node, st.dictionaries(st.just("inner"), st.lists(node, max_size=5), min_size=1)), max_size=6))
def test_levels_give_back_every_node(values):
    roots = [v for v in values if isinstance(v, dict)]
    columns = list(sh.shred(roots))
    got = [[] for _ in roots]
    for depth, record, parents, paths in sh.assemble(columns, len(roots)):
        for r, a, b in zip(record.tolist(), parents.to_pylist(), paths.to_pylist(), strict=True):
            if depth:
                got[r].append((a, b))
    assert [sorted(g) for g in got] == [brute(r) for r in roots]


def frame(spark, data):
    return spark.createDataFrame([(a, t, "x", 1) for a, t in data], "ast_id bigint, ast_json string, record_id string, depth int")


def test_what_is_a_node(spark, rows):
    doc = {"inner": [{}, 3, None, {"inner": {"kind": "A"}}, [{"inner": []}], "s"], "array_filler": [{"inner": [{}]}]}
    got = rows(sh.child_links(frame(spark, [(1, json.dumps(doc)), (1, json.dumps(doc, indent=2)), (2, '{"inner": null}')])))
    assert got == [(1, "0", "0.0"), (1, "0", "0.3"), (1, "0.3", "0.3.0")]


def test_texts_that_are_no_object(spark, rows):
    bad = [None, "", " ", "[]", "null", "error: no such file", '{"inner":[{}', '{"inner":[{}]} x', '{"a":NaN,"inner":[{}]}', '﻿{"inner":[{}]}', "[{}]", '{"inner":[{}]}{}']
    assert rows(sh.child_links(frame(spark, list(enumerate(bad))))) == []
    assert rows(sh.child_links(frame(spark, []))) == []
    assert rows(sh.child_links(frame(spark, [(None, ' \n{"inner":[{}]}\t')]))) == [(None, "0", "0.0")]


def test_kind_file_and_report(spark, rows):
    doc = {"kind": "T", "inner": [{"kind": "F", "loc": {"file": "a.c"}}, {"kind": 7, "loc": 3}, {"kind": {}}, {"kind": True}]}
    got = rows(sh.node_table(frame(spark, [(1, json.dumps(doc))])))
    assert [(r[3], r[4], r[5]) for r in got] == [("0", "T", None), ("0.0", "F", "a.c"), ("0.1", "7", None), ("0.2", None, None), ("0.3", "true", None)]
    report = {r[0]: tuple(r)[1:] for r in sh.kind_report(frame(spark, [(1, json.dumps(doc))] * 2)).collect()}
    assert report["F"] == (1, 1, 1, 1)


def test_level_columns_are_the_published_form(spark):
    doc = {"inner": [{"inner": [{"kind": "x"}, 1]}, {}]}
    got = {r["depth"]: (r["rep"], r["def"], r["kind"]) for r in sh.level_columns(frame(spark, [(9, json.dumps(doc))])).collect()}
    assert got == {0: ([0], [0], [None]), 1: ([0, 1], [2, 2], [None, None]), 2: ([0, 2, 1], [4, 3, 2], ["x"])}


def test_deep_and_wide_in_one_batch(spark):
    deep = '{"inner":[' * 60_000 + "{}" + "]}" * 60_000
    wide = json.dumps({"inner": [{}] * 5000})
    start = time.time()
    got = list(sh.shred([loads(wide), loads('{"inner":[' * 3000 + "{}" + "]}" * 3000)]))
    assert len(got) == 3001 and time.time() - start < 20
    assert isinstance(loads(deep), dict)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]",:1-.e0 ntrufalse\\', max_size=14))
def test_strict_json_both_parsers_agree_with_the_standard(text):
    def outcome(f):
        try:
            f(text)
            return True
        except ValueError:
            return False

    def standard(t):
        json.loads(t, parse_constant=lambda c: int("x"))

    assert outcome(loads) == outcome(_loads_deep) == outcome(standard)
