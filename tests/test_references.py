import numpy as np
import pytest

from lodegraph.pipeline import references as rf

E = "graph_name string, snapshot_id string, id string, title string, h1 string, mask string"
R = "graph_name string, snapshot_id string, id string, source string, target string"
U = "graph_name string, snapshot_id string, id string, entity_id string"


def orphans(spark, e, r, u):
    return rf.orphan_references(spark.createDataFrame([(*x, "", "") for x in e], E), spark.createDataFrame(r, R), spark.createDataFrame(u, U))


def test_titles_ids_and_roles(spark, rows):
    e = [("g", "a", "ent:1", "m:f"), ("g", "b", "ent:2", "m:g"), ("g", "a", None, "only title")]
    r = [("g", "a", "r1", "m:f", "ent:1"), ("g", "a", "r2", "m:g", "only title"), ("g", "b", "r3", "m:g", "M:G"), ("g", "a", "r4", None, ""), ("g", "a", None, "x", "m:f")]
    u = [("g", "a", "u1", "ent:1"), ("g", "a", "u2", "m:f"), ("g", "b", "u3", "ent:1"), ("g", "a", "u4", None)]
    assert rows(orphans(spark, e, r * 2, u * 2)) == sorted([
        ("relationships", "g", "a", "r2", "source"), ("relationships", "g", "b", "r3", "target"), ("relationships", "g", "a", None, "source"),
        ("text_units", "g", "a", "u2", "entity_id"), ("text_units", "g", "b", "u3", "entity_id"),
    ], key=repr)


def test_empty_sides_and_null_graphs(spark, rows):
    assert rows(orphans(spark, [], [], [])) == []
    assert rows(orphans(spark, [], [("g", "a", "r", "x", None)], [])) == [("relationships", "g", "a", "r", "source")]
    assert rows(orphans(spark, [(None, None, "i", "t")], [(None, None, "r", "t", "i"), ("g", None, "q", "t", None)], [])) == [("relationships", "g", None, "q", "source")]


def test_hot_missing_key_and_long_text(spark, rows):
    long = "k" * 100_000
    r = [("g", "a", f"r{i}", "emit", long) for i in range(2000)]
    got = orphans(spark, [("g", "a", "i", long)], r, [])
    assert got.count() == 2000 and {x[4] for x in rows(got)} == {"source"}


def test_probe_walks_runs_of_one_hash():
    """Different keys that share the first half of the digest are told apart by the second."""
    ids, titles = (np.array([5, 5, 7]), np.array([1, 2, 3])), (np.array([5, 9]), np.array([9, 1]))
    refs = np.array([5, 5, 5, 5, 7, 9]), np.array([2, 1, 4, 9, 3, 3])
    assert rf.unanswered(refs, ids, titles).tolist() == [2, 5] and rf.unanswered(refs, ids).tolist() == [2, 3, 5]
    assert rf.unanswered(refs).tolist() == [0, 1, 2, 3, 4, 5] and rf.unanswered((np.zeros(0, np.int64),) * 2, ids).tolist() == []


def test_ranges_cover_the_key_space():
    got = rf.ranges_of(np.array([-(2**63), -1, 0, 2**63 - 1]), 7).tolist()
    assert got[0] == 0 and got[-1] == 6 and got == sorted(got)


@pytest.mark.parametrize("per_sort, per_range", [(3, 2), (1000, 7), (2_000_000, 400_000)])
def test_against_plain_sets(spark, rows, monkeypatch, per_sort, per_range):
    """Whatever the sizes of sorts, ranges and the filter, the misses are those of sets of strings."""
    monkeypatch.setattr(rf, "KEYS_PER_SORT", per_sort)
    monkeypatch.setattr(rf, "KEYS_PER_RANGE", per_range)
    monkeypatch.setattr(rf, "MIN_FILTER_BITS", 4096)
    rng = np.random.default_rng(3)
    name = lambda n: None if n % 11 == 0 else f"n{n}"
    e = [(f"g{i % 3}", "a", name(int(x)), name(int(y))) for i, (x, y) in enumerate(rng.integers(0, 150, (60, 2)))]
    r = [(f"g{i % 3}", "a", f"r{i}", name(int(x)), name(int(y))) for i, (x, y) in enumerate(rng.integers(0, 150, (90, 2)))]
    u = [(f"g{i % 3}", "a", f"u{i}", name(int(x))) for i, x in enumerate(rng.integers(0, 150, 40))]
    ids, titles = {(g, i) for g, _, i, _ in e}, {(g, t) for g, _, _, t in e}
    want = [("relationships", g, "a", i, f) for g, _, i, s, t in r for f, v in (("source", s), ("target", t)) if v and (g, v) not in ids | titles]
    want += [("text_units", g, "a", i, "entity_id") for g, _, i, v in u if v and (g, v) not in ids]
    assert rows(orphans(spark, e, r, u)) == sorted(want, key=repr)


def test_report(spark, rows):
    from datetime import datetime

    o = spark.createDataFrame([("relationships", "g", "a", "r", "source"), ("relationships", "g", "a", "q", "source")], "table_name string, graph_name string, snapshot_id string, record_id string, ref_field string")
    s = spark.createDataFrame([("g", "a", datetime(2025, 3, 5))] * 2, "graph_name string, snapshot_id string, created_at timestamp")
    assert rows(rf.orphan_report(o, s)) == [("relationships", "source", datetime(2025, 3, 1), 2, 1)]
