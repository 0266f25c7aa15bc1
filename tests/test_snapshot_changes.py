from datetime import datetime, timedelta
from random import Random

from lodegraph.pipeline import snapshot_changes as sc

T0 = datetime(2025, 1, 1)
SNAP = "graph_name string, snapshot_id string, created_at timestamp, ingested_at timestamp"
ENT = "graph_name string, snapshot_id string, id string, span string, hash string, ordinal string, table_name string"
REL = "graph_name string, snapshot_id string, id string, confidence double"


def snaps(spark, pairs):
    return spark.createDataFrame([(g, s, T0 + timedelta(days=t), T0) for g, s, t in pairs], SNAP)


def ents(spark, data):
    # columns whose names clash with the operator's own must not matter
    return spark.createDataFrame([(g, s, i, v, "h", "o", "t") for g, s, i, v in data], ENT)


def changes(spark, e, r, s):
    return sc.snapshot_changes({"entities": (ents(spark, e), "span"), "relationships": (spark.createDataFrame(r, REL), "confidence")}, snaps(spark, s))


def test_added_removed_changed_and_back(spark, rows):
    s = [("g", "c", 3), ("g", "a", 1), ("g", "b", 2), ("g", "a", 1)]  # unordered, one registered twice
    e = [("g", "a", "x", "1:0"), ("g", "b", "x", "1:0"), ("g", "c", "x", "2:0"), ("g", "a", "y", None), ("g", "c", "y", None), ("g", "b", "z", ""), ("g", "b", "z", "")]
    got = rows(changes(spark, e, [], s))
    assert got == sorted([
        ("entities", "g", "c", "x", "changed"), ("entities", "g", "b", "y", "removed"), ("entities", "g", "c", "y", "added"),
        ("entities", "g", "b", "z", "added"), ("entities", "g", "c", "z", "removed"),
    ], key=repr)


def test_null_nan_zero_and_null_keys(spark, rows):
    s = [("g", "a", 1), ("g", "b", 2)]
    nan = float("nan")
    r = [("g", "a", "1", nan), ("g", "b", "1", None), ("g", "a", "2", 0.0), ("g", "b", "2", -0.0), ("g", "a", "3", None), ("g", "b", "3", 0.5), ("g", "b", None, 1.0)]
    assert rows(changes(spark, [], r, s)) == [("relationships", "g", "b", "3", "changed"), ("relationships", "g", "b", None, "added")]


def test_empty_tables_unregistered_and_silent_snapshots(spark, rows):
    assert rows(changes(spark, [], [], [])) == []
    assert rows(changes(spark, [("g", "zz", "x", "1")], [], [("g", "a", 1)])) == []
    # a registered snapshot without rows ends what was open
    assert rows(changes(spark, [("g", "a", "x", "1")], [], [("g", "a", 1), ("g", "b", 2)])) == [("entities", "g", "b", "x", "removed")]


def test_against_brute_force(spark, rows):
    rnd = Random(4)
    s = [(g, f"{g}{k}", k) for g in "pq" for k in range(5)]
    data = [(g, sid, f"i{i}", rnd.choice(["1", "2", None])) for g, sid, _ in s for i in range(6) if rnd.random() < 0.6]
    want = []
    held = {(g, sid): {i: v for g2, s2, i, v in data if (g2, s2) == (g, sid)} for g, sid, _ in s}
    for (g, a, k), (g2, b, _) in zip(s, s[1:], strict=False):
        if g != g2:
            continue
        x, y = held[g, a], held[g, b]
        want += [("entities", g, b, i, "added") for i in y.keys() - x.keys()] + [("entities", g, b, i, "removed") for i in x.keys() - y.keys()]
        want += [("entities", g, b, i, "changed") for i in x.keys() & y.keys() if x[i] != y[i]]
    assert rows(changes(spark, data * 2, [], s)) == sorted(want, key=repr)


def test_a_hot_key_is_one_row_per_task(spark, rows):
    e = [("g", "a", "x", "1:0")] * 3000 + [("g", "b", "x", "1:1")]
    assert rows(changes(spark, e, [], [("g", "a", 1), ("g", "b", 2)])) == [("entities", "g", "b", "x", "changed")]


def test_shuffled_register_beyond_the_broadcast_bound(spark, rows, monkeypatch):
    e = [("g", "a", "x", "1"), ("g", "b", "x", "2")]
    s = [("g", "a", 1), ("g", "b", 2)]
    want = rows(changes(spark, e, [], s))
    monkeypatch.setattr(sc, "small_enough", lambda *_: False)
    assert rows(changes(spark, e, [], s)) == want == [("entities", "g", "b", "x", "changed")]
