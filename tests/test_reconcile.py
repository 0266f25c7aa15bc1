from random import Random

import numpy as np

from lodegraph.bitmaps import PresenceBitmap
from lodegraph.pipeline import reconcile as rc

COLS = "graph_name string, id string, title string, flag string, b string"


def side(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], COLS)


def run(spark, left, right, n=3):
    return rc.reconcile(side(spark, left), side(spark, right), ("graph_name", "id"), ["title", "flag"], n)


def test_fields_nulls_and_sides(spark, rows):
    left = [("g", "1", "a", "true"), ("g", "2", None, None), ("g", "3", "", "x"), ("g", "4", "é", "y"), ("g", None, "n", "n"), ("h", "9", "only", "left")]
    right = [("g", "1", "a", "true"), ("g", "2", None, "false"), ("g", "3", None, "x"), ("g", "4", "é", "y"), ("g", None, "n", "n"), (None, "9", "only", "right")]
    assert rows(run(spark, left * 2, right)) == sorted([
        ("g", "2", "flag"), ("g", "3", "title"), ("g", "4", "title"), ("h", "9", "only_in_left"), (None, "9", "only_in_right"),
    ], key=repr)


def test_versions_of_one_key_are_compared_as_sets(spark, rows):
    assert rows(run(spark, [("g", "1", "a", "x"), ("g", "1", "b", "x")], [("g", "1", "b", "x"), ("g", "1", "a", "x")])) == []
    assert rows(run(spark, [("g", "1", "a", "x"), ("g", "1", "b", "x")], [("g", "1", "a", "x")])) == [("g", "1", "title")]


def test_empty_copies(spark, rows):
    assert rows(run(spark, [], [])) == []
    assert rows(run(spark, [("g", "1", "a", "x")], [])) == [("g", "1", "only_in_left")]
    assert rows(run(spark, [], [("g", "1", "a", "x")])) == [("g", "1", "only_in_right")]


def test_against_brute_force(spark, rows):
    rnd = Random(2)
    make = lambda: {("g", str(i)): (rnd.choice("ab"), rnd.choice(["t", None])) for i in range(300) if rnd.random() < 0.7}
    a, b = make(), make()
    want = [(*k, "only_in_left") for k in a.keys() - b.keys()] + [(*k, "only_in_right") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        want += [(*k, f) for f, x, y in zip(("title", "flag"), a[k], b[k], strict=True) if x != y]
    for n in (1, 5):
        assert rows(run(spark, [(*k, *v) for k, v in a.items()], [(*k, *v) for k, v in b.items()], n)) == sorted(want, key=repr)


def test_truth_by_meaning(spark):
    from pyspark.sql import functions as F

    values = ["TRUE", "yes", "t", "1", " True ", "False", "NO", "f", "0", "maybe", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(rc.truth(F.col("v"))).collect()]
    assert got == ["true"] * 5 + ["false"] * 4 + ["?maybe", "?", None]


def test_bitmaps_match_sets():
    rnd = np.random.default_rng(1)
    shapes = [rnd.choice(200_000, 50), np.arange(70_000, 140_000), rnd.choice(70_000, 40_000), np.array([], int), np.array([0, 65_535, 65_536])]
    for a in shapes:
        for b in shapes:
            x, y = PresenceBitmap.of(a), PresenceBitmap.of(b)
            assert set(x.and_not(y).ordinals()) == set(a.tolist()) - set(b.tolist())
            assert set(x.intersect(y).ordinals()) == set(a.tolist()) & set(b.tolist())
            assert set(x.union(y).ordinals()) == set(a.tolist()) | set(b.tolist()) and len(x) == len(set(a.tolist()))
    kinds = {k for s in shapes for k, _ in PresenceBitmap.of(s).chunks.values()}
    assert kinds == {"array", "runs", "bits"}


def test_keys_with_nul_and_colons_stay_apart(spark, rows):
    left = spark.createDataFrame([("a\0+b", "c", "1"), ("a", "b\0+c", "1"), ("1:a", "b", "1"), (None, "", "1"), ("", None, "1")], "g string, i string, v string")
    right = spark.createDataFrame([("a", "b\0+c", "1"), ("1", "a:b", "1"), ("", "", "1")], "g string, i string, v string")
    got = rows(rc.reconcile(left, right, ("g", "i"), ["v"], 1, ("l", "r")))
    want = [("a\0+b", "c", "l"), ("1:a", "b", "l"), (None, "", "l"), ("", None, "l"), ("1", "a:b", "r"), ("", "", "r")]
    assert got == sorted(want, key=repr)
