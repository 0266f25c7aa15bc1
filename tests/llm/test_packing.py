import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import packing as pk


def pack(spark, sizes, capacity):
    counts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint")
    return pk.pack_documents(counts, capacity).toPandas()


def sound(p, sizes, capacity):
    placed = p[p.pack_id.notna()].sort_values(["pack_id", "pack_offset"])
    assert p.groupby("doc_id").n_tokens.sum().to_dict() == {i: int(n) for i, n in enumerate(sizes)}
    assert (placed.groupby("pack_id").n_tokens.sum() <= capacity).all()
    ends = placed.pack_offset + placed.n_tokens
    following = placed.groupby("pack_id").pack_offset.shift(-1)
    assert (ends.where(following.notna(), 0) <= following.fillna(0)).all() and (ends <= capacity).all()
    cut = p.groupby("doc_id").size()
    assert all((cut[i] > 1) == (n > capacity) for i, n in enumerate(sizes))
    pieces = p.sort_values(["doc_id", "piece"])
    assert (pieces.groupby("doc_id").n_tokens.cumsum() - pieces.n_tokens == pieces.first_token).all()
    n = placed.pack_id.nunique()
    assert set(placed.pack_id.astype(int)) == set(range(n))
    return n


def test_few_packs_and_only_long_documents_cut(spark):
    rnd = np.random.default_rng(3)
    sizes = np.concatenate([rnd.integers(1, 300, 900), rnd.integers(300, 900, 60), [512, 512, 1024, 1025, 5000, 0, 0]])
    n = sound(pack(spark, sizes, 512), sizes, 512)
    assert n <= 1.02 * np.ceil(sizes.sum() / 512)


def test_borders(spark):
    for sizes, capacity, packs in (([], 10, 0), ([0, 0], 10, 0), ([10], 10, 1), ([11], 10, 2), ([1] * 25, 10, 3), ([6] * 7, 10, 7), ([3, 3, 4] * 5, 10, 5), ([2, 5], 1, 7)):
        assert sound(pack(spark, sizes, capacity), sizes, capacity) == packs if sizes else len(pack(spark, sizes, capacity)) == 0
    with pytest.raises(ValueError):
        pack(spark, [1], 0)


def test_hot_size_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(pk, "BUCKETS", 20)
    sizes = [7] * 2000 + list(range(1, 60))
    assert sound(pack(spark, sizes, 64), sizes, 64) <= 2000 * 7 // 63 + 40
    monkeypatch.setattr(pk, "BROADCAST_ROWS", 0)
    sound(pack(spark, sizes, 64), sizes, 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 40))
def test_the_plan_places_the_whole_histogram(sizes, capacity):
    histogram = np.bincount([min(s, capacity) for s in sizes], minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
    plan = pk.make_plan(histogram, capacity)
    load = np.zeros(plan.n_packs)
    for s in np.flatnonzero(histogram):
        rows = np.flatnonzero(plan.size == s)
        ends = np.append(plan.first[rows][1:], histogram[s])
        assert plan.first[rows][0] == 0
        for r, end in zip(rows, ends, strict=True):
            ranks = np.arange(plan.first[r], end)
            np.add.at(load, plan.pack[r] + (ranks - plan.first[r]) // plan.per_pack[r], s)
    assert (load <= capacity).all() and load.sum() == (np.arange(capacity + 1) * histogram).sum()


def test_patterns_and_fit():
    pats = pk.patterns(np.array([2, 3, 5, 8, 10]), 10)
    assert {tuple(p) for p in pats} == {(10, 0, 0), (8, 2, 0), (5, 5, 0), (5, 3, 2)}
    histogram = np.zeros(11)
    histogram[[8, 2, 10]] = 40, 40, 7
    x = dict(zip(map(tuple, pats), pk.fit(pats, histogram, 500), strict=True))
    assert abs(x[8, 2, 0] - 40) < 1 and abs(x[10, 0, 0] - 7) < 0.5 and x[5, 5, 0] < 1


def test_report(spark):
    counts = spark.createDataFrame([(1, 10), (2, 6), (3, 0)], "doc_id bigint, n_tokens bigint")
    r = pk.fill_report(pk.pack_documents(counts, 10, "p")).first()
    assert (r["n_packs"], r["n_documents"], r["n_tokens"], r["fill"]) == (2, 3, 16, 0.8)


def test_no_triple_is_left_out_of_the_rounds(monkeypatch):
    monkeypatch.setattr(pk, "MAX_PATTERNS", 50)
    histogram = np.zeros(101, np.int64)
    histogram[[*range(1, 29), *range(60, 80)]] = 1
    histogram[[33, 34]] = 2000, 1000
    plan = pk.make_plan(histogram, 100)
    assert plan.n_fitted >= 1000
    assert plan.n_packs <= 1.01 * np.ceil((np.arange(101) * histogram).sum() / 100) + 1


def test_rounds_hold_every_triple_once(monkeypatch):
    sizes = np.arange(1, 60)
    whole = pk.patterns(sizes, 60)
    monkeypatch.setattr(pk, "MAX_PATTERNS", 20)
    parts = [pk.patterns(sizes, 60, r) for r in pk.rounds(sizes, 60)]
    triples = sorted(tuple(p) for part in parts for p in part[part[:, 2] > 0].tolist())
    assert len(parts) > 5 and triples == [(60 - b - c, b, c) for b, c in sorted(((b, c) for c in range(1, 21) for b in range(c, (60 - c) // 2 + 1)), key=lambda x: (60 - x[0] - x[1], *x))]
    assert triples == sorted(tuple(p) for p in whole[whole[:, 2] > 0].tolist())


def test_patterns_of_many_documents_fill_packs_exactly():
    rng = np.random.default_rng(0)
    left = np.bincount(rng.integers(20, 400, 5000), minlength=2049)
    pats = pk.drawn(left, 2048, 500, rng)
    assert len(pats) > 300 and (pats.sum(1) == 2048).all() and (left[pats[pats > 0]] > 0).all() and (np.diff(pats, axis=1) <= 0).all()
    assert ((pats > 0).sum(1) > 3).mean() > 0.9


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_most_packs_are_fitted_and_few_are_more_than_needed(capacity):
    sizes = np.clip(np.random.default_rng(5).lognormal(5.3, 1.1, 40_000).astype(int) + 1, 1, capacity)
    histogram = np.bincount(sizes, minlength=capacity + 1)
    plan = pk.make_plan(histogram, capacity)
    bound = -(-int(sizes.sum()) // capacity)
    assert bound <= plan.n_packs <= 1.003 * bound + 2 and plan.n_fitted >= 0.8 * plan.n_packs


def test_a_full_histogram_has_triples_of_every_smallest_size():
    found = np.concatenate(pk.rounds(np.arange(1, 8193), 8192))
    assert sorted(found.tolist()) == list(range(1, 8192 // 3 + 1))
