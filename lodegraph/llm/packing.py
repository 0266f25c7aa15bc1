"""Filling packs of one capacity: length patterns fitted by non-negative least squares.

1. A document longer than a pack is cut into full packs and a remainder; every other is one item.
2. The histogram of item sizes (at most ``capacity`` bins) goes to the driver; the items do not.
3. All patterns of up to three sizes that fill a pack exactly are enumerated; accelerated projected
   gradients fit non-negative repeat counts to the histogram; the counts are rounded to what the histogram
   holds.  Packs of many documents are fitted the same way to what is left, with patterns that are drawn in
   proportion to the histogram and closed exactly by one or two of its sizes.  The rest is packed best fit,
   largest first, on the histogram.
4. The plan is a list of rank intervals per size.  Items get a rank within their size by bucketed
   counting (no task sees all items of a popular size), and the interval tells pack and offset.

Defined results
---------------
* Null and empty texts have no tokens and need no room: they come out once with a null pack.
* Repeated rows count once (one doc_id is one document, of several texts the longest counts).
* No documents: no packs.  A capacity below 1 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Triples are fitted in rounds of about this number, each to what the rounds before it left; none is left out.
MAX_PATTERNS = 1_500_000
ITERATIONS = 300
#: Patterns of many documents: rounds of drawing at most, patterns of a round at most, iterations of their fit.
DRAWN_ROUNDS, DRAWN_PATTERNS, DRAWN_ITERATIONS = 8, 8192, 60
#: One pack in so many is left to best fit.
RESIDUAL_SHARE = 8
#: Items of a size are ranked in so many buckets of a hash, in the order of the buckets, whatever their number.
BUCKETS = 1024
BROADCAST_ROWS = 400_000


def _triples(have: np.ndarray, capacity: int, c: int) -> np.ndarray:
    """The middle sizes of the triples with the smallest size c."""
    b = np.arange(c, (capacity - c) // 2 + 1)
    return b[have[b] & have[capacity - c - b]]


def _smallest(have: np.ndarray, capacity: int) -> np.ndarray:
    c = np.flatnonzero(have[: capacity // 3 + 1])
    return c[c > 0]


def _have(sizes: np.ndarray, capacity: int) -> np.ndarray:
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    return have


def patterns(sizes: np.ndarray, capacity: int, smallest: np.ndarray | None = None) -> np.ndarray:
    """Rows of up to three of ``sizes``, descending, 0 for none, that add up to the capacity.

    ``smallest`` limits the triples to those with such a smallest size.
    """
    have = _have(sizes, capacity)
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = np.flatnonzero(have[: capacity // 2 + 1])
    a = a[a > 0]
    pair = a[have[capacity - a]]
    out.append(np.stack([capacity - pair, pair, np.zeros_like(pair)], 1))
    every = _smallest(have, capacity)
    for c in every if smallest is None else np.intersect1d(every, smallest):
        b = _triples(have, capacity, c)
        out.append(np.stack([capacity - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(out)


def rounds(sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """The smallest sizes of the triples of each round; together all, and each round has small and large ones."""
    have = _have(sizes, capacity)
    smallest = _smallest(have, capacity)
    n = max(1, -(-sum(len(_triples(have, capacity, c)) for c in smallest) // MAX_PATTERNS))
    return [smallest[k::n] for k in range(n)]


def fit(pats: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeat counts whose items come closest to the histogram (projected, accelerated)."""
    n = len(pats)
    if n == 0:
        return np.zeros(0)
    size = len(histogram)
    flat, real = pats.ravel(), (pats > 0).astype(float)

    def items(x):
        got = np.bincount(flat, (x[:, None] * real).ravel(), minlength=size)
        got[0] = 0
        return got

    def back(r):
        return (r[pats] * real).sum(1)

    v = np.ones(n)
    for _ in range(12):
        v = back(items(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0.0, y - step * back(items(y) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(pats: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeat counts that the histogram holds, largest first, and the histogram that is left."""
    left = histogram.copy()
    plan = []
    order = np.argsort(-x, kind="stable")
    for k in order[: np.searchsorted(-x[order], -0.5)]:
        want = int(np.floor(x[k] + 0.5))
        sizes, need = np.unique(pats[k][pats[k] > 0], return_counts=True)
        n = min(want, int((left[sizes] // need).min()))
        if n > 0:
            left[sizes] -= n * need
            plan.append((tuple(int(s) for s in pats[k] if s), n))
    return plan, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, over counted sizes: equal packs are one entry with a count.

    Within one size the fullest packs that still take it are filled first, as often as it fits.
    """
    open_packs: dict[int, list[list]] = {}  # room -> [[sizes, count]]
    rooms: list[int] = []
    import bisect

    def add(room, sizes, count):
        if room not in open_packs:
            open_packs[room] = []
            bisect.insort(rooms, room)
        open_packs[room].append([sizes, count])

    for size in range(len(left) - 1, 0, -1):
        n = int(left[size])
        while n:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                whole, rest = divmod(n, per)
                if whole:
                    add(capacity - per * size, (size,) * per, whole)
                if rest:
                    add(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[i]
            sizes, count = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop(i)
            per = room // size
            whole, rest = divmod(min(n, per * count), per)
            if whole:
                add(room - per * size, sizes + (size,) * per, whole)
            if rest:
                add(room - rest * size, sizes + (size,) * rest, 1)
            if count - whole - bool(rest):
                add(room, sizes, count - whole - bool(rest))
            n -= whole * per + rest
    return [(tuple(sizes), count) for packs in open_packs.values() for sizes, count in packs]


def drawn(left: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """At most n patterns of sizes of the histogram that fill a pack exactly, drawn in proportion to it; 0 for none.

    The first size is drawn in proportion to the room that its items need, since large ones find no room later;
    others follow until about one mean size of room is left; one size or a pair that the histogram holds closes
    the pack, chosen in proportion to what it holds.
    """
    up_to, total = np.cumsum(left), int(left.sum())
    mean = float((left * np.arange(len(left))).sum()) / total
    width = int(np.clip(2 * capacity / mean, 1, 256))
    sizes = np.searchsorted(up_to, rng.integers(0, total, (n, width)), side="right")
    need = np.cumsum(left * np.arange(len(left)))
    sizes[:, 0] = np.searchsorted(need, rng.integers(0, int(need[-1]), n), side="right")
    kept = np.cumsum(sizes, 1) <= capacity - mean
    kept[:, 0] = True
    sizes *= kept
    room = capacity - sizes.sum(1)
    out = np.zeros((n, width + 2), np.int64)
    out[:, :width] = sizes
    pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, (r, at) in enumerate(zip(room.tolist(), rng.random(n).tolist(), strict=True)):
        if r not in pairs:
            a = np.arange(0, r // 2 + 1)
            held = np.minimum(left[a], left[r - a]) if r < len(left) else np.zeros(len(a), np.int64)
            held[0] = left[r] if r < len(left) else 0
            pairs[r] = np.flatnonzero(held), np.cumsum(held[held > 0])
        a, weight = pairs[r]
        if len(a):
            first = a[np.searchsorted(weight, at * weight[-1], side="right")]
            out[k, width:] = first, r - first
    found = np.sort(out[out[:, width:].any(1)], 1)[:, ::-1]
    found = np.unique(found, axis=0)
    return found[:, : int((found > 0).any(0).sum())]


@dataclass
class PackPlan:
    """Rank intervals per size; sorted by (size, first rank)."""

    size: np.ndarray
    first: np.ndarray
    pack: np.ndarray
    per_pack: np.ndarray
    offset: np.ndarray
    n_packs: int
    n_fitted: int


def make_plan(histogram: np.ndarray, capacity: int) -> PackPlan:
    """``histogram[s]`` items of size s, 1 <= s <= capacity."""
    fitted, left = [], histogram
    for smallest in rounds(np.flatnonzero(histogram), capacity):
        pats = patterns(np.flatnonzero(left), capacity, smallest)
        more, left = rounded(pats, fit(pats, left.astype(float)), left)
        fitted += more
    rng, packs_in_all = np.random.default_rng(7), int((histogram * np.arange(len(histogram))).sum() // capacity)
    for _ in range(DRAWN_ROUNDS):
        packs_left = int((left * np.arange(len(left))).sum() // capacity)
        if packs_left <= packs_in_all // RESIDUAL_SHARE + 1:  # best fit needs some of all sizes to fill up the last packs
            break
        # part of every size stays, in proportion
        offered = left - left // RESIDUAL_SHARE
        pats = drawn(offered, capacity, min(DRAWN_PATTERNS, packs_left), rng)
        more, rest = rounded(pats, fit(pats, offered.astype(float), DRAWN_ITERATIONS), offered)
        left = left - offered + rest
        fitted += more
        if sum(n for _, n in more) < packs_left // 50:
            break
    used = np.zeros(len(histogram), np.int64)
    rows, packs = [], 0
    n_fitted = sum(n for _, n in fitted)
    for content, n in fitted + best_fit(left, capacity):
        offset = 0
        for s, m in zip(*np.unique(content, return_counts=True), strict=True):
            rows.append((int(s), int(used[s]), packs, int(m), offset))
            used[s] += n * m
            offset += int(s * m)
        packs += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return PackPlan(*table.T, n_packs=packs, n_fitted=n_fitted)


def pieces_of(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, size): whole documents, or full packs and a remainder."""
    n = F.col("n_tokens")
    cut = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.ceil(n / capacity).cast("bigint") - 1),
        lambda i: F.struct(
            i.cast("int").alias("piece"),
            (i * capacity).alias("first_token"),
            F.least(F.lit(capacity).cast("bigint"), n - i * capacity).cast("int").alias("size"),
        ),
    )
    return counts.where(n > 0).select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.*")


def pack_documents(counts: DataFrame, capacity: int, pack_name: str = "pack") -> DataFrame:
    """Assign every document, ``counts`` being (doc_id, n_tokens), one row per doc_id.

    Returns pack_name, capacity_tokens, pack_id, doc_id, piece, first_token, n_tokens, pack_offset.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = pieces_of(counts, capacity)
    n_items = F.count(F.lit(1)).alias("n")
    by_size = items.groupBy("size").agg(n_items).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in by_size:
        histogram[row["size"]] = row["n"]
    plan = make_plan(histogram, capacity)
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("size", "bucket").agg(n_items).select(
        "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    if min(BUCKETS * len(by_size), int(histogram.sum())) <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    own = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece"))
    ranked = bucketed.withColumn("own", own).join(starts, ["size", "bucket"]).withColumn("rank", F.col("start") + F.col("own") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan.size * (1 << 44) + plan.first
        for b in batches:
            size, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            at = np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1
            nth = rank - plan.first[at]
            pack = plan.pack[at] + nth // plan.per_pack[at]
            offset = plan.offset[at] + nth % plan.per_pack[at] * size
            yield pa.RecordBatch.from_arrays(
                [pa.array(pack, pa.int64()), b.column(0), b.column(1), b.column(2), pa.array(size, pa.int64()), pa.array(offset, pa.int64())],
                names=["pack_id", "doc_id", "piece", "first_token", "n_tokens", "pack_offset"],
            )

    schema = "pack_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint, pack_offset bigint"
    placed = ranked.select("doc_id", "piece", "first_token", "size", "rank").mapInArrow(place, schema)
    roomless = counts.where("n_tokens = 0").selectExpr(
        "cast(null as bigint) pack_id", "doc_id", "0 piece", "0L first_token", "0L n_tokens", "cast(null as bigint) pack_offset"
    )
    return placed.unionByName(roomless).select(
        F.lit(pack_name).alias("pack_name"), F.lit(capacity).cast("bigint").alias("capacity_tokens"), "*"
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: packs, documents, tokens, and the share of room that is used."""
    return packed.groupBy("pack_name", "capacity_tokens").agg(
        F.countDistinct("pack_id").alias("n_packs"),
        F.countDistinct("doc_id").alias("n_documents"),
        F.sum("n_tokens").alias("n_tokens"),
    ).withColumn("fill", F.try_divide(F.col("n_tokens"), F.col("n_packs") * F.col("capacity_tokens")))
