"""References to records that do not exist: range-partitioned sorted key arrays and binary search.

Keys are 128-bit digests of (graph, snapshot, key text), two independently seeded 64-bit hashes.
The first half is uniform, so equal-width ranges of it hold equally many keys whatever the data looks
like.  Every map task sorts its keys, drops repeats and sends each range its part as one packed array;
the range number is the partition, so this is the only exchange of keys.  Per range the parents are
sorted arrays, and the distinct references are probed against them as one vector by binary search.

Only the misses return to the rows: a bit array over their digests, of at most ``MAX_FILTER_BITS``, is
broadcast and thins the references before they are shuffled for the exact semi-join.  It only thins; a
miss is never lost by it.

A key that a third of all references name is one entry per map task, so no range is hot.  A referenced
key always hashes like its parent, so nothing is reported wrongly; that a missing key equals a parent in
all 128 bits has odds of 1e-20 at 1e9 keys.

Defined results
---------------
* Null and empty references refer to nothing.  Null graphs and snapshots are values like others.
* Repeated rows count once.  A null record id is reported as null.
* No parents: every reference is missing.  No references: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import shuffle_width

#: Keys that one range should hold at most; 16 bytes each.
KEYS_PER_RANGE = 400_000
#: Keys of one kind that a map task sorts at a time.
KEYS_PER_SORT = 2_000_000
#: Bits of the broadcast filter: one for each eight keys, within these bounds (the upper one is 32 MB).
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 16, 1 << 28
WORDS = 64  # 64-bit words in a row of the filter

#: What a key is: the id or the title of a parent, or a reference that an id or a title answers, or only an id.
PARENT_ID, PARENT_TITLE, REF_ANY, REF_ID = range(4)


def digests(*values: Column) -> list[Column]:
    """Two 64-bit halves over null-flagged values."""
    parts = [p for v in values for p in (v.isNull(), v)]
    return [F.xxhash64(F.lit(17), *parts).alias("h1"), F.xxhash64(F.lit(90_001), *parts, F.lit(3)).alias("h2")]


def ranges_of(h1: np.ndarray, n_ranges: int) -> np.ndarray:
    """Numbers of the equal-width ranges of the signed 64-bit space; they ascend with ``h1``."""
    return (((h1 >> 33) + 2**30) * (n_ranges / 2**31)).astype(np.int32)


def distinct_sorted(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in the order of ``h1``, repeats dropped as far as they are neighbours (of one ``h1`` nearly all are)."""
    order = np.argsort(h1, kind="stable")
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1[new], h2[new]


def _packer(n_ranges: int):
    names = ["r", "kind", "h1", "h2"]

    def flush(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h1, h2 = distinct_sorted(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        r = ranges_of(h1, n_ranges)
        first = np.flatnonzero(np.diff(r, prepend=-1))
        ends = np.append(first, len(r))[1:]
        spans = list(zip(first.tolist(), ends.tolist(), strict=True))
        packed = [pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()) for h in (h1, h2)]
        return pa.RecordBatch.from_arrays([pa.array(r[first]), pa.array(np.full(len(first), kind, np.int32)), *packed], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for b in batches:
            kinds, h1, h2 = (b.column(k).to_numpy() for k in range(3))
            for kind in np.unique(kinds).tolist():
                mine = kinds == kind
                held.setdefault(kind, []).append((h1[mine], h2[mine]))
                size[kind] = size.get(kind, 0) + int(mine.sum())
                if size[kind] >= KEYS_PER_SORT:
                    yield flush(kind, held.pop(kind))
                    size[kind] = 0
        for kind, parts in held.items():
            yield flush(kind, parts)

    return pack


def unanswered(refs: tuple[np.ndarray, np.ndarray], *parents: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which references are in none of the parent arrays, all sorted by the first half."""
    h1, h2 = refs
    left = np.arange(len(h1))
    for p1, p2 in parents:
        hit = np.zeros(len(left), bool)
        at = np.searchsorted(p1, h1[left], side="left")
        seek = np.arange(len(left))
        while len(seek):  # runs of one h1 are nearly always a single key
            seek = seek[at[seek] < len(p1)]
            seek = seek[p1[at[seek]] == h1[left[seek]]]
            same = p2[at[seek]] == h2[left[seek]]
            hit[seek[same]] = True
            seek = seek[~same]
            at[seek] += 1
        left = left[~hit]
    return left


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The references of the partition's ranges that no parent answers."""
    ranges: dict[int, dict[int, list]] = {}
    for b in batches:
        for r, kind, h1, h2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ranges.setdefault(r, {}).setdefault(kind, []).append((np.frombuffer(h1, np.int64), np.frombuffer(h2, np.int64)))
    none = (np.zeros(0, np.int64),) * 2
    for r in list(ranges):
        by_kind = {k: distinct_sorted(*(np.concatenate(c) for c in zip(*v, strict=True))) for k, v in ranges.pop(r).items()}
        ids, titles = by_kind.get(PARENT_ID, none), by_kind.get(PARENT_TITLE, none)
        for kind, parents in ((REF_ANY, (ids, titles)), (REF_ID, (ids,))):
            refs = by_kind.get(kind, none)
            left = unanswered(refs, *parents)
            if len(left):
                arrays = [pa.array(refs[0][left]), pa.array(refs[1][left]), pa.array(np.full(len(left), kind, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "kind"])


def missing_keys(keys: DataFrame, n_ranges: int) -> DataFrame:
    """``keys``: kind, h1, h2 of parents and references -> h1, h2, kind of the distinct references without a parent."""
    packed = keys.select("kind", "h1", "h2").mapInArrow(_packer(n_ranges), "r int, kind int, h1 binary, h2 binary")
    return packed.repartitionById(n_ranges, F.col("r")).mapInArrow(_probe, "h1 bigint, h2 bigint, kind int").distinct()


def _filter_place(bits: int) -> dict[str, Column]:
    x = F.col("h1").bitwiseAND(F.lit(bits - 1))
    return {"block": F.shiftright(x, 12).cast("int"), "word": F.shiftright(x, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"), "bit": x.bitwiseAND(F.lit(63)).cast("int")}


def thinned(refs: DataFrame, missing: DataFrame, bits: int) -> DataFrame:
    """The rows of ``refs`` whose bit is set by a row of ``missing``: all that are missing, and few others."""
    place = _filter_place(bits)
    words = missing.select(*[c.alias(n) for n, c in place.items()]).groupBy("block", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    blocks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select(
        "block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("words")
    )
    joined = refs.withColumns(place).join(F.broadcast(blocks), "block")
    return joined.where(F.expr("getbit(words[word], bit) = 1")).drop("block", "word", "bit", "words")


def reference_rows(relationships: DataFrame, text_units: DataFrame) -> DataFrame:
    """All references as (table_name, graph_name, snapshot_id, record_id, ref_field, h1, h2, kind)."""

    def of(df: DataFrame, table: str, fields: list[str], kind: int) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields]))
        flat = df.select("graph_name", "snapshot_id", F.col("id").alias("record_id"), pairs.alias("p"))
        return flat.where("p.v is not null and p.v <> ''").select(
            F.lit(table).alias("table_name"),
            "graph_name",
            "snapshot_id",
            "record_id",
            F.col("p.f").alias("ref_field"),
            *digests(F.col("graph_name"), F.col("snapshot_id"), F.col("p.v")),
            F.lit(kind).alias("kind"),
        )

    return of(relationships, "relationships", ["source", "target"], REF_ANY).unionByName(
        of(text_units, "text_units", ["entity_id"], REF_ID)
    )


def parent_keys(entities: DataFrame) -> DataFrame:
    pairs = F.explode(
        F.array(
            F.struct(F.lit(PARENT_ID).alias("kind"), F.col("id").alias("v")),
            F.struct(F.lit(PARENT_TITLE).alias("kind"), F.col("title").alias("v")),
        )
    )
    flat = entities.select("graph_name", "snapshot_id", pairs.alias("p")).where("p.v is not null")
    return flat.select(*digests(F.col("graph_name"), F.col("snapshot_id"), F.col("p.v")), "p.kind")


def orphan_references(entities: DataFrame, relationships: DataFrame, text_units: DataFrame) -> DataFrame:
    """(table_name, graph_name, snapshot_id, record_id, ref_field) of every unanswered reference."""
    spark = entities.sparkSession
    keys = 2 * entities.count() + 2 * relationships.count() + text_units.count()  # footers only
    n_ranges = max(shuffle_width(spark), -(-keys // KEYS_PER_RANGE))
    bits = 1 << min(max(keys // 8, MIN_FILTER_BITS), MAX_FILTER_BITS).bit_length() - 1
    refs = reference_rows(relationships, text_units)
    key = ["h1", "h2", "kind"]
    missing = missing_keys(parent_keys(entities).unionByName(refs.select(*key)), n_ranges)
    # an inner join with distinct keys: a semi-join would be pushed below the filter, and shuffle all references
    return (
        thinned(refs, missing, bits)
        .join(missing, key)
        .select("table_name", "graph_name", "snapshot_id", "record_id", "ref_field")
        .distinct()
    )


def orphan_report(orphans: DataFrame, snapshots: DataFrame, period: str = "month") -> DataFrame:
    """Orphan references per table, field and period of the snapshot's creation."""
    when = snapshots.groupBy("graph_name", "snapshot_id").agg(F.min("created_at").alias("created_at"))
    counted = orphans.groupBy("graph_name", "snapshot_id", "table_name", "ref_field").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        counted.join(when, ["graph_name", "snapshot_id"], "left")
        .groupBy("table_name", "ref_field", F.date_trunc(period, "created_at").alias("period"))
        .agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_snapshots"))
    )
