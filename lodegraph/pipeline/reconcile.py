"""Differences between two copies of a table, field by field, over shared key ordinals.

Both copies are co-partitioned by a hash of the key into buckets of bounded size.  Inside a bucket the
distinct keys of both sides get shared ordinals, each side becomes a compressed presence bitmap over
them, AND-NOT gives the rows one side lacks, and the intersection drives a columnar comparison in which
row i of either side is ordinal i.

Defined results
---------------
* Repeated rows count once.  If a side holds several versions of a key, a field differs when the sets
  of its values differ.
* Texts are equal only character by character; null equals only null (an empty text is no null).
* Truth values are compared by meaning (see ``truth``); a spelling without one differs from both.
* A null key part is a value like any other.  Two empty copies agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.bitmaps import PresenceBitmap
from lodegraph.pipeline.snapshot_changes import small_enough
from lodegraph.session import shuffle_width

#: Rows of both sides together that one bucket should hold at most.
ROWS_PER_BUCKET = 200_000

#: Spellings of truth, compared without case and outer blanks.
TRUE_SPELLINGS = ("true", "t", "yes", "y", "1", "on", "1.0")
FALSE_SPELLINGS = ("false", "f", "no", "n", "0", "off", "0.0")


def truth(c: Column) -> Column:
    """'true', 'false', null, or the text itself behind '?' when it means neither."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE_SPELLINGS), "true").when(text.isin(*FALSE_SPELLINGS), "false").when(
        c.isNotNull(), F.concat(F.lit("?"), c.cast("string"))
    )


def _comparer(fields: list[str], names: tuple[str, str]):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        n_left = left.num_rows
        both = pa.concat_tables([left.select(["k1", "k2", *fields]), right.select(["k1", "k2", *fields])])
        # the length of the first part says where the second begins, whatever characters they hold
        length = pc.fill_null(pc.cast(pc.binary_length(both["k1"]), pa.string()), "-")
        second = pc.if_else(pc.is_null(both["k2"]), "-", pc.binary_join_element_wise("+", pc.fill_null(both["k2"], ""), ""))
        key = pc.binary_join_element_wise(length, pc.fill_null(both["k1"], ""), second, ":")
        coded = pc.dictionary_encode(key.combine_chunks())
        ordinal = coded.indices.to_numpy().astype(np.int64)
        first = np.full(len(coded.dictionary), -1, dtype=np.int64)
        first[ordinal[::-1]] = np.arange(len(ordinal) - 1, -1, -1)  # a row that spells the key of an ordinal
        here, there = PresenceBitmap.of(ordinal[:n_left]), PresenceBitmap.of(ordinal[n_left:])
        found: list[tuple[str, np.ndarray]] = [
            (names[0], here.and_not(there).ordinals()),
            (names[1], there.and_not(here).ordinals()),
        ]
        shared = np.zeros(len(first), dtype=bool)
        shared[here.intersect(there).ordinals()] = True
        for f in fields:
            values = pc.dictionary_encode(both[f].combine_chunks(), null_encoding="encode")
            pair = ordinal * (len(values.dictionary) + 1) + values.indices.to_numpy().astype(np.int64)
            a, b = np.unique(pair[:n_left][shared[ordinal[:n_left]]]), np.unique(pair[n_left:][shared[ordinal[n_left:]]])
            off = np.setxor1d(a, b, assume_unique=True) // (len(values.dictionary) + 1)
            found.append((f, np.unique(off)))
        rows = np.concatenate([first[o] for _, o in found])
        kinds = np.repeat([k for k, _ in found], [len(o) for _, o in found])
        picked = both.select(["k1", "k2"]).take(pa.array(rows))
        return pa.table({"k1": picked["k1"], "k2": picked["k2"], "diff_kind": pa.array(kinds, pa.string())})

    return compare


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: tuple[str, str],
    fields: list[str],
    n_buckets: int,
    names: tuple[str, str] = ("only_in_left", "only_in_right"),
) -> DataFrame:
    """(k1, k2, diff_kind): keys on one side only, and one row per shared key and differing field."""

    def side(df: DataFrame) -> DataFrame:
        k1, k2 = (F.col(k).cast("string") for k in keys)
        bucket = F.pmod(F.xxhash64(k1, k2, k1.isNull()), F.lit(n_buckets)).cast("int")
        return df.select(bucket.alias("b"), k1.alias("k1"), k2.alias("k2"), *[F.col(f).cast("string").alias(f) for f in fields]).distinct()

    return (
        side(left).groupBy("b").cogroup(side(right).groupBy("b"))
        .applyInArrow(_comparer(fields, names), schema="k1 string, k2 string, diff_kind string")
    )


def last_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("created_at is not null and snapshot_id is not null").groupBy("graph_name").agg(
        F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id")
    )


def graph_export_differences(
    entities: DataFrame,
    relationships: DataFrame,
    entities_export: DataFrame,
    relationships_export: DataFrame,
    snapshots: DataFrame,
) -> DataFrame:
    """(table_name, graph_name, record_id, diff_kind) between the last snapshots and their export."""
    spark = entities.sparkSession
    last = last_snapshots(snapshots)
    last = F.broadcast(last) if small_enough(snapshots) else last

    def newest(df: DataFrame) -> DataFrame:
        return df.join(last, ["graph_name", "snapshot_id"], "left_semi")

    out = []
    for name, mine, theirs, texts, truths in (
        ("entities", entities, entities_export, ["title"], ["is_deterministic", "dynamic_dependent"]),
        ("relationships", relationships, relationships_export, ["resolved_target_hint"], []),
    ):
        fields = texts + truths
        # both sides count: an export may be empty or broken, and the other side whole
        rows = theirs.count() + newest(mine.select("graph_name", "snapshot_id")).count()
        n = max(shuffle_width(spark), -(-rows // ROWS_PER_BUCKET))
        shape = lambda df: df.select("graph_name", "id", *texts, *[truth(F.col(c)).alias(c) for c in truths])
        found = reconcile(
            shape(newest(mine.select("graph_name", "snapshot_id", "id", *fields))),
            shape(theirs),
            ("graph_name", "id"),
            fields,
            n,
            ("only_in_graph", "only_in_export"),
        )
        out.append(
            found.select(
                F.lit(name).alias("table_name"), F.col("k1").alias("graph_name"), F.col("k2").alias("record_id"), "diff_kind"
            )
        )
    return out[0].unionByName(out[1])


def difference_rates(differences: DataFrame) -> DataFrame:
    return differences.groupBy("table_name", "graph_name", "diff_kind").agg(F.count(F.lit(1)).alias("n_records"))
