"""Changes between consecutive full snapshots: gaps and islands over (key, row hash).

Every record is reduced to the set of (snapshot ordinal, row hash) pairs it occurs with.  Runs of
neighbouring ordinals that carry one hash are its validity intervals ("islands"); the places where an
interval starts, ends or touches the next one are the change events.

Defined results
---------------
* A repeated row counts once: the pairs form a set, collapsed map-side before the only shuffle.
* Rows of one key and snapshot that disagree: the version with the greatest row hash stands for it.
* ``null`` equals ``null``; a floating-point ``NaN`` is ``null`` and ``-0.0`` is ``0.0``.
* A null key is a key like any other (its record_id is null); a row whose snapshot no manifest
  registers cannot be ordered and belongs to no interval.
* A registered snapshot without rows of a table ends all open intervals of that table.
* Empty tables give no rows; surplus columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Snapshot registers of at most so many rows (about 150 bytes each, so 30 MB) are broadcast; larger ones are shuffled.
BROADCAST_SNAPSHOTS = 200_000


def comparable(df: DataFrame, column: str) -> Column:
    """The column with NaN as null and one zero, so that equal numbers have equal hashes."""
    c = F.col(column)
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.when(F.isnan(c), None).otherwise(c + F.lit(0.0))
    return c


def row_hash(*values: Column) -> Column:
    """64 bits over values and null flags; only neighbouring versions of one key are ever compared."""
    return F.xxhash64(*values, *[v.isNull() for v in values])


def snapshot_ordinals(snapshots: DataFrame) -> DataFrame:
    """(graph_name, snapshot_id, ordinal from 1, last ordinal, previous snapshot) by created_at."""
    seen = (
        snapshots.where("created_at is not null and snapshot_id is not null")
        .groupBy("graph_name", "snapshot_id")
        .agg(F.min("created_at").alias("created_at"))
    )
    by_time = Window.partitionBy("graph_name").orderBy("created_at", "snapshot_id")
    return seen.select(
        "graph_name",
        "snapshot_id",
        F.row_number().over(by_time).alias("ordinal"),
        F.count(F.lit(1)).over(Window.partitionBy("graph_name")).cast("int").alias("last_ordinal"),
        "created_at",
    )


def small_enough(snapshots: DataFrame, limit: int = BROADCAST_SNAPSHOTS) -> bool:
    """Whether the register may be broadcast. Counting a Parquet table reads its footers only."""
    return snapshots.count() <= limit


def validity_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``: keys, ordinal int, last_ordinal int, hash bigint -> keys, last_ordinal, intervals.

    ``intervals`` is an array of (first, last, hash), ordered and disjoint.  One shuffle, by the keys;
    the set of pairs is built map-side first.  An array is as long as one record has snapshots.
    """
    packed = rows.groupBy(*keys).agg(
        F.max("last_ordinal").alias("last_ordinal"),
        F.array_sort(F.collect_set(F.struct("ordinal", "hash"))).alias("_all"),
    )
    # of several hashes in one snapshot the greatest is kept: the sorted array holds it last
    packed = packed.withColumn(
        "_v",
        F.expr("filter(_all, (x, i) -> i = size(_all) - 1 or get(_all, i + 1).ordinal <> x.ordinal)"),
    )
    packed = packed.withColumn(
        "_starts",
        F.expr(
            "filter(sequence(0, size(_v) - 1), i -> i = 0 or _v[i].ordinal <> _v[i - 1].ordinal + 1"
            " or _v[i].hash <> _v[i - 1].hash)"
        ),
    )
    return packed.select(
        *keys,
        "last_ordinal",
        F.expr(
            "transform(_starts, (s, k) -> named_struct('first', _v[s].ordinal, 'last',"
            " _v[coalesce(get(_starts, k + 1), size(_v)) - 1].ordinal, 'hash', _v[s].hash))"
        ).alias("intervals"),
    )


def change_events(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Interval starts, ends and adjacencies as (keys, ordinal of the later snapshot, change_kind)."""
    events = F.expr(
        "filter(flatten(transform(intervals, (x, k) -> array("
        " named_struct('ordinal', x.first, 'change_kind',"
        "   case when k > 0 and get(intervals, k - 1).last = x.first - 1 then 'changed'"
        "        when x.first > 1 then 'added' end),"
        " named_struct('ordinal', x.last + 1, 'change_kind',"
        "   case when x.last < last_ordinal"
        "         and coalesce(get(intervals, k + 1).first, -1) <> x.last + 1 then 'removed' end)"
        "))), e -> e.change_kind is not null)"
    )
    return intervals.select(*keys, F.explode(events).alias("_e")).select(
        *keys, F.col("_e.ordinal").alias("ordinal"), F.col("_e.change_kind").alias("change_kind")
    )


def snapshot_changes(tables: dict[str, tuple[DataFrame, str]], snapshots: DataFrame) -> DataFrame:
    """Change events of several tables; ``tables``: name -> (rows, column whose change counts).

    Returns (table_name, graph_name, snapshot_id, record_id, change_kind), the snapshot being the
    later one of the pair.
    """
    register = snapshot_ordinals(snapshots)
    small = small_enough(snapshots)
    hint = F.broadcast if small else (lambda df: df)
    parts = []
    for name, (df, column) in tables.items():
        parts.append(
            df.select(
                F.lit(name).alias("table_name"),
                "graph_name",
                "snapshot_id",
                F.col("id").alias("record_id"),
                row_hash(comparable(df, column)).alias("hash"),
            )
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keys = ["table_name", "graph_name", "record_id"]
    placed = rows.join(
        hint(register.select("graph_name", "snapshot_id", "ordinal", "last_ordinal")), ["graph_name", "snapshot_id"]
    ).drop("snapshot_id")
    events = change_events(validity_intervals(placed, keys), keys)
    names = hint(register.select("graph_name", "ordinal", "snapshot_id"))
    return events.join(names, ["graph_name", "ordinal"]).select(
        "table_name", "graph_name", "snapshot_id", "record_id", "change_kind"
    )


def change_rates(changes: DataFrame) -> DataFrame:
    """Number of changes per table, snapshot and kind."""
    return changes.groupBy("table_name", "graph_name", "snapshot_id", "change_kind").agg(
        F.count(F.lit(1)).alias("n_records")
    )
