"""Row differences between two snapshots of a table, and of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.windows import capped

BY = "graph_name"


class RowIndexError(ValueError):
    """Rows cannot be indexed by id."""


def check_ids(df: DataFrame, keys: list[str]) -> None:
    """Ids must be non-empty texts without duplicates."""
    id_ = keys[-1]
    if not df.where(F.col(id_).isNull() | (F.trim(id_) == "")).isEmpty():
        raise RowIndexError(f"{id_} is missing in a row")
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise RowIndexError(f"{id_} occurs twice")


def _value(df: DataFrame, c: str) -> Column:
    return F.when(F.isnan(F.col(c)), None).otherwise(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)


def check_finite(df: DataFrame) -> None:
    """An infinite number has no canonical form."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    if numbers:
        bad = F.lit(False)
        for c in numbers:
            bad = bad | (F.abs(F.col(c)) == F.lit(float("inf")))
        if not df.where(bad).isEmpty():
            raise ValueError("a number is infinite")


def row_diff(before: DataFrame, after: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """(keys, change, fields): added, removed, and modified rows with the sorted names of their changed columns.

    Null equals NaN; types are strict; a column that only one side has counts as changed in every shared row.
    """
    types_a, types_b = dict(before.dtypes), dict(after.dtypes)
    shared = sorted(c for c in types_a.keys() & types_b.keys() if c not in keys and c not in ignore)
    alone = sorted(c for c in types_a.keys() ^ types_b.keys() if c not in keys and c not in ignore)
    strict = [c for c in shared if types_a[c] != types_b[c]]
    a = before.select(*keys, *[_value(before, c).alias(f"a_{c}") for c in shared], F.lit(True).alias("_a"))
    b = after.select(*keys, *[_value(after, c).alias(f"b_{c}") for c in shared], F.lit(True).alias("_b"))
    j = a.join(b, keys, "full_outer")
    tests = {c: F.lit(True) if c in strict else ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in shared} | {c: F.lit(True) for c in alone}
    names = [F.when(t, F.lit(c)) for c, t in sorted(tests.items())]
    fields = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(fields) > 0, "modified")
    out = j.select(*keys, change.alias("change"), F.when(change == "modified", fields).alias("fields"))
    return out.where("change is not null")


def diff_summary(diff: DataFrame, by: list[str]) -> DataFrame:
    """Exact numbers of added, removed and modified rows."""
    return diff.groupBy(*by).agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "modified")])


def diff_samples(diff: DataFrame, by: list[str], key: str, n: int = 50) -> DataFrame:
    """The first ids of each kind of change in byte order, with exact totals; at most 500."""
    return capped(diff, [*by, "change"], [key], min(n, 500)).select(*by, "change", "rank", key, "total", "truncated")


def manifest_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of two string maps: added, removed and changed. One row each side, joined by ``graph_name``."""
    j = before.select(BY, F.col("manifest").alias("a")).join(after.select(BY, F.col("manifest").alias("b")), BY)
    shared = F.array_intersect(F.map_keys("a"), F.map_keys("b"))
    return j.select(
        BY,
        F.sort_array(F.array_except(F.map_keys("b"), F.map_keys("a"))).alias("added"),
        F.sort_array(F.array_except(F.map_keys("a"), F.map_keys("b"))).alias("removed"),
        F.sort_array(F.filter(shared, lambda k: ~F.element_at("a", k).eqNullSafe(F.element_at("b", k)))).alias("changed"),
    )
