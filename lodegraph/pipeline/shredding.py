"""Deeply nested records as flat tables: columnar shredding with repetition and definition levels.

A record is an object whose ``inner`` repeats: the leaf paths are ``kind``, ``inner.kind``,
``inner.inner.kind`` ... and the same with ``loc.file``.  All leaves below one repeated ancestor share
their repetition levels, so per depth there is one level column and one value list per leaf:

* repetition level r of an entry: 0 starts a record, r > 0 continues the list at depth r;
* definition level: 2j-1 says the list element at depth j exists, 2j that it is an object.

``shred`` derives the column of depth d from that of depth d-1 by expansion: an entry with children
becomes one entry per child, any other is carried on as it ended.  ``assemble`` uses the level columns
only: an entry with r < d descends from the next entry of the column above, the list index is the
number of entries with r = d since, and a node is an entry whose definition level is 2d.

A record leaves the columns of the depths it has no object at, so that one very deep record costs
nothing to the others of its batch.

Defined results
---------------
* A text that is not exactly one JSON object (null, empty, array, truncated, NaN inside) gives no rows.
* An object in place of the ``inner`` list is a list of one; other values of ``inner`` hold nothing.
* Elements that are no objects keep their position and are no nodes.
* ``kind`` and ``file`` keep numbers as written; booleans become true/false, containers null.
* Repeated rows and several texts of one id: each (id, path) comes out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.strict_json import loads

NODE_SCHEMA = "record_id bigint, depth int, parent_path string, node_path string, kind string, file string"
LEVEL_SCHEMA = "record_id bigint, depth int, rep array<int>, def array<int>, kind array<string>, file array<string>"


def _leaf(value) -> str | None:
    if isinstance(value, str):
        return value
    return {True: "true", False: "false"}.get(value) if isinstance(value, bool) else None


def _children(node: dict) -> list:
    inner = node.get("inner")
    return inner if isinstance(inner, list) else [inner] if isinstance(inner, dict) else []


def _file(node: dict) -> str | None:
    loc = node.get("loc")
    return _leaf(loc.get("file")) if isinstance(loc, dict) else None


def shred(roots: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list, list]]:
    """Per depth: (depth, record of each entry, rep, def, kinds of its nodes, files of its nodes).

    Kinds and files have one entry per node, that is per entry whose definition level is 2 * depth.
    """
    record = np.arange(len(roots))
    rep, level = np.zeros(len(roots), np.int32), np.zeros(len(roots), np.int32)
    live, depth = list(roots), 0
    while live:
        yield depth, record, rep, level, [_leaf(x.get("kind")) for x in live], [_file(x) for x in live]
        depth += 1
        lists = [_children(x) for x in live]
        is_live = level == 2 * (depth - 1)
        fan = np.ones(len(rep), np.int64)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        fan[is_live] = np.maximum(sizes, 1)
        first = np.cumsum(fan) - fan
        new_record, new_level = np.repeat(record, fan), np.repeat(level, fan)
        new_rep = np.full(len(new_record), depth, np.int32)
        new_rep[first] = rep
        elements = [e for x in lists for e in x]
        opened = np.zeros(len(rep), bool)
        opened[is_live] = sizes > 0
        spots = np.repeat(opened, fan)
        objects = np.fromiter((isinstance(e, dict) for e in elements), bool, len(elements))
        new_level[spots] = np.where(objects, 2 * depth, 2 * depth - 1)
        live = [e for e in elements if isinstance(e, dict)]
        kept = np.zeros(len(roots), bool)
        kept[new_record[new_level == 2 * depth]] = True
        keep = kept[new_record]
        record, rep, level = new_record[keep], new_rep[keep], new_level[keep]


def assemble(columns, n_records: int) -> Iterator[tuple[int, np.ndarray, pa.Array, pa.Array]]:
    """Per depth: (depth, record of each node, parent paths, node paths), from level columns alone."""
    above: tuple[np.ndarray, pa.Array] | None = None
    for depth, record, rep, level, *_ in columns:
        if depth == 0:
            paths = pa.array(["0"] * len(rep), pa.string())
            yield 0, record, pa.nulls(len(rep), pa.string()), paths
            above = (record, paths)
            continue
        here = np.zeros(n_records, bool)
        here[record] = True
        old_record, old_paths = above
        candidates = np.flatnonzero(here[old_record])  # entries of records that reach this depth, in order
        parent = candidates[np.cumsum(rep < depth) - 1]
        step = np.cumsum(rep == depth)
        index = step - np.maximum.accumulate(np.where(rep < depth, step, 0))
        nodes = level == 2 * depth
        came = old_paths.take(pa.array(parent))
        grown = pc.binary_join_element_wise(came, pc.cast(pa.array(index), pa.string()), ".")
        # entries that ended above keep the path they ended with; nothing below reads it
        yield depth, record[nodes], came.filter(pa.array(nodes)), grown.filter(pa.array(nodes))
        above = (record, pc.if_else(pa.array(level >= 2 * depth - 1), grown, came))


def _parse(batch: pa.RecordBatch) -> tuple[list[int | None], list[dict]]:
    ids, roots = [], []
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if not text:
            continue
        try:
            value = loads(text)
        except ValueError:
            continue
        if isinstance(value, dict):
            ids.append(key)
            roots.append(value)
    return ids, roots


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    for batch in _slices(batches):
        ids, roots = _parse(batch)
        key = pa.array(ids, pa.int64())
        columns = list(shred(roots))
        for (depth, record, parents, paths), column in zip(assemble(columns, len(roots)), columns, strict=True):
            yield pa.RecordBatch.from_arrays(
                [
                    key.take(pa.array(record)),
                    pa.array(np.full(len(record), depth, np.int32)),
                    parents,
                    paths,
                    pa.array(column[4], pa.string()),
                    pa.array(column[5], pa.string()),
                ],
                names=names,
            )


def node_table(records: DataFrame, key: str = "ast_id", text: str = "ast_json") -> DataFrame:
    """All objects of all records, roots included, one row per (record, path): see NODE_SCHEMA."""
    source = records.select(F.col(key).cast("bigint"), text).where(F.col(text).isNotNull())
    return source.mapInArrow(_nodes, NODE_SCHEMA)


def child_links(records: DataFrame, key: str = "ast_id", text: str = "ast_json") -> DataFrame:
    """(record_id, parent_path, node_path) of every node below the roots; each row is distinct."""
    nodes = node_table(records, key, text).where("depth > 0")
    return nodes.select("record_id", "parent_path", "node_path").distinct()


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.int32())] * 2 + [pa.list_(pa.string())] * 2
    for batch in _slices(batches):
        ids, roots = _parse(batch)
        for depth, record, rep, level, kind, file in shred(roots):
            starts = np.flatnonzero(rep == 0)
            node_counts = np.add.reduceat(level == 2 * depth, starts) if len(starts) else np.array([], int)
            offsets = pa.array(np.append(starts, len(rep)), pa.int32())
            node_offsets = pa.array(np.concatenate(([0], np.cumsum(node_counts))), pa.int32())
            arrays = [
                pa.ListArray.from_arrays(o, pa.array(v, t.value_type))
                for o, v, t in zip((offsets, offsets, node_offsets, node_offsets), (rep, level, kind, file), kinds, strict=True)
            ]
            own = pa.array([ids[r] for r in record[starts]], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(np.full(len(starts), depth, np.int32)), *arrays],
                names=[f.split()[0] for f in LEVEL_SCHEMA.split(", ")],
            )


def level_columns(records: DataFrame, key: str = "ast_id", text: str = "ast_json") -> DataFrame:
    """The shredded form itself: per record and depth the level sequences and the leaf values."""
    source = records.select(F.col(key).cast("bigint"), text).where(F.col(text).isNotNull())
    return source.mapInArrow(_levels, LEVEL_SCHEMA)


def kind_report(records: DataFrame, key: str = "ast_id", text: str = "ast_json") -> DataFrame:
    """Nodes per kind: how many, in how many records, how deep, and how many name a file."""
    nodes = node_table(records, key, text).dropDuplicates(["record_id", "node_path"])
    return nodes.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.countDistinct("record_id").alias("n_records"),
        F.max("depth").alias("max_depth"),
        F.count("file").alias("n_files"),
    )
