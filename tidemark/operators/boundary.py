"""Merging objects across the first and last column.

Two policies: "compat" goes once through the edge's labels in order, so chains may stay apart; "closure" joins all that
touch. Edge pairs are distinct labels of two columns; only these reach the kernel.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Grid
from .graph import TOGETHER, connected, cut, dealt, numbered


def edge_pairs(labels: DataFrame, grid: Grid, keys: list[str], label: str = "label") -> DataFrame:
    """keys, first, last, for labels in the first and the last column of one row."""
    first = labels.filter("x = 0").select(*keys, "y", F.col(label).alias("first"))
    last = labels.filter(F.col("x") == grid.x - 1).select(*keys, "y", F.col(label).alias("last"))
    return first.join(last, [*keys, "y"])


def ordered_merge(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """What each label becomes when the labels of the first column, in ascending order, take over those they face. Rows
    change as soon as a label does. Labels of one name form a group; what a label faces is looked at once, as it then
    belongs to the label's group for good."""
    facing: dict[int, list[int]] = defaultdict(list)
    for a, b in pairs:
        facing[a].append(b)
    up = {x: x for p in pairs for x in p}
    name, members = dict(up), {x: [x] for x in up}  # of each group's root: its name, and its labels of the first column

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    named = dict(up)  # name -> root
    for value in sorted(facing):
        own = named.get(value)
        if own is None:
            continue
        gone = {root(b) for a in members[own] for b in facing.pop(a, ())} - {own}
        for g in gone:
            del named[name[g]]
            big, small = (own, g) if len(members[own]) >= len(members[g]) else (g, own)
            up[small] = big
            members[big] += members.pop(small)
            own = big
        name[own], named[value] = value, own
    return {x: n for x in up if (n := name[root(x)]) != x}


def slice_merge(rows: list[tuple[int, int, int]]) -> dict[int, int]:
    """rows (y, left, right) of one slice: by y, the larger of two different labels becomes the smaller; the columns are
    those from before any change."""
    now: dict[int, int] = {}
    for _, a, b in sorted(rows):
        if a != b:
            old, new = max(a, b), min(a, b)
            for label in {x for r in rows for x in r[1:]}:
                if now.get(label, label) == old:
                    now[label] = new
    return now


def _renamed(labels: DataFrame, names: DataFrame, keys: list[str], label: str) -> DataFrame:
    return (
        labels.join(names.withColumnRenamed("old", label), [*keys, label], "left")
        .withColumn(label, F.coalesce("new", label))
        .drop("new")
        .select(*labels.columns)
    )


def merged_edges(labels: DataFrame, grid: Grid, policy: str = "compat", label: str = "label", together: int = TOGETHER) -> DataFrame:
    """Labels merged over the whole field, then numbered anew from 1. labels is read several times."""
    pairs = edge_pairs(labels, grid, ["t"], label)
    pairs = cut(pairs.select("first", "last").distinct())
    ends = pairs.select(F.col("first").alias("a"), F.col("last").alias("b"))
    if policy == "closure":
        nodes = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
        names = connected(nodes, ends).filter("id <> root").select(F.col("id").alias("old"), F.col("root").alias("new"))
    else:  # labels that no chain of pairs connects don't influence each other

        def run(table: pa.Table) -> pa.Table:
            now = ordered_merge(list(zip(table.column("first").to_pylist(), table.column("last").to_pylist(), strict=True)))
            return pa.table([pa.array(list(now), pa.int64()), pa.array(list(now.values()), pa.int64())], ["old", "new"])

        nodes = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
        rows = pairs.join(dealt(nodes, ends, together).withColumnRenamed("id", "first"), "first")
        rows = rows.select("bucket", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))
        names = rows.groupBy("bucket").applyInArrow(run, "old bigint, new bigint")
    # labels are in the order of their first times
    first = labels.groupBy(F.col(label).alias("old")).agg(F.min("t").alias("t0"))
    names = cut(first.join(names, "old", "left").select("old", "t0", F.coalesce("new", "old").alias("new")))
    left = names.select("new").distinct().join(names.select(F.col("old").alias("new"), "t0"), "new")
    final = names.drop("t0").join(numbered(left, ["t0", "new"], "again").drop("t0"), "new")
    return labels.join(final.select(F.col("old").alias(label), "again"), label).withColumn(label, F.col("again")).select(*labels.columns)


def merged_slices(labels: DataFrame, grid: Grid, label: str = "label") -> DataFrame:
    """Labels merged within each (t, z) slice only."""
    pairs = edge_pairs(labels, grid, ["t", "z"], label).select(
        F.col("t").cast("int").alias("t"), F.col("z").cast("int").alias("z"), F.col("y").cast("int").alias("y"),
        F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"),
    )

    def run(table: pa.Table) -> pa.Table:
        now = slice_merge(list(zip(*[table.column(c).to_pylist() for c in ("y", "first", "last")], strict=True)))
        t, z = table.column("t")[0].as_py(), table.column("z")[0].as_py()
        return pa.table({
            "t": pa.array([t] * len(now), pa.int32()), "z": pa.array([z] * len(now), pa.int32()),
            "old": pa.array(list(now), pa.int64()), "new": pa.array(list(now.values()), pa.int64()),
        })

    names = pairs.groupBy("t", "z").applyInArrow(run, "t int, z int, old bigint, new bigint")
    return _renamed(labels, names, ["t", "z"], label)
