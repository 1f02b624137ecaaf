"""Closing and opening of binary fields, slice by slice, with a wrapped margin of finite width.

A small disk is exploded into offsets: dilation is a distinct, erosion a grouped count, and both pre-aggregate before
the shuffle. A large disk would multiply the rows, so then each slice goes to a NumPy kernel; a slice is one row of the
grid's size. Both give the same cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Grid

#: Offsets from which on the kernel is used.
LARGE = 45


def disk(radius: int, strict: bool) -> list[tuple[int, int]]:
    """Offsets (dy, dx) within the radius; strict leaves out the rim."""
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if (dy * dy + dx * dx < radius * radius if strict else dy * dy + dx * dx <= radius * radius)]


def _spread(cells: DataFrame, se: list[tuple[int, int]], keys: list[str], grid: Grid, pad: int) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in se])
    moved = cells.select(*keys, "y", "x", F.explode(offsets).alias("o"))
    moved = moved.select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.filter(F.col("y").between(-pad, grid.y + pad - 1) & F.col("x").between(-pad, grid.x + pad - 1))


def dilated(cells: DataFrame, se: list[tuple[int, int]], keys: list[str], grid: Grid, pad: int = 0) -> DataFrame:
    return _spread(cells, se, keys, grid, pad).distinct()


def eroded(cells: DataFrame, se: list[tuple[int, int]], keys: list[str], grid: Grid, pad: int = 0) -> DataFrame:
    counts = _spread(cells, se, keys, grid, pad).groupBy(*keys, "y", "x").count()
    return counts.filter(F.col("count") == len(se)).drop("count")


def wrapped(cells: DataFrame, keys: list[str], grid: Grid, pad: int) -> DataFrame:
    """The cells and their cyclic copies within a margin of `pad` on all sides."""

    def copies(c: str, n: int):
        k = -(-pad // n)
        every = F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda i: F.col(c) + i * n)
        return F.explode(F.filter(every, lambda v: v.between(-pad, n + pad - 1))).alias(c)

    rows = cells.select(*keys, "x", copies("y", grid.y))
    return rows.select(*keys, "y", copies("x", grid.x))


def dense_close_open(a: np.ndarray, se: list[tuple[int, int]], pad: int) -> np.ndarray:
    """The same on one dense slice."""
    p = np.pad(a, pad, mode="wrap") if pad else a
    r = max(max(abs(dy), abs(dx)) for dy, dx in se)

    def around(x, how, outside):
        e = np.pad(x, r, constant_values=False)
        h, w = x.shape
        out = np.full(x.shape, outside)
        for dy, dx in se:
            how(out, e[r + dy : r + dy + h, r + dx : r + dx + w], out=out)
        return out

    dilate = lambda x: around(x, np.logical_or, False)
    erode = lambda x: around(x, np.logical_and, True)
    out = dilate(erode(erode(dilate(p))))
    return out[pad : pad + a.shape[0], pad : pad + a.shape[1]]


def close_open(cells: DataFrame, grid: Grid, se: list[tuple[int, int]], pad: int, method: str = "auto") -> DataFrame:
    keys = [c for c in ("t", "z") if c in cells.columns]
    if method == "kernel" or (method == "auto" and len(se) >= LARGE):

        def run(table: pa.Table) -> pa.Table:
            a = np.zeros((grid.y, grid.x), bool)
            a[table.column("y").to_numpy(), table.column("x").to_numpy()] = True
            y, x = np.nonzero(dense_close_open(a, se, pad))
            first = {k: pa.array(np.full(len(y), table.column(k)[0].as_py()), pa.int32()) for k in keys}
            return pa.table(first | {"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32())})

        schema = ", ".join(f"{c} int" for c in [*keys, "y", "x"])
        ints = cells.select(*[F.col(c).cast("int").alias(c) for c in [*keys, "y", "x"]])
        return ints.groupBy(*keys).applyInArrow(run, schema)
    c = wrapped(cells, keys, grid, pad) if pad else cells
    for step in (dilated, eroded, eroded, dilated):
        c = step(c, se, keys, grid, pad)
    return select_inside(c, grid)


def select_inside(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.filter(F.col("y").between(0, grid.y - 1) & F.col("x").between(0, grid.x - 1))


def clean_surface(cells: DataFrame, grid: Grid, radius: int = 2, method: str = "auto") -> DataFrame:
    """A margin of twice the radius and a disk without its rim; radius 1 changes nothing."""
    if radius < 1:
        raise ValueError("the radius must be at least 1")
    return cells if radius == 1 else close_open(cells, grid, disk(radius, strict=True), 2 * radius, method)


def clean_volume(cells: DataFrame, grid: Grid, radius: int = 3, method: str = "auto") -> DataFrame:
    """A margin of the radius and a disk with its rim."""
    if radius < 1:
        raise ValueError("the radius must be at least 1")
    return close_open(cells, grid, disk(radius, strict=False), radius, method)
