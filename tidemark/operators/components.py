"""Connected components of cells: a kernel labels each slice, and objects of neighbouring slices are joined as a graph.

A label is the least linear index (z, y, x) of the object's cells, so labels don't depend on how the work is dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Grid
from .graph import connected, cut, numbered
from .preprocess import anisotropic_offsets

FOUR = [(0, 0, 1), (0, 1, 0)]
EIGHT = [(0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1)]


def label_cells(z: np.ndarray, y: np.ndarray, x: np.ndarray, grid: Grid, offsets, wrap: bool = False) -> np.ndarray:
    """The least linear index of each cell's component; offsets (dz, dy, dx), each once for both directions."""
    index = (z.astype(np.int64) * grid.y + y) * grid.x + x
    order = np.argsort(index)
    place = index[order]
    pairs = []
    for dz, dy, dx in offsets:
        nx = x + dx
        inside = (z + dz >= 0) & (z + dz < grid.z) & (y + dy >= 0) & (y + dy < grid.y)
        if wrap:
            nx = nx % grid.x
        else:
            inside &= (nx >= 0) & (nx < grid.x)
        to = ((z + dz).astype(np.int64) * grid.y + y + dy) * grid.x + nx
        at = np.minimum(np.searchsorted(place, to), len(place) - 1)
        hit = inside & (place[at] == to)
        pairs.append(np.stack([np.flatnonzero(hit), order[at[hit]]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    root = index.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        # the root of the root: rows are found by their index
        new = new[order[np.searchsorted(place, new)]] if len(new) else new
        if np.array_equal(new, root):
            return root
        root = new


def labelled(cells: DataFrame, grid: Grid, keys: list[str], offsets, wrap: bool = False) -> DataFrame:
    """cells with blob: the label within each group of keys."""
    names = [c for c in ("t", "z", "y", "x") if c in cells.columns]
    extra = [c for c in keys if c not in names]

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        z = table.column("z").to_numpy() if "z" in names and "z" not in keys else np.zeros(len(y), np.int64)
        return table.append_column("blob", pa.array(label_cells(z, y, x, grid, offsets, wrap), pa.int64()))

    ints = cells.select(*[F.col(c).cast("bigint").alias(c) for c in extra], *[F.col(c).cast("int").alias(c) for c in names])
    schema = ", ".join([*[f"{c} bigint" for c in extra], *[f"{c} int" for c in names], "blob bigint"])
    return ints.groupBy(*keys).applyInArrow(run, schema)


def label_2d(cells: DataFrame, grid: Grid, connectivity: int = 8) -> DataFrame:
    """Labels within each slice (t, or t and z)."""
    keys = [c for c in ("t", "z") if c in cells.columns]
    return labelled(cells, grid, keys, EIGHT if connectivity == 8 else FOUR)


#: Cells of a time's (z, y, x) block that one task labels as a whole.
BLOCK = 4_000_000


def label_depths(cells: DataFrame, grid: Grid, connect_xy: bool = True, connect_z: bool = True, block: int = BLOCK) -> DataFrame:
    """Objects in (z, y, x) of each t; labels start anew at every t. Times of larger grids are labelled by slices, whose
    objects are then joined as a graph."""
    offsets = [o for o in anisotropic_offsets(connect_xy, connect_z) if o > (0, 0, 0)]
    if grid.z * grid.y * grid.x <= block:
        return labelled(cells, grid, ["t"], offsets)
    at = ["t", "z", "y", "x"]
    if connect_xy:
        slices = label_2d(cells.select(*at), grid)
    else:
        slices = cells.select(*at).withColumn("blob", F.col("y").cast("bigint") * grid.x + F.col("x"))
    size = grid.y * grid.x
    blob = F.col("z").cast("bigint") * size + F.col("blob")
    slices = cut(_ids(slices.withColumn("blob", blob), grid))
    if not connect_z:
        return slices.drop("id")
    below = slices.select("t", (F.col("z") + 1).alias("z"), "y", "x", F.col("id").alias("b"))
    faces = slices.join(below, ["t", "z", "y", "x"]).select(F.col("id").alias("a"), "b").distinct()
    roots = connected(slices.select("id").distinct(), faces)
    return slices.join(roots, "id").select(*at, F.pmod(F.col("root"), F.lit(grid.z * size)).alias("blob"))


def _ids(blobs: DataFrame, grid: Grid) -> DataFrame:
    return blobs.withColumn("id", F.col("t").cast("bigint") * (grid.z * grid.y * grid.x) + F.col("blob"))


def touching(blobs: DataFrame, grid: Grid) -> DataFrame:
    """a, b: blobs of neighbouring times of which two cells are the same or neighbours."""
    ids = _ids(blobs, grid)
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    moved = ids.select(F.col("id").alias("a"), (F.col("t") + 1).alias("t"), "y", "x", F.explode(near).alias("o"))
    moved = moved.select("a", "t", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.join(ids.select("t", "y", "x", F.col("id").alias("b")), ["t", "y", "x"]).select("a", "b").distinct()


def overlapping(blobs: DataFrame, grid: Grid) -> DataFrame:
    """a, b, n: blobs of neighbouring times and how many cells they share."""
    at = [c for c in ("t", "z", "y", "x") if c in blobs.columns]
    ids = _ids(blobs, grid)
    moved = ids.select(F.col("id").alias("a"), (F.col("t") + 1).alias("t"), *at[1:])
    return moved.join(ids.select(*at, F.col("id").alias("b")), at).groupBy("a", "b").agg(F.count("*").alias("n"))


def events(blobs: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """Cells (t, y, x, label): components of the blob graph, numbered by their first cell."""
    ids = _ids(blobs, grid)
    roots = connected(ids, edges)
    names = numbered(roots.select(F.expr(f"root div {grid.z * grid.y * grid.x}").alias("t0"), "root").distinct(), ["t0", "root"])
    return ids.join(roots, "id").join(names.select("root", "label"), "root").select("t", *[c for c in ("z",) if c in blobs.columns], "y", "x", "label")


def label_3d(cells: DataFrame, grid: Grid) -> DataFrame:
    """26-connected events over (t, y, x)."""
    blobs = cut(label_2d(cells, grid))
    return events(blobs, touching(blobs, grid), grid)


def label_temporal_neighbor(cells: DataFrame, grid: Grid, contain_thresh: float = 0.0) -> DataFrame:
    """8-connected blobs, joined with those of the next time that they overlap: by any cell, or so that the shared part of
    one of them reaches the threshold."""
    if not 0 <= contain_thresh <= 1:
        raise ValueError("contain_thresh must be between 0 and 1")
    if "z" in cells.columns:
        raise ValueError("a surface field is needed")
    blobs = cut(label_2d(cells, grid))
    size = _ids(blobs, grid).groupBy("id").agg(F.count("*").alias("size"))
    e = overlapping(blobs, grid)
    if contain_thresh > 0:
        e = e.join(size.select(F.col("id").alias("a"), F.col("size").alias("size_a")), "a")
        e = e.join(size.select(F.col("id").alias("b"), F.col("size").alias("size_b")), "b")
        e = e.filter(F.greatest(F.col("n") / F.col("size_a"), F.col("n") / F.col("size_b")) >= contain_thresh)
    return events(blobs, e.select("a", "b"), grid)
