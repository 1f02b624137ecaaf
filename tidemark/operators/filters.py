"""Filters by the size of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Grid
from .boundary import merged_edges
from .components import label_2d
from .graph import cut, numbered, ranked


def object_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("area"))


def area_threshold(objects: DataFrame, q: float, floor: float) -> tuple[float, int]:
    """The larger of the floor and the exact quantile of areas, and how many objects there are."""
    got, n = objects.agg(F.percentile("area", F.lit(q)), F.count("*")).first()
    if not n:
        raise ValueError("no objects were found")
    return max(float(floor), float(got)), n


def surface_objects(cells: DataFrame, grid: Grid, wrap: bool = True) -> DataFrame:
    """Cells with consecutive labels of 8-connected objects of each t; objects across the edge columns are merged."""
    blobs = cut(label_2d(cells, grid))
    names = numbered(blobs.select("t", "blob"), ["t", "blob"])
    out = cut(blobs.join(names, ["t", "blob"]).drop("blob"))
    return merged_edges(out, grid) if wrap else out


def filter_area(cells: DataFrame, grid: Grid, q: float = 0.25, min_area_cells: float = 100):
    """(objects with areas, threshold, cells of objects that reach it, number of objects before)."""
    labels = cut(surface_objects(cells, grid))
    objects = cut(object_sizes(labels))
    least, n = area_threshold(objects, q, min_area_cells)
    kept = labels.join(objects.filter(F.col("area") >= least), "label", "left_semi").drop("label")
    return objects, least, kept, n


#: The same under its other name.
label_filter_area = filter_area


def filter_area_by_depth(labels: DataFrame, grid: Grid, q: float = 0.25, min_area_cells: float = 100) -> DataFrame:
    """Cells (t, z, y, x and more) of 4-connected slice objects that reach their level's threshold: the larger of the
    floor and the quantile over all times. Labels of the input stay."""
    blobs = cut(label_2d(labels.select("t", "z", "y", "x"), grid, 4))
    sizes = blobs.groupBy("t", "z", "blob").agg(F.count("*").alias("area"))
    least = sizes.groupBy("z").agg(F.greatest(F.percentile("area", F.lit(q)), F.lit(float(min_area_cells))).alias("least"))
    kept = sizes.join(least, "z").filter(F.col("area") >= F.col("least"))
    cells = blobs.join(kept, ["t", "z", "blob"], "left_semi")
    return labels.join(cells.select("t", "z", "y", "x"), ["t", "z", "y", "x"], "left_semi")


def volume_ranks(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, vol, rank (from 1; by volume, then label). Volumes are pooled over all times that use a number. Ranks are
    taken in ranges of (volume, label), so objects of one size don't meet in one task."""
    vol = labels.groupBy(label).agg(F.count("*").alias("vol"))
    return ranked(vol, ["vol", label]).select(label, "vol", "rank")


def filter_smallest(labels: DataFrame, frac: float, label: str = "label") -> DataFrame:
    """Without the int(n * frac) smallest labels; the others keep their numbers."""
    ranks = cut(volume_ranks(labels, label))
    drop = int(ranks.count() * frac)
    return labels.join(ranks.filter(F.col("rank") > drop), label, "left_semi").select(*labels.columns)
