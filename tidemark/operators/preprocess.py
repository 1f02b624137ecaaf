"""Anomalies, thresholds, layer thickness and volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cell_keys(df: DataFrame) -> list[str]:
    return [c for c in ("z", "y", "x") if c in df.columns]


def harmonic_basis(years: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The design matrix (time, 6) of mean, trend and two harmonics of the year, and its pseudo-inverse (6, time)."""
    t = np.asarray(years, dtype=float)
    w = 2 * np.pi * t
    m = np.stack([np.ones_like(t), t - t.mean(), np.sin(w), np.cos(w), np.sin(2 * w), np.cos(2 * w)], axis=1)
    return m, np.linalg.pinv(m)


def _basis(spark: SparkSession, years: list[float]) -> DataFrame:
    m, p = harmonic_basis(years)
    rows = [(t, m[t].tolist(), p[:, t].tolist()) for t in range(len(years))]
    return spark.createDataFrame(rows, "t int, m array<double>, p array<double>")


def decomposed(df: DataFrame, years: list[float]) -> DataFrame:
    """Each cell's series split by least squares: mean, trend, seas and anom. Cells without a value at every time are
    left out. The basis has a row for each time step; it is broadcast."""
    keys = cell_keys(df)
    basis = F.broadcast(_basis(df.sparkSession, years))
    joined = df.join(basis, "t")
    fit = joined.groupBy(*keys).agg(*[F.sum(F.col("p")[k] * F.col("v")).alias(f"b{k}") for k in range(6)], F.count("v").alias("n"))
    fit = fit.filter(F.col("n") == len(years)).drop("n")
    out = joined.join(fit, keys)
    seas = sum((F.col("m")[k] * F.col(f"b{k}") for k in range(3, 6)), F.col("m")[2] * F.col("b2"))
    out = out.withColumns({"mean": F.col("m")[0] * F.col("b0"), "trend": F.col("m")[1] * F.col("b1"), "seas": seas})
    out = out.withColumn("anom", F.col("v") - F.col("mean") - F.col("trend") - F.col("seas"))
    return out.select("t", *keys, "v", "mean", "trend", "seas", "anom")


def anomalies(df: DataFrame, years: list[float]) -> DataFrame:
    return decomposed(df, years).select("t", *cell_keys(df), F.col("anom").alias("v"))


def quantile_map(df: DataFrame, q: float = 0.9, value: str = "v") -> DataFrame:
    """Each cell's exact quantile over time."""
    return df.groupBy(*cell_keys(df)).agg(F.percentile(value, F.lit(q)).alias("thr"))


def threshold_features(df: DataFrame, q: float = 0.9, value: str = "v") -> tuple[DataFrame, DataFrame]:
    """(cells at or over their quantile, the quantiles). A cell's series meets once, in one shuffle; the field isn't
    computed twice."""
    own = F.percentile(value, F.lit(q)).over(Window.partitionBy(*cell_keys(df)))
    return df.withColumn("thr", own).filter(F.col(value) >= F.col("thr")).drop("thr"), quantile_map(df, q, value)


def anomalies_and_features(df: DataFrame, years: list[float], q: float = 0.9) -> DataFrame:
    """decomposed() with features: the anomaly where it reaches the cell's quantile, else NULL."""
    own = F.percentile("anom", F.lit(q)).over(Window.partitionBy(*cell_keys(df)))
    parts = decomposed(df, years).withColumn("thr", own)
    return parts.withColumn("features", F.when(F.col("anom") >= F.col("thr"), F.col("anom"))).drop("thr")


def layer_thickness(dim_z: DataFrame) -> DataFrame:
    """dim_z (z, depth) with dz: central differences, one-sided at the ends, 0 for a single level. A dimension table is
    as long as a column of the grid."""
    w = Window.orderBy("z")
    before, after, at = F.lag("depth").over(w), F.lead("depth").over(w), F.col("depth")
    return dim_z.withColumn("dz", F.coalesce((after - before) / 2, after - at, at - before, F.lit(0.0)))


def cell_volume(area: DataFrame, dim_z: DataFrame, n_z: int = 20) -> DataFrame:
    """area (y, x, area in cm2) times thickness of the top n_z levels (depth in cm): z, y, x, vol in m3. The levels,
    n_z rows at most, are broadcast."""
    levels = layer_thickness(dim_z.filter(F.col("z") < n_z)).select("z", "dz")
    joined = area.crossJoin(F.broadcast(levels))
    return joined.select("z", "y", "x", (F.col("area") * 1e-4 * (F.col("dz") / 100)).alias("vol"))


def anisotropic_offsets(connect_xy: bool = True, connect_z: bool = True) -> list[tuple[int, int, int]]:
    """(dz, dy, dx): the centre, its 8 neighbours in the level, and those above and below."""
    plane = [(0, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return (plane if connect_xy else [(0, 0, 0)]) + ([(-1, 0, 0), (1, 0, 0)] if connect_z else [])


def background_to_null(labels: DataFrame, grid, label: str = "label") -> DataFrame:
    """Every cell (t, y, x) of the grid with its label, NULL where there is none: the dense form of a label table."""
    n = grid.y * grid.x
    every = labels.sparkSession.range(grid.t * n)
    every = every.select(F.expr(f"int(id div {n})").alias("t"), F.expr(f"int(id % {n} div {grid.x})").alias("y"), F.expr(f"int(id % {grid.x})").alias("x"))
    return every.join(labels.select("t", "y", "x", label), ["t", "y", "x"], "left")


def binarised(df: DataFrame, positive: bool = True) -> DataFrame:
    """The cells over (or, for cold events, under) zero, without their values."""
    at = ["t", *cell_keys(df)]
    return df.filter((F.col("v") > 0) if positive else (F.col("v") < 0)).select(*at)


def land_to_null(field: DataFrame) -> DataFrame:
    """The field without its cells of value 0, which stand for land."""
    return field.filter("v <> 0")


def build_mask(field: DataFrame, grid, t: int = 0) -> DataFrame:
    """y, x and valid: 0 where the field is 0 at time t, else 1; a missing cell is valid."""
    land = field.filter((F.col("t") == t) & (F.col("v") == 0)).select("y", "x", F.lit(0).alias("valid"))
    cells = field.sparkSession.range(grid.y * grid.x).select(F.expr(f"int(id div {grid.x})").alias("y"), F.expr(f"int(id % {grid.x})").alias("x"))
    return cells.join(land, ["y", "x"], "left").select("y", "x", F.coalesce("valid", F.lit(1)).alias("valid"))


def masked(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """The cells where mask (y, x[, t], valid) is 1. A mask in which nothing is valid is an error."""
    valid = mask.filter("valid = 1")
    if valid.isEmpty():
        raise ValueError("the mask has no valid cell")
    return cells.join(valid.select(*[c for c in ("t", "y", "x") if c in mask.columns]), [c for c in ("t", "y", "x") if c in mask.columns], "left_semi")
