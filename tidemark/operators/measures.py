"""Measures of events: shape, motion, time and intensity, for all events in one plan each.

Events are rows (label, t, y, x) with coordinate tables dim_y (y, lat) and dim_x (x, lon) and, for intensities, a field
(t, y, x, v). Coordinate tables are as long as a side of the grid and are broadcast.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EARTH_KM, LAT_KM, LON_KM, circularity, haversine_km, percentile_key
from ..sources import Grid
from .components import EIGHT, labelled
from .graph import cut


def by_time():
    return Window.partitionBy("label").orderBy("t")


def located(cells: DataFrame, dim_y: DataFrame, dim_x: DataFrame) -> DataFrame:
    return cells.join(F.broadcast(dim_y), "y").join(F.broadcast(dim_x), "x")


# time


def n_events(labels: DataFrame) -> int:
    return labels.select("label").distinct().count()


def durations(labels: DataFrame) -> DataFrame:
    """label, duration: at how many times an event is present; gaps don't count."""
    return labels.select("label", "t").distinct().groupBy("label").agg(F.count("*").alias("duration"))


def summary(labels: DataFrame) -> DataFrame:
    d = F.col("duration")
    atleast = [F.count_if(d >= k).alias(f"n_at_least_{k}") for k in (1, 3, 6, 12)]
    return durations(labels).agg(
        F.count("*").alias("n_events"), F.min(d).alias("min_duration"), F.percentile(d, F.lit(0.5)).cast("int").alias("median_duration"),
        F.max(d).alias("max_duration"), *atleast,
    )


def temporal(labels: DataFrame, dim_t: DataFrame) -> DataFrame:
    """label, initial_detection_date, duration."""
    joined = labels.select("label", "t").distinct().join(F.broadcast(dim_t), "t")
    return joined.groupBy("label").agg(F.min_by("time", "t").alias("initial_detection_date"), F.count("*").alias("duration"))


def counts_by_time(labels: DataFrame) -> DataFrame:
    return labels.select("label", "t").distinct().groupBy("t").agg(F.count("*").alias("n_objects"))


# intensity


def object_cells(labels: DataFrame, field: DataFrame) -> DataFrame:
    """Cells of events with their value; only positive values are intensities."""
    return labels.join(field.filter("v > 0"), ["t", "y", "x"])


def object_masks(labels: DataFrame, field: DataFrame, object_id: int) -> tuple[DataFrame, DataFrame]:
    """Of one event: its cells (t, y, x), and those of them with a positive value (t, y, x, v); both at the times of the
    event only. An unknown id gives empty tables and a warning."""
    own = labels.filter(F.col("label") == object_id).select("t", "y", "x")
    if own.isEmpty():
        warnings.warn(f"no object {object_id}", stacklevel=2)
    return own, own.join(field.filter("v > 0").select("t", "y", "x", "v"), ["t", "y", "x"])


def intensities(labels: DataFrame, field: DataFrame, q: float = 0.9) -> DataFrame:
    """label, t (NULL: the whole event), cumulative, mean, max, std (of the population), quantile. A time's cells are at
    most a slice of the grid; an event's cells may be many, so of these only the values near the quantile are gathered."""
    v = F.col("v")
    name = f"{percentile_key(q)}_intensity"
    rows = object_cells(labels, field).select("label", "t", "v")
    parts = [
        F.sum(v).alias("cumulative_intensity"), F.avg(v).alias("mean_intensity"), F.max(v).alias("max_intensity"), F.stddev_pop(v).alias("std_intensity"),
    ]
    each = rows.groupBy("label", "t").agg(*parts, F.percentile(v, F.lit(q)).alias(name))
    near = [F.lit(max(q - 0.002, 0.0)), F.lit(min(q + 0.002, 1.0))]
    whole = rows.groupBy("label").agg(
        *parts, F.count("*").alias("n"), F.percentile_approx(v, F.array(*near), F.lit(10_000)).alias("near"), F.array(F.min(v), F.max(v)).alias("all")
    ).withColumn("near", F.when(F.col("n") < 2000, F.col("all")).otherwise(F.col("near")))
    # the ranks of the two values that the quantile lies between, from 0
    rank = (F.col("n") - 1) * F.lit(q)
    bounds = whole.select("label", F.col("near")[0].alias("low"), F.col("near")[1].alias("high"), F.floor(rank).alias("k"), (rank - F.floor(rank)).alias("part"))
    inside = rows.join(bounds, "label").groupBy("label", "k", "part").agg(
        F.count_if(v < F.col("low")).alias("below"), F.sort_array(F.collect_list(F.when(v.between(F.col("low"), F.col("high")), v))).alias("vs"))
    at = (F.col("k") - F.col("below")).cast("int")
    first = F.get("vs", at)
    exact = first + (F.coalesce(F.get("vs", at + 1), first) - first) * F.col("part")
    whole = whole.join(inside.select("label", exact.alias(name)), "label")
    columns = ["label", "t", "cumulative_intensity", "mean_intensity", "max_intensity", "std_intensity", name]
    return each.select(*columns).unionByName(whole.withColumn("t", F.lit(None).cast("int")).select(*columns))


# shape


def _area(lat: Column, lat_km: float = LAT_KM, lon_km: float = LON_KM) -> Column:
    """km2 of a cell of one degree."""
    return F.cos(F.radians(lat)) * (lat_km * lon_km)


def extents(labels: DataFrame, dim_y: DataFrame, lat_km: float = LAT_KM, lon_km: float = LON_KM) -> DataFrame:
    """label, t, spatial_extent; lat_km and lon_km: the lengths of a degree."""
    return labels.join(F.broadcast(dim_y), "y").groupBy("label", "t").agg(F.sum(_area(F.col("lat"), lat_km, lon_km)).alias("spatial_extent"))


def whole_extents(labels: DataFrame, dim_y: DataFrame, lat_km: float = LAT_KM, lon_km: float = LON_KM) -> DataFrame:
    """label, max_spatial_extent, mean_spatial_extent and cumulative_spatial_extent, over an event's times."""
    e = F.col("spatial_extent")
    return extents(labels, dim_y, lat_km, lon_km).groupBy("label").agg(
        F.max(e).alias("max_spatial_extent"), F.avg(e).alias("mean_spatial_extent"), F.sum(e).alias("cumulative_spatial_extent")
    )


def deformation(labels: DataFrame, dim_y: DataFrame) -> DataFrame:
    """label, t, complement_to_deformation (the shared part of this time's and the next present time's area, over their
    sum: at most 0.5) and deformation (1 less that)."""
    e = extents(labels, dim_y).withColumns({"t_next": F.lead("t").over(by_time()), "next": F.lead("spatial_extent").over(by_time())})
    e = e.filter("t_next IS NOT NULL")
    here = labels.join(e.select("label", "t", "t_next"), ["label", "t"])
    there = labels.select("label", F.col("t").alias("t_next"), "y", "x")
    shared = here.join(there, ["label", "t_next", "y", "x"]).join(F.broadcast(dim_y), "y")
    shared = shared.groupBy("label", "t").agg(F.sum(_area(F.col("lat"))).alias("shared"))
    part = F.coalesce(F.col("shared"), F.lit(0.0)) / (F.col("spatial_extent") + F.col("next"))
    out = e.join(shared, ["label", "t"], "left").select("label", "t", part.alias("complement_to_deformation"))
    return out.withColumn("deformation", 1 - F.col("complement_to_deformation"))


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    (lat1, lon1), (lat2, lon2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def contours(mask: np.ndarray) -> list[list[tuple[float, float]]]:
    """Level lines of a binary picture at one half. Highs that touch by a corner are apart; lines that the picture's
    border cuts are open, the others end where they began. Only squares with both kinds of corners are visited."""
    m = mask.astype(np.int8)
    code = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, :-1] + 8 * m[1:, 1:]
    nexts: dict = {}
    for r, c in zip(*(x.tolist() for x in np.nonzero((code > 0) & (code < 15))), strict=True):
        top, left, right, bottom = (r, c + 0.5), (r + 0.5, c), (r + 0.5, c + 1), (r + 1, c + 0.5)
        nexts.update(_SEGMENTS[int(code[r, c])](top, left, right, bottom))
    ends = set(nexts.values())
    starts = set(nexts)
    lines = []
    for first in [*sorted(starts - ends), *sorted(starts)]:
        if first not in nexts:
            continue
        line = [first]
        while line[-1] in nexts:
            line.append(nexts.pop(line[-1]))
        lines.append(line)
    return lines


def _segments() -> dict:
    """For the four corners of a square (as bits: upper left, upper right, lower left, lower right), its directed pieces
    of lines, highs on the left."""
    out = {}
    for k in range(16):
        ul, ur, ll, lr = (bool(k & b) for b in (1, 2, 4, 8))

        def pieces(t, l, r, b, ul=ul, ur=ur, ll=ll, lr=lr):
            if ul and lr and not ur and not ll:
                return [(t, l), (b, r)]
            if ur and ll and not ul and not lr:
                return [(r, t), (l, b)]
            # walk round the square: where the corner turns high, a line leaves; where it turns low, one comes in
            ring = [(ul, ur, t), (ur, lr, r), (lr, ll, b), (ll, ul, l)]
            rise = [e for a, z, e in ring if z and not a]
            fall = [e for a, z, e in ring if a and not z]
            return list(zip(fall, rise, strict=True))

        out[k] = pieces
    return out


_SEGMENTS = _segments()


def perimeter_km(y: np.ndarray, x: np.ndarray, lats: np.ndarray, lons: np.ndarray) -> float:
    """All level lines of the cells, their ends joined; points are cut to whole cells, longitudes less 180. Only the
    cells' box and what borders on it are looked at."""
    y0, x0 = max(int(y.min()) - 1, 0), max(int(x.min()) - 1, 0)
    box = np.zeros((min(int(y.max()) + 2, len(lats)) - y0, min(int(x.max()) + 2, len(lons)) - x0), bool)
    box[y - y0, x - x0] = True
    total = 0.0
    for line in contours(box):
        p = [(float(lats[int(r) + y0]), float(lons[int(c) + x0]) - 180.0) for r, c in line]
        total += sum(_km(a, b) for a, b in zip(p, [*p[1:], p[0]], strict=True))
    return total


def hull_cells(y: np.ndarray, x: np.ndarray) -> int:
    """Cells whose centre lies in the convex hull of the middles of the cells' sides."""
    order = np.lexsort((x, y))
    change = np.flatnonzero(np.diff(y[order])) + 1
    ends = order[np.unique(np.concatenate([[0], change, change - 1, [len(order) - 1]]))]  # the outer cells of each row
    points = sorted({(a + da, b + db) for a, b in zip(y[ends].tolist(), x[ends].tolist(), strict=True) for da, db in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))})
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(points) + half(points[::-1])
    gy, gx = np.mgrid[y.min() : y.max() + 1, x.min() : x.max() + 1]
    inside = np.ones(gy.shape, bool)
    for a, b in zip(hull, [*hull[1:], hull[0]], strict=True):
        inside &= (b[0] - a[0]) * (gx - a[1]) - (b[1] - a[1]) * (gy - a[0]) >= -1e-9
    return int(inside.sum())


def outlines(labels: DataFrame, dim_y: DataFrame, dim_x: DataFrame, grid: Grid) -> DataFrame:
    """label, t, perimeter, convex_hull_area (cells) and ratio_convexhullarea_vs_area (the object's part of its hull)."""
    lats = np.array([r[0] for r in dim_y.orderBy("y").select("lat").collect()])
    lons = np.array([r[0] for r in dim_x.orderBy("x").select("lon").collect()])

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        hull = hull_cells(y, x)
        return pa.table({
            "label": pa.array([table.column("label")[0].as_py()], pa.int64()), "t": pa.array([table.column("t")[0].as_py()], pa.int32()),
            "perimeter": pa.array([perimeter_km(y, x, lats, lons)]), "convex_hull_area": pa.array([hull], pa.int64()),
            "ratio_convexhullarea_vs_area": pa.array([len(y) / hull]),
        })

    ints = labels.select(F.col("label").cast("bigint").alias("label"), *[F.col(c).cast("int").alias(c) for c in ("t", "y", "x")])
    return ints.groupBy("label", "t").applyInArrow(
        run, "label bigint, t int, perimeter double, convex_hull_area bigint, ratio_convexhullarea_vs_area double"
    )


def shape(labels: DataFrame, dim_y: DataFrame, dim_x: DataFrame, grid: Grid) -> DataFrame:
    """label, t and all shape measures; an event's largest, mean and summed extent stand at each of its times."""
    labels = cut(labels)
    d = extents(labels, dim_y).join(whole_extents(labels, dim_y), "label")
    d = d.join(outlines(labels, dim_y, dim_x, grid), ["label", "t"]).join(deformation(labels, dim_y), ["label", "t"], "left")
    return d.withColumn("circularity", circularity(F.col("spatial_extent"), F.col("perimeter")))


# motion


def centres(cells: DataFrame, keys: list[str], dim_y: DataFrame, dim_x: DataFrame, grid: Grid, weight: str | None = None) -> DataFrame:
    """keys, lat, lon: the centre of mass of each group. The columns are rolled first, so that the emptiest (of several,
    the last) comes last; places are rounded half to even."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = cells.groupBy(*keys, "x").agg(F.sum(w).alias("s"), F.sum(w * F.col("y")).alias("sy"))
    a = sums.groupBy(*keys).agg(F.sum("s").alias("n"), F.sum("sy").alias("sy"), F.sort_array(F.collect_list(F.struct("x", "s")), asc=False).alias("cols"))
    # a column without cells is the emptiest: the last such one comes before the run of columns that ends the row
    run = F.size(F.filter("cols", lambda c, i: c["x"] == F.lit(grid.x - 1) - i))
    least = F.array_min(F.transform("cols", lambda c: F.struct(c["s"].alias("s"), (-c["x"]).alias("x"))))["x"]
    a = a.withColumn("shift", F.when(F.size("cols") < grid.x, run).otherwise(F.lit(grid.x - 1) + least))
    sx = F.aggregate("cols", F.lit(0.0), lambda t, c: t + c["s"] * F.pmod(c["x"] + F.col("shift"), F.lit(grid.x)))
    a = a.withColumns({"cy": F.bround(F.try_divide(F.col("sy"), F.col("n"))).cast("int"), "cx": F.bround(F.try_divide(sx, F.col("n"))).cast("int")})
    a = a.withColumn("x", F.pmod(F.col("cx") - F.col("shift"), F.lit(grid.x)).cast("int")).withColumn("y", F.col("cy"))
    return a.select(*keys, "y", "x").join(F.broadcast(dim_y), "y").join(F.broadcast(dim_x), "x").select(*keys, "lat", "lon")


def regions(labels: DataFrame, grid: Grid) -> DataFrame:
    """Cells with region: the 8-connected part, around the edge columns, of an event at a time."""
    found = labelled(labels.select("label", "t", "y", "x"), grid, ["label", "t"], EIGHT, wrap=True)
    return found.withColumnRenamed("blob", "region")


def displacements(path: DataFrame) -> DataFrame:
    """path (label, t, lat, lon) with km: how far it is to the next present time; NULL at the last."""
    to = [F.lead(c).over(by_time()) for c in ("lat", "lon")]
    return path.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), *to))


def directionality(path: DataFrame, swapped: bool = True) -> DataFrame:
    """label, mean_delta_lon, mean_delta_lat, mean_angle, direction, movement_count. swapped: the first of a point's (lat,
    lon) is taken for the longitude, as callers always did; events with one point have no direction."""
    a, b = ("lat", "lon") if swapped else ("lon", "lat")
    steps = path.select("label", *[(F.lead(c).over(by_time()) - F.col(c)).alias(n) for c, n in ((a, "dx"), (b, "dy"))]).filter("dx IS NOT NULL")
    m = steps.groupBy("label").agg(F.avg("dx").alias("mean_delta_lon"), F.avg("dy").alias("mean_delta_lat"), F.count("*").alias("movement_count"))
    angle = F.pmod(F.degrees(F.atan2("mean_delta_lat", "mean_delta_lon")), F.lit(360.0))
    m = m.withColumn("mean_angle", angle)
    g = F.col("mean_angle")
    # fixed values: the four names
    name = (
        F.when((g < 45) | (g >= 315), "eastward (zonal-dominated)").when(g < 135, "northward (meridional-dominated)")
        .when(g < 225, "westward (zonal-dominated)").otherwise("southward (meridional-dominated)")
    )
    return m.withColumn("direction", name)


def motion(labels: DataFrame, field: DataFrame, dim_y: DataFrame, dim_x: DataFrame, grid: Grid) -> DataFrame:
    """label, t, of centroids and of centres of mass: how many regions, their places, the path and its displacements."""
    out = None
    labels, field = cut(labels), cut(field.filter("v > 0").join(labels.select("t", "y", "x").distinct(), ["t", "y", "x"], "left_semi"))
    r = cut(regions(labels, grid))
    for name, cells, weight in (("centroid", labels, None), ("com", object_cells(labels, field), "v")):
        parts = r if weight is None else r.join(field.filter("v > 0"), ["t", "y", "x"])
        each = centres(parts, ["label", "t", "region"], dim_y, dim_x, grid, weight)
        each = each.groupBy("label", "t").agg(
            F.count("*").alias(f"num_{name}s_per_timestep"),
            F.sort_array(F.collect_list(F.struct("region", "lat", "lon"))).alias(f"{name}_coords"),
        )
        path = displacements(centres(cells, ["label", "t"], dim_y, dim_x, grid, weight))
        path = path.select("label", "t", F.struct("lat", "lon").alias(f"{name}_path"), F.col("km").alias(f"{name}_displacements_km"))
        both = each.join(path, ["label", "t"])
        out = both if out is None else out.join(both, ["label", "t"], "left")
    return out


def process_objects(ids: list[int], labels: DataFrame, field: DataFrame, dims: dict[str, DataFrame], grid: Grid, *,
                    shape_measures: bool = True, motion_measures: bool = True, temporal_measures: bool = True, intensity_measures: bool = True, q: float = 0.9) -> dict[str, DataFrame]:
    """The groups of measures asked for, for all ids at once; an unknown id is an error."""
    wanted = labels.sparkSession.createDataFrame([(i,) for i in ids], "label bigint")
    own = cut(labels.join(F.broadcast(wanted), "label", "left_semi"))  # as long as the caller's list
    missing = wanted.join(own.select("label").distinct(), "label", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"unknown ids: {[r[0] for r in missing.limit(20).collect()]}")
    out = {}
    if shape_measures:
        out["shape_measures"] = shape(own, dims["y"], dims["x"], grid)
    if motion_measures:
        out["motion_measures"] = motion(own, field, dims["y"], dims["x"], grid)
    if temporal_measures:
        out["temporal_measures"] = temporal(own, dims["t"])
    if intensity_measures:
        out["intensity_measures"] = intensities(own, field, q)
    return out
