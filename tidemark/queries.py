"""The driver's queries over the reference's operators; their SQL is in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import oracles as o
from .operators import boundary, components, filters, link, measures, morphology, preprocess
from .operators.graph import cut
from .plans import SurfaceTracker, Tracker, VolumeTracker
from .sources import (
    Grid, convert_lons, find_members, is_periodic, member_files, member_pair, member_prefixes, monthly_grid, quarterly_grid, read_fields, select, write_fields,
)

SURFACE, VOLUME = Grid(84, 12, 24, periodic=True), Grid(28, 12, 24, z=4)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def surface(spark, d) -> DataFrame:
    return monthly_grid(_read(spark, d, "lineitem"))


def volume(spark, d) -> DataFrame:
    return quarterly_grid(_read(spark, d, "lineitem"))


def hot(spark, d, q=0.7) -> DataFrame:
    return preprocess.threshold_features(surface(spark, d), q)[0].select("t", "y", "x")


def hot_volume(spark, d, q=0.7) -> DataFrame:
    return preprocess.threshold_features(volume(spark, d), q)[0].select("t", "z", "y", "x")


def dims(spark) -> dict[str, DataFrame]:
    n = lambda k, c: spark.range(k).select(F.col("id").cast("int").alias(c))
    return {
        "t": n(84, "t").withColumn("time", F.expr("add_months(DATE'1995-01-01', t)")),
        "y": n(12, "y").withColumn("lat", F.col("y") * 15.0 - 82.5),
        "x": n(24, "x").withColumn("lon", F.col("x") * 15.0 + 7.5),
        "z": n(4, "z").withColumn("depth", F.col("z") * F.col("z") * 10.0 + F.col("z") * 5.0),
    }


def mask(spark) -> DataFrame:
    cells = spark.range(12 * 24).select((F.col("id") / 24).cast("int").alias("y"), (F.col("id") % 24).cast("int").alias("x"))
    return cells.withColumn("valid", F.when((F.col("y") * 7 + F.col("x")) % 11 == 0, 0).otherwise(1))


def tracked(spark, d) -> DataFrame:
    return components.label_temporal_neighbor(hot(spark, d, 0.9), SURFACE, 0.3)


def positive(spark, d) -> DataFrame:
    """A field with values on both sides of zero: cents less 3 million."""
    return surface(spark, d).withColumn("v", F.col("v") - 3e6)


def depth_labels(spark, d) -> DataFrame:
    return cut(components.label_depths(hot_volume(spark, d), VOLUME)).withColumnRenamed("blob", "label")


def edge_labels(spark, d) -> DataFrame:
    return filters.surface_objects(hot(spark, d), SURFACE, wrap=False)


def levels_volume(spark) -> DataFrame:
    return preprocess.cell_volume(mask(spark).select("y", "x", F.lit(1e8).alias("area")), dims(spark)["z"])


def _r(c, k=4):
    return F.round(c, k)


def _rounded(df: DataFrame, k: int, *but: str) -> DataFrame:
    return df.select(*[F.col(c) if c in but else _r(F.col(c), k).alias(c) for c in df.columns])


def _surface_tracker(spark, d, kind=SurfaceTracker) -> SurfaceTracker:
    return kind(positive(spark, d), mask(spark), SURFACE, radius=1, min_area_cells=3, method="temporal_neighbor", contain_thresh=0.5)


def _volume_tracker(spark, d, **more) -> VolumeTracker:
    return VolumeTracker(hot_volume(spark, d).withColumn("v", F.lit(1.0)), VOLUME, radius=1, min_area_cells=2, **more)


def _surface_events(spark, d, kind=SurfaceTracker):
    return _surface_tracker(spark, d, kind).run().result.select("t", "y", "x", F.col("labels").cast("bigint").alias("labels"))


def _attrs(spark, d):
    a = _surface_tracker(spark, d).run().attrs
    return a.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_").replace("(", "").replace(")", "")) for c in a.columns])


def _tracker_summary(spark, d):
    return _surface_tracker(spark, d).run().summary()


def _flagged(spark, d):
    s = _surface_tracker(spark, d).clean().fraction_flagged()
    v = _volume_tracker(spark, d).clean().fraction_flagged()
    return spark.createDataFrame([("surface", round(s, 9)), ("volume", round(v, 9))], "field string, flagged double")


def _filled(spark, d) -> tuple[DataFrame, list[float]]:
    years = [1995 + (t // 12) + (t % 12 + 1) / 12 for t in range(84)]
    full = spark.range(84).select(F.col("id").cast("int").alias("t")).crossJoin(mask(spark).select("y", "x"))
    return full.join(surface(spark, d), ["t", "y", "x"], "left").fillna(0.0, ["v"]), years


def _harmonic(spark, d):
    out = preprocess.decomposed(*_filled(spark, d))
    return out.select("t", "y", "x", *[(_r(F.col(c) / 1e6, 3) + 0.0).alias(c) for c in ("mean", "trend", "seas", "anom")])


def _features(spark, d):
    out = preprocess.anomalies_and_features(*_filled(spark, d)).filter("features IS NOT NULL")
    return out.select("t", "y", "x", (_r(F.col("features") / 1e6, 3) + 0.0).alias("features"))


def _anomalies(spark, d):
    return preprocess.anomalies(*_filled(spark, d)).select("t", "y", "x", (_r(F.col("v") / 1e6, 3) + 0.0).alias("v"))


def _places(spark, d, name: str, **kind):
    """A field written (by time, or in two parts) and read again."""
    from .sources import scratch

    field, path = surface(spark, d), scratch(spark, name)
    if kind.get("parts"):
        field.filter("t < 42").write.parquet(f"{path}/first")
        field.filter("t >= 42").write.parquet(f"{path}/second")
        return read_fields(spark, [f"{path}/first", f"{path}/second"])
    write_fields(field, path)
    return read_fields(spark, [path]).select("t", "y", "x", "v")


def _guard(spark, d):
    """Whether a mask without a valid cell, and one with some, are taken."""
    rows = []
    for name, m in (("some", mask(spark)), ("none", mask(spark).withColumn("valid", F.lit(0)))):
        try:
            preprocess.masked(preprocess.binarised(positive(spark, d)), m)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "mask string, taken boolean")


def _object_masks(spark, d):
    cells, values = measures.object_masks(cut(tracked(spark, d)), positive(spark, d), 7)
    return cells.join(values, ["t", "y", "x"], "left").select("t", "y", "x", "v")


def _orchestrated(spark, d):
    labels = cut(tracked(spark, d))
    ids = [r[0] for r in labels.select("label").distinct().orderBy("label").limit(12).collect()]
    got = measures.process_objects(ids, labels, surface(spark, d), dims(spark), SURFACE)
    by_event = got["temporal_measures"].join(got["intensity_measures"].filter("t IS NULL").select("label", "max_intensity"), "label")
    shape = got["shape_measures"].groupBy("label").agg(_r(F.max("max_spatial_extent"), 3).alias("max_spatial_extent"))
    moves = got["motion_measures"].groupBy("label").agg(F.sum("num_centroids_per_timestep").alias("centroids"))
    return by_event.join(shape, "label").join(moves, "label")


def _shape(spark, d):
    return _rounded(measures.shape(tracked(spark, d), dims(spark)["y"], dims(spark)["x"], SURFACE), 3, "label", "t", "convex_hull_area")


def _motion(spark, d):
    m = measures.motion(tracked(spark, d), surface(spark, d), dims(spark)["y"], dims(spark)["x"], SURFACE)
    said = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", (p["lat"] * 2).cast("int"), (p["lon"] * 2).cast("int"))), ",")
    return m.select("label", "t", *[x for k in ("centroid", "com") for x in (
        F.col(f"num_{k}s_per_timestep"), said(f"{k}_coords").alias(f"{k}_coords"), F.col(f"{k}_path.lat").alias(f"{k}_lat"),
        F.col(f"{k}_path.lon").alias(f"{k}_lon"), _r(F.col(f"{k}_displacements_km"), 3).alias(f"{k}_km"))])


def _path(spark, d):
    return measures.centres(tracked(spark, d), ["label", "t"], dims(spark)["y"], dims(spark)["x"], SURFACE)


def _streamed(spark, d):
    """The lineage of three batches of times, as a stream hands them over."""
    from .sources import scratch
    from .streaming import lineage_batches

    labels, out = depth_labels(spark, d), scratch(spark, "lineage-out")
    step = lineage_batches(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), scratch(spark, "lineage-state"), 0.1)
    for n, (low, high) in enumerate(((0, 9), (9, 10), (10, 28))):
        step(labels.filter((F.col("t") >= low) & (F.col("t") < high)), n)
    return spark.read.parquet(*[f"{out}/{n}" for n in range(3)]).select("t", "label", "event")


def _members(spark):
    return spark.createDataFrame([(f,) for p in ("b.e21.BHISTcmip6.f09.001", "b.e21.BSSP370smbb.f09.002") for v in ("historical", "future") for f in member_files(p + ".pop.h", "TEMP", v)], "name string")


def _pair(spark):
    names = [[f"{s}.f09.{k:03d}" for k in range(1, 6)] for s in ("b.e21.BHISTcmip6", "b.e21.BSSP370cmip6")]
    return spark.createDataFrame([(p, *member_pair(*names, p)) for p in ("f09.002", "004")], "part string, historical string, future string")


def _periodic(spark):
    rows = [(n, step, is_periodic([step * k for k in range(n)])) for n in (1, 2, 12, 23, 24, 25, 36) for step in (10.0, 15.0, 30.0)]
    return spark.createDataFrame(rows, "n int, step double, periodic boolean")


def _scalars(spark, d):
    e = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 180 - 90).cast("double").alias("a"), (F.col("l_suppkey") % 360).cast("double").alias("b"))
    far = fn.haversine_km(F.col("a"), F.col("b"), F.col("a") / 2, F.col("b") - 40.0)
    round_ = fn.circularity(F.col("a") + 91.0, F.col("b"))
    return e.select("l_orderkey", "l_linenumber", _r(far, 3).alias("km"), _r(round_, 6).alias("circularity"),
                    fn.lon_to_180(F.col("b")).alias("to_180"), fn.lon_to_360(F.col("b") - 400.0).alias("to_360"))


QUERIES = {
    "grid_build": surface,
    "read_fields": lambda s, d: _places(s, d, "parts", parts=True),
    "write_fields": lambda s, d: _places(s, d, "fields"),
    "select_slice": lambda s, d: select(surface(s, d), t=(12, 23), y=(2, 5)),
    "volume_grid": volume,
    "binarise_warm": lambda s, d: preprocess.binarised(positive(s, d)),
    "binarise_cold": lambda s, d: preprocess.binarised(positive(s, d), positive=False),
    "binarise_volume": lambda s, d: preprocess.binarised(volume(s, d).withColumn("v", F.col("v") - 3e6)),
    "apply_mask": lambda s, d: preprocess.masked(preprocess.binarised(positive(s, d)), mask(s)),
    "mask_guard": _guard,
    "land_to_null": lambda s, d: preprocess.land_to_null(surface(s, d).withColumn("v", F.when(F.col("v") % 7 == 0, 0.0).otherwise(F.col("v")))),
    "build_mask": lambda s, d: preprocess.build_mask(surface(s, d).withColumn("v", F.when(F.col("v") % 7 == 0, 0.0).otherwise(F.col("v"))), SURFACE, 3),
    "background_null": lambda s, d: preprocess.background_to_null(hot(s, d).withColumn("label", F.col("y") + 1), SURFACE),
    "threshold_features": lambda s, d: preprocess.threshold_features(surface(s, d))[0],
    "quantile_map": lambda s, d: preprocess.quantile_map(surface(s, d)).withColumn("thr", _r(F.col("thr"), 1)),
    "lons_to_180": lambda s, d: convert_lons(dims(s)["x"], 180),
    "lons_to_360": lambda s, d: convert_lons(dims(s)["x"].withColumn("lon", F.col("lon") - 180.0), 360),
    "periodic_test": lambda s, d: _periodic(s),
    "scalar_functions": _scalars,
    "layer_thickness": lambda s, d: preprocess.layer_thickness(dims(s)["z"]),
    "cell_volume": lambda s, d: preprocess.cell_volume(mask(s).select("y", "x", (F.col("x") * 1e8).alias("area")), dims(s)["z"]).withColumn("vol", _r(F.col("vol"), 3)),
    "harmonic_parts": _harmonic,
    "harmonic_anomalies": _anomalies,
    "harmonic_features": _features,
    "decimal_year": lambda s, d: _read(s, d, "lineitem").select("l_shipdate").distinct().select("l_shipdate", _r(fn.decimal_year(F.col("l_shipdate")), 6).alias("year")),
    "clean_surface_r2": lambda s, d: morphology.clean_surface(hot(s, d), SURFACE, 2),
    "clean_volume_disk_r1": lambda s, d: morphology.clean_volume(hot(s, d), SURFACE, 1),
    "clean_surface_kernel_r2": lambda s, d: morphology.clean_surface(hot(s, d), SURFACE, 2, method="kernel"),
    "label_2d_8": lambda s, d: components.label_2d(hot(s, d, 0.9), SURFACE),
    "label_2d_4": lambda s, d: components.label_2d(hot(s, d, 0.9), SURFACE, 4),
    "label_2d_stack": lambda s, d: components.label_2d(hot_volume(s, d), VOLUME, 4),
    "label_depths": lambda s, d: components.label_depths(hot_volume(s, d), VOLUME),
    "label_depths_by_slices": lambda s, d: components.label_depths(hot_volume(s, d), VOLUME, block=0),
    "label_3d": lambda s, d: components.label_3d(hot(s, d, 0.95), SURFACE),
    "label_temporal_neighbor": tracked,
    "label_regions": lambda s, d: measures.regions(tracked(s, d), SURFACE),
    "object_areas": lambda s, d: filters.object_sizes(filters.surface_objects(hot(s, d, 0.9), SURFACE, wrap=False)),
    "filter_area": lambda s, d: filters.filter_area(hot(s, d), SURFACE, 0.25, 3)[2],
    "label_filter_area": lambda s, d: filters.label_filter_area(hot(s, d), SURFACE, 0.25, 3)[0],
    "filter_area_by_depth": lambda s, d: filters.filter_area_by_depth(hot_volume(s, d), VOLUME, 0.5, 2),
    "filter_smallest": lambda s, d: filters.filter_smallest(depth_labels(s, d), 0.5),
    "volume_ranks": lambda s, d: filters.volume_ranks(depth_labels(s, d)),
    "wrap_labels": lambda s, d: boundary.merged_edges(edge_labels(s, d), SURFACE),
    "wrap_closure": lambda s, d: boundary.merged_edges(edge_labels(s, d), SURFACE, "closure"),
    "wrap_slices": lambda s, d: boundary.merged_slices(depth_labels(s, d), VOLUME),
    "containment_pairs": lambda s, d: link.containment_pairs(depth_labels(s, d)).drop("w"),
    "containment_volumes": lambda s, d: _rounded(link.containment_pairs(depth_labels(s, d), levels_volume(s)), 3, "t", "label", "prev", "n"),
    "lineage": lambda s, d: link.track_with_splitting(depth_labels(s, d), None, 0.1)[0],
    "lineage_volumes": lambda s, d: link.events_of(depth_labels(s, d), levels_volume(s), 0.3, 0.5),
    "lineage_batches": _streamed,
    "surface_tracker": _surface_events,
    "tracker_alias": lambda s, d: _surface_events(s, d, Tracker),
    "surface_tracker_attrs": _attrs,
    "surface_tracker_summary": _tracker_summary,
    "volume_tracker": lambda s, d: _volume_tracker(s, d, min_quantile=0.25, contain_thresh=0.1).run(levels_volume(s)).result,
    "volume_funnel": lambda s, d: _volume_tracker(s, d).run().funnel(),
    "fraction_flagged": _flagged,
    "durations": lambda s, d: measures.durations(tracked(s, d)),
    "summary": lambda s, d: measures.summary(tracked(s, d)),
    "temporal_measures": lambda s, d: measures.temporal(tracked(s, d), dims(s)["t"]),
    "counts_by_time": lambda s, d: measures.counts_by_time(tracked(s, d)),
    "intensities": lambda s, d: _rounded(measures.intensities(cut(tracked(s, d)), surface(s, d)), 2, "label", "t"),
    "object_masks": _object_masks,
    "process_objects": _orchestrated,
    "extents": lambda s, d: measures.extents(tracked(s, d), dims(s)["y"]).withColumn("spatial_extent", _r(F.col("spatial_extent"), 3)),
    "whole_extents": lambda s, d: _rounded(measures.whole_extents(tracked(s, d), dims(s)["y"], 111.0, 111.0), 3, "label"),
    "deformation": lambda s, d: _rounded(measures.deformation(cut(tracked(s, d)), dims(s)["y"]), 6, "label", "t"),
    "centroid_path": lambda s, d: measures.displacements(_path(s, d)).withColumn("km", _r(F.col("km"), 3)),
    "shape_measures": _shape,
    "motion_measures": _motion,
    "directionality": lambda s, d: _rounded(measures.directionality(_path(s, d)).select("label", "mean_delta_lon", "mean_delta_lat", "movement_count", "direction"), 6, "label", "movement_count", "direction"),
    "member_prefixes": lambda s, d: member_prefixes(_members(s)),
    "find_members": lambda s, d: find_members(member_prefixes(_members(s)).select("prefix").distinct(), "002"),
    "member_pair": lambda s, d: _pair(s),
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Threshold, label, link and summarise: duration, cells and largest value of each event."""
    cells = measures.object_cells(tracked(spark, d), surface(spark, d))
    return cells.groupBy("label").agg(F.count_distinct("t").alias("duration"), F.count("*").alias("cells"), F.max("v").alias("max_v"))


QUERIES["flagship"] = flagship

_LON = "row_number() OVER (ORDER BY lon) - 1)::INT AS new_x"
_SUMMARY = ("count(*) AS n_events, min(d) AS min_duration, floor(quantile_cont(d, 0.5))::INT AS median_duration, max(d) AS max_duration, count(*) FILTER (d >= 1) AS n_at_least_1, "
            "count(*) FILTER (d >= 3) AS n_at_least_3, count(*) FILTER (d >= 6) AS n_at_least_6, count(*) FILTER (d >= 12) AS n_at_least_12")  # fmt: skip
_INTENSITY = "round(sum(v), 2) AS cumulative_intensity, round(avg(v), 2) AS mean_intensity, round(max(v), 2) AS max_intensity, round(stddev_pop(v), 2) AS std_intensity, round(quantile_cont(v, 0.9), 2) AS percentile_90_intensity"
_DEPTH = (o.hot_volume(), o.depths("h4", "d"), "l AS MATERIALIZED (SELECT t, z, y, x, blob AS label FROM d)")
_PATH = (o.centres("labels", "cp", "label, t"), o.moved("cp", "cm"))
_REGIONS = o.blobs("labels", "reg", o.AROUND, ("label", "t"))
_MOTION = (
    *_PATH, _REGIONS, "lv AS MATERIALIZED (SELECT l.*, v FROM labels l JOIN g USING (t, y, x) WHERE v > 0)", "rv AS MATERIALIZED (SELECT reg.*, v FROM reg JOIN g USING (t, y, x) WHERE v > 0)",
    o.centres("reg", "rc", "label, t, blob"), o.centres("rv", "rw", "label, t, blob", "v"), o.centres("lv", "vp", "label, t", "v"), o.moved("vp", "vm"),
    *[f"""{a}n AS (SELECT label, t, count(*) AS n, string_agg((lat * 2)::INT || ':' || (lon * 2)::INT, ',' ORDER BY blob, lat, lon) AS s FROM {a} GROUP BY label, t)""" for a in ("rc", "rw")],
)
_MONTHS = "x AS (SELECT *, CASE WHEN v % 7 = 0 THEN 0.0 ELSE v END AS w FROM g)"
_PREFIXES = "SELECT i AS k, 'b.e21.BHISTcmip6.f09.00' || i AS h, 'b.e21.BSSP370cmip6.f09.00' || i AS f FROM range(1, 6) r(i)"

ORACLE = {
    "grid_build": o.query(o.GRID, then="SELECT * FROM g"),
    "read_fields": o.query(o.GRID, then="SELECT * FROM g"),
    "write_fields": o.query(o.GRID, then="SELECT * FROM g"),
    "select_slice": o.query(o.GRID, then="SELECT * FROM g WHERE t BETWEEN 12 AND 23 AND y BETWEEN 2 AND 5"),
    "volume_grid": o.query(o.VOLUME, then="SELECT * FROM g4"),
    "binarise_warm": o.query(o.GRID, then="SELECT t, y, x FROM g WHERE v - 3e6 > 0"),
    "binarise_cold": o.query(o.GRID, then="SELECT t, y, x FROM g WHERE v - 3e6 < 0"),
    "binarise_volume": o.query(o.VOLUME, then="SELECT t, z, y, x FROM g4 WHERE v - 3e6 > 0"),
    "apply_mask": o.query(o.GRID, o.POSITIVE, then="SELECT * FROM p"),
    "mask_guard": "SELECT mask, n > 0 AS taken FROM (SELECT 'some' AS mask, count(*) FILTER ((i // 24 * 7 + i % 24) % 11 <> 0) AS n FROM range(288) r(i) UNION ALL SELECT 'none', 0)",
    "land_to_null": o.query(o.GRID, _MONTHS, then="SELECT t, y, x, w AS v FROM x WHERE w <> 0"),
    "build_mask": o.query(o.GRID, _MONTHS, then="SELECT (i // 24)::INT AS y, (i % 24)::INT AS x, CASE WHEN w = 0 THEN 0 ELSE 1 END::INT AS valid FROM range(288) r(i) LEFT JOIN x ON x.t = 3 AND x.y = i // 24 AND x.x = i % 24"),
    "background_null": o.query(o.hot(0.7), then="SELECT a.t::INT AS t, (i // 24)::INT AS y, (i % 24)::INT AS x, CASE WHEN h.v IS NOT NULL THEN i // 24 + 1 END::INT AS label FROM range(84) a(t), range(288) r(i) LEFT JOIN h ON h.t = a.t AND h.y = i // 24 AND h.x = i % 24"),
    "threshold_features": o.query(o.hot(0.9), then="SELECT t, y, x, v FROM h"),
    "quantile_map": o.query(o.GRID, then="SELECT y, x, round(quantile_cont(v, 0.9), 1) AS thr FROM g GROUP BY y, x"),
    "lons_to_180": f"SELECT x, lon, ({_LON} FROM (SELECT i::INT AS x, (i * 15.0::DOUBLE + 7.5 + 180) % 360 - 180 AS lon FROM range(24) r(i))",
    "lons_to_360": f"SELECT x, lon, ({_LON} FROM (SELECT i::INT AS x, (i * 15.0::DOUBLE - 172.5 + 360) % 360 AS lon FROM range(24) r(i))",
    "periodic_test": "SELECT n::INT AS n, step, n > 1 AND (n - 1) * step >= 360 - step AS periodic FROM (SELECT unnest([1, 2, 12, 23, 24, 25, 36]) AS n), (SELECT unnest([10.0::DOUBLE, 15.0, 30.0]) AS step)",
    "scalar_functions": f"""SELECT l_orderkey, l_linenumber, round({o.km('a', 'b', 'a / 2', 'b - 40')}, 3) AS km, round(4 * pi() * (a + 91) / nullif(b * b, 0), 6) AS circularity,
  (b + 180) % 360 - 180 AS to_180, (b - 400 + 720) % 360 AS to_360 FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 180 - 90)::DOUBLE AS a, (l_suppkey % 360)::DOUBLE AS b FROM lineitem)""",
    "layer_thickness": o.query(o.LEVELS, then="SELECT * FROM levels"),
    "cell_volume": o.query(o.LEVELS, then="SELECT z, (i // 24)::INT AS y, (i % 24)::INT AS x, round((i % 24) * 1e8 * 1e-4 * (dz / 100), 3) AS vol FROM levels, range(288) r(i)"),
    "harmonic_parts": o.query(o.GRID, o.harmonic(), then=f"SELECT t::INT AS t, y::INT AS y, x::INT AS x, {', '.join(f'round({c} / 1e6, 3) + 0 AS {c}' for c in ('mean', 'trend', 'seas', 'anom'))} FROM parts"),
    "harmonic_anomalies": o.query(o.GRID, o.harmonic(), then="SELECT t::INT AS t, y::INT AS y, x::INT AS x, round(anom / 1e6, 3) + 0 AS v FROM parts"),
    "harmonic_features": o.query(o.GRID, o.harmonic(), then="SELECT t::INT AS t, y::INT AS y, x::INT AS x, round(anom / 1e6, 3) + 0 AS features FROM (SELECT *, quantile_cont(anom, 0.9) OVER (PARTITION BY y, x) AS thr FROM parts) WHERE anom >= thr"),
    "decimal_year": "SELECT DISTINCT l_shipdate, round(year(l_shipdate) + month(l_shipdate) / 12.0::DOUBLE, 6) AS year FROM lineitem",
    "clean_surface_r2": o.query(o.hot(0.7), o.close_open("h", "c", 2, True, 4), then="SELECT * FROM c"),
    "clean_surface_kernel_r2": o.query(o.hot(0.7), o.close_open("h", "c", 2, True, 4), then="SELECT * FROM c"),
    "clean_volume_disk_r1": o.query(o.hot(0.7), o.close_open("h", "c", 1, False, 1), then="SELECT * FROM c"),
    "label_2d_8": o.query(o.hot(0.9), o.blobs("h", "b"), then="SELECT * FROM b"),
    "label_2d_4": o.query(o.hot(0.9), o.blobs("h", "b", o.FOUR), then="SELECT * FROM b"),
    "label_2d_stack": o.query(o.hot_volume(), o.blobs("h4", "b", o.FOUR, ("t", "z")), then="SELECT * FROM b"),
    "label_depths": o.query(*_DEPTH[:2], then="SELECT * FROM d"),
    "label_depths_by_slices": o.query(*_DEPTH[:2], then="SELECT * FROM d"),
    "label_3d": o.query(o.hot(0.95), o.blobs("h", "b"), "i AS MATERIALIZED (SELECT *, t * 288 + blob AS id FROM b)", "n AS (SELECT DISTINCT id FROM i)",
                        f"k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM i a JOIN i b ON b.t = a.t + 1 AND {o.EIGHT})", o.graph("n", "k", "r"),
                        then="SELECT t, y, x, dense_rank() OVER (ORDER BY root)::BIGINT AS label FROM i JOIN r USING (id)"),
    "label_temporal_neighbor": o.tracked("SELECT * FROM labels"),
    "label_regions": o.tracked("SELECT label, t, y, x, blob AS region FROM reg", _REGIONS),
    "object_areas": o.query(o.hot(0.9), o.objects("h", "b"), then="SELECT label, count(*) AS area FROM b GROUP BY label"),
    "filter_area": o.query(o.hot(0.7), o.objects("h", "b"), o.wrapped("b", "w"), o.large("w", "f", 0.25, 3), then="SELECT * FROM f"),
    "label_filter_area": o.query(o.hot(0.7), o.objects("h", "b"), o.wrapped("b", "w"), then="SELECT label, count(*) AS area FROM w GROUP BY label"),
    "filter_area_by_depth": o.query(o.hot_volume(), o.large_by_depth("h4", "f", 0.5, 2), then="SELECT * FROM f"),
    "filter_smallest": o.query(*_DEPTH, o.without_smallest("l", "f", 0.5), then="SELECT * FROM f"),
    "volume_ranks": o.query(*_DEPTH, o.without_smallest("l", "f", 0.5), then="SELECT * FROM f_k"),
    "wrap_labels": o.query(o.hot(0.7), o.objects("h", "b"), o.wrapped("b", "w"), then="SELECT * FROM w"),
    "wrap_closure": o.query(o.hot(0.7), o.objects("h", "b"), o.wrapped("b", "w", closure=True), then="SELECT * FROM w"),
    "wrap_slices": o.query(*_DEPTH, o.slice_wrap("l", "w"), then="SELECT * FROM w"),
    "containment_pairs": o.query(*_DEPTH, then="SELECT b.t, b.label, a.label AS prev, count(*) AS n FROM l b JOIN l a ON b.t = a.t + 1 AND a.z = b.z AND a.y = b.y AND a.x = b.x GROUP BY 1, 2, 3"),
    "containment_volumes": o.query(*_DEPTH, o.LEVELS, then="SELECT b.t, b.label, a.label AS prev, count(*) AS n, round(sum(10000.0 * (dz / 100)), 3) AS w FROM l b JOIN l a ON b.t = a.t + 1 AND a.z = b.z AND a.y = b.y AND a.x = b.x JOIN levels ON levels.z = b.z GROUP BY 1, 2, 3"),
    "lineage": o.query(*_DEPTH, o.lineage("l", "names", 0.1), then="SELECT l.t, z, y, x, event AS label FROM l JOIN names USING (t, label)"),
    "lineage_volumes": o.query(*_DEPTH, o.LEVELS, o.lineage("l", "names", 0.3, 0.5), then="SELECT * FROM names"),
    "lineage_batches": o.query(*_DEPTH, o.lineage("l", "names", 0.1), then="SELECT * FROM names"),
    "surface_tracker": o.query(*o.SURFACE_TRACKER, then="SELECT t, y, x, label AS labels FROM events"),
    "tracker_alias": o.query(*o.SURFACE_TRACKER, then="SELECT t, y, x, label AS labels FROM events"),
    "surface_tracker_attrs": o.query(*o.SURFACE_TRACKER, then="""SELECT n::INT AS initial_objects_identified, (SELECT count(DISTINCT label) FROM events)::INT AS final_objects_tracked, 1 AS radius,
  0.25::DOUBLE AS size_quantile_threshold, 3 AS min_area_cells, least AS min_area_effective, reject AS percent_area_reject, 1 - reject AS percent_area_accept, 'temporal_neighbor' AS method, 0.5::DOUBLE AS contain_thresh
  FROM f_l, (SELECT coalesce(sum(area) FILTER (area <= least), 0) / sum(area) AS reject FROM f_a, f_l)"""),
    "surface_tracker_summary": o.query(*o.SURFACE_TRACKER, then=f"SELECT {_SUMMARY} FROM (SELECT count(DISTINCT t) AS d FROM events GROUP BY label)"),
    "volume_tracker": o.query(*o.volume_tracker(0.1, 0.5), then="SELECT t, z, y, x, event AS events_tracked FROM tracked"),
    "volume_funnel": o.query(*o.volume_tracker(0.3, None), then="""SELECT 'binary_clean' AS stage, count(*) AS cells, NULL::BIGINT AS objects FROM c UNION ALL SELECT 'labeled_2d', count(*), count(DISTINCT (t, z, blob)) FROM c2
  UNION ALL SELECT 'labeled_3d', count(*), count(DISTINCT (t, label)) FROM l3 UNION ALL SELECT 'filtered_labels', count(*), count(DISTINCT (t, label)) FROM l4 UNION ALL SELECT 'tracked', count(*), count(DISTINCT event) FROM tracked"""),
    "fraction_flagged": o.query(o.GRID, o.POSITIVE, o.hot_volume(), o.close_open("h4", "c", 1, False, 1, ("t", "z")), then="SELECT 'surface' AS field, round(count(*) / (84 * 12 * 24), 9) AS flagged FROM p UNION ALL SELECT 'volume', round(count(*) / (28 * 4 * 12 * 24), 9) FROM c"),
    "durations": o.tracked("SELECT label, count(DISTINCT t) AS duration FROM labels GROUP BY label"),
    "summary": o.tracked(f"SELECT {_SUMMARY} FROM (SELECT count(DISTINCT t) AS d FROM labels GROUP BY label)"),
    "temporal_measures": o.tracked("SELECT label, (DATE '1995-01-01' + to_months(min(t)::INT))::DATE AS initial_detection_date, count(DISTINCT t) AS duration FROM labels GROUP BY label"),
    "counts_by_time": o.tracked("SELECT t, count(DISTINCT label) AS n_objects FROM labels GROUP BY t"),
    "intensities": o.tracked(f"SELECT label, t, {_INTENSITY} FROM labels JOIN g USING (t, y, x) WHERE v > 0 GROUP BY GROUPING SETS ((label, t), (label))"),
    "object_masks": o.tracked("SELECT t, y, x, CASE WHEN v - 3e6 > 0 THEN v - 3e6 END AS v FROM labels JOIN g USING (t, y, x) WHERE label = 7"),
    "process_objects": o.tracked("""SELECT l.label, (DATE '1995-01-01' + to_months(min(t)::INT))::DATE AS initial_detection_date, count(DISTINCT t) AS duration, max(v) AS max_intensity,
  round(any_value(smax), 3) AS max_spatial_extent, any_value(n)::BIGINT AS centroids FROM labels l JOIN g USING (t, y, x) JOIN w USING (label) JOIN (SELECT label, count(DISTINCT (t, blob)) AS n FROM reg GROUP BY label) q USING (label)
  WHERE l.label IN (SELECT DISTINCT label FROM labels ORDER BY label LIMIT 12) GROUP BY l.label""", o.EXTENTS, o.WHOLE, _REGIONS),
    "extents": o.tracked("SELECT label, t, round(s, 3) AS spatial_extent FROM a", o.EXTENTS),
    "whole_extents": o.tracked("SELECT label, round(smax * f, 3) AS max_spatial_extent, round(smean * f, 3) AS mean_spatial_extent, round(ssum * f, 3) AS cumulative_spatial_extent FROM w, (SELECT 111.0::DOUBLE * 111.0 / (110.574 * 111.320) AS f)", o.EXTENTS, o.WHOLE),
    "deformation": o.tracked("SELECT label, t, round(x, 6) AS complement_to_deformation, round(1 - x, 6) AS deformation FROM d", o.EXTENTS, o.DEFORMATION),
    "centroid_path": o.tracked("SELECT label, t, lat, lon, round(km, 3) AS km FROM cm", *_PATH),
    "shape_measures": o.tracked("""SELECT a.label, a.t, round(s, 3) AS spatial_extent, round(smax, 3) AS max_spatial_extent, round(smean, 3) AS mean_spatial_extent, round(ssum, 3) AS cumulative_spatial_extent,
  round(coalesce(perimeter, 0), 3) AS perimeter, hull.n AS convex_hull_area, round(size.n / hull.n, 3) AS ratio_convexhullarea_vs_area, round(x, 3) AS complement_to_deformation, round(1 - x, 3) AS deformation,
  round(4 * pi() * s / nullif(perimeter * perimeter, 0), 3) AS circularity
  FROM a JOIN w USING (label) JOIN hull ON hull.label = a.label AND hull.t = a.t JOIN size ON size.label = a.label AND size.t = a.t LEFT JOIN peri ON peri.label = a.label AND peri.t = a.t
  LEFT JOIN d ON d.label = a.label AND d.t = a.t""", o.EXTENTS, o.WHOLE, o.DEFORMATION, o.OUTLINES),
    "motion_measures": o.tracked("""SELECT c.label, c.t, rcn.n AS num_centroids_per_timestep, rcn.s AS centroid_coords, c.lat AS centroid_lat, c.lon AS centroid_lon, round(c.km, 3) AS centroid_km,
  rwn.n AS num_coms_per_timestep, rwn.s AS com_coords, m.lat AS com_lat, m.lon AS com_lon, round(m.km, 3) AS com_km
  FROM cm c JOIN rcn ON rcn.label = c.label AND rcn.t = c.t LEFT JOIN (rwn JOIN vm m USING (label, t)) ON m.label = c.label AND m.t = c.t""", *_MOTION),
    "directionality": o.tracked("""SELECT label, round(dx, 6) AS mean_delta_lon, round(dy, 6) AS mean_delta_lat, n AS movement_count, CASE WHEN a < 45 OR a >= 315 THEN 'eastward (zonal-dominated)' WHEN a < 135 THEN 'northward (meridional-dominated)'
  WHEN a < 225 THEN 'westward (zonal-dominated)' ELSE 'southward (meridional-dominated)' END AS direction FROM (SELECT *, (degrees(atan2(dy, dx)) + 360) % 360 AS a FROM (SELECT label, avg(e) AS dx, avg(f) AS dy, count(*) AS n FROM (
  SELECT label, lead(lat) OVER q - lat AS e, lead(lon) OVER q - lon AS f FROM cp WINDOW q AS (PARTITION BY label ORDER BY t)) WHERE e IS NOT NULL GROUP BY label))""", _PATH[0]),
    "member_prefixes": o.query(o.MEMBERS, then="SELECT * FROM members"),
    "find_members": o.query(o.MEMBERS, then="SELECT * FROM (SELECT prefix, (row_number() OVER (ORDER BY prefix) - 1)::INT AS place FROM (SELECT DISTINCT prefix FROM members)) WHERE prefix LIKE '%002%'"),
    "member_pair": f"SELECT part, h AS historical, f AS future FROM ({_PREFIXES}), (SELECT unnest(['f09.002', '004']) AS part) WHERE contains(h, part)",
    "flagship": o.tracked("SELECT label, count(DISTINCT t) AS duration, count(*) AS cells, max(v) AS max_v FROM labels JOIN g USING (t, y, x) WHERE v > 0 GROUP BY label"),
}
