"""The two trackers: each step is a plan over the one before; later steps run missing earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import measures
from ..operators.boundary import merged_edges, merged_slices
from ..operators.components import label_2d, label_3d, label_depths, label_temporal_neighbor
from ..operators.filters import filter_area, filter_area_by_depth, filter_smallest
from ..operators.graph import cut
from ..operators.link import track_with_splitting
from ..operators.morphology import clean_surface, clean_volume
from ..operators.preprocess import binarised, masked
from ..sources import Grid


class _Tracker:
    result: DataFrame | None = None

    def _events(self) -> DataFrame:
        raise NotImplementedError

    def n_events(self) -> int:
        return measures.n_events(self._events())

    def event_duration(self) -> DataFrame:
        return measures.durations(self._events())

    def summary(self) -> DataFrame:
        return measures.summary(self._events())


class SurfaceTracker(_Tracker):
    """Events of a surface field (t, y, x, v) on a mask (y, x, valid): clean, filter, track, postprocess."""

    def __init__(self, field: DataFrame, mask: DataFrame, grid: Grid, *, radius: int = 2, min_size_quartile: float = 0.25, min_area_cells: int = 100,
                 positive: bool = True, method: str = "3d", contain_thresh: float = 0.0):
        if method not in ("3d", "temporal_neighbor"):
            raise ValueError(f"unknown method {method}")
        self.field, self.mask, self.grid, self.radius, self.q, self.floor = field, mask, grid, radius, min_size_quartile, min_area_cells
        self.positive, self.method, self.contain_thresh = positive, method, contain_thresh
        self.binary_clean = self.binary_filtered = self.area = self.min_area = self.N_initial = self.labels_raw = self.result = self.attrs = None

    def __repr__(self) -> str:
        return f"SurfaceTracker(radius={self.radius}, method={self.method!r}, contain_thresh={self.contain_thresh})"

    def clean(self) -> SurfaceTracker:
        cells = clean_surface(binarised(self.field, self.positive), self.grid, self.radius)
        self.binary_clean = cut(masked(cells, self.mask))
        return self

    def fraction_flagged(self) -> float:
        return self.binary_clean.count() / (self.grid.t * self.grid.y * self.grid.x)

    def filter(self) -> SurfaceTracker:
        if self.binary_clean is None:
            self.clean()
        self.area, self.min_area, kept, self.N_initial = filter_area(self.binary_clean, self.grid, self.q, self.floor)
        self.binary_filtered = cut(kept)
        return self

    def track(self) -> SurfaceTracker:
        if self.binary_filtered is None:
            self.filter()
        if self.method == "3d":
            labels = label_3d(self.binary_filtered, self.grid)
        else:
            labels = label_temporal_neighbor(self.binary_filtered, self.grid, self.contain_thresh)
        self.labels_raw = cut(merged_edges(labels, self.grid) if self.grid.periodic else labels)
        return self

    def postprocess(self) -> SurfaceTracker:
        if self.labels_raw is None:
            raise RuntimeError("track() comes first")
        self.result = self.labels_raw.withColumnRenamed("label", "labels")
        share = self.area.agg(
            F.coalesce(F.try_divide(F.sum(F.when(F.col("area") <= self.min_area, F.col("area"))), F.sum("area")), F.lit(0.0)).alias("reject")
        )
        n = measures.n_events(self.labels_raw)
        # fixed values: the names of the attributes
        self.attrs = share.select(
            F.lit(self.N_initial).alias("initial objects identified"), F.lit(n).alias("final objects tracked"), F.lit(self.radius).alias("radius"),
            F.lit(self.q).alias("size quantile threshold"), F.lit(self.floor).alias("min area cells"), F.lit(self.min_area).alias("min area (effective)"),
            F.col("reject").alias("percent area reject"), (1 - F.col("reject")).alias("percent area accept"), F.lit(self.method).alias("method"),
            F.lit(self.contain_thresh).alias("contain_thresh"),
        )
        return self

    def run(self) -> SurfaceTracker:
        return self.clean().filter().track().postprocess()

    def n_events(self) -> int:
        if self.labels_raw is None:
            raise RuntimeError("track() comes first")
        return measures.n_events(self.labels_raw)

    def _events(self) -> DataFrame:
        if self.result is None:
            raise RuntimeError("postprocess() comes first")
        return self.labels_raw


class VolumeTracker(_Tracker):
    """Events of a volume field (t, z, y, x, v): clean, label, connect_depth, prefilter, track, postprocess."""

    def __init__(self, field: DataFrame, grid: Grid, *, radius: int = 3, min_area_cells: int = 200, min_quantile: float = 0.25, contain_thresh: float = 0.3,
                 alpha: float = 0.5, frac_filter: float = 0.25, connect_z: bool = True, positive: bool = True, n_z: int = 20, wrap_lon: bool = False):
        self.field, self.grid, self.radius, self.floor, self.q = field, grid, radius, min_area_cells, min_quantile
        self.contain_thresh, self.alpha, self.frac, self.connect_z, self.positive, self.wrap = contain_thresh, alpha, frac_filter, connect_z, positive, wrap_lon
        self.binary_clean = self.labeled_2d = self.labeled_3d = self.filtered_labels = self.tracked = self.origin_map = self.result = None

    def __repr__(self) -> str:
        return f"VolumeTracker(radius={self.radius}, contain_thresh={self.contain_thresh}, alpha={self.alpha})"

    def clean(self) -> VolumeTracker:
        self.binary_clean = cut(clean_volume(binarised(self.field, self.positive), self.grid, self.radius))
        return self

    def fraction_flagged(self) -> float:
        return self.binary_clean.count() / (self.grid.t * self.grid.z * self.grid.y * self.grid.x)

    def label(self) -> VolumeTracker:
        if self.binary_clean is None:
            self.clean()
        self.labeled_2d = label_2d(self.binary_clean, self.grid, 4).withColumnRenamed("blob", "label")
        return self

    def connect_depth(self) -> VolumeTracker:
        if self.labeled_2d is None:
            self.label()
        kept = filter_area_by_depth(self.binary_clean, self.grid, self.q, self.floor)
        blobs = label_depths(kept, self.grid, connect_z=self.connect_z)
        # numbers start anew at each time
        names = blobs.select("t", "blob").distinct().withColumn("label", F.row_number().over(Window.partitionBy("t").orderBy("blob")).cast("bigint"))
        labels = blobs.join(names, ["t", "blob"]).drop("blob")
        self.labeled_3d = cut(merged_slices(labels, self.grid) if self.wrap else labels)
        return self

    def prefilter(self) -> VolumeTracker:
        if self.labeled_3d is None:
            self.connect_depth()
        self.filtered_labels = cut(filter_smallest(self.labeled_3d, self.frac))
        return self

    def track(self, volume: DataFrame | None = None) -> VolumeTracker:
        if self.filtered_labels is None:
            self.prefilter()
        tracked, self.origin_map = track_with_splitting(self.filtered_labels, volume, self.contain_thresh, self.alpha)
        self.tracked = cut(tracked)
        return self

    def postprocess(self) -> VolumeTracker:
        if self.tracked is None:
            raise RuntimeError("track() comes first")
        self.result = self.tracked.withColumnRenamed("label", "events_tracked")
        return self

    def run(self, volume: DataFrame | None = None) -> VolumeTracker:
        return self.clean().label().connect_depth().prefilter().track(volume).postprocess()

    def funnel(self) -> DataFrame:
        """stage, cells and objects after each step that has run."""
        out = None
        for name in ("binary_clean", "labeled_2d", "labeled_3d", "filtered_labels", "tracked"):
            df = getattr(self, name)
            if df is not None:
                keys = ["t", *(["z"] if name == "labeled_2d" else []), "label"] if name != "tracked" else ["label"]
                n = F.count_distinct(*keys) if "label" in df.columns else F.lit(None).cast("bigint")
                row = df.agg(F.lit(name).alias("stage"), F.count("*").alias("cells"), n.alias("objects"))
                out = row if out is None else out.unionByName(row)
        return out

    def _events(self) -> DataFrame:
        if self.result is None:
            raise RuntimeError("postprocess() comes first")
        return self.tracked


Tracker = SurfaceTracker
