"""Linking volume objects through time by containment.

The cell work is one join: for each pair of objects of neighbouring times, the cells (and the volume) they share. Events
of the time before may be unions of objects, and shares of disjoint objects add up, so the fold over time needs only
rows of objects and of overlapping pairs. Objects that no chain of pairs connects don't influence each other, so the fold
runs in tasks of whole components; an event is named there by its first object, and numbered afterwards.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import TOGETHER, cut, dealt, numbered


def object_table(labels: DataFrame, volume: DataFrame | None = None) -> DataFrame:
    """t, label, n and w (the volume; NULL without one)."""
    if volume is None:
        return labels.groupBy("t", "label").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("w"))
    joined = labels.join(volume, ["z", "y", "x"], "left")
    return joined.groupBy("t", "label").agg(F.count("*").alias("n"), F.sum("vol").alias("w"))


def containment_pairs(labels: DataFrame, volume: DataFrame | None = None) -> DataFrame:
    """t, label, prev (an object of t - 1), n and w, for all pairs that share a cell."""
    before = labels.select((F.col("t") + 1).alias("t"), "z", "y", "x", F.col("label").alias("prev"))
    both = labels.join(before, ["t", "z", "y", "x"])
    if volume is None:
        return both.groupBy("t", "label", "prev").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("w"))
    both = both.join(volume, ["z", "y", "x"], "left")
    return both.groupBy("t", "label", "prev").agg(F.count("*").alias("n"), F.sum("vol").alias("w"))


def score(n: float, size: float, other: float, w: float | None, w_size: float | None, w_other: float | None, alpha: float) -> float:
    """The larger share of the two in the common part, mixed with the same of volumes. A volume that is not a number in
    the common part or the current object rules a link out."""
    cells = max(n / size, n / other)
    if w_size is None:
        return cells
    ratio = lambda a, b: a / b if b else math.nan
    first, second = ratio(w, w_size), ratio(w, w_other)
    if math.isnan(first):
        return math.nan
    return alpha * cells + (1 - alpha) * (second if second > first else first)


def fold(objects: list[tuple], pairs: list[tuple], thresh: float, alpha: float) -> dict[tuple, tuple]:
    """objects (t, label, n, w) and pairs (t, label, prev, n, w) of whole components. Gives (t, label) -> (t, label) of
    the first object of its event. An object joins the earliest of the events that share enough of it; of the last time's
    events, all cells count."""
    by_time: dict = defaultdict(dict)
    for t, b, n, w in objects:
        by_time[t][b] = (n, w)
    shares: dict = defaultdict(list)
    for t, b, prev, n, w in pairs:
        shares[t, b].append((prev, n, w))
    out: dict[tuple, tuple] = {}
    parents: dict = {}
    for t in sorted(by_time):
        now = {}
        for b, (size, w_size) in by_time[t].items():
            common: dict = defaultdict(lambda: [0, 0.0])
            for prev, n, w in shares.get((t, b), ()):
                c = common[out[t - 1, prev]]
                c[0] += n
                c[1] += w if w is not None else 0.0
            fits = [
                e for e, (n, w) in common.items()
                if score(n, size, parents[e][0], w, w_size, parents[e][1], alpha) > thresh
            ]
            now[b] = min(fits, default=(t, b))
        parents = {}
        for b, e in now.items():
            n, w = by_time[t][b]
            n0, w0 = parents.get(e, (0, 0.0))
            parents[e] = (n0 + n, w0 + (w if w is not None else 0.0))
        out.update(((t, b), e) for b, e in now.items())
    return out


def events_of(labels: DataFrame, volume: DataFrame | None = None, contain_thresh: float = 0.3, alpha: float = 0.5, *,
              first: int = 0, next_id: int | None = None, together: int = TOGETHER) -> DataFrame:
    """t, label, event for each object. Objects of the time `first` give their labels to the events; later events are
    numbered in the order of their first time and label, from next_id on (by default, after those of `first`)."""
    objects = cut(object_table(labels, volume).select(F.col("t").cast("int"), F.col("label").cast("bigint"), "n", "w"))
    pairs = cut(containment_pairs(labels, volume).select(F.col("t").cast("int"), F.col("label").cast("bigint"), F.col("prev").cast("bigint"), "n", "w"))
    key = lambda t, b: F.struct(F.col("t").alias("t") if t is None else t.alias("t"), F.col(b).alias("b"))
    nodes = objects.select(key(None, "label").alias("id"))
    edges = pairs.select(key(None, "label").alias("a"), key(F.col("t") - 1, "prev").alias("b"))
    bucket = dealt(nodes, edges, together).select("id.t", F.col("id.b").alias("label"), "bucket")
    rows = objects.withColumn("prev", F.lit(None).cast("bigint")).unionByName(pairs).join(bucket, ["t", "label"])

    def run(table: pa.Table) -> pa.Table:
        all_rows = list(zip(*[table.column(c).to_pylist() for c in ("t", "label", "prev", "n", "w")], strict=True))
        own = [(t, b, n, w) for t, b, prev, n, w in all_rows if prev is None]
        found = fold(own, [r for r in all_rows if r[2] is not None], contain_thresh, alpha)
        flat = [(t, b, *e) for (t, b), e in found.items()]
        columns = list(zip(*flat, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["t", "label", "t0", "b0"])

    named = cut(rows.groupBy("bucket").applyInArrow(run, "t int, label bigint, t0 int, b0 bigint"))
    if next_id is None:
        next_id = (objects.filter(F.col("t") == first).agg(F.max("label")).first()[0] or 0) + 1
    later = numbered(named.filter(F.col("t0") != first), ["t0", "b0"], "place")
    event = F.when(F.col("t0") == first, F.col("b0")).otherwise(F.col("place") + (next_id - 1))
    return named.join(later, ["t0", "b0"], "left").select("t", "label", event.cast("bigint").alias("event"))


def track_with_splitting(labels: DataFrame, volume: DataFrame | None = None, contain_thresh: float = 0.3, alpha: float = 0.5, first: int = 0):
    """(cells with label = event, lineage (id, origin_id)). first: the grid's first time, whose labels are event ids."""
    table = cut(events_of(labels, volume, contain_thresh, alpha, first=first))
    tracked = labels.join(table, ["t", "label"]).drop("label").withColumnRenamed("event", "label")
    lineage = table.select(F.col("event").alias("id"), F.col("event").alias("origin_id")).distinct()
    return tracked, lineage
