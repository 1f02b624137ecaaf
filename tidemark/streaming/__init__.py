"""Fields that arrive as a stream: cells of an event stream by day, and lineage carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..operators.link import events_of


def day_cells(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Cells (window start, y, x) of an event stream with the number and sum of events, late rows up to `late`."""
    keys = [F.window("ts", "1 day").alias("day"), (F.col("user_id") % 12).cast("int").alias("y"), (F.col("event_id") % 24).cast("int").alias("x")]
    return events.withWatermark("ts", late).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def _folders(spark, state: str) -> dict[int, object]:
    """The batches that have a state, and its folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return {}
    names = [s.getPath() for s in system.listStatus(path)]
    return {int(p.getName()[6:]): p for p in names if p.getName().startswith("batch=") and system.exists(p.suffix("/_SUCCESS"))}


def lineage_batches(sink: Callable[[DataFrame, int], None], state: str, contain_thresh: float = 0.3, alpha: float = 0.5, first: int = 0):
    """A foreachBatch function for labelled cells (t, z, y, x, label) that arrive in the order of t, whole times in each
    batch: it gives each batch's (t, label, event) to the sink. The state, the last time's cells with their events and the
    next id, is a table in the shared folder `state`, one for each batch number: a batch starts from the latest state of
    an earlier number, so after a restart nothing is lost, and a repeated batch gives the same rows again. States before
    the last two are removed. An empty batch leaves the state as it is."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cells = cut(batch.select(F.col("t").cast("int"), F.col("z").cast("int"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("label").cast("bigint")))
        if cells.isEmpty():
            return
        known = _folders(spark, state)
        before = [n for n in known if n < number]
        if before:
            last = spark.read.parquet(known[max(before)].toString())
            start, next_id = last.select("t", "next_id").first()
            cells_and_last = cells.unionByName(last.select("t", "z", "y", "x", "label"))
            names = events_of(cells_and_last, None, contain_thresh, alpha, first=start, next_id=next_id).filter(F.col("t") != start)
        else:
            next_id = 1
            names = events_of(cells, None, contain_thresh, alpha, first=first)
        names = cut(names)
        latest, highest = names.agg(F.max("t"), F.max("event")).first()
        own = cells.filter(F.col("t") == latest).join(names, ["t", "label"]).select("t", "z", "y", "x", F.col("event").alias("label"))
        own = own.withColumn("next_id", F.lit(max(next_id, highest + 1)).cast("bigint"))
        own.write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")
        sink(names, number)
        for n in sorted(before)[:-1]:
            known[n].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(known[n], True)

    return step
