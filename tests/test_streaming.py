"""Streams: lineage over batches with a restart, and cells of an event stream."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import link
from tidemark.streaming import day_cells, lineage_batches


def labels(spark):
    rng = np.random.default_rng(21)
    a = (rng.random((9, 1, 6, 7)) < 0.4) * rng.integers(1, 5, (9, 1, 6, 7))
    a[4] = 0
    rows = [(*map(int, i), int(a[tuple(i)])) for i in np.argwhere(a > 0)]
    return spark.createDataFrame(rows, "t int, z int, y int, x int, label bigint")


def test_lineage_over_a_restart(spark, tmp_path):
    cells = labels(spark)
    whole = {tuple(r) for r in link.events_of(cells, None, 0.25).select("t", "label", "event").collect()}
    got: dict[int, set] = {}

    def sink(df, n):
        got[n] = {tuple(r) for r in df.select("t", "label", "event").collect()}

    state, cuts = str(tmp_path / "state"), (0, 2, 3, 6, 9)
    part = lambda n: cells.filter((F.col("t") >= cuts[n]) & (F.col("t") < cuts[n + 1]))
    step = lineage_batches(sink, state, 0.25)
    step(part(0), 0)
    step(part(1), 1)
    step(cells.filter("false"), 2)  # nothing arrives
    first = dict(got)
    step = lineage_batches(sink, state, 0.25)  # a new process
    step(part(1), 1)  # the last batch is handed over again
    assert got == first
    step(part(2), 3)
    step(part(3), 4)
    assert set().union(*got.values()) == whole


def test_lineage_as_a_stream(spark, tmp_path):
    cells = labels(spark)
    for t in range(9):
        cells.filter(F.col("t") == t).coalesce(1).write.parquet(str(tmp_path / f"in/{t}"))
    schema, out = cells.schema, []
    step = lineage_batches(lambda df, n: out.extend(tuple(r) for r in df.select("t", "label", "event").collect()), str(tmp_path / "state"), 0.25)
    q = (
        spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
        .writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert set(out) == {tuple(r) for r in link.events_of(cells, None, 0.25).select("t", "label", "event").collect()}


def test_day_cells(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 3} 10:00:00", k % 5, float(k)) for k in range(60)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = day_cells(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("day_cells").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["day"]["start"].day, r["y"], r["x"], r["n"], r["v"]) for r in spark.table("day_cells").collect()}
    want = {(r["day"]["start"].day, r["y"], r["x"], r["n"], r["v"]) for r in day_cells(events).collect()}
    assert got == want and sum(g[3] for g in got) == 60
