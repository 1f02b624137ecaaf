"""Components of graphs of objects, and ranks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of objects that one task takes in order; more are dealt by the components of their graph.
TOGETHER = 100_000


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder; on a cluster, that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder, so that lineage ends and a lost executor costs nothing."""
    shared(df.sparkSession)
    return df.checkpoint()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), edges (a, b): id, root, the least id that each node reaches. Every round, each node takes the least
    root around it, and that root's own root."""
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct())
    roots = cut(nodes.select("id").distinct().withColumn("root", F.col("id")))
    while True:
        near = both.join(roots.select(F.col("id").alias("to"), "root"), "to").groupBy("id").agg(F.min("root").alias("near"))
        new = roots.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("up"))
        jump = roots.select(F.col("id").alias("up"), F.col("root").alias("top"))
        new = cut(new.join(jump, "up").select("id", "old", F.least("up", "top").alias("root")))
        roots = new.select("id", "root")
        if new.filter("old <> root").isEmpty():
            return roots


def dealt(nodes: DataFrame, edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """nodes (id) with bucket: nodes of one component share a bucket, which holds `together` nodes or so. A graph of no
    more nodes than that is one bucket; then the components aren't looked for."""
    n = nodes.count()
    if n <= together:
        return nodes.select("id").withColumn("bucket", F.lit(0))
    buckets = -(-n // max(together, 1))
    return connected(nodes, edges).select("id", F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("int").alias("bucket"))


def numbered(objects: DataFrame, order: list[str], to: str = "label") -> DataFrame:
    """Consecutive numbers from 1 in the order of the columns, the first of which is t: ranks within each t, and what the
    earlier ones hold (a window over a row for each t)."""
    distinct = objects.select(*order).distinct()
    sizes = distinct.groupBy(order[0]).count()
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)))
    ranked = distinct.withColumn("own", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])))
    return ranked.join(before.drop("count"), order[0]).select(*order, (F.col("own") + F.coalesce("before", F.lit(0))).cast("bigint").alias(to))


def ranked(rows: DataFrame, order: list[str], to: str = "rank") -> DataFrame:
    """rows with their place from 1 in a total order: dealt by ranges of it, so no value's rows meet in one task; a row
    for each partition says how many the earlier ones hold."""
    at = F.monotonically_increasing_id()
    rows = cut(rows.orderBy(*order).withColumn("_at", at))
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumns({"_part": part, "_own": own}).drop("_at")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    # a row for each partition
    return rows.join(F.broadcast(before), "_part").withColumn(to, (F.col("_own") + F.col("_before") + 1).cast("bigint")).drop("_part", "_own", "_before")
