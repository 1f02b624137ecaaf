"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: In counted(): heavy keys at most, and the rows from which on a key can be one.
MOST, RARE = 50_000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder; on a cluster, whose executors would each write to their own disk, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextmanager
def freed(spark: SparkSession):
    """Within it, the shuffle files of a query that is begun and run go as it ends. Else they stay until the driver happens
    to collect its garbage, so that the disk that a chain of queries takes would depend on the time of that."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, tag: str, into: list | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later readers neither recompute it nor lose it
    with an executor, and its shuffle files go. Removed when the application ends, or by discard(); into: a list that gets
    it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    with freed(spark):
        df.write.parquet(path)
    system, target = _folder(spark, path)
    system.deleteOnExit(target)
    spare(spark)
    out = spark.read.schema(schema).parquet(path)
    out._tidemark_path = path
    if into is not None:
        into.append(out)
    return out


def discard(tables: list, *but: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more, all but some."""
    for t in (t for t in tables if not any(t is b for b in but)):
        system, target = _folder(t.sparkSession, t._tidemark_path)
        system.delete(target, True)
        system.cancelDeleteOnExit(target)


def met(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows.join(table, keys, how), where table (stored) has each key once and in `weight` how many rows have it. Keys that
    hold more than one in MOST rows, so MOST keys at most, are broadcast and joined where their rows are; only rows of
    other keys are shuffled. rows is read twice; weight is dropped."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    bound = max(RARE, total // MOST)
    heavy = F.broadcast(table.filter(F.col(weight) > bound).drop(weight))
    light = table.filter(F.col(weight) <= bound).drop(weight)
    near = rows.join(heavy, keys)
    far = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return near.unionByName(far)


def counted(rows: DataFrame, key: str, to: str = "count", least: int = 2, into: list | None = None) -> DataFrame:
    """The rows whose key has `least` rows or more, with their number."""
    sizes = stored(rows.groupBy(key).agg(F.count("*").alias(to)).filter(F.col(to) >= least), "counts", into)
    return met(rows, sizes.withColumn("_weight", F.col(to)), [key], "_weight")


def release() -> None:
    """Gives free memory back to the system: idle Python workers stay alive for the next stage and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spare(spark: SparkSession) -> None:
    """The same for the driver's JVM: compilers and the threads of its pools leave free pieces all over the allocator's
    arenas, and a heap that one step's plans have grown would stay so. The heap is collected only where it takes more than
    half of its limit and has grown since it was last collected here. A JVM without the command to trim keeps its pieces."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > max(runtime.maxMemory() // 2, getattr(spark.sparkContext, "_tidemark_heap", 0)):
        gc.collect()
        jvm.java.lang.System.gc()
        spark.sparkContext._tidemark_heap = runtime.totalMemory()
    named = jvm.java.lang.Class.forName
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = named(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by the interface's method, as the server's own class is not exported
    invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        pass


def lean(run):
    """run, a function of mapInArrow, that releases memory at the end of each task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text is an empty one."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def columns(docs: DataFrame, *but: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c not in but]


def told_apart(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, bool]:
    """(docs with a key column, its name, whether ids tell rows apart). The key is doc_id where every row has one of its
    own; else it is a struct that orders rows by id (null last) and then by a hash of their text, so only rows with equal
    ids and texts share one."""
    name = fresh(docs, "row_key")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if again.isEmpty():
        return docs.withColumn(name, F.col("doc_id")), name, True
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    return docs.withColumn(name, key), name, False


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, a struct of all columns but text, and text: what an operator takes to hand rows on as they are."""
    return docs.select(F.struct(*columns(docs, "text")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def handed_on(result: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs, from result's doc_id (see carried) and the new text; n_chars follows it."""
    new = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return result.select(*[new[c].alias(c) if c in new else F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def words(text: Column) -> Column:
    """The words of a text: runs of anything but SPACE."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def sealed(d: DataFrame, *columns: Column | str) -> DataFrame:
    """d.select(*columns), so that no later filter moves below it: the optimizer would put the expressions of a long
    chain of projections into the filter, and into each other, and compute them many times over."""
    return d.select(F.inline(F.array(F.struct(*columns))))
