"""Each pipeline stage on empty tables, null ids, equal ids and clashing columns."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, near_dedup, pii, quality_rules, substring_dedup

STAGES = {"quality": quality_rules.stage, "near": near_dedup.stage, "passages": substring_dedup.stage, "pii": pii.stage}
FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORDS = [f"w{k}" for k in range(400)]


def prose(a, n=80):
    return " ".join(f"{w} it{(i * a) % 97}" for i, w in enumerate(WORDS[a : a + n])) + "."


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id bigint, _kept string, row_key int, cut_text int, `a.b` string, kept boolean, rep string, h bigint"


def frame(spark, rows):
    """rows: (id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 7, "k", k, 2, "dot", False, "r", 5) for k, (i, t) in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize("name", STAGES)
def test_odd_tables(spark, name):
    docs = frame(spark, [(1, prose(0)), (2, prose(100)), (None, prose(200)), (None, prose(300)), (3, None), (4, ""), (2, prose(250))])
    got = STAGES[name](docs)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    rows = got.collect()
    texts = {r["row_key"]: r["text"] for r in rows}
    want = {0, 1, 2, 3, 6} | (set() if name == "quality" else {4, 5})
    assert set(texts) == want and len(rows) == len(want)
    for r in rows:
        assert (r["_id"], r["_kept"], r["a.b"], r["kept"], r["rep"], r["h"]) == (7, "k", "dot", False, "r", 5)
    assert {k: texts[k] for k in (0, 1, 2, 3, 6)} == {0: prose(0), 1: prose(100), 2: prose(200), 3: prose(300), 6: prose(250)}
    assert STAGES[name](docs.filter("false")).count() == 0


def test_passages_of_rows_with_equal_ids(spark):
    passage = " ".join(WORDS[:40])
    docs = frame(spark, [(1, passage), (2, passage + " tail of two"), (2, "an entirely different text")])
    assert {r["row_key"]: r["text"] for r in substring_dedup.stage(docs).collect()} == {0: passage, 1: "tail of two", 2: "an entirely different text"}


def test_near_copies_of_rows_with_equal_ids(spark):
    a, b = prose(0), prose(200)
    docs = frame(spark, [(1, a), (2, a), (2, b), (2, b), (None, a), (5, ""), (5, "")])
    got = near_dedup.stage(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (2, b), (5, ""), (5, "")]


def test_counts_of_heavy_and_light_keys(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 700).alias("k"), "id")
    want = {(r["k"], r["count"]) for r in rows.groupBy("k").count().filter("count > 1").collect()}
    for rare, most in ((10, 50), (1, 10**9), (10**9, 1)):
        monkeypatch.setattr(common, "RARE", rare)
        monkeypatch.setattr(common, "MOST", most)
        got = common.counted(rows, "k")
        assert {(r["k"], r["count"]) for r in got.select("k", "count").distinct().collect()} == want
        assert got.count() == sum(n for _, n in want)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

            class _jsc:  # noqa: N801
                class sc:  # noqa: N801
                    class getCheckpointDir:  # noqa: N801
                        isEmpty = staticmethod(lambda: True)

    with pytest.raises(RuntimeError):
        common.shared_dir(Far)


def test_stored_tables_leave_the_driver_no_free_memory(spark):
    jvm = spark.sparkContext._jvm
    pid, unsafe = jvm.java.lang.ProcessHandle.current().pid(), jvm.org.apache.spark.unsafe.Platform
    resident = lambda: int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 / 1e6
    common.stored(spark.range(1), "first")
    places, pins = [], []
    for _ in range(1000):
        places.append(unsafe.allocateMemory(100_000))
        pins.append(unsafe.allocateMemory(1000))
        unsafe.setMemory(places[-1], 1, 100_000)
    full = resident()
    for place in places:
        unsafe.freeMemory(place)
    common.stored(spark.range(1), "second")
    left = resident()
    for place in pins:
        unsafe.freeMemory(place)
    assert left < full - 70


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = lambda: {p.name for folder in disk.localDirsString() for p in Path(folder).rglob("shuffle_*")}
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(3)
    both = rows.join(rows.groupBy("k").count().hint("merge"), "k")
    before, setting = found(), spark.conf.get(FILES, None)
    kept = common.stored(both, "both")
    until = time.time() + 10  # executors are told, not waited for
    while found() - before and time.time() < until:
        time.sleep(0.1)
    assert not found() - before and spark.conf.get(FILES, None) == setting
    assert kept.count() == both.count() == 1000


def test_passages_read_the_texts_last_without_earlier_tables(spark, monkeypatch, tmp_path):
    there = {}

    def spied(df, tag, into=None):
        there[tag] = {p.name.split("-")[1] for p in tmp_path.iterdir()}
        return common.stored(df, tag, into)

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(substring_dedup, "stored", spied)
    monkeypatch.setattr(substring_dedup, "BROADCAST", -1)
    passage = " ".join(WORDS[:40])
    docs = frame(spark, [(1, passage), (2, passage + " tail of two"), (3, "an entirely different text")])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.op8(docs).collect()}
    assert got == {1: (40, 0), 2: (43, 40), 3: (4, 0)}
    assert there["segments"] == {"plain", "hot"} and there["cut"] == {"plain", "marked"}
