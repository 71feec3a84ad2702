import os
import time

from pyspark.sql import functions as F

from quillspark.llm import common as C


def shuffle_files(spark):
    folder = spark.conf.get("spark.local.dir")
    return {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffle_files_of_a_written_table_go(spark):
    before = shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = C.materialize(df.join(df.withColumnRenamed("count", "n").hint("merge"), "k"), "test")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert sorted(r["n"] for r in table.collect()) == [142, *[143] * 6]
    assert df.count() == 7 and spark.conf.get(C.CLEANUP) == "false"  # other queries keep theirs
    C.discard(table)
    assert not os.path.exists(table.inputFiles()[0].removeprefix("file://"))


def test_executors_collect_their_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    C.collect_executors(spark)  # a local session's executor is the driver
    assert sum(b.getCollectionCount() for b in beans()) > before


def test_steps_collect_the_executors_now_and_then(monkeypatch):
    class Session:
        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master})

    calls = []
    monkeypatch.setattr(C, "collect_executors", calls.append)
    for master, more in (("local[4]", 0), ("local", 0), ("local-cluster[3,2,3000]", 1), ("spark://host:7077", 1), ("yarn", 1)):
        monkeypatch.setattr(C, "collected", [time.monotonic(), time.monotonic() - C.EXECUTORS_PAUSE - 1])
        before = len(calls)
        for _ in range(3):  # once in a while, however many steps there are
            C.collect_garbage(Session(master))
        assert len(calls) - before == more
