"""What several operators share: scratch tables, hold-out folds, deterministic range cuts and files on shared storage."""

from __future__ import annotations

import contextlib
import gc
import math
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without the six ASCII white-space characters; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Part of all rows from which a key's rows are not shuffled to meet their one partner.
HOT = 4096
#: Ranges of a table at most; a larger table has larger ranges.
MOST_CUTS = 100_000
#: Bits of a row of ``bitmap_construct_agg``.
PAGE = 1 << 15
#: Spark removes the shuffle files of a query that began under this setting when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds at least between two collections of the driver's garbage, and when the last one was.
PAUSE, collected = 60, [0.0, 0.0]
#: The same for the executors', which a local session does not have.
EXECUTORS_PAUSE = 12


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; unset, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and a lost executor costs no rerun.

    The shuffle files of the write go with it."""
    spark = df.sparkSession
    path, before = new_folder(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    scratch(df.sparkSession)
    out = df.checkpoint(eager=True)
    collect_garbage(df.sparkSession)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Now and then: Spark removes shuffles, broadcasts and checkpoints that nothing refers to once the driver's heap is
    collected, and a heap with room to grow is not, while disk and the driver's memory fill."""
    now = time.monotonic()
    if now - collected[0] > PAUSE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        release()
        collected[0] = time.monotonic()
    if now - collected[1] > EXECUTORS_PAUSE and not re.match(r"local(\[|$)", spark.sparkContext.master):
        collect_executors(spark)
        collected[1] = time.monotonic()


def collect_executors(spark: SparkSession) -> None:
    """Between two steps the executors' heaps hold little that is in use, but what a step left there stays until a heap is
    full, beside the next step's Python workers. One short task for each executor collects it."""
    n = max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no later query reads."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the decimal text of ``key``, modulo ``modulus``; null keys give -1, which is no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def joined(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with ``table``, which has one row a key and in ``n`` how many of ``total`` rows hold it.

    Keys of more than one row in HOT are at most HOT: they are broadcast, so that no task gets all rows of one of them."""
    hot = F.col(n) * HOT > total
    often = table.where(hot)
    if not often.limit(1).count():
        return rows.join(table, key, how)
    rest = rows.join(F.broadcast(often.select(*key)), key, "left_anti").join(table.where(~hot), key, how)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def lowest_hashes(df: DataFrame, h: Column, most: int) -> DataFrame:
    """About ``most`` rows, those whose 64-bit hash is below a bound; ``df`` holds each key once."""
    share = min(1.0, most / max(df.count(), 1))
    return df.where(h.cast("double") <= -(2.0**63) + share * 2.0**64)


def range_cuts(df: DataFrame, key: str, shards: int, per_shard: int = 16) -> list[int]:
    """At most ``shards - 1`` ascending values of the integer column ``key`` that cut it into even ranges.

    They come from the distinct keys whose hash is lowest, so the same keys give the same cuts whatever the
    partitioning. The driver gets about ``shards * per_shard`` keys, MOST_CUTS times that at most."""
    shards = min(shards, MOST_CUTS)
    if shards < 2:
        return []
    keys = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    rows = sorted(r["k"] for r in lowest_hashes(keys, F.xxhash64("k"), shards * per_shard).collect())
    return sorted({rows[i * len(rows) // shards] for i in range(1, shards)}) if rows else []


def shard_of(key: Column, cuts: list[int]) -> Column:
    """The index of the range of ``cuts`` that holds ``key`` (null: 0), found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    pages = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    count = lambda values: F.size(F.filter(values, lambda c: c <= key))
    page = F.greatest(count(F.from_json(F.lit(str([p[0] for p in pages])), "array<long>")), F.lit(1))
    inner = F.element_at(F.from_json(F.lit(str(pages)), "array<array<long>>"), page)
    return F.coalesce((page - 1) * width + count(inner), F.lit(0))


def bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit for each key modulo ``bits``, a power of two from 2 ** 15: bits / 8 bytes however many keys there are."""
    at = F.col(key).bitwiseAND(bits - 1)
    rows = df.select(F.floor(at / PAGE).cast("int").alias("part"), (at % PAGE).alias("at")).repartition("part")
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[r["part"] * PAGE // 8 : (r["part"] + 1) * PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI on shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_session(spark: SparkSession) -> None:
    """Arrow batches of long texts hold 8 MB, unless the session says something else than Spark's 64."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(8 << 20))


def release() -> None:
    """Give memory that is free in this Python worker back to the machine."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches, column: int = 1, most: int = 2 << 20):
    """Slices of Arrow batches with at most ``most`` bytes of text each (one text may be longer)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    release()


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
