"""The relational plane: versions, listings, differences, upserts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order``: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, deleted, changed or same, by key set and hash inequality."""
    o, n = old.select(key, F.col(value).alias("o"), F.lit(1).alias("in_old")), new.select(key, F.col(value).alias("n"), F.lit(1).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def reused(new: DataFrame, old: DataFrame, key: str, *rendered: str) -> DataFrame:
    """key, reused: whether a row of ``old`` has the same rendered strings, wherever it stands."""
    passage = F.sha2(F.to_json(F.struct(*rendered), {"ignoreNullFields": "false"}).cast("binary"), 256)
    have = old.select(passage.alias("_p")).distinct().withColumn("reused", F.lit(True))
    return new.withColumn("_p", passage).join(have, "_p", "left").select(key, F.coalesce("reused", F.lit(False)).alias("reused"))


def listing(libraries: DataFrame, documents: DataFrame) -> DataFrame:
    """Libraries with their documents counted: all, ready, removed ones too; libraries without any stay."""
    counts = documents.groupBy("library").agg(F.count("*").alias("document_count"), F.count_if("ready").alias("ready_count"))
    return libraries.where("active").join(counts, "library", "left").na.fill(0, ["document_count", "ready_count"])


def inventory_hash(files: DataFrame, name: str, digest: str, by: str) -> DataFrame:
    """One hash per group of its sorted files, as of one text: read as a stream in order, so that no group is held or has a limit.

    A hash of one text runs in sequence, so one task reads a group's names and digests; ``inventory_tree`` has no such task."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        group, state, n = None, None, 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], [by, "inventory", "files"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for g, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or g != group:
                    if state is not None:
                        yield make()
                    group, state, n = g, hashlib.sha256(), 0
                state.update((("\n" if n else "") + line).encode())
                n += 1
        if state is not None:
            yield make()

    rows = files.select(by, F.concat_ws(":", name, digest).alias("line")).repartition(by).sortWithinPartitions(by, "line")
    kind = files.schema[by].dataType.simpleString()
    return rows.mapInArrow(run, f"`{by}` {kind}, inventory string, files long")


#: Rows of a bucket of ``inventory_tree``, on average at most.
LEAF = 4096


def inventory_tree(files: DataFrame, name: str, digest: str, by: str) -> DataFrame:
    """One hash per group in levels: buckets of the names' hash, whose number grows with the group, halved in bits until one is left.

    Equal for the same files in any order; each array holds about LEAF lines or 256 digests, however large the group."""
    line = F.concat_ws(":", name, digest)
    rows = files.select(by, F.sha2(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 256).alias("key"), line.alias("line"))
    sizes = rows.groupBy(by).agg(F.count("*").alias("files"))
    largest = sizes.agg(F.max("files")).first()[0] or 0
    # hexadecimal digits of a bucket by its group's size, and digests in levels of two digits
    digits = sum((F.when(F.col("files") > LEAF * 16**i, 1).otherwise(0) for i in range(12)), F.lit(0))
    sizes = sizes.withColumn("digits", digits)
    same = F.col("s.by").eqNullSafe(F.col("r.by"))
    rows = rows.withColumnRenamed(by, "by").alias("r").join(F.broadcast(sizes.withColumnRenamed(by, "by")).alias("s"), same).select("r.by", "key", "line", "files", "digits")
    rows = rows.withColumn("bucket", F.expr("substr(key, 1, digits)"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    out = rows.groupBy("by", "files", "bucket").agg(joined("line").alias("d"))
    depth = 0
    while LEAF * 16**depth < largest:
        depth += 1
    for _ in range(-(-depth // 2)):
        out = out.withColumn("upper", F.expr("substr(bucket, 1, greatest(0, length(bucket) - 2))"))
        out = out.groupBy("by", "files", F.col("upper").alias("bucket")).agg(joined(F.concat_ws(":", "bucket", "d")).alias("d"))
    return out.select(F.col("by").alias(by), F.col("d").alias("inventory"), "files")


def grouped_split(df: DataFrame, group: str, shares: dict[str, float], seed: int, namespace: str) -> DataFrame:
    """group, split: groups in the order of a seeded hash, the first shares to their splits, the rest to ``train``. A null group is the last."""
    groups = df.select(group).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{namespace}:{seed}:"), F.col(group).cast("string")).cast("binary"), 256))
    # ranks by hash prefix: counts of the 4096 prefixes are small, and only rows of one prefix are sorted together
    groups = groups.withColumn("p", F.coalesce(F.substring("h", 1, 3), F.lit("none")))
    counts = groups.groupBy("p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).withColumn("total", F.sum("count").over(Window.partitionBy()))
    ranked = groups.join(F.broadcast(counts.drop("count")), "p").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("h", group)))
    split, edge = F.lit("train"), F.lit(0)
    cases = []
    for name, share in shares.items():
        edge = edge + F.greatest(F.lit(1), F.bround(F.col("total") * share).cast("long"))
        cases.append((name, edge))
    for name, limit in reversed(cases):
        split = F.when(F.col("rank") <= limit, name).otherwise(split)
    return ranked.select(group, split.alias("split"))


def nearest_rank(df: DataFrame, by: str, value: str, last: str, window: int, shares: dict[str, float]) -> DataFrame:
    """Count, mean, maximum and nearest-rank percentiles of the last ``window`` values of each key."""
    recent = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(last), F.desc(value)))).where(F.col("_r") <= window)
    rows = F.array_sort(F.collect_list(value))
    out = recent.groupBy(by).agg(rows.alias("v"))
    at = lambda share: F.element_at("v", F.greatest(F.lit(1), F.floor(F.size("v") * F.lit(share) + 0.999999)).cast("int"))
    return out.select(by, F.size("v").alias("n"), *[at(s).alias(name) for name, s in shares.items()], F.array_max("v").alias("top"), (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"))
