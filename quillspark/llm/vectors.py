"""Exact and approximate nearest neighbours of the vectors whose id is divisible by 50, among all others.

Both searches work on distinct vectors: equal vectors form one class that keeps its smallest ``k + 1`` ids, so a vector
that a third of all rows share is one candidate and one query. The ids come back at the end.

Exact top k: the classes lie in shards, and a shard has one sorted list for each component. A query reads its lists in step,
keeps a lower and an upper bound of every score, and drops rows whose upper bound is below the k-th lower bound. The lists
are read on until every row that is left has been met in all of them, which gives its score; no row is looked up. Shards'
results are merged.

Approximate: random projections are ordered along several shifted Hilbert curves by range partitions. A query meets the
``window`` classes on either side of its place on every curve; a pair is scored on the first curve that brings it
together, and what the curves find is merged and ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

EVERY = 50
SALTS = 16
#: Exact search: rows of a shard, queries of a block.
SHARD, QUERIES = 8192, 512
#: How deep the lists are read before the bounds are looked at, in sixteenths.
DEPTHS = (13, 15, 16)
#: Approximate search: curves, projected dimensions and bits of each; share of the classes on either side; rows of a block.
CURVES, DIMENSIONS, BITS, WINDOW, BLOCK = 12, 8, 6, 0.055, 4096
#: Classes on either side at least.
LEAST = 64


def usable(df: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, embedding (doubles) of rows that can take part. Of rows with the same vec_id one stands for all: the least array."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = df.where(fine).select(F.col("vec_id").cast("long"), x.alias("embedding"))
    if nonzero:
        out = out.where(F.exists("embedding", lambda v: v != 0))
    return out.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(c, vector, ids, asked) of each distinct vector, and (query_id, c) of each query. ids: its k + 1 smallest."""
    marked = materialize(rows.withColumn("c", F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))), "vectors")
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")
    asked = marked.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "c")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    least = marked.select("c", "vector", "vec_id", salt).withColumn("r", first("c", "salt")).where(f"r <= {k + 1}").withColumn("r", first("c")).where(f"r <= {k + 1}")
    grouped = least.groupBy("c").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    wanted = asked.select("c").distinct().withColumn("asked", F.lit(True))
    return materialize(grouped.join(wanted, "c", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "classes"), asked


def ranked(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Found (qc, ids, score) of classes to query_id, rank, vec_id, score: at most k, best first, ties to the smaller id."""
    by_class = Window.partitionBy("qc").orderBy(F.desc("score"), "vec_id")
    best = found.select("qc", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(by_class)).where(f"r <= {k + 1}")
    rows = asked.join(materialize(best.drop("r"), "best"), F.col("c") == F.col("qc")).where("query_id <> vec_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by_query)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(x.T, axis=1, kind="stable")
    return order, np.take_along_axis(x.T, order, 1).astype(np.float64)


def no_random_access(lists: tuple[np.ndarray, np.ndarray], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, depth read) of the k best integer inner products of ``q`` in a shard; rows of equal score are all found."""
    return next(read_lists(lists, q[None, :], k))


def read_lists(lists: tuple[np.ndarray, np.ndarray], queries: np.ndarray, k: int):
    """(rows, scores, depth read) of ``no_random_access`` for each query.

    Only the sorted lists are read, each from the ends that some query favours, in step and once for all queries. A row's
    lower bound takes the far end of every list in which it has not been met, its upper bound what that list has come down
    to; both are sums over what has been met, so the bounds of all queries are two matrix products."""
    order, value = lists
    d, n = order.shape
    positive, negative = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    ends = [(c, True) for c in range(d) if positive[:, c].any()] + [(c, False) for c in range(d) if negative[:, c].any()]
    if not ends:
        for _ in queries:
            yield np.arange(n), np.zeros(n, np.int64), 0
        return
    factor = np.stack([(positive if up else negative)[:, c] for c, up in ends], 1)
    # what is known of a row from each list and end: its value, or as long as it has not been met the far end
    known = np.tile([float(value[c, 0] if up else value[c, -1]) for c, up in ends], (n, 1))
    met, depth = np.zeros((n, len(ends)), bool), 0
    left = [None] * len(queries)
    done: list[tuple[np.ndarray, np.ndarray, int] | None] = [None] * len(queries)
    for part in DEPTHS:
        to = n if part == DEPTHS[-1] else max(depth, 1, n * part // 16)
        if to == depth:
            continue
        for j, (c, up) in enumerate(ends):
            span = slice(n - to, n - depth) if up else slice(depth, to)
            rows = order[c, span]
            known[rows, j] = value[c, span]
            met[rows, j] = True
        depth = to
        front = np.array([float(value[c, n - depth] if up else value[c, depth - 1]) for c, up in ends])
        first = left[0] is None and done[0] is None
        if first:
            all_lower, all_upper = factor @ known.T, factor @ np.where(met, known, front).T
        for i, f in enumerate(factor):
            if done[i] is not None:
                continue
            if first:
                at, lower, upper = np.arange(n), all_lower[i], all_upper[i]
            else:
                at = left[i]
                lower, upper = known[at] @ f, np.where(met[at], known[at], front) @ f
            keep = upper >= (np.partition(lower, -k)[-k] if len(at) >= k else -np.inf)
            at, lower = at[keep], lower[keep]
            left[i] = at
            if met[at][:, f != 0].all():
                done[i] = at, np.rint(lower).astype(np.int64), depth
        if all(x is not None for x in done):
            break
    yield from done


def exact_search(df: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(256 x) of every query with all other rows.

    Null, ragged and non-finite vectors: those with a null or non-finite component take no part, and vectors are compared
    with those of their own length. Scores are exact while they fit 53 bits. A repeated vec_id is one row (the
    least of its arrays); null ids take no part; other columns are ignored; an empty table gives no row."""
    rows = usable(df, False).select("vec_id", F.transform("embedding", lambda v: F.floor(v * 256).cast("long")).alias("vector"))
    all_, asked = classes(rows, k)
    n, m = all_.count(), all_.where("asked").count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    place = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "c"), F.lit(parts)).cast("int")
    size = F.size("vector").alias("d")
    left = all_.select(size, place("s", shards).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "c", "vector", "ids")
    right = all_.where("asked").select(size, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), place("b", blocks).alias("b"), F.col("c").alias("qc"), "vector")

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x = np.stack(rows["vector"].to_numpy()).astype(np.int64)
            lists, ids = sorted_lists(x), rows["ids"].to_numpy()
            found = read_lists(lists, np.stack(queries["vector"].to_numpy()).astype(np.int64), k + 1)
            for qc, (at, score, _) in zip(queries["qc"], found, strict=True):
                if len(at) > k + 1:
                    edge = np.partition(score, -(k + 1))[-(k + 1)]
                    keep = score >= edge
                    at, score = at[keep], score[keep]
                    if len(at) > k + 1:  # of equal scores those with the smallest ids
                        first = np.array([ids[a][0] for a in at])
                        keep = np.lexsort((first, -score))[: k + 1]
                        at, score = at[keep], score[keep]
                out += [(qc, ids[a], int(s)) for a, s in zip(at, score, strict=True)]
        return pd.DataFrame(out, columns=["qc", "ids", "score"])

    found = left.groupBy("d", "s", "b").cogroup(right.groupBy("d", "s", "b")).applyInPandas(search, "qc string, ids array<long>, score long")
    return ranked(found, asked, k)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of unsigned ``bits``-bit coordinates, by the transposed axes method."""
    x = points.T.astype(np.int64).copy()
    d, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(x: np.ndarray, curve: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Keys of the rows' directions on one curve: a random rotation and a random shift, the same for every vector of that length."""
    rng = np.random.default_rng([20240229, x.shape[1], curve])
    base = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0][:, :dimensions]
    shift = rng.random(base.shape[1])
    scale = np.abs(x).max(1, keepdims=True)  # no overflow of squares
    unit = x / scale
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    z = np.clip(unit @ base * (x.shape[1] ** 0.5 / 3.2), -1, 1)
    grid = ((z + 1) / 2 * 0.75 + shift * 0.25) * ((1 << bits) - 1)
    return hilbert(grid.astype(np.int64), bits)


def places(all_: DataFrame, curves: int) -> DataFrame:
    """c, d, ranks: the place of every class (c, vector) on each curve, among the classes of its length.

    Keys are range-partitioned; a partition's places follow from the counts of those before it."""

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = part.column(1).to_pylist()
                lengths = np.array([len(v) for v in vectors])
                for d in set(lengths.tolist()):
                    rows = np.flatnonzero(lengths == d)
                    x, mine = np.array([vectors[i] for i in rows], dtype=np.float64), part.column(0).take(pa.array(rows))
                    for curve in range(curves):
                        yield pa.RecordBatch.from_arrays([mine, pa.array(np.full(len(rows), d, np.int32)), pa.array(np.full(len(rows), curve, np.int32)), pa.array(curve_keys(x, curve))], ["c", "d", "curve", "key"])

    keys = all_.select("c", "vector").mapInArrow(index, "c string, d int, curve int, key long")
    order = ["d", "curve", "key", "c"]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.drop("key"), "curves")
    counts = ranged.groupBy("d", "curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # one row a partition, and one a curve
    before = Window.partitionBy("d", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("d", "curve", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked_ = ranged.join(F.broadcast(counts), ["d", "curve", "part"]).select("c", "d", "curve", (F.col("at") - F.col("first") + F.col("before")).alias("r"))
    return ranked_.groupBy("c", "d").agg(F.transform(F.sort_array(F.collect_list(F.struct("curve", "r"))), lambda x: x["r"]).alias("ranks"))


def window_scores(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> tuple[list[tuple], int]:
    """(qc, ids, score) of each query's k + 1 best in its window on this curve, and how many pairs were scored.

    A pair whose windows meet on an earlier curve has been scored there."""
    rows = rows.sort_values("r", ignore_index=True)
    at, curve = rows["r"].to_numpy(), int(rows["curve"].iloc[0])
    x, ranks, ids = np.stack(rows["vector"].to_numpy()), np.stack(rows["ranks"].to_numpy()), rows["ids"].to_numpy()
    x = x / np.abs(x).max(1, keepdims=True)
    nx, out, scored = np.sqrt((x * x).sum(1)), [], 0
    for qc, r, theirs, q, reach in zip(*(queries[c] for c in ("qc", "r", "ranks", "vector", "reach")), strict=True):
        low, high = np.searchsorted(at, r - reach, "left"), np.searchsorted(at, r + reach, "right")
        near = np.arange(low, high)
        if curve:
            near = near[(np.abs(ranks[low:high, :curve] - theirs[:curve]) > reach).all(1)]
        scored += len(near)
        if not len(near):
            continue
        q = q / np.abs(q).max()
        nq = np.sqrt((q * q).sum())
        rough = x[near] @ q / (nx[near] * nq)
        if len(near) > k + 1:
            near = near[rough >= np.partition(rough, -(k + 1))[-(k + 1)] - 1e-12]  # all that tie with the last
        score = (x[near] * q).sum(1) / (nx[near] * nq)
        if len(near) > k + 1:
            keep = np.lexsort((np.array([ids[i][0] for i in near]), -score))[: k + 1]
            near, score = near[keep], score[keep]
        out += [(qc, ids[i], s) for i, s in zip(near, score, strict=True)]
    return out, scored


def approximate_search(df: DataFrame, k: int = 5, curves: int = CURVES, window: float = WINDOW, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest cosines found for every query among all other rows.

    Every class is indexed on every curve. A query meets the share ``window`` of a curve, and ``least`` classes at least, on
    either side, so it finds ``k`` others wherever there are so many. Zero, null and non-finite vectors
    take no part; lengths, repeated and null ids, other columns and empty tables as in ``exact_search``."""
    all_, asked = classes(usable(df, True).withColumnRenamed("embedding", "vector"), k)
    ranks = materialize(places(all_, curves), "places")
    sizes = materialize(ranks.groupBy("d").count(), "lengths").select("d", F.greatest(F.ceil(F.col("count") * window), F.lit(max(least, k + 1))).alias("reach"))
    placed = materialize(all_.join(ranks, "c"), "placed").select("*", F.posexplode("ranks").alias("curve", "r"))
    left = placed.select("d", "curve", F.floor(F.col("r") / block).alias("block"), "r", "ranks", "vector", "ids")
    queries = placed.where("asked").withColumnRenamed("c", "qc").join(F.broadcast(sizes), "d")  # one row a length
    reached = F.sequence(F.floor(F.greatest(F.col("r") - F.col("reach"), F.lit(0)) / block), F.floor((F.col("r") + F.col("reach")) / block))
    right = queries.withColumn("block", F.explode(reached)).select("d", "curve", "block", "qc", "r", "ranks", "vector", "reach")
    right = right.toDF(*right.columns)

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = window_scores(rows, queries, k)[0] if len(rows) and len(queries) else []
        return pd.DataFrame(out, columns=["qc", "ids", "score"])

    found = left.groupBy("d", "curve", "block").cogroup(right.groupBy("d", "curve", "block")).applyInPandas(search, "qc string, ids array<long>, score double")
    return ranked(found, asked, k)


SQL_EXACT = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS i FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.i AS DOUBLE[]), CAST(c.i AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
