"""Hard negatives by cover trees over norm-augmented candidates.

A component more, the root of (largest squared norm - own squared norm), puts all candidates on one sphere. Then the squared
distance of a query q (with a zero there) to a candidate x is |q|^2 + M - 2 q.x, so a ball of candidates with its
centre's score and covering radius bounds every inner product in it from both sides.

Candidates are classes of equal label and vector, dealt to shards. A shard's cover tree is made level by level: the centres
of a level lie farther apart than its covering distance, each lies within the covering distance of the level above of its
parent there, every centre is its own child, and the distance halves until all candidates are centres. A node keeps the largest
distance to anything below it. The tree's nodes are rows of a table, made once for all blocks of queries.

A search descends best first: the node with the highest upper bound is opened, its children's scores are computed whole,
and nodes outside every window, or below what all windows still need, are skipped. Positives are the window without bounds
on the anchor's own label; negatives have a window for each positive. Ties are kept open: a class of a
score that equals the last one is compared by its smallest id.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

EVERY, TOP, SCALE, SALTS = 100, 5, 256, 16
#: Classes of a shard and anchors of a block.
SHARD, ANCHORS = 8192, 512
#: Largest whole component for which inner products of 64 components are exact in doubles.
MOST = 1 << 23


def whole_rows(df: DataFrame, scale: int = SCALE, relabel: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v: floor(scale * component) of rows with an id, a label and a finite vector; of a repeated id the least row.

    Where ``relabel`` divides vec_id the label is (label + 1) % ``labels``. Components of 2 ** 23 and more after scaling
    take no part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size(x) > 0)
    fine &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / scale))
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    rows = df.where(fine).select(F.col("vec_id").cast("long"), label.alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def label_classes(rows: DataFrame, keep: int) -> DataFrame:
    """label, v, ids of each different (label, vector): its ``keep`` smallest ids. Rows of one vector are salted first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for by in (["label", "v", "salt"], ["label", "v"]):
        salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(f"r <= {keep}")
    return salted.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class CoverTree:
    """Candidates of one shard: x (whole), with children in runs, a covering radius each and the label and ids of each class."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: list[np.ndarray], parent: np.ndarray, radius: np.ndarray):
        #: Rows are in breadth-first order, so that a node's children are a run; the root is row 0.
        self.x, self.labels, self.ids, self.radius = x.astype(np.float64), labels, ids, radius
        self.least = np.array([i[0] for i in ids], np.int64)
        n = len(x)
        self.first = np.searchsorted(parent[1:], np.arange(n), "left") + 1
        self.last = np.searchsorted(parent[1:], np.arange(n), "right") + 1
        self.most = float((self.x * self.x).sum(1).max()) if n else 0.0


def augmented(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    size = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(size.max() - size)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0))


def cover_tree(x: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, radius): rows of ``x`` in breadth-first order, each one's parent as a place there (root: -1), and
    the largest distance, rounded up, from a node to any row below it."""
    y, n = augmented(x), len(x)
    if n == 1:
        return np.zeros(1, np.int64), np.full(1, -1), np.zeros(1)
    to = distances(y[:1], y)[0]
    reach = float(to.max())
    #: parent of every row that is a centre; rows that are none yet hang on their nearest centre met so far
    parent, level = np.full(n, -1), np.full(n, -1)
    level[0], depth = 0, 0
    nearest, gap = np.zeros(n, np.int64), to.copy()
    while (level < 0).any():
        depth, reach = depth + 1, reach / 2
        rest = np.flatnonzero(level < 0)
        if reach < 0.5:  # whole vectors that differ are 1 apart at least: these are equal ones of different labels
            parent[rest], level[rest] = nearest[rest], depth
            break
        above = nearest.copy()  # parents are centres of a level above
        new: list[int] = []
        for at in range(0, len(rest), block):
            rows = rest[at : at + block]
            if new:  # the new centres of earlier blocks
                d = distances(y[rows], y[new])
                best = d.argmin(1)
                better = d[np.arange(len(rows)), best] < gap[rows]
                gap[rows[better]], nearest[rows[better]] = d[np.arange(len(rows)), best][better], np.array(new)[best[better]]
            open_ = rows[gap[rows] > reach]
            if not len(open_):
                continue
            d, left = distances(y[open_], y[open_]), np.ones(len(open_), bool)
            for j in range(len(open_)):  # greedy: the first that is not covered yet becomes a centre
                if not left[j]:
                    continue
                new.append(int(open_[j]))
                closer = d[j] < gap[open_]
                gap[open_[closer]], nearest[open_[closer]] = d[j][closer], open_[j]
                left &= d[j] > reach
                left[j] = False
        if new:
            # rows of earlier blocks meet the centres of later ones, too, so that each hangs on its nearest
            made = np.array(new)
            for at in range(0, len(rest), block):
                rows = rest[at : at + block]
                d = distances(y[rows], y[made])
                best = d.argmin(1)
                value = d[np.arange(len(rows)), best]
                better = value < gap[rows]
                gap[rows[better]], nearest[rows[better]] = value[better], made[best[better]]
            level[made], parent[made] = depth, above[made]
            gap[made], nearest[made] = 0.0, made
    order, frontier = [np.array([0])], np.array([0])
    children = np.argsort(parent, kind="stable")
    starts = np.searchsorted(parent[children], np.arange(n), "left")
    ends = np.searchsorted(parent[children], np.arange(n), "right")
    while len(frontier):
        frontier = np.concatenate([children[starts[i] : ends[i]] for i in frontier])
        if len(frontier):
            order.append(frontier)
    order = np.concatenate(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    up = np.where(parent[order] < 0, -1, place[np.maximum(parent[order], 0)])
    radius = np.zeros(n)
    ancestor = up.copy()
    z = y[order]
    while (ancestor >= 0).any():  # every row to each of its ancestors
        rows = np.flatnonzero(ancestor >= 0)
        np.maximum.at(radius, ancestor[rows], np.sqrt(((z[rows] - z[ancestor[rows]]) ** 2).sum(1)))
        ancestor[rows] = up[ancestor[rows]]
    return order, up, radius * (1 + 1e-9) + 1e-6


def descend(tree: CoverTree, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """(for each window its k best (score, smallest id, row), score descending and ties by id; scores computed).

    A window takes classes of the query's own label if ``same``, else of the others, whose score is within [low, high]."""
    q = q.astype(np.float64)
    norm = float(q @ q) + tree.most
    found: list[list[tuple[int, int, int]]] = [[] for _ in low]
    need = low.astype(np.float64)  # what a class must reach to count in a window

    def meet(rows: np.ndarray, scores: np.ndarray) -> None:
        right = (tree.labels[rows] == label) == same
        for w in range(len(low)):
            at = np.flatnonzero(right & (scores >= need[w]) & (scores <= high[w]))
            if not len(at):
                continue
            if len(at) > k:  # all that tie with the k-th stay
                at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
            both = found[w] + [(-int(scores[i]), int(tree.least[rows[i]]), int(rows[i])) for i in at]
            found[w] = sorted(both)[:k]
            if len(found[w]) == k:
                need[w] = max(need[w], -found[w][-1][0])

    root = float(tree.x[0] @ q)
    meet(np.array([0]), np.array([root]))
    agenda, computed = [(-np.inf, 0, root, np.inf)], 1
    while agenda:
        bound, node, _, _ = heappop(agenda)
        if -bound < need.min(initial=np.inf):
            break  # no window needs what is left
        rows = np.arange(tree.first[node], tree.last[node])
        scores = tree.x[rows] @ q
        computed += len(rows)
        meet(rows, scores)
        inner = np.flatnonzero(tree.last[rows] > tree.first[rows])
        if not len(inner):
            continue
        away, r = np.sqrt(np.maximum(norm - 2 * scores[inner], 0)), tree.radius[rows[inner]]
        upper = (norm - np.maximum(away - r, 0) ** 2) / 2 + 1e-6 * norm
        lower = (norm - (away + r) ** 2) / 2 - 1e-6 * norm
        wanted = ((upper[:, None] >= need) & (lower[:, None] <= high)).any(1)
        for i in np.flatnonzero(wanted):
            heappush(agenda, (-upper[i], int(rows[inner[i]]), float(scores[inner[i]]), lower[i]))
    return found, computed


def forest(classes: DataFrame, shards: int) -> DataFrame:
    """d, s, at, parent, radius, label, v, ids: the cover trees of all shards, a node a row."""
    place = F.pmod(F.xxhash64("label", "v"), F.lit(shards)).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        order, parent, radius = cover_tree(np.stack(rows["v"].to_numpy()))
        rows = rows.iloc[order].reset_index(drop=True)
        return pd.DataFrame({"d": rows["d"], "s": rows["s"], "at": np.arange(len(rows)), "parent": parent, "radius": radius, "label": rows["label"], "v": rows["v"], "ids": rows["ids"]})

    rows = classes.select(F.size("v").alias("d"), place.alias("s"), "label", "v", "ids")
    return rows.groupBy("d", "s").applyInPandas(build, "d int, s int, at int, parent int, radius double, label long, v array<long>, ids array<long>")


def searched(trees: DataFrame, anchors: DataFrame, shards: int, blocks: int, same: bool, k: int) -> DataFrame:
    """anchor_id, window, vec_id, score: at most k of each shard for each window of ``anchors`` (anchor_id, label, v, windows)."""
    block = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")
    left = trees.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.select(F.size("v").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), block.alias("b"), "anchor_id", "label", "v", "low", "high")

    def search(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(queries):
            nodes = nodes.sort_values("at")
            ids = nodes["ids"].to_numpy()
            tree = CoverTree(np.stack(nodes["v"].to_numpy()), nodes["label"].to_numpy(), ids, nodes["parent"].to_numpy(), nodes["radius"].to_numpy())
            for anchor, label, q, low, high in zip(*(queries[c] for c in ("anchor_id", "label", "v", "low", "high")), strict=True):
                found, _ = descend(tree, np.asarray(q), label, same, np.asarray(low, np.float64), np.asarray(high, np.float64), k)
                for w, rows in enumerate(found):
                    best = sorted((s, int(i)) for s, _, at in rows for i in ids[at] if i != anchor)[:k]
                    out += [(anchor, w, i, -s) for s, i in best]
        return pd.DataFrame(out, columns=["anchor_id", "window", "vec_id", "score"])

    keys = ("d", "s", "b")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "anchor_id long, window int, vec_id long, score long")


def hard_negatives(df: DataFrame, positives: int = TOP, negatives: int = TOP, least: int = 80, most: int = 100, every: int = EVERY, shard: int = SHARD, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor (``every`` divides its vec_id) has its ``positives`` best other rows of its label; for each, the ``negatives`` best rows
    of other labels whose score is ``least`` to ``most`` per cent of the positive's. Rows with a null id, label, vector or component or
    a non-finite one take no part; vectors meet those of their own length; of a repeated vec_id the least (label, vector) counts; other
    columns are ignored; ties go to the smaller id; anchors or positives without a partner give no row, an empty table none."""
    rows = materialize(whole_rows(df), "rows")
    keep = max(positives, negatives) + 1  # one may be the anchor itself
    classes = materialize(label_classes(rows, keep), "classes")
    anchors = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    shards, blocks = max(1, -(-classes.count() // shard)), max(1, -(-anchors.count() // block))
    trees = materialize(forest(classes, shards), "trees")
    wide = lambda x: F.array(F.lit(x).cast("double"))
    ranked = lambda found, k, *by: found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(f"rank <= {k}")
    first = searched(trees, anchors.withColumn("low", wide("-inf")).withColumn("high", wide("inf")), shards, blocks, True, positives + 1)
    first = materialize(ranked(first.drop("window"), positives, "anchor_id").select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    ends = first.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("window", "positive_score"))), lambda p: p["positive_score"]).alias("p"))  # at most ``positives``
    # least * p <= 100 * n <= most * p in whole numbers
    ends = ends.select("anchor_id", F.transform("p", lambda p: F.ceil(p * least / 100).cast("double")).alias("low"), F.transform("p", lambda p: F.floor(p * most / 100).cast("double")).alias("high"))
    second = searched(trees, anchors.join(ends, "anchor_id"), shards, blocks, False, negatives)
    best = ranked(second, negatives, "anchor_id", "window")
    return best.join(first, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
