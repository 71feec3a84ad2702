import math

import numpy as np
import pytest

from quillspark.llm import negatives as N


def vectors(n=600, d=6, seed=0):
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(12, d))
    out = [(k, int(rng.integers(0, 4)), (near[k % 12] + rng.normal(size=d) * 0.15).astype(np.float32).tolist()) for k in range(n)]
    for k in range(150, 350):  # a hot vector of several labels
        out[k] = (k, k % 3, out[150][2])
    out[3], out[5], out[8] = (3, 0, None), (5, 0, [None] + [0.5] * (d - 1)), (8, None, out[8][2])
    out[9], out[11], out[400] = (9, 0, [math.inf] * d), (11, 0, [0.25, 0.5]), (400, 2, [0.0] * d)
    return out + [(20, 2, out[21][2]), (None, 1, out[21][2]), (-100, 1, out[150][2]), (700, 9, [1.0] * d), (800, 8, [0.5, 1.0])]


def brute(data, positives=5, negatives=5):
    use = {}
    for i, lab, v in data:
        if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v):
            row = ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(c))) for c in v])
            use[i] = min(use.get(i, row), row)
    out = []
    for a, (lab, v) in use.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in use.items() if i != a and len(w) == len(v)}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if use[i][0] == lab][:positives]:
            fit = [i for i in best if use[i][0] != lab and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:negatives])]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(i, lab, v, "x", 1) for i, lab, v in data], "vec_id long, label int, embedding array<float>, ids string, score int")


@pytest.mark.parametrize("shard,block,seed", [(8192, 512, 0), (50, 2, 0), (100, 3, 5)])
def test_equals_brute_force(spark, shard, block, seed):
    data = vectors(seed=seed)
    got = N.hard_negatives(frame(spark, data).repartition(4), shard=shard, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_small_tables(spark):
    assert N.hard_negatives(frame(spark, [])).collect() == []
    assert N.hard_negatives(frame(spark, [(0, 1, [1.0]), (1, 1, [1.0])])).collect() == []
    one = N.hard_negatives(frame(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [1.0]), (4, 3, [0.1])]))
    assert sorted(map(tuple, one.collect())) == [(100, 1, 1, 3, 65536, 65536), (100, 1, 2, 2, 65536, 58880)]


def grown(x, labels=None):
    order, parent, radius = N.cover_tree(x)
    labels = np.zeros(len(x), np.int64) if labels is None else labels
    return order, parent, N.CoverTree(x[order], labels[order], [np.array([i]) for i in order], parent, radius)


def test_tree():
    """Every row is below the root once, parents come first, and no row below a node is out of its covering radius."""
    rng = np.random.default_rng(2)
    for x in (rng.integers(-50, 50, (500, 4)), np.repeat(rng.integers(-5, 5, (20, 3)), 9, axis=0), np.array([[3, 4]]), rng.integers(-(1 << 22), 1 << 22, (60, 5))):
        order, parent, tree = grown(x)
        assert sorted(order) == list(range(len(x))) and parent[0] == -1 and (parent[1:] < np.arange(1, len(x))).all()
        y = N.augmented(x)[order]
        for at in range(1, len(x)):
            up = parent[at]
            while up >= 0:
                assert np.linalg.norm(y[at] - y[up]) <= tree.radius[up]
                up = parent[up]


def test_levels_cover_and_part():
    """Children of a node are apart, and a node's children lie within twice the distance that parts them."""
    x = np.random.default_rng(4).integers(-100, 100, (300, 3))
    order, parent, tree = grown(x)
    y = N.augmented(x)[order]
    kids = np.arange(tree.first[0], tree.last[0])
    gaps = N.distances(y[kids], y[kids]) + np.eye(len(kids)) * 1e9
    assert gaps.min() > 0


def test_descent_skips_and_is_exact():
    rng = np.random.default_rng(7)
    near = rng.integers(-300, 300, (20, 8))
    x = np.unique(near[rng.integers(0, 20, 4000)] + rng.integers(-12, 13, (4000, 8)), axis=0)
    labels = rng.integers(0, 5, len(x))
    order, _, tree = grown(x, labels)
    scored = []
    for q in x[rng.integers(0, len(x), 30)]:
        score = x @ q
        for same in (True, False):
            best = int(score.max())
            low, high = (np.array([-np.inf]), np.array([np.inf])) if same else (np.array([best * 0.8, best * 0.5]), np.array([best * 0.9, best * 0.52]))
            found, computed = N.descend(tree, q, 2, same, low, high, 5)
            scored.append(computed)
            for w in range(len(low)):
                fit = [(-int(score[i]), i) for i in range(len(x)) if (labels[i] == 2) == same and low[w] <= score[i] <= high[w]]
                assert [(a, b) for a, b, _ in found[w]] == sorted(fit)[:5]
    assert np.mean(scored) < 0.5 * len(x)
