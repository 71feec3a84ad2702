import math

import numpy as np
import pytest

from quillspark.llm import vectors as V


def rows(n=600, d=12, seed=0):
    rng = np.random.default_rng(seed)
    out = [(k, rng.normal(size=d).astype(np.float32).tolist()) for k in range(n)]
    same = rng.normal(size=d).astype(np.float32).tolist()
    for k in range(100, 300):  # a hot vector
        out[k] = (k, same)
    out[50] = (50, None)
    out[150] = (150, [None] + [0.5] * (d - 1))
    out[200] = (200, [math.inf] + [0.5] * (d - 1))
    out[250] = (250, [math.nan] * d)
    out[400] = (400, [0.0] * d)
    out[450] = (450, [1.0, 2.0])
    out[451] = (451, [2.0, 1.0])
    return out + [(10, out[10][1]), (None, out[11][1])]


def brute(data, cosine, k=5):
    use = {}
    for i, v in data:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (not cosine or any(v)):
            v = [float(np.float32(x)) for x in v]
            use[i] = min(use.get(i, v), v)
    out = []
    for q in use:
        if q % 50:
            continue
        scored = []
        for i, v in use.items():
            if i != q and len(v) == len(use[q]):
                if cosine:
                    s = sum(a * b for a, b in zip(v, use[q], strict=True)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(a * a for a in use[q]))
                else:
                    s = sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, use[q], strict=True))
                scored.append((-round(s, 12), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("shard,block", [(8192, 512), (64, 3)])
def test_exact(spark, shard, block):
    data = rows()
    got = sorted(tuple(r) for r in V.exact_search(frame(spark, data), 5, shard, block).collect())
    assert got == brute(data, False)


class Counted(np.ndarray):
    """A table of lists that notes how deep it is read, and allows slices of one list from either end only."""

    def __getitem__(self, at):
        if isinstance(at, tuple) and isinstance(at[1], slice):
            assert np.isscalar(at[0])
            self.read.append((at[0], at[1].start, at[1].stop))
        else:
            assert isinstance(at, tuple) and np.isscalar(at[1])  # the ends, and what the lists have come down to
        return np.asarray(self)[at]


def test_reading_stops_early_and_exactly():
    """Lists are read in order only, once each; where some rows lead in all lists, the bounds end the reading."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (1 + 0.1 * rng.normal(size=(4000, 16))) * rng.gamma(0.5, size=(4000, 1))).astype(np.int64)
    order, value = V.sorted_lists(x)
    value = value.view(Counted)
    depths = []
    for q in [*x[:40], np.zeros(16, np.int64)]:
        value.read = []
        at, score, depth = V.no_random_access((order, value), q, 6)
        depths.append(depth)
        assert (np.sort(score)[-6:] == np.sort(x @ q)[-6:]).all()
        for j in range(16):
            spans = [(a, b) for i, a, b in value.read if i == j]
            forward, backward = sorted(spans), sorted(spans, reverse=True)
            assert spans in (forward, backward) and all(a[1] == b[0] for a, b in zip(forward, forward[1:], strict=False))
            assert sum(b - a for a, b in spans) in (0, depth)
    assert min(depths[:-1]) < 4000


def test_reading_a_few_rows():
    for n in range(1, 9):
        x = np.arange(n * 3).reshape(n, 3) % 5 - 2
        at, score, _ = V.no_random_access(V.sorted_lists(x), np.array([1, -2, 0]), 6)
        assert sorted(at.tolist()) == list(range(n)) or n > 6
        assert (score == x[at] @ np.array([1, -2, 0])).all()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 12, 30])
def test_approximate_gives_all_of_a_small_table(spark, n):
    data = [(50 * k, np.random.default_rng(k).normal(size=8).astype(np.float32).tolist()) for k in range(n)]
    got = sorted(tuple(r) for r in V.approximate_search(frame(spark, data), curves=3).collect())
    assert [r[:3] for r in got] == [r[:3] for r in brute(data, True)] and len(got) == n * min(5, n - 1)


def test_pairs_are_scored_once():
    """Over all curves a pair comes once, in the first window that holds it."""
    import pandas as pd

    rng = np.random.default_rng(2)
    x, n, reach = rng.normal(size=(300, 6)), 300, 25
    ranks = np.array([np.argsort(np.argsort(V.curve_keys(x, c), kind="stable"), kind="stable") for c in range(4)]).T
    scored = 0
    for c in range(4):
        rows_ = pd.DataFrame({"curve": c, "r": ranks[:, c], "ranks": list(ranks), "vector": list(x), "ids": [[k] for k in range(n)]})
        asked = pd.DataFrame({"qc": range(0, n, 50), "r": ranks[::50, c], "ranks": list(ranks[::50]), "vector": list(x[::50]), "reach": reach})
        scored += V.window_scores(rows_, asked, 5)[1]
    want = sum((np.abs(ranks - ranks[q]) <= reach).any(1).sum() for q in range(0, n, 50))
    assert scored == want


def test_approximate(spark):
    data = rows(2000, 16, 5)
    got = [tuple(r) for r in V.approximate_search(frame(spark, data)).collect()]
    want = brute(data, True)
    exact = {(q, i): s for q, _, i, s in brute(data, True, 2000)}
    assert all(abs(exact[q, i] - s) < 1e-9 for q, _, i, s in got)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    hot = [r for r in got if r[0] == 100]
    assert [r[2] for r in sorted(hot, key=lambda r: r[1])] == [101, 102, 103, 104, 105]
    assert [i for q, _, i, _ in got if q == 450] == [451]


def test_hilbert_is_a_path():
    """Neighbours on the curve differ by one in one coordinate."""
    side = 8
    points = np.array([[i, j, k] for i in range(side) for j in range(side) for k in range(side)])
    keys = V.hilbert(points, 3)
    path = points[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(side**3)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_empty(spark):
    for data in ([], [(50, None)], [(50, [1.0, 2.0])]):
        assert V.exact_search(frame(spark, data)).collect() == [] and V.approximate_search(frame(spark, data)).collect() == []


def test_lists_are_read_once_for_all_queries():
    """What a query finds does not depend on the queries beside it, and they share the reading of the lists."""
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (500, 16))
    order, value = V.sorted_lists(x)
    queries = np.concatenate([x[:30], np.zeros((1, 16), np.int64), rng.integers(0, 3, (5, 16))])
    value = value.view(Counted)
    value.read = []
    together = list(V.read_lists((order, value), queries, 6))
    assert len(value.read) <= 2 * 16 * len(V.DEPTHS)  # each end of a list in at most so many steps
    for q, (at, score, depth) in zip(queries, together, strict=True):
        alone = V.no_random_access(V.sorted_lists(x), q, 6)
        assert sorted(zip(at, score, strict=True)) == sorted(zip(*alone[:2], strict=True)) and (depth == alone[2] or not q.any())
        assert (score == x[at] @ q).all()
        assert (np.sort(score)[-6:] == np.sort(x @ q)[-6:]).all()
