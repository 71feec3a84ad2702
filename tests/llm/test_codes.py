import hashlib
import math

import numpy as np
import pytest

from quillspark.llm import codes as C


def vectors(n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(6, d)) * 2
    out = [(k, int(k % 3), (near[k % 6] + rng.normal(size=d) * 0.1).astype(np.float32).tolist()) for k in range(n)]
    for k in range(100, 240):  # a hot vector
        out[k] = (k, None if k % 2 else 1, out[100][2])
    out[3], out[5], out[7] = (3, 0, None), (5, 0, [None] + [0.5] * (d - 1)), (7, 0, [math.nan] * d)
    out[9], out[11] = (9, 0, [math.inf] * d), (11, 0, [0.25] * (d - 1))
    return out + [(20, 2, out[20][2]), (None, 1, out[21][2]), (-4, 1, [0.0] * d)]


def plain(data, parts, entries, rounds):
    """All distances, in Python's whole numbers."""
    kept = [(i, lab, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, lab, v in data if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for *_, v in kept)
    kept = [r for r in kept if len(r[2]) == d]
    w = d // parts
    start = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))[:entries]
    books = [[r[2][k * w : (k + 1) * w] for r in start] for k in range(parts)]

    def assigned(v):
        out = []
        for k in range(parts):
            p = v[k * w : (k + 1) * w]
            out.append(min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(books[k])))
        return out

    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            for k, (_, j) in enumerate(assigned(v)):
                groups.setdefault((k, j), []).append(v[k * w : (k + 1) * w])
        for (k, j), g in groups.items():
            books[k][j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    rows, labels = [], {}
    for i, lab, v in kept:
        a = assigned(v)
        error = sum(x for x, _ in a)
        labels[lab] = labels.get(lab, 0) + error
        rows.append((i, lab, "".join(f"{j:02x}" for _, j in a), error))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab], sha) for i, lab, c, e in rows), key=str)


def frame(spark, data):
    return spark.createDataFrame([(i, lab, v, "x", 1) for i, lab, v in data], "vec_id long, label int, embedding array<float>, code string, error int")


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 4), (2, 40, 3), (1, 256, 2)])
def test_report_equals_all_distances(spark, parts, entries, rounds):
    data = vectors()
    got = C.code_report(frame(spark, data).repartition(5), parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(data, parts, entries, rounds)


def test_balls_skip_work(spark):
    """On clustered vectors the rounds after the first compute far fewer than all distances, and codes stay exact."""
    coded, _ = C.ball_codes(frame(spark, vectors(2000)), 2, 64, 4)
    rows = coded.count()
    assert coded.agg({"work": "sum"}).first()[0] < 0.5 * rows * 2 * 64


def test_rings_are_exact():
    rng = np.random.default_rng(3)
    for low, high in ((-3, 4), (-1000, 1000), (-(1 << 26), 1 << 26)):
        books, x = rng.integers(low, high, (30, 5)), rng.integers(low, high, (500, 5))
        books[7] = books[3]  # of equal entries the lower index counts
        code, own, _ = C.Balls(books).assign(x, None, None)
        step = rng.integers(-2, 3, books.shape) * (rng.random(30) < 0.3)[:, None]
        fresh = books + step
        size = np.sqrt((step**2).sum(1))
        radius = np.array([own[code == i].max(initial=0) ** 0.5 for i in range(30)]) + size
        after = C.Balls(fresh, size > 0, radius * (1 + 1e-9)).assign(x, code, own)
        want = C.Balls(fresh).assign(x, None, None)
        assert (after[0] == want[0]).all() and (after[1] == want[1]).all()
        exact = [min((sum(int(a - b) ** 2 for a, b in zip(r, e, strict=True)), j) for j, e in enumerate(fresh)) for r in x[:40]]
        assert [(int(d), int(c)) for d, c in zip(want[1], want[0], strict=False)][:40] == exact


def test_small_tables(spark):
    assert C.code_report(frame(spark, [])).collect() == []
    assert C.code_report(frame(spark, [(1, 1, None)])).collect() == []
    one = C.code_report(frame(spark, [(1, None, [0.5, -0.5])]), parts=2).collect()
    assert [tuple(r) for r in one] == [(1, "0000", 0, 0, hashlib.sha256(b"512,-512").hexdigest())]
    assert {r["code"] for r in C.code_report(frame(spark, [(None, 1, [0.5, 1.0]), (None, 2, [0.5, 1.0])]), parts=2).collect()} == {"0000"}
