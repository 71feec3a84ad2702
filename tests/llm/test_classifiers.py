import random
import zlib

import numpy as np

from quillspark.llm import quality as Q
from quillspark.llm import toxicity as X
from quillspark.llm.linear import Rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=700, seed=1):
    """(doc_id, text, quality, toxic): junk has marks behind its words, toxic texts an insult now and then."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "an"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 80))]
        low, toxic = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["scum", "moron", "idiot"])
        if low:
            words = [w + rng.choice(["%%%", "###"]) for w in words]
        out.append((k, " ".join(words), int(not low), int(toxic)))
    return out


EDGES = [(5000, None), (5001, ""), (5002, " \n"), (None, "ka lo mi"), (5003, "mi " * 60_000), (3, "ka lo"), (3, "ka lo")]


def frames(spark, data, labelled=500):
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, *_ in data] + [(i, t, 0.5, "x") for i, t in EDGES], "doc_id long, text string, score double, p_toxic string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data[:labelled]] + [(None, 1, 1), (9999, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(got, data, column):
    truth = {r[0]: r[column] for r in data}
    rows = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    return len(rows), sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_quality(spark):
    data = corpus()
    docs, labels = frames(spark, data)
    got = Q.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    n, right = accuracy(got, data, 2)
    assert n > 80 and right > 0.9
    again = {r["doc_id"]: r["score"] for r in Q.classify(docs, labels).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] != 3)


def test_quality_learns_no_held_out_label(spark):
    data = corpus(200)
    docs, labels = frames(spark, data)
    flipped = spark.createDataFrame([(i, 1 - q if held(i) else q, t) for i, _, q, t in data], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id long, quality int, toxic int")
    a, b = (sorted(((r["doc_id"] or -1, r["score"]) for r in Q.classify(docs, x).collect())) for x in (plain, flipped))
    assert a == b


def test_risk_is_kept_from_falling_below_zero():
    """With a prior far too high the plain unbiased risk would call everything positive; scores stay spread."""
    data = corpus(600)
    texts = [t.encode() for _, t, *_ in data] + [t.encode() for _, t, q, _ in data if q]
    positive = np.array([False] * len(data) + [True] * (len(texts) - len(data)))
    order = np.random.default_rng(0).permutation(len(texts))
    x, dense = Q.features([texts[k] for k in order])
    w, prior = Q.fit(Rows.of(*x.packed(), x.width), dense, positive[order])
    s = Q.sigmoid(Q.logits(*Q.features([t.encode() for _, t, *_ in data]), w))
    truth = np.array([q for _, _, q, _ in data])
    assert 0.65 < prior < 0.9 and s[truth == 1].mean() > 0.7 > 0.3 > s[truth == 0].mean()


def test_toxicity(spark):
    data = corpus()
    docs, labels = frames(spark, data)
    got = X.classify(docs, labels).collect()
    assert len(got) == docs.count() and set(got[0].asDict()) == {"doc_id", "held_out", "p_toxic_prose", "p_toxic", "predicted"}
    n, right = accuracy(got, data, 3)
    assert n > 80 and right > 0.9
    assert {r["predicted"] for r in got if r["doc_id"] in (5000, 5001, 5002)} == {0}


def test_chain_uses_earlier_categories(spark):
    """The second label repeats the first: its model leans on the first one's probability."""
    data = corpus(400)
    docs, _ = frames(spark, data)
    labels = spark.createDataFrame([(i, t) for i, _, _, t in data], "doc_id long, toxic int")
    weights = X.train(docs, labels, {"first": "toxic = 1", "second": "toxic = 1"})
    assert len(weights[0]) == (1 << X.BITS) + 1 and len(weights[1]) == (1 << X.BITS) + 2 and weights[1][1 << X.BITS] > 0.1


def test_without_labels_or_documents(spark):
    docs, labels = frames(spark, corpus(30))
    none = labels.limit(0)
    assert {r["score"] for r in Q.classify(docs, none).collect()} == {0.5}
    assert {(r["p_toxic"], r["predicted"]) for r in X.classify(docs, none).collect()} == {(0.5, 0)}
    assert Q.classify(docs.limit(0), labels).collect() == [] and X.classify(docs.limit(0), labels).collect() == []


def dense_rows(x):
    out = np.zeros((x.n, x.width))
    for doc, feature, value in zip(x.doc, x.feature, x.value, strict=True):
        out[doc, feature] += np.float32(value)
    return out


def test_risk_gradient_is_that_of_the_plain_risk():
    """Against finite differences of the non-negative risk, written out in plain loops."""
    data = corpus(40, 3)
    x, dense = Q.features([t.encode() for _, t, *_ in data])
    rows, full = Rows.of(*x.packed(), x.width), dense_rows(x)
    positive = np.array([bool(q) for _, _, q, _ in data])
    both = [np.column_stack([dense[k], np.ones(k.sum())]) for k in (positive, ~positive)]
    rng = np.random.default_rng(0)
    w = rng.normal(size=x.width + Q.DENSE + 1) * 0.1

    def risk(w, prior):
        def mean(k, cost):
            return sum(cost(full[i] @ w[: x.width] + np.append(dense[i], 1) @ w[x.width :]) for i in np.flatnonzero(k)) / k.sum()

        as_negative = mean(~positive, lambda s: np.log1p(np.exp(s))) - prior * mean(positive, lambda s: np.log1p(np.exp(s)))
        return prior * mean(positive, lambda s: np.log1p(np.exp(-s))) + as_negative if as_negative >= 0 else -as_negative

    for prior in (0.3, 3.0):  # the second makes the negative class's risk fall below zero
        g = Q.risk_gradient(w, rows.take(positive), both[0], rows.take(~positive), both[1], prior)
        for at in [*rng.choice(np.flatnonzero(full.any(0)), 8), x.width, x.width + Q.DENSE]:
            step = np.zeros(len(w))
            step[at] = 1e-5
            assert abs((risk(w + step, prior) - risk(w - step, prior)) / 2e-5 - g[at]) < 1e-5


def test_chain_equals_plain_loops(spark):
    """The chain's weights against logistic fits fold by fold on dense rows."""
    data = corpus(120, 8)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id long, quality int, toxic int")
    names = ["toxic = 1", "quality = 0"]
    got = X.train(docs, labels, dict(zip("ab", names, strict=True)), folds=3)
    from pyspark.sql import functions as F

    mine = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).alias("fold")).orderBy("doc_id").collect()
    mine = [r for r in mine if not held(r["doc_id"])]
    truth = {i: (t, int(q == 0)) for i, _, q, t in data}
    x, _ = X.features([r["text"].encode() for r in mine])
    used = np.unique(x.feature)
    full = dense_rows(x)[:, used]
    fold = np.array([r["fold"] for r in mine])
    extra = np.zeros((len(mine), 0))
    for k in range(2):
        y = np.array([truth[r["doc_id"]][k] for r in mine], float)

        def fit(rows, k=k, y=y):
            """Adam on the mean log loss of dense rows."""
            a = np.column_stack([full[rows], extra[rows], np.ones(rows.sum())])
            w, m, v = (np.zeros(a.shape[1]) for _ in range(3))
            w[-1] = np.log((y[rows].sum() + 0.5) / (rows.sum() - y[rows].sum() + 0.5))
            for t in range(1, 151):
                g = a.T @ (1 / (1 + np.exp(-(a @ w))) - y[rows]) / rows.sum() + X.RIDGE * w
                g[-1] = 0
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                w = w - 0.1 * (1 - t / 151) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            return w

        w, width = fit(np.ones(len(mine), bool)), 1 << X.BITS
        assert np.abs(np.concatenate([got[k][used], got[k][width:]]) - w).max() < 1e-3
        out_of_fold = np.zeros(len(mine))
        for f in range(3):
            v = fit(fold != f)
            a = np.column_stack([full, extra, np.ones(len(mine))])
            out_of_fold[fold == f] = (1 / (1 + np.exp(-(a @ v))))[fold == f]
        extra = np.column_stack([extra, out_of_fold])


def test_long_runs_count_whole():
    """A text without white space has a score of its whole length, not of its first 64 characters."""
    a, _ = Q.features([b"a" * 640])
    b, _ = Q.features([b"a" * 64 + b"9#" * 288])
    assert set(b.feature.tolist()) > set(a.feature.tolist())


def test_repeated_documents_do_not_swell_the_sample(spark):
    """One text of a doc_id is learnt from, however often the table holds it."""
    data = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id long, quality int, toxic int")
    again = docs.unionByName(docs.where("doc_id = 7").crossJoin(spark.range(300).select()))
    score = lambda d, f: {r["doc_id"]: r[-2] for r in f(d, labels).collect()}
    assert score(docs, X.classify) == score(again, X.classify)
