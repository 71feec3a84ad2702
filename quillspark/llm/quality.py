"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1, unlabelled text is the corpus itself. A linear model on hashed word shapes
and repetition measures minimises the non-negative unbiased risk: the unlabelled risk of the negative class less what the
class prior says of it is positive, kept from falling below zero. The prior is estimated from the same sample.

The fit sees about ``most`` documents of each kind at most, picked by the hash of their doc_id, one text each; their features
are made in parallel and written down as sparse rows. Every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, materialize, release, text_slices
from .linear import Rows, Sparse, Words, descend, featured, logistic, matrix, memo, one_text, sigmoid

#: Rows of each kind in the fit, on average.
MOST = 8000
BITS = 12
DENSE = 5
THRESHOLD = 0.3


def shape_words() -> Words:
    return memo("shapes", BITS, 64)


def features(texts: list[bytes]) -> tuple[Sparse, np.ndarray]:
    """Square roots of shape frequencies; shares of words that repeat the last or last but one or any, log length, no words."""
    words = shape_words()
    codes, sizes = words.of(texts)
    doc, feature, n = matrix(words.rows, codes, sizes, BITS)
    length, of = np.maximum(sizes, 1), np.repeat(np.arange(len(sizes)), sizes)
    shares = []
    for back in (1, 2):
        same = np.zeros(len(codes))
        same[back:] = (codes[back:] == codes[:-back]) & (of[back:] == of[:-back])
        shares.append(np.bincount(of, same, len(sizes)) / length)
    distinct = np.bincount(np.unique((of << 32) | codes) >> 32, minlength=len(sizes)) if len(codes) else np.zeros(len(sizes))
    dense = np.column_stack([*shares, np.where(sizes > 0, 1 - distinct / length, 0), np.log1p(sizes) / 10, sizes == 0])
    return Sparse(doc, feature, 10 / 3 * np.sqrt(n / length[doc]), len(sizes), 1 << BITS), dense


def logits(x: Sparse | Rows, dense: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.dot(w[: x.width]) + dense @ w[x.width : -1] + w[-1]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the unlabelled and the positive share above a threshold: where no negative is left, it is the prior.

    Both shares are taken at the far end of two standard errors: a prior that is too high would call negatives
    positive, one that is a little low costs nothing."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0, 0.5, 51))
    share = {k: 1 - np.searchsorted(np.sort(s), cuts) / len(s) for k, s in (("u", unlabelled), ("p", positive))}
    error = {k: 2 * np.sqrt(a * (1 - a) / n) for (k, a), n in zip(share.items(), (len(unlabelled), len(positive)), strict=True)}
    return float(np.clip(((share["u"] - error["u"]) / (share["p"] + error["p"])).min(), 0.05, 0.95))


def fit(x: Rows, dense: np.ndarray, positive: np.ndarray, ridge: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights (features, dense, constant) and the prior. Without positives or unlabelled rows: zeros, every score is 0.5."""
    if not positive.any() or positive.all():
        return np.zeros(x.width + DENSE + 1), 0.5
    half = np.arange(x.n) % 2 == 0
    w = logistic(x.take(half), dense[half], positive[half].astype(float), 1e-3, 120)
    s = logits(x.take(~half), dense[~half], w)
    prior = class_prior(s[positive[~half]], s[~positive[~half]])
    xp, xu = x.take(positive), x.take(~positive)
    dp, du = (np.column_stack([dense[k], np.ones(k.sum())]) for k in (positive, ~positive))

    def gradient(w):
        return risk_gradient(w, xp, dp, xu, du, prior) + ridge * w

    return descend(gradient, x.width + DENSE + 1, steps, 0.05), prior


def risk_gradient(w: np.ndarray, xp: Rows, dp: np.ndarray, xu: Rows, du: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the risk: the positives' cost, and what the unlabelled rows cost as negatives less the prior's share of it."""
    gp, gu = sigmoid(xp.dot(w[: xp.width]) + dp @ w[xp.width :]), sigmoid(xu.dot(w[: xp.width]) + du @ w[xp.width :])
    negative = prior * np.log(1 - gp + 1e-9).mean() - np.log(1 - gu + 1e-9).mean()
    if negative >= 0:
        a, b = prior * (gp - 1 - gp) / xp.n, gu / xu.n
    else:  # the negative class's risk has been fitted away: step back up
        a, b = prior * gp / xp.n, -gu / xu.n
    return np.concatenate([xp.back(a) + xu.back(b), a @ dp + b @ du])


def sampled(df: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` documents at most, those whose doc_id's hash is low."""
    share = min(1.0, most / max(df.count(), 1))
    return df.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, most: int = MOST) -> tuple[np.ndarray, float]:
    """Fit on rows whose crc32(doc_id) modulo ``fold`` is not ``held``; labels without a text and null labels are left out."""
    open_ = lambda df: df.where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held))
    trusted = sampled(open_(labels.where("quality = 1").select(F.col("doc_id").cast("long"))).distinct(), most, "trusted")
    texts = open_(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    positive = one_text(texts.join(F.broadcast(trusted), "doc_id"))  # about ``most`` ids
    some = one_text(sampled(texts, most, "unlabelled"))
    rows = some.select("text", "doc_id", F.lit(False).alias("positive")).unionByName(positive.select("text", "doc_id", F.lit(True).alias("positive")))
    sample = featured(rows.withColumn("place", F.xxhash64("doc_id", "positive")), features, ["place", "positive"], "quality-sample")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", ignore_index=True)
        dense = np.frombuffer(b"".join(rows["dense"]), "<f8").reshape(len(rows), DENSE)
        w, prior = fit(Rows.of(rows["ids"], rows["values"], 1 << BITS), dense, rows["positive"].to_numpy(bool))
        release()
        return pd.DataFrame({"w": [w.tolist()], "prior": [prior]})

    found = sample.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(run, "w array<double>, prior double").first()
    return (np.array(found["w"]), found["prior"]) if found else (np.zeros((1 << BITS) + DENSE + 1), 0.5)


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and ``score`` (in place of one of that name), the probability of quality 1; null text is empty."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(w)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for part in text_slices(batches, at, 2 << 20):
            yield part.append_column("score", pa.array(sigmoid(logits(*features(as_bytes(part.column(at))), shared.value))))

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; repeated rows score alike, other columns are ignored.

    No label, language, source or id is an input of a score. A null doc_id is not held out and not learnt from; null text is
    empty, and an empty text has a score of its own from a feature that says so; texts of any length are scored whole; a
    score at the threshold is predicted 1; an empty table gives no row, and without labels every score is 0.5."""
    w, _ = train(docs, labels, fold, held, **settings)
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), w)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
