"""Toxicity by a classifier chain of logistic models on hashed words and word beginnings.

The categories are predicted in order. The model of a category also takes the probabilities of the categories before it: in
training those that models of the other folds gave a row (so that no row's own label reaches them), in scoring those of the
models fitted on all folds. The folds of a category are fitted side by side, one Spark task each.

The fits see about ``most`` labelled documents at most, picked by the hash of their doc_id, one text each; their features are
made once, in parallel, and written down as sparse rows. Every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, crc_mod, materialize, release, text_slices
from .linear import Rows, Sparse, Words, featured, logistic, matrix, memo, one_text, sigmoid
from .quality import sampled

MOST = 6000
FOLDS = 3
BITS = 18
RIDGE = 3e-4
#: The chain over the columns of ``labels``: toxic language in prose of quality first, then toxic language anywhere.
CATEGORIES = {"toxic_prose": "quality = 1 AND toxic = 1", "toxic": "toxic = 1"}
THRESHOLD = 0.5


def affix_words() -> Words:
    return memo("affixes", BITS)


def scale(sizes: np.ndarray) -> np.ndarray:
    return 3 / np.sqrt(np.maximum(sizes, 30))


def features(texts: list[bytes]) -> tuple[Sparse, np.ndarray]:
    words = affix_words()
    codes, sizes = words.of(texts)
    doc, feature, n = matrix(words.rows, codes, sizes, BITS)
    return Sparse(doc, feature, n * scale(sizes)[doc], len(sizes), 1 << BITS), np.zeros((len(sizes), 0))


def fitting(k: int, folds: int):
    """Fits category ``k`` on all folds but that of the group's part (part ``folds``: on all)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = int(group["part"].iloc[0])
        group = group.sort_values("doc_id", ignore_index=True)
        extra, fitted, width = group[[f"p{j}" for j in range(k)]].to_numpy(float), (group["fold"] != g).to_numpy(), 1 << BITS
        rows = lambda use: Rows.of(group["ids"][use], group["values"][use], width)
        w = np.zeros(width + k + 1)
        if fitted.any():
            w = logistic(rows(fitted), extra[fitted], group[f"y{k}"].to_numpy(float)[fitted], RIDGE, 150, fixed=True)
        release()
        if g == folds:
            return pd.DataFrame({"doc_id": [0], "p": [0.0], "w": [w.astype("<f4").tobytes()]})
        odds = rows(~fitted).dot(w[:width]) + extra[~fitted] @ w[width:-1] + w[-1]
        return pd.DataFrame({"doc_id": group["doc_id"][~fitted], "p": sigmoid(odds), "w": None})

    return run


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str | Column], fold: int = 5, held: int = 0, most: int = MOST, folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector a category: features, probabilities of earlier categories, constant. No labelled row: zeros.

    A null label is no; a document with several texts is learnt from the least of them."""
    known = [F.coalesce((F.expr(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)).alias(f"y{k}") for k, c in enumerate(categories.values())]
    marked = labels.where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held)).select(F.col("doc_id").cast("long"), *known)
    ys = [f"y{k}" for k in range(len(categories))]
    marked = sampled(marked.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys]), most, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = one_text(texts.join(F.broadcast(marked), "doc_id"), *ys)  # about ``most`` ids
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int"))
    sample = featured(rows, features, ["doc_id", "fold", *ys], "toxicity-sample")
    weights, guesses = [], None
    for k in range(len(categories)):
        now = sample if guesses is None else sample.join(F.broadcast(guesses), "doc_id")  # a few numbers for each sampled document
        parts = now.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        got = materialize(parts.groupBy("part").applyInPandas(fitting(k, folds), "doc_id long, p double, w binary"), "chain")
        last = got.where("w IS NOT NULL").first()
        weights.append(np.frombuffer(last["w"], "<f4").astype(float) if last else np.zeros((1 << BITS) + k + 1))
        out = got.where("w IS NULL").select("doc_id", F.col("p").alias(f"p{k}"))
        guesses = out if guesses is None else guesses.join(out, "doc_id")
    return weights


def score(docs: DataFrame, weights: list[np.ndarray], names: list[str]) -> DataFrame:
    """All columns of ``docs`` and a probability for each category (in place of columns of their names); null text is empty."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    width, at = 1 << BITS, docs.columns.index("text")

    def run(batches):
        words, weights = affix_words(), shared.value
        tables = np.zeros((len(weights), width))
        for k, w in enumerate(weights):
            tables[k, 1:] = w[1:width]
        for part in text_slices(batches, at, 4 << 20):
            codes, sizes = words.of(as_bytes(part.column(at)))
            used, back = np.unique(codes, return_inverse=True)
            of, chances = np.repeat(np.arange(len(sizes)), sizes), []
            for w, table in zip(weights, tables, strict=True):
                each = table[words.rows[used]].sum(1) if len(used) else np.zeros(0)
                o = np.bincount(of, each[back], len(sizes)) * scale(sizes) + w[-1]
                for j, earlier in enumerate(chances):
                    o = o + w[width + j] * earlier
                chances.append(sigmoid(o))
            for name, p in zip(names, chances, strict=True):
                part = part.append_column(name, pa.array(p))
            yield part

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str | Column] = CATEGORIES, fold: int = 5, held: int = 0, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """doc_id, held_out, a probability for each category (``p_`` and its name), and predicted for the last one.

    Models learn from rows whose crc32(doc_id) modulo ``fold`` is not ``held``. Repeated rows score alike, null and empty
    texts are scored by the share of each category in the labels alone, texts of any length whole, a null doc_id is not held out and not learnt from,
    a probability at the threshold is not predicted, other columns are ignored; an empty table gives no row, and without
    labels every probability is 0.5 and nothing is predicted toxic."""
    weights = train(docs, labels, categories, fold, held, **settings)
    names = [f"p_{c}" for c in categories]
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), weights, names)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"), *names, (F.col(names[-1]) > threshold).cast("int").alias("predicted"))
