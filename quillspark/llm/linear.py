"""Hashed linear features of whole texts and the logistic models on them, for the text classifiers."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, materialize, text_slices

MEMO = 300_000
#: Values of a block in the fits.
BLOCK = 1 << 18


@lru_cache(maxsize=1)
def memo(kind: str, bits: int, piece: int | None = None) -> Words:
    """The words that this Python worker has met, of one kind of features at a time."""
    return Words(*{"affixes": affixes, "shapes": shapes}[kind](bits), piece=piece)


class Words(dict):
    """Word to its row of feature ids, in bounded memory. Words of over ``piece`` bytes count as several, one a piece."""

    def __init__(self, features, width: int, piece: int | None = None):
        self.features, self.rows, self.piece = features, np.zeros((1024, width), np.int32), piece

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.features(word)
        self[word] = at
        return at

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words, and the number of words of each text. Case is kept."""
        if len(self) > MEMO:
            self.clear()
        get, out, sizes = self.__getitem__, [], []
        for text in texts:
            words = text.split()
            if self.piece and len(text) > self.piece and max(map(len, words), default=0) > self.piece:
                words = [w[k : k + self.piece] for w in words for k in range(0, len(w), self.piece)]
            out.extend(map(get, words))
            sizes.append(len(words))
        return np.array(out, np.int64), np.array(sizes, np.int64)


MARKS = b".,!?;:|%$#*&\"'()[]{}-_/<>=+~`@^"


def affixes(bits: int, lengths: tuple[int, ...] = (3, 4, 5, 6, 7)):
    """A word without case and outer marks, and its first 3 to 7 characters, each hashed into ``2 ** bits`` places.

    Place 0 is kept for prefixes of words that are no longer."""
    mask = (1 << bits) - 1

    def features(word: bytes) -> list[int]:
        bare = word.decode("utf-8", "replace").lower().strip(MARKS.decode())
        out = [zlib.crc32(bare.encode()) & mask or 1]
        return out + [(zlib.crc32(bare[:n].encode(), n) & mask or 1) if len(bare) > n else 0 for n in lengths]

    return features, 1 + len(lengths)


_RUNS = re.compile(r"(.)\1+")
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def shapes(bits: int):
    """The shape of a word: runs of small letters, capitals and digits as a, A and 0, other runs as one mark; and its length."""
    mask = (1 << bits) - 1

    def features(word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        shape = _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", text)))
        marks = _RUNS.sub(r"\1", re.sub(r"[aA0]", "", shape))
        return [zlib.crc32(_RUNS.sub(r"\1", shape).encode()) & mask or 1, zlib.crc32(marks.encode(), 1) & mask or 1 if marks else 0, zlib.crc32(b"%d" % min(len(text), 40), 2) & mask or 1]

    return features, 3


def matrix(rows: np.ndarray, words: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts (document, feature, count) of the words' features; feature 0 is left out."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pair, n = np.unique((doc << 32) | words, return_counts=True)
    ids = rows[pair & 0xFFFFFFFF]
    key = (((pair >> 32)[:, None] << bits) | ids).ravel()
    use = ids.ravel() > 0
    key, at = np.unique(key[use], return_inverse=True)
    return key >> bits, key & ((1 << bits) - 1), np.bincount(at, np.repeat(n, ids.shape[1])[use]) if len(key) else np.zeros(0)


class Sparse:
    """Features of some texts: (text, feature, value) in the order of the texts."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, width: int):
        self.doc, self.feature, self.value, self.n, self.width = doc, feature, value, n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, self.value * w[self.feature], self.n)

    def packed(self) -> tuple[list[bytes], list[bytes]]:
        """Feature ids (i4) and values (f4) of each text."""
        ends = np.searchsorted(self.doc, np.arange(self.n + 1))
        ids, values = self.feature.astype("<i4"), self.value.astype("<f4")
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], [values[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


class Rows:
    """The packed features of a bounded sample, eight bytes a value; products go block by block.

    Each row begins with a value 0 of feature 0, so that none is empty."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int):
        self.sizes, self.ids, self.values, self.width, self.n = sizes, ids, values, width, len(sizes)
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, ids, values, width: int) -> Rows:
        first = (b"\0\0\0\0",)
        join = lambda column: b"".join(x for row in column for x in (*first, row))
        sizes = np.array([len(x) // 4 + 1 for x in ids], np.int64)
        return cls(sizes, np.frombuffer(join(ids), "<i4"), np.frombuffer(join(values), "<f4"), width)

    def blocks(self):
        a = 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + BLOCK)))
            low, high = self.starts[a], self.starts[b - 1] + self.sizes[b - 1]
            yield slice(a, b), self.ids[low:high], self.values[low:high]
            a = b

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for rows, ids, values in self.blocks():
            out[rows] = np.add.reduceat(w[ids] * values, self.starts[rows] - self.starts[rows.start])
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for rows, ids, values in self.blocks():
            out += np.bincount(ids, values * np.repeat(g[rows], self.sizes[rows]), self.width)
        return out

    def take(self, keep: np.ndarray) -> Rows:
        at = np.repeat(keep, self.sizes)
        return Rows(self.sizes[keep], self.ids[at], self.values[at], self.width)


def featured(sample: DataFrame, build, kept: list[str], label: str) -> DataFrame:
    """The columns ``kept`` of ``sample`` (text and others), and ids, values, dense: features made in parallel and written down.

    ``build`` makes (Sparse, dense columns) of a list of texts."""
    fields = [sample.schema[c] for c in kept] + [T.StructField(c, T.BinaryType()) for c in ("ids", "values", "dense")]

    def run(batches):
        for part in text_slices(batches, len(kept), 1 << 20):
            x, dense = build(as_bytes(part.column(len(kept))))
            columns = (*x.packed(), [row.astype("<f8").tobytes() for row in dense])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.binary()) for c in columns)], [*kept, "ids", "values", "dense"])

    return materialize(sample.select(*kept, F.col("text").cast("string")).mapInArrow(run, T.StructType(fields)), label)


def one_text(sample: DataFrame, *known: str) -> DataFrame:
    """A row for each doc_id: the least of its texts, and the greatest of each column ``known``. Its tasks are not fused."""
    width = max(2, sample.sparkSession.sparkContext.defaultParallelism)
    return sample.repartition(width, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(c).alias(c) for c in known])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def descend(gradient, width: int, steps: int = 200, rate: float = 0.1, start: np.ndarray | None = None) -> np.ndarray:
    """Adam from ``start`` (zero) with a falling rate; ``gradient(w)`` over all rows of the sample."""
    w, m, v = np.zeros(width) if start is None else start.copy(), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def logistic(x: Rows, extra: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200, fixed: bool = False) -> np.ndarray:
    """Weights of the features, of the ``extra`` dense columns and of the constant.

    A ``fixed`` constant is the log odds of ``y`` itself, so that a text of few known features gets about that."""
    k = extra.shape[1] if extra.ndim == 2 else 0
    dense = np.column_stack([extra.reshape(x.n, k), np.ones(x.n)])
    start = np.zeros(x.width + k + 1)
    if fixed:
        start[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def gradient(w):
        g = (sigmoid(x.dot(w[: x.width]) + dense @ w[x.width :]) - y) / max(x.n, 1)
        out = np.concatenate([x.back(g), g @ dense]) + ridge * w
        out[-1] *= not fixed
        return out

    return descend(gradient, x.width + k + 1, steps, start=start)
