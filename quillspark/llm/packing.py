"""Packing documents into fixed windows: non-negative least squares over shallow length combinations.

A document's ids fill whole windows first; what is left of it (under a window) is its remainder. Pairs of lengths that fill
a window exactly, and triples of two frequent lengths and what completes them, are the columns of a matrix; their repeat
counts solve a non-negative least-squares problem against the histogram of remainders. The counts are rounded down;
the remainders that they leave are packed greedily, longest lengths first, and cut where a window ends.

Only the histogram (at most one entry a length) reaches the driver. A remainder finds its place from its
rank among those of its length, counted in salted groups, so a length that a third of all documents share is no hot key.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

#: Lengths whose pairs make triples.
FREQUENT = 64
#: Rows of a salted group of one length.
GROUP = 100_000
SALTS = 64


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Lengths (ascending, 0: none) of each combination of two or three lengths that fills ``window``."""
    have = np.flatnonzero(histogram[1:window]) + 1
    exists = np.zeros(window + 1, bool)
    exists[have] = True
    rows = {(0, a, window - a) for a in have.tolist() if a <= window - a and exists[window - a]}
    top = have[np.argsort(-histogram[have], kind="stable")][:FREQUENT].tolist()
    rows |= {tuple(sorted((a, b, c))) for a in top for b in top if 0 < (c := window - a - b) and exists[c]}
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2, by accelerated projected gradients; A has 2 or 3 entries a column."""
    if not len(combos):
        return np.zeros(0)
    n = len(histogram)
    target = histogram.astype(np.float64)
    target[0] = 0
    use = (combos > 0).astype(np.float64)

    def forward(x):
        out = np.bincount(combos.ravel(), (use * x[:, None]).ravel(), n)
        out[0] = 0
        return out

    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue of A'A
        v = (forward(v)[combos] * use).sum(1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - ((forward(y) - target)[combos] * use).sum(1) / (1.05 * norm))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray, window: int) -> dict:
    """Which ranks of each length go to which sequences; ``histogram[n]``: remainders of ``n`` ids."""
    combos = combinations(histogram, window)
    times = np.floor(solve(combos, histogram) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequences = 0
    for c in np.argsort(-times, kind="stable"):
        lengths = combos[c][combos[c] > 0]
        unique, need = np.unique(lengths, return_counts=True)
        n = int(min(times[c], (left[unique] // need).min()))
        if n <= 0:
            continue
        offset = 0
        for length in lengths.tolist():
            first = int(histogram[length] - left[length])
            slots.setdefault(length, []).append((first, first + n, sequences, offset))
            left[length] -= n
            offset += length
        sequences += n
    lengths = np.arange(len(histogram))
    stream = np.zeros(len(histogram), np.int64)  # where a length's residuals begin in the greedy stream
    sizes = (lengths * left)[::-1]
    stream[::-1] = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    ends = list(range(window, total + 1, window))
    tail, at = total % window, total - total % window
    while tail:  # what is left fills power-of-two sequences, which need no padding
        step = 1 << (tail.bit_length() - 1)
        at, tail = at + step, tail - step
        ends.append(at)
    return {"slots": {k: np.array(v, np.int64) for k, v in slots.items()}, "used": histogram - left, "stream": stream, "ends": np.array(ends, np.int64), "first": sequences, "full": sequences + len(ends)}


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """doc_id, doc_tokens, full_crcs (of the whole windows), rem (the remainder's ids, u16), rem_len."""
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            counts, crcs, rems = [], [], []
            for ids in encode(batch.column(1).to_pylist()):
                ids += tail
                n = len(ids) // 2
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                counts.append(n)
                crcs.append([zlib.crc32(wide[k : k + window].tobytes()) for k in range(0, n // window * window, window)])
                rems.append(ids[n // window * window * 2 :])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rems, pa.binary()), pa.array([len(x) // 2 for x in rems], pa.int32())], ["doc_id", "doc_tokens", "full_crcs", "rem", "rem_len"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, doc_tokens long, full_crcs array<long>, rem binary, rem_len int")


def ranked(tokens: DataFrame, totals: list) -> DataFrame:
    """``rank`` of each row among those of its rem_len, and ``before``, the whole windows of the rows that precede it there."""
    salts = max(SALTS, -(-max((r["n"] for r in totals), default=0) // GROUP))
    salted = tokens.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(salts)))
    groups = salted.groupBy("rem_len", "salt").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("w"))
    earlier = Window.partitionBy("rem_len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("rem_len", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("rem_len", "salt").orderBy("doc_id", "doc_tokens", "rem")
    placed = salted.withColumn("r", F.row_number().over(inside)).withColumn("w", F.sum(F.size("full_crcs")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(groups, ["rem_len", "salt"]).select("doc_id", "doc_tokens", "full_crcs", "rem", "rem_len", (F.col("r") - 1 + F.col("n0")).alias("rank"), (F.col("w") - F.size("full_crcs") + F.col("w0")).alias("before"))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is the end id alone; a repeated row is packed as often as it stands there; a null doc_id stays
    null; other columns are ignored; an empty table gives no piece. All sequences hold ``window`` ids but
    up to log2(window) last ones, of a power of two each: nothing is padded."""
    tokens = materialize(tokenize(docs, tokenizer, end_id, window), "packing")
    totals = tokens.groupBy("rem_len").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("w")).collect()  # at most ``window`` rows
    histogram, full = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64)
    for r in totals:
        histogram[r["rem_len"]], full[r["rem_len"]] = r["n"], r["w"]
    laid = plan(histogram, window)
    laid["bases"] = laid["full"] + np.cumsum(full) - full
    shared = tokens.sparkSession.sparkContext.broadcast(laid)

    def place(batches):
        p = shared.value
        ends = p["ends"]
        for batch in batches:
            out = []
            for doc_id, n, crcs, rem, size, rank, before in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                base = int(p["bases"][size]) + before
                out += [(doc_id, k * window, window, crc, n, base + k, 0) for k, crc in enumerate(crcs)]
                if not size:
                    continue
                start, wide = len(crcs) * window, np.frombuffer(rem, "<u2").astype("<u4")
                slots = p["slots"].get(size)
                if rank < p["used"][size]:
                    first, _, sequence, offset = slots[np.searchsorted(slots[:, 0], rank, "right") - 1].tolist()
                    out.append((doc_id, start, size, zlib.crc32(wide.tobytes()), n, sequence + rank - first, offset))
                    continue
                at, done = int(p["stream"][size] + (rank - p["used"][size]) * size), 0
                while done < size:
                    k = int(np.searchsorted(ends, at, "right"))
                    take = min(size - done, int(ends[k]) - at)
                    out.append((doc_id, start + done, take, zlib.crc32(wide[done : done + take].tobytes()), n, p["first"] + k, at - (int(ends[k - 1]) if k else 0)))
                    at, done = at + take, done + take
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked(tokens, totals).mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
