"""Training-set rows: character vocabularies, windows, leakage, schedules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAD, UNKNOWN, END, IGNORE = 0, 1, 2, -100


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each text begins in them and the last ends); null texts are empty."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    found = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return found, before[at - at[0]]


def vocabulary(texts: DataFrame) -> DataFrame:
    """char, id of the distinct characters of texts (text) in code-point order, after the three special ids.

    Alphabets are small: the one sorted partition holds a row a character."""

    def run(batches):
        for batch in batches:
            chars = [chr(p) for p in np.unique(points(batch.column(0))[0])]
            yield pa.RecordBatch.from_arrays([pa.array(chars, pa.string())], ["char"])

    chars = texts.select("text").mapInArrow(run, "char string").distinct()
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) + END).alias("id"))


def lists(values: np.ndarray, begins: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values, pa.int32()), mask=None if missing is None else pa.array(missing))


def coded(rows: DataFrame, alphabet: DataFrame, **columns: tuple[str, bool]) -> DataFrame:
    """``rows`` with arrays of ids by ``alphabet`` (char, id) in place of texts: name=(text column, whether the end id is behind).

    Characters outside the alphabet are unknown, null texts stay null. The alphabet, a row a character, is sent to all tasks."""
    known = {ord(r["char"]): r["id"] for r in alphabet.collect()}
    table = np.full(max(known, default=0) + 2, UNKNOWN, np.int32)
    table[list(known)] = list(known.values())
    stay = [c for c in rows.columns if c not in {text for text, _ in columns.values()}]

    def run(batches):
        for batch in batches:
            out = [batch.column(i) for i in range(len(stay))]
            for i, (_, end) in enumerate(columns.values(), len(stay)):
                found, begins = points(batch.column(i))
                codes = table[np.minimum(found, len(table) - 1)]
                if end:
                    codes, begins = np.insert(codes, begins[1:], END), begins + np.arange(len(begins))
                out.append(lists(codes, begins, batch.column(i).is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(out, [*stay, *columns])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in stay] + [f"`{c}` array<int>" for c in columns]
    return rows.select(*stay, *[text for text, _ in columns.values()]).mapInArrow(run, ", ".join(kinds))


def encoded(texts: DataFrame, alphabet: DataFrame) -> DataFrame:
    """id, codes (array, in text order, end id last); characters outside ``alphabet`` are unknown."""
    return coded(texts.select("id", "text"), alphabet, codes=("text", True))


#: Windows made at once.
BLOCKS = 1 << 14


def windows(codes: DataFrame, block: int) -> DataFrame:
    """id, start, x, y of codes (id, codes): strides of ``block``, y one step ahead, padded at the right."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, begins = column.flatten().to_numpy(), np.cumsum(sizes) - sizes
            n = np.where(sizes >= 2, -(-(sizes - 1) // block), 0)
            doc = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * block
            for low in range(0, len(doc), BLOCKS):
                d, s = doc[low : low + BLOCKS], start[low : low + BLOCKS]
                place = s[:, None] + np.arange(block + 1)
                inside = place < sizes[d][:, None]
                got = values[np.where(inside, begins[d][:, None] + place, 0)]
                x = np.where(inside[:, 1:], got[:, :-1], PAD)
                y = np.where(inside[:, 1:], got[:, 1:], IGNORE)
                ends = np.arange(len(d) + 1) * block
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(s, pa.int32()), lists(x.ravel(), ends), lists(y.ravel(), ends)], ["id", "start", "x", "y"])

    kind = codes.schema["id"].dataType.simpleString()
    return codes.select("id", "codes").mapInArrow(run, f"id {kind}, start int, x array<int>, y array<int>")


def leaked(train: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``held`` that share one of ``keys`` with ``train``; each key is a semi-join of its own."""
    out = None
    for key in keys:
        one = held.join(train.select(key).distinct(), key, "left_semi").select("id", F.lit(key).alias("shared"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("shared")), ",").alias("shared"))


def learning_rate(steps: DataFrame, total: int, warm: int, top: float) -> DataFrame:
    """step, rate: linear warm-up, then a cosine down to a tenth."""
    part = (F.col("step") - warm) / F.greatest(F.lit(1), F.lit(total - warm))
    cosine = top * (0.1 + 0.9 * 0.5 * (1 + F.cos(F.pi() * part)))
    return steps.select("step", F.when(F.col("step") < warm, top * (F.col("step") + 1) / warm).otherwise(cosine).alias("rate"))
