import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing as P
from quillspark.llm.queries import tokenizer

from .test_tokens import ROWS


def held(pieces, rows, window):
    """Every id of every row lies in exactly one piece, and sequences are gapless and full but for powers of two."""
    model = Tokenizer.from_file(tokenizer("bytes"))
    want = defaultdict(int)
    for i, t in rows:
        x = np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    texts = {k: np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, (_, t) in enumerate(rows)}
    for p in pieces:
        assert any(i == p.doc_id and len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for (i, _), x in zip(rows, texts.values(), strict=True))
    count = defaultdict(int)
    for p in pieces:
        for k in range(p.start, p.start + p.length):
            count[p.doc_id, p.doc_tokens, k] += 1
    expect = defaultdict(int)
    for (i, _), x in zip(rows, texts.values(), strict=True):
        for k in range(len(x)):
            expect[i, len(x), k] += 1
    assert count == expect
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("window", [8, 64, 1024])
def test_pieces(spark, window):
    rng = np.random.default_rng(window)
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 1000] + [(100 + k, "word " * int(rng.integers(0, 120))) for k in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int")
    pieces = P.pack(docs, tokenizer("bytes"), window).collect()
    held(pieces, rows, window)


def test_hot_length_and_empty(spark):
    rows = [(k, "same text here") for k in range(300)]
    held(P.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("bytes"), 16).collect(), rows, 16)
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer("bytes")).collect() == []


def test_least_squares_finds_counts():
    """A histogram made of combinations is taken apart again, and little is left for the greedy rest."""
    rng = np.random.default_rng(4)
    histogram = np.zeros(129, np.int64)
    for _ in range(60):
        a = int(rng.integers(1, 64))
        histogram[[a, 128 - a]] += int(rng.integers(10, 50))
    laid = P.plan(histogram, 128)
    assert (laid["used"] <= histogram).all() and laid["used"].sum() > 0.9 * histogram.sum()
    combos = P.combinations(histogram, 128)
    assert (combos.sum(1) == 128).all() and ((combos > 0).sum(1) >= 2).all()
    x = P.solve(combos, histogram)
    assert (x >= 0).all()
    # against projected coordinate descent, run long
    rows = np.zeros((len(combos), 129))
    for c, combo in enumerate(combos):
        for length in combo[combo > 0]:
            rows[c, length] += 1
    target = histogram.astype(float)
    z, rest = np.zeros(len(combos)), target.copy()
    for _ in range(300):
        for c, row in enumerate(rows):
            new = max(0.0, z[c] + row @ rest / (row @ row))
            rest -= (new - z[c]) * row
            z[c] = new
    assert np.linalg.norm(x @ rows - target) <= np.linalg.norm(rest) + 0.05 * np.linalg.norm(target)
