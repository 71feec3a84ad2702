import hashlib
import importlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import pieces as P

TEXTS = ["", " ", "a", "  a  b ", "a\nb\t", "▁x", "<s> </s> <unk> <0x41>", "İé é ﬁ", "中文😀 混 mixed", "\x00a", "a　b\r\n", "﻿a", " " * 40, "x" * 3000, "▁▁", " ▁ ▁ ", "\n", "a" + " " * 100 + "b", "ab" * 900 + "中" * 900, "the the the, \"the\"."]


@pytest.fixture(scope="module")
def model():
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def lines(n=300, seed=1):
    rng = random.Random(seed)
    parts = ["the", "Über", "naïve", "<s>", "0x1F", "  ", "\n", "中文", "é", "😀", ".", ",,", "qzx", "▁", "ing", "\t"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_query_equals_library(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    data = list(enumerate(TEXTS + lines())) + [(7, "again"), (7, "again"), (None, "no id"), (900, None), (901, "long " * 60_000 + "z" * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, ids string, part int")
    out = P.decode(P.encode(df.repartition(3), model), model).select("doc_id", F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256))
    want = []
    for i, t in data:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_agendas_agree(model):
    """The agenda of one segment and the one over many give the same, the cache changes nothing, and every segment is checked."""
    p = P.Pieces(model)
    words = sorted({s for t in TEXTS + lines(200, 2) for s in p.cut(t) if len(s) < P.LONG})
    assert p.many([P.MARK + w for w in words]) == [p.one(P.MARK + w) for w in words]
    first = p.encode(TEXTS)
    assert p.checked == len({s for t in TEXTS for s in p.cut(t) if s})
    assert p.encode(TEXTS) == first
    p.known.clear()
    p.separable = False  # whole texts at once
    assert p.encode(TEXTS) == first


def test_a_difference_is_an_error(model):
    p = P.Pieces(model)
    p.pair_id = np.where(p.pair_id == p.ids["▁the"], p.ids["▁a"], p.pair_id)
    with pytest.raises(AssertionError, match="differ"):
        p.encode(["the other weather"])


def test_empty_and_other_columns(spark, model):
    df = spark.createDataFrame([], "doc_id long, text string, ids int")
    assert P.decode(P.encode(df, model), model).collect() == []
    plain = P.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model, ends=False)
    assert [len(r["ids"]) for r in plain.collect()] == [4]
