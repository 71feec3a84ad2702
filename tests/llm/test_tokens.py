import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm import huffman as H
from quillspark.llm import packing as P
from quillspark.llm import tokens as T
from quillspark.llm.queries import tokenizer

ODD = ["a  b\n\n c \t d", "\nx y ", "  lead", " İstanbul ΣΑΣ Σ  x", "don't  'll x's 1234 5", "a b c　 d", "<|endoftext|> a b <|endoftext|>", "x <|startoftext|>\ny", "é a ́b", "日本語 テスト x\x1cy \x1c z", "\r\n a\r\nb", "a \x85 b", "😀 a😀 b\n😀c", "\n", "\n\n", " ", " a", "a ", "a\n b", "a \nb", "\na\nb\n", " \n", "word. word, (word) word's $#% | |", "Straße ÀÉÎ ÿ Ĭ ĳ", None, ""]
ROWS = [(5, "b a b"), (2, None), (9, ""), (2, "zz zz"), (None, "no id"), (7, "long " * 30_000), (5, "b a b")]


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_cut_texts_encode_like_whole_ones(kind, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 50)  # emptied again and again
    model, encoder, rng = Tokenizer.from_file(tokenizer(kind)), T.Encoder(tokenizer(kind)), random.Random(1)
    alphabet = list("abAB .,!'\n\t12é日 ") + ["  ", "the", "\n\n", "’s", "'s"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(part)]
        assert got == [model.encode(t or "", add_special_tokens=False).ids for t in part]


def huffman_cost(counts):
    heap = sorted(c for c in counts if c)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def test_code_lengths():
    rng = np.random.default_rng(0)
    counts = rng.zipf(1.4, 2000).clip(0, 10**6)
    free = H.code_lengths(counts, 40).astype(int)
    assert (free * counts).sum() == huffman_cost(counts.tolist())
    short = H.code_lengths(counts, 11).astype(int)
    assert short.max() <= 11 and abs((2.0**-short).sum() - 1) < 1e-12 and (short * counts).sum() >= (free * counts).sum()
    assert H.code_lengths(np.array([0, 0, 0])).tolist() == [0, 0, 0] and H.code_lengths(np.array([0, 4])).tolist() == [0, 1]
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(9), 3)


def test_blocks_decode_from_their_own_offsets():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.zipf(1.3, 40_000).clip(0, 3000), minlength=65536)
    lengths = H.code_lengths(counts)
    codes, ids, sizes, top = H.canonical(lengths)
    text = rng.choice(np.flatnonzero(counts), 5000)
    stream, at = H.pack_bits(codes[text], lengths[text].astype(np.int64))
    offsets = at[::256]
    assert (H.unpack_blocks(stream, offsets, 5000, 256, ids, sizes, top) == text).all()
    alone = H.unpack_blocks(stream, offsets[3:4], 256, 256, ids, sizes, top)
    assert (alone == text[768:1024]).all()


@pytest.mark.parametrize("file_tokens", [1, 50, 10**6])
def test_files_round_trip(spark, file_tokens):
    model = Tokenizer.from_file(tokenizer("words"))
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, ids string")
    got = [tuple(r) for r in H.read_token_files(H.write_token_files(docs, tokenizer("words"), 2, file_tokens)).collect()]
    ids = [(i, np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in ROWS]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    want, start = [], 0
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(got, key=lambda r: r[1]) == want


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert H.read_token_files(H.write_token_files(empty, tokenizer("words"), 2)).collect() == []


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_each_different_cut_is_looked_up_once(kind):
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    Counted.asked = 0
    encoder = T.Encoder(tokenizer(kind))
    encoder.later = Counted()
    texts = ["one two two\nthree two"] * 500
    got = encoder.encode(texts)
    assert Counted.asked <= 3
    assert got == encoder._plain(texts)
    odd = ["", " ", "\n", " a", "a ", "a\n", "\na", "a,", ", a", "a ,. b", "\n. a", "a b\u00a0c", None]
    assert encoder.encode(odd) == [encoder._plain([t or ""])[0] for t in odd]


def test_neighbours_are_packed_at_once(monkeypatch):
    """The stream is the codes' bits one after the other, for groups of one to four codes; few arrays are as long as the codes."""
    rng = np.random.default_rng(4)
    for top, count in ((1, 1), (1, 130), (5, 1000), (18, 2000), (30, 777), (40, 64), (63, 65)):
        sizes = rng.integers(1, top + 1, count)
        codes = np.array([rng.integers(0, 1 << int(n)) for n in sizes], np.int64)
        bits = "".join(format(c, f"0{n}b") for c, n in zip(codes.tolist(), sizes.tolist(), strict=True))
        stream, at = H.pack_bits(codes, sizes)
        assert at.tolist() == (np.cumsum(sizes) - sizes).tolist()
        got = "".join(format(x, "08b") for x in stream)
        assert got[: len(bits)] == bits and not got[len(bits) :].strip("0") and len(stream) % 8 == 0
    codes, long = np.ones(100_000, np.int64), []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: long.append(len(x)) or count(x, *a))
    H.pack_bits(codes, np.full(len(codes), 16))
    assert sum(long) < len(codes)


def test_a_batch_is_encoded_whole(spark):
    """A call's words are looked up once, so a batch is one call."""
    calls = []

    class Held:
        def encode(self, texts):
            calls.append(len(texts))
            return [b"" for _ in texts]

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run([pa.record_batch({"doc_id": list(range(5000)), "text": ["a b"] * 5000})]))

    for module, args in ((H, ("x", 2)), (P, ("x", 0, 1024))):
        kept, module.encoder = module.encoder, lambda _: Held()
        try:
            assert sum(b.num_rows for b in module.tokenize(Docs(), *args)) == 5000
        finally:
            module.encoder = kept
    assert calls == [5000, 5000]
