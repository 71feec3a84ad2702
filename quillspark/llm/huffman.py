"""Token-id files: canonical length-limited Huffman codes from the corpus's own counts, decoded by table in independent blocks.

A file holds whole documents in ascending doc_id order::

    b"QTK1"  u32 length of the JSON header  header  doc ids (i64)  null flags (u1)  tokens of each (i64)
    code lengths (zlib, u1 for each id)  bit offset of each block (u64)  bit stream (big-endian, zero-padded)

The bit offsets are checkpoints: block ``i`` decodes from its own, without what stands before. Blocks of a file decode
side by side, one vectorised table lookup for a symbol of each.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, new_folder, range_cuts, shard_of
from .tokens import encoder

#: Longest code in bits; 2 ** LIMIT table entries are kept for decoding.
LIMIT = 18
#: Tokens between two checkpoints.
BLOCK = 512
#: Tokens after which a file is closed.
FILE_TOKENS = 2_000_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each id under ``limit`` by package-merge (0: the id does not occur)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    row, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        kinds.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code of each id, and for decoding the id and length of every prefix of the longest length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    top = int(lengths.max()) if len(order) else 1
    spans = (1 << (top - lengths[order].astype(np.int64))) if len(order) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(order) else spans
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[order] = starts >> (top - lengths[order].astype(np.int64))
    fill = (1 << top) - int(spans.sum())
    ids = np.concatenate([np.repeat(order, spans), np.zeros(fill, np.int64)])
    sizes = np.concatenate([np.repeat(lengths[order].astype(np.int64), spans), np.ones(fill, np.int64)])
    return codes, ids, sizes, top


@lru_cache(maxsize=1)
def codebook(lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``canonical`` of some code lengths, which all files of a corpus share."""
    return canonical(np.frombuffer(lengths, np.uint8))


def pack_bits(codes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``codes`` and the bit offset of each. A few neighbours of at most 63 bits together are put in place at once."""
    at = np.cumsum(sizes) - sizes
    if not len(codes):
        return bytes(8), at
    width = min(4, 63 // int(sizes.max()))
    groups = np.zeros((2, -(-len(codes) // width) * width), np.uint64)
    groups[0, : len(codes)], groups[1, : len(codes)] = codes, sizes
    code, size = groups.reshape(2, -1, width)
    value, bits = code[:, 0], size[:, 0]
    for k in range(1, width):
        value, bits = value << size[:, k] | code[:, k], bits + size[:, k]
    start, bits = at[::width], bits.astype(np.int64)
    word, room = start >> 6, 64 - (start & 63) - bits
    over = np.flatnonzero(room < 0)
    high = value << np.maximum(room, 0).view(np.uint64)
    high[over] = value[over] >> (-room[over]).view(np.uint64)
    # a group has under 64 bits, so one begins in each word, and one at most reaches into it
    total = np.zeros(word[-1] + 2, np.uint64)
    total[:-1] = np.bitwise_or.reduceat(high, np.flatnonzero(np.diff(word, prepend=-1)))
    total[word[over] + 1] |= value[over] << (64 + room[over]).view(np.uint64)
    return total.astype(">u8").tobytes(), at


def unpack_blocks(stream: bytes, offsets: np.ndarray, tokens: int, block: int, ids: np.ndarray, sizes: np.ndarray, top: int) -> np.ndarray:
    """All ids of a file: each step looks up the next symbol of every block that still has one."""
    words = np.frombuffer(stream, ">u4").astype(np.uint64)
    pairs = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    both = (ids << 6 | sizes).astype(np.uint32)
    out = np.zeros((block, len(offsets)), dtype=np.uint32)
    at, mask = offsets.astype(np.int64), (1 << top) - 1
    last = tokens - block * (len(offsets) - 1)
    for k in range(block if len(offsets) > 1 else last):
        n = len(at) if k < last else len(at) - 1
        now = at[:n]
        found = both[(pairs[now >> 5] >> (64 - top - (now & 31)).view(np.uint64)).view(np.int64) & mask]
        out[k, :n] = found >> 6
        now += found & 63
    return out.T.reshape(-1)[:tokens]


def write_file(docs: list[tuple[int | None, bytes]], base: int, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.frombuffer(b"".join(d[1] for d in docs), "<u2").astype(np.int64)
    stream, at = pack_bits(codes[ids], lengths[ids].astype(np.int64))
    sizes = zlib.compress(lengths.tobytes(), 6)
    head = json.dumps({"docs": len(docs), "tokens": len(ids), "base": base, "block": block, "vocabulary": len(lengths), "lengths": len(sizes)}).encode()
    parts = [b"QTK1", np.uint32(len(head)).tobytes(), head, np.array([d[0] or 0 for d in docs], "<i8").tobytes(), np.array([d[0] is None for d in docs], "u1").tobytes(), np.array([len(d[1]) // 2 for d in docs], "<i8").tobytes(), sizes, at[::block].astype("<u8").tobytes(), stream]
    return b"".join(parts)


def read_file(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, index of its first token in the corpus, ids) of each document."""
    if data[:4] != b"QTK1":
        raise ValueError("not a token file")
    size = int(np.frombuffer(data, "<u4", 1, 4)[0])
    head = json.loads(data[8 : 8 + size])
    at, n, blocks = 8 + size, head["docs"], -(-head["tokens"] // head["block"])
    doc_ids = np.frombuffer(data, "<i8", n, at)
    nulls = np.frombuffer(data, "u1", n, at + 8 * n)
    counts = np.frombuffer(data, "<i8", n, at + 9 * n)
    at += 17 * n
    lengths = zlib.decompress(data[at : at + head["lengths"]])
    at += head["lengths"]
    offsets = np.frombuffer(data, "<u8", blocks, at)
    _, ids, sizes, top = codebook(lengths)
    out = unpack_blocks(data[at + 8 * blocks :], offsets, head["tokens"], head["block"], ids, sizes, top)
    start = 0
    for doc_id, null, count in zip(doc_ids.tolist(), nulls.tolist(), counts.tolist(), strict=True):
        yield (None if null else doc_id), head["base"] + start, out[start : start + count]
        start += count


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """doc_id, ids (binary, little-endian u16, ``end_id`` last), n_tokens. Null text: as empty."""
    tail = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:  # whole, so that a word is looked up once a batch
            ids = [x + tail for x in encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; at most ``vocabulary`` sums reach the driver."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][: len(ids) + 1]
            total += np.bincount(np.frombuffer(ids.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, ends[0]), minlength=vocabulary) if ends[-1] > ends[0] else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, file_tokens: int = FILE_TOKENS, limit: int = LIMIT) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files in the shared folder; returns the manifest, one row a file.

    The manifest is the commit: a task that dies or runs twice leaves files that no manifest row names. Documents
    with equal doc_id are all kept, ordered by their ids; a null doc_id comes first; null text is empty; other
    columns are ignored; an empty table gives an empty manifest."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, end_id), "tokens")
    vocabulary = 1 << 16
    lengths = code_lengths(id_counts(tokens, vocabulary), limit)
    total = tokens.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    cuts = range_cuts(tokens, "doc_id", max(1, -(-total // file_tokens)))
    placed = tokens.withColumn("shard", shard_of(F.col("doc_id"), cuts))
    base, bases = 0, {}
    for row in sorted(placed.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["shard"]):
        bases[row["shard"]] = base
        base += row["n"]
    folder = new_folder(spark, "token-files")
    shared = spark.sparkContext.broadcast((lengths, bases))

    def write(batches):
        lengths, bases = shared.value
        codes = codebook(lengths.tobytes())[0]
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        state = {"shard": None, "docs": [], "n": 0, "base": 0, "part": 0}

        def close():
            if not state["docs"]:
                return None
            name = f"{state['shard']:08d}-{state['part']:05d}-{uuid.uuid4().hex}.qtk"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(write_file(state["docs"], state["base"], lengths, codes))
            row = (f"{folder}/{name}", state["base"], state["n"], len(state["docs"]))
            state.update(docs=[], n=0, base=state["base"] + state["n"], part=state["part"] + 1)
            return row

        def rows():
            for batch in batches:
                for doc_id, ids, shard in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if shard != state["shard"]:
                        yield close()
                        state.update(shard=shard, base=bases[shard], part=0)
                    state["docs"].append((doc_id, ids))
                    state["n"] += len(ids) // 2
                    if state["n"] >= file_tokens:
                        yield close()
            yield close()

        for row in rows():
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "first_token", "n_tokens", "n_docs"])

    out = placed.select("doc_id", "ids", "shard").repartition(max(1, len(bases)), "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return materialize(out.mapInArrow(write, "path string, first_token long, n_tokens long, n_docs long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``manifest``, decoded from them."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_file(at) as f:
                    rows = [(d, s, len(x), zlib.crc32(x.astype("<u4", copy=False))) for d, s, x in read_file(f.read())]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path")
    width = max(1, min(manifest.count(), 10_000))
    return files.repartition(width, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
