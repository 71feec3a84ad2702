"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by page_id within shards cut at fixed page_ids, a file is closed once its compressed size
reaches a limit, and headers and digests are made anew from the payload. Tasks write under temporary names; the manifest
(one row a file) names those of the attempts that counted, and a second pass renames them, so a task that dies or
runs twice leaves nothing that a reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, new_folder, range_cuts, shard_of

#: Compressed bytes after which a file is closed.
FILE_BYTES = 64 << 20
#: Payload bytes of a shard.
SHARD_BYTES = 16 << 20
#: The same date in every record, so that rewriting gives the same bytes.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit keeps the HTTP header (with the payload's length) and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"] + ([f"X-Refers-To-Page: {first}"] if first is not None else [])
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a file object, one at a time."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if parts:
                    raise ValueError("the last record is cut off")
                return
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"][5:]
    if fields["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page")}


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files; returns the manifest: path, records, bytes.

    Null html is an empty payload, a null url leaves its header out, a null page_id sorts last and is never referred
    to while its payload has a page with one. Of repeated rows the first is the response. Other columns are
    ignored; an empty table gives an empty manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
    firsts = materialize(firsts, "payloads")
    total = rows.agg(F.sum(F.octet_length("payload")).alias("b")).first()["b"] or 0 if min_bytes else firsts.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    cuts = range_cuts(rows, "page_id", max(1, -(-total // shard_bytes)))
    placed = rows.withColumn("shard", F.when(F.col("page_id").isNull(), len(cuts)).otherwise(shard_of(F.col("page_id"), cuts)))
    # payloads travel once, to their shard; who refers to whom follows in rows without a payload
    marks = placed.select("page_id", "digest", "shard").join(firsts.where("n > 1").select("digest", "first"), "digest")
    marks = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first", F.lit(True).alias("mark"), "digest", "shard")
    placed = placed.select("page_id", "url", "payload", F.lit(None).cast("long").alias("first"), F.lit(False).alias("mark"), "digest", "shard").unionByName(marks)
    folder = new_folder(spark, "warc")

    def write(batches):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        state = {"shard": None, "part": 0, "out": None}

        def close():
            if state["out"] is None:
                return []
            state["out"].close()
            done = (folder, state["temp"], f"part-{state['shard']:06d}-{state['part']:05d}.warc.gz", state["records"], state["bytes"])
            state.update(out=None, part=state["part"] + 1)
            return [done]

        def files():
            seen = marked = None
            for batch in batches:
                for page_id, url, payload, first, mark, digest, shard in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    if mark:
                        marked = (page_id, digest, first)
                        continue
                    if shard != state["shard"]:
                        yield from close()
                        state.update(shard=shard, part=0)
                    if state["out"] is None:
                        temp = f"_temporary-{uuid.uuid4().hex}"
                        state.update(out=store.open_output_stream(f"{root}/{temp}", compression=None), temp=temp, records=0, bytes=0)
                    copied = marked is not None and marked[:2] == (page_id, digest)
                    first = marked[2] if copied else None
                    again = copied and (page_id != first or seen == (page_id, digest))
                    seen = (page_id, digest)
                    data = record(page_id, url, payload, first, again)
                    state["out"].write(data)
                    state["records"] += 1
                    state["bytes"] += len(data)
                    if state["bytes"] >= file_bytes:
                        yield from close()
            yield from close()

        for row in files():
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["folder", "temp", "name", "records", "bytes"])

    ordered = placed.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", F.desc("mark"), "url")
    written = materialize(ordered.mapInArrow(write, "folder string, temp string, name string, records long, bytes long"), "written")

    def commit(batches):
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, root = filesystem(row["folder"])
                if store.get_file_info(f"{root}/{row['temp']}").type != fs.FileType.NotFound:  # else a former attempt has renamed it
                    store.move(f"{root}/{row['temp']}", f"{root}/{row['name']}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{r['folder']}/{r['name']}" for r in batch.to_pylist()]), batch.column(3), batch.column(4)], ["path", "records", "bytes"])

    return materialize(written.mapInArrow(commit, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record in the files of ``manifest``; digests are checked. ``payloads`` adds url and payload."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + (["url", "payload"] if payloads else [])
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows, held = [], 0
                    for data in members(stream):
                        rows.append(parse(data))
                        held += len(data) if payloads else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)

    schema = ", ".join(f"{k} {'long' if kinds.get(k) == pa.int64() else 'binary' if k == 'payload' else 'string'}" for k in names)
    return manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)), "path").mapInArrow(read, schema)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST(('0x' || substr(hex || '0', 1 + CAST(floor(i * 5 / 4) AS BIGINT), 2)) AS BIGINT) >> (3 - (i * 5) % 4)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
