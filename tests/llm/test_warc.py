import base64
import gzip
import hashlib
import os

from quillspark.llm import warc as W

ROWS = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (2, None, None), (9, "http://a/\r\nX: y", ""), (4, "u", "é" * 70_000), (5, "u", "one\r\n\r\ntwo"), (5, "u", "one\r\n\r\ntwo"), (None, "n", "<p>x</p>"), (None, "n", "alone"), (None, "n", "alone"), (8, "h", "WARC/1.0\r\n\r\n")]


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out, seen = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        key = h or ""
        response = (first.get(key) == i) and key not in seen
        seen.add(key) if response else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first.get(key)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, b"z") for i, u, h in rows], "page_id long, url string, html string, digest binary")


def test_round_trip(spark):
    for settings in ({}, {"file_bytes": 1, "shard_bytes": 50}):
        manifest = W.write_archives(frame(spark, ROWS), **settings)
        got = W.read_archives(manifest, payloads=True).collect()
        assert sorted([tuple(r)[:5] for r in got], key=repr) == brute(ROWS)
        assert all(r["payload"] == b"" for r in got if r["record_type"] == "revisit")
        assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in ROWS}


def test_same_bytes_again_and_standard_gzip(spark):
    first, second = (sorted(W.write_archives(frame(spark, ROWS), shard_bytes=50).collect()) for _ in range(2))
    data = [[(os.path.basename(r["path"]), open(r["path"][7:], "rb").read()) for r in m] for m in (first, second)]
    assert data[0] == data[1] and data[0]
    text = gzip.decompress(data[0][0][1])
    assert text.startswith(b"WARC/1.0\r\nWARC-Type: ")
    assert not [x for x in os.listdir(os.path.dirname(first[0]["path"][7:])) if x.startswith("_temporary")]


def test_small_payloads_stay_responses(spark):
    got = W.read_archives(W.write_archives(frame(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]), min_bytes=5)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_no_pages(spark):
    assert W.read_archives(W.write_archives(frame(spark, []))).collect() == []
