"""Versioned builds: what is carried, what a failure leaves, and who wins."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.jobs import plane as jobs
from quillspark.operators import plane
from quillspark.sources import versions as V


def docs(spark, rows):
    return spark.createDataFrame(rows, "source_file string, title string, text string")


def make(spark, root, rows, **more):
    return V.build(spark, root, lambda: docs(spark, rows), jobs.line_chunks, jobs.chunk_postings, more.pop("signature", "s"), **more)


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def shown(spark, root, version=None):
    return sorted((r["source_file"], r["text"], r["built"]) for r in V.Store(spark, root).table("chunks", version).collect())


A, B, C = ("a", "A", "alpha one"), ("b", "B", "beta two"), ("c", "C", "gamma three")


def test_builds_carry_what_is_unchanged(spark, tmp_path):
    root = f"{tmp_path}/i"
    first = make(spark, root, [A, B, C])
    before = files(root)
    assert first["status"] == "built" and first["parent"] is None and first["stats"]["added"] == 3
    assert make(spark, root, [C, A, B])["status"] == "unchanged" and files(root) == before  # nothing is written
    second = make(spark, root, [A, B, ("c", "C", "gamma four"), ("d", "D", "delta")])
    assert second["stats"] | {"new_chunks": 0} == {"documents": 4, "added": 1, "modified": 1, "deleted": 0, "parsed": 2, "moved": 0, "new_chunks": 0}
    assert shown(spark, root) == [("a", "alpha one", 1), ("b", "beta two", 1), ("c", "gamma four", 2), ("d", "delta", 2)]
    assert all(f in files(root) for f in before if f != "current.json" and not f.startswith(".current"))  # old files stay as they are
    assert shown(spark, root, 1) == [("a", "alpha one", 1), ("b", "beta two", 1), ("c", "gamma three", 1)]
    words = {(r["source_file"], r["token"]) for r in V.Store(spark, root).table("postings").collect()}
    assert ("c", "four") in words and ("c", "three") not in words and ("a", "alpha") in words
    store = V.Store(spark, root)
    store.activate(1)
    assert [v["version"] for v in store.versions()] == [2, 1] and store.current()["version"] == 1
    third = make(spark, root, [A, B])  # from the version that stands, with a number of its own
    assert (third["version"], third["parent"], third["stats"]["deleted"]) == (3, 1, 1)


def test_another_signature_reads_all_anew(spark, tmp_path):
    root = f"{tmp_path}/i"
    make(spark, root, [A, B])
    again = make(spark, root, [A, B], signature="other")
    assert again["status"] == "built" and again["stats"]["parsed"] == 2 and [r[2] for r in shown(spark, root)] == [2, 2]


def test_dead_segments_move(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/i"
    make(spark, root, [(k, k, f"text {k}") for k in "abcdefgh"])
    assert len(make(spark, root, [(k, k, f"text {k}") for k in "abcdef"])["segments"]) == 2
    moved = make(spark, root, [(k, k, f"text {k}") for k in "abc"])
    assert moved["stats"]["moved"] == 3 and len(moved["segments"]) == 1
    assert shown(spark, root) == [(k, f"text {k}", 1) for k in "abc"]  # who cut them is kept
    monkeypatch.setattr(V, "MOST", 3)
    for k in range(4):
        last = make(spark, root, [(k, k, f"text {k}") for k in "abc"] + [(f"n{j}", "", f"new {j}") for j in range(k + 1)])
        assert len(last["segments"]) <= 3
    assert [r[0] for r in shown(spark, root)] == ["a", "b", "c", "n0", "n1", "n2", "n3"]


def test_failures_leave_the_version(spark, tmp_path):
    root = f"{tmp_path}/i"
    with pytest.raises(ValueError, match="no documents"):
        make(spark, root, [])
    make(spark, root, [A])

    def broken(_):
        raise RuntimeError("no cut")

    with pytest.raises(RuntimeError, match="no cut"):
        V.build(spark, root, lambda: docs(spark, [A, B]), broken, jobs.chunk_postings, "s")
    counted = lambda d: jobs.line_chunks(d).withColumn("tokens", F.length("text"))
    with pytest.raises(ValueError, match="more than 5 tokens"):
        V.build(spark, root, lambda: docs(spark, [A, B]), counted, jobs.chunk_postings, "s", limit=5)
    turns = iter([[A, B], [A, C]])
    with pytest.raises(V.Conflict, match="changed"):
        V.build(spark, root, lambda: docs(spark, next(turns)), jobs.line_chunks, jobs.chunk_postings, "s")
    assert V.Store(spark, root).current()["version"] == 1 and shown(spark, root) == [("a", "alpha one", 1)]
    assert make(spark, root, [A, B])["version"] == 2 and [r[0] for r in shown(spark, root)] == ["a", "b"]
    assert make(spark, root, [], allow_empty=True)["stats"]["documents"] == 0 and shown(spark, root) == []


def test_of_two_builds_one_wins(spark, tmp_path):
    root = f"{tmp_path}/i"
    make(spark, root, [A])

    def slow():
        if V.Store(spark, root).current()["version"] == 1 and len(calls) == 1:
            calls.append(2)
            make(spark, root, [A, B])  # another build publishes in between
        calls.append(1)
        return docs(spark, [A, C])

    calls = []
    with pytest.raises(V.Conflict):
        V.build(spark, root, slow, jobs.line_chunks, jobs.chunk_postings, "s")
    assert [r[0] for r in shown(spark, root)] == ["a", "b"]
    with pytest.raises(V.Conflict):
        V.Store(spark, root).write("versions/2.json", {})


def test_a_version_must_be_whole(spark, tmp_path):
    root = f"{tmp_path}/i"
    made = make(spark, root, [A])
    make(spark, root, [A, B])
    os.remove(f"{root}/segments/{made['files']}/chunks/_SUCCESS")
    with pytest.raises(ValueError, match="not whole"):
        V.Store(spark, root).activate(1)
    assert V.Store(spark, root).current()["version"] == 2


def test_repeated_and_null_names(spark, tmp_path):
    root = f"{tmp_path}/i"
    made = make(spark, root, [A, ("a", "A", "alpha zero"), (None, "x", "nobody"), ("n", None, None), ("e", "", "")])
    assert made["stats"]["documents"] == 3
    assert [r[:2] for r in shown(spark, root)] == [("a", "alpha one")]


def test_new_versions_and_snapshot(spark):
    documents = spark.createDataFrame([(1, "l", False, "ready", "x"), (2, "l", False, "failed", None), (3, "off", False, "ready", "z"), (4, "l", True, "ready", "w")], "document_id long, library string, removed boolean, status string, current_version_id string")
    text = "sha2(cast(t as binary), 256)"
    old = spark.createDataFrame([(1, "x", 1, "one"), (3, "z", 1, "three"), (4, "w", 1, "four")], "document_id long, version_id string, number int, t string").selectExpr("document_id", "version_id", "number", f"{text} AS checksum")
    chunks = spark.createDataFrame([(1, "x", 0, "one"), (3, "z", 0, "three"), (4, "w", 0, "four")], "document_id long, version_id string, position int, text string")
    incoming = spark.createDataFrame([(1, "one"), (2, "two"), (3, "THREE"), (9, "nobody")], "document_id long, text string")
    d, v, c = plane.new_versions(documents, old, chunks, incoming, jobs.paragraphs)
    assert sorted((r["document_id"], r["number"]) for r in v.collect()) == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1)]
    libraries = spark.createDataFrame([("l", True), ("off", False)], "library string, active boolean")
    assert sorted((r["document_id"], r["text"]) for r in plane.snapshot(d, c, libraries).collect()) == [(1, "one"), (2, "two")]


def test_texts_of_single_names_stay_where_they_are(spark):
    """Only repeated names are grouped with their texts; the plan of the others groups none."""
    wide = V.hashed(docs(spark, [A, B]))
    assert "HashAggregate" not in V.single(wide)._jdf.queryExecution().executedPlan().toString()
    twice = V.single(V.hashed(docs(spark, [A, B, ("a", "Z", "alpha"), (None, "x", "y")])))
    assert sorted((r["source_file"], r["title"], r["text"]) for r in twice.collect()) == [("a", "Z", "alpha"), B]
