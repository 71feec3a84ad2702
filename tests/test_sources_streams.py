"""Folders, versions and streams."""

import json
import os

from pyspark.sql import functions as F

from quillspark.sources import files
from quillspark.streaming import windows

SF = "/root/testdata/sf0.001"


def test_scan(spark, tmp_path):
    os.makedirs(tmp_path / "docs" / "sub")
    (tmp_path / "docs" / "a.md").write_bytes("﻿intro\r\n# Title \r\nx".encode())
    (tmp_path / "docs" / "sub" / "b.md").write_text("no heading")
    (tmp_path / "docs" / "c.txt").write_text("# other")
    got = {r["source_file"]: r for r in files.scan(spark, str(tmp_path / "docs")).collect()}
    assert set(got) == {"a.md", "sub/b.md"}
    assert got["a.md"]["title"] == "Title" and got["a.md"]["text"] == "intro\n# Title \nx" and got["sub/b.md"]["title"] == "b"


def test_notebooks_and_types(spark):
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# A\n", "b"]}, {"cell_type": "code", "source": ["x = 1"]}]})
    rows = files.notebook_cells(spark.createDataFrame([("n.ipynb", book)], "source_file string, content string")).collect()
    assert [(r["cell"], r["cell_type"], r["text"]) for r in rows] == [(0, "markdown", "# A\nb"), (1, "code", "x = 1")]
    kinds = spark.createDataFrame([("a.MD",), ("b.exe",)], "p string").select(files.media_type(F.col("p"))).collect()
    assert [r[0] for r in kinds] == ["markdown", None]


def test_publish(spark, tmp_path):
    root = str(tmp_path / "index")
    for version, n in (("v1", 3), ("v2", 5)):
        files.publish(spark.range(n), root, version)
        assert files.current(spark, root).count() == n


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in rows)
    assert key(spark.table("windowed").collect()) == key(windows.windowed(events).collect())


def test_rolling_keeps_the_last(spark, tmp_path):
    rows = [("a", k, float(k)) for k in range(12)] + [("b", 1, 7.0)]
    df = spark.createDataFrame(rows, "event_type string, s long, value double").select("event_type", F.timestamp_seconds("s").alias("ts"), "value")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windows.rolling(stream, last=5).writeStream.outputMode("update").format("memory").queryName("rolling").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("rolling").collect()) == [("a", 5, 9.0, 11.0), ("b", 1, 7.0, 7.0)]


def day(hour, minute=0):
    return f"2024-01-01 {hour:02d}:{minute:02d}:00"


def run_jobs(spark, folder, hours=2):
    """What the stream says of what has come since its checkpoint."""
    schema = "job string, ts timestamp, state string, event_id long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = windows.job_states(stream, hours).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").format("parquet").start(f"{folder}/out")
    query.processAllAvailable()
    query.stop()
    return sorted((r["job"], str(r["ts"]), r["state"]) for r in spark.read.parquet(f"{folder}/out").collect())


def add_events(spark, folder, rows):
    spark.createDataFrame(rows, "job string, ts string, state string, event_id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_job_states_survive_a_restart(spark, tmp_path):
    """A job that is under way when the stream stops is interrupted after the restart, when its time is over; a stream equals its table."""
    first = [("a", day(0), "queued", 1), ("a", day(1), "running", 2), ("b", day(1), "running", 3), ("b", day(1, 30), "done", 4), ("c", day(0, 30), "running", 5)]
    add_events(spark, tmp_path, first)
    assert len(run_jobs(spark, tmp_path)) == 5
    second = [("a", day(2, 30), "running", 6), ("d", day(9), "queued", 7)]
    add_events(spark, tmp_path, second)
    third = [("e", day(15), "done", 8)]
    add_events(spark, tmp_path, third)
    got = run_jobs(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/in")
    want = sorted((r["job"], str(r["ts"]), r["state"]) for r in windows.job_log(table, 2).collect())
    assert got == want and [x for x in got if x[2] == "interrupted"] == [("a", day(4, 30), "interrupted"), ("c", day(2, 30), "interrupted"), ("d", day(11), "interrupted")]


def test_rolling_takes_late_events(spark, tmp_path):
    """Events that come in another order than their times give what the table gives."""
    rows = [("a", k * 7 % 40, float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "event_type string, s long, value double").select("event_type", F.timestamp_seconds("s").alias("ts"), "value")
    for part in range(4):
        df.where(f"value % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.rolling(stream, last=9).writeStream.outputMode("update").format("memory").queryName("late").start()
    query.processAllAvailable()
    query.stop()
    assert tuple(spark.table("late").collect()[-1]) == tuple(windows.rolled(df, last=9).first())


def test_folder_scan(spark, tmp_path):
    """A broken file fails alone and keeps its document; missing ones are removed once."""
    import hashlib

    root = tmp_path / "vault"
    for name, data in {"a.md": b"same", "b/c.txt": b"new", "d.md": b"changed", "e.md": b"\xff\xfe", "f.md": b"back", ".x/g.md": b"hidden", "h.exe": b"other"}.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(data)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    known = [("a.md", sha(b"same"), False), ("d.md", "old", False), ("e.md", "old", False), ("f.md", sha(b"back"), True), ("gone.md", "x", False), ("long.md", "x", True)]
    got = {r["source_file"]: (r["outcome"], r["error"]) for r in files.folder_scan(spark, str(root), spark.createDataFrame(known, "source_file string, checksum string, removed boolean")).collect()}
    assert got == {"a.md": ("same", None), "b/c.txt": ("added", None), "d.md": ("changed", None), "e.md": ("failed", "not UTF-8"), "f.md": ("back", None), "gone.md": ("removed", None)}
