"""Reading document folders and publishing versions as ordinary tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SUFFIXES = {"md": "markdown", "markdown": "markdown", "txt": "text", "pdf": "pdf", "ipynb": "notebook", "html": "web", "htm": "web"}


def media_type(path):
    """Column: the media type of a path by its lower-case suffix; null if unsupported."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(suffix == s, F.lit(m)) for s, m in SUFFIXES.items()])


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """source_file, title, text, document_sha256 of the Markdown files below ``folder``.

    Dot files and folders are skipped, a byte-order mark goes, line ends become line feeds, the hash is of the raw bytes; the
    title is the first line that starts with ``# ``, else the file's stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), f"^{root}/", "")
    rows = files.select(name.alias("source_file"), F.sha2("content", 256).alias("document_sha256"), F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""), r"\r\n?", "\n").alias("text"))
    rows = rows.where(~F.col("source_file").rlike(r"(^|/)\."))
    first = F.regexp_extract("text", r"(?m)^# (.*)$", 1)
    stem = F.regexp_extract("source_file", r"([^/]+)\.[^.]+$", 1)
    return rows.select("source_file", F.when(F.col("text").rlike(r"(?m)^# "), T.strip(first)).otherwise(stem).alias("title"), "text", "document_sha256")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; unset, a local session gets one of its own, and elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that its uses do not repeat its work."""
    path = f"{scratch_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folder and schema of each table that ``corpus_table`` made, by application, label and what the corpus was.
_MADE: dict[tuple, tuple] = {}


def corpus_table(spark: SparkSession, path: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make()`` gives of the corpus at ``path``, written once a version of the corpus (its files' number, bytes and
    time) and application, and read by all that ask for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getContentSummary(at)
    key = (spark.sparkContext.applicationId, label, path, size.getFileCount(), size.getLength(), system.getFileStatus(at).getModificationTime())
    if key not in _MADE:
        folder = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
        rows = make()
        rows.write.parquet(folder)
        _MADE[key] = folder, rows.schema
    folder, schema = _MADE[key]
    return spark.read.schema(schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew where its scan has fewer tasks than the cluster has cores, which a large corpus never has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def notebook_cells(files: DataFrame) -> DataFrame:
    """source_file, cell, cell_type, text of notebooks (source_file, content): sources of all cells, in order."""
    schema = "cells array<struct<cell_type:string,source:array<string>>>"
    parsed = files.select("source_file", F.from_json("content", schema).alias("n"))
    return parsed.select("source_file", F.posexplode("n.cells").alias("cell", "c")).select("source_file", "cell", F.col("c.cell_type").alias("cell_type"), F.array_join("c.source", "").alias("text"))


def publish(df: DataFrame, root: str, version: str) -> None:
    """Write ``df`` as a version of its own, then point to it: readers see the old or the new one, never a part."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")


def current(spark: SparkSession, root: str) -> DataFrame:
    version = json.loads(spark.read.text(f"{root}/current").first()[0])["version"]
    return spark.read.parquet(f"{root}/versions/{version}")


def folder_scan(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """source_file, media_type, checksum, outcome, error of the files below ``folder`` against documents (source_file, checksum, removed).

    Files of unknown types and those with a dot in front of any part of their path are left out. A file is added, changed,
    the same, or back (removed before); one whose text is no UTF-8 failed, alone, and keeps its document; documents without a
    file are removed, unless they were. Contents are hashed where they are read, and only names and hashes are joined."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), f"^{root}/", "")
    rows = files.select(name.alias("source_file"), F.sha2("content", 256).alias("now"), F.is_valid_utf8(F.col("content").cast("string")).alias("readable"))
    rows = rows.withColumn("media_type", media_type(F.col("source_file"))).where(F.col("media_type").isNotNull() & ~F.col("source_file").rlike(r"(^|/)\."))
    both = rows.join(documents.select("source_file", "checksum", "removed"), "source_file", "full_outer")
    gone, text = F.col("now").isNull(), F.col("media_type") != "pdf"
    outcome = F.when(gone & ~F.col("removed"), "removed").when(text & ~F.col("readable"), "failed").when(F.col("checksum").isNull(), "added").when(F.col("removed"), "back").when(F.col("checksum") == F.col("now"), "same").otherwise("changed")
    found = both.where(~(gone & F.col("removed"))).withColumn("outcome", outcome)
    return found.select("source_file", "media_type", F.col("now").alias("checksum"), "outcome", F.when(F.col("outcome") == "failed", "not UTF-8").alias("error"))


def write_files(rows: DataFrame, folder: str) -> None:
    """One file a row of rows (name, content as bytes) below ``folder``, by the tasks, through the file system of the folder's URI."""

    def run(frames):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                path = f"{root}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as f:
                    f.write(bytes(content))
            yield frame[["name"]]

    rows.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
