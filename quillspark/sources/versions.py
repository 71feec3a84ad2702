"""A versioned index of documents on shared storage, built in increments.

    segments/<name>/documents, chunks, postings   what one build read anew, as Parquet
    files/<name>                                  source_file, document_sha256, segment of every live document
    versions/<number>.json                        manifest: parent, signature, files, segments with their documents, counts
    current.json                                  the version that readers see

A build compares the hashes of all documents with the current version's. Unchanged documents keep their chunks and postings
where they are: a version is the rows of its segments whose document is live there. Only added and changed documents are cut
and indexed, and nothing is published if there are none and none is gone. The build that leaves a segment mostly dead, or more
than MOST segments, moves the live rows of that one, or of the smallest, into its own.

Versions count up, and a manifest is made with a create that fails if it exists, so of two builds at once one fails. Readers follow
the pointer, which a rename replaces: they see the old version or the new one. A build that fails leaves the pointer alone, and
its files, which bear a name of their own, are in no manifest. All paths may be on any storage that Spark's file systems reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .files import scratch_table

TABLES = ("documents", "chunks", "postings")
#: Dead part of a segment's documents from which its live ones move.
DEAD = 0.5
#: Segments of a version at most.
MOST = 16


class Conflict(RuntimeError):
    """Another build published, or the documents changed, while this one ran."""


class Store:
    """Files below ``root`` through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._system().exists(self._path(name))

    def read(self, name: str) -> dict:
        stream = self._system().open(self._path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """A new file; an error if it exists."""
        try:
            stream = self._system().create(self._path(name), False)
        except Exception as e:
            raise Conflict(f"{name} exists") from e
        try:
            stream.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
        finally:
            stream.close()

    def swap(self, name: str, value: dict) -> None:
        """Replace a file as a whole, by a rename."""
        new = f".{name}-{uuid.uuid4().hex}"
        self.write(new, value)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(name).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        modes = self.spark.sparkContext._gateway.new_array(rename, 1)
        modes[0] = rename.OVERWRITE
        context.rename(self._path(new), self._path(name), modes)

    def current(self) -> dict | None:
        """Manifest of the version that readers see."""
        return self.read(f"versions/{self.read('current.json')['version']}.json") if self.exists("current.json") else None

    def manifest(self, version: int) -> dict:
        return self.read(f"versions/{version}.json")

    def activate(self, version: int) -> dict:
        """Let readers see an older or newer version whose files are all there."""
        found = self.manifest(version)
        for name in [f"files/{found['files']}", *[f"segments/{s}/{t}" for s in found["segments"] for t in TABLES]]:
            if not self.exists(f"{name}/_SUCCESS"):
                raise ValueError(f"version {version} is not whole: {name}")
        self.swap("current.json", {"version": version})
        return found

    def versions(self) -> list[dict]:
        """Manifests of all versions, newest first."""
        if not self.exists("versions"):
            return []
        names = [s.getPath().getName() for s in self._system().listStatus(self._path("versions"))]
        return [self.manifest(v) for v in sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)]

    def files(self, found: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/files/{found['files']}")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """Live rows of ``name`` in a version (the current one if None), with the segment that holds each."""
        found = self.current() if version is None else self.manifest(version)
        rows = None
        for s in found["segments"]:
            one = self.spark.read.parquet(f"{self.root}/segments/{s}/{name}").withColumn("segment", F.lit(s))
            rows = one if rows is None else rows.unionByName(one)
        return rows.join(self.files(found).select("source_file", "segment"), ["source_file", "segment"], "left_semi")


def fingerprint(documents: DataFrame) -> tuple:
    """One row about all documents' names and hashes that no order changes."""
    h = F.xxhash64("source_file", "document_sha256")
    return tuple(documents.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def hashed(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("source_file").isNotNull()).withColumn("document_sha256", T.sha256(F.coalesce("text", F.lit(""))))


def single(wide: DataFrame) -> DataFrame:
    """``wide`` with the least text of each source_file. Only names are shuffled, and the texts of those that stand more than once."""
    names = scratch_table(wide.groupBy("source_file").agg(F.count("*").alias("n")).where("n > 1").select("source_file"), "repeated")
    if not names.limit(1).count():
        return wide
    least = wide.join(names, "source_file", "left_semi").groupBy("source_file").agg(F.min(F.struct("text", "title", "document_sha256")).alias("d")).select("source_file", "d.*")
    return wide.select(*least.columns).join(names, "source_file", "left_anti").unionByName(least)


def build(
    spark: SparkSession,
    root: str,
    source: Callable[[], DataFrame],
    cut: Callable[[DataFrame], DataFrame],
    index: Callable[[DataFrame], DataFrame],
    signature: str,
    limit: int | None = None,
    allow_empty: bool = False,
) -> dict:
    """Bring the index below ``root`` up to the documents of ``source()`` (source_file, title, text) and publish it.

    cut: chunks (source_file and more; ``tokens`` if there is a ``limit``) of documents; index: postings (source_file and more) of chunks.
    ``signature`` names the rules: with another one every document is read anew. Returns the manifest with ``status``
    built, or unchanged and nothing written. Of rows with the same source_file the least text counts; null names take no part.

    Errors, which leave the current version as it is: no documents without ``allow_empty``, a chunk over ``limit`` tokens, documents
    that changed while the build ran, and another build's version (Conflict)."""
    store = Store(spark, root)
    old = store.current()
    last = max([v["version"] for v in store.versions()], default=0)
    wide = hashed(source())
    before = fingerprint(wide)
    docs = single(wide).select("source_file", "text", "title", "document_sha256")
    if not before[0] and not allow_empty:
        raise ValueError("no documents; allow_empty publishes an empty index")
    kind = docs.schema["source_file"].dataType.simpleString()
    held = store.files(old) if old else spark.createDataFrame([], f"source_file {kind}, document_sha256 string, segment string")
    compatible = bool(old) and old["signature"] == signature
    name = f"{last + 1}-{uuid.uuid4().hex}"
    new, was = F.col("n.document_sha256"), F.col("o.document_sha256")
    change = F.when(was.isNull(), "added").when(new.isNull(), "deleted").when(new != was, "modified").otherwise("same")
    pair = docs.select("source_file", "document_sha256").alias("n").join(held.alias("o"), "source_file", "full_outer").select("source_file", new.alias("document_sha256"), "segment", change.alias("change"))
    pair = scratch_table(pair, "changes")
    counts = {r["change"]: r["count"] for r in pair.groupBy("change").count().collect()}
    added, modified, deleted, same = (counts.get(c, 0) for c in ("added", "modified", "deleted", "same"))
    if compatible and not (added or modified or deleted):
        return {**old, "status": "unchanged"}
    carried = pair.where("change = 'same'") if compatible else pair.where("false")
    live = {r["segment"]: r["count"] for r in carried.groupBy("segment").count().collect()}  # MOST rows
    dead = {s for s, n in live.items() if n <= (1 - DEAD) * old["segments"][s]}
    dead |= set(sorted(set(live) - dead, key=live.get, reverse=True)[MOST - 1 :])
    moved, kept = carried.where(F.col("segment").isin(*dead)), carried.where(~F.col("segment").isin(*dead))
    fresh = pair.where("change IN ('added', 'modified')" if compatible else "change <> 'deleted'")
    read = docs
    if compatible and same:  # else all documents are read
        read = scratch_table(docs.join(fresh.select("source_file"), "source_file", "left_semi"), "read")
    cuts = scratch_table(cut(read).withColumn("built", F.lit(last + 1)), "cuts")
    if limit is not None and cuts.where(F.col("tokens") > limit).limit(1).count():
        raise ValueError(f"a chunk has more than {limit} tokens")
    for table, rows in zip(TABLES, (read, cuts, index(cuts)), strict=True):
        if dead:
            rows = rows.unionByName(store.table(table, old["version"]).join(moved.select("source_file"), "source_file", "left_semi").drop("segment"))
        rows.write.parquet(f"{root}/segments/{name}/{table}")
    here = fresh.unionByName(moved).withColumn("segment", F.lit(name))
    here.unionByName(kept).select("source_file", "document_sha256", "segment").write.parquet(f"{root}/files/{name}")
    if fingerprint(hashed(source())) != before:
        raise Conflict("the documents changed while the index was built")
    if store.current() != old:
        raise Conflict("another version was published meanwhile")
    stats = {"documents": added + modified + same, "added": added, "modified": modified, "deleted": deleted, "parsed": fresh.count(), "moved": moved.count(), "new_chunks": cuts.count()}
    segments = {s: old["segments"][s] for s in live if s not in dead} | {name: stats["parsed"] + stats["moved"]}
    manifest = {"version": last + 1, "parent": old["version"] if old else None, "signature": signature, "files": name, "segments": segments, "stats": stats}
    store.write(f"versions/{last + 1}.json", manifest)
    store.activate(last + 1)
    return {**manifest, "status": "built"}
