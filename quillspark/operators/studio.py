"""Outlines and rollups of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def outline(rows: DataFrame) -> DataFrame:
    """path, parent, label, depth, sources (distinct, below or at the node) of rows (segments, source): all prefixes of all paths."""
    prefixes = rows.where(F.size("segments") > 0).select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda i: F.slice("segments", F.lit(1), i))).alias("p"))
    nodes = prefixes.groupBy("p").agg(F.count_distinct("source").alias("sources"))
    return nodes.select(F.array_join("p", "/").alias("path"), F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("parent"), F.element_at("p", -1).alias("label"), F.size("p").alias("depth"), "sources")


def shares(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """The ``keep`` most frequent keys with their count, share of the greatest, and the number of keys left out."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), key)
    ranked = counts.withColumn("place", F.row_number().over(order)).withColumn("keys", F.count("*").over(Window.partitionBy()))
    ranked = ranked.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy()))
    return ranked.where(F.col("place") <= keep).select(key, "n", "share", "place", F.greatest(F.col("keys") - keep, F.lit(0)).alias("omitted"))


def tree_order(rows: DataFrame, by: str) -> DataFrame:
    """by, path, label, depth, sources, key of the nodes of all prefixes of rows (by, segments, source), one tree for each ``by``.

    key puts a tree's nodes into preorder: the places of a node's ancestors and its own among their siblings, by first source
    and then label, at one width. Trees of any depth take the same two shuffles: a node meets its ancestors by their paths."""
    split = rows.where(F.size("segments") > 0).select(by, "source", F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda i: F.slice("segments", F.lit(1), i))).alias("path"))
    nodes = split.groupBy(by, "path").agg(F.min("source").alias("first"), F.count_distinct("source").alias("sources"))
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    place = F.row_number().over(Window.partitionBy(by, "parent").orderBy("first", F.element_at("path", -1)))
    nodes = nodes.withColumn("parent", parent).withColumn("place", place)
    above = nodes.select(by, "path", "sources", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("ancestor"))
    above = above.join(nodes.select(by, F.col("path").alias("ancestor"), "place"), [by, "ancestor"])
    steps = F.array_sort(F.collect_list(F.struct(F.size("ancestor").alias("depth"), F.format_string("%010d", "place").alias("place"))))
    keyed = above.groupBy(by, "path", "sources").agg(F.array_join(F.transform(steps, lambda s: s["place"]), "/").alias("key"))
    return keyed.select(by, "path", F.element_at("path", -1).alias("label"), F.size("path").alias("depth"), "sources", "key")


def mindmap(rows: DataFrame, by: str) -> DataFrame:
    """by, mermaid: each tree of ``tree_order`` as Mermaid text under a root of the name ``by``, a node a line, indented by depth."""
    nodes = tree_order(rows, by)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), N.label(F.col("label")), F.lit(" "), F.col("sources").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda x: x["line"])
    text = F.concat(F.lit("mindmap\n  root(("), N.label(F.col(by).cast("string")), F.lit("))\n"), F.array_join(ordered, "\n"))
    return nodes.groupBy(by).agg(text.alias("mermaid"))
