"""Packing ranked sources into budgeted contexts, and checking citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def upto(*keys: str, order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def fit_evidence(sources: DataFrame, budget: int) -> DataFrame:
    """Sources (query_id, rank, header, text) whose UTF-8 bytes fit ``budget`` in rank order; the first always stays.

    Sizes are positive, so once one does not fit, none after it does."""
    sized = sources.withColumn("bytes", F.octet_length(F.concat("header", "text")).cast("long"))
    order = upto("query_id", order="rank")
    return sized.withColumn("used", F.sum("bytes").over(order)).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where((F.col("n") == 1) | (F.col("used") <= budget)).drop("n")


def evidence_budget(context: int = 8192, answer: int = 512, prompt: int = 2048, bytes_per_token: float = 2.5) -> int:
    return int((context - answer - prompt) * bytes_per_token)


def header(label: Column, source: Column, heading: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]\n来源："), source, F.lit("\n标题路径："), heading, F.lit("\n内容："))


def build_context(sources: DataFrame, max_chars: int = 2200, least: int = 240) -> DataFrame:
    """query_id, rank, label, content of sources (query_id, rank, source, heading, content): a base share each, leftovers by rank.

    Blank contents get no label. Headers are taken while they, their separators and one character a source fit; the
    first that does not fit ends the list. Cut contents end in an ellipsis."""
    live = sources.where(F.length(T.strip(F.col("content"))) > 0)
    live = live.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    live = live.withColumn("label", F.concat(F.lit("S"), F.col("n"))).withColumn("head", header(F.col("label"), F.col("source"), F.col("heading")))
    width = F.length("head") + F.when(F.col("n") > 1, 2).otherwise(0)
    live = live.withColumn("heads", F.sum(width).over(upto("query_id", order="n"))).where(F.col("heads") + F.col("n") <= max_chars)
    whole = Window.partitionBy("query_id")
    live = live.withColumn("room", F.lit(max_chars) - F.max("heads").over(whole)).withColumn("sources", F.count("*").over(whole))
    live = live.withColumn("base", F.least(F.length("content"), F.lit(least), F.floor(F.col("room") / F.col("sources"))))
    live = live.withColumn("spare", F.col("room") - F.sum("base").over(whole)).withColumn("need", F.length("content") - F.col("base"))
    before = F.sum("need").over(upto("query_id", order="n")) - F.col("need")
    live = live.withColumn("budget", F.col("base") + F.greatest(F.lit(0), F.least(F.col("need"), F.col("spare") - before)))
    cut = F.concat(F.regexp_replace(F.col("content").substr(F.lit(1), (F.col("budget") - 1).cast("int")), r"(?U)\s+$", ""), F.lit("…"))
    return live.select("query_id", "rank", "label", "head", F.when(F.length("content") > F.col("budget"), cut).otherwise(F.col("content")).alias("content"))


def context_text(packed: DataFrame) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct("rank", F.concat("head", "content").alias("block"))))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("sources"))


def round_robin(units: DataFrame, budget: int) -> DataFrame:
    """query_id, accepted (array of struct source, unit) of units (query_id, source, unit, header, content).

    One unit a source and round, whatever becomes of it, so the visiting order is fixed: by unit, then by source. One
    fold per query carries what is used, seen and opened; a query has the few units of its top sources."""
    visit = F.array_sort(F.collect_list(F.struct("unit", "source", F.length("header").alias("head"), F.length("content").alias("size"), "content")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("opened"), F.array().cast("array<struct<source:int,unit:int>>").alias("accepted"))

    def step(s, x):
        known = F.array_contains(s["opened"], x["source"])
        added = x["size"] + F.when(known, 2).otherwise(x["head"] + F.when(F.size(s["opened"]) > 0, 2).otherwise(0))
        take = ~F.array_contains(s["seen"], x["content"]) & (s["used"] + added <= budget)
        grown = F.struct((s["used"] + added).alias("used"), F.array_append(s["seen"], x["content"]).alias("seen"), F.when(known, s["opened"]).otherwise(F.array_append(s["opened"], x["source"])).alias("opened"), F.array_append(s["accepted"], F.struct(x["source"].alias("source"), x["unit"].alias("unit"))).alias("accepted"))
        return F.when(take, grown).otherwise(s)

    return units.withColumn("unit", F.col("unit").cast("int")).withColumn("source", F.col("source").cast("int")).groupBy("query_id").agg(F.aggregate(visit, start, step).alias("state")).select("query_id", F.col("state.used").alias("used"), F.col("state.accepted").alias("accepted"))


def recent_history(messages: DataFrame, last: int = 8, budget: int = 4000) -> DataFrame:
    """conv_id, turns (chronological), chars of messages (conv_id, turn, text): of the last ones, newest first, each that still fits."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= last)
    newest = F.array_sort(F.collect_list(F.struct("_r", F.col("turn").cast("long").alias("turn"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))))
    start = F.struct(F.lit(0).alias("chars"), F.array().cast("array<bigint>").alias("turns"))

    def step(s, x):
        grown = F.struct((s["chars"] + x["size"]).alias("chars"), F.array_prepend(s["turns"], x["turn"]).alias("turns"))
        return F.when(s["chars"] + x["size"] <= budget, grown).otherwise(s)

    return rows.groupBy("conv_id").agg(F.aggregate(newest, start, step).alias("s")).select("conv_id", "s.turns", "s.chars")


def cited(answers: DataFrame) -> DataFrame:
    """Adds labels, invalid, valid to answers (answer, available): at least one citation and none outside ``available``."""
    out = answers.withColumn("labels", T.citation_labels(F.col("answer"))).withColumn("invalid", F.array_except("labels", "available"))
    return out.withColumn("valid", (F.size("labels") > 0) & (F.size("invalid") == 0))


def assertion_lines(texts: DataFrame) -> DataFrame:
    """id, line (from 1), text of lines that need a source: no blank, heading, fenced or rule-only line."""
    rows = texts.select("id", F.posexplode(T.lines(F.col("content"))).alias("at", "raw")).withColumn("line", T.strip(F.col("raw")))
    fence = F.col("line").startswith("```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(upto("id", order="at")))
    keep = ~fence & (F.col("fences") % 2 == 0) & (F.length("line") > 0) & ~F.col("line").startswith("#") & ~F.col("line").rlike(r"^[|\-: ]*$")
    return rows.where(keep).select("id", (F.col("at") + 1).alias("line"), F.col("line").alias("text"))


def backlinks(texts: DataFrame, known: int) -> DataFrame:
    """id, assertions, with_source, hit_rate (null without assertions), of texts (id, content) with labels S1 to S``known``."""
    available = F.transform(F.sequence(F.lit(1), F.lit(known)), lambda i: F.concat(F.lit("S"), i))
    rows = assertion_lines(texts).withColumn("found", T.single_citations(F.col("text")))
    rows = rows.withColumn("good", (F.size(F.array_intersect("found", available)) > 0).cast("int"))
    sums = rows.groupBy("id").agg(F.count("*").alias("assertions"), F.sum("good").alias("with_source"))
    out = texts.select("id").join(sums, "id", "left").na.fill(0)
    return out.withColumn("hit_rate", F.when(F.col("assertions") > 0, F.col("with_source") / F.col("assertions")))
