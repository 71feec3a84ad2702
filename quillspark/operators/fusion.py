"""Dense scores, reciprocal-rank fusion of channels, hybrid and multi-question search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import best, lexical

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    """Inner product folded from the left in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(queries: DataFrame, vectors: DataFrame, block: int = 4096) -> DataFrame:
    """query_id, chunk_id, score of a stated query set (query_id, qvec) against all vectors (chunk_id, vec), in blocks of queries.

    Every block meets every vector: that is the search itself. Blocks keep a task's queries bounded."""
    n = max(1, -(-queries.count() // block))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    rows = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    return rows.join(asked, "block").select("query_id", "chunk_id", dot(F.col("qvec"), F.col("vec")).alias("score"))


def dense_best(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank of the ``k`` best by ``dense_scores`` of a stated query set, of which a task hands on its own best."""
    asked = queries.select("query_id", "qvec").collect()
    numbers = best.numbered([r["query_id"] for r in asked], queries.schema["query_id"].dataType, queries.sparkSession)
    tried = best.vector_best(vectors, [r["qvec"] for r in asked], k)
    return lexical.top(tried.join(F.broadcast(numbers), "list").select("query_id", "chunk_id", "score"), k)


def fuse(channels: list[tuple[str, DataFrame]], k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score of ranked channels (query_id, chunk_id, rank): sums of 1 / (k + rank) in channel order.

    A chunk that a channel lists twice votes once, with its first rank."""
    votes = None
    for at, (_, ranked) in enumerate(channels):
        one = ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")).withColumn("channel", F.lit(at))
        votes = one if votes is None else votes.unionByName(one)
    votes = votes.withColumn("vote", 1 / (k + F.col("rank")))
    return votes.groupBy("query_id", "chunk_id").agg(lexical.in_order("channel", "vote").alias("score"))


def hybrid(queries: DataFrame, chunks: DataFrame, query_vectors: DataFrame, vectors: DataFrame, candidates: int = 50, k: int = 10) -> DataFrame:
    """Both channels cut to ``candidates``, fused, quality factor once on positive scores, then the ``k`` best."""
    found = lexical.index(chunks)
    words = lexical.search(queries, found, candidates, raw=True)
    dense = dense_best(query_vectors, vectors, candidates)
    fused = fuse([("bm25", words), ("vector", dense)])
    factors = lexical.factors(found.chunks)
    scored = fused.join(factors, "chunk_id", "left").withColumn("score", F.when(F.col("score") > 0, F.col("score") * F.coalesce("factor", F.lit(1.0))).otherwise(F.col("score")))
    return lexical.top(scored.select("query_id", "chunk_id", "score"), k)


def multi_query(queries: DataFrame, chunks: DataFrame | lexical.Index, each: int = 3, k: int = 5, rrf: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score, parts, rank: the ``k`` best of each question, whose sub-questions have ``each`` hits and fuse by rank.

    An undivided question keeps its BM25 ranking and scores. All sub-questions and questions are one search."""
    subs = queries.select("query_id", T.decompose(F.coalesce("query", F.lit(""))).alias("subs")).select("query_id", F.size("subs").alias("parts"), F.posexplode("subs").alias("part", "query"))
    found = lexical.search(subs.select(F.struct("query_id", "part", "parts").alias("query_id"), "query"), chunks, max(each, k))
    found = found.select("query_id.*", "chunk_id", "rank", "score").where((F.col("parts") == 1) | (F.col("rank") <= each))
    votes = found.withColumn("vote", F.when(F.col("parts") == 1, F.col("score")).otherwise(1 / (rrf + F.col("rank"))))
    return lexical.top(votes.groupBy("query_id", "parts", "chunk_id").agg(lexical.in_order("part", "vote").alias("score")), k)


def relative(scores: DataFrame) -> DataFrame:
    """Adds ratio, the score's place between the least and the greatest of its query (1 where all are equal)."""
    span = Window.partitionBy("query_id")
    low, high = F.min("score").over(span), F.max("score").over(span)
    return scores.withColumn("ratio", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
