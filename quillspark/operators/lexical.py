"""Lexical index and ranking: postings, document frequencies, IDF and BM25 scores.

A chunk's tokens are counted in its own row, so an index is made without a shuffle. It is a table with a row a chunk, which all searches
of a corpus read. A search scores the asked tokens of each row where it is read, in the order of the tokens, and a task hands on
its k best of each question (``best``): pairs of a question and a chunk are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import scratch_table
from . import best

K1, B, HEADING_REPEAT = 1.5, 0.75, 1
#: Not read any more: a search had a first threshold from about so many postings.
SEED = 4096


@dataclass
class Index:
    """chunks (chunk_id, heading, text) and their bags (``bag_rows``)."""

    chunks: DataFrame
    bags: DataFrame

    @property
    def rows(self) -> DataFrame:
        """Posting rows (``posting_rows``)."""
        return unpacked(self.bags)


def index(chunks: DataFrame | Index) -> Index:
    return chunks if isinstance(chunks, Index) else Index(chunks, scratch_table(bag_rows(chunks), "postings"))


def posting_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, token, heading_tf, text_tf, doc_len, head_len of every token of every chunk; one without tokens has a row of the empty token."""
    return unpacked(bag_rows(chunks))


def unpacked(bags: DataFrame) -> DataFrame:
    rows = bags.select("chunk_id", "doc_len", "head_len", F.explode_outer("postings").alias("x"))
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    n, head = F.col("x.n"), F.col("x.heading_tf")
    return rows.select("chunk_id", F.coalesce("x.token", F.lit("")).alias("token"), count(head).alias("heading_tf"), count(n - head).alias("text_tf"), "doc_len", "head_len")


def bag_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_len, head_len, factor, postings (token, n, heading_tf: all and those in the heading) in the order of tokens of every chunk.

    Sorted tokens are counted by where the next different one begins. The heading counts 1 + HEADING_REPEAT times in doc_len."""
    rows = chunks.select("chunk_id", T.tokenize(F.coalesce("heading", F.lit(""))).alias("heads"), T.tokenize(F.coalesce("text", F.lit(""))).alias("words"), T.quality_factor(F.coalesce("heading", F.lit(""))).alias("factor"))
    doc_len = (F.size("heads") * (1 + HEADING_REPEAT) + F.size("words")).cast("long")
    rows = rows.select("chunk_id", "factor", doc_len.alias("doc_len"), "heads", F.sort_array(F.concat("heads", "words")).alias("tokens"))
    # one element more than there are tokens: the last turn is the end
    turns = F.zip_with("tokens", F.concat(F.array(F.lit(None).cast("string")), "tokens"), lambda x, before: F.when(~x.eqNullSafe(before), F.struct(x.alias("token"))))
    places = F.filter(F.transform(turns, lambda e, i: F.when(e.isNotNull(), F.struct(e["token"].alias("token"), i.alias("at")))), lambda e: e.isNotNull())
    rows = rows.select("chunk_id", "factor", "doc_len", "heads", places.alias("turns"))
    runs = F.zip_with("turns", F.slice("turns", 2, F.greatest(F.size("turns"), F.lit(1))), lambda a, b: F.struct(a["token"].alias("token"), (b["at"] - a["at"]).alias("n")))
    runs = F.filter(runs, lambda x: x["token"].isNotNull())
    in_heading = lambda x: F.size(F.filter("heads", lambda h: h == x["token"]))
    bag = F.transform(runs, lambda x: F.struct(x["token"].alias("token"), x["n"].alias("n"), in_heading(x).alias("heading_tf")))
    return rows.select("chunk_id", "doc_len", F.size("heads").cast("long").alias("head_len"), "factor", bag.alias("postings"))


def weighed(rows: DataFrame, repeat: int = HEADING_REPEAT) -> Column:
    return F.col("heading_tf") * (1 + repeat) + F.col("text_tf")


def postings(chunks: DataFrame | Index) -> DataFrame:
    """chunk_id, token, tf, heading_tf, text_tf, doc_len of every token of every chunk."""
    rows = chunks.rows if isinstance(chunks, Index) else posting_rows(chunks)
    return rows.where("token <> ''").select("chunk_id", "token", weighed(rows).alias("tf"), "heading_tf", "text_tf", "doc_len")


def corpus_stats(chunks: DataFrame | Index) -> DataFrame:
    """One row: n (chunks), avgdl."""
    return index(chunks).bags.agg(F.count("*").alias("n"), (F.sum("doc_len") / F.count("*")).alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token of queries (query_id, query), each pair once."""
    return queries.select("query_id", F.explode(T.tokenize_query(F.coalesce("query", F.lit("")))).alias("token")).distinct()


def bm25_part(idf: Column, tf: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What a token adds to BM25, in the order of the SQL's operations."""
    return idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * doc_len / avgdl))


def asked_words(wanted: DataFrame, chunks: Index) -> DataFrame:
    """token, df, n, avgdl, idf of BM25 and smooth of the wanted tokens that the corpus has."""
    post = chunks.bags.select(F.explode("postings.token").alias("token")).join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
    words = document_frequency(post).crossJoin(F.broadcast(corpus_stats(chunks)))  # one row
    n, df = F.col("n"), F.col("df")
    return words.withColumn("idf", best.natural_log(1 + (n - df + 0.5) / (df + 0.5))).withColumn("smooth", best.natural_log((n + 1) / (df + 1)) + 1)


def in_order(token: str, score: str) -> Column:
    """Sum of ``score`` in the order of ``token``."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(token, score))), F.lit(0.0), lambda a, x: a + x[score])


def exact(score: Column) -> tuple[Column, Column]:
    """Sums of scores of up to 2**40 as two sums of whole numbers: no order changes them, and they combine before the shuffle."""
    high = F.floor(score * 2.0**20)
    return F.sum(high).alias("high"), F.sum(F.round((score * 2.0**20 - high) * 2.0**40).cast("long")).alias("low")


def value(high: Column, low: Column) -> Column:
    return high / F.lit(2.0**20) + low / F.lit(2.0**60)


def exact_sum(score: Column) -> Column:
    return value(*exact(score))


def contributions(queries: DataFrame, chunks: DataFrame | Index, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, token, tf, heading_tf, text_tf, idf, score of every token of a query in every chunk that has it,
    or in those of ``pairs`` (query_id, chunk_id)."""
    found, wanted = index(chunks), query_tokens(queries)
    asked = wanted.join(asked_words(wanted, found).select("token", "idf", "avgdl"), "token")
    post = postings(found)
    rows = asked.join(pairs, "query_id").join(post, ["token", "chunk_id"]) if pairs is not None else post.join(asked, "token")
    return rows.select("query_id", "chunk_id", "token", "tf", "heading_tf", "text_tf", "idf", bm25_part(F.col("idf"), F.col("tf"), F.col("doc_len"), F.col("avgdl")).alias("score"))


def factors(chunks: DataFrame) -> DataFrame:
    """chunk_id, factor of the chunks with unfinished headings."""
    return chunks.select("chunk_id", T.quality_factor(F.coalesce("heading", F.lit(""))).alias("factor")).where("factor < 1")


def bm25_scores(queries: DataFrame, chunks: DataFrame | Index, raw: bool = False) -> DataFrame:
    """query_id, chunk_id, score > 0 of every chunk; unfinished headings count 0.35 unless ``raw``."""
    found = index(chunks)
    sums = contributions(queries, found).groupBy("query_id", "chunk_id").agg(in_order("token", "score").alias("score"))
    if not raw:
        sums = sums.join(factors(found.chunks), "chunk_id", "left").select("query_id", "chunk_id", (F.col("score") * F.coalesce("factor", F.lit(1.0))).alias("score"))
    return sums.where("score > 0")


def stated(queries: DataFrame, found: Index) -> tuple[list, list[tuple], DataFrame, tuple]:
    """(query_ids, (token, df, idf, smooth, numbers of its queries), query_ids with their numbers as ``list``, (n, avgdl)).

    Questions are a stated set, which the driver reads and every task gets."""
    wanted = scratch_table(query_tokens(queries), "questions")
    ids = [r[0] for r in wanted.select("query_id").distinct().collect()]
    numbers = best.numbered(ids, wanted.schema["query_id"].dataType, queries.sparkSession)
    same = wanted["query_id"].eqNullSafe(numbers["query_id"])
    asked = wanted.join(F.broadcast(numbers), same).groupBy("token").agg(F.collect_list("list").alias("lists"))
    words = asked.join(asked_words(wanted, found), "token").select("token", "idf", "smooth", "lists", "n", "avgdl").collect()
    return ids, words, numbers, (words[0]["n"], words[0]["avgdl"]) if words else (0, 1.0)


def search(queries: DataFrame, chunks: DataFrame | Index, k: int, raw: bool = False, idf_only: bool = False, seed: int = SEED) -> DataFrame:
    """query_id, chunk_id, score, rank of the ``k`` best chunks of each query with a score over 0; ties to the smaller chunk_id.

    BM25 by default, with the factor of unfinished headings unless ``raw``; ``idf_only``: IDF of the tokens matched in the text
    plus those matched in the heading, without factor. Every chunk is scored, and its terms are added in the order of their tokens."""
    found = index(chunks)
    ids, words, numbers, (_, avgdl) = stated(queries, found)
    form = None if idf_only else (K1, B, HEADING_REPEAT, avgdl, raw)
    asked = [(w["token"], w["smooth" if idf_only else "idf"], w["lists"]) for w in words]
    tried = best.token_best(found.bags, asked, max(1, len(ids)), [form], k, True)
    near = top(tried.join(F.broadcast(numbers), "list").select("query_id", "chunk_id", "score"), k)
    return scratch_table(near, "near")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query with their rank; ties to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
