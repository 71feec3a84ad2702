"""The contract queries over the given tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from . import codes, mixing, negatives, vectors, warc
from .common import text_session

TOKENIZERS = {"words": "word_bpe_49k.json", "bytes": "byte_bpe_50k.json", "pieces": "piece_bpe_32k.model"}


def tokenizer(kind: str) -> str:
    return importlib.import_module("public_tokenizers").path(TOKENIZERS[kind])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    text_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector with all others."""
    from .vectors import exact_search

    return exact_search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=5)


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of every 50th vector among all others."""
    from .vectors import approximate_search

    return approximate_search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of 1024."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("bytes"), window=1024, end_id=0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to token files and read back."""
    from .huffman import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("words"), end_id=2))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; longer documents have higher odds."""
    from pyspark.sql import functions as F

    from .common import materialize
    from .mixing import inclusion, mix, words

    sized = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("size"))
    sized = materialize(sized.withColumn("weight", inclusion(F.col("size"))), "sizes")
    return mix(sized, weight="weight", stats=sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, written to archives and read back."""
    from .warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probabilities under the suffix tree and under word counts."""
    from .suffix_tree import train_and_score

    return train_and_score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the classifier chain."""
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the positive-unlabelled model."""
    from .quality import classify

    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' SentencePiece ids with begin and end, and the text decoded from them, as digests."""
    from pyspark.sql import functions as F

    from .pieces import decode, encode

    model = tokenizer("pieces")
    rows = decode(encode(table(spark, sf_dir, "documents", "doc_id", "text"), model), model)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's product code by ball k-means, its error and its label's."""
    from .codes import code_report

    return code_report(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives of each anchor's five positives, by cover trees."""
    from .negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


QUERIES = {"op1_near_duplicates": op1_near_duplicates, "op2_exact_top_k": op2_exact_top_k, "op3_toxicity": op3_toxicity, "op4_packing": op4_packing, "op5_token_files": op5_token_files, "op6_mixing": op6_mixing, "op7_hilbert_neighbours": op7_hilbert_neighbours, "op8_warc": op8_warc, "op9_suffix_tree": op9_suffix_tree, "op10_quality": op10_quality, "op11_ball_codes": op11_ball_codes, "op12_pieces": op12_pieces, "op13_hard_negatives": op13_hard_negatives}
SQL = {"op2_exact_top_k": vectors.SQL_EXACT, "op6_mixing": mixing.SQL, "op8_warc": warc.SQL, "op11_ball_codes": codes.sql(), "op13_hard_negatives": negatives.SQL}
