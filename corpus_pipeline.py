"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, but for the last, which returns pieces
of packed sequences. Every stage reads whole texts of all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, packing, quality, toxicity
from quillspark.llm.common import materialize, text_session
from quillspark.llm.neardup import near_duplicates
from quillspark.llm.queries import table, tokenizer


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator works on, and the whole row beside them, so that no other name can clash."""
    return docs.select(*columns, F.struct(*docs.columns).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. Null and empty texts have no toxic word and stay; equal texts go or stay alike."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    weights = toxicity.train(docs, labels, toxicity.CATEGORIES)
    names = [f"p_{c}" for c in toxicity.CATEGORIES]
    return toxicity.score(_rows(docs, "text"), weights, names).where(F.col(names[-1]) <= toxicity.THRESHOLD).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores at least 0.3; null text counts as empty, equal texts go or stay alike."""
    weights, _ = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(_rows(docs, "text"), weights).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates; documents without an id all stay.

    Texts of one doc_id are one document and stay or go together; of its rows with the same text one stays, the one whose other
    columns come first as JSON."""
    text_session(spark)
    dropped = near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    once = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = once.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    rows = once.join(repeated, "doc_id", "left_semi").select(docs.columns).groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), others).alias("row"))
    return once.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(rows.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it; null and empty texts cost nothing and stay at least once where their source is not cut."""
    sized = _rows(docs, "doc_id", "source", "text").select("doc_id", "source", mixing.words(F.col("text")).alias("size"), "row")
    sized = sized.withColumn("weight", mixing.inclusion(F.col("size")))
    mixed = mixing.mix(sized, weight="weight", stats=materialize(sized.drop("row"), "sizes")).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids; null text is empty and has its end id alone; a repeated row is packed each time."""
    text_session(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer("bytes"), window=1024, end_id=0)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

#: The classifiers and the tokenizer have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
