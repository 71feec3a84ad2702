import corpus_pipeline
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import queries
from quillspark.llm.common import materialize

from .test_classifiers import corpus
from .test_neardup import brute
from .test_packing import held

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, data, extra=()):
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, *_ in data]
    docs += [(1000 + i, t, "en", "s1", len(t)) for i, t, *_ in data[:20]] + list(extra)  # exact copies
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {i: (q, t) for i, _, q, t in data}


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    extra = [(None, None, None, None, None), (3000, None, "en", None, 0), (3001, "", None, "s1", 0), (7, "ka lo mi", "en", "s3", 3)]
    truth = tables(spark, folder, corpus(400), extra)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = map(ids, seen["toxicity"])
    assert sum(truth[i][1] for i in truth if i in before - after) > 0.9 * sum(t for _, t in truth.values())
    assert sum(not truth[i][1] for i in truth if i in before - after) < 0.03 * len(truth)
    before, after = map(ids, seen["quality"])
    assert sum(truth[i][0] for i in truth if i in before - after) < 0.03 * len(truth)
    before, after = (df.select("doc_id", "text").collect() for df in seen["near_duplicates"])
    component = brute([tuple(r) for r in before])
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(set(component.values()))
    before, after = (df.withColumn("w", F.regexp_count("text", F.lit(r"\S+"))).groupBy("source").agg(F.sum("w").alias("w")).collect() for df in seen["mixing"])
    assert abs(sum(r["w"] or 0 for r in before) - sum(r["w"] or 0 for r in after)) < 0.1 * sum(r["w"] or 0 for r in before)
    mixed, pieces = seen["packing"]
    held(pieces.collect(), [(r["doc_id"], r["text"]) for r in mixed.select("doc_id", "text").collect()], 1024)
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "start", "length").collect()
    assert sorted(whole, key=repr) == sorted(pieces.select("doc_id", "start", "length").collect(), key=repr)


def test_empty_tables_and_clashing_names(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder, corpus(60))
    empty = spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
    odd = spark.read.parquet(f"{folder}/documents.parquet").select("*", *[F.lit(1).alias(c) for c in ("score", "size", "target", "copies", "row", "p_toxic", "component", "kept", "rank")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert out.count() and (name == "packing" or out.columns == odd.columns)


def test_every_operator_has_a_query():
    assert sorted({int(k[2:].split("_")[0]) for k in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
