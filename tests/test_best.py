"""Searches whose scores are equal on paper against their SQL, and what a task hands on."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.jobs import catalog, search  # noqa: F401
from tests.test_training import oracle

TABLES = ("documents", "benchmark", "embeddings")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Words in as many documents each, so that sums of different words differ by the order of their terms alone."""
    rng, path = random.Random(3), tmp_path_factory.mktemp("ties")
    words = [f"w{k:02d}" for k in range(48)]
    sizes = [12, 17, 23, 31, 47, 58]
    held = [set() for _ in range(240)]
    for k, w in enumerate(words):
        for i in rng.sample(range(240), sizes[k % len(sizes)]):
            held[i].add(w)
    docs = [(i, " ".join(rng.sample(sorted(h), len(h))), f"s{i % 3}") for i, h in enumerate(held)]
    asked = [(i, " ".join(rng.sample(words, 24))) for i in range(12)]
    asked[4] = (4, docs[9][1])
    vectors = [(i, [float(x) for x in rng.choices((-0.1, 0.2, 0.7), k=5)]) for i in range(240)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, source string"), ("benchmark", asked, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["r1_search_idf", "r3_search_bm25", "r4_vector_search", "r6_hybrid", "r13_compare", "r14_sweep"])
def test_ties_are_those_of_the_sql(spark, folder, name):
    got = sorted((tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()), key=str)
    assert got == oracle(folder, TABLES, catalog.SQL[name])


def test_a_task_hands_on_its_best(spark):
    """Every chunk meets every question, and no more than the k best of a task leave it."""
    from quillspark.operators import best, lexical

    bags = lexical.bag_rows(spark.range(3000).selectExpr("id AS chunk_id", "'' AS heading", "concat('common ', id % 50) AS text").repartition(3))
    asked = [("common", 1.0, list(range(20))), ("7", 0.5, [3])]
    forms = [None, (1.5, 0.75, 1, 2.0, True)]
    rows = best.token_best(bags, asked, 20, forms, 5, True)
    assert rows.count() == 3 * 20 * 2 * 5
    assert {r["chunk_id"] % 50 for r in rows.where("list = 3").collect()} == {7}


def test_keeper_orders_like_sql():
    from quillspark.operators import best

    keeper = best.Keeper(2, 3)
    ids = pa.array([5, None, 1, 2, 3], pa.int64())
    keeper.add(np.array([0] * 5), np.array([1.0, 1.0, np.nan, 1.0, 9.0]), np.arange(5), ids, np.array([False, False, False, False, True]))
    keeper.add(np.array([1, 1]), np.array([0.0, -1.0]), np.array([0, 2]), ids, np.array([True, False]))
    out = keeper.batch(["list", "chunk_id", "score"], pa.int64()).to_pydict()
    assert out["list"] == [0, 0, 0, 1, 1] and out["chunk_id"] == [1, None, 2, 1, 5] and out["score"][1:] == [1.0, 1.0, -1.0, None]


def test_covered_is_covers_expected(spark):
    """Each keyword is looked for once a text: the pairs are those of the expression, for odd texts and keywords too."""
    from pyspark.sql import functions as F

    from quillspark.operators import evaluation

    texts = [(1, "The ABC cat"), (2, ""), (3, None), (4, "中文 the dog"), (5, "x"), (None, "the cat")]
    items = [(1, ["the", "Cat"]), (2, []), (3, ["中文", "cat", "dog"]), (4, ["", "the"]), (5, None), (6, ["the", None]), (7, ["中", "文", "zebra"]), (7, ["zebra"])]
    chunks, asked = spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(items, "query_id long, keywords array<string>")
    want = chunks.crossJoin(asked).select("query_id", "chunk_id", evaluation.covers_expected(F.col("text"), F.col("keywords")).alias("covers"))
    got = evaluation.covered(chunks, asked)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
