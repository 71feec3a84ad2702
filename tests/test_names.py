"""Names, paths, follow-up questions, answer formats and retrieval rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import names as N
from quillspark.operators import evaluation, lexical


@pytest.fixture(scope="module")
def of(spark):
    def run(build, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r["y"] for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_names(of):
    assert of(N.title, "a\n# B  \n# C", "## no", "", None, "# \nx") == ["B", None, None, None, ""]
    assert of(N.canonical, " a\r\nb \r", "a  b", "", None) == ["a\nb", "a  b", "", None]
    assert of(N.label, 'a[b]  "c"', "", "x" * 70, None) == ["a·b· ·c·", "未命名", "x" * 60, "未命名"]
    assert of(lambda x: N.file_name(x, F.lit("f")), "a/b?.", " . ", "con", "y" * 99, "") == ["a_b_", "f", "收藏-con", "y" * 80, "f"]
    assert of(lambda x: N.same_title(x, F.lit("检索")), "检索.MD", "检索.docx", "检索2", None) == [True, True, False, None]
    assert of(lambda x: F.array_join(N.tags(F.split(x, ",")), "|"), " a  b ,a b,,c", "") == ["a b|c", ""]
    assert of(N.follows_up, "它呢", "那么如何？", "什么是RAG呢？！", "什么是RAG", "") == [True, True, True, False, False]
    assert of(N.safe_member, "a/b.md", "../b", "a//b", "a/con.txt", "a\\b", "c:/x", "a/b.", "", "/a") == [True, False, False, False, False, False, False, False, False]


def test_answer_formats(spark):
    rows = [
        (0, "结论：x [S1]\n依据：y", "answer", ["S1"], [], ["S1"]),
        (1, "结论：x\n依据：资料不足", "answer", [], [], []),
        (2, "资料不足：没有", "abstain", [], [], []),
        (3, "资料不足：没有\n结论：有", "abstain", [], [], []),
        (4, "资料冲突：可能 [S9]", "conflict", ["S9"], ["S9"], ["S9"]),
        (5, "结论：x\n依据：y [S2][S1]", "answer", ["S2", "S1"], [], ["S1", "S2"]),
    ]
    df = spark.createDataFrame([(*r, []) for r in rows], "i int, answer string, expected string, labels array<string>, invalid array<string>, required array<string>, must_mention array<string>")
    got = {r["i"]: r for r in evaluation.score_formats(df).collect()}
    assert [got[i]["passed"] for i in range(6)] == [True, False, True, False, False, False]
    assert not got[4]["citations_available"] and not got[4]["no_speculation"] and got[4]["behavior_correct"]
    assert got[5]["format_correct"] and not got[5]["citations_exact"]


def test_retrieval_cases(spark):
    q = spark.range(4).withColumnRenamed("id", "query_id")
    pairs = lambda rows: spark.createDataFrame(rows, "query_id long, source string")
    got = evaluation.retrieval_cases(q, pairs([(0, "a"), (0, "a"), (1, "b")]), pairs([(0, "a"), (0, "a"), (0, "c"), (1, "c"), (2, "a")]))
    assert sorted(tuple(r) for r in got.collect()) == [(0, True, 2, 1, True), (1, True, 1, 0, False), (2, False, 1, 0, False), (3, False, 0, 0, True)]
    assert tuple(evaluation.case_summary(got).first()) == (2, 2, 0.5, 0.5)
    assert tuple(evaluation.case_summary(got.limit(0)).first()) == (0, 0, None, None)


def test_lenient_rank(spark):
    q = spark.createDataFrame([(1, ["red", "fox"]), (2, []), (3, ["owl"])], "query_id long, keywords array<string>")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, chunk_id long, rank int")
    texts = spark.createDataFrame([(10, "red hen"), (11, "Red Fox"), (12, None)], "chunk_id long, text string")
    assert sorted((r[0], r[1]) for r in evaluation.lenient_rank(q, hits, texts).collect()) == [(1, 2), (2, None), (3, None)]


def test_scores_sum_exactly_in_any_order(spark):
    values = [0.1 * i + 1e-9 * i * i for i in range(1, 400)]
    df = spark.createDataFrame([(v,) for v in values] , "x double")
    sums = {df.repartition(n, "x").agg(lexical.exact_sum(F.col("x"))).first()[0] for n in (1, 3, 7)}
    assert len(sums) == 1 and abs(sums.pop() - sum(values)) < 1e-9


def test_search_on_edges(spark):
    q = spark.createDataFrame([(1, "red fox"), (2, ""), (3, None)], "query_id long, query string")
    schema = "chunk_id long, heading string, text string, query_id string"
    some = spark.createDataFrame([(1, None, "red red", "x"), (2, "Fox", None, "x"), (3, "", "", "x"), (4, None, "red red", "x")], schema)
    best = lexical.top(lexical.bm25_scores(q, some), 10).orderBy("rank").collect()
    assert {r["query_id"] for r in best} == {1} and {r["chunk_id"] for r in best} == {1, 2, 4}
    same = [r for r in best if r["chunk_id"] in (1, 4)]
    assert same[0]["score"] == same[1]["score"] and same[0]["chunk_id"] == 1
    assert lexical.bm25_scores(q, spark.createDataFrame([], schema)).count() == 0
