"""Searches by bounds against all scores, sub-questions, sweeps, highlights and trees on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation, fusion, lexical, studio


def corpus(spark, n=150, seed=2):
    """Chunks of frequent and rare words, some with an unfinished heading, some equal, one empty and one null."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 60)))
    rows = [(k, rng.choice(["w1 head", "待继续拆分", "other"]), text()) for k in range(n)]
    rows += [(n + k, *rows[3][1:]) for k in range(5)] + [(900, "h", ""), (901, None, None)]
    return spark.createDataFrame(rows, "chunk_id long, heading string, text string")


def questions(spark):
    rng = random.Random(7)
    rows = [(q, " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(8))) for q in range(12)] + [(90, ""), (91, None), (92, "nothing known")]
    return spark.createDataFrame(rows, "query_id long, query string")


@pytest.mark.parametrize("k,seed", [(1, 1), (5, 20), (10, 100_000), (400, 10)])
def test_search_finds_the_best_of_all(spark, k, seed):
    chunks, asked = lexical.index(corpus(spark)), questions(spark)
    for raw in (False, True):
        want = {tuple(r) for r in lexical.top(lexical.bm25_scores(asked, chunks, raw), k).collect()}
        got = [tuple(r) for r in lexical.search(asked, chunks, k, raw, seed=seed).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_search_leaves_frequent_words_to_the_last(spark, monkeypatch):
    """A rare word that few chunks hold decides, and the frequent one brings no chunk of its own."""
    rows = [(k, "", "common " * 3 + ("rare unique" if k < 3 else f"filler{k}")) for k in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, heading string, text string")
    seen, keep = [], lexical.scratch_table

    def watched(df, label):
        table = keep(df, label)
        if label == "near":
            seen.append(table.count())
        return table

    monkeypatch.setattr(lexical, "scratch_table", watched)
    asked = spark.createDataFrame([(1, "common rare unique")], "query_id long, query string")
    got = lexical.search(asked, chunks, 3).collect()
    assert sorted(r["chunk_id"] for r in got) == [0, 1, 2] and seen == [3]


def test_posting_rows(spark):
    rows = [(1, "a b", "b c c"), (2, None, ""), (3, "x", None)]
    got = {tuple(r) for r in lexical.posting_rows(spark.createDataFrame(rows, "chunk_id long, heading string, text string")).collect()}
    assert got == {(1, "a", 1, 0, 7, 2), (1, "b", 1, 1, 7, 2), (1, "c", 0, 2, 7, 2), (2, "", 0, 0, 0, 0), (3, "x", 1, 0, 2, 1)}
    plan = lexical.posting_rows(spark.createDataFrame(rows, "chunk_id long, heading string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sub_questions(spark):
    rows = [(1, "", "rag rag"), (2, "", "agent agent"), (3, "", "tools"), (4, "", "rag agent")]
    chunks = spark.createDataFrame(rows, "chunk_id long, heading string, text string")
    asked = spark.createDataFrame([(1, "rag和agent分别用"), (2, "rag agent"), (3, "分别rag"), (4, None)], "query_id long, query string")
    got = [tuple(r) for r in fusion.multi_query(asked, chunks, each=2, k=3).select("query_id", "parts", "chunk_id", "score", "rank").collect()]
    of = lambda q: [(c, r) for i, _, c, _, r in sorted(got, key=lambda x: (x[0], x[4])) if i == q]
    # 4 is second for both parts, 1 and 2 first for one each
    assert of(1) == [(4, 1), (1, 2), (2, 3)] and {p for i, p, *_ in got if i == 1} == {2}
    assert [s for i, _, c, s, _ in got if i == 1 and c == 4] == [1 / 62 + 1 / 62]
    assert of(2)[0] == (4, 1) and {p for i, p, *_ in got if i == 2} == {1} and of(3) and not of(4)


def test_sweep_equals_single_searches(spark):
    chunks, asked = lexical.index(corpus(spark)), questions(spark).where("query_id < 90")
    good = asked.select("query_id", ((F.col("query_id") * 7) % 150).alias("chunk_id"))
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(150)], "chunk_id long, vec array<double>")
    qv = asked.select("query_id", F.array(F.lit(1.0), F.lit(0.5)).alias("qvec"))
    settings = [{"name": "a", "mode": "bm25"}, {"name": "b", "mode": "bm25", "k1": 0.5, "top_k": 40}, {"name": "h", "mode": "hybrid"}, {"name": "i", "mode": "hybrid", "rrf_k": 5, "candidates": 20}]
    got = {r["setting"]: r for r in evaluation.sweep(asked, good, chunks, qv, vectors, settings).collect()}
    plain = evaluation.summary(evaluation.expected_rank(lexical.search(asked, chunks, 10), good)).first()
    assert [got["a"][c] for c in ("questions", "recall_1", "recall_8", "mrr")] == [plain[c] for c in ("questions", "recall_1", "recall_8", "mrr")]
    hybrid = evaluation.summary(evaluation.expected_rank(fusion.hybrid(asked, chunks, qv, vectors), good)).first()
    assert got["h"]["mrr"] == hybrid["mrr"] and (got["a"]["better"], got["a"]["worse"]) == (0, 0)
    with pytest.raises(ValueError):
        evaluation.sweep(asked, good, chunks, qv, vectors, [{"name": "a", "mode": "bm25"}, {"name": "a", "mode": "bm25"}])


def test_highlight(spark):
    def pieces(text, tokens):
        df = spark.createDataFrame([(text, tokens)], "x string, t array<string>")
        return [tuple(p) for p in df.select(T.highlighted(F.col("x"), F.col("t")).alias("p")).first()["p"] or []]

    assert pieces("ABCabcd", ["ab", "abc", "", None]) == [("ABC", True), ("abc", True), ("d", False)]
    assert pieces("a.b a+b", ["a.b", "+"]) == [("a.b", True), (" a", False), ("+", True), ("b", False)]
    assert pieces("plain", []) == [("plain", False)] and pieces("", ["a"]) == [("", False)] and pieces(None, ["a"]) == []
    assert pieces("x\\Ey 中文检索", ["\\e", "文检"]) == [("x", False), ("\\E", True), ("y 中", False), ("文检", True), ("索", False)]


def test_mindmap_is_in_tree_order(spark):
    rows = [("r", ["b", "x"], 1), ("r", ["a"], 2), ("r", ["b", "w", "deep"], 3), ("r", ["b", "x"], 4), ("q", [], 5)]
    got = studio.mindmap(spark.createDataFrame(rows, "t string, segments array<string>, source long"), "t").collect()
    assert [tuple(r) for r in got] == [("r", "mindmap\n  root((r))\n    b 3\n      x 2\n      w 1\n        deep 1\n    a 1")]
    wide = spark.createDataFrame([("r", [f"n{k:02d}"], k) for k in range(12)], "t string, segments array<string>, source long")
    assert studio.mindmap(wide, "t").first()["mermaid"].split("\n")[2:4] == ["    n00 1", "    n01 1"]
