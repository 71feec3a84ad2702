"""Training records, their checks, labels and batches."""

import importlib

from pyspark.sql import functions as F

from quillspark.operators import datasets, training

SCHEMA = "id string, group_id string, category string, question string, sources array<struct<label:string,text:string>>, expected_behavior string, conclusion string, must_mention array<string>, required_citations array<string>"


def made(spark):
    rows = [
        ("a", "g", "c", "Q?", [("S1", "one"), ("S2", "two")], "answer", "It is One.", ["one"], ["S2", "S1"]),
        ("b", "g", "c", "Q?", [("S1", "one")], "abstain", "", [], []),
        ("d", "g", "c", "Q?", [("S1", "one"), ("S3", "two")], "conflict", "they differ.", [], ["S1", "S3"]),
    ]
    return training.records(spark.createDataFrame(rows, SCHEMA))


def test_records_and_checks(spark):
    rows = made(spark)
    got = {r["id"]: r for r in rows.collect()}
    assert got["a"]["response"] == "结论：It is One.\n依据：[S2][S1]" and got["b"]["response"] == training.ABSTAIN and got["d"]["response"] == "资料冲突：they differ.[S1][S3]"
    assert got["a"]["messages"][1]["content"] == "问题：Q?\n\n证据：\n[S1]\none\n\n[S2]\ntwo" and got["a"]["available_citations"] == ["S1", "S2"]
    assert training.violations(rows).count() == 0
    bad = rows.withColumns({"group_id": F.lit(None).cast("string"), "response": F.lit("x"), "expected_behavior": F.when(F.col("id") == "d", "other").otherwise(F.col("expected_behavior"))})
    broken = {r["id"]: r["broken"] for r in training.violations(bad).collect()}
    assert broken["a"] == ["fields", "mentions", "contract"] and broken["b"] == ["fields", "mentions", "contract"] and broken["d"] == ["fields", "behaviour"]


def test_labels_cover_the_answer_alone(spark):
    rows = made(spark)
    alphabet = datasets.vocabulary(rows.select(F.concat(training.prompt_text(F.col("messages")), "response").alias("text")))
    ids = {r["char"]: r["id"] for r in alphabet.collect()}
    for r in training.character_labels(rows, alphabet, 70).join(rows, "id").collect():
        prompt = "".join(f"<|{m['role']}|>\n{m['content']}\n" for m in r["messages"]) + "<|assistant|>\n"
        answer = [ids[c] for c in r["response"]] + [datasets.END]
        assert r["input_ids"] == [ids[c] for c in prompt] + answer and r["labels"] == [datasets.IGNORE] * len(prompt) + answer
        assert (r["prompt_tokens"], r["response_tokens"]) == (len(prompt), len(answer)) and r["fits"] == (len(prompt) + len(answer) <= 70)


def test_labels_by_a_tokenizer(spark):
    from tokenizers import Tokenizer

    path = importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = made(spark)
    for r in training.token_labels(rows, path, 0, 512).join(rows, "id").collect():
        answer = [*model.encode(r["response"], add_special_tokens=False).ids, 0]
        assert r["input_ids"][-len(answer) :] == answer and r["labels"] == [-100] * r["prompt_tokens"] + answer and r["fits"]


def test_batches_are_padded_to_their_longest(spark):
    rows = [(f"e{k}", list(range(1, k % 7 + 2)), [5] * (k % 7 + 1)) for k in range(600)]
    df = spark.createDataFrame(rows, "id string, input_ids array<int>, labels array<int>")
    got = training.batches(df.repartition(5), 4).collect()
    assert len(got) == 600 and {r["id"] for r in got} == {i for i, *_ in rows}
    groups = {}
    for r in got:
        groups.setdefault(r["batch"], []).append(r)
    own = {i: x for i, x, _ in rows}
    for batch in groups.values():
        n = max(len(own[r["id"]]) for r in batch)
        assert len(batch) <= 4 and sorted(r["place"] for r in batch) == list(range(len(batch)))
        for r in batch:
            x = own[r["id"]]
            assert r["length"] == n and r["input_ids"] == x + [0] * (n - len(x)) and r["attention"] == [1] * len(x) + [0] * (n - len(x)) and r["labels"][len(x) :] == [-100] * (n - len(x))
    again = {(r["batch"], r["place"]): r["id"] for r in training.batches(df.repartition(2), 4).collect()}
    assert again == {(r["batch"], r["place"]): r["id"] for r in got}


def test_case_problems(spark):
    rows = [(1, "a", "x"), (2, "a", " x\r\n"), (3, "b", "y"), (3, "a", "z"), (4, "a", " "), (5, None, "v"), (6, "a", None), (7, "a", "fine")]
    got = {(r["id"], r["problem"]) for r in training.case_problems(spark.createDataFrame(rows, "id long, category string, text string"), ("a",)).collect()}
    assert got == {(2, "repeated text"), (3, "category"), (3, "repeated id"), (4, "empty"), (5, "empty"), (6, "empty")}


def test_losses(spark):
    rows = [("a", 1.0, True, True, False), ("a", 3.0, True, False, True), ("a", 9.0, False, True, True), ("b", 5.0, False, True, False), ("c", 800.0, True, True, False)]
    df = spark.createDataFrame(rows, "k string, loss double, counted boolean, correct boolean, unknown boolean")
    got = {r["k"]: tuple(r)[1:] for r in training.loss_figures(df, "k").collect()}
    assert got["a"][0] == 2 and got["a"][1] == 2.0 and abs(got["a"][2] - 7.389056) < 1e-6 and got["a"][3:] == (0.5, 0.5)
    assert got["b"] == (0, None, None, None, None) and got["c"][2] is None


def test_split_keeps_groups_whole(spark):
    from quillspark.operators import tables

    rows = [(k, f"g{k % 9}", f"text {k}") for k in range(90)] + [(200, "g1", "text 5 "), (201, None, "null group"), (202, "g2", "")]
    df = spark.createDataFrame(rows, "id long, grp string, text string")
    got = training.split_documents(df, "grp", 0.2, tables.grouped_split).collect()
    assert {r["id"] for r in got} == set(range(90))
    sides = {}
    for r in got:
        sides.setdefault(r["grp"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {"validation"} for s in sides.values()) == 2


def oracle(path, tables, sql):
    """Rows of ``sql`` over Parquet tables of a folder."""
    import duckdb

    with duckdb.connect() as con:
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
        return sorted(con.execute(sql).fetchall(), key=str)


def test_split_of_odd_documents_is_that_of_the_sql(spark, tmp_path):
    """Empty, blank and null texts, other white space at the ends, repeated ids and texts without a language or source."""
    from quillspark.jobs import catalog, training as jobs  # noqa: F401

    rows = [(k, f"text {k % 50}", "en", f"s{k % 9}") for k in range(90)]
    rows += [(100, "", "en", "s1"), (101, " \n", "en", "s2"), (102, None, "fr", "s1"), (103, None, "fr", "s2"), (104, "text 3\u00a0", "en", "s3"), (105, "\x0btext 3", "en", "s3")]
    rows += [(106, "own\r\n", "de", "s1"), (107, "own", "de", "s1"), (108, "twice", "de", "s2"), (108, "again", "de", "s2"), (109, "lost", None, "s4"), (110, "lost too", "en", None), (None, "no id", "en", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["d5_split"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == oracle(tmp_path, ["documents"], catalog.SQL["d5_split"])


def test_codes_are_made_without_joins_and_of_any_character(spark):
    """Prompt and answer are coded in one pass over the rows, on more tasks than a small file has; texts of batches are shuffled, not their ids."""
    alphabet = spark.createDataFrame([("a", 3), ("中", 4), ("😀", 5)], "char string, id int")
    rows = spark.createDataFrame([(1, "a中", "😀b"), (2, "", "a"), (3, None, "x" * 3), (1, "中", "")], "id long, asked string, said string")
    got = [tuple(r) for r in datasets.coded(rows, alphabet, prompt=("asked", False), answer=("said", True)).collect()]
    assert sorted(got, key=str) == sorted([(1, [3, 4], [5, 1, 2]), (2, [], [3, 2]), (3, None, [1, 1, 1, 2]), (1, [4], [2])], key=str)
    plan = training.character_labels(made(spark), alphabet, 70)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert [tuple(r) for r in datasets.vocabulary(spark.createDataFrame([("b😀a",), (None,), ("",), ("aé",)], "text string")).collect()] == [("a", 3), ("b", 4), ("é", 5), ("😀", 6)]


def test_the_parts_are_dealt_anew(spark, tmp_path):
    from quillspark.jobs import training as jobs

    spark.range(40).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert jobs.cards(spark, str(tmp_path), 3).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
