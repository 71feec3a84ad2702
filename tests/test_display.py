"""Text shown to readers, and updates of the relational plane, on hand-made rows."""

from pyspark.sql import functions as F

from quillspark.functions import display as D
from quillspark.operators import plane


def shown(spark, build, *values, kinds="string"):
    columns = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, kinds.split("|") * len(columns), strict=False))
    return spark.createDataFrame([tuple(values)], schema).select(build(*map(F.col, columns)).alias("y")).first()["y"]


def test_concepts(spark):
    assert shown(spark, D.separate_concepts, "MQA, GQA and MQA 分别 是什么 X1") == ["MQA", "GQA", "and"]
    assert shown(spark, D.separate_concepts, "no such word") == [] and shown(spark, D.separate_concepts, None) == []
    cover = lambda answer, names: shown(spark, D.covers_separately, answer, names, kinds="string|array<string>")
    assert cover("- **MQA**: a\n2) gqa b", ["MQA", "GQA"]) and cover("x", [])
    assert not cover("- MQA 和 GQA: a\n- GQA b", ["MQA", "GQA"])
    assert not cover("MQA a\n- GQA b", ["MQA", "GQA"]) and not cover("- MQA-2 a", ["MQA"]) and not cover("- see MQA", ["MQA"])


def test_links_and_places(spark):
    link = lambda text, labels: shown(spark, D.citation_links, text, labels, kinds="string|array<string>")
    assert link("a [S1] [S9] [S1, S2]", ["S1", "S2"]) == "a [[S1]](#cite-S1) [S9] [S1, S2]" and link("[S1]", []) == "[S1]"
    assert [shown(spark, D.safe_url, u) for u in ("HTTPS://x", "javascript:x", "#cite-S1", "ftp://x")] == ["HTTPS://x", "", "#cite-S1", ""]
    at = lambda kind, origin=None, published=None: shown(spark, D.place, kind, 4, 7, 10, 12, origin, published, kinds="string|int|int|int|int|string|string")
    assert at("pdf") == "第 4 页" and at("notebook") == "单元格 7 · 第 10–12 行" and at("markdown") == "第 10–12 行"
    assert at("memory") == "来自记忆" and at("memory", "chat") == "来自记忆 · chat" and at("web") == "发布时间未知" and at("web", None, "2024-05-06T07") == "发布于 2024-05-06"


def test_figures_and_errors(spark):
    cell = lambda kind, rate, nodes: shown(spark, D.rate_cell, kind, rate, nodes, kinds="string|double|int")
    assert cell("guide", 0.5, 3) == "50.0%" and cell("guide", None, 3) == "—" and cell("mindmap", 0.5, 3) == "3" and cell("mindmap", 0.5, 0) == "—"
    assert shown(spark, D.short_time, "2024-05-06T07:08:09") == "2024-05-06 07:08" and shown(spark, D.short_time, "") == "未记录"
    assert shown(spark, D.error_code, "no Ollama here") == "ollama_unavailable" and shown(spark, D.error_code, "x") == "generation_failed"
    assert shown(spark, D.measured, "12.5") == 12.5 and shown(spark, D.measured, "-1") is None and shown(spark, D.measured, "x") is None
    assert shown(spark, lambda t: D.private(t, "vault"), 'a "C:\\\\Users\\\\me\\\\x"') and not shown(spark, lambda t: D.private(t, "vault"), "plain")
    note = shown(spark, D.reduction_note, 5, 3, 8192, kinds="long|long|int")
    assert note.startswith("模型上下文窗口为 8192 token，证据从 5 条减到 3 条") and shown(spark, D.reduction_note, 3, 3, 8192, kinds="long|long|int") is None
    got = shown(spark, D.phases, {"a": 1.0, "total_ms": 5.0}, 10.0, 1.0, 12.0, kinds="map<string,double>|double|double|double")
    assert got == {"prepare_a": 1.0, "prepare_total_ms": 5.0, "generation_wall_ms": 10.0, "finalize_ms": 1.0, "runtime_overhead_ms": 0.0, "runtime_total_ms": 12.0}


def test_batches_report_every_request(spark):
    table = spark.createDataFrame([(1, "x"), (2, "busy"), (3, "x"), (3, "x")], "id long, state string")
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,), (None,)], "id long")
    left, report = plane.delete_batch(table, "id", ids, F.col("state") == "busy")
    assert {tuple(r) for r in report.collect()} == {(1, "deleted"), (2, "busy"), (3, "deleted"), (9, "not_found")}
    assert [tuple(r) for r in left.collect()] == [(2, "busy")]


def test_disconnect_keeps_rows(spark):
    libraries = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "library string, active boolean")
    documents = spark.createDataFrame([(1, "a", False, "ready"), (2, "a", True, "removed"), (3, "b", False, "ready")], "document_id long, library string, removed boolean, status string")
    off, left, report = plane.disconnect(libraries, documents, spark.createDataFrame([("a",), ("c",), ("z",)], "library string"))
    assert {tuple(r) for r in off.collect()} == {("a", False), ("b", True), ("c", False)}
    assert sorted(tuple(r) for r in left.collect()) == [(1, "a", True, "removed"), (2, "a", True, "removed"), (3, "b", False, "ready")]
    assert {tuple(r) for r in report.collect()} == {("a", "disconnected", 1), ("c", "not_found", 0), ("z", "not_found", 0)}


def test_favorites_are_copies(spark):
    messages = spark.createDataFrame([(1, "user", "complete", " How  so? ", None), (2, "assistant", "complete", "So [S1]", 1), (3, "assistant", "stopped", "x", 1), (4, "assistant", "complete", "y", 1)], "message_id long, role string, status string, text string, reply_to long")
    sources = spark.createDataFrame([(2, 1, "d"), (3, 1, "d")], "message_id long, position int, document_id string")
    asked = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 4, 9)], "message_id long")
    made, copied, report = plane.copy_favorites(asked, messages, sources)
    assert [tuple(r) for r in made.collect()] == [(2, "How so?", " How  so? ", "So [S1]", 1)] and [r["message_id"] for r in copied.collect()] == [2]
    assert {tuple(r) for r in report.collect()} == {(1, "not_found"), (2, "copied"), (3, "not_complete"), (4, "no_sources"), (9, "not_found")}


def test_filters_keep_all_choices(spark):
    rows = [(1, ["l"], ["t"], "useful", 5), (2, ["m", "l"], [], None, 9), (3, [], ["u"], "useful", 9)]
    df = spark.createDataFrame(rows, "id long, libraries array<string>, tags array<string>, feedback string, updated_at long")
    kept, choices = plane.filter_favorites(df, library="l", feedback="useful", since=F.lit(5))
    assert [r["id"] for r in kept.collect()] == [1]
    assert {tuple(r) for r in choices.collect()} == {("library", "l"), ("library", "m"), ("tag", "t"), ("tag", "u"), ("total", "3")}
