"""Registered queries of what readers are shown and of small checks: concepts, links, places, notes, timings, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import text as T
from ..operators import evidence
from .catalog import SQL_ANSWERS, SQL_BM25, SQL_CITED, answers, found, indexed, query, questions, read
from .plane import SQL_PLANE, tables


def terms(text):
    """The first three words of a turn, joined as a question that asks for each on its own."""
    w = F.split(text, " ")
    listed = F.array_join(F.filter(F.transform(F.slice(w, 1, 3), lambda x: F.regexp_replace(x, "[^A-Za-z]", "")), lambda x: F.length(x) > 1), " 、 ")
    return F.concat(listed, F.lit(" 分别 "), F.coalesce(F.get(w, 3), F.lit("")))


SQL_TERMS = """q AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, ' ')[1:3], lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')), lambda x: length(x) > 1) AS w FROM conversations),
c AS (SELECT conv_id, turn, text, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS concepts FROM q)"""


@query("p17_concepts", f"WITH {SQL_TERMS} SELECT conv_id, turn, array_to_string(concepts, ',') AS concepts FROM c")
def p17_concepts(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", terms(F.col("text")).alias("question"))
    return rows.select("conv_id", "turn", F.array_join(D.separate_concepts(F.col("question")), ",").alias("concepts"))


@query("p18_coverage", f"""WITH {SQL_TERMS}, n AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(concepts, lambda x: lower(x)))) AS names FROM c),
i AS (SELECT *, CASE WHEN turn % 3 = 0 THEN names WHEN turn % 3 = 1 THEN names[1:1] ELSE [] END AS alone, CASE WHEN turn % 3 = 1 AND len(names) > 1 THEN true ELSE false END AS pair FROM n)
SELECT conv_id, turn, CAST(len(names) AS INTEGER) AS concepts, len(list_filter(names, lambda x: NOT list_contains(alone, x))) = 0 AS covered FROM i""")
def p18_coverage(spark, d):
    """Answers that give every concept an item, only the first one (and the others joined in one), or none."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", terms(F.col("text")).alias("question"))
    rows = rows.withColumn("names", F.array_sort(F.array_distinct(F.transform(D.separate_concepts(F.col("question")), F.lower))))
    each = F.array_join(F.transform("names", lambda x: F.concat(F.lit("- **"), F.upper(x), F.lit("**: text"))), "\n")
    first = F.concat(F.lit("1. "), F.coalesce(F.get("names", 0), F.lit("")), F.lit(" alone\n- "), F.array_join(F.slice(F.array_sort("names"), 2, 9), " and "), F.lit(" together"))
    joined = F.concat(F.lit("- "), F.array_join("names", "、"), F.lit("\ntext"))
    single = F.when(F.size("names") == 2, F.concat(F.lit("1. "), F.get("names", 0), F.lit("\n* none"))).otherwise(first)
    answer = F.when(F.col("turn") % 3 == 0, each).when(F.col("turn") % 3 == 1, single).otherwise(F.when(F.size("names") > 1, joined).otherwise("text"))
    return rows.select("conv_id", "turn", F.size("names").alias("concepts"), D.covers_separately(answer, F.col("names")).alias("covered"))


@query("p27_links", f"WITH {SQL_ANSWERS} SELECT conv_id, turn, md5(regexp_replace(answer, '\\[(S1|S2|S3)\\]', '[\\0](#cite-\\1)', 'g')) AS digest FROM answers")
def p27_links(spark, d):
    """Citations of the three sources as links."""
    linked = D.citation_links(F.col("answer"), T.literals(("S1", "S2", "S3")))
    return answers(spark, d).select("conv_id", "turn", F.md5(linked.cast("binary")).alias("digest"))


@query("p27_urls", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '#cite-S' || page_id WHEN 2 THEN upper(url) ELSE url END AS target FROM pages")
def p27_urls(spark, d):
    """Link targets, some of other schemes."""
    n = F.col("page_id") % 4
    url = F.when(n == 0, F.concat(F.lit("javascript:"), "url")).when(n == 1, F.concat(F.lit("#cite-S"), "page_id")).when(n == 2, F.upper("url")).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", D.safe_url(url).alias("target"))


@query("p28_places", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '第 ' || user_id || ' 页' WHEN 1 THEN '单元格 ' || user_id || ' · 第 ' || event_id || '–' || (event_id + 3) || ' 行' WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN '来自记忆 · ' || event_type ELSE '来自记忆' END
  WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN '发布于 ' || strftime(ts, '%Y-%m-%d') ELSE '发布时间未知' END ELSE '第 ' || event_id || '–' || (event_id + 3) || ' 行' END AS place FROM events""")
def p28_places(spark, d):
    """Events as sources of every kind."""
    kind = F.element_at(T.literals(("pdf", "notebook", "memory", "web", "markdown")), (F.col("event_id") % 5 + 1).cast("int"))
    even = F.col("user_id") % 2 == 0
    label = D.place(kind, F.col("user_id"), F.col("user_id"), F.col("event_id"), F.col("event_id") + 3, F.when(even, F.col("event_type")), F.when(even, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    return read(spark, d, "events").select("event_id", label.alias("place"))


@query("p30_private", "SELECT page_id, page_id % 3 = 0 OR contains(html, 'vault_dir') OR contains(html, 'script') AS private FROM pages")
def p30_private(spark, d):
    """Pages with a user's folder put into every third, and with markers."""
    text = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(' "C:\\\\Users\\\\someone\\\\notes"'))).otherwise(F.col("html"))
    return read(spark, d, "pages").select("page_id", D.private(text, "vault_dir", "script").alias("private"))


@query("p32_previews", f"WITH {SQL_BM25} SELECT query_id, 'S' || rank AS label, md5(substr(text, 1, 360)) AS preview FROM bm25_top JOIN documents ON doc_id = chunk_id WHERE rank <= 10")
def p32_previews(spark, d):
    """Labels and previews of the hits."""
    rows = found(spark, d).join(indexed(spark, d).chunks.select("chunk_id", "text"), "chunk_id")
    return rows.select("query_id", F.concat(F.lit("S"), "rank").alias("label"), F.md5(F.substring("text", 1, D.PREVIEW).cast("binary")).alias("preview"))


@query("t4_matched_tokens", f"""WITH {SQL_BM25}, t AS (SELECT query_id, chunk_id FROM bm25_top WHERE rank <= 10)
SELECT query_id, t.chunk_id, string_agg(p.token, ' ' ORDER BY p.token) FILTER (text_tf > 0) AS in_text, string_agg(p.token, ' ' ORDER BY p.token) FILTER (heading_tf > 0) AS in_heading, string_agg(p.token, ' ' ORDER BY p.token) AS matched FROM t JOIN wanted USING (query_id) JOIN post p ON p.chunk_id = t.chunk_id AND p.token = wanted.token GROUP BY query_id, t.chunk_id""")
def t4_matched_tokens(spark, d):
    """A question's tokens that a hit has, in its text, in its heading, and in either."""
    i = indexed(spark, d)
    rows = found(spark, d).join(i.chunks, "chunk_id").join(questions(spark, d), "query_id")
    asked = T.tokenize_query(F.col("query"))
    shared = lambda c: F.array_sort(F.array_intersect(asked, T.tokenize(F.coalesce(c, F.lit("")))))
    rows = rows.select("query_id", "chunk_id", shared("text").alias("t"), shared("heading").alias("h"))
    flat = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    return rows.select("query_id", "chunk_id", flat("t").alias("in_text"), flat("h").alias("in_heading"), F.array_join(F.array_sort(F.array_union("t", "h")), " ").alias("matched"))


@query("e8_reduction", f"""WITH {SQL_BM25}, s AS (SELECT query_id, rank, CAST(octet_length(encode(source || trim(text, chr(10) || chr(32) || chr(9) || chr(13)))) AS BIGINT) AS bytes FROM bm25_top JOIN documents ON doc_id = chunk_id WHERE rank <= 10 AND length(trim(text, chr(10) || chr(32) || chr(9) || chr(13))) > 0),
u AS (SELECT *, sum(bytes) OVER (PARTITION BY query_id ORDER BY rank) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM s),
c AS (SELECT query_id, count(*) AS before, count(*) FILTER (n = 1 OR used <= 14080) AS after FROM u GROUP BY query_id)
SELECT query_id, CASE WHEN after < before THEN '模型上下文窗口为 8192 token，证据从 ' || before || ' 条减到 ' || after || ' 条；被减掉的条目没有参与生成。' END AS note FROM c""")
def e8_reduction(spark, d):
    """What a question is told of the sources that did not fit."""
    from .catalog import sources

    rows = sources(spark, d).select("query_id", "rank", F.col("source").alias("header"), F.col("content").alias("text"))
    kept = evidence.fit_evidence(rows, evidence.evidence_budget()).groupBy("query_id").agg(F.count("*").alias("after"))
    counts = rows.groupBy("query_id").agg(F.count("*").alias("before")).join(kept, "query_id")
    return counts.select("query_id", D.reduction_note(F.col("before"), F.col("after"), F.lit(8192)).alias("note"))


@query("x15_prompt", f"""WITH {SQL_BM25}, s AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, source, text FROM bm25_top JOIN documents ON doc_id = chunk_id WHERE rank <= 5)
SELECT query_id, md5(substr(string_agg('[S' || n || '] ' || source || ' → ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY n), 1, 9000)) AS digest, CAST(least(9000, length(string_agg('[S' || n || '] ' || source || ' → ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY n))) AS INTEGER) AS chars FROM s GROUP BY query_id""")
def x15_prompt(spark, d):
    """Evidence of the five best hits as one text, cut as a whole at 9,000 characters (E6)."""
    rows = found(spark, d).where("rank <= 5").join(indexed(spark, d).chunks, "chunk_id")
    each = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(F.col("heading").alias("title"), "heading", "text").alias("x")))), lambda s: s["x"])
    cut = F.substring(D.evidence_text(F.col("each")), 1, D.CHAT_CUT)
    return rows.groupBy("query_id").agg(each.alias("each")).select("query_id", F.md5(cut.cast("binary")).alias("digest"), F.length(cut).alias("chars"))


@query("g5_rates", """WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' WHEN event_id % 11 = 0 THEN NULL ELSE CAST(CAST(floor(value * 1000000) AS BIGINT) AS VARCHAR) END AS ns, CASE WHEN event_id % 5 = 0 THEN '-1' ELSE CAST(user_id AS VARCHAR) END AS n FROM events),
m AS (SELECT event_id, CASE WHEN regexp_matches(ns, '^[0-9]+$') THEN CAST(ns AS DOUBLE) / 1000000 END AS ms, CASE WHEN regexp_matches(n, '^[0-9]+$') THEN CAST(n AS DOUBLE) END AS tokens FROM r)
SELECT event_id, round(ms, 6) AS ms, tokens, CASE WHEN ms > 0 THEN round(tokens * 1000 / ms, 6) END AS per_second FROM m""".replace("CASE WHEN regexp_matches(ns", "CASE WHEN ns IS NOT NULL AND regexp_matches(ns"))
def g5_rates(spark, d):
    """Durations in nanoseconds and counts as text, some of them broken, as milliseconds and tokens a second."""
    n = F.col("event_id")
    ns = F.when(n % 7 == 0, F.lit("x")).when(n % 11 == 0, F.lit(None)).otherwise(F.floor(F.col("value") * 1_000_000).cast("string"))
    count = F.when(n % 5 == 0, F.lit("-1")).otherwise(F.col("user_id").cast("string"))
    rows = read(spark, d, "events").select("event_id", (D.measured(ns) / 1_000_000).alias("ms"), D.measured(count).alias("tokens"))
    return rows.select("event_id", F.round("ms", 6).alias("ms"), "tokens", F.round(F.try_divide(F.col("tokens") * 1000, F.col("ms")), 6).alias("per_second"))


@query("g6_phases", """WITH t AS (SELECT user_id, sum(CAST(floor(value * 100) AS BIGINT)) FILTER (event_type = 'view') / 100 AS search, sum(CAST(floor(value * 100) AS BIGINT)) FILTER (event_type = 'click') / 100 AS pack, sum(CAST(floor(value * 100) AS BIGINT)) FILTER (event_type IN ('view', 'click', 'signup')) / 100 AS ready, coalesce(sum(CAST(floor(value * 100) AS BIGINT)) FILTER (event_type = 'purchase'), 0) / 100 AS made, coalesce(sum(CAST(floor(value * 100) AS BIGINT)) FILTER (event_type = 'error'), 0) / 100 AS final FROM events GROUP BY user_id)
SELECT user_id, round(search, 2) AS prepare_search_ms, round(pack, 2) AS prepare_pack_ms, round(coalesce(ready, 0), 2) AS prepare_total_ms, round(greatest(0, made * 3 - coalesce(ready, 0) - made - final), 2) AS overhead_ms FROM t""")
def g6_phases(spark, d):
    """A user's events as phases of a request; the total is three times the generation."""
    part = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.floor(F.col("value") * 100))) / 100
    rows = read(spark, d, "events").groupBy("user_id").agg(part("view").alias("search"), part("click").alias("pack"), part("view", "click", "signup").alias("ready"), F.coalesce(part("purchase"), F.lit(0.0)).alias("made"), F.coalesce(part("error"), F.lit(0.0)).alias("final"))
    prepare = F.map_filter(F.create_map(F.lit("search_ms"), "search", F.lit("pack_ms"), "pack", F.lit("total_ms"), "ready"), lambda k, v: v.isNotNull())
    rows = rows.withColumn("m", D.phases(prepare, F.col("made"), F.col("final"), F.col("made") * 3))
    of = lambda name: F.round(F.try_element_at("m", F.lit(name)), 2)
    return rows.select("user_id", of("prepare_search_ms").alias("prepare_search_ms"), of("prepare_pack_ms").alias("prepare_pack_ms"), of("prepare_total_ms").alias("prepare_total_ms"), of("runtime_overhead_ms").alias("overhead_ms"))


@query("x3_document_text", f"""WITH {SQL_PLANE}, cur AS (SELECT d.document_id, coalesce(c.text, d.text) AS text FROM docs d LEFT JOIN came c ON c.document_id = d.document_id WHERE c.document_id IS NOT NULL OR d.document_id % 9 <> 0)
SELECT document_id, md5(lower(regexp_replace(text, '\\n$', ''))) AS digest FROM cur WHERE length(text) > 0""")
def x3_document_text(spark, d):
    """The lines of a document's current version as one text."""
    documents, _, chunks, _ = tables(spark, d)
    current = documents.select("document_id", F.col("current_version_id").alias("version_id"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    rows = chunks.join(current, ["document_id", "version_id"]).groupBy("document_id").agg(F.lower(F.array_join(lines, "\n")).alias("text"))
    return rows.select("document_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("x17_case_runs", f"""WITH {SQL_CITED}, q AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
SELECT q.conv_id, q.turn, CASE WHEN c.answer IS NULL THEN 'no answer' WHEN contains(c.answer, 'une') THEN 'refused: une' END AS error, c.answer IS NOT NULL AND NOT contains(c.answer, 'une') AND len(labels) > 0 AS passed FROM q LEFT JOIN cited c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1""")
def x17_case_runs(spark, d):
    """A row for every question asked, also of those whose run failed, with the error instead of a verdict."""
    asked = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn")
    made = evidence.cited(answers(spark, d).withColumn("available", T.literals(("S1", "S2", "S3")))).select("conv_id", (F.col("turn") - 1).alias("turn"), "answer", "labels")
    rows = asked.join(made, ["conv_id", "turn"], "left")
    error = F.when(F.col("answer").isNull(), "no answer").when(F.contains("answer", F.lit("une")), "refused: une")
    return rows.select("conv_id", "turn", error.alias("error"), (error.isNull() & F.coalesce(F.size("labels") > 0, F.lit(False))).alias("passed"))


@query("x18_report_match", f"""WITH {SQL_ANSWERS}, s AS (SELECT conv_id, turn, length(answer) AS chars, CASE WHEN turn % 5 = 3 THEN NULL WHEN turn % 7 = 5 THEN length(answer) + 1 ELSE length(answer) END AS stored FROM answers)
SELECT conv_id, turn, CASE WHEN stored IS NULL THEN 'missing' WHEN stored = chars THEN 'same' ELSE 'differs' END AS outcome FROM s""")
def x18_report_match(spark, d):
    """Figures of a stream against those stored, of which some are lost and some altered."""
    rows = answers(spark, d).select("conv_id", "turn", F.length("answer").alias("chars"))
    stored = rows.where("turn % 5 <> 3").select("conv_id", "turn", F.when(F.col("turn") % 7 == 5, F.col("chars") + 1).otherwise(F.col("chars")).alias("stored"))
    outcome = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") == F.col("chars"), "same").otherwise("differs")
    return rows.join(stored, ["conv_id", "turn"], "left").select("conv_id", "turn", outcome.alias("outcome"))


@query("x24_figures", f"""WITH {SQL_ANSWERS}, l AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS raw FROM answers),
a AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (regexp_matches(raw, '\\[S[123]\\]')) AS s FROM l WHERE length(trim(raw)) > 0 AND NOT starts_with(trim(raw), '#') AND NOT regexp_matches(trim(raw), '^[|\\-: ]*$') GROUP BY ALL)
SELECT x.conv_id, x.turn, CASE WHEN x.turn % 4 = 1 THEN CASE WHEN x.conv_id % 9 > 0 THEN CAST(x.conv_id % 9 AS VARCHAR) ELSE '—' END WHEN n IS NULL THEN '—' ELSE printf('%.1f%%', s / n * 100) END AS figure, CASE WHEN x.conv_id % 5 = 0 THEN '未记录' ELSE 'idx_' || substr(md5(CAST(x.conv_id AS VARCHAR)), 1, 4) END AS index_name FROM answers x LEFT JOIN a ON a.conv_id = x.conv_id AND a.turn = x.turn""")
def x24_figures(spark, d):
    """The figure in a picture's corner: a rate, or for every fourth turn, a map, its nodes."""
    rows = evidence.backlinks(answers(spark, d).select(F.struct("conv_id", "turn").alias("id"), F.col("answer").alias("content")), 3).select("id.*", "hit_rate")
    kind = F.when(F.col("turn") % 4 == 1, "mindmap").otherwise("guide")
    name = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("idx_"), F.md5(F.col("conv_id").cast("string").cast("binary"))))
    return rows.select("conv_id", "turn", D.rate_cell(kind, F.col("hit_rate"), F.col("conv_id") % 9).alias("figure"), D.short_index(name).alias("index_name"))


@query("x29_errors", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'deepseek_not_configured' WHEN 1 THEN 'ollama_busy' WHEN 2 THEN 'ollama_unavailable' ELSE 'generation_failed' END AS code, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events WHERE event_type = 'error'")
def x29_errors(spark, d):
    """Error events by what their text says, with the minute."""
    said = F.element_at(T.literals(("deepseek_not_configured", "Ollama is busy: wait", "no Ollama at the port", "timeout")), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, d, "events").where("event_type = 'error'").select("event_id", D.error_code(said).alias("code"), D.short_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("minute"))


@query("a21_documents", f"WITH {SQL_BM25} SELECT count(DISTINCT chunk_id) AS documents, count(DISTINCT query_id) AS questions FROM bm25_top WHERE rank <= 10")
def a21_documents(spark, d):
    """Different documents among all hits."""
    return found(spark, d).agg(F.count_distinct("chunk_id").alias("documents"), F.count_distinct("query_id").alias("questions"))


SQL_FILES = """pg AS (SELECT page_id AS p, html, (page_id % 4) || '/' || CASE WHEN page_id % 9 = 4 THEN '.hidden/' ELSE '' END || page_id || CASE page_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.html' WHEN 2 THEN '.TXT' WHEN 3 THEN '.ipynb' ELSE '.exe' END AS name FROM pages)"""


@query("s4_folder_scan", f"""WITH {SQL_FILES}, f AS (SELECT p, name, CASE WHEN p % 8 = 5 THEN NULL WHEN p % 7 = 3 THEN 'failed' WHEN p % 6 = 0 THEN 'added' WHEN p % 6 = 1 THEN 'back' WHEN p % 6 = 2 THEN 'changed' ELSE 'same' END AS file FROM pg WHERE p % 5 <> 4 AND p % 9 <> 4)
SELECT name AS source_file, CASE WHEN file IS NULL THEN 'removed' ELSE file END AS outcome FROM f WHERE file IS NOT NULL OR p % 6 > 1""")
def s4_folder_scan(spark, d):
    """Pages as files of several types, some broken, hidden or gone, against documents that know some of them."""
    import uuid

    from ..sources import files

    n = F.col("page_id")
    ending = F.element_at(T.literals((".md", ".html", ".TXT", ".ipynb", ".exe")), (n % 5 + 1).cast("int"))
    name = F.concat((n % 4).cast("string"), F.lit("/"), F.when(n % 9 == 4, ".hidden/").otherwise(""), n, ending)
    content = F.when(n % 7 == 3, F.concat(F.unhex(F.lit("FFFE80")), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary"))
    pages = read(spark, d, "pages").select("page_id", name.alias("name"), content.alias("content"))
    folder = f"{files.scratch_folder(spark)}/folder-{uuid.uuid4().hex}"
    files.write_files(pages.where("page_id % 8 <> 5"), folder)
    known = pages.where("page_id % 6 > 0 AND page_id % 5 <> 4 AND page_id % 9 <> 4")
    checksum = F.when(n % 6 == 2, F.lit("old")).otherwise(F.sha2("content", 256))
    known = known.select(F.col("name").alias("source_file"), checksum.alias("checksum"), (n % 6 == 1).alias("removed"))
    return files.folder_scan(spark, folder, known).select("source_file", "outcome")
