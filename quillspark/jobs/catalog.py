"""Registered queries of the library's own operators, each with the same result in DuckDB SQL.

Chunks are documents (``chunk_id`` = doc_id, heading and file = source); questions are the benchmark's passages; vectors
are joined to documents of the same number, a declared stand-in; relevance is a passage found word for word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets, evaluation, evidence, fusion, lexical, studio, tables
from ..sources.files import corpus_table, scratch_table, spread
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("heading"), "text")


def indexed(spark: SparkSession, d: str) -> lexical.Index:
    """The documents with their posting table, which all queries over the same files read."""
    return lexical.Index(chunks(spark, d), corpus_table(spark, f"{d}/documents.parquet", "postings", lambda: lexical.bag_rows(spread(chunks(spark, d)))))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Nine decimals: the logarithms of two engines differ in the last bit."""
    return df.withColumns({c: F.round(c, 9) for c in columns or ("score",)})


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with citations put in by a rule: label turn % 5, and for some one in a list."""
    rows = read(spark, d, "conversations").where("role = 'assistant'")
    mark = F.concat(F.lit(" [S"), F.col("turn") % 5, F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(", s"), F.col("conv_id") % 7)).otherwise(F.lit("")), F.lit("]"))
    return rows.select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 4 == 3, F.lit("")).otherwise(mark)).alias("answer"))


# What several oracles share.
TOKENS = """list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(regexp_extract_all(lower({t}), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+'),
  lambda r: CASE WHEN length(r) > 1 AND regexp_matches(r, '^[\\x{{4e00}}-\\x{{9fff}}]') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END)), lambda a, b: list_concat(a, b))"""
SQL_CHUNKS = f"""chunks AS (SELECT doc_id AS chunk_id, {TOKENS.format(t="source")} AS h, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
stats AS (SELECT count(*) AS n, sum(len(h) * 2 + len(t)) / count(*) AS avgdl FROM chunks),
rows AS (SELECT chunk_id, unnest(h) AS token, 1 AS hd FROM chunks UNION ALL SELECT chunk_id, unnest(t), 0 FROM chunks),
post AS (SELECT r.chunk_id, token, CAST(sum(hd) * 2 + sum(1 - hd) AS BIGINT) AS tf, CAST(sum(hd) AS BIGINT) AS heading_tf, CAST(sum(1 - hd) AS BIGINT) AS text_tf FROM rows r GROUP BY ALL),
lens AS (SELECT chunk_id, len(h) * 2 + len(t) AS doc_len FROM chunks),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
wanted AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark)"""
SQL_BM25 = f"""{SQL_CHUNKS},
parts AS (SELECT query_id, p.chunk_id, p.token, tf, heading_tf, text_tf, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, doc_len, avgdl FROM post p JOIN df USING (token) JOIN wanted USING (token) JOIN lens ON p.chunk_id = lens.chunk_id, stats),
scored AS (SELECT *, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)) AS score FROM parts),
bm25 AS (SELECT query_id, chunk_id, list_sum(list(score ORDER BY token)) AS score FROM scored GROUP BY ALL),
bm25_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25 WHERE score > 0)"""


@query("p3_tokenize", f"SELECT doc_id, CAST(len({TOKENS.format(t='text')}) AS INTEGER) AS n_tokens, md5(array_to_string({TOKENS.format(t='text')}, ' ')) AS digest FROM documents")
def p3_tokenize(spark, d):
    rows = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("p29_hashing", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def p29_hashing(spark, d):
    return read(spark, d, "documents").select("doc_id", T.sha256(F.col("text")).alias("sha256"))


@query("p33_url_host", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages")
def p33_url_host(spark, d):
    return read(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))


@query("a1_build_idf", f"WITH {SQL_CHUNKS} SELECT token, CAST(df AS BIGINT) AS df, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf FROM df, stats")
def a1_build_idf(spark, d):
    found_ = indexed(spark, d)
    df = lexical.document_frequency(lexical.postings(found_)).crossJoin(F.broadcast(lexical.corpus_stats(found_)))  # one row
    return df.select("token", "df", F.round(lexical.smooth_idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query("a2_postings", f"WITH {SQL_CHUNKS} SELECT p.chunk_id, token, tf, heading_tf, text_tf, CAST(doc_len AS BIGINT) AS doc_len FROM post p JOIN lens ON p.chunk_id = lens.chunk_id")
def a2_postings(spark, d):
    return lexical.postings(indexed(spark, d))


@query("r1_search_idf", f"""WITH {SQL_CHUNKS},
parts AS (SELECT query_id, chunk_id, token, heading_tf, text_tf, ln((n + 1) / (df + 1)) + 1 AS idf FROM post JOIN df USING (token) JOIN wanted USING (token), stats),
sums AS (SELECT query_id, chunk_id, coalesce(list_sum(list(idf ORDER BY token) FILTER (text_tf > 0)), 0) + coalesce(list_sum(list(idf ORDER BY token) FILTER (heading_tf > 0)), 0) AS score FROM parts GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sums WHERE score > 0)
SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM top WHERE rank <= 10""")
def r1_search_idf(spark, d):
    return rounded(lexical.search(questions(spark, d), indexed(spark, d), 10, idf_only=True))


@query("r2_explain", f"WITH {SQL_BM25} SELECT s.query_id, s.chunk_id, token, tf, heading_tf, text_tf, round(idf, 9) AS idf, round(s.score, 9) AS score FROM scored s JOIN bm25_top b ON s.query_id = b.query_id AND s.chunk_id = b.chunk_id WHERE rank = 1")
def r2_explain(spark, d):
    q, i = questions(spark, d), indexed(spark, d)
    best = lexical.search(q, i, 1).select("query_id", "chunk_id")
    return rounded(lexical.contributions(q, i, best), "score", "idf")


@query("r3_search_bm25", f"WITH {SQL_BM25} SELECT query_id, chunk_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM bm25_top WHERE rank <= 10")
def r3_search_bm25(spark, d):
    return rounded(found(spark, d))


def found(spark, d):
    return lexical.search(questions(spark, d), indexed(spark, d), 10)


SQL_DENSE = """dense AS (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))), lambda a, x: a + x) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
dense_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense)"""


def vectors(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    q = v.withColumnRenamed("chunk_id", "query_id").withColumnRenamed("vec", "qvec").join(questions(spark, d).select("query_id"), "query_id", "left_semi")
    return q, v


@query("r4_vector_search", f"WITH {SQL_DENSE} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM dense_top WHERE rank <= 10")
def r4_vector_search(spark, d):
    return fusion.dense_best(*vectors(spark, d), 10)


@query("r6_hybrid", f"""WITH {SQL_BM25}, {SQL_DENSE},
votes AS (SELECT query_id, chunk_id, 0 AS c, 1::DOUBLE / (60 + rank) AS vote FROM bm25_top WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, 1, 1::DOUBLE / (60 + rank) FROM dense_top WHERE rank <= 50),
fused AS (SELECT query_id, chunk_id, list_sum(list(vote ORDER BY c)) AS score FROM votes GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused)
SELECT query_id, chunk_id, score, rank FROM top WHERE rank <= 10""")
def r6_hybrid(spark, d):
    return fusion.hybrid(questions(spark, d), indexed(spark, d), *vectors(spark, d))


@query("p25_relative", f"WITH {SQL_BM25}, t AS (SELECT * FROM bm25_top WHERE rank <= 10) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score, round(CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1.0::DOUBLE ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END, 9) AS ratio FROM t")
def p25_relative(spark, d):
    return rounded(fusion.relative(found(spark, d)), "score", "ratio")


def relevant(spark, d):
    """Documents that hold a question's passage: words of the passage pick candidates by its rarest token, then the text decides."""
    q, i = questions(spark, d), indexed(spark, d)
    tokens = q.select("query_id", "query", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("token"))
    post = i.rows.where("text_tf > 0").select("chunk_id", "token").join(tokens.select("token").distinct(), "token", "left_semi")
    rare = post.groupBy("token").count().join(tokens, "token")
    rare = rare.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("count", "token"))).where("r = 1")
    near = i.rows.where("text_tf > 0").join(rare.select("query_id", "query", "token"), "token").select("query_id", "query", "chunk_id")
    return near.join(i.chunks.select("chunk_id", "text"), "chunk_id").where(F.contains("text", "query")).select("query_id", "chunk_id")


SQL_RELEVANT = "relevant AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("j14_contamination", f"WITH {SQL_RELEVANT} SELECT query_id, chunk_id FROM relevant")
def j14_contamination(spark, d):
    return relevant(spark, d)


SQL_FIRST = f"""{SQL_BM25}, {SQL_RELEVANT},
first AS (SELECT b.query_id, CAST(min(CASE WHEN r.chunk_id IS NOT NULL THEN rank END) AS INTEGER) AS first_rank FROM bm25_top b LEFT JOIN relevant r ON r.query_id = b.query_id AND r.chunk_id = b.chunk_id WHERE rank <= 10 GROUP BY b.query_id)"""


@query("r9_expected_rank", f"WITH {SQL_FIRST} SELECT * FROM first")
def r9_expected_rank(spark, d):
    return evaluation.expected_rank(found(spark, d), relevant(spark, d))


@query("r10_document_ranks", f"WITH {SQL_BM25}, f AS (SELECT query_id, source AS path, min(rank) AS place FROM bm25_top JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY ALL) SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, path) AS INTEGER) AS rank FROM f")
def r10_document_ranks(spark, d):
    hits = found(spark, d).join(chunks(spark, d).select("chunk_id", F.col("heading").alias("path")), "chunk_id")
    return evaluation.document_ranks(hits)


@query("a11_summary", f"""WITH {SQL_FIRST} SELECT count(*) AS questions, count(*) FILTER (first_rank <= 1) / count(*) AS recall_1, count(*) FILTER (first_rank <= 5) / count(*) AS recall_5, count(*) FILTER (first_rank <= 8) / count(*) AS recall_8,
  list_sum(list(coalesce(1::DOUBLE / first_rank, 0) ORDER BY coalesce(1::DOUBLE / first_rank, 0))) / count(*) AS mrr FROM first""")
def a11_summary(spark, d):
    return evaluation.summary(r9_expected_rank(spark, d))


@query("r13_compare", f"""WITH {SQL_FIRST}, {SQL_DENSE},
second AS (SELECT b.query_id, min(CASE WHEN r.chunk_id IS NOT NULL THEN rank END) AS r2 FROM dense_top b LEFT JOIN relevant r ON r.query_id = b.query_id AND r.chunk_id = b.chunk_id WHERE rank <= 10 GROUP BY b.query_id)
SELECT coalesce(f.query_id, s.query_id) AS query_id, CASE WHEN coalesce(r2, 1073741824) < coalesce(first_rank, 1073741824) THEN 'better' WHEN coalesce(r2, 1073741824) > coalesce(first_rank, 1073741824) THEN 'worse' ELSE 'unchanged' END AS verdict FROM first f FULL JOIN second s ON f.query_id = s.query_id""")
def r13_compare(spark, d):
    good = scratch_table(relevant(spark, d), "relevant")
    dense = evaluation.expected_rank(r4_vector_search(spark, d), good)
    return evaluation.compared(evaluation.expected_rank(found(spark, d), good), dense)


SQL_ANSWERS = "answers AS (SELECT conv_id, turn, text || CASE WHEN turn % 4 = 3 THEN '' ELSE ' [S' || (turn % 5) || CASE WHEN conv_id % 3 = 0 THEN ', s' || (conv_id % 7) ELSE '' END || ']' END AS answer FROM conversations WHERE role = 'assistant')"
SQL_CITED = f"""{SQL_ANSWERS},
found AS (SELECT conv_id, turn, answer, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1), lambda x: regexp_extract_all(upper(x), 'S\\d+'))), lambda a, b: list_concat(a, list_filter(b, lambda y: NOT list_contains(a, y)))) AS raw FROM answers),
cited AS (SELECT conv_id, turn, answer, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS labels FROM found)"""


@query("p10_validate_citations", f"WITH {SQL_CITED} SELECT conv_id, turn, array_to_string(labels, ',') AS labels, array_to_string(list_filter(labels, lambda x: x NOT IN ('S1', 'S2', 'S3')), ',') AS invalid, len(labels) > 0 AND len(list_filter(labels, lambda x: x NOT IN ('S1', 'S2', 'S3'))) = 0 AS valid FROM cited")
def p10_validate_citations(spark, d):
    out = evidence.cited(answers(spark, d).withColumn("available", T.literals(("S1", "S2", "S3"))))
    return out.select("conv_id", "turn", F.array_join("labels", ",").alias("labels"), F.array_join("invalid", ",").alias("invalid"), "valid")


@query("e11_backlinks", f"""WITH {SQL_ANSWERS},
l AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS raw FROM answers),
a AS (SELECT conv_id, turn, count(*) AS assertions, count(*) FILTER (regexp_matches(raw, '\\[S[123]\\]')) AS with_source FROM l WHERE length(trim(raw)) > 0 AND NOT starts_with(trim(raw), '#') AND NOT regexp_matches(trim(raw), '^[|\\-: ]*$') GROUP BY ALL)
SELECT x.conv_id, x.turn, coalesce(assertions, 0) AS assertions, coalesce(with_source, 0) AS with_source, with_source / assertions AS hit_rate FROM answers x LEFT JOIN a ON a.conv_id = x.conv_id AND a.turn = x.turn""")
def e11_backlinks(spark, d):
    rows = answers(spark, d).select(F.struct("conv_id", "turn").alias("id"), F.col("answer").alias("content"))
    return evidence.backlinks(rows, 3).select("id.conv_id", "id.turn", "assertions", "with_source", "hit_rate")


@query("g1_score_answers", f"""WITH {SQL_CITED},
c AS (SELECT conv_id, turn, answer, labels, turn % 7 = 5 AS rejected, CASE WHEN turn % 7 = 5 THEN 'reject' WHEN turn % 7 = 3 THEN 'abstain' ELSE 'answer' END AS expected, turn % 2 = 1 AS must_cite,
  len(labels) > 0 AND len(list_filter(labels, lambda x: x NOT IN ('S1', 'S2', 'S3'))) = 0 AS valid FROM cited),
s AS (SELECT conv_id, turn, CASE expected WHEN 'answer' THEN NOT rejected WHEN 'reject' THEN rejected ELSE NOT rejected AND (contains(answer, '资料不足') OR contains(answer, '无法提供') OR contains(answer, '无法回答') OR contains(answer, '未提供详细') OR contains(answer, '无法直接找到') OR contains(answer, '未给出明确支持')) END AS behavior_correct,
  contains(lower(answer), 'the') AS mentions_present, NOT (contains(answer, '推测') OR contains(answer, '可能') OR contains(answer, '一般而言') OR contains(answer, '根据常识') OR contains(answer, '我认为') OR contains(answer, '大概')) AS no_speculation, must_cite, valid FROM c)
SELECT conv_id, turn, behavior_correct, mentions_present, no_speculation, behavior_correct AND mentions_present AND no_speculation AND (NOT must_cite OR valid) AS passed FROM s""")
def g1_score_answers(spark, d):
    rows = evidence.cited(answers(spark, d).withColumn("available", T.literals(("S1", "S2", "S3"))))
    kind = F.col("turn") % 7
    rows = rows.withColumn("rejected", kind == 5).withColumn("expected", F.when(kind == 5, "reject").when(kind == 3, "abstain").otherwise("answer"))
    rows = rows.withColumn("must_mention", F.array(F.lit("the"))).withColumn("must_cite", F.col("turn") % 2 == 1)
    return evaluation.score_answers(rows).select("conv_id", "turn", "behavior_correct", "mentions_present", "no_speculation", "passed")


GUARD_ROWS = ("今天天气如何", "帮我预订机票", "根据我的简历", "最新论文有哪些", "最新价格", "什么是RAG", "")
GUARD_SQL = ", ".join(f"({i}, '{q}')" for i, q in enumerate(GUARD_ROWS))


def _first(phrases, column="t"):
    return "CASE " + " ".join(f"WHEN contains({column}, '{p}') THEN '{p}'" for p in phrases) + " END"


@query("p8_guard", f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, lower(text) AS t FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - i, lower(x) FROM (VALUES {GUARD_SQL}) v(i, x))
SELECT CAST(id AS BIGINT) AS id, coalesce('action:' || {_first(T.ACTIONS)}, 'personal:' || {_first(T.PERSONAL)}, 'realtime:' || coalesce({_first(T.REALTIME_HARD)}, CASE WHEN {_first(T.STATIC_CONTEXT)} IS NULL THEN {_first(T.REALTIME_SOFT)} END)) AS reason FROM q""")
def p8_guard(spark, d):
    rows = read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    rows = rows.unionByName(spark.createDataFrame([(-1 - i, q) for i, q in enumerate(GUARD_ROWS)], "id long, q string"))
    return rows.select("id", T.rejection(F.col("q")).alias("reason"))


SQL_SOURCES = f"""{SQL_BM25},
sources AS (SELECT query_id, rank, source, trim(text, chr(10) || chr(32) || chr(9) || chr(13)) AS content FROM bm25_top JOIN documents ON doc_id = chunk_id WHERE rank <= 10 AND length(trim(text, chr(10) || chr(32) || chr(9) || chr(13))) > 0)"""


def sources(spark, d):
    c = chunks(spark, d).select("chunk_id", F.col("heading").alias("source"), "heading", F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", "").alias("content"))
    return found(spark, d).join(c, "chunk_id").where(F.length("content") > 0)


@query("e4_fit_evidence", f"""WITH {SQL_SOURCES},
s AS (SELECT query_id, rank, CAST(octet_length(encode(source || content)) AS BIGINT) AS bytes FROM sources),
u AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, bytes, used FROM u WHERE n = 1 OR used <= 14080""")
def e4_fit_evidence(spark, d):
    rows = sources(spark, d).select("query_id", "rank", F.col("source").alias("header"), F.col("content").alias("text"))
    return evidence.fit_evidence(rows, evidence.evidence_budget()).select("query_id", "rank", "bytes", "used")


@query("e1_build_context", f"""WITH {SQL_SOURCES},
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM sources),
h AS (SELECT *, '[S' || n || ']' || chr(10) || '来源：' || source || chr(10) || '标题路径：' || source || chr(10) || '内容：' AS head FROM a),
k AS (SELECT *, sum(length(head) + CASE WHEN n > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY n) AS heads FROM h),
f AS (SELECT * FROM k WHERE heads + n <= 2200),
r AS (SELECT *, 2200 - max(heads) OVER (PARTITION BY query_id) AS room, count(*) OVER (PARTITION BY query_id) AS k FROM f),
b AS (SELECT *, least(length(content), 240, room // k) AS base FROM r),
s AS (SELECT *, room - sum(base) OVER (PARTITION BY query_id) AS spare, length(content) - base AS need FROM b),
x AS (SELECT *, CAST(base + greatest(0, least(need, spare - (sum(need) OVER (PARTITION BY query_id ORDER BY n) - need))) AS BIGINT) AS budget FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, 'S' || n AS label, md5(head || CASE WHEN length(content) > budget THEN rtrim(substr(content, 1, budget - 1), chr(32) || chr(10) || chr(9) || chr(13)) || '…' ELSE content END) AS digest FROM x""")
def e1_build_context(spark, d):
    return evidence.build_context(sources(spark, d)).select("query_id", "rank", "label", F.md5(F.concat("head", "content").cast("binary")).alias("digest"))


def outlined(spark, d):
    """Documents as Markdown: every fifth line becomes a heading of level 1 to 3 by its place."""
    level = lambda i: F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int"))
    mark = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(level(i), F.lit(" "), x)).otherwise(x))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.array_join(mark, "\n").alias("text"))


SQL_OUTLINED = """outlined AS (SELECT doc_id AS id, source AS title, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN repeat('#', CAST(((i - 1) // 5) % 3 + 1 AS INTEGER)) || ' ' || x ELSE x END) AS lines FROM documents)"""


@query("e2_round_robin", f"""WITH RECURSIVE {SQL_SOURCES},
u AS (SELECT query_id, rank, CAST(unnest(range(len(x))) AS INTEGER) AS position, unnest(x) AS content FROM (SELECT query_id, rank, string_split(content, chr(10)) AS x FROM sources)),
a AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS asked FROM benchmark),
m AS (SELECT u.*, len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')), asked)) AS matches FROM u JOIN a USING (query_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY matches DESC, position) AS unit FROM m),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY unit, rank) AS k FROM o),
f AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS opened, CAST([] AS STRUCT(r BIGINT, p INTEGER)[]) AS taken FROM v
  UNION ALL SELECT query_id, k, CASE WHEN ok THEN used + added ELSE used END, CASE WHEN ok THEN list_append(seen, content) ELSE seen END, CASE WHEN ok AND NOT list_contains(opened, rank) THEN list_append(opened, rank) ELSE opened END, CASE WHEN ok THEN list_append(taken, {{'r': rank, 'p': position}}) ELSE taken END
  FROM (SELECT *, NOT list_contains(seen, content) AND used + added <= 2200 AS ok FROM (SELECT f.query_id, v.k, used, seen, opened, taken, v.rank, v.position, v.content, length(v.content) + CASE WHEN list_contains(opened, v.rank) THEN 2 WHEN len(opened) > 0 THEN 5 ELSE 3 END AS added FROM f JOIN v ON v.query_id = f.query_id AND v.k = f.k + 1)))
SELECT query_id, CAST(used AS INTEGER) AS used, array_to_string(list_transform(list_sort(taken), lambda x: x.r || ':' || x.p), ',') AS accepted FROM f QUALIFY k = max(k) OVER (PARTITION BY query_id)""")
def e2_round_robin(spark, d):
    """Lines of a source in the order (-matches, position); accepted ones as source:position, in that order."""
    rows = sources(spark, d).select("query_id", F.col("rank").alias("source"), F.lit("[S]").alias("header"), F.posexplode(T.lines(F.col("content"))).alias("position", "content"))
    asked = questions(spark, d).select("query_id", T.tokenize_query(F.col("query")).alias("asked"))
    rows = rows.join(asked, "query_id").withColumn("matches", F.size(F.array_intersect("asked", T.tokenize(F.col("content")))))
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("matches"), "position")
    rows = rows.withColumn("unit", F.row_number().over(order) - 1)
    out = evidence.round_robin(rows.select("query_id", "source", "unit", "header", "content"), 2200)
    taken = out.select("query_id", F.explode("accepted").alias("x")).select("query_id", "x.source", "x.unit").join(rows, ["query_id", "source", "unit"])
    placed = F.array_sort(F.collect_list(F.struct("source", "position")))
    texts = taken.groupBy("query_id").agg(F.array_join(F.transform(placed, lambda x: F.concat(x["source"], F.lit(":"), x["position"])), ",").alias("accepted"))
    return out.select("query_id", "used").join(texts, "query_id", "left").na.fill("", ["accepted"])


@query("a6_libraries", "SELECT source AS library, count(*) AS document_count, count(*) FILTER (n_chars >= 200) AS ready_count FROM documents GROUP BY source")
def a6_libraries(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("library"), (F.col("n_chars") >= 200).alias("ready"))
    return tables.listing(docs.select("library").distinct().withColumn("active", F.lit(True)), docs).drop("active")


@query("a7_conversations", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'assistant') AS answers, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def a7_conversations(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max_by("role", "turn").alias("last_role"))


@query("j5_replies", "SELECT a.conv_id, a.turn, q.turn AS question_turn, length(q.text) AS question_chars FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 AND q.role = 'user' WHERE a.role = 'assistant'")
def j5_replies(spark, d):
    c = read(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = c.withColumn("q", F.lag(F.struct("turn", "role", "text")).over(order))
    return before.where("role = 'assistant' AND q.role = 'user' AND q.turn = turn - 1").select("conv_id", "turn", F.col("q.turn").alias("question_turn"), F.length("q.text").cast("long").alias("question_chars"))


@query("r16_fitting_history", """WITH RECURSIVE l AS (SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS r, 0 AS chars, CAST([] AS BIGINT[]) AS turns FROM l
  UNION ALL SELECT f.conv_id, l.r, CASE WHEN chars + n <= 4000 THEN chars + n ELSE chars END, CASE WHEN chars + n <= 4000 THEN list_prepend(turn, turns) ELSE turns END FROM f JOIN l ON l.conv_id = f.conv_id AND l.r = f.r + 1 WHERE l.r <= 8)
SELECT conv_id, chars, array_to_string(turns, ',') AS turns FROM f QUALIFY r = max(r) OVER (PARTITION BY conv_id)""")
def r16_fitting_history(spark, d):
    """The turns that a prompt takes of a conversation, in order."""
    rows = evidence.recent_history(read(spark, d, "conversations"))
    return rows.select("conv_id", "chars", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


@query("j9_difference", """WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def j9_difference(spark, d):
    """Two versions made of the documents: one lacks every tenth, the other every eleventh and has edits."""
    docs = read(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 0").select("doc_id", T.sha256(F.col("text")).alias("h"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", T.sha256(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return tables.difference(old, new, "doc_id", "h")


@query("j10_passage_reuse", """WITH n AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents), o AS (SELECT DISTINCT source, text FROM documents WHERE doc_id % 10 <> 0)
SELECT n.doc_id, o.text IS NOT NULL AS reused FROM n LEFT JOIN o ON n.source = o.source AND n.text = o.text""")
def j10_passage_reuse(spark, d):
    """Two versions as in ``j9_difference``: a passage, heading and text, keeps its vector whatever its id; edited ones do not."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tables.reused(edited, docs.where("doc_id % 10 <> 0"), "doc_id", "source", "text")


@query("w1_upsert", "SELECT user_id, event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value, max(ts) AS updated_at FROM events GROUP BY ALL")
def w1_upsert(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "value", F.col("ts").alias("updated_at"), "event_id")
    return tables.latest(e, ["user_id", "event_type"], F.col("updated_at"), F.col("event_id")).drop("event_id")


@query("x9_inventory", "SELECT source, sha256(string_agg(x, chr(10) ORDER BY x)) AS inventory, count(*) AS files FROM (SELECT source, doc_id || ':' || sha256(text) AS x FROM documents) GROUP BY source")
def x9_inventory(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", T.sha256(F.col("text")).alias("h"))
    return tables.inventory_hash(docs, "doc_id", "h", "source")


@query("d4_grouped_split", """WITH g AS (SELECT DISTINCT text FROM documents), h AS (SELECT sha256(text) AS grp FROM g), r AS (SELECT grp, row_number() OVER (ORDER BY sha256('split:7:' || grp), grp) AS rank, count(*) OVER () AS n FROM h)
SELECT grp, CASE WHEN rank <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'test' WHEN rank <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) * 2 THEN 'validation' ELSE 'train' END AS split FROM r""")
def d4_grouped_split(spark, d):
    docs = read(spark, d, "documents").select(T.sha256(F.col("text")).alias("grp"))
    return tables.grouped_split(docs, "grp", {"test": 0.1, "validation": 0.1}, 7, "split")


@query("j13_leakage", """WITH s AS (SELECT doc_id AS id, sha256(text) AS text_hash, doc_id % 5 = 0 AS held FROM documents)
SELECT id, 'text_hash' AS shared FROM s WHERE held AND text_hash IN (SELECT text_hash FROM s WHERE NOT held)""")
def j13_leakage(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.sha256(F.col("text")).alias("text_hash"))
    return datasets.leaked(docs.where("id % 5 <> 0"), docs.where("id % 5 = 0"), "text_hash")


@query("d6_vocabulary", "WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents) SELECT char, CAST(row_number() OVER (ORDER BY char) + 2 AS INTEGER) AS id FROM c WHERE char <> ''")
def d6_vocabulary(spark, d):
    return datasets.vocabulary(read(spark, d, "documents"))


@query("d7_document_windows", """WITH v AS (SELECT char, CAST(row_number() OVER (ORDER BY char) + 2 AS INTEGER) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents WHERE doc_id % 10 <> 0) WHERE char <> ''),
m AS (SELECT map(list(char), list(id)) AS t FROM v),
c AS (SELECT doc_id AS id, list_append(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: coalesce(t[x], 1)), 2) AS codes FROM documents, m),
s AS (SELECT id, codes, unnest(range(0, len(codes) - 1, 64)) AS start FROM c WHERE len(codes) >= 2),
p AS (SELECT id, start, codes[start + 1 : least(start + 64, len(codes) - 1)] AS x, codes[start + 2 : start + 65] AS y FROM s)
SELECT id, CAST(start AS INTEGER) AS start, md5(array_to_string(list_concat(x, list_transform(range(64 - len(x)), lambda i: 0)), ' ') || '|' || array_to_string(list_concat(y, list_transform(range(64 - len(y)), lambda i: -100)), ' ')) AS digest FROM p""")
def d7_document_windows(spark, d):
    """Windows of every document by the alphabet of the training split (all but every tenth), as a digest of each."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = datasets.windows(datasets.encoded(docs, datasets.vocabulary(docs.where("id % 10 <> 0"))), 64)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return rows.select("id", "start", F.md5(F.concat_ws("|", flat("x"), flat("y")).cast("binary")).alias("digest"))


@query("a17_latency", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS r FROM events), v AS (SELECT event_type, list(value ORDER BY value) AS v FROM r WHERE r <= 100 GROUP BY event_type)
SELECT event_type, CAST(len(v) AS INTEGER) AS n, v[greatest(1, CAST(floor(len(v) * 0.5::DOUBLE + 0.999999::DOUBLE) AS BIGINT))] AS p50, v[greatest(1, CAST(floor(len(v) * 0.95::DOUBLE + 0.999999::DOUBLE) AS BIGINT))] AS p95, v[len(v)] AS top, round(list_sum(v) / len(v), 9) AS mean FROM v""")
def a17_latency(spark, d):
    """Counts, means and nearest-rank percentiles of the last hundred values of each type."""
    return rounded(tables.nearest_rank(read(spark, d, "events"), "event_type", "value", "ts", 100, {"p50": 0.5, "p95": 0.95}), "mean")


@query("st9_windowed", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st9_windowed(spark, d):
    return windows.windowed(read(spark, d, "events")).drop("total")


@query("st7_progress", "SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, arg_max(event_type, {'t': ts, 'e': event_id}) AS state FROM events GROUP BY user_id")
def st7_progress(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("a18_pivot", "SELECT lang, count(*) FILTER (doc_id % 10 = 0) AS test, count(*) FILTER (doc_id % 10 <> 0) AS train FROM documents GROUP BY lang")
def a18_pivot(spark, d):
    docs = read(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    return docs.groupBy("lang").pivot("split", ["test", "train"]).count().na.fill(0)


@query("e9_outline", """WITH s AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+', '/', 'g'), '/'), lambda x: x <> '') AS p FROM pages),
n AS (SELECT page_id, unnest(list_transform(range(1, len(p) + 1), lambda i: p[1:i])) AS p FROM s)
SELECT array_to_string(p, '/') AS path, coalesce(array_to_string(p[1 : len(p) - 1], '/'), '') AS parent, p[len(p)] AS label, CAST(len(p) AS INTEGER) AS depth, count(DISTINCT page_id) AS sources FROM n GROUP BY p""")
def e9_outline(spark, d):
    pages = read(spark, d, "pages")
    parts = F.filter(F.split(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/+"), lambda x: F.length(x) > 0)
    return studio.outline(pages.select(parts.alias("segments"), F.col("page_id").alias("source")))


@query("a19_shares", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS place, count(*) OVER () AS k, n / max(n) OVER () AS share FROM c) SELECT source, n, share, CAST(place AS INTEGER) AS place, greatest(k - 8, 0) AS omitted FROM r WHERE place <= 8")
def a19_shares(spark, d):
    return studio.shares(read(spark, d, "documents"), "source", 8)


@query("s11_export", "SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def s11_export(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n\n"), "text").alias("x"))))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n\n").alias("markdown"))


def _clean_sql(column: str) -> str:
    for phrase in sorted(T.STOP_PHRASES, key=len, reverse=True):
        column = f"replace({column}, '{phrase}', ' ')"
    return f"regexp_replace({column}, '{T.CONNECTORS}', ' ', 'g')"


QUESTION_ROWS = ("什么是RAG和Agent的区别", "系统从 KV Cache 到 GQA 的步骤有哪些", "中", "")
QUESTION_SQL = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTION_ROWS))


@query("p4_tokenize_query", f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, text AS t FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - i, x FROM (VALUES {QUESTION_SQL}) v(i, x)),
c AS (SELECT id, {_clean_sql('lower(t)')} AS t FROM q)
SELECT CAST(id AS BIGINT) AS id, array_to_string(list_sort(list_distinct({TOKENS.format(t='t')})), ' ') AS tokens FROM c""")
def p4_tokenize_query(spark, d):
    rows = read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    rows = rows.unionByName(spark.createDataFrame([(-1 - i, q) for i, q in enumerate(QUESTION_ROWS)], "id long, q string"))
    return rows.select("id", F.array_join(T.tokenize_query(F.col("q")), " ").alias("tokens"))


@query("p12_excerpt", f"""WITH {SQL_BM25}, b AS (SELECT query_id, chunk_id, trim(d.text, chr(10) || chr(32) || chr(9) || chr(13)) AS text, regexp_extract_all(lower(q.text), '[a-z0-9]+') AS asked FROM bm25_top JOIN documents d ON doc_id = chunk_id JOIN benchmark q ON item_id = query_id WHERE rank = 1),
h AS (SELECT *, string_split(text, chr(10)) AS lines, list_transform(string_split(text, chr(10)), lambda x: list_has_any(regexp_extract_all(lower(x), '[a-z0-9]+'), asked)) AS hit FROM b)
SELECT query_id, chunk_id, CASE WHEN list_contains(hit, true) THEN array_to_string(list_filter(lines, lambda x, i: length(trim(x)) > 0 AND (hit[i] OR coalesce(hit[i + 1], false))), chr(10)) ELSE text END AS excerpt FROM h""")
def p12_excerpt(spark, d):
    """Of each question's best document, the lines that hold one of its tokens and the lines above them."""
    best = lexical.search(questions(spark, d), indexed(spark, d), 1)
    rows = best.join(chunks(spark, d), "chunk_id").join(questions(spark, d), "query_id")
    return rows.select("query_id", "chunk_id", T.excerpt(F.col("text"), T.tokenize_query(F.col("query"))).alias("excerpt"))


@query("p16_covers_all", "SELECT item_id AS query_id, doc_id AS chunk_id, length(d.text) > 0 AND contains(lower(d.text), 'the') AND contains(lower(d.text), split_part(lower(b.text), ' ', 1)) AS covers FROM benchmark b, documents d")
def p16_covers_all(spark, d):
    """Whether a document covers a keyword list, ``the`` and a passage's first word, for every document and passage.

    The passages are a stated set, so the pairs grow with the documents."""
    words = questions(spark, d).select("query_id", F.array(F.lit("the"), F.substring_index("query", " ", 1)).alias("keywords"))
    return evaluation.covered(chunks(spark, d), words).select("query_id", "chunk_id", "covers")


@query("a4_diagnostics", "SELECT lang, count(*) AS documents, max(length(text)) AS longest, count(*) FILTER (length(text) > 800) AS over_limit, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def a4_diagnostics(spark, d):
    size = F.length("text")
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.max(size).cast("long").alias("longest"), F.count_if(size > 800).alias("over_limit"), F.sum("n_chars").alias("chars"))


@query("a13_summary", f"""WITH {SQL_CITED},
c AS (SELECT conv_id, turn % 7 AS category, contains(lower(answer), 'the') AND (turn % 2 = 0 OR (len(labels) > 0 AND len(list_filter(labels, lambda x: x NOT IN ('S1', 'S2', 'S3'))) = 0)) AND turn % 7 <> 3 AS passed, len(labels) > 0 AS cites FROM cited)
SELECT category, count(*) AS answers, count(*) FILTER (passed) AS passed, count(*) FILTER (cites) / count(*) AS cited_rate FROM c GROUP BY category""")
def a13_summary(spark, d):
    """Passed answers and citing ones by category (the turn's place in a week)."""
    rows = evidence.cited(answers(spark, d).withColumn("available", T.literals(("S1", "S2", "S3")))).select("conv_id", "turn", F.size("labels").alias("n"))
    scored = g1_score_answers(spark, d).join(rows, ["conv_id", "turn"])
    return scored.groupBy((F.col("turn") % 7).alias("category")).agg(F.count("*").alias("answers"), F.count_if("passed").alias("passed"), F.try_divide(F.count_if(F.col("n") > 0), F.count("*")).alias("cited_rate"))


@query("a15_backlink_rates", f"""WITH {SQL_ANSWERS},
l AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS raw FROM answers),
a AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (regexp_matches(raw, '\\[S[123]\\]')) AS s FROM l WHERE length(trim(raw)) > 0 AND NOT starts_with(trim(raw), '#') AND NOT regexp_matches(trim(raw), '^[|\\-: ]*$') GROUP BY ALL)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS assertions, CAST(sum(s) AS BIGINT) AS with_source, sum(s) / sum(n) AS weighted, median(s / n) AS middle FROM a GROUP BY conv_id""")
def a15_backlink_rates(spark, d):
    """Sourced lines of a conversation's answers: weighted rate and the median of the answers' rates; answers without lines are out."""
    rates = e11_backlinks(spark, d).where("assertions > 0")
    return rates.groupBy("conv_id").agg(F.sum("assertions").alias("assertions"), F.sum("with_source").alias("with_source"), (F.sum("with_source") / F.sum("assertions")).alias("weighted"), F.median("hit_rate").alias("middle"))


@query("a16_length_statistics", "WITH t AS (SELECT lang, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents) SELECT lang, CAST(min(n) AS INTEGER) AS shortest, CAST(max(n) AS INTEGER) AS longest, sum(n) / count(*) AS mean, median(n) AS middle FROM t GROUP BY lang")
def a16_length_statistics(spark, d):
    n = F.size(T.tokenize(F.col("text")))
    rows = read(spark, d, "documents").select("lang", n.alias("n"))
    return rows.groupBy("lang").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), (F.sum("n") / F.count("*")).alias("mean"), F.median("n").alias("middle"))


@query("j6_favorites", "WITH f AS (SELECT DISTINCT conv_id, doc_id FROM conversations JOIN documents ON doc_id = conv_id * 7 + turn) SELECT source AS library, count(DISTINCT conv_id) AS favorites, count(*) AS sources FROM f JOIN documents USING (doc_id) GROUP BY source")
def j6_favorites(spark, d):
    """Messages as favorites, the document of number 7 conv_id + turn as their source: distinct ones for each library."""
    marks = read(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 7 + F.col("turn")).alias("doc_id"))
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("library"))
    return marks.join(docs, "doc_id").distinct().groupBy("library").agg(F.count_distinct("conv_id").alias("favorites"), F.count("*").alias("sources"))


@query("j11_report_compare", """WITH a AS (SELECT doc_id, quality = 1 AS p FROM labels), b AS (SELECT doc_id, n_chars > 1000 AS p FROM documents)
SELECT doc_id, CASE WHEN a.p IS NULL OR b.p IS NULL THEN 'unmatched' WHEN a.p AND b.p THEN 'kept_pass' WHEN a.p THEN 'regressed' WHEN b.p THEN 'fixed' ELSE 'kept_fail' END AS verdict FROM a FULL JOIN b USING (doc_id)""")
def j11_report_compare(spark, d):
    """Two reports on the documents: their label, and their length."""
    a = read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("x"))
    b = read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("y"))
    x, y = F.col("x"), F.col("y")
    verdict = F.when(x.isNull() | y.isNull(), "unmatched").when(x & y, "kept_pass").when(x, "regressed").when(y, "fixed").otherwise("kept_fail")
    return a.join(b, "doc_id", "full_outer").select("doc_id", verdict.alias("verdict"))


@query("j12_manifest", "WITH m AS (SELECT source, sha256(string_agg(x, chr(10) ORDER BY x)) AS h FROM (SELECT source, doc_id || ':' || sha256(text) AS x FROM documents) GROUP BY source), n AS (SELECT source, sha256(string_agg(x, chr(10) ORDER BY x)) AS h FROM (SELECT source, doc_id || ':' || sha256(CASE WHEN doc_id % 97 = 3 THEN text || ' ' ELSE text END) AS x FROM documents) GROUP BY source) SELECT source, m.h = n.h AS intact FROM m JOIN n USING (source)")
def j12_manifest(spark, d):
    """Manifests of each source before and after some files were touched."""
    docs = read(spark, d, "documents")
    touched = F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    both = [tables.inventory_tree(docs.select("source", "doc_id", T.sha256(t).alias("h")), "doc_id", "h", "source").select("source", F.col("inventory").alias(n)) for t, n in ((F.col("text"), "a"), (touched, "b"))]
    return both[0].join(both[1], "source").select("source", (F.col("a") == F.col("b")).alias("intact"))


@query("r17_stable_order", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('order:7:' || doc_id), doc_id) AS INTEGER) AS place FROM documents")
def r17_stable_order(spark, d):
    order = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("order:7:"), "doc_id").cast("binary"), 256), "doc_id")
    return read(spark, d, "documents").select("doc_id", F.row_number().over(order).alias("place"))


@query("t1_set_algebra", f"""WITH {SQL_BM25}, {SQL_RELEVANT},
h AS (SELECT query_id, list(chunk_id ORDER BY chunk_id) AS hits FROM bm25_top WHERE rank <= 10 GROUP BY query_id), r AS (SELECT query_id, list(chunk_id ORDER BY chunk_id) AS want FROM relevant GROUP BY query_id)
SELECT h.query_id, CAST(len(list_filter(hits, lambda x: list_contains(coalesce(want, []), x))) AS INTEGER) AS shared, CAST(len(list_filter(coalesce(want, []), lambda x: NOT list_contains(hits, x))) AS INTEGER) AS missed FROM h LEFT JOIN r ON h.query_id = r.query_id""")
def t1_set_algebra(spark, d):
    """Hits and relevant documents of a question: shared ones, and those missed."""
    hits = scratch_table(found(spark, d), "hits")
    want = relevant(spark, d).join(hits.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    counts = want.groupBy("query_id").agg(F.count("hit").cast("int").alias("shared"), F.count_if(F.col("hit").isNull()).cast("int").alias("missed"))
    return hits.select("query_id").distinct().join(counts, "query_id", "left").na.fill(0)


@query("st8_supersession", "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS current, count(*) - 1 AS superseded FROM events WHERE event_type = 'click' GROUP BY user_id")
def st8_supersession(spark, d):
    clicks = read(spark, d, "events").where("event_type = 'click'")
    return clicks.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("current"), (F.count("*") - 1).alias("superseded"))


@query("st6_rolling", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS r FROM events)
SELECT event_type, count(*) AS n, round(list_sum(list(value ORDER BY value)) / count(*), 9) AS mean, max(value) AS top FROM r WHERE r <= 100 GROUP BY event_type""")
def st6_rolling(spark, d):
    """What a stream's rolling state of the last hundred values says when all events have come."""
    return rounded(windows.rolled(read(spark, d, "events")), "mean")


@query("x27_job_states", """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS state FROM events WHERE event_type <> 'click'),
n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, max(ts) OVER () AS final FROM e)
SELECT user_id, ts, state FROM n UNION ALL SELECT user_id, ts + INTERVAL 6 HOUR, 'interrupted' FROM n WHERE state IN ('queued', 'running') AND coalesce(next, final + INTERVAL 1 SECOND) > ts + INTERVAL 6 HOUR AND (next IS NOT NULL OR final > ts + INTERVAL 6 HOUR)""")
def x27_job_states(spark, d):
    """The log of each user's job: its events, and an interruption six hours after one that was under way and never heard of again."""
    kinds = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    events = read(spark, d, "events").where("event_type <> 'click'").select(F.col("user_id").alias("job"), "ts", kinds.alias("state"), "event_id")
    return windows.job_log(events, 6).select(F.col("job").alias("user_id"), "ts", "state")
