"""More registered queries: names and paths, answer formats, retrieval rules, counts and updates of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import evaluation, evidence
from .catalog import SQL_BM25, SQL_CITED, SQL_OUTLINED, SQL_RELEVANT, answers, found, outlined, query, questions, read, relevant

RESERVED = ", ".join(f"'{x}'" for x in N.RESERVED)
WHITE = "chr(10) || chr(32) || chr(9) || chr(13)"


@query("p1_title", f"WITH {SQL_OUTLINED} SELECT id, trim(substr(list_filter(lines, lambda x: starts_with(x, '# '))[1], 3), {WHITE}) AS title FROM outlined")
def p1_title(spark, d):
    return outlined(spark, d).select("id", N.title(F.col("text")).alias("title"))


@query("p5_normal_path", "SELECT doc_id, source || '/' || lang || '/' || (doc_id % 7) || '/' || doc_id || '.md' AS path FROM documents")
def p5_normal_path(spark, d):
    """File names as different systems write them, with one kind of slash."""
    slash = F.when(F.col("doc_id") % 2 == 0, F.lit("\\")).otherwise(F.lit("/"))
    name = F.concat("source", F.lit("\\"), "lang", slash, F.col("doc_id") % 7, F.lit("/"), "doc_id", F.lit(".md"))
    return read(spark, d, "documents").select("doc_id", N.normal_path(name).alias("path"))


@query("p13_canonical", f"SELECT page_id, md5(trim(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {WHITE} || chr(11) || chr(12))) AS digest FROM pages")
def p13_canonical(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(N.canonical(F.col("html")).cast("binary")).alias("digest"))


@query("p20_follow_up", """WITH u AS (SELECT conv_id, turn, text || CASE WHEN turn % 4 = 2 THEN '呢？' ELSE '' END AS q FROM conversations WHERE role = 'user'),
p AS (SELECT *, lag(q) OVER (PARTITION BY conv_id ORDER BY turn) AS before, regexp_matches(rtrim(q, '？?！!。.'), '^(?:它|这个|这项|上述|前面|刚才|那个|那它|还有|那么|为什么|怎么做|有何区别)|(?:呢|还有吗)$') AS leans FROM u)
SELECT conv_id, turn, leans, leans AND before IS NULL AS unclear, md5(CASE WHEN leans AND before IS NOT NULL THEN before || chr(10) || '当前追问：' || q ELSE q END) AS digest FROM p""")
def p20_follow_up(spark, d):
    """User turns, every second one with a particle that makes it lean on the turn before."""
    u = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 4 == 2, "呢？").otherwise("")).alias("q"))
    u = u.withColumn("before", F.lag("q").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("leans", N.follows_up(F.col("q")))
    asked = F.when(F.col("leans") & F.col("before").isNotNull(), F.concat("before", F.lit("\n当前追问："), "q")).otherwise(F.col("q"))
    return u.select("conv_id", "turn", "leans", (F.col("leans") & F.col("before").isNull()).alias("unclear"), F.md5(asked.cast("binary")).alias("digest"))


@query("p24_names", f"""WITH x AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages),
y AS (SELECT page_id, substr(trim(regexp_replace(regexp_replace(t, '[\\[\\](){{}}<>"`|#]', '·', 'g'), '\\s+', ' ', 'g')), 1, 60) AS label, substr(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 80) AS name FROM x)
SELECT page_id, CASE WHEN label = '' THEN '未命名' ELSE label END AS label, CASE WHEN name = '' THEN 'page' WHEN upper(name) IN ({RESERVED}) THEN '收藏-' || name ELSE name END AS file_name FROM y""")
def p24_names(spark, d):
    head = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read(spark, d, "pages").select("page_id", N.label(head).alias("label"), N.file_name(F.col("url"), F.lit("page")).alias("file_name"))


@query("p31_safe_member", r"""WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'other/' ELSE 'pages/' END || CASE page_id % 4 WHEN 0 THEN '' ELSE regexp_replace(url, '^https?://', '') END AS path FROM pages)
SELECT page_id, length(path) > 0 AND NOT regexp_matches(path, '[\\:\x00]') AND len(list_filter(string_split(path, '/'), lambda p: p = '' OR p = '.' OR p = '..' OR regexp_matches(p, '[ .]$') OR regexp_matches(p, '[\x00-\x1f<>"|?*]') OR regexp_matches(p, '(?i)^(CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])(\.|$)'))) = 0 AND (path = 'manifest.json' OR starts_with(path, 'pages/')) AS safe FROM x""")
def p31_safe_member(spark, d):
    """Page addresses as members of an archive that holds one file and one folder."""
    n, address = F.col("page_id") % 4, F.regexp_replace("url", "^https?://", "")
    path = F.when(n == 0, "manifest.json").when(n == 1, F.concat(F.lit("other/"), address)).otherwise(F.concat(F.lit("pages/"), address))
    return read(spark, d, "pages").select("page_id", N.safe_member(path, ("manifest.json",), ("pages",)).alias("safe"))


SPECULATES = " OR ".join(f"contains(body, '{p}')" for p in T.SPECULATION)
SQL_FORMATS = f"""{SQL_CITED},
w AS (SELECT conv_id, turn, labels, turn % 3 AS kind, CASE WHEN turn % 3 = 0 THEN '资料不足：' || answer WHEN turn % 3 = 1 THEN '结论：' || answer || chr(10) || '依据：' ELSE '资料冲突：' || answer END AS body FROM cited),
g AS (SELECT conv_id, turn, CASE kind WHEN 1 THEN 'answer' WHEN 0 THEN 'abstain' ELSE 'conflict' END AS expected,
  CASE kind WHEN 1 THEN starts_with(body, '结论：') AND NOT contains(body, '资料不足') AND NOT contains(body, '资料冲突') WHEN 0 THEN starts_with(body, '资料不足：') AND NOT contains(body, '结论：') ELSE starts_with(body, '资料冲突：') AND NOT contains(body, '结论：') END AS behavior_correct,
  CASE kind WHEN 1 THEN length(body) - length(replace(body, chr(10), '')) = 1 AND contains(body, chr(10) || '依据：') ELSE NOT contains(trim(body, {WHITE}), chr(10)) END AS format_correct,
  len(list_filter(labels, lambda x: x NOT IN ('S1', 'S2', 'S3'))) = 0 AS citations_available, array_to_string(labels, ',') = 'S' || (turn % 5) AS citations_exact, NOT ({SPECULATES}) AS no_speculation FROM w),
formats AS (SELECT *, behavior_correct AND format_correct AND citations_available AND citations_exact AND no_speculation AS passed FROM g)"""


def formatted(spark, d):
    """Answers in the three formats by turn, each expected to cite the label of its turn."""
    kind = F.col("turn") % 3
    rows = evidence.cited(answers(spark, d).withColumn("available", T.literals(("S1", "S2", "S3"))))
    body = F.when(kind == 0, F.concat(F.lit("资料不足："), "answer")).when(kind == 1, F.concat(F.lit("结论："), "answer", F.lit("\n依据："))).otherwise(F.concat(F.lit("资料冲突："), "answer"))
    rows = rows.withColumn("answer", body).withColumn("expected", F.when(kind == 1, "answer").when(kind == 0, "abstain").otherwise("conflict"))
    rows = rows.withColumn("required", F.array(F.concat(F.lit("S"), F.col("turn") % 5))).withColumn("must_mention", F.array().cast("array<string>"))
    return evaluation.score_formats(rows).select("conv_id", "turn", "expected", "behavior_correct", "format_correct", "citations_available", "citations_exact", "no_speculation", "passed")


@query("g3_answer_formats", f"WITH {SQL_FORMATS} SELECT * FROM formats")
def g3_answer_formats(spark, d):
    return formatted(spark, d)


@query("a14_check_counts", f"WITH {SQL_FORMATS} SELECT expected, count(*) AS answers, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in evaluation.CHECKS)} FROM formats GROUP BY expected")
def a14_check_counts(spark, d):
    return evaluation.check_counts(formatted(spark, d), "expected")


SQL_CASES = f"""{SQL_BM25}, {SQL_RELEVANT},
want AS (SELECT DISTINCT r.query_id, source FROM relevant r JOIN documents ON doc_id = chunk_id),
got AS (SELECT query_id, source, min(rank) AS rank FROM bm25_top JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY ALL),
cases AS (SELECT item_id AS query_id, (SELECT count(*) FROM want w WHERE w.query_id = item_id) > 0 AS in_domain, (SELECT count(*) FROM got g WHERE g.query_id = item_id) AS retrieved,
  (SELECT count(*) FROM got g JOIN want w ON w.query_id = g.query_id AND w.source IS NOT DISTINCT FROM g.source WHERE g.query_id = item_id) AS matched FROM benchmark)"""


def cases(spark, d):
    """Each question with the sources that hold its passage and those found for it."""
    source = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    want = relevant(spark, d).join(source, "chunk_id").select("query_id", "source")
    got = found(spark, d).join(source, "chunk_id").select("query_id", "source")
    return evaluation.retrieval_cases(questions(spark, d).select("query_id"), want, got)


@query("g4_retrieval_cases", f"WITH {SQL_CASES} SELECT query_id, in_domain, retrieved, matched, CASE WHEN in_domain THEN matched > 0 ELSE retrieved = 0 END AS passed FROM cases")
def g4_retrieval_cases(spark, d):
    return cases(spark, d)


@query("a10_evaluation_summary", f"""WITH {SQL_CASES} SELECT count(*) FILTER (in_domain) AS in_domain, count(*) FILTER (NOT in_domain) AS out_of_domain,
  count(*) FILTER (in_domain AND matched > 0) / nullif(count(*) FILTER (in_domain), 0) AS recall, count(*) FILTER (NOT in_domain AND retrieved = 0) / nullif(count(*) FILTER (NOT in_domain), 0) AS rejection FROM cases""")
def a10_evaluation_summary(spark, d):
    return evaluation.case_summary(cases(spark, d))


SQL_LENIENT = f"""{SQL_BM25}, keys AS (SELECT item_id AS query_id, list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 5) AS keywords FROM benchmark),
lenient AS (SELECT k.query_id, CAST(min(CASE WHEN len(keywords) > 0 AND len(list_filter(keywords, lambda w: NOT contains(lower(d.text), w))) = 0 THEN rank END) AS INTEGER) AS first_rank
  FROM keys k LEFT JOIN bm25_top b ON b.query_id = k.query_id AND rank <= 10 LEFT JOIN documents d ON d.doc_id = b.chunk_id GROUP BY k.query_id)"""


@query("r11_lenient_rank", f"WITH {SQL_LENIENT} SELECT * FROM lenient")
def r11_lenient_rank(spark, d):
    """Keywords are a question's first five tokens; any document found that holds them all answers it."""
    asked = questions(spark, d).select("query_id", F.slice(T.tokenize(F.col("query")), 1, 5).alias("keywords"))
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return evaluation.lenient_rank(asked, found(spark, d), texts)


@query("a12_lenient_summary", f"WITH {SQL_LENIENT} SELECT count(*) AS questions, count(*) FILTER (first_rank <= 1) / count(*) AS recall_1, count(*) FILTER (first_rank <= 5) / count(*) AS recall_5, count(*) FILTER (first_rank <= 8) / count(*) AS recall_8, list_sum(list(coalesce(1::DOUBLE / first_rank, 0) ORDER BY coalesce(1::DOUBLE / first_rank, 0))) / count(*) AS mrr FROM lenient")
def a12_lenient_summary(spark, d):
    return evaluation.summary(r11_lenient_rank(spark, d))


@query("a5_setup", "SELECT count(*) AS total, count(*) FILTER (n_chars >= 200) AS ready FROM documents")
def a5_setup(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 200).alias("ready"))


@query("a8_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def a8_status_counts(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("a22_diagnostics", "SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages, count(*) FILTER (role = 'assistant') AS answers FROM conversations")
def a22_diagnostics(spark, d):
    return read(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("d5_duplicates", "SELECT sha256(text) AS text_sha256, count(*) AS rows, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def d5_duplicates(spark, d):
    """Texts that a split must refuse: those that more than one row holds."""
    rows = read(spark, d, "documents").select("doc_id", T.sha256(F.col("text")).alias("text_sha256"))
    return rows.groupBy("text_sha256").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id")).where("rows > 1")


@query("j2_listing", "SELECT l.doc_id, source, n_chars, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE toxic = 0")
def j2_listing(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels").where("toxic = 0"), "doc_id").select("doc_id", "source", "n_chars", "quality")


@query("r15_newest", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def r15_newest(spark, d):
    return read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "event_type")


@query("t6_libraries", "SELECT DISTINCT source, lang FROM documents")
def t6_libraries(spark, d):
    return read(spark, d, "documents").select("source", "lang").distinct()


@query("w2_feedback", "SELECT user_id, event_type, arg_max(value, struct_pack(ts := ts, id := event_id)) AS value, max(struct_pack(ts := ts, id := event_id)).id AS event_id FROM events GROUP BY user_id, event_type")
def w2_feedback(spark, d):
    """The last value of each (user, kind): what upserts in the order of time leave."""
    last = F.max(F.struct("ts", F.col("event_id").alias("id"), "value")).alias("x")
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "x.value", F.col("x.id").alias("event_id"))
