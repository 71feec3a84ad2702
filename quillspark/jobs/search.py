"""Registered queries: searches of several questions in one, parameter sweeps, highlights, outlines as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, fusion, studio
from .catalog import SQL_CHUNKS, SQL_DENSE, SQL_RELEVANT, indexed, query, questions, read, relevant, rounded, vectors

SQL_INDEX = SQL_CHUNKS[: SQL_CHUNKS.index("\nwanted AS")].rstrip(",")


def words(text, low, high):
    return F.array_join(F.slice(F.split(text, " "), low, high - low + 1), " ")


def enumerating(spark, d):
    """Passages as questions: every second one lists three subjects (its words 1 to 12, in fours), of which half name a place."""
    text = F.col("query")
    parts = [words(text, a, a + 3) for a in (1, 5, 9, 13)]
    kind = F.col("query_id") % 4
    listed = F.concat(parts[0], F.lit("、"), parts[1], F.lit("和"), parts[2], F.lit("分别"), parts[3])
    placed = F.concat(parts[0], F.lit("与"), parts[1], F.lit("在"), parts[2], F.lit("分别"), parts[3])
    return questions(spark, d).select("query_id", F.when(kind == 2, listed).when(kind == 0, placed).otherwise(words(text, 1, 12)).alias("query"))


@query("p19_subjects", """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), p AS (SELECT item_id, array_to_string(w[1:4], ' ') AS a, array_to_string(w[5:8], ' ') AS b, array_to_string(w[9:12], ' ') AS c, array_to_string(w[13:16], ' ') AS e, array_to_string(w[1:12], ' ') AS f FROM w),
s AS (SELECT item_id, CASE item_id % 4 WHEN 2 THEN [a || ' ' || e, b || ' ' || e, c || ' ' || e] WHEN 0 THEN [a || ' 在' || c || ' ' || e, b || ' 在' || c || ' ' || e] ELSE [f] END AS subs FROM p)
SELECT item_id AS query_id, CAST(unnest(range(len(subs))) AS INTEGER) AS part, trim(unnest(subs), ' ' || chr(10)) AS sub FROM s""")
def p19_subjects(spark, d):
    return enumerating(spark, d).select("query_id", F.posexplode(T.decompose(F.col("query"))).alias("part", "sub"))


@query("r8_multi_query", f"""WITH {SQL_INDEX}, w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), p AS (SELECT item_id, array_to_string(w[1:4], ' ') AS a, array_to_string(w[5:8], ' ') AS b, array_to_string(w[9:12], ' ') AS c, array_to_string(w[13:16], ' ') AS e, array_to_string(w[1:12], ' ') AS f FROM w),
s AS (SELECT item_id, CASE item_id % 4 WHEN 2 THEN [a || ' ' || e, b || ' ' || e, c || ' ' || e] WHEN 0 THEN [a || ' ' || c || ' ' || e, b || ' ' || c || ' ' || e] ELSE [f] END AS subs FROM p),
q AS (SELECT item_id AS query_id, len(subs) AS parts, unnest(range(len(subs))) AS part, unnest(subs) AS sub FROM s),
wanted AS (SELECT DISTINCT query_id, parts, part, unnest(regexp_extract_all(lower(sub), '[a-z0-9]+')) AS token FROM q),
scored AS (SELECT query_id, parts, part, p.chunk_id, p.token, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)) AS score FROM post p JOIN df USING (token) JOIN wanted USING (token) JOIN lens ON p.chunk_id = lens.chunk_id, stats),
sums AS (SELECT query_id, parts, part, chunk_id, list_sum(list(score ORDER BY token)) AS score FROM scored GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, chunk_id) AS rank FROM sums),
votes AS (SELECT query_id, parts, chunk_id, part, CASE WHEN parts = 1 THEN score ELSE 1::DOUBLE / (60 + rank) END AS vote FROM top WHERE rank <= CASE WHEN parts = 1 THEN 5 ELSE 3 END),
fused AS (SELECT query_id, parts, chunk_id, list_sum(list(vote ORDER BY part)) AS score FROM votes GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused)
SELECT query_id, CAST(parts AS INTEGER) AS parts, chunk_id, round(score, 9) AS score, rank FROM best WHERE rank <= 5""")
def r8_multi_query(spark, d):
    return rounded(fusion.multi_query(enumerating(spark, d), indexed(spark, d)))


SETTINGS = [
    {"name": "bm25", "mode": "bm25"},
    {"name": "bm25:k1=0.9", "mode": "bm25", "k1": 0.9},
    {"name": "bm25:k1=1.2", "mode": "bm25", "k1": 1.2},
    {"name": "bm25:k1=2.0", "mode": "bm25", "k1": 2.0},
    {"name": "bm25:b=0.3", "mode": "bm25", "b": 0.3},
    {"name": "bm25:b=1.0", "mode": "bm25", "b": 1.0},
    {"name": "bm25:heading_repeat=0", "mode": "bm25", "heading_repeat": 0},
    {"name": "bm25:heading_repeat=3", "mode": "bm25", "heading_repeat": 3},
    {"name": "hybrid", "mode": "hybrid"},
    {"name": "hybrid:rrf_k=10", "mode": "hybrid", "rrf_k": 10},
    {"name": "hybrid:rrf_k=100", "mode": "hybrid", "rrf_k": 100},
    {"name": "hybrid:candidate_k=10", "mode": "hybrid", "candidates": 10},
    {"name": "hybrid:candidate_k=20", "mode": "hybrid", "candidates": 20},
    {"name": "hybrid:b=0.3", "mode": "hybrid", "b": 0.3},
]
DEFAULTS = {"k1": 1.5, "b": 0.75, "heading_repeat": 1, "rrf_k": 60, "candidates": 50}
SQL_SETTINGS = ", ".join("('{name}', '{mode}', {k1}::DOUBLE, {b}::DOUBLE, {heading_repeat}, {rrf_k}, {candidates})".format(**(DEFAULTS | s)) for s in SETTINGS)


@query("r14_sweep", f"""WITH {SQL_CHUNKS}, {SQL_DENSE}, {SQL_RELEVANT}, sets AS (SELECT * FROM (VALUES {SQL_SETTINGS}) s(setting, mode, k1, b, rep, rrf, cand)),
forms AS (SELECT DISTINCT k1, b, rep FROM sets),
sizes AS (SELECT chunk_id, k1, b, rep, len(h) * (1 + rep) + len(t) AS size, sum(len(h) * (1 + rep) + len(t)) OVER (PARTITION BY k1, b, rep) / count(*) OVER (PARTITION BY k1, b, rep) AS avgdl FROM chunks, forms),
parts AS (SELECT query_id, p.chunk_id, p.token, k1, b, rep, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (heading_tf * (1 + rep) + text_tf) * (k1 + 1) / ((heading_tf * (1 + rep) + text_tf) + k1 * ((1 - b) + b * size / z.avgdl)) AS score
  FROM post p JOIN df USING (token) JOIN wanted USING (token) JOIN sizes z ON z.chunk_id = p.chunk_id, stats),
sums AS (SELECT query_id, chunk_id, k1, b, rep, list_sum(list(score ORDER BY token)) AS score FROM parts GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id, k1, b, rep ORDER BY score DESC, chunk_id) AS rank FROM sums WHERE score > 0),
votes AS (SELECT setting, query_id, chunk_id, 0 AS c, 1::DOUBLE / (rrf + rank) AS vote FROM lex JOIN sets USING (k1, b, rep) WHERE mode = 'hybrid' AND rank <= cand UNION ALL SELECT setting, query_id, chunk_id, 1, 1::DOUBLE / (rrf + rank) FROM dense_top, sets WHERE mode = 'hybrid' AND rank <= cand),
fused AS (SELECT setting, query_id, chunk_id, list_sum(list(vote ORDER BY c)) AS score FROM votes GROUP BY ALL),
hits AS (SELECT setting, query_id, chunk_id, rank FROM lex JOIN sets USING (k1, b, rep) WHERE mode = 'bm25' AND rank <= 10 UNION ALL SELECT * FROM (SELECT setting, query_id, chunk_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 10),
ranks AS (SELECT h.setting, h.query_id, min(CASE WHEN r.chunk_id IS NOT NULL THEN rank END) AS first FROM hits h LEFT JOIN relevant r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id GROUP BY ALL),
turns AS (SELECT a.setting, count(*) FILTER (coalesce(a.first, 1073741824) < coalesce(o.first, 1073741824)) AS better, count(*) FILTER (coalesce(a.first, 1073741824) > coalesce(o.first, 1073741824)) AS worse FROM ranks a JOIN sets s ON s.setting = a.setting LEFT JOIN ranks o ON o.setting = s.mode AND o.query_id = a.query_id GROUP BY a.setting)
SELECT setting, count(*) AS questions, count(*) FILTER (first <= 1) / count(*) AS recall_1, count(*) FILTER (first <= 5) / count(*) AS recall_5, count(*) FILTER (first <= 8) / count(*) AS recall_8,
  list_sum(list(coalesce(1::DOUBLE / first, 0) ORDER BY coalesce(1::DOUBLE / first, 0))) / count(*) AS mrr, any_value(better) AS better, any_value(worse) AS worse FROM ranks JOIN turns USING (setting) GROUP BY setting""")
def r14_sweep(spark, d):
    """Fourteen settings over the benchmark's passages, from one pass over the postings."""
    return evaluation.sweep(questions(spark, d), relevant(spark, d), indexed(spark, d), *vectors(spark, d), SETTINGS)


@query("p26_highlight", """WITH t AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations),
n AS (SELECT *, list_sort(list_distinct(list_transform(list_filter([w[1], substr(w[1], 1, 2), w[3], substr(w[3], 1, 1) || '.', ''], lambda x: length(x) > 0), lambda x: lower(x)))) AS needles FROM t),
p AS (SELECT *, '(?i)(?:' || array_to_string(list_transform(list_sort(list_transform(needles, lambda x: {'n': -length(x), 't': x})), lambda x: '\\Q' || x.t || '\\E'), '|') || ')' AS pat FROM n)
SELECT conv_id, turn, CAST(len(regexp_extract_all(text, pat)) AS INTEGER) AS hits, md5(regexp_replace(text, pat, '<\\0>', 'g')) AS digest FROM p""")
def p26_highlight(spark, d):
    """A turn's first and third word and their beginnings marked wherever the turn has them."""
    w = F.split("text", " ")
    first, third = F.get(w, 0), F.coalesce(F.get(w, 2), F.lit(""))
    tokens = F.array(first, F.substring(first, 1, 2), third, F.when(F.length(third) > 0, F.concat(F.substring(third, 1, 1), F.lit("."))), F.lit(""), F.lit(None).cast("string"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", T.highlighted(F.col("text"), tokens).alias("pieces"))
    marked = F.array_join(F.transform("pieces", lambda x: F.when(x["hit"], F.concat(F.lit("<"), x["text"], F.lit(">"))).otherwise(x["text"])), "")
    return rows.select("conv_id", "turn", F.size(F.filter("pieces", lambda x: x["hit"])).alias("hits"), F.md5(marked.cast("binary")).alias("digest"))


@query("e10_mindmap", """WITH RECURSIVE s AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+', '/', 'g'), '/'), lambda x: x <> '') AS p FROM pages),
n AS (SELECT p[1] AS host, unnest(list_transform(range(2, len(p) + 1), lambda i: p[2:i])) AS path, page_id FROM s),
g AS (SELECT host, path, min(page_id) AS first, count(DISTINCT page_id) AS sources FROM n GROUP BY host, path),
c AS (SELECT *, path[1 : len(path) - 1] AS parent, row_number() OVER (PARTITION BY host, path[1 : len(path) - 1] ORDER BY first, path[len(path)]) AS place FROM g),
k AS (SELECT host, path, sources, printf('%010d', place) AS key FROM c WHERE len(path) = 1 UNION ALL SELECT c.host, c.path, c.sources, k.key || '/' || printf('%010d', c.place) FROM k JOIN c ON c.host = k.host AND c.parent = k.path)
SELECT host, 'mindmap' || chr(10) || '  root((' || host || '))' || chr(10) || string_agg(repeat('  ', CAST(len(path) + 1 AS INTEGER)) || path[len(path)] || ' ' || sources, chr(10) ORDER BY key) AS mermaid FROM k GROUP BY host""")
def e10_mindmap(spark, d):
    """The pages of each host as a tree of their paths."""
    parts = F.filter(F.split(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/+"), lambda x: F.length(x) > 0)
    rows = read(spark, d, "pages").select(F.col("page_id").alias("source"), parts.alias("parts")).where(F.size("parts") > 1)
    rows = rows.select(F.get("parts", 0).alias("host"), F.slice("parts", 2, F.size("parts")).alias("segments"), "source")
    return studio.mindmap(rows, "host")
