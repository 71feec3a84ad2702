"""Registered queries of the relational plane: versioned builds, document versions, snapshots, deletions and copies.

Libraries are the documents' sources, messages the conversations' turns, and states follow from the numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, plane, sections
from ..sources import versions
from ..sources.files import scratch_folder, spread
from .catalog import query, read
from .markdown import sql_runs

#: Four states of the corpus: the first, the same again, one with additions, edits and losses, and one with more edits.
STATES = (
    ("doc_id % 10 <> 0", "text"),
    ("doc_id % 10 <> 0", "text"),
    ("doc_id % 11 <> 0", "CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END"),
    ("doc_id % 11 <> 0", "CASE WHEN doc_id % 5 = 1 THEN concat(text, chr(10), 'more') WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END"),
)


def corpus(spark, d, state: int):
    where, text = STATES[state]
    return spread(read(spark, d, "documents")).where(where).select(F.col("doc_id").alias("source_file"), F.col("source").alias("title"), F.expr(text).alias("text"))


def line_chunks(documents):
    """source_file, part, first_line, last_line, text: greedy runs of lines of at most 800 characters."""
    rows = documents.where(F.length("text") > 0).withColumn("rows", T.lines(F.col("text")))
    rows = rows.withColumn("run", sections.runs(F.sequence(F.lit(1), F.size("rows")), F.transform("rows", lambda x: F.length(x)), 800))
    rows = rows.select("source_file", "rows", F.posexplode("run").alias("part", "run"))
    text = F.array_join(F.slice("rows", F.element_at("run", 1), F.size("run")), "\n")
    return rows.select("source_file", "part", F.element_at("run", 1).alias("first_line"), F.element_at("run", -1).alias("last_line"), text.alias("text"))


def chunk_postings(chunks):
    rows = chunks.select(F.struct("source_file", "part").alias("chunk_id"), F.lit("").alias("heading"), "text")
    return lexical.postings(rows).select("chunk_id.source_file", "chunk_id.part", "token", "tf", "doc_len")


def built(spark, d):
    """(store, reports) of the four states built one after the other in a new folder."""
    root = f"{scratch_folder(spark)}/index-{uuid.uuid4().hex}"
    reports = [versions.build(spark, root, lambda state=state: corpus(spark, d, state), line_chunks, chunk_postings, "runs of 800") for state in range(len(STATES))]
    return versions.Store(spark, root), reports


FINAL = STATES[-1][1]


@query("w13_incremental_build", f"""WITH RECURSIVE f AS (SELECT doc_id, {FINAL} AS text, CASE WHEN doc_id % 5 = 1 THEN 3 WHEN doc_id % 10 = 0 OR doc_id % 7 = 0 THEN 2 ELSE 1 END AS built FROM documents WHERE doc_id % 11 <> 0 AND length(text) > 0),
d AS (SELECT doc_id AS id, regexp_replace(text, '\\n$', '') AS text FROM f),
lines AS (SELECT id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS line, length(unnest(x)) AS size FROM (SELECT id, string_split(text, chr(10)) AS x FROM d)), {sql_runs('lines', 'id')},
c AS (SELECT r.id, part, r.k, upto, string_agg(line, chr(10) ORDER BY l.k) AS text FROM run r JOIN lines l ON l.id = r.id AND l.k BETWEEN r.k AND r.upto GROUP BY r.id, part, r.k, upto)
SELECT id AS source_file, CAST(part AS INTEGER) AS part, built, CAST(k AS INTEGER) AS first_line, CAST(upto AS INTEGER) AS last_line, md5(c.text) AS digest, CAST(len(list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9]+'))) AS BIGINT) AS terms FROM c JOIN f ON doc_id = id""")
def w13_incremental_build(spark, d):
    """Chunks of the last of four states, with the version that cut each and the number of its postings."""
    store, _ = built(spark, d)
    terms = store.table("postings").groupBy("source_file", "part").agg(F.count("*").alias("terms"))
    rows = store.table("chunks").join(terms, ["source_file", "part"], "left")
    return rows.select("source_file", "part", "built", "first_line", "last_line", F.md5(F.col("text").cast("binary")).alias("digest"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))


@query("w7_index_versions", """WITH d AS (SELECT doc_id, doc_id % 10 <> 0 AS a, doc_id % 11 <> 0 AS b, doc_id % 7 = 0 AS e, doc_id % 5 = 1 AS f FROM documents)
SELECT 1 AS state, 'built' AS status, 1 AS version, NULL AS parent, count(*) FILTER (a) AS documents, count(*) FILTER (a) AS added, 0::BIGINT AS modified, 0::BIGINT AS deleted, count(*) FILTER (a) AS parsed FROM d
UNION ALL SELECT 2, 'unchanged', 1, NULL, count(*) FILTER (a), count(*) FILTER (a), 0, 0, count(*) FILTER (a) FROM d
UNION ALL SELECT 3, 'built', 2, 1, count(*) FILTER (b), count(*) FILTER (b AND NOT a), count(*) FILTER (a AND b AND e), count(*) FILTER (a AND NOT b), count(*) FILTER (b AND (NOT a OR e)) FROM d
UNION ALL SELECT 4, 'built', 3, 2, count(*) FILTER (b), 0, count(*) FILTER (b AND f), 0, count(*) FILTER (b AND f) FROM d""")
def w7_index_versions(spark, d):
    """What each of the four builds reports; the second finds nothing to do and gives the version that stands."""
    rows = [(k, r["status"], r["version"], r["parent"], *(r["stats"][c] for c in ("documents", "added", "modified", "deleted", "parsed"))) for k, r in enumerate(built(spark, d)[1], 1)]
    return spark.createDataFrame(rows, "state int, status string, version int, parent int, documents long, added long, modified long, deleted long, parsed long")


# Documents with a first version each; every fourth gets another text, every fourth the same again; none of every ninth has a version.
SQL_PLANE = """docs AS (SELECT doc_id AS document_id, source AS library, doc_id % 13 = 0 AS removed, CASE WHEN doc_id % 6 = 0 THEN 'failed' WHEN doc_id % 6 = 1 THEN 'updating' WHEN doc_id % 6 = 2 THEN 'pending' ELSE 'ready' END AS status, text FROM documents),
vers AS (SELECT document_id, 1 AS number, sha256(text) AS checksum FROM docs WHERE document_id % 9 <> 0),
inc AS (SELECT document_id, CASE WHEN document_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM docs WHERE document_id % 4 < 2),
came AS (SELECT i.document_id, coalesce(number, 0) + 1 AS number, i.text FROM inc i LEFT JOIN vers v ON v.document_id = i.document_id WHERE checksum IS NULL OR checksum <> sha256(i.text)),
allv AS (SELECT document_id, number FROM vers UNION ALL SELECT document_id, number FROM came),
lib AS (SELECT DISTINCT library, NOT ends_with(library, '3') AS active FROM docs)"""


def paragraphs(texts):
    """document_id, version_id, position, text: the lines of a version."""
    return texts.select("document_id", "version_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("position", "text"))


def tables(spark, d):
    """(documents, versions, chunks, libraries) after the incoming texts."""
    docs = read(spark, d, "documents")
    first = docs.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("v1-"), "doc_id").alias("version_id"), F.lit(1).alias("number"), T.sha256(F.col("text")).alias("checksum"), "text")
    status = F.expr("CASE WHEN doc_id % 6 = 0 THEN 'failed' WHEN doc_id % 6 = 1 THEN 'updating' WHEN doc_id % 6 = 2 THEN 'pending' ELSE 'ready' END")
    current = F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("v1-"), "doc_id"))
    documents = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("library"), (F.col("doc_id") % 13 == 0).alias("removed"), status.alias("status"), current.alias("current_version_id"))
    incoming = docs.where("doc_id % 4 < 2").select(F.col("doc_id").alias("document_id"), F.expr("CASE WHEN doc_id % 4 = 0 THEN concat(text, '!') ELSE text END").alias("text"))
    after = plane.new_versions(documents, first.drop("text"), paragraphs(first), incoming, paragraphs)
    libraries = docs.select(F.col("source").alias("library")).distinct().withColumn("active", ~F.col("library").endswith("3"))
    return *after, libraries


@query("w6_new_versions", f"WITH {SQL_PLANE} SELECT document_id, number, number = max(number) OVER (PARTITION BY document_id) AS current FROM allv")
def w6_new_versions(spark, d):
    documents, versions_, _, _ = tables(spark, d)
    pointed = documents.select("document_id", "current_version_id")
    return versions_.join(pointed, "document_id").select("document_id", "number", (F.col("version_id") == F.col("current_version_id")).alias("current"))


@query("a9_next_version", f"WITH {SQL_PLANE} SELECT d.document_id, coalesce(max(number), 0) + 1 AS next FROM docs d LEFT JOIN allv v ON v.document_id = d.document_id GROUP BY d.document_id")
def a9_next_version(spark, d):
    documents, versions_, _, _ = tables(spark, d)
    return plane.next_numbers(documents, versions_)


@query("j1_snapshot", f"""WITH {SQL_PLANE},
cur AS (SELECT d.document_id, library, coalesce(c.text, d.text) AS text FROM docs d LEFT JOIN came c ON c.document_id = d.document_id JOIN lib USING (library) WHERE active AND NOT removed AND (c.document_id IS NOT NULL OR status IN ('ready', 'updating')) AND (c.document_id IS NOT NULL OR d.document_id % 9 <> 0)),
l AS (SELECT document_id, library, unnest(range(len(x))) AS position, unnest(x) AS text FROM (SELECT document_id, library, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM cur WHERE length(text) > 0))
SELECT document_id, library, CAST(position AS INTEGER) AS position, md5(text) AS digest FROM l""")
def j1_snapshot(spark, d):
    """Lines of the current versions that a search may find."""
    documents, _, chunks, libraries = tables(spark, d)
    return plane.snapshot(documents, chunks, libraries).select("document_id", "library", "position", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("j8_resolution", f"WITH {SQL_PLANE}, s AS (SELECT event_id, user_id AS document_id, event_id % 3 AS number FROM events) SELECT event_id, v.number IS NOT NULL AND NOT removed AS found FROM s LEFT JOIN vers v ON v.document_id = s.document_id AND v.number = s.number LEFT JOIN docs d ON d.document_id = s.document_id")
def j8_resolution(spark, d):
    """Events as sources that name a document and a version: whether that one can still be opened."""
    documents, versions_, _, _ = tables(spark, d)
    sources = read(spark, d, "events").select("event_id", F.col("user_id").alias("document_id"), F.concat(F.lit("v"), F.col("event_id") % 3, F.lit("-"), "user_id").alias("version_id"))
    return plane.resolved(sources, documents, versions_).select("event_id", "found")


@query("w3_batch_delete", "WITH q AS (SELECT DISTINCT event_id AS doc_id FROM events WHERE event_id % 9 = 0) SELECT coalesce(q.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN q.doc_id IS NULL THEN 'left' ELSE 'deleted' END AS outcome FROM q FULL JOIN documents d ON q.doc_id = d.doc_id")
def w3_batch_delete(spark, d):
    """Every ninth event's number as ids to delete: what is left, and the report."""
    ids = read(spark, d, "events").where("event_id % 9 = 0").select(F.col("event_id").alias("doc_id"))
    left, report = plane.delete_batch(read(spark, d, "documents"), "doc_id", ids)
    return left.select("doc_id", F.lit("left").alias("outcome")).unionByName(report)


@query("w12_artifact_delete", "WITH q AS (SELECT DISTINCT event_id AS page_id FROM events WHERE event_id % 2 = 0) SELECT coalesce(q.page_id, p.page_id) AS page_id, CASE WHEN p.page_id IS NULL THEN 'not_found' WHEN q.page_id IS NULL THEN 'left' WHEN p.page_id % 5 = 1 OR p.page_id % 10 = 4 THEN 'busy' ELSE 'deleted' END AS outcome FROM q FULL JOIN pages p ON q.page_id = p.page_id UNION ALL SELECT page_id, 'left' FROM q JOIN pages p USING (page_id) WHERE page_id % 5 = 1 OR page_id % 10 = 4")
def w12_artifact_delete(spark, d):
    """Pages as artifacts, some still in the making: those stay, and the report says so."""
    ids = read(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("page_id"))
    left, report = plane.delete_batch(read(spark, d, "pages").select("page_id"), "page_id", ids, (F.col("page_id") % 5 == 1) | (F.col("page_id") % 10 == 4))
    return left.withColumn("outcome", F.lit("left")).unionByName(report)


@query("w4_disconnect", f"""WITH {SQL_PLANE}, q AS (SELECT DISTINCT library FROM docs WHERE ends_with(library, '1') OR ends_with(library, '3') UNION ALL SELECT 'nowhere')
SELECT q.library, CASE WHEN active THEN 'disconnected' ELSE 'not_found' END AS outcome, CASE WHEN active THEN count(*) FILTER (NOT removed) ELSE 0 END AS deleted, count(*) FILTER (removed OR active) AS removed_now FROM q LEFT JOIN lib USING (library) LEFT JOIN docs USING (library) WHERE q.library <> 'nowhere' GROUP BY q.library, active
UNION ALL SELECT 'nowhere', 'not_found', 0, 0""")
def w4_disconnect(spark, d):
    """Libraries disconnected, one that is off already and one that nobody knows: the report, and the removed documents of each."""
    documents, _, _, libraries = tables(spark, d)
    asked = libraries.where(F.col("library").endswith("1") | F.col("library").endswith("3")).select("library").unionByName(spark.createDataFrame([("nowhere",)], "library string"))
    _, left, report = plane.disconnect(libraries, documents, asked)
    now = left.where("removed").groupBy("library").agg(F.count("*").alias("removed_now"))
    return report.join(now, "library", "left").na.fill(0, ["removed_now"])


SQL_MESSAGES = """msgs AS (SELECT conv_id, turn, conv_id * 1000 + turn AS message_id, role, text, CASE WHEN turn % 8 = 7 THEN 'stopped' ELSE 'complete' END AS status FROM conversations),
srcs AS (SELECT m.message_id, k AS position, doc_id AS document_id, source AS library FROM msgs m, range(1, 4) r(k), documents WHERE doc_id = conv_id * 7 + turn * k AND role = 'assistant' AND turn % 4 <> 1 AND k <= 1 + turn % 3),
pairs AS (SELECT a.message_id, a.status, a.text AS answer, q.text AS question FROM msgs a JOIN msgs q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant')"""


def messages(spark, d):
    c = read(spark, d, "conversations")
    status = F.when(F.col("turn") % 8 == 7, "stopped").otherwise("complete")
    number = F.col("conv_id") * 1000 + F.col("turn")
    return c.select("conv_id", "turn", number.alias("message_id"), "role", status.alias("status"), "text", (number - 1).alias("reply_to"))


def message_sources(spark, d):
    rows = messages(spark, d).where("role = 'assistant' AND turn % 4 <> 1").select("message_id", "conv_id", "turn", F.explode(F.sequence(F.lit(1), (1 + F.col("turn") % 3).cast("int"))).alias("position"))
    rows = rows.withColumn("doc_id", F.col("conv_id") * 7 + F.col("turn") * F.col("position"))
    return rows.join(read(spark, d, "documents").select("doc_id", F.col("source").alias("library")), "doc_id").select("message_id", "position", F.col("doc_id").alias("document_id"), "library")


@query("w8_favorite_copy", f"""WITH {SQL_MESSAGES}, n AS (SELECT message_id, count(*) AS sources FROM srcs GROUP BY message_id),
s AS (SELECT m.message_id, CASE WHEN answer IS NULL THEN 'not_found' WHEN p.status <> 'complete' THEN 'not_complete' WHEN sources IS NULL THEN 'no_sources' ELSE 'copied' END AS outcome, question, answer, coalesce(sources, 0) AS sources FROM msgs m LEFT JOIN pairs p ON p.message_id = m.message_id LEFT JOIN n ON n.message_id = m.message_id)
SELECT message_id, outcome, CASE WHEN outcome = 'copied' THEN md5(substr(trim(regexp_replace(question, '\\s+', ' ', 'g')), 1, 80) || '|' || question || '|' || answer) END AS digest, CASE WHEN outcome = 'copied' THEN sources ELSE 0 END AS sources FROM s""")
def w8_favorite_copy(spark, d):
    """Every message asked for as a favorite: copies of whole answers with sources, and why the others are not copied."""
    made, copied, report = plane.copy_favorites(messages(spark, d).select("message_id"), messages(spark, d), message_sources(spark, d))
    made = made.select("message_id", F.md5(F.concat_ws("|", "title", "question", "answer").cast("binary")).alias("digest"))
    counts = copied.groupBy("message_id").agg(F.count("*").alias("sources"))
    return report.join(made, "message_id", "left").join(counts, "message_id", "left").na.fill(0, ["sources"])


SQL_FAVORITES = f"""{SQL_MESSAGES},
favs AS (SELECT message_id AS id, list_sort(list_distinct(list(library))) AS libraries, ['turn' || (message_id % 10), 'all'] AS tags, CASE message_id % 3 WHEN 0 THEN 'useful' WHEN 1 THEN 'wrong' END AS feedback, message_id % 60 AS age FROM srcs GROUP BY message_id)"""


def favorites(spark, d):
    rows = message_sources(spark, d).groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_set("library")).alias("libraries"))  # three at most
    feedback = F.when(F.col("id") % 3 == 0, "useful").when(F.col("id") % 3 == 1, "wrong")
    return rows.select("id", "libraries", F.array(F.concat(F.lit("turn"), F.col("id") % 10), F.lit("all")).alias("tags"), feedback.alias("feedback"), (-(F.col("id") % 60)).alias("updated_at"))


@query("w9_favorite_filters", f"""WITH {SQL_FAVORITES}
SELECT 'favorite' AS kind, CAST(id AS VARCHAR) AS value FROM favs WHERE list_contains(tags, 'turn3') AND feedback = 'useful' AND age <= 30
UNION ALL SELECT DISTINCT 'library', unnest(libraries) FROM favs UNION ALL SELECT DISTINCT 'tag', unnest(tags) FROM favs UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR) FROM favs""")
def w9_favorite_filters(spark, d):
    """Favorites of one tag and verdict from the last thirty days (ages stand for dates), and the choices of all favorites."""
    kept, choices = plane.filter_favorites(favorites(spark, d), tag="turn3", feedback="useful", since=F.lit(-30))
    return kept.select(F.lit("favorite").alias("kind"), F.col("id").cast("string").alias("value")).unionByName(choices)


@query("j7_conversation_delete", f"""WITH {SQL_FAVORITES}, q AS (SELECT DISTINCT conv_id FROM msgs WHERE conv_id % 4 = 0 UNION ALL SELECT -1)
SELECT q.conv_id, CASE WHEN count(m.conv_id) = 0 THEN 'not_found' ELSE 'deleted' END AS outcome, count(m.conv_id) AS messages, count(f.id) AS kept_favorites FROM q LEFT JOIN msgs m ON m.conv_id = q.conv_id LEFT JOIN favs f ON f.id = m.message_id GROUP BY q.conv_id
UNION ALL SELECT NULL, 'left', count(*), count(f.id) FROM msgs m LEFT JOIN favs f ON f.id = m.message_id WHERE conv_id % 4 <> 0""")
def j7_conversation_delete(spark, d):
    """Every fourth conversation and an unknown one deleted: the report, and how many messages and favorites' messages are left."""
    rows, marks = messages(spark, d), favorites(spark, d).select(F.col("id").alias("message_id"))
    asked = rows.where("conv_id % 4 = 0").select("conv_id").unionByName(spark.createDataFrame([(-1,)], "conv_id long"))
    left, report = plane.delete_conversations(rows, marks, asked)
    rest = left.join(marks.withColumn("f", F.lit(1)), "message_id", "left").agg(F.count("*").alias("messages"), F.count("f").alias("kept_favorites"))
    return report.unionByName(rest.select(F.lit(None).cast("long").alias("conv_id"), F.lit("left").alias("outcome"), "messages", "kept_favorites"))


@query("x22_favorite_update", f"""WITH {SQL_FAVORITES}, o AS (SELECT id, 'title ' || id AS title, 'note' AS note, tags FROM favs),
n AS (SELECT id, CASE id % 4 WHEN 0 THEN '  new   title ' WHEN 1 THEN ' ' END AS title, CASE WHEN id % 2 = 0 THEN ' n ' END AS note, CASE WHEN id % 8 = 2 THEN ['b', ' a  a ', 'b', ''] WHEN id % 8 = 6 THEN list_transform(range(9), lambda x: 't' || x) END AS tags FROM o WHERE id % 5 <> 0)
SELECT o.id, CASE WHEN n.id % 4 = 0 THEN 'new title' ELSE o.title END AS title, CASE WHEN n.id % 2 = 0 AND n.id % 8 <> 6 THEN 'n' ELSE o.note END AS note, CASE WHEN n.id % 8 = 2 THEN 'b,a a' ELSE array_to_string(o.tags, ',') END AS tags FROM o LEFT JOIN n ON n.id = o.id""")
def x22_favorite_update(spark, d):
    """Partial updates: titles and tags put in order, and those with a blank title or too many tags refused."""
    old = favorites(spark, d).select("id", F.concat(F.lit("title "), "id").alias("title"), F.lit("note").alias("note"), "tags")
    title = F.when(F.col("id") % 4 == 0, "  new   title ").when(F.col("id") % 4 == 1, " ")
    tags = F.when(F.col("id") % 8 == 2, T.literals(("b", " a  a ", "b", ""))).when(F.col("id") % 8 == 6, T.literals([f"t{k}" for k in range(9)]))
    changes = old.where("id % 5 <> 0").select("id", title.alias("title"), F.when(F.col("id") % 2 == 0, " n ").alias("note"), tags.alias("tags"))
    return plane.update_favorites(old, changes).withColumn("tags", F.array_join("tags", ","))


@query("w5_recovery", """WITH l AS (SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS last, CAST(max(ts) AS TIMESTAMP) AS at FROM events GROUP BY user_id),
s AS (SELECT user_id, CASE last WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status FROM l)
SELECT user_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'interrupted by a restart' WHEN status = 'failed' THEN 'own' END AS error FROM s""")
def w5_recovery(spark, d):
    """Users' last events as states of jobs, after a restart."""
    last = read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    status = F.when(F.col("last") == "view", "running").when(F.col("last") == "click", "queued").when(F.col("last") == "purchase", "complete").otherwise("failed")
    jobs = last.select("user_id", status.alias("status")).withColumn("error", F.when(F.col("status") == "failed", "own"))
    return plane.recovered(jobs)


@query("t5_layers", f"""WITH {SQL_MESSAGES}, r AS (SELECT message_id, 0 AS layer, 'note' AS origin, position, document_id FROM srcs UNION ALL SELECT message_id, 1, 'memory', 1, NULL FROM msgs WHERE role = 'assistant' AND message_id % 2 = 0 UNION ALL SELECT message_id, 2, 'web', k, NULL FROM msgs, range(1, 3) t(k) WHERE role = 'assistant' AND message_id % 3 = 0)
SELECT message_id, origin, document_id, 'S' || row_number() OVER w AS label, CAST(row_number() OVER w AS INTEGER) AS position FROM r WINDOW w AS (PARTITION BY message_id ORDER BY layer, position)""")
def t5_layers(spark, d):
    """Notes, then memory, then the web, as one numbered list of sources for each answer."""
    asked = messages(spark, d).where("role = 'assistant'").select("message_id")
    memory = asked.where("message_id % 2 = 0").withColumn("position", F.lit(1))
    web = asked.where("message_id % 3 = 0").select("message_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    rows = plane.layered(note=message_sources(spark, d).drop("library"), memory=memory, web=web)
    return rows.select("message_id", "origin", "document_id", "label", "position")


@query("x19_conversation", f"""WITH {SQL_MESSAGES}, n AS (SELECT message_id, string_agg('S' || position || ':' || document_id, ',' ORDER BY position) AS sources FROM srcs GROUP BY message_id)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, role, md5(text) AS digest, coalesce(sources, '') AS sources FROM msgs LEFT JOIN n USING (message_id)""")
def x19_conversation(spark, d):
    """Conversations as they are shown: turns in order, each with its sources."""
    each = F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("S"), "position", F.lit(":"), "document_id").alias("x"))))
    cited = message_sources(spark, d).groupBy("message_id").agg(F.array_join(F.transform(each, lambda x: x["x"]), ",").alias("sources"))
    rows = messages(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.join(cited, "message_id", "left").select("conv_id", "place", "role", F.md5(F.col("text").cast("binary")).alias("digest"), F.coalesce("sources", F.lit("")).alias("sources"))
