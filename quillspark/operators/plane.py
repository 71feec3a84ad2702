"""Updates of the relational tables, each as new tables from old ones: document versions, snapshots, deletions, copies.

Nothing is changed in place. An operator takes tables and a batch of requests and gives the tables that follow, with a
report row for every request; writing them is the caller's, as a version of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T

READY = ("ready", "updating")


def next_numbers(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """document_id, next: one more than the highest version number of every document, 1 without any."""
    highest = versions.groupBy("document_id").agg(F.max("number").alias("number"))
    return documents.select("document_id").join(highest, "document_id", "left").select("document_id", (F.coalesce("number", F.lit(0)) + 1).alias("next"))


def new_versions(documents: DataFrame, versions: DataFrame, chunks: DataFrame, incoming: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, versions, chunks) after texts came in.

    documents: document_id, current_version_id, status and more; versions: document_id, version_id, number, checksum; chunks: document_id,
    version_id and what ``cut`` makes of (document_id, version_id, text); incoming: document_id, text, one row a document. A text
    with the checksum of the current version brings nothing; another one is the next version, which its document then points to, ready.
    Unknown documents are left out."""
    known = documents.select("document_id", F.col("current_version_id").alias("version_id")).join(versions.select("document_id", "version_id", "checksum"), ["document_id", "version_id"], "left")
    came = incoming.select("document_id", "text", T.sha256(F.coalesce("text", F.lit(""))).alias("new")).join(known.select("document_id", "checksum"), "document_id")
    came = came.where(~F.col("new").eqNullSafe(F.col("checksum"))).join(next_numbers(documents, versions), "document_id")
    version_id = F.substring(T.sha256(F.concat_ws(":", F.col("document_id").cast("string"), F.col("next").cast("string"), "new")), 1, 24)
    came = came.select("document_id", version_id.alias("version_id"), F.col("next").alias("number"), F.col("new").alias("checksum"), "text")
    pointed = documents.join(came.select("document_id", F.col("version_id").alias("_v")), "document_id", "left")
    pointed = pointed.withColumns({"current_version_id": F.coalesce("_v", "current_version_id"), "status": F.when(F.col("_v").isNotNull(), "ready").otherwise(F.col("status"))})
    return pointed.select(documents.columns), versions.unionByName(came.select(versions.columns)), chunks.unionByName(cut(came.select("document_id", "version_id", "text")).select(chunks.columns))


def snapshot(documents: DataFrame, chunks: DataFrame, libraries: DataFrame) -> DataFrame:
    """Chunks that a search may find: of the current version of documents that are there and ready, or ready but updating, in active libraries."""
    live = documents.where(~F.col("removed") & F.col("status").isin(*READY)).join(libraries.where("active").select("library"), "library", "left_semi")
    return chunks.join(live.select("document_id", F.col("current_version_id").alias("version_id"), "library"), ["document_id", "version_id"])


def resolved(sources: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Source rows (document_id, version_id) with found: whether that version of that document is still there; removed documents are not."""
    have = versions.join(documents.where(~F.col("removed")).select("document_id"), "document_id", "left_semi").select("document_id", "version_id", F.lit(True).alias("found"))
    return sources.join(have, ["document_id", "version_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete_batch(table: DataFrame, key: str, ids: DataFrame, busy: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(table without the rows asked for, report of ids (``key``): deleted, not_found, or busy, which stays)."""
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    state = table.select(key, F.when(busy if busy is not None else F.lit(False), "busy").otherwise("deleted").alias("outcome"))
    state = state.groupBy(key).agg(F.min("outcome").alias("outcome"))
    report = asked.join(state, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_found")))
    return table.join(report.where("outcome = 'deleted'").select(key), key, "left_anti"), report


def disconnect(libraries: DataFrame, documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(libraries, documents, report) after libraries were disconnected: they turn inactive and their documents removed; no row goes.

    report: library, outcome (disconnected, not_found), deleted (documents removed now)."""
    asked = ids.select("library").distinct()
    hit = asked.join(libraries.where("active").select("library"), "library", "left_semi").withColumn("_hit", F.lit(True))
    off = libraries.join(hit, "library", "left").withColumn("active", F.col("active") & F.col("_hit").isNull()).drop("_hit")
    gone = documents.join(hit, "library", "left").withColumn("_now", F.col("_hit").isNotNull() & ~F.col("removed"))
    counts = gone.where("_now").groupBy("library").agg(F.count("*").alias("deleted"))
    left = gone.withColumns({"status": F.when(F.col("_now"), "removed").otherwise(F.col("status")), "removed": F.col("removed") | F.col("_now")}).select(documents.columns)
    report = asked.join(hit, "library", "left").join(counts, "library", "left")
    return off, left, report.select("library", F.when(F.col("_hit"), "disconnected").otherwise("not_found").alias("outcome"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


def delete_conversations(messages: DataFrame, favorites: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages left, report: conv_id, outcome, messages, kept_favorites). Favorites are copies and stay."""
    asked = ids.select("conv_id").distinct()
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("messages"))
    kept = messages.join(favorites.select("message_id"), "message_id").groupBy("conv_id").agg(F.count("*").alias("kept_favorites"))
    report = asked.join(counts, "conv_id", "left").join(kept, "conv_id", "left")
    outcome = F.when(F.col("messages").isNull(), "not_found").otherwise("deleted").alias("outcome")
    return messages.join(asked, "conv_id", "left_anti"), report.select("conv_id", outcome, F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("kept_favorites", F.lit(0)).alias("kept_favorites"))


def copy_favorites(asked: DataFrame, messages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(favorites, their sources, report of asked (message_id)) of complete answers with sources: question and answer as they are now.

    messages: message_id, role, status, text, reply_to; sources: message_id, position and more. report: copied, not_found, not_complete, no_sources."""
    wanted = asked.select("message_id").distinct()
    answers = messages.where("role = 'assistant'").select("message_id", "status", F.col("text").alias("answer"), F.col("reply_to").alias("asked_id"))
    answers = answers.join(messages.select(F.col("message_id").alias("asked_id"), F.col("text").alias("question")), "asked_id")
    cited = sources.groupBy("message_id").agg(F.count("*").alias("sources"))
    state = wanted.join(answers, "message_id", "left").join(cited, "message_id", "left")
    outcome = F.when(F.col("answer").isNull(), "not_found").when(F.col("status") != "complete", "not_complete").when(F.col("sources").isNull(), "no_sources").otherwise("copied")
    state = state.withColumn("outcome", outcome)
    short = F.substring(T.strip(F.regexp_replace("question", r"(?U)\s+", " ")), 1, 80)
    made = state.where("outcome = 'copied'").select("message_id", F.when(F.length(short) > 0, short).otherwise("收藏的回答").alias("title"), "question", "answer", "sources")
    return made, sources.join(made.select("message_id"), "message_id", "left_semi"), state.select("message_id", "outcome")


def filter_favorites(favorites: DataFrame, library: str | None = None, tag: str | None = None, feedback: str | None = None, since: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(favorites that pass, choices: kind, value) of favorites (id, libraries, tags, feedback, updated_at).

    The choices, libraries, tags and the total, are those of all favorites, so that a filter does not take the others away."""
    keep = F.lit(True)
    for wanted, column in ((library, "libraries"), (tag, "tags")):
        if wanted is not None:
            keep &= F.array_contains(column, wanted)
    if feedback is not None:
        keep &= F.coalesce(F.col("feedback") == feedback, F.lit(False))
    if since is not None:
        keep &= F.col("updated_at") >= since
    each = [favorites.select(F.lit(kind).alias("kind"), F.explode(column).alias("value")).distinct() for kind, column in (("library", "libraries"), ("tag", "tags"))]
    total = favorites.agg(F.count("*").cast("string").alias("value")).select(F.lit("total").alias("kind"), "value")
    return favorites.where(keep), each[0].unionByName(each[1]).unionByName(total)


def update_favorites(favorites: DataFrame, changes: DataFrame) -> DataFrame:
    """favorites (id, title, note, tags) after changes (the same columns; null: as it is): texts trimmed and cut, tags in order.

    A change whose title is blank is refused as a whole, as are more than eight tags."""
    title, tags = T.strip(F.regexp_replace("n.title", r"(?U)\s+", " ")), N.tags(F.col("n.tags"))
    fine = (F.col("n.title").isNull() | (F.length(title) > 0)) & (F.col("n.tags").isNull() | (F.size(tags) <= 8))
    new = lambda c, value: F.when(fine, F.coalesce(value, F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}")).alias(c)
    both = favorites.alias("o").join(changes.alias("n"), "id", "left")
    return both.select("id", new("title", F.substring(title, 1, 100)), new("note", F.substring(T.strip(F.col("n.note")), 1, 4000)), new("tags", tags))


def recovered(jobs: DataFrame, running: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """Jobs (status, error and more) after a restart: what was under way is interrupted, with a reason; the rest is as it was."""
    cut = F.col("status").isin(*running)
    return jobs.withColumn("error", F.when(cut, "interrupted by a restart").otherwise(F.col("error"))).withColumn("status", F.when(cut, "failed").otherwise(F.col("status")))


def layered(**layers: DataFrame) -> DataFrame:
    """The layers' source rows (message_id, position and more) one after the other, as label S1, S2, ... of each message, with their origin."""
    rows = None
    for place, (origin, layer) in enumerate(layers.items()):
        one = layer.withColumns({"origin": F.lit(origin), "_layer": F.lit(place)})
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    order = Window.partitionBy("message_id").orderBy("_layer", "position")
    return rows.withColumn("position", F.row_number().over(order)).withColumn("label", F.concat(F.lit("S"), "position")).drop("_layer")
