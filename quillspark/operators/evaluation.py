"""Retrieval and answer metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import scratch_table
from . import best, fusion, lexical


def expected_rank(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, first_rank over chunks of hits (query_id, chunk_id, rank); null if no relevant one is among them."""
    marked = hits.join(relevant.select("query_id", "chunk_id", F.lit(True).alias("hit")), ["query_id", "chunk_id"], "left")
    return marked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))


def document_ranks(hits: DataFrame) -> DataFrame:
    """query_id, path, rank over distinct documents: each keeps its first place."""
    first = hits.groupBy("query_id", "path").agg(F.min("rank").alias("at"))
    return first.select("query_id", "path", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "path")).alias("rank"))


def announced(ranks: DataFrame) -> DataFrame:
    """Adds at_1, at_5, at_8 and the reciprocal rank (0 without a hit)."""
    within = lambda k: F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"at_{k}")
    return ranks.select("*", within(1), within(5), within(8), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"))


def summary(ranks: DataFrame, *by: str) -> DataFrame:
    """Questions, recalls and mean reciprocal rank; null where nothing was asked."""
    rate = lambda c: F.try_divide(F.sum(F.col(c).cast("int")), F.count("*"))
    ordered = F.aggregate(F.array_sort(F.collect_list("reciprocal")), F.lit(0.0), lambda a, x: a + x)
    return announced(ranks).groupBy(*by).agg(F.count("*").alias("questions"), *[rate(f"at_{k}").alias(f"recall_{k}") for k in (1, 5, 8)], F.try_divide(ordered, F.count("*")).alias("mrr"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, verdict of b against a (query_id, first_rank): better, worse or unchanged; no hit is worst."""
    worst = 1 << 30
    x, y = F.coalesce("ra", F.lit(worst)), F.coalesce("rb", F.lit(worst))
    joined = a.select("query_id", F.col("first_rank").alias("ra")).join(b.select("query_id", F.col("first_rank").alias("rb")), "query_id", "full_outer")
    return joined.select("query_id", F.when(y < x, "better").when(y > x, "worse").otherwise("unchanged").alias("verdict"))


def sweep(queries: DataFrame, relevant: DataFrame, chunks: DataFrame | lexical.Index, query_vectors: DataFrame, vectors: DataFrame, settings: list[dict]) -> DataFrame:
    """setting, questions, recall_1, recall_5, recall_8, mrr, better, worse of a search under every setting.

    A setting has a name, a mode (bm25 or hybrid) and any of k1, b, heading_repeat, rrf_k, candidates and top_k; better and worse
    count questions against the first setting of its mode. Bags are read once: a task keeps the best of each different set of BM25
    parameters and question, with and without the factor. Settings are a stated list, a few dozen at most."""
    given = [{"k1": lexical.K1, "b": lexical.B, "heading_repeat": lexical.HEADING_REPEAT, "rrf_k": fusion.RRF_K, "candidates": 50, "top_k": 10} | s for s in settings]
    if len({s["name"] for s in given}) < len(given) or any(s["mode"] not in ("bm25", "hybrid") for s in given):
        raise ValueError("settings need different names and a known mode")
    found = lexical.index(chunks)
    ids, words, numbers, (n, _) = lexical.stated(queries, found)
    kinds = sorted({(s["k1"], s["b"], s["heading_repeat"], s["mode"] == "hybrid") for s in given})  # a fused ranking takes the factor once, at its end
    total = found.bags.agg(F.sum("doc_len"), F.sum("head_len")).first()
    length = lambda r: (total[0] + (r - lexical.HEADING_REPEAT) * total[1]) / n if n else 1.0
    each = [(k1, b, r, length(r), raw) for k1, b, r, raw in kinds]
    most = max(max(s["candidates"], s["top_k"]) for s in given)
    tried = best.token_best(found.bags, [(w["token"], w["idf"], w["lists"]) for w in words], max(1, len(ids)), each, most, True)
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "chunk_id"))
    width = F.lit(max(1, len(ids)))
    tried = tried.withColumn("rank", place).where(F.col("rank") <= most).withColumn("kind", F.floor(F.col("list") / width).cast("int")).withColumn("list", F.col("list") % width)
    tried = scratch_table(tried.join(F.broadcast(numbers), "list").select("kind", "query_id", "chunk_id", "rank"), "tried")
    ranked_by = lambda s: tried.where(F.col("kind") == kinds.index((s["k1"], s["b"], s["heading_repeat"], s["mode"] == "hybrid"))).drop("kind")
    dense = scratch_table(fusion.dense_best(query_vectors, vectors, most).select("query_id", "chunk_id", "rank"), "dense")
    hits = None
    for s in given:
        if s["mode"] == "bm25":
            one = ranked_by(s).where(F.col("rank") <= s["top_k"])
        else:
            near = F.col("rank") <= s["candidates"]
            votes = fusion.fuse([("bm25", ranked_by(s).where(near)), ("vector", dense.where(near))], s["rrf_k"])
            votes = votes.join(lexical.factors(found.chunks), "chunk_id", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0)))
            one = lexical.top(votes.select("query_id", "chunk_id", "score"), s["top_k"]).select("query_id", "chunk_id", "rank")
        one = one.select(F.lit(s["name"]).alias("setting"), "*")
        hits = one if hits is None else hits.unionByName(one)
    good = relevant.select("query_id", "chunk_id", F.lit(True).alias("hit")).distinct()
    ranks = hits.join(good, ["query_id", "chunk_id"], "left").groupBy("setting", "query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))
    ranks = scratch_table(ranks, "ranks")
    base = {}
    for s in given:
        base.setdefault(s["mode"], s["name"])
    against = F.coalesce(*[F.when(F.col("setting") == s["name"], F.lit(base[s["mode"]])) for s in given])
    other = ranks.select(F.col("setting").alias("base"), "query_id", F.col("first_rank").alias("was"))
    worst = lambda c: F.coalesce(F.col(c), F.lit(1 << 30))
    turns = ranks.withColumn("base", against).join(other, ["base", "query_id"], "left")
    turns = turns.groupBy("setting").agg(F.count_if(worst("first_rank") < worst("was")).alias("better"), F.count_if(worst("first_rank") > worst("was")).alias("worse"))
    return summary(ranks, "setting").join(turns, "setting")


def covers(text: Column, keywords: Column) -> Column:
    low = F.lower(text)
    return F.coalesce((F.length(text) > 0) & F.forall(keywords, lambda k: F.contains(low, F.lower(k))), F.lit(False))


def covers_expected(text: Column, keywords: Column) -> Column:
    """All keywords, or all of one script's (CJK or other) if it has two or more."""
    cjk = lambda k: k.rlike("[\\x{3400}-\\x{9fff}]")
    parts = [F.filter(keywords, cjk), F.filter(keywords, lambda k: ~cjk(k))]
    return covers(text, keywords) | ((F.size(parts[0]) >= 2) & covers(text, parts[0])) | ((F.size(parts[1]) >= 2) & covers(text, parts[1]))


def covered(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, chunk_id, covers (``covers_expected``) of every chunk (chunk_id, text) and every one of items (query_id, keywords).

    Items are a stated set, sent to all tasks. A text is put in lower case once and each different keyword is looked for once."""
    rows = items.select("query_id", F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower).alias("keywords"), F.col("keywords").isNull().alias("unknown"))
    rows = rows.select("query_id", "keywords", F.transform("keywords", lambda k: k.rlike("[\\x{3400}-\\x{9fff}]")).alias("cjk"), "unknown").collect()
    ids, kind = [r["query_id"] for r in rows], items.schema["query_id"].dataType
    words = sorted({k for r in rows for k in r["keywords"] if k is not None})
    at = {k: i for i, k in enumerate(words)}
    # per item: all its keywords, and those of a script with two or more; a null keyword is never found
    ways = []
    for r in rows:
        sides = [[k for k, c in zip(r["keywords"], r["cjk"], strict=True) if c is not None and c == side] for side in (True, False)]
        lists = [r["keywords"], *[x for x in sides if len(x) >= 2]]
        ways.append([] if r["unknown"] else [[at[k] for k in x] for x in lists if None not in x])

    def run(batches):
        for batch in batches:
            found = np.zeros((batch.num_rows, len(words)), bool)
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    found[i] = [w in text for w in words]
            some = np.array([bool(t) for t in texts], bool)
            out = np.zeros((batch.num_rows, len(ids)), bool)
            for j, lists in enumerate(ways):
                for x in lists:
                    out[:, j] |= found[:, x].all(axis=1) & some
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], ["chunk_id", "covers"])

    each = chunks.select("chunk_id", F.lower("text").alias("text")).mapInArrow(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, covers array<boolean>")
    each = each.select("chunk_id", F.posexplode("covers").alias("list", "covers"))
    return each.join(F.broadcast(best.numbered(ids, kind, chunks.sparkSession)), "list").select("query_id", "chunk_id", "covers")


def score_answers(answers: DataFrame) -> DataFrame:
    """Adds the checks to answers (answer, rejected, expected, must_mention, must_cite, valid)."""
    has = lambda phrases: F.exists(T.literals(phrases), lambda p: F.contains(F.col("answer"), p))
    behaviour = F.when(F.col("expected") == "answer", ~F.col("rejected")).when(F.col("expected") == "reject", F.col("rejected")).when(F.col("expected") == "abstain", ~F.col("rejected") & has(T.ABSTENTION))
    out = answers.withColumn("behavior_correct", behaviour).withColumn("mentions_present", F.forall("must_mention", lambda m: F.contains(F.lower("answer"), F.lower(m))))
    out = out.withColumn("no_speculation", ~has(T.SPECULATION))
    return out.withColumn("passed", F.col("behavior_correct") & F.col("mentions_present") & F.col("no_speculation") & (~F.col("must_cite") | F.col("valid")))


#: Checks of an answer's format, in the order of reports.
CHECKS = ("behavior_correct", "format_correct", "citations_available", "citations_exact", "no_speculation", "passed")


def score_formats(answers: DataFrame) -> DataFrame:
    """Adds CHECKS and mentions_present to answers (answer, expected, labels, invalid, required, must_mention).

    ``expected`` is answer (a conclusion and a line of grounds), abstain or conflict (one line each)."""
    text = F.col("answer")
    opens = lambda p: text.startswith(p)
    holds = lambda p: F.contains(text, F.lit(p))
    answer, abstain = F.col("expected") == "answer", F.col("expected") == "abstain"
    behaviour = F.when(answer, opens("结论：") & ~holds("资料不足") & ~holds("资料冲突")).when(abstain, opens("资料不足：") & ~holds("结论：")).otherwise(opens("资料冲突：") & ~holds("结论："))
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    shape = F.when(answer, (ends == 1) & holds("\n依据：")).otherwise(~F.contains(T.strip(text), F.lit("\n")))
    out = answers.withColumns({
        "behavior_correct": behaviour,
        "format_correct": shape,
        "mentions_present": F.forall("must_mention", lambda m: F.contains(F.lower(text), F.lower(m))),
        "citations_available": F.size("invalid") == 0,
        "citations_exact": F.col("labels") == F.col("required"),
        "no_speculation": ~F.exists(T.literals(T.SPECULATION), lambda p: F.contains(text, p)),
    })
    return out.withColumn("passed", F.forall(F.array("mentions_present", *CHECKS[:-1]), lambda x: x))


def check_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Answers and how many met each check, by category."""
    return scored.groupBy(*by).agg(F.count("*").alias("answers"), *[F.count_if(F.col(c)).alias(c) for c in CHECKS])


def retrieval_cases(queries: DataFrame, expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, in_domain, retrieved, matched, passed: distinct sources; a question that expects none passes if nothing is found."""
    sides = expected.select("query_id", "source", F.lit(1).alias("want"), F.lit(0).alias("got")).unionByName(retrieved.select("query_id", "source", F.lit(0).alias("want"), F.lit(1).alias("got")))
    each = sides.groupBy("query_id", "source").agg(F.max("want").alias("want"), F.max("got").alias("got"))
    sums = each.groupBy("query_id").agg(F.sum("want").alias("want"), F.sum("got").alias("retrieved"), F.sum(F.col("want") * F.col("got")).alias("matched"))
    rows = queries.join(sums, "query_id", "left").na.fill(0)
    domain = F.col("want") > 0
    return rows.select("query_id", domain.alias("in_domain"), "retrieved", "matched", F.when(domain, F.col("matched") > 0).otherwise(F.col("retrieved") == 0).alias("passed"))


def case_summary(cases: DataFrame) -> DataFrame:
    """Questions in and out of the domain, recall of the first and rejection of the second; null where there are none."""
    inside, outside = F.count_if("in_domain"), F.count_if(~F.col("in_domain"))
    rate = lambda of, n: F.try_divide(F.count_if(of & F.col("passed")), n)
    return cases.agg(inside.alias("in_domain"), outside.alias("out_of_domain"), rate(F.col("in_domain"), inside).alias("recall"), rate(~F.col("in_domain"), outside).alias("rejection"))


def lenient_rank(queries: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, first_rank of queries (query_id, keywords): the first hit whose whole text covers the keywords; null without keywords."""
    met = hits.select("query_id", "chunk_id", "rank").join(texts, "chunk_id")
    joined = queries.join(met, "query_id", "left")
    good = (F.size("keywords") > 0) & covers_expected(F.col("text"), F.col("keywords"))
    return joined.groupBy("query_id").agg(F.min(F.when(good, F.col("rank"))).alias("first_rank"))
