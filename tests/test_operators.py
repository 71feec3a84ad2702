"""Each registered query against its SQL, and what SQL does not express against plain Python."""

import itertools
import math
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.jobs import catalog, details, markdown, plane, records, search, training  # noqa: F401
from quillspark.operators import datasets, evidence, fusion, lexical, sections, tables

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in NAMES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows):
    return sorted(repr(tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    want = oracle.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert plain(got) == plain(want)


def column(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()["y"]


def test_tokenize(spark):
    cases = {"": [], "中": ["中"], "中文检索 RAG系统2": ["中文", "文检", "检索", "rag", "系统", "2"], "A-b_c": ["a", "b", "c"], "a😀b": ["a", "b"], "É": []}
    for text, want in cases.items():
        assert column(spark, text, T.tokenize) == want
    assert column(spark, "什么是RAG和Agent的区别", T.tokenize_query) == ["agent", "rag", "区别"]


def test_guards_and_questions(spark):
    assert column(spark, "今天天气如何", T.rejection) == "realtime:天气"
    assert column(spark, "最新论文有哪些", T.rejection) is None
    assert column(spark, "根据我的经历，帮我购买", T.rejection) == "action:购买"
    assert column(spark, "RAG、Agent和微调在项目中分别起什么作用", T.decompose) == ["RAG 在项目中 起什么作用", "Agent 在项目中 起什么作用", "微调 在项目中 起什么作用"]
    assert column(spark, "RAG分别如何", T.decompose) == ["RAG分别如何"]


def test_citations_and_lines(spark):
    assert column(spark, "x [S1, s2] [S1] [a] [S9", T.citation_labels) == ["S1", "S2"]
    assert column(spark, "[S1, S2] [S3]", T.single_citations) == ["S3"]
    assert column(spark, "a\r\nb c\n", T.lines) == ["a", "b", "c"] and column(spark, "", T.lines) == []
    assert column(spark, "　 x 　", T.strip) == "x"
    df = spark.createDataFrame([("head\nrag here\n\nother\nlast", ["rag"]), ("none", ["rag"])], "t string, m array<string>")
    assert [r[0] for r in df.select(T.excerpt(F.col("t"), F.col("m"))).collect()] == ["head\nrag here", "none"]


def test_bm25_against_python(spark):
    rng = random.Random(1)
    texts = [(k, rng.choice(["h one", "h two", "待继续拆分"]), " ".join(rng.choice("abcdefg") * 2 for _ in range(rng.randrange(0, 30)))) for k in range(60)]
    queries = [(0, "aa bb"), (1, "gg one"), (2, ""), (3, "zz")]
    tok = lambda s: [t for t in s.split() if t.isascii()] + ([s[i : i + 2] for i in range(len(s) - 1)] if not s.isascii() else [])
    bags = {k: Counter(tok(h) * 2 + tok(t)) for k, h, t in texts}
    avg = sum(sum(b.values()) for b in bags.values()) / len(bags)
    want = {}
    for q, s in queries:
        for k, h, _ in texts:
            score = 0.0
            for t in sorted(set(tok(s))):
                tf, df = bags[k][t], sum(t in b for b in bags.values())
                if tf:
                    score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sum(bags[k].values()) / avg))
            if score:
                want[q, k] = score * (0.35 if h == "待继续拆分" else 1)
    chunks = spark.createDataFrame(texts, "chunk_id long, heading string, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.bm25_scores(spark.createDataFrame(queries, "query_id long, query string"), chunks).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_fusion(spark):
    ranked = lambda rows: spark.createDataFrame([(1, c, r) for c, r in rows], "query_id long, chunk_id string, rank int")
    got = {r["chunk_id"]: r["score"] for r in fusion.fuse([("a", ranked([("x", 1), ("y", 2), ("x", 3)])), ("b", ranked([("y", 1)]))]).collect()}
    assert got == {"x": 1 / 61, "y": 1 / 62 + 1 / 61}


def test_pack_lines(spark):
    rng = random.Random(3)
    texts = [(k, "\n".join("x" * rng.randrange(0, 40) for _ in range(rng.randrange(1, 25)))) for k in range(40)] + [(90, "y" * 200), (91, "")]
    want = []
    for k, text in texts:
        lines, part, first, size = text.split("\n") if text else [], 0, 1, -1
        if lines and lines[-1] == "":
            lines.pop()
        for at, line in enumerate(lines, 1):
            if size >= 0 and size + 1 + len(line) <= 50:
                size += 1 + len(line)
                continue
            if size >= 0:
                want.append((k, part, first, at - 1, size))
                part += 1
            first, size = at, len(line)
        if size >= 0:
            want.append((k, part, first, len(lines), size))
    got = sections.line_runs(spark.createDataFrame(texts, "id long, text string"), 50)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_sections(spark):
    text = "intro\n# A\none\n```\n# not\n```\n### C\ntwo\n## B\n\n# D\nthree"
    got = sections.sections(spark.createDataFrame([(1, "T", text)], "id long, title string, text string")).orderBy("section").collect()
    assert [(r["path"], r["text"]) for r in got] == [("T", "intro"), ("A", "one\n```\n# not\n```"), ("A > C", "two"), ("D", "three")]


def test_blocks(spark):
    text = "para\nmore\n\n- one\n- two\n\n| a |\n| b |\n```\ncode\n\n```\nend"
    got = sections.blocks(spark.createDataFrame([(1, "", text)], "id long, title string, text string")).orderBy("first_line").collect()
    assert [(r["kind"], r["first_line"], r["last_line"]) for r in got] == [("paragraph", 1, 2), ("list", 4, 4), ("list", 5, 5), ("table", 7, 8), ("code", 9, 12), ("paragraph", 13, 13)]
    assert [text[r["start"] : r["end"]] for r in got] == ["para\nmore", "- one", "- two", "| a |\n| b |", "```\ncode\n\n```", "end"]


def test_context_keeps_budget(spark):
    rows = [(b, r, f"f{r}", "h", "word " * (r * 13 % 40 + 1)) for b in range(1, 400, 7) for r in range(1, 6)]
    df = spark.createDataFrame(rows, "query_id long, rank int, source string, heading string, content string")
    for budget in (60, 150, 390):
        texts = evidence.context_text(evidence.build_context(df, budget, 20)).collect()
        assert all(len(r["context"]) <= budget for r in texts)


def test_round_robin(spark):
    rng = random.Random(8)
    units, want = [], {}
    for q in range(20):
        pending = {s: ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5))] for s in range(1, 4)}
        units += [(q, s, u, "H" * s, c) for s, us in pending.items() for u, c in enumerate(us)]
        used, seen, opened, accepted = 0, set(), set(), []
        for u in itertools.count():
            if all(u >= len(us) for us in pending.values()):
                break
            for s, us in pending.items():
                if u < len(us) and us[u] not in seen:
                    added = len(us[u]) + (2 if s in opened else s + (2 if opened else 0))
                    if used + added <= 25:
                        used += added
                        seen.add(us[u])
                        opened.add(s)
                        accepted.append((s, u))
        want[q] = (used, accepted)
    df = spark.createDataFrame(units, "query_id long, source int, unit int, header string, content string")
    got = {r["query_id"]: (r["used"], [tuple(x) for x in r["accepted"]]) for r in evidence.round_robin(df, 25).collect()}
    assert got == want


def test_backlinks(spark):
    text = "# T\nsays [S1]\n- wrong [S9]\n```\ncode [S1]\n```\n---\nplain"
    row = evidence.backlinks(spark.createDataFrame([(1, text), (2, "# only")], "id long, content string"), 3).orderBy("id").collect()
    assert [tuple(r) for r in row] == [(1, 3, 1, 1 / 3), (2, 0, 0, None)]


def test_tables(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "k string, h string")
    assert {r["k"]: r["change"] for r in tables.difference(old, new, "k", "h").collect()} == {"a": "deleted", "b": "changed", "c": "same", "d": "added"}
    split = tables.grouped_split(spark.range(25).withColumnRenamed("id", "g"), "g", {"test": 0.1, "validation": 0.1}, 1, "n").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 2, "validation": 2, "train": 21}


def test_windows(spark):
    rows = datasets.windows(spark.createDataFrame([(1, [3, 4, 5, 6, 2]), (2, [2]), (3, [3, 2])], "id long, codes array<int>"), 3).orderBy("id", "start").collect()
    assert [(r["id"], r["start"], r["x"], r["y"]) for r in rows] == [(1, 0, [3, 4, 5], [4, 5, 6]), (1, 3, [6, 0, 0], [2, -100, -100]), (3, 0, [3, 0, 0], [2, -100, -100])]


def test_learning_rate(spark):
    rates = [r["rate"] for r in datasets.learning_rate(spark.range(100).withColumnRenamed("id", "step"), 100, 10, 1.0).orderBy("step").collect()]
    assert rates[0] == 0.1 and rates[9] == 1.0 and abs(rates[10] - 1) < 1e-9 and rates[-1] < 0.11


def test_covers_all_pairs(spark, oracle):
    """Every passage meets every document."""
    items, docs = (oracle.execute(f"SELECT * FROM {t}").fetchall() for t in ("(SELECT item_id, text FROM benchmark)", "(SELECT doc_id, text FROM documents)"))
    got = {(r["query_id"], r["chunk_id"]): r["covers"] for r in catalog.QUERIES["p16_covers_all"](spark, SF).collect()}
    want = {(i, n): "the" in text.lower() and item.split(" ")[0].lower() in text.lower() for i, item in items for n, text in docs}
    assert got == want and any(got[i, n] for i, n in got if i % 40 != n % 40)


def test_fitting_history(spark):
    """Of the last eight, newest first, what does not fit is skipped and older ones still tried."""
    sizes = [50, 100, 900, 3500, 10, 3000, 4001, 700, 400, 30]
    rows = [(1, k, "x" * n) for k, n in enumerate(sizes)] + [(2, 0, "")]
    got = {r["conv_id"]: (r["turns"], r["chars"]) for r in evidence.recent_history(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()}
    assert got == {1: _greedy(sizes), 2: ([0], 0)}
    found = {r["conv_id"]: r["chars"] for r in catalog.QUERIES["r16_fitting_history"](spark, "/root/testdata/sf0.1").collect()}
    assert max(found.values()) <= 4000


def _greedy(sizes):
    taken, total = [], 0
    for k in reversed(range(max(0, len(sizes) - 8), len(sizes))):
        if total + sizes[k] <= 4000:
            taken.insert(0, k)
            total += sizes[k]
    return taken, total


def test_passage_reuse(spark):
    """Moved passages keep their vectors, edited ones and those of another heading do not."""
    old = spark.createDataFrame([(1, "a", "t"), (2, "a", "u")], "id long, heading string, text string")
    new = spark.createDataFrame([(1, "a", "t!"), (2, "b", "u"), (3, "a", "t"), (4, None, "t")], "id long, heading string, text string")
    assert {r["id"]: r["reused"] for r in tables.reused(new, old, "id", "heading", "text").collect()} == {1: False, 2: False, 3: True, 4: False}


def test_round_robin_visits_matches_first(spark):
    """Accepted lines are those of a plain visit in the order (-matches, position)."""
    asked = {r["query_id"]: set(r["a"]) for r in catalog.questions(spark, SF).select("query_id", T.tokenize_query(F.col("query")).alias("a")).collect()}
    units = {}
    lines = catalog.sources(spark, SF).select("query_id", "rank", F.posexplode(T.lines(F.col("content"))).alias("position", "content"))
    for r in lines.select("*", T.tokenize(F.col("content")).alias("words")).collect():
        units.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((-len(asked[r["query_id"]] & set(r["words"])), r["position"], r["content"]))
    want = {}
    for q, of in units.items():
        used, seen, opened, accepted = 0, set(), set(), []
        for turn in itertools.zip_longest(*(sorted((m, p, s, c) for m, p, c in of[s]) for s in sorted(of))):
            for _, p, s, c in filter(None, turn):
                added = len(c) + (2 if s in opened else 3 + (2 if opened else 0))
                if c not in seen and used + added <= 2200:
                    used += added
                    seen.add(c)
                    opened.add(s)
                    accepted.append((s, p))
        want[q] = (used, ",".join(f"{s}:{p}" for s, p in sorted(accepted)))
    assert {r["query_id"]: (r["used"], r["accepted"]) for r in catalog.QUERIES["e2_round_robin"](spark, SF).collect()} == want


def test_inventories_hold_no_group(spark, monkeypatch):
    """Both hashes depend on the files alone, and neither plan gathers the lines of a group."""
    import hashlib

    monkeypatch.setattr(tables, "LEAF", 4)
    rows = [("big" if k % 10 else None if k % 20 else "small", k, f"h{k}") for k in range(4000)]
    frame = lambda x, n: spark.createDataFrame(x, "g string, k long, h string").repartition(n)
    flat = {r["g"]: (r["inventory"], r["files"]) for r in tables.inventory_hash(frame(rows, 5), "k", "h", "g").collect()}
    of = lambda g: sorted(f"{k}:{h}" for x, k, h in rows if x == g)
    assert flat == {g: (hashlib.sha256("\n".join(of(g)).encode()).hexdigest(), len(of(g))) for g in ("big", "small", None)}
    assert "collect_list" not in tables.inventory_hash(frame(rows, 5), "k", "h", "g")._jdf.queryExecution().toString()
    tree = lambda x, n: {r["g"]: (r["inventory"], r["files"]) for r in tables.inventory_tree(frame(x, n), "k", "h", "g").collect()}
    one, moved = tree(rows, 3), [(g, k, h + "!" if k == 1001 else h) for g, k, h in rows]
    assert one == tree(rows[::-1], 7) and {g: n for g, (_, n) in one.items()} == {"big": 3600, "small": 200, None: 200}
    other = tree(moved, 3)
    assert {g for g in one if one[g] != other[g]} == {"big"}


def test_document_windows(spark, tmp_path):
    """Every document is cut, and characters that only held-out ones have are unknown."""
    import hashlib

    data = [(k, f"text {k} " * (k % 40) + ("\u00e9" if k % 10 == 0 else "")) for k in range(1, 60)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {c: i + 3 for i, c in enumerate(sorted({c for k, t in data if k % 10 for c in t}))}
    want = set()
    for k, text in data:
        codes = [ids.get(c, datasets.UNKNOWN) for c in text] + [datasets.END]
        for at in range(0, len(codes) - 1, 64):
            x, y = codes[at : min(at + 64, len(codes) - 1)], codes[at + 1 : at + 65]
            x, y = x + [datasets.PAD] * (64 - len(x)), y + [datasets.IGNORE] * (64 - len(y))
            want.add((k, at, hashlib.md5("|".join(" ".join(map(str, v)) for v in (x, y)).encode()).hexdigest()))
    assert "\u00e9" not in ids
    assert {tuple(r) for r in catalog.QUERIES["d7_document_windows"](spark, str(tmp_path)).collect()} == want
