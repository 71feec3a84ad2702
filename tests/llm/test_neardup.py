import os
import random

import numpy as np
import pytest

from quillspark.llm import neardup as N


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component of each id by comparing all pairs."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=3):
    """Near copies at all distances, a hot group of near copies that differ from each other, and a hot shared passage."""
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 120]))
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "y", "zz"])
            rows.append((n, " ".join(copy)))
            n += 1
    base = words(rng, 90)
    for _ in range(60):  # each about 0.8 like the base, less like each other
        copy = list(base)
        copy[rng.randrange(90)] = f"e{n}"
        if rng.random() < 0.5:
            copy[rng.randrange(90)] = f"f{n}"
        rows.append((n, " ".join(copy)))
        n += 1
    passage = words(rng, 40)
    for _ in range(60):
        rows.append((n, " ".join(words(rng, 25, 5000) + passage)))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("many", [N.MANY, 2])
def test_components_equal_all_pairs(spark, monkeypatch, many):
    """Also with the pairs of nearly every document dealt to parts."""
    monkeypatch.setattr(N, "MANY", many)
    rows = corpus()
    got = {r["doc_id"]: r for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_shingles"] == len(sets_of(t)) for i, t in rows)


def no_pairs(rows, *_):
    return rows.sparkSession.createDataFrame([], "a long, b long")


@pytest.mark.parametrize("chunk", [N.CHUNK, 16 * N.LEAST])
def test_sweep_finds_what_pairs_left(spark, monkeypatch, chunk):
    """Without any pair of an unfrequent key or a hub, the sweep of frequent keys still connects all, in one chunk or in several."""
    for name in ("first_pairs", "open_pairs", "hub_pairs"):
        monkeypatch.setattr(N, name, no_pairs)
    monkeypatch.setattr(N, "FEW", 1)
    monkeypatch.setattr(N, "CHUNK", chunk)
    rows = corpus(5)[:120]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_open_components_give_every_pair_but_the_hubs(spark):
    """Of each key every pair of similar size in different components is met once, with the hub first and then without it."""
    rng = random.Random(3)
    rows = sorted({(k, d, 10 + d % 3) for k in range(20) for d in rng.sample(range(30), rng.randint(2, 8))})
    label = {d: d % 4 for d in range(0, 30, 2)}
    few = spark.createDataFrame(rows, "key long, doc long, n long")
    first = {tuple(r) for r in N.first_pairs(few).collect()}
    # equal registers pass the estimate, and those of document 7 fail it
    full = {d: np.full(N.BUCKETS, 9 if d == 7 else 5, np.uint16).tobytes() for d in range(30)}
    sketches = spark.createDataFrame([(d, 10 + d % 3, bytearray(x)) for d, x in full.items()], "doc long, n long, registers binary")
    other = [tuple(r) for r in N.open_pairs(few, spark.createDataFrame(list(label.items()), "node long, component long"), sketches).collect()]
    want = {(a, b) for k, a, n in rows for j, b, m in rows if k == j and a < b and min(n, m) * 100 >= max(n, m) * N.SIMILAR}
    apart = {(a, b) for a, b in want if label.get(a, a) != label.get(b, b) and 7 not in (a, b)}
    assert not any(7 in x for x in other)
    assert first | set(other) <= want and apart <= first | set(other)
    assert all(label.get(a, a) != label.get(b, b) for a, b in other)
    assert N.open_pairs(few, few.selectExpr("doc AS node", "-1L AS component").distinct(), sketches).count() == 0


def test_long_texts_in_a_hot_key(spark):
    """Long texts that share most of their words, some similar and some not, over several chunks of the sweep."""
    rng = random.Random(9)
    base, rows = words(rng, 12_000, 10**9), []
    for k in range(14):  # all nearly similar: a part of the words of each is its own
        own = rng.choice([600, 900, 2600, 3000])
        rows.append((k, " ".join(base[own:] + [f"own{k}-{i}" for i in range(own)])))
    want = brute(rows)
    assert len(set(want.values())) > 1
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_texts_of_one_document_meet(spark):
    rows = [(7, "a b c d e f"), (7, "g h i j k l"), (3, "a b c d e f"), (5, "g h i j k l"), (9, "m n o p q r")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (7, 3), (7, 3), (9, 9)]


def test_words_longer_than_a_window():
    shingler = N.Shingler()
    long = b"q" * (2 * shingler.WINDOW)
    got = shingler.sets([b"a " + long + b" b c d e", b"A " + long.upper() + b" B c d e", b"a b c d e", b"", b"  "])
    assert [len(x) for x in got] == [2, 2, 1, 0, 0] and (got[0] == got[1]).all()


def test_edges(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B\n"), (None, "a b"), (6, long), (7, long + " tail"), (8, "same same same same same same"), (8, "same same same same same same"), (9, "a b")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int")
    got = sorted(N.near_duplicates(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (8, 8), (9, 9), (None, None)]
    assert [r["n_shingles"] for r in got][:5] == [0, 0, 0, 1, 1]
    assert [r["kept"] for r in got][-1] is True
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.75, 0.9):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**64, 1000, dtype=np.uint64)
            own = int(1000 * (1 - share) / share / 2)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, own, dtype=np.uint64)])) for _ in range(2))
            regs = N.registers([a, b])
            similar, _ = N.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))
            errors.append(similar[0] - share)
        assert abs(np.mean(errors)) < 0.03


def test_registers_hold_zeros_and_mantissa():
    regs = N.registers([np.array([1], np.uint64), np.zeros(0, np.uint64)])
    assert regs[0, 0] > 0 and (regs[0, 1:] == 0).all() and (regs[1] == 0).all()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(1, 40)], [(5, 9), (9, 30), (2, 30), (7, 8)]])
def test_components(spark, edges):
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = N.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in parent}


def test_scratch_of_earlier_steps_is_gone_in_the_end(spark):
    folder = N.materialize(spark.range(1), "probe").inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    scratch = lambda: {d for d in os.listdir(folder) if d.startswith(("sketches", "shared-keys", "keys", "candidates", "pairs", "open-pairs", "wanted", "sets", "open-keys", "unconnected"))}
    before, rows = scratch(), corpus()
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert scratch() <= before and out.count() == len(rows)
