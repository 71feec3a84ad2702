import math
import os
import random
import zlib
from collections import Counter

import numpy as np

from quillspark.llm import suffix_tree as S


def rows():
    rng = random.Random(2)
    out = []
    for k in range(400):
        words = []
        while len(words) < rng.randrange(1, 60):
            words += ["new", "york", "city"] if rng.random() < 0.3 else [rng.choice("abcdefgh") * rng.randrange(1, 4)]
            words += [f"rare{rng.randrange(3000)}"] if rng.random() < 0.2 else []
            # what follows "mid" hangs on the word before it
            words += rng.choice((["left", "mid", "one"], ["right", "mid", "two"])) if rng.random() < 0.3 else []
        out.append((k, " ".join(words).upper() if k % 3 else "\n".join(words)))
    return out + [(1000, None), (1001, ""), (None, "new york"), (7, "new york city"), (7, "new york city"), (1002, "word " * 50_000)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(data, depth=2):
    """The same tree with dictionaries."""
    toks = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [" end"]
    train = [toks(t) for i, t in data if not held(i)]
    c = Counter(w for ws in train for w in ws)
    total, v = sum(c.values()), len(c)
    n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    off = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
    root = lambda w: (c[w] - off) / total if c[w] else off * v / total
    common = {w for w in c if c[w] >= max(S.LEAST_COUNT, S.LEAST_CONTEXT * total)}
    states, contexts, seen = {}, {(w,) for w in common}, {(w,): c[w] for w in common}

    def p(context, w):
        out = root(w)
        for k in range(1, len(context) + 1):
            s = context[-k:]
            if s in states:
                out = states[s][1] * out + states[s][0].get(w, 0.0)
        return out

    for level in range(1, depth + 1):
        joint = Counter()
        for ws in train:
            for i in range(level, len(ws)):
                s = tuple(ws[i - level : i])
                if s in contexts and ws[i] in common:
                    joint[s, ws[i]] += 1
        joint = {x: n for x, n in joint.items() if n >= max(S.LEAST_COUNT, S.LEAST_PAIR * total)}
        new = {}
        for s in contexts:
            mine = {w: n for (s2, w), n in joint.items() if s2 == s}
            if not mine:
                continue
            q = {w: p(s[1:], w) for w in mine}
            left, other = 1 - sum(mine.values()) / seen[s], max(1e-12, 1 - sum(q.values()))
            gain = sum(n * math.log(n / seen[s] / q[w]) for w, n in mine.items()) + (seen[s] * left * math.log(left / other) if left > 0 else 0)
            if gain >= S.GAIN * len(mine):
                new[s] = ({w: (n - S.DISCOUNT) / seen[s] for w, n in mine.items()}, 1 - sum(n - S.DISCOUNT for n in mine.values()) / seen[s])
        states |= new
        seen = {(*s, w): n for (s, w), n in joint.items() if n >= max(S.LEAST_COUNT, S.LEAST_CONTEXT * total)}
        contexts = set(seen)
    out = []
    for i, t in data:
        ws, score = toks(t), 0.0
        for k, w in enumerate(ws):
            score += math.log10(p(tuple(ws[max(0, k - depth) : k]), w))
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + v + 1)) for w in ws), score))
    # a state's distribution over all known words and the one unseen symbol sums to 1
    for s in list(states)[:20]:
        assert abs(sum(p(s, w) for w in c) + p(s, "never seen") - 1) < 1e-9
    return out, states


def test_equals_dictionaries(spark):
    data = rows()
    want, states = brute(data)
    assert ("new",) in states and any(len(s) == 2 for s in states)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in data], "doc_id long, text string, score double")
    got = [tuple(r) for r in S.train_and_score(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_without_training_text(spark):
    out = S.train_and_score(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == []
    only_held = next(k for k in range(100) if held(k))
    row = S.train_and_score(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (True, 3, 0, 0, 0.0)


def test_support_is_absolute(spark, monkeypatch):
    """Pairs and contexts of ten occurrences are kept however many other tokens there are, broadcast or joined."""
    monkeypatch.setattr(S, "LEAST_CONTEXT", 0.0)
    monkeypatch.setattr(S, "LEAST_PAIR", 0.0)
    rng = random.Random(3)
    data = [(k, " ".join(rng.choice(["new york city", "los angeles", "rio", f"once{k}"]) for _ in range(6))) for k in range(60)]
    data += [(1000 + k, "word " * 300_000) for k in range(5) if not held(1000 + k)]
    want, states = brute(data)
    assert ("new",) in states and max(len(s) for s in states) == 2
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for settings in ({}, {"least_word": 1.0}, {"least_word": 4e-5}):
        got = sorted(tuple(r) for r in S.train_and_score(docs, **settings).collect())
        for a, b in zip(got, sorted(want), strict=True):
            assert a[:5] == b[:5]
            assert np.allclose(a[5:], b[5:], rtol=1e-9)


def test_packed_buckets_hold_all_counts():
    rng = np.random.default_rng(5)
    buckets = np.concatenate([rng.integers(0, 1 << 32, 20_000, dtype=np.uint32), np.repeat(np.array([0, 7, (1 << 32) - 1], np.uint32), [300, 9, 1])])
    got = {}
    rows = list(S.packed(buckets))
    for part, k, n in rows:
        k, n = S.unpacked(k, n)
        assert (k >> 24 == part).all()
        got |= dict(zip(k.tolist(), n.tolist(), strict=True))
    assert got == {b: min(255, n) for b, n in Counter(buckets.tolist()).items()}
    assert sum(len(k) + len(n) for _, k, n in rows) < 5 * len(got)  # a row of two numbers takes 24 bytes


def test_found_in_an_indexed_table():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 5000):
        k = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, n), rng.integers(S.BIG, S.BIG + 50, n)]))
        keys = np.concatenate([k, rng.integers(-(1 << 63), (1 << 63) - 1, 1000), rng.integers(S.BIG - 9, S.BIG + 99, 1000), [0, -(1 << 63), (1 << 63) - 1]])
        have, value = S.found(S.indexed(k, k * 0.5), keys)
        assert (have == np.isin(keys, k)).all() and (value[have] == keys[have] * 0.5).all()


def test_what_open_tokens_ask_is_gone_in_the_end(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    tables = lambda: {d for d in os.listdir(folder) if d.startswith(("partial-scores", "pairs", "contexts", "states"))}
    before = tables() if os.path.isdir(folder) else set()
    out = S.train_and_score(docs, least_word=1.0)
    assert tables() <= before and out.count() == len(rows())


def test_texts_are_coded_once_and_a_slice_asks_for_a_key_once(spark):
    docs = spark.createDataFrame([(k, "new york city and " * 3, k % 3 == 0) for k in range(60)], "doc_id long, text string, held boolean").coalesce(1)
    slices = S.coded(docs)
    assert sorted(i for r in slices.collect() for i in r["doc_id"]) == list(range(60))
    model, counts, states = S.learn(slices.where("NOT held"), least_word=1.0)
    got = [(r["k"], r["row"]) for r in S.asked(slices, spark.sparkContext.broadcast(model)).collect()]
    assert len(got) == len(set(got)) and {k for k, _ in got} >= {r["k"] for r in counts.union(states).collect() if r["k"]}


def test_asks_and_answers_are_packed(spark):
    """One row for each slice and range of keys, about 6 bytes a key and 2 a small count; a key without a value gets zeros."""
    rng = np.random.default_rng(7)
    for x in ([], [0], [5, 0, (1 << 64) - 1], rng.integers(0, 1 << 62, 1000)):
        x = np.array(x, np.uint64)
        for plain in (0, S.PLAIN):
            assert (S.restored(S.squeezed(x, plain), plain) == x).all()
    keys = np.unique(S.turned(rng.integers(S.BIG, S.BIG * 2 - 1, 40_000)))
    packed = {part: S.steps(keys[span]) for part, span in S.spans(keys, S.PARTS)}
    assert len(packed) == S.PARTS and (np.concatenate([S.unstepped(packed[p]) for p in sorted(packed)]) == keys).all()
    assert sum(map(len, packed.values())) < 7 * len(keys)  # a row of key, slice and place took 16 in the shuffle
    k = keys.view(np.int64)
    counts = spark.createDataFrame([(int(x >> 2 & (S.BIG - 1) | S.BIG), n % 50, 0, 1) for n, x in enumerate(k[:3000:2].tolist())], "k long, n long, m long, seen long")
    values = S.dealt(counts, counts.limit(0), S.PARTS).toArrow()
    want = dict(zip(keys[:3000:2].tolist(), (n % 50 for n in range(1500)), strict=True))
    asks = S.pa.table({"part": [0], "row": [9], "keys": [S.steps(keys[:3000])]})
    got = S.restored(S.answers(asks, values).column("told")[0].as_py()).reshape(3, -1)
    assert got[0].tolist() == [want.get(x, 0) for x in keys[:3000].tolist()] and (got[2] == np.arange(1, 3001) % 2).all()
    assert S.answers(asks, values.slice(0, 0)).num_rows == 1 and len(S.answers(asks, values).column("told")[0].as_py()) < 2 * 3000


def test_tasks_count_several_splits_together(spark):
    slices = S.coded(spark.createDataFrame([(k, "new york city " * 40, False) for k in range(300)], "doc_id long, text string, held boolean").repartition(60))
    cores, split = spark.sparkContext.defaultParallelism, slices.repartition(40 * spark.sparkContext.defaultParallelism)
    assert S.gathered(split).rdd.getNumPartitions() == 10 * cores and S.gathered(slices.coalesce(3)).rdd.getNumPartitions() <= 3
    assert sum(r["n"] for r in S.learn(split)[1].collect()) == 300 * 121
