import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import mixing as M


def level(sizes, most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def brute(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    target, out = level(sizes), []
    for s in sizes:
        ratio = target[s] / sizes[s] if sizes[s] else 0.0
        whole, need, cum = int(ratio), target[s] - int(ratio) * sizes[s], 0
        u = lambda i: (int(hashlib.md5(f"{M.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        for i, _, n in sorted((r for r in sized if r[1] == s), key=lambda r: (u(r[0]), r[0] or 0, r[2])):
            more = ratio > whole and cum + n / 2 <= need
            cum += n
            out.append((i, n, sizes[s], round(target[s], 6), n * (whole + more)))
    return sorted(out, key=repr)


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(i, s, t, "w") for i, s, t in rows], "doc_id long, source string, text string, target string")
    out = M.mix(docs.withColumn("size", M.words(F.col("text"))), **settings)
    return sorted([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"] * r["size"]) for r in out.collect()], key=repr)


def rows():
    out = [(k, ["a", "b", "c", "d", None, "é"][k * k % 6], "w " * (k * 37 % 50)) for k in range(200)]
    return out + [(1000 + k, "huge", "x " * 40) for k in range(150)] + [(2000, "empty", None), (2001, "empty", " \t"), (None, "a", "no id"), (7, "b", "again again"), (7, "b", "again again")]


def test_equals_one_sorted_window(spark):
    assert run(spark, rows()) == brute(rows()) == run(spark, rows(), buckets=3)


def test_near_target_and_reruns_agree(spark):
    got = run(spark, rows())
    taken, want = defaultdict(int), {}
    for i, n, size, target, t in got:
        taken[size] += t
        want[size] = target
        assert t <= 3 * n
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert run(spark, rows()) == got


def test_weights_raise_inclusion(spark):
    data = [(k, s, "w " * 10) for s in ("a", "b", "c") for k in range(400)]
    docs = spark.createDataFrame([(i + 1000 * ord(s), s, t, 5.0 if i < 100 else 1.0) for i, s, t in data], "doc_id long, source string, text string, weight double")
    out = M.mix(docs.withColumn("size", M.words(F.col("text"))), weight="weight").where("source = 'a'").collect()
    heavy = [r["copies"] for r in out if r["weight"] > 1]
    light = [r["copies"] for r in out if r["weight"] == 1]
    assert sum(heavy) / len(heavy) > 1.5 * sum(light) / len(light)
    assert abs(sum(r["copies"] * r["size"] for r in out) - out[0]["target"]) <= 10


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a", ""), (2, None, None)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
