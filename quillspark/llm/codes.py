"""Product codes of vectors by ball k-means, in whole numbers.

Each part position has a codebook. A ball is an entry with the parts assigned to it; its radius is the distance of its
farthest part. In a round

- a ball's neighbours are the entries nearer to its own than twice its radius: no other entry can be nearest to one of its parts;
- parts nearer to their entry than half way to its nearest neighbour are the ball's stable core and keep their code;
- of the rest, in annular rings between half the distances to one neighbour and the next, the parts of the i-th ring are
  compared with the first i neighbours;
- a ball that has not moved, and whose neighbours have not, keeps all its codes without a look.

Distances are squared and whole, so every comparison is exact: an entry at squared distance D from a part's own entry is out
if D > 4 d, with d the part's own squared distance, and ties go to the lower index. A part's radius bound between rounds is
the old radius plus how far the entry moved, rounded up.

Spark deals the rows; a task sends at most one row of sums an entry, whatever the size of a ball, and the driver holds the
codebooks (parts x entries rows). Codes and own distances are a table in the shared folder, rewritten each round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block in a task.
BLOCK = 8192
#: Largest size of a whole component for which squared distances fit 62 bits (up to 64 components a part).
MOST = 1 << 27


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: floor(scale * component) of the rows whose vector is there and holds only finite numbers.

    Vectors of another length than the longest, or with components of 2 ** 27 and more after scaling, are no part of the
    table either."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / scale))
    return df.where(fine).select(F.col("vec_id").cast("long"), "label", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def cuts(length: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where ``parts`` divides the length; else the first ones are one longer."""
    ends = [length * 0]
    for k in range(parts):
        ends.append(ends[-1] + length // parts + (k < length % parts))
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whole squared distances of all rows of ``x`` and ``y``."""
    big = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if big * big * x.shape[1] < 1 << 50:  # products and sums are exact in doubles
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(y)), np.int64)
    for j, e in enumerate(y):
        out[:, j] = ((x - e) ** 2).sum(1)
    return out


class Balls:
    """One part position's codebook with what a round may skip."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None, radius: np.ndarray | None = None):
        #: radius: upper bound of the distance of a ball's parts to its entry; None before the first round.
        self.entries, self.first = entries, radius is None
        if self.first:
            return
        between = squared(entries, entries)
        order = np.argsort(between, axis=1, kind="stable")
        self.rings, self.near, self.still = [], [], np.zeros(len(entries), bool)
        for i in range(len(entries)):
            others = order[i][order[i] != i]
            # twice the radius, squared and rounded up, so that a bound in doubles leaves nothing out
            reach = int(4 * float(radius[i]) ** 2 * (1 + 1e-9)) + 1
            others = others[between[i, others] <= reach]
            self.near.append(others)
            self.rings.append(between[i, others])
            self.still[i] = not moved[i] and not moved[others].any()

    def assign(self, x: np.ndarray, code: np.ndarray | None, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(codes, squared distances, distances computed) of the parts ``x``, whose codes and distances were ``code`` and ``own``."""
        if self.first:
            away = squared(x, self.entries)
            return away.argmin(1), away.min(1), away.size
        code, own, work = code.copy(), own.copy(), 0
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(self.entries) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            rows = order[edges[i] : edges[i + 1]]
            if self.still[i]:
                continue
            mine = ((x[rows] - self.entries[i]) ** 2).sum(1)
            work += len(rows)
            own[rows] = mine
            ring = np.searchsorted(self.rings[i], 4 * mine, "right")  # neighbours that can be as near
            low = 0
            while low < ring.max(initial=0):  # rings of about double width: a part meets the neighbours of its ring and few more
                high = max(2 * low, 1)
                inside = (ring > low) & (ring <= high)
                if inside.any():
                    at, near = rows[inside], np.sort(np.append(self.near[i][:high], i))
                    away = squared(x[at], self.entries[near])
                    code[at], own[at] = near[away.argmin(1)], away.min(1)  # of equal ones the lowest index
                    work += away.size
                low = high
        return code, own, work


def run_round(rows: DataFrame, balls: list[Balls], spans: list[slice]) -> DataFrame:
    """vec_id, label, v with the codes and squared distances (one a part) of a new assignment."""
    first, n = balls[0].first, len(spans)
    schema = rows.select("vec_id", "label", "v").schema.simpleString()[7:-1] + ", codes binary, own array<long>, work long"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column(2)
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if not first:
                    before = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint16).reshape(-1, n).astype(np.int64)
                    dist = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                code, own, work = np.empty((len(x), n), np.int64), np.empty((len(x), n), np.int64), 0
                for k, s in enumerate(spans):
                    code[:, k], own[:, k], w = balls[k].assign(x[:, s], None if first else before[:, k], None if first else dist[:, k])
                    work += w
                codes = pa.array([r.tobytes() for r in code.astype(np.uint16)], pa.binary())
                owns = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, n, dtype=np.int32)), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, codes, owns, pa.array(np.append(work, np.zeros(len(x) - 1, np.int64)))], ["vec_id", "label", "v", "codes", "own", "work"])

    columns = ["vec_id", "label", "v"] + ([] if first else ["codes", "own"])
    return rows.select(*columns).mapInArrow(run, schema)


def ball_sums(coded: DataFrame, spans: list[slice], entries: int) -> DataFrame:
    """part, entry, n, total (componentwise), far (largest squared distance): a task adds its rows up before the shuffle."""
    n, width = len(spans), max(s.stop - s.start for s in spans)

    def run(batches):
        total, count, far = np.zeros((n, entries, width), np.int64), np.zeros((n, entries), np.int64), np.zeros((n, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, n)
            own = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for k, s in enumerate(spans):
                count[k] += np.bincount(code[:, k], minlength=entries)
                np.maximum.at(far[k], code[:, k], own[:, k])
                order = np.argsort(code[:, k], kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(code[order, k].astype(np.int64)) != 0))
                total[k, code[order[heads], k], : s.stop - s.start] += np.add.reduceat(x[order, s], heads, axis=0)
        k, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(k, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[k, e]), "far": pa.array(far[k, e]), "total": pa.array(total[k, e].tolist(), pa.list_(pa.int64()))})

    each = coded.select("v", "codes", "own").mapInArrow(run, "part int, entry int, n long, far long, total array<long>")
    columns = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *columns)


def ball_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, own, work of every kept row; the final codebooks of all parts).

    codes: an unsigned 16-bit entry index a part; own: the squared distances; work: how many distances were computed for the
    block that the row leads. Rows with a null or non-finite component go (see ``whole_vectors`` for lengths and sizes);
    rows of the same vec_id are coded each; the codebooks start from the smallest vec_ids, of equal ones from the smaller vector,
    and null ids start none, unless all are null. Fewer rows than entries give fewer entries. An empty table gives no rows."""
    if not 0 < entries <= 1 << 16:
        raise ValueError("an entry's index must fit 16 bits")
    rows = whole_vectors(df, scale)
    length = rows.agg(F.max(F.size("v"))).first()[0]
    if length is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.array().cast("array<long>").alias("own"), F.lit(0).cast("long").alias("work")), []
    rows = materialize(rows.where(F.size("v") == length), "vectors")
    spans = cuts(length, parts)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if (numbered := [r for r in start if r["vec_id"] is not None]) or not start:
        start = numbered
    start = np.array([r["v"] for r in start], np.int64)
    books, balls = [start[:, s] for s in spans], [Balls(start[:, s]) for s in spans]
    state = rows
    for turn in range(rounds + 1):
        state = materialize(run_round(state, balls, spans), f"codes-{turn}")
        if turn == rounds:
            break
        sums, fresh, moved, radius = ball_sums(state, spans, entries).collect(), [b.copy() for b in books], [], []  # parts x entries rows
        reached = [np.zeros(len(b)) for b in books]
        for r in sums:
            s = spans[r["part"]]
            fresh[r["part"]][r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(s.stop - s.start)]
            reached[r["part"]][r["entry"]] = r["far"] ** 0.5
        for k in range(parts):
            step = np.sqrt(((fresh[k] - books[k]) ** 2).sum(1).astype(np.float64))
            moved.append(step > 0)
            radius.append((reached[k] + step) * (1 + 1e-9))
        books = fresh
        balls = [Balls(books[k], moved[k], radius[k]) for k in range(parts)]
    return state.select("vec_id", "label", "codes", "own", "work"), books


def digest(books: list[np.ndarray]) -> str:
    """Lower-case sha256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_report(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits an index), error, label_error (over equal labels, nulls together), codebooks_sha256.

    For at most 256 entries. Cases as in ``ball_codes``; a label that holds a third of the rows is added up in each task first."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    coded, books = ball_codes(df, parts, entries, rounds, scale)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.substring(F.hex("codes"), k * 4 + 1, 2))
    error = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = coded.select("vec_id", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"), F.lower(F.array_join(pairs, "")).alias("code"), error.alias("error"))
    rows = materialize(rows, "coded")
    totals = materialize(rows.groupBy("none", "name").agg(F.count("*").alias("rows"), F.sum("error").alias("label_error")), "label-errors")
    out = joined(rows, totals, ["none", "name"], "rows", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, width: int = 16, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The report of vectors of ``parts * width`` components as DuckDB SQL: every distance, and no balls."""
    nearest = """a{r} AS MATERIALIZED (SELECT p.row, p.part, p.x, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) * 256 + b.entry) AS near
  FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.row, p.part, p.x)"""
    update = """b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT part, entry, list(floor(total / n) ORDER BY place) AS x FROM
  (SELECT part, near % 256 AS entry, place, CAST(sum(y) AS DOUBLE) AS total, count(*) AS n FROM (SELECT part, near, unnest(x) AS y, unnest(range(len(x))) AS place FROM a{r}) GROUP BY ALL) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""
    steps = ",\n".join(f"{nearest.format(r=r)},\n{update.format(r=r, n=r + 1)}" for r in range(rounds)) + f",\n{nearest.format(r=rounds)}"
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, k AS part, x[k * {width} + 1 : (k + 1) * {width}] AS x FROM v, range({parts}) t(k)),
b0 AS (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries}),
{steps},
c AS (SELECT row, string_agg(printf('%02x', near % 256), '' ORDER BY part) AS code, CAST(sum(near // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN v USING (row), h
"""
