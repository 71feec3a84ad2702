"""Near-duplicate documents: HyperMinHash registers, banded, estimated, and confirmed on full shingle sets.

1. A document's words make shingles of five; each shingle hash falls into one of 192 buckets, and of the least hash of a bucket
   a register keeps the count of leading zeros and ten mantissa bits. Equal sets form one class; only its smallest
   document goes on.
2. Four neighbouring registers are a band; classes that share a band key are candidates. The classes of a key are compared
   with one hub, those of a frequent key with one for each range of sizes; a hub is the same for all the keys that it is in.
   Of a key with few classes all pairs follow that are in different components by then; they are estimated where the key is,
   so that only pairs that pass become rows.
3. A candidate pair's Jaccard similarity is estimated from its registers, less what chance collisions add; pairs six
   standard errors below the threshold are left. The others are confirmed on full shingle sets.
4. A frequent key whose classes are not all connected by then is swept: classes of different components are estimated, and
   compared on full sets, in chunks of bounded size that one task holds at a time. Only links leave the task, no more
   than join its components, so a hot group of texts that are nearly similar enough makes no rows, and none is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bitmap, checkpointed, discard, joined, marked, materialize, text_slices

WORDS = 5
BUCKETS, ROWS, MANTISSA = 192, 4, 10
#: Sets up to this size also have a key for each register: few shingles can all meet in one band.
TINY = 12
#: Classes of a key that are all compared.
FEW = 8
#: Similarity in hundredths.
SIMILAR = 75
ERRORS = 6
#: Ranges of sizes in which the classes of a frequent key meet: each ends at this many times its start.
SPAN = 4
#: Bytes of shingles in a chunk of the sweep; a set counts as LEAST bytes at least.
CHUNK, LEAST = 8 << 20, 1024
#: Pairs of one document beyond which they are dealt to parts, and how many parts.
MANY, SALTS = 256, 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes.

    A word's hash is a polynomial of random values of its bytes, A-Z as a-z; it is the difference of two prefix sums, so a
    window of a text is hashed at once. Words longer than LONG are hashed one by one."""

    WINDOW, LONG = 1 << 17, 4096

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[list(b" \t\n\v\f\r")] = True
        self.byte = _mixed(np.arange(1, 257, dtype=np.uint64))
        self.byte[65:91] = self.byte[97:123]
        inverse = np.uint64(pow(int(MIX), -1, 1 << 64))
        self.power, self.back = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.WINDOW, x)])) for x in (MIX, inverse))

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word of ``data``."""
        import xxhash

        blank = np.ones(len(data) + 2, np.int8)
        blank[1:-1] = self.space[data]
        edges = np.flatnonzero(np.diff(blank))
        start, end = edges[::2], edges[1::2]
        out, at = np.zeros(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + self.WINDOW, "right")))
            low = int(start[at])
            if end[to - 1] - low <= self.WINDOW:
                part = self.byte[data[low : int(end[to - 1])]]
                part *= self.power[: len(part)]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part, out=sums[1:])
                s, e = start[at:to] - low, end[at:to] - low
                out[at:to] = (sums[e] - sums[s]) * self.back[s]
            at = to
        for k in np.flatnonzero(end - start > self.LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes().lower())
        return start, _mixed(out + (end - start).astype(np.uint64))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in texts])
        start, h = self.words(np.frombuffer(b" ".join(texts), np.uint8))
        n = max(0, len(h) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled = rolled * MIX + h[k : k + n]
        rolled, out, at = _mixed(rolled), [], 0
        for to in np.searchsorted(start, ends).tolist():
            size = to - at
            if size >= WORDS:
                own = np.sort(rolled[at : to - WORDS + 1])
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                out.append(own[new])
            elif size:
                x = size
                for w in h[at:to].tolist():
                    x = (x * int(MIX) + w) & 0xFFFFFFFFFFFFFFFF
                out.append(_mixed(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at = to
        return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BUCKETS 16-bit registers for each set; 0: no shingle in that bucket. The high 32 bits of the hashes decide.

    A bucket is a range of hashes, so in a sorted set its least hash comes first."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    if not sets or not sum(map(len, sets)):
        return out
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    wide = (h >> np.uint64(32)) * np.uint64(BUCKETS)
    key = doc * BUCKETS + (wide >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = key[1:] != key[:-1]
    # what the hash is within its bucket, in 32 bits: exact as a double, whose exponent counts the leading zeros
    fraction, exponent = np.frexp((wide[first] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    out.reshape(-1)[key[first]] = ((33 - exponent).astype(np.uint16) << MANTISSA) | mantissa | np.uint16(0x8000)
    return out


def band_keys(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band that is not empty, and for tiny sets of every register."""
    bands = rows.reshape(len(rows), -1, ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64)
    for k in range(ROWS):
        key = (key << np.uint64(16)) | bands[:, :, k]
    key = _mixed(key + MIX * np.arange(1, bands.shape[1] + 1, dtype=np.uint64))
    at, band = np.nonzero(bands.any(2))
    tiny = np.flatnonzero((sizes <= TINY) & (sizes > 0))
    r, b = np.nonzero(rows[tiny])
    single = _mixed(rows[tiny][r, b].astype(np.uint64) + MIX * (b + 1000).astype(np.uint64))
    return np.concatenate([at, tiny[r]]), np.concatenate([key[at, band], single])


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Equal registers to expect of disjoint sets: a bucket holds some of both, and mantissas agree by chance."""
    both = (1 - np.exp(-n / BUCKETS)) * (1 - np.exp(-m / BUCKETS))
    ratio = n / np.maximum(m, 1)
    return BUCKETS * both * 0.17 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)


def least_similar(used: np.ndarray) -> np.ndarray:
    """The least estimate that passes, of so many registers."""
    t = SIMILAR / 100
    return t - ERRORS * np.sqrt(t * (1 - t) / used) - 1 / used


def set_bits(flags: np.ndarray) -> np.ndarray:
    """How many of the BUCKETS flags of each row are set."""
    return np.bitwise_count(np.packbits(flags, axis=1).view(np.uint64)).sum(1, dtype=np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity, and the least value that still passes."""
    used = np.maximum(set_bits((a | b) > 0), 1)
    same = BUCKETS - set_bits(a != b) - (BUCKETS - used)  # equal, and not both empty
    return np.clip((same - chance(n, m)) / used, 0, 1), least_similar(used)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), digest of the set (empty for none), registers."""

    def run(batches):
        import xxhash

        shingler = Shingler()
        for part in text_slices(batches):
            sets = shingler.sets(as_bytes(part.column(1)))
            rows = registers(sets)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "n", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, digest binary, registers binary")


def bands(sketches: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """key, doc, n: a row for each band key of each class; with ``bits`` only for keys whose bit is set."""
    shared = None if bits is None else sketches.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sizes = part.column(1).to_numpy()
                rows = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(len(sizes), BUCKETS)
                row, key = band_keys(rows, sizes)
                key = key.view(np.int64)
                if shared is not None:
                    use = marked(shared.value, key)
                    row, key = row[use], key[use]
                for k in range(0, len(row), 100_000):
                    r = row[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(part.column(0).to_numpy()[r]), pa.array(sizes[r])], ["key", "doc", "n"])

    return sketches.select("doc", "n", "registers").mapInArrow(run, "key long, doc long, n long")


def shared_keys(firsts: DataFrame) -> DataFrame:
    """key, doc, n, c of the keys that c > 1 classes share. Of the others a bitmap of 16 MB at most keeps nearly all from a second shuffle."""
    counts = bands(firsts).groupBy("key").agg(F.count("*").alias("c"))
    shared = materialize(counts.where("c > 1"), "shared-keys")
    bits = 1 << min(27, max(15, (16 * shared.count()).bit_length()))
    keys = materialize(bands(firsts, bitmap(shared, "key", bits)), "keys")
    out = materialize(joined(keys, shared, ["key"], "c", keys.count()).select("key", "doc", "n", "c"), "bands")
    discard(shared, keys)
    return out


def sized_alike(n, m):
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR


def spans(rows: DataFrame) -> DataFrame:
    """A row (span, own) for the range of sizes of each class, and for the one below while a class of it may be similar."""
    start = F.pow(F.lit(float(SPAN)), F.col("g"))
    both = F.when(F.col("n") * SIMILAR <= start * 100, F.array(F.col("g"), F.col("g") - 1)).otherwise(F.array("g"))
    ranged = rows.withColumn("g", F.floor(F.log("n") / F.log(F.lit(float(SPAN))) + 1e-9).cast("int"))
    return ranged.withColumn("span", F.explode(both)).withColumn("own", F.col("span") == F.col("g")).drop("g")


def first_pairs(few: DataFrame) -> DataFrame:
    """Pairs of each class of a key (key, doc, n) with the key's class of least hash, if of similar size."""
    grouped = few.groupBy("key").agg(F.collect_list(F.struct("doc", "n")).alias("x"), hub_of().alias("hub"))
    ends = grouped.select("hub", F.explode("x").alias("y")).where((F.col("hub.doc") != F.col("y.doc")) & sized_alike(F.col("hub.n"), F.col("y.n")))
    return ends.select(F.least("hub.doc", "y.doc").alias("a"), F.greatest("hub.doc", "y.doc").alias("b"))


def hub_of():
    return F.min(F.struct(F.xxhash64("doc").alias("h"), "doc", "n"))


def open_pairs(few: DataFrame, label: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs a < b that pass the estimate, of similar size, that share a key of at most FEW classes, are in different components of
    ``label``, and were not met in ``first_pairs`` of that key.

    A key gets the registers of its classes once, and its pairs are made and estimated in one task: only what passes leaves it."""
    rows = few.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    members = F.sort_array(F.collect_list(F.struct("doc", "n", "component")))
    grouped = rows.groupBy("key").agg(members.alias("x"), hub_of().alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    hub = lambda x: (x["doc"] == F.col("hub.doc")) & (x["n"] == F.col("hub.n"))
    rest = grouped.where("low <> high").select("key", F.filter("x", lambda x: ~hub(x)).alias("x")).where(F.size("x") > 1)
    rest = rest.select("key", F.explode("x").alias("x")).select("key", "x.*").join(sketches.select("doc", "n", "registers"), ["doc", "n"])
    rest = rest.groupBy("key").agg(F.collect_list(F.struct("doc", "n", "component", "registers")).alias("x"))  # FEW at most

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            lengths = np.diff(lists.offsets.to_numpy())
            doc, n, component, registers_ = (lists.flatten().field(k) for k in range(4))
            doc, n, component = (c.to_numpy(zero_copy_only=False) for c in (doc, n, component))
            regs = np.frombuffer(b"".join(registers_.to_pylist()), np.uint16).reshape(-1, BUCKETS)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            for step in range(1, int(lengths.max(initial=0))):
                i = np.flatnonzero(owner[:-step] == owner[step:])
                j = i + step
                i, j = (x[(component[i] != component[j]) & (doc[i] != doc[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * SIMILAR)] for x in (i, j))
                for at in range(0, len(i), 8192):
                    a, b = i[at : at + 8192], j[at : at + 8192]
                    similar, least = estimate(regs[a], regs[b], n[a], n[b])
                    a, b = doc[a[similar >= least]], doc[b[similar >= least]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rest.select("x").mapInArrow(run, "a long, b long").distinct()


def hub_pairs(spanned: DataFrame, total: int) -> DataFrame:
    """Pairs of each class of a frequent key with the key's hub in its range of sizes: of those in the range the one of least hash."""
    hubs = spanned.groupBy("key", "span").agg(F.min(F.when(F.col("own"), F.struct(F.xxhash64("doc").alias("h"), "doc", "n"))).alias("hub"), F.count("*").alias("held"))
    hubs = materialize(hubs.where("hub IS NOT NULL AND held > 1").select("key", "span", "held", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    rows = joined(spanned, hubs, ["key", "span"], "held", total).where((F.col("doc") != F.col("hub")) & sized_alike(F.col("n"), F.col("hub_n")))
    return rows.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))


def with_sides(pairs: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of ``side`` (doc) for a and for b. Pairs of a document that is in over MANY of them are dealt
    to SALTS parts, each of which gets what the document brings."""
    mine = lambda s: side.select(F.col("doc").alias(s), *[F.col(c).alias(c + s) for c in columns])
    order = ["a", "b", *[c + s for c in columns for s in ("a", "b")]]
    many = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").count().where(F.col("count") > MANY).select("doc")
    many = materialize(many, "many-pairs")
    if not many.limit(1).count():
        return pairs.select("a", "b").join(mine("a"), "a").join(mine("b"), "b").select(order)
    flagged = pairs.select("a", "b")
    for s in ("a", "b"):
        flagged = flagged.join(many.select(F.col("doc").alias(s), F.lit(True).alias("many" + s)), s, "left")
    flagged = materialize(flagged.select("a", "b", F.coalesce("manya", "manyb", F.lit(False)).alias("many")), "dealt-pairs")
    few = flagged.where("NOT many").select("a", "b").join(mine("a"), "a").join(mine("b"), "b").select(order)
    salted = flagged.where("many").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int").alias("salt"))
    for s in ("a", "b"):
        salted = salted.join(salted.select(s, "salt").distinct().join(mine(s), s), [s, "salt"])
    return few.unionByName(salted.select(order))


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the estimate."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                ra, rb = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
                similar, least = estimate(ra, rb, part.column(2).to_numpy(), part.column(3).to_numpy())
                keep = pa.array(np.flatnonzero(similar >= least))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    return with_sides(pairs, sketches, ["n", "registers"]).mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, shingles of the texts whose doc_id is in ``ids`` (doc), and of a few others.

    A bitmap of the wanted ids, of 16 MB at most, spares other texts the hashing; no text is shuffled. Full, it only
    lets more texts through."""
    ids = materialize(ids.select("doc").distinct(), "wanted")
    bits = 1 << min(27, max(15, (16 * ids.count()).bit_length()))
    hashed = lambda c: F.xxhash64(F.col(c).cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(hashed("doc").alias("k")), "k", bits))

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            use = np.flatnonzero(marked(shared.value, batch.column(2).to_numpy()))
            for part in text_slices([batch.take(pa.array(use))]) if len(use) else ():
                sets = shingler.sets(as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "shingles"])

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), hashed("doc_id").alias("k"))
    out = materialize(texts.mapInArrow(run, "doc long, shingles binary"), "sets")
    discard(ids)
    return out


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b), a materialized table that goes, whose full shingle sets reach the similarity."""
    sets = sets_of(docs, pairs.select(F.col("a").alias("doc")).union(pairs.select("b")))

    def check(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if similar_enough(int(shared_with(x, y, np.array([0]))[0]) if len(x) and len(y) else 0, len(x), len(y)):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    out = materialize(with_sides(pairs, sets, ["shingles"]).mapInArrow(check, "a long, b long"), "links")
    discard(pairs, sets)
    return out


def linked_pairs(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), each tried once, that pass the estimate and then full sets."""
    candidates = materialize(pairs.distinct(), "candidates")
    passed = materialize(estimated(candidates, sketches), "pairs")
    discard(candidates)
    return confirmed(passed, docs)


def shared_with(mine: np.ndarray, others: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many values of each of the non-empty sorted sets that start at ``starts`` of ``others`` are in the sorted set ``mine``."""
    at = np.minimum(np.searchsorted(mine, others), len(mine) - 1)
    return np.add.reduceat((mine[at] == others).astype(np.int64), starts)


def similar_enough(shared, n, m):
    return (100 * shared >= SIMILAR * (n + m - shared)) & (shared > 0)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b), by least neighbours and pointer jumps.

    A node that holds more than one edge in 4096 (there are no more than that many) tells its component by broadcast."""
    both = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    label = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("component"), F.count("*").alias("held")))
    total = both.count()
    while True:
        heard = joined(both.withColumnRenamed("v", "node"), label, ["node"], "held", total).select(F.col("u").alias("node"), "component")
        least_heard = heard.groupBy("node").agg(F.min("component").alias("heard"))
        # a root hears what its members hear, so whole trees join and not single nodes
        now = label.join(least_heard, "node", "left").withColumn("heard", F.least("component", F.coalesce("heard", "component")))
        roots = now.groupBy(F.col("component").alias("node")).agg(F.min("heard").alias("root_heard"))
        least = now.join(roots, "node", "left").select("node", "held", F.least("heard", F.coalesce("root_heard", "heard")).alias("component"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = checkpointed(least.join(up, "component", "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "held"))
        moved = new.join(label.select("node", F.col("component").alias("before")), "node").where("component <> before").limit(1).count()
        label = new
        if not moved:
            return label.select("node", "component")


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after ``links`` join those of ``label``."""
    links = checkpointed(links)
    if label is None:
        return components(links)
    at = lambda s: label.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    above = components(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = label.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = above.select(F.col("component").alias("node"), F.col("top").alias("component")).join(label.select("node"), "node", "left_anti")
    return checkpointed(old.union(new))


def links_between(doc: np.ndarray, component: np.ndarray, side: np.ndarray, own: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join components of these classes, no two of them the same two.

    Classes of ``side`` 0 and 1 are two chunks, and only pairs of both are compared; 2 is one chunk. Pairs of which neither is
    ``own`` to this range of sizes are compared in another."""
    n = np.array([len(s) for s in sets])
    order = np.lexsort((doc, n))
    n, doc, component, side, own, sets = n[order], doc[order], component[order].copy(), side[order], own[order], [sets[k] for k in order]
    regs, out = registers(sets), []
    names, count = np.unique(component, return_counts=True)
    main = names[count.argmax()]
    other, first = component != main, np.searchsorted(n, n * SIMILAR / 100, "left")
    last = np.searchsorted(n, n * 100 / SIMILAR, "right")
    for x in np.flatnonzero(other).tolist():
        at = slice(int(first[x]), int(last[x]))
        open_ = (component[at] != component[x]) & (own[at] | own[x]) & ((side[at] != side[x]) | (side[x] == 2))
        open_ &= ~other[at] | (np.arange(at.start, at.stop) > x)  # of two others the pair comes once
        if not open_.any():
            continue
        similar, least = estimate(regs[at], regs[x][None, :], n[at], n[x : x + 1])
        passed = np.flatnonzero(open_ & (similar >= least))
        at = at.start + passed[np.argsort(-similar[passed], kind="stable")]
        while len(at):
            now, at = at[:16], at[16:]
            shared = shared_with(sets[x], np.concatenate([sets[k] for k in now]), np.cumsum(n[now]) - n[now])
            for k in now[similar_enough(shared, n[now], n[x])].tolist():
                if component[k] != component[x]:
                    out.append((min(int(doc[k]), int(doc[x])), max(int(doc[k]), int(doc[x]))))
                    component[component == component[k]] = component[x]
            at = at[component[at] != component[x]]
    return out


def swept(spanned: DataFrame, label: DataFrame, docs: DataFrame, chunk: int | None = None) -> DataFrame:
    """Links (a, b) between classes of a frequent key that ``label`` has in different components.

    Of keys that the same classes share, one is swept."""
    rows = spanned.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    weight = F.greatest(F.col("n") * 8, F.lit(LEAST))
    parts = rows.groupBy("key", "span", "component").agg(F.sum(weight).alias("bytes"), F.max("own").alias("own"), F.count("*").alias("held"), *[F.bit_xor(F.xxhash64("doc", "n", F.lit(x))).alias(x) for x in ("x", "y")])
    parts = parts.groupBy("key", "span").agg(F.count("*").alias("parts"), F.sum("bytes").alias("bytes"), F.max("own").alias("some"), F.sum("held").alias("held"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    once = parts.where("parts > 1 AND some").groupBy("span", "held", "bytes", "x", "y").agg(F.min("key").alias("key"))
    open_ = materialize(once.select("key", "span", "held", F.ceil(F.col("bytes") / (chunk or CHUNK)).cast("int").alias("chunks")), "open-keys")
    total = rows.count()
    rows = joined(rows, open_, ["key", "span"], "held", total).withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    rows = materialize(rows.select("key", "span", "doc", "component", "own", "chunk", "chunks"), "unconnected")
    sets = sets_of(docs, rows)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = rows.withColumn("other", other).select("key", "span", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "doc", "component", "own", F.when(F.col("chunk") == F.col("other"), F.lit(2)).otherwise((F.col("chunk") > F.col("other")).cast("int")).alias("side"))

    def run(members: pd.DataFrame) -> pd.DataFrame:
        found = []
        if members["component"].nunique() > 1:
            found = links_between(*(members[c].to_numpy() for c in ("doc", "component", "side", "own")), [np.frombuffer(x, np.uint64) for x in members["shingles"]])
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    out = materialize(dealt.join(sets, "doc").groupBy("key", "span", "i", "j").applyInPandas(run, "a long, b long").distinct(), "links")
    discard(open_, rows, sets)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased. Documents are linked when 100 * shared >= 75 * all of their
    distinct five-word shingles; fewer words are one shingle, no words none and no link. A component is named by its
    smallest doc_id. Null text is empty; a null doc_id is linked with nothing and kept, its component null; rows of
    equal doc_id are one document with several texts, in one component; other columns are ignored; an empty table gives
    no row. Texts of any length are hashed whole, a window at a time; one text's shingles fit a task."""
    documents = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = materialize(sketch(documents), "sketches")
    linked = sketches.where("n > 0 AND doc_id IS NOT NULL")
    least = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "registers")).alias("x"), F.count("*").alias("held"))
    classes = materialize(least.select("digest", "held", F.col("x.doc_id").alias("doc"), F.col("x.n").alias("n"), F.col("x.registers").alias("registers")), "classes")
    whole, sketches = sketches, materialize(sketches.drop("registers"), "sizes")
    discard(whole)  # the classes have the registers
    linked = sketches.where("n > 0 AND doc_id IS NOT NULL")
    # a doc_id that stands for several sets has a row for each: all their keys and estimates are tried
    firsts = classes.select("doc", "n", "registers")
    rows = shared_keys(firsts)
    frequent = spans(rows.where(F.col("c") > FEW).select("key", "doc", "n"))
    few = rows.where(F.col("c") <= FEW).select("key", "doc", "n")
    links = linked_pairs(first_pairs(few).union(hub_pairs(frequent, rows.count())), firsts, documents)
    several = linked.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    copies = linked.join(several, "doc_id").select("doc_id", "digest").join(classes.select("digest", "doc"), "digest").where("doc_id <> doc")
    label = merged(None, links.union(copies.select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))))
    label = merged(label, confirmed(materialize(open_pairs(few, label, firsts), "open-pairs"), documents))
    label = merged(label, swept(frequent, label, documents))
    named = classes.select("digest", "doc", "held").join(label.withColumnRenamed("node", "doc"), "doc", "left").select("digest", "held", F.coalesce("component", "doc").alias("found"))
    found = joined(linked.select("doc_id", "n", "digest"), materialize(named, "components"), ["digest"], "held", sketches.count()).select("doc_id", "n", "found")
    alone = sketches.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("found"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("found").alias("component_id"), F.coalesce(F.col("found") == F.col("doc_id"), F.lit(True)).alias("kept"))
