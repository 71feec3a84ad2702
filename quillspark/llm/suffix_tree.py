"""Probabilistic suffix tree over words: training counts gathered by Spark, scores of whole texts.

Symbols are the words of a text and one end. The root is a discounted unigram distribution in which all unseen words share
the mass of one more symbol, as in the base score. A context of up to ``depth`` words is a candidate, and a word is one of
its explicit next symbols, while they occur together ``least_count`` times; it is retained if its next-symbol distribution
diverges enough from that of its longest suffix. A retained state discounts its counts and gives what it takes off to its
suffix, so each state's distribution sums to 1; a word is scored in the longest suffix that is a state.

Sizes: support is absolute, so contexts and pairs grow with the corpus; their counts and states are tables. What is
broadcast only spares joins: the entries whose relative frequency reaches ``least_word`` (at most its inverse for the words
and for either table of a level), and bitmaps of BITS hashed keys, which never miss a key. All else is joined by key.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bitmap, crc_mod, discard, marked, materialize, release, text_slices

END = b" end"  # no word holds a space
LEAST_WORD, LEAST_COUNT = 1e-6, 8
#: Contexts and pairs need no relative frequency, so that none is lost as the corpus grows; the tests' dictionaries read these.
LEAST_CONTEXT = LEAST_PAIR = 0.0
DISCOUNT = 0.75
#: A context stays if its log-likelihood gain is this many nats for each explicit symbol.
GAIN = 4.0
MEMO = 1_000_000
BIG = 1 << 62
BITS = 1 << 27
#: Ranges of the 32-bit buckets of grams, and grams of a task that are counted at a time.
RANGES, HELD = 256, 2_000_000
#: Bytes of text in a slice, which is one row of codes (a text may be longer).
SLICE = 512 << 10
#: Turns in which the slices are scored, so that what those of one turn ask and are told is gone before the next.
TURNS = 3
#: Ranges of keys in which slices meet counts and states, at least, and slices for each range beyond that.
PARTS, SLICES = 128, 400
#: Input splits that a task counts together, if that leaves every core two tasks.
SPLITS = 4
#: Low bytes of the steps between sorted keys, which no code shortens.
PLAIN = 5


class Codes(dict):
    """Word to its code of 62 hash bits."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        self[word] = h = self.hash(word) & (BIG - 1) | BIG
        return h

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens and the number of tokens of each text."""
        if len(self) > MEMO:
            self.clear()
        get, end, out, sizes = self.__getitem__, self[END], [], []
        for text in texts:
            words = text.lower().split()
            out.extend(map(get, words))
            out.append(end)
            sizes.append(len(words) + 1)
        return np.array(out, np.int64), np.array(sizes, np.int64)


class Counter:
    """Sums of equal keys in bounded memory; ``beside`` are columns that the key determines."""

    def __init__(self, names: list[str], most: int = 1_000_000):
        self.names, self.parts, self.held, self.most = names, [], 0, most

    def add(self, keys: np.ndarray, *beside: np.ndarray, times: np.ndarray | None = None):
        """``times``: how often each of some distinct keys stands there."""
        if times is None:
            keys, at, times = np.unique(keys, return_index=True, return_counts=True)
            beside = [b[at] for b in beside]
        self.parts.append((keys, times.astype(np.int64), *beside))
        self.held += len(keys)
        if self.held > self.most:
            yield from self.flush(self.most * 3 // 4)

    def flush(self, keep: int = 0):
        if not self.parts:
            return
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        k, first, at = np.unique(columns[0], return_index=True, return_inverse=True)
        n = np.bincount(at, columns[1]).astype(np.int64)
        rows = (k, n, *(x[first] for x in columns[2:]))
        self.parts, self.held = [rows], len(k)
        if len(k) > keep:
            self.parts, self.held = [], 0
            found = {"k": k, "n": n, "context": rows[-2], "suffix": rows[-1]}
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[x][i : i + 200_000]) for x in self.names], self.names)
            del columns, first, at, rows, found
            release()


def coded(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (doc_id, text, held) as codes, in slices of texts of equal ``held``: row, held, doc_id and
    sizes of its texts, the distinct words' codes, and each token's place among them.

    The texts are cut into words once; what is written here is read in each pass and takes about as much as the texts' Parquet."""

    def run(batches):
        codes = Codes()
        for batch in batches:
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for held in (False, True):
                use = np.flatnonzero(flags == held)
                for part in text_slices([batch.take(pa.array(use))], most=SLICE) if len(use) else ():
                    c, sizes = codes.of(as_bytes(part.column(1)))
                    c = pa.array(c).dictionary_encode()
                    words = c.dictionary.to_numpy()
                    at = c.indices.to_numpy().astype("<u2" if len(words) <= 1 << 16 else "<u4")
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    rows = [pa.array([held]), ids, *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, words, at))]
                    yield pa.RecordBatch.from_arrays(rows, ["held", "doc_id", "sizes", "words", "places"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held")
    slices = texts.mapInArrow(run, "held boolean, doc_id array<long>, sizes binary, words binary, places binary")
    return materialize(slices.withColumn("row", F.monotonically_increasing_id()), "codes")


def decoded(batches):
    """(row, codes of the distinct words, each token's place among them, number of tokens of each text) of every slice."""
    for batch in batches:
        row, *columns = (batch.column(batch.schema.get_field_index(n)) for n in ("row", "words", "places", "sizes"))
        for k in range(batch.num_rows):
            words, places, sizes = (c[k].as_buffer() for c in columns)
            words = np.frombuffer(words, np.int64)
            yield row[k].as_py(), words, np.frombuffer(places, "<u2" if len(words) <= 1 << 16 else "<u4"), np.frombuffer(sizes, np.int64)
        release()


def mix(a: np.ndarray, b) -> np.ndarray:
    """64 hash bits of a pair of keys, never 0."""
    x = a.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) + np.asarray(b, np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))).view(np.int64)
    return np.where(x == 0, 1, x)


def shifted(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What stands before each token of its text (0: nothing)."""
    out = np.empty_like(keys)
    out[0:1], out[1:] = 0, keys[:-1]
    out[np.cumsum(sizes) - sizes] = 0
    return out


def grams(codes: np.ndarray, sizes: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (gram, context, suffix): keys of the level + 1 words that end at each token, without the last and without the first (0: none)."""
    out, key = [], codes
    for _ in range(depth):
        context = shifted(key, sizes)
        gram = np.where((context != 0) & (key != 0), mix(context, key), 0)
        out.append((gram, context, key))
        key = gram
    return out


def bucket(grams: np.ndarray) -> np.ndarray:
    """The high 32 bits of each key."""
    return (grams.view(np.uint64) >> np.uint64(32)).astype(np.int64)


def packed(buckets: np.ndarray):
    """(range, distinct buckets, counts) of each of the RANGES of some 32-bit buckets: what stands between two sorted buckets in four byte planes, and counts up to 255, compressed."""
    k, n = np.unique(buckets, return_counts=True)
    ends = np.searchsorted(k >> (32 - RANGES.bit_length() + 1), np.arange(RANGES + 1))
    for part in np.flatnonzero(np.diff(ends)).tolist():
        span = slice(ends[part], ends[part + 1])
        steps = np.diff(k[span], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
        yield part, zlib.compress(steps.tobytes(), 1), zlib.compress(np.minimum(n[span], 255).astype(np.uint8).tobytes(), 1)


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(zlib.decompress(counts), np.uint8)
    steps = np.frombuffer(zlib.decompress(keys), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint32).ravel(), dtype=np.uint32), n


def full_buckets(docs: DataFrame, usable, least_count: int) -> np.ndarray:
    """A bit for each 32 neighbouring buckets of grams, set if one of them holds ``least_count`` grams (at most 255).

    Counts of 32 hash bits are at least those of their grams, so a bucket without the support holds no gram that has it. A
    task sends its counts of a range of buckets as one packed row; a range is summed in one task, in an array of fixed size."""
    width, names = (1 << 32) // RANGES, ["part", "k", "n"]

    def count(batches):
        held, size = [], 0

        def rows():
            nonlocal held, size
            found = [pa.array(x) for x in zip(*packed(np.concatenate(held)), strict=True)] if size else None
            held, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([found[0].cast(pa.int32()), *found[1:]], names)

        for gram, _, _ in usable(batches):
            held.append(bucket(gram).astype(np.uint32))
            size += len(gram)
            if size > HELD:
                yield from rows()
        yield from rows()

    def total(batches):
        part, sums = None, None

        def row():
            full = np.packbits((sums >= min(least_count, 255)).reshape(-1, 32).any(1), bitorder="little")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([full.tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for p, k, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if part is not None:
                        yield row()
                    part, sums = p, np.zeros(width, np.uint8)
                k, n = unpacked(k, n)
                k &= width - 1
                sums[k] = np.minimum(sums[k].astype(np.int16) + n, 255)
        if part is not None:
            yield row()

    out = np.zeros((1 << 32) // 32 // 8, np.uint8)
    ranges = docs.mapInArrow(count, "part int, k binary, n binary").repartition("part").sortWithinPartitions("part")
    for r in ranges.mapInArrow(total, "part int, bits binary").collect():
        out[r["part"] * (width // 256) :][: width // 256] = np.frombuffer(r["bits"], np.uint8)
    return out


def squeezed(numbers: np.ndarray, plain: int = 0) -> bytes:
    """Whole numbers from 0 in byte planes up to the highest in use; all but the ``plain`` lowest planes are compressed."""
    x = np.ascontiguousarray(numbers, np.uint64)
    width = max(plain, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return struct.pack("<IB", len(x), width) + planes[:plain].tobytes() + zlib.compress(planes[plain:width].tobytes(), 1)


def restored(data: bytes, plain: int = 0) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    body, out = memoryview(data)[5:], np.zeros((n, 8), np.uint8)
    out[:, :plain] = np.frombuffer(body[: plain * n], np.uint8).reshape(plain, n).T
    out[:, plain:width] = np.frombuffer(zlib.decompress(body[plain * n :]), np.uint8).reshape(width - plain, n).T
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def turned(keys: np.ndarray) -> np.ndarray:
    """Keys with their two high bits, which are the same for all words, at the end: even over all ranges."""
    x = keys.view(np.uint64)
    return x << np.uint64(2) | x >> np.uint64(62)


def spans(keys: np.ndarray, parts: int):
    """(part, span) of each of ``parts`` ranges that holds some of the sorted turned keys."""
    ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    for part in np.flatnonzero(np.diff(ends)).tolist():
        yield part, slice(ends[part], ends[part + 1])


def steps(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)), PLAIN)


def unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(restored(data, PLAIN), dtype=np.uint64)


def keyed(df: DataFrame, key, schema: str) -> DataFrame:
    """``df`` with its column k replaced by ``key`` of each batch."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            columns = [pa.array(key(batch)) if n == "k" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def numbers(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def gathered(slices: DataFrame) -> DataFrame:
    """``slices`` in fewer, larger tasks: each sends the words and pairs it has counted once, so fewer tasks send fewer rows."""
    splits = slices.rdd.getNumPartitions()
    tasks = max(2 * slices.sparkSession.sparkContext.defaultParallelism, splits // SPLITS)
    return slices.coalesce(tasks) if tasks < splits else slices


def learn(slices: DataFrame, depth: int = 2, least_word: float = LEAST_WORD, least_count: int = LEAST_COUNT, gain: float = GAIN) -> tuple[dict, DataFrame, DataFrame]:
    """(model, counts, states) of the texts in ``slices`` (see ``coded``): what is broadcast, the table of every training word's
    count, and the table of what a state leaves its suffix and gives each explicit symbol. Both are (k, n, m, seen): a
    count and a gift are (n - DISCOUNT * m) / seen, what is left is 1 less that."""
    docs = slices.select("row", "words", "places", "sizes")
    spark = docs.sparkSession

    def words(batches):
        sums = Counter(["k", "n"])
        for _, codes, at, _ in decoded(batches):
            yield from sums.add(codes, times=np.bincount(at, minlength=len(codes)))
        yield from sums.flush()

    counts = materialize(gathered(docs).mapInArrow(words, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "words")
    head = counts.agg(F.sum("n").alias("N"), F.count("*").alias("V"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
    total, distinct = head["N"] or 0, head["V"]
    off = min(0.95, max(0.05, head["n1"] / (head["n1"] + 2 * head["n2"]) if head["n1"] + head["n2"] else 0.5))
    often = max(1.0, least_word * total)
    model = {"N": total, "V": distinct, "off": off, "depth": depth}
    states, used = spark.createDataFrame([], "k long, v double, often long, n long, m long, seen long"), []
    #: Grams of the level before with their count and the probability of their last word in the states so far.
    before = counts.where(F.col("n") >= least_count).select("k", "n", ((F.col("n") - off) / max(total, 1)).alias("p"))
    for level in range(1, depth + 1):
        shared = spark.sparkContext.broadcast(bitmap(before, "k", BITS))

        def usable(batches, shared=shared, level=level):
            """Grams of which context and suffix may have the support, without which they have none."""
            for _, codes, at, sizes in decoded(batches):
                gram, context, suffix = grams(codes[at], sizes, level)[-1]
                use = np.flatnonzero(gram)
                use = use[marked(shared.value, context[use]) & marked(shared.value, suffix[use])]
                yield gram[use], context[use], suffix[use]

        full = spark.sparkContext.broadcast(full_buckets(docs, usable, least_count))

        def pairs(batches, usable=usable, full=full):
            sums = Counter(["n", "context", "suffix"])
            for gram, context, suffix in usable(batches):
                use = marked(full.value, bucket(gram) >> 5)
                yield from sums.add(gram[use], context[use], suffix[use])
            yield from sums.flush()

        joint = gathered(docs).mapInArrow(pairs, "n long, context long, suffix long").groupBy("context", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
        joint = joint.select(F.lit(0).cast("long").alias("k"), "context", "suffix", "n")
        joint = keyed(joint, lambda b: mix(numbers(b, "context"), numbers(b, "suffix")), "k long, context long, suffix long, n long")
        # the suffix of a gram occurs at least as often as the gram, so it is in the table
        joint = materialize(joint.join(before.select(F.col("k").alias("suffix"), F.col("p").alias("q")), "suffix"), "pairs")
        sums = joint.groupBy("context").agg(F.sum("n").alias("explicit"), F.sum("q").alias("q"), F.count("*").alias("m"), F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("likely"))
        sums = sums.join(before.select(F.col("k").alias("context"), F.col("n").alias("seen")), "context")
        left = F.greatest(F.lit(0.0), 1 - F.col("explicit") / F.col("seen"))
        other = F.greatest(F.lit(1e-12), 1 - F.col("q"))
        likely = F.col("likely") - F.col("explicit") * F.log("seen") + F.when(left > 0, F.col("seen") * left * F.log(left / other)).otherwise(0.0)
        kept = materialize(sums.where(likely >= gain * F.col("m")).select("context", "seen", "explicit", "m", (1 - (F.col("explicit") - DISCOUNT * F.col("m")) / F.col("seen")).alias("rest")), "contexts")
        p = (F.col("n") - DISCOUNT) / F.col("seen")
        used.append(joint)
        joint = materialize(joint.join(kept, "context", "left").select("k", "n", "seen", p.alias("own"), F.coalesce(F.col("rest") * F.col("q") + p, "q").alias("p")), "states")
        rests = kept.select(F.col("context").alias("k"), F.col("rest").alias("v"), F.col("seen").alias("often"), F.col("explicit").alias("n"), "m", "seen")
        rests = keyed(rests, lambda b: rest_key(numbers(b, "k")), "k long, v double, often long, n long, m long, seen long")
        states = states.unionByName(rests).unionByName(joint.where("own IS NOT NULL").select("k", F.col("own").alias("v"), F.col("n").alias("often"), "n", F.lit(1).cast("long").alias("m"), "seen"))
        used += [kept, joint]
        before = joint.select("k", "n", "p")
    states = materialize(states, "tree")
    discard(*used)
    for name, frame, count, value in (("words", counts, "n", "n"), ("states", states, "often", "v")):
        rows = frame.where(F.col(count) >= often).select("k", F.col(value).cast("double").alias("v")).toPandas().sort_values("k")  # relative frequencies, so bounded
        model[name] = rows["k"].to_numpy(np.int64), rows["v"].to_numpy(np.float64)
    model["bits"] = bitmap(states.where(F.col("often") < often), "k", BITS)
    return model, counts.select("k", "n", F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("seen")), states.select("k", "n", "m", "seen")


def rest_key(contexts: np.ndarray) -> np.ndarray:
    return np.where(contexts != 0, mix(contexts, 1), 0)


def indexed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A table sorted by key, and where each range of keys begins. The keys are hashes, so a range holds about half a key."""
    bits = min(22, max(1, 1 + len(keys).bit_length()))
    starts = np.searchsorted(keys, np.append((np.arange(1 << bits) - (1 << bits - 1)) << (64 - bits), BIG * 2 - 1)).astype(np.int32)
    return keys, values, starts, 64 - bits


def found(table: tuple[np.ndarray, np.ndarray, np.ndarray, int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, value) of each key in an indexed table; the value of an absent key is any."""
    k, v, starts, shift = table
    if not len(k):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    span = (keys >> shift) + (1 << 63 - shift)
    at = np.minimum(starts[span], len(k) - 1)
    have = k[at] == keys
    open_ = np.flatnonzero(~have & (k[at] < keys))
    while len(open_):
        at[open_] += 1
        open_ = open_[at[open_] < len(k)]
        now = k[at[open_]]
        have[open_] = now == keys[open_]
        open_ = open_[now < keys[open_]]
    at = np.minimum(at, len(k) - 1)
    return have, v[at]


def needed(m: dict, words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """(v, open, keys, order) of a slice. v: the count of each distinct word, then for each level what the state leaves
    and what it gives the word, of each token, so far as that is broadcast. open: which values of v tables have to
    tell. keys: those to look up, turned, sorted, each once; ``order`` has the place among them of every open value, in turn."""
    depth, state_of = m["depth"], m["states"]
    have, n = found(m["words"], words)
    v, open_, lacking = [np.where(have, n, 0.0)], [(0, np.flatnonzero(~have))], [words[~have]]

    def look(key):
        have, x = found(state_of, key)
        return have, x, ~have & marked(m["bits"], key)

    def put(absent, pos, key, have, x, lacks):
        value = np.full(len(at), absent)
        value[pos] = np.where(have, x, absent)
        v.append(value)
        open_.append((len(v) - 1, pos[lacks]))
        lacking.append(key[lacks])
        return pos[have | lacks]

    codes = words[at]
    rests = rest_key(words)
    known = rests, *look(rests)
    for level, (gram, context, _) in enumerate(grams(codes, sizes, depth)):
        pos = np.flatnonzero(context)
        if level:
            key = rest_key(context[pos])
            told = key, *look(key)
        else:
            told = [x[at[pos - 1]] for x in known]
        pos = put(1.0, pos, *told)  # a context that is no state names no word
        put(0.0, pos, gram[pos], *look(gram[pos]))
    keys, order = np.unique(turned(np.concatenate(lacking)), return_inverse=True)
    return v, open_, keys, order


def ready(shared) -> dict:
    """The broadcast model with its tables indexed, once in each worker."""
    m = shared.value
    if len(m["words"]) == 2:
        m |= {name: indexed(*m[name]) for name in ("words", "states")}
    return m


def asks(slices: DataFrame, shared, parts: int) -> DataFrame:
    """part, row, keys: what each slice of texts has to be told, a key once, in one packed row for each range of keys."""

    def ask(batches):
        m = ready(shared)
        for row, words, at, sizes in decoded(batches):
            keys = needed(m, words, at, sizes)[2]
            rows = [(part, steps(keys[span])) for part, span in spans(keys, parts)]
            if rows:
                part, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), row)), pa.array(packed, pa.binary())], ["part", "row", "keys"])

    return slices.select("row", "words", "places", "sizes").mapInArrow(ask, "part int, row long, keys binary")


def asked(slices: DataFrame, shared) -> DataFrame:
    """k, row: the keys of ``asks``, one in a row."""

    def run(batches):
        for batch in batches:
            for row, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys = unstepped(packed)
                keys = (keys >> np.uint64(2) | keys << np.uint64(62)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), row))], ["k", "row"])

    return asks(slices, shared, PARTS).mapInArrow(run, "k long, row long")


def dealt(counts: DataFrame, states: DataFrame, parts: int) -> DataFrame:
    """part, keys, values: the rows of both tables, those that a task holds of a range of keys in one packed row."""

    def run(batches):
        held, size = [], 0

        def rows():
            nonlocal held, size
            keys, *values = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = turned(keys)
            order = np.argsort(keys)
            keys, values = keys[order], np.stack([x[order] for x in values])
            held, size = [], 0
            found = [(part, steps(keys[span]), squeezed(values[:, span].ravel())) for part, span in spans(keys, parts)]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "keys", "values"])

        for batch in batches:
            if batch.num_rows:
                held.append([numbers(batch, n) for n in ("k", "n", "m", "seen")])
                size += batch.num_rows
            if size > HELD // 2:
                yield rows()
        if size:
            yield rows()
        release()

    return materialize(counts.unionByName(states).mapInArrow(run, "part int, keys binary, values binary"), "values")


def answers(left: pa.Table, right: pa.Table) -> pa.Table:
    """row, part, told: the values of the keys that slices ask for in a range of keys, zeros for those that have none."""
    rows = right.column("keys").to_pylist()
    k = np.concatenate([np.zeros(0, np.uint64), *map(unstepped, rows)])
    order = np.argsort(k)
    k = np.append(k[order], np.uint64(0))
    values = np.concatenate([np.zeros((3, 0), np.uint64), *(restored(x).reshape(3, -1) for x in right.column("values").to_pylist())], axis=1)
    values = np.append(values[:, order], np.zeros((3, 1), np.uint64), axis=1)

    def told(packed: bytes) -> bytes:
        keys = unstepped(packed)
        at = np.searchsorted(k[:-1], keys)
        return squeezed(np.where(k[at] == keys, values[:, at], np.uint64(0)).ravel())

    return pa.table([left.column("row"), left.column("part"), pa.array(map(told, left.column("keys").to_pylist()), pa.binary())], ["row", "part", "told"])


def score(slices: DataFrame, model: dict, values: DataFrame, parts: int) -> DataFrame:
    """doc_id, held, n_tokens, n_known, base_score, score of every text in ``slices`` (see ``coded``); ``values`` are ``dealt`` to ``parts``.

    What is not broadcast of the counts and states that a slice may need is asked for by key, once for each slice. What is
    asked meets the values in ranges of keys; a slice meets its answers in one group and scores its texts there. All of
    this moves as packed rows. The slices take turns."""
    shared = slices.sparkSession.sparkContext.broadcast(model)
    total, distinct, off, depth = model["N"], model["V"], model["off"], model["depth"]
    unseen = off * distinct / total if total else 1.0

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        held, doc_id = left.column("held")[0].as_py(), left.column("doc_id").combine_chunks().flatten()
        _, words, at, sizes = next(decoded(left.combine_chunks().to_batches()))
        v, open_, keys, order = needed(ready(shared), words, at, sizes)
        packed = right.column("told").to_pylist()
        packed = [packed[i] for i in np.argsort(right.column("part").to_numpy())]  # the keys are sorted, and so are their ranges
        n, m, seen = np.concatenate([np.zeros((3, 0), np.uint64), *(restored(x).reshape(3, -1) for x in packed)], axis=1).astype(np.float64)
        assert len(n) == len(keys)
        have = seen > 0
        answer = (n - DISCOUNT * m) / np.where(have, seen, 1.0)
        done = 0
        for kind, pos in open_:
            of = order[done : done + len(pos)]
            done += len(pos)
            x = answer[of]
            v[kind][pos[have[of]]] = (1 - x if kind % 2 else x)[have[of]]  # kinds: counts, then what is left and what is given of each level
        n = v[0]
        p = np.where(n > 0, (n - off) / max(total, 1), unseen)[at]
        for level in range(depth):
            p = v[2 * level + 1] * p + v[2 * level + 2]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda x: np.bincount(doc, x, len(sizes))
        known, base = sums((n > 0)[at]).astype(np.int64), sums(np.log10((n + 1) / (total + distinct + 1))[at])
        return pa.table([doc_id, pa.array(np.full(len(sizes), held)), pa.array(sizes), pa.array(known), pa.array(base), pa.array(sums(np.log10(p)))], ["doc_id", "held", "n_tokens", "n_known", "base_score", "score"])

    scores = []
    for turn in range(TURNS):
        mine = slices.where(F.pmod("row", F.lit(TURNS)) == turn)
        told = asks(mine, shared, parts).groupBy("part").cogroup(values.groupBy("part")).applyInArrow(answers, "row long, part int, told binary")
        whole = mine.groupBy("row").cogroup(told.groupBy("row")).applyInArrow(finish, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")
        scores.append(materialize(whole, "scores"))
    return functools.reduce(DataFrame.unionByName, scores)


def train_and_score(docs: DataFrame, fold: int = 7, held: int = 2, **settings) -> DataFrame:
    """Scores of all ``docs``, learnt from those whose crc32(doc_id) modulo ``fold`` is not ``held`` (a null doc_id is learnt from).

    Repeated rows count and are scored each; other columns are ignored. Without training text every word is unseen
    and the one symbol left has probability 1."""
    slices = coded(docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), fold) == held).alias("held")))
    model, counts, states = learn(slices.where("NOT held"), **settings)
    parts = max(PARTS, -(-slices.count() // SLICES))
    values = dealt(counts, states, parts)
    discard(counts, states)
    out = score(slices, model, values, parts)
    discard(slices, values)
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")
