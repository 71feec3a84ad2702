"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size says how many copies of each document the mix wants. The whole copies are certain. For the
rest a document has inclusion odds, and is ranked by its random odds divided by them; the mix takes documents
in that order until the source's target is met, so the sample has a fixed size in words.

The order is never sorted as a whole: ranks fall into buckets, bucket sums tell where the target ends, and only the
one bucket of each source in which it ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Copies of a document at most.
MOST = 3
#: Buckets of the order in each source.
BUCKETS = 4096
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inclusion(size: Column) -> Column:
    """Inclusion weight of a document: sixteen times the root of its words, whole, so that sums do not depend on their order."""
    return F.greatest(F.floor(16 * F.sqrt(size)).cast("long"), F.lit(1).cast("long"))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target: all sizes shared by the weights 1, 2, 3, 1, ... of the sources in code-point order (null last).

    A target stops at ``most`` times its source's size and the excess is shared anew, which ends at
    min(most * size, level * weight) for one level."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sums.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighed.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(rest))
    open_ = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = level.withColumn("water", F.max(open_).over(everything))
    return level.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that the key and the seed alone decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def with_order(sized: DataFrame, shares: DataFrame, seed: str, weight: str | None) -> DataFrame:
    """Adds source_size, target, whole (certain copies), need (words still open) and v, the place in the order from 0 to 1."""
    out = sized.join(shares, sized["source"].eqNullSafe(shares["src"]), "left")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("whole", F.floor(ratio).cast("long")).withColumn("part", ratio - F.floor(ratio))
    out = out.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    odds = F.col("part") if weight is None else F.least(F.lit(1.0), F.col("part") * (F.col(weight) / F.col("mean_weight")))
    u = uniform(F.col("doc_id"), seed)
    place = (u / (1 - u)) / (odds / (1 - odds))
    return out.withColumn("v", F.when(odds <= 0, 1.0).when(odds >= 1, 0.0).otherwise(place / (1 + place)))


def mix(docs: DataFrame, most: int = MOST, seed: str = SEED, weight: str | None = None, buckets: int = BUCKETS, stats: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with source_size, target and copies (0 to ``most``).

    ``weight`` names a column of relative inclusion weights (none: all alike), whole numbers if reruns must agree to the last
    bit: a document's inclusion odds are the part of a copy that its source wants, times its weight over the mean weight of a
    word. A null source is a source of its own;
    a null or empty text has size 0 and costs nothing; repeated rows are separate documents that are taken or left
    alike but at a target's end; columns named as the added ones are replaced; an empty table gives none. ``stats``: the same doc_id, source, size and weight, if they
    are already written down."""
    keep = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    narrow = ["doc_id", "source", "size"] + ([weight] if weight else [])
    stats = stats if stats is not None else materialize(docs.select(*narrow), "sizes")
    shares = materialize(targets(stats, most).withColumnRenamed("source", "src"), "targets")
    if weight:
        means = stats.groupBy(F.col("source").alias("s")).agg(F.coalesce(F.try_divide(F.sum(F.col(weight) * F.col("size")), F.sum("size")), F.lit(1.0)).alias("mean_weight"))
        shares = shares.join(means, F.col("src").eqNullSafe(F.col("s"))).drop("s")
    n = shares.count()
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_SOURCES else (lambda df: df)
    bucket = F.least(F.floor(F.col("v") * buckets), F.lit(buckets - 1)).cast("int").alias("b")
    sums = with_order(stats, small(shares), seed, weight).where("part > 0").groupBy("src", bucket).agg(F.sum("size").alias("words"), F.max("need").alias("need"))
    upto = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("cum", F.sum("words").over(upto)).where("cum > need")
    ends = over.groupBy(F.col("src").alias("end_src")).agg(F.min(F.struct("b", (F.col("cum") - F.col("words")).alias("before"))).alias("end"))
    ends = materialize(ends.select("end_src", F.col("end.b").alias("end_b"), F.col("end.before").alias("end_before")), "ends")
    whole_rows = docs.select(*narrow, F.struct(*keep).alias("row"))  # no name of theirs meets one of ours
    placed = with_order(whole_rows, small(shares), seed, weight).withColumn("b", bucket)
    placed = placed.join(small(ends), placed["src"].eqNullSafe(ends["end_src"]), "left")
    last = F.coalesce(F.col("b") == F.col("end_b"), F.lit(False))
    clear = placed.where(~last).withColumn("more", F.coalesce(F.col("b") < F.col("end_b"), F.lit(True)))
    inside = Window.partitionBy("source").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.col("end_before") + F.sum("size").over(inside) - F.col("size")
    edge = placed.where(last).withColumn("more", cum + F.col("size") / 2 <= F.col("need"))
    out = clear.unionByName(edge)
    return out.select("row.*", "source_size", "target", (F.col("whole") + F.when(F.col("more") & (F.col("part") > 0), 1).otherwise(0)).alias("copies"))


#: The same in DuckDB, with one sorted window a source instead of buckets.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
means AS (SELECT source AS mean_source, CASE WHEN sum(size) > 0 THEN CAST(sum(weight * size) AS DOUBLE) / CAST(sum(size) AS DOUBLE) ELSE 1.0 END AS mean_weight
  FROM (SELECT *, greatest(CAST(floor(16 * sqrt(size)) AS BIGINT), 1) AS weight FROM sized) GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, source_size * {MOST} AS cap FROM sums),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
water AS (SELECT max(level) AS water FROM levels WHERE level <= cap / weight),
shares AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(water, 0.0) * weight) AS target FROM levels, water),
ordered AS (
  SELECT d.doc_id, d.size, s.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
    CAST(greatest(CAST(floor(16 * sqrt(d.size)) AS BIGINT), 1) AS DOUBLE) / mean_weight AS lead,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(1 << 52)} AS u
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source JOIN means m ON d.source IS NOT DISTINCT FROM m.mean_source),
odded AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS part, target - floor(ratio) * source_size AS need, least(1.0, (ratio - floor(ratio)) * lead) AS odds FROM ordered),
placed AS (
  SELECT *, CASE WHEN odds <= 0 THEN 1.0 WHEN odds >= 1 THEN 0.0 ELSE (u / (1 - u)) / (odds / (1 - odds)) / (1 + (u / (1 - u)) / (odds / (1 - odds))) END AS v FROM odded),
cums AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS cum FROM placed)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN part > 0 AND cum + size / 2 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cums
"""
