"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule, piecewise linear over training time 0..1. Its integral, scaled to
the source's target, is the cumulative token demand; a document's place in its source's supply
(copies included) is put through the inverse of that demand and becomes its training position.
Documents are finally range-sorted by position.

Skew: sizes are summed with map-side combine; a source's supply order is cut into buckets whose number
follows the source's document count, so running sums need one window over bucket totals and one inside
each bucket, never one over a whole source. Targets reach the rows by lookup(): broadcast, or salted beyond a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lookup, table, written

BASE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BUCKET_DOCS = 4096
#: (relative weight at the start, in the middle, at the end), repeating with the source's rank.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 2.0), (2.0, 1.0, 0.5))
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def ranked(per: DataFrame) -> DataFrame:
    """``per`` (one row per source) with rank: its place from 0 by code points, null last.

    Range partitions are numbered inside and shifted by the rows before them, so no task holds all sources.
    """
    order = F.col("source").asc_nulls_last()
    rows = written(per.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_at", 33)
    # one row per partition of the shuffle
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    rank = F.col("_shift") + F.col("_at") - F.shiftleft("_part", 33)
    return rows.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn("rank", rank.cast("int")).drop("_at", "_part", "_shift")


def source_targets(sized: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: rank, weight, source_size, docs, target.

    Water filling: the level (words per weight) rises until the sources that reach their cap stay the same; each
    round is one sum over the sources, and only sums come to the driver.
    """
    per = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    weights = F.array(*[F.lit(float(x)) for x in BASE_WEIGHTS])
    per = per.withColumn("weight", F.get(weights, F.col("rank") % len(BASE_WEIGHTS))).withColumn("cap", F.lit(cap) * F.col("source_size"))
    per = written(per, "mix-ranks")
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") >= F.col("cap") if before >= 0 else F.lit(False)
        full, used, weight = per.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if full == before or not weight:
            break
        before, level = full, (total - (used or 0.0)) / weight
    target = F.when(F.lit(level) * F.col("weight") >= F.col("cap"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return per.select("source", "rank", "weight", "source_size", "docs", target.alias("target"))


def _inverse_demand(share: Column, rank: Column) -> Column:
    """Training time at which a source has been asked for this share (0..1) of its target.

    The schedule is linear from a to b over 0..1/2 and from b to c over 1/2..1; its integral is a
    quadratic on each half, inverted in closed form.
    """
    pick = lambda k: F.get(F.array(*[F.lit(s[k]) for s in SCHEDULES]), rank % len(SCHEDULES))
    a, b, c = pick(0), pick(1), pick(2)
    first, second = (a + b) / 4, (b + c) / 4
    need = share * (first + second)

    def solve(lo: Column, hi: Column, area: Column) -> Column:
        # lo*t + (hi-lo)*t^2 = area for t in 0..1/2, in the form that is stable for hi == lo
        return 2 * area / (lo + F.sqrt(F.greatest(lo * lo + 4 * (hi - lo) * area, F.lit(0.0))))

    early = need <= first
    return F.when(early, solve(a, b, need)).otherwise(0.5 + solve(b, c, need - first))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, ordered: bool = True, texts: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position, positions, source; range-sorted by position.

    A source's documents are laid in a fixed pseudo-random order; the supply is that order repeated, and
    the mix takes its first floor(target) words: every document whole ``copies`` times, and once more, in
    part for the one on the edge, where the last round ends. ``positions`` are the training times of the
    middles of all taken stretches, in order: one for each whole copy and one for the part on the edge; empty
    where nothing is taken. ``position`` is the first of them or null. With ``texts``, the column text comes along.

    Null text: size 0. Null source: a source of its own, last. Null doc_id and repeated rows are kept, each
    row on its own; rows equal in every field may swap their share. No rows in: no rows out. Other columns
    of ``docs`` are ignored.
    """
    size = word_count(F.col("text")).alias("size")
    sized = written(docs.select("doc_id", "source", size), "mix-sizes")
    targets = source_targets(sized, share, cap)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    same_source = [F.coalesce(F.col("source"), F.lit("")).alias("_s"), F.col("source").isNull().alias("_n")]
    targets = written(targets.select("source", "rank", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_DOCS)).alias("_nb"), *same_source), "mix-targets")
    # the key's first 7 hex digits spread evenly over the buckets and keep the key's order
    bucket = F.floor(F.conv(F.substring("_key", 1, 7), 16, 10).cast("double") * F.col("_nb") / F.lit(float(16**7))).cast("long")
    sums = lookup(sized.select("size", key.alias("_key"), *same_source), targets.select("_s", "_n", "_nb"), ["_s", "_n"], "_key").withColumn("_bucket", bucket)
    carried = ["text"] if texts else []
    plain = docs.select("doc_id", "source", size, *carried) if texts else sized
    rows = lookup(plain.select("doc_id", "size", key.alias("_key"), *same_source, *carried), targets, ["_s", "_n"], "_key").withColumn("_bucket", bucket)
    sums = sums.groupBy("_s", "_n", "_bucket").agg(F.sum("size").alias("_in_bucket"))
    before = W.partitionBy("_s", "_n").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))).drop("_in_bucket")
    inside = W.partitionBy("_s", "_n", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.join(sums, ["_s", "_n", "_bucket"]).withColumn("_end", F.col("_before") + F.sum("size").over(inside))
    demand = F.floor(F.col("target")).cast("long")
    copies = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("_rest", F.when(F.col("source_size") > 0, demand - copies * F.col("source_size")).otherwise(F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - (F.col("_end") - F.col("size"))))
    rows = rows.withColumn("taken", (F.col("copies") * F.col("size") + extra).cast("long"))
    start = F.col("_end") - F.col("size")

    def placed(copy: Column) -> Column:
        stretch = F.when(copy < F.col("copies"), F.col("size")).otherwise(extra)
        middle = (copy * F.col("source_size") + start + stretch / 2) / F.col("target")
        return _inverse_demand(F.least(middle, F.lit(1.0)), F.col("rank"))

    rounds = F.col("copies") + F.when(extra > 0, 1).otherwise(0)
    each = F.transform(F.sequence(F.lit(0).cast("long"), rounds - 1), placed)
    rows = rows.withColumn("positions", F.when(F.col("taken") > 0, each).otherwise(F.array().cast("array<double>")))
    rows = rows.withColumn("position", F.get("positions", F.lit(0)))
    out = rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "positions", "source", *carried)
    return out.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id")) if ordered else out


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sized GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(rnk % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
lev AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    sum(weight) OVER () - sum(weight) OVER o + weight AS weight_here, sum(cap) OVER o - cap AS capped_before
  FROM w WINDOW o AS (ORDER BY cap / weight, rnk ROWS UNBOUNDED PRECEDING)),
l2 AS (SELECT *, (total - capped_before) / weight_here AS level FROM lev),
op AS (SELECT cap / weight AS r, rnk AS k, level AS open_level FROM l2 WHERE NOT (level * weight >= cap) ORDER BY 1, 2 LIMIT 1),
t AS (
  SELECT source, source_size, rnk,
    CASE WHEN open_level IS NOT NULL AND (cap / weight > r OR (cap / weight = r AND rnk >= k)) THEN open_level * weight ELSE cap END AS target
  FROM l2 LEFT JOIN op ON true),
d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS demand,
    [1.0::DOUBLE, 0.5, 2.0][(rnk % 3 + 1)::INT] AS a, 1.0::DOUBLE AS b, [1.0::DOUBLE, 2.0, 0.5][(rnk % 3 + 1)::INT] AS c,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, 'null')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS copies,
    CASE WHEN source_size > 0 THEN greatest(0, least(size, demand % source_size - (e - size))) ELSE 0 END AS extra
  FROM d),
y AS (SELECT *, copies * size + extra AS taken, (CASE WHEN copies > 0 THEN size ELSE extra END)::DOUBLE AS stretch FROM x),
z AS (
  SELECT *, CASE WHEN taken > 0 THEN least(((e - size)::DOUBLE + stretch / 2.0::DOUBLE) / target, 1.0::DOUBLE) END * ((a + b) / 4.0::DOUBLE + (b + c) / 4.0::DOUBLE) AS need,
    (a + b) / 4.0::DOUBLE AS early FROM y)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, copies::BIGINT AS copies,
  CASE WHEN need <= early THEN 2.0::DOUBLE * need / (a + sqrt(greatest(a * a + 4.0::DOUBLE * (b - a) * need, 0.0::DOUBLE)))
    ELSE 0.5::DOUBLE + 2.0::DOUBLE * (need - early) / (b + sqrt(greatest(b * b + 4.0::DOUBLE * (c - b) * (need - early), 0.0::DOUBLE))) END AS position
FROM z
"""
