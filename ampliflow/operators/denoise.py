"""UNOISE noise correction, exact, by rounds of joins instead of one sequential pass.

A sequence can only be absorbed by one at least 2**(alpha + 1) times as abundant, so whether it is a centroid depends on
more abundant sequences alone. Each round settles the sequences whose possible centroids are all settled; abundance
grows by that factor along any chain, so there are few rounds however many sequences.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distance import near_pairs

MAX_DISTANCE = 10


def unoise(counts: DataFrame, alpha: float = 2.0, gamma: int = 4, abundance_based: bool = False) -> DataFrame:
    """seq, centroid for counts(seq, abundance); sequences below gamma have none.

    Distance-based (default): the nearest centroid, of equals the least abundant, then the first by sequence.
    Abundance-based: the most abundant that qualifies, then the first by sequence.
    """
    seqs = counts.where(F.col("abundance") >= gamma).groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    spark = counts.sparkSession
    bounds = seqs.agg(F.max("abundance"), F.min("abundance")).first()
    if bounds[0] is None:
        return seqs.select("seq", F.col("seq").alias("centroid"))
    top, least = bounds
    reach = _cutoff(top, least, alpha)
    if reach < 1:
        return seqs.select("seq", F.col("seq").alias("centroid"))
    pairs = near_pairs(seqs.select(F.col("seq").alias("l"), F.col("seq").alias("l_seq")), seqs.select(F.col("seq").alias("r"), F.col("seq").alias("r_seq")), reach)
    a, c = F.col("a.abundance"), F.col("c.abundance")
    pairs = pairs.where("l <> r").join(seqs.alias("a"), F.col("l") == F.col("a.seq")).join(seqs.alias("c"), F.col("r") == F.col("c.seq"))
    allowed = F.least(F.when(a * 2 < top, F.floor((F.log2(F.lit(float(top)) / a) - 1) / alpha)).otherwise(0), F.lit(MAX_DISTANCE))
    ok = (F.col("dist") <= allowed) & (c >= a * F.lit(2.0 ** (alpha + 1))) & (a * F.pow(F.lit(2.0), F.lit(alpha) * F.col("dist") + 1) <= c)
    pairs = kept(spark, pairs.where(ok).select(F.col("l").alias("seq"), F.col("r").alias("choice"), "dist", c.alias("n")))
    state = kept(spark, seqs.select("seq").join(pairs.select("seq").distinct(), "seq", "left_anti").select("seq", F.lit(True).alias("is_centroid")))
    total = seqs.count()
    while state.count() < total:
        seen = pairs.join(state.select(F.col("seq").alias("choice"), "is_centroid"), "choice", "left")
        votes = seen.groupBy("seq").agg(F.bool_or(F.coalesce("is_centroid", F.lit(False))).alias("_taken"), F.bool_and(F.col("is_centroid").isNotNull()).alias("_settled"))
        new = votes.where(F.col("_settled")).join(state, "seq", "left_anti").select("seq", (~F.col("_taken")).alias("is_centroid"))
        state = kept(spark, state.unionByName(new))
    best = F.struct("dist", "n", "choice") if not abundance_based else F.struct((-F.col("n")).alias("n"), F.col("choice").alias("c"))
    chosen = pairs.join(state.where("is_centroid").select(F.col("seq").alias("choice")), "choice").groupBy("seq").agg(F.min_by("choice", best).alias("centroid"))
    return state.join(chosen, "seq", "left").select("seq", F.when(F.col("is_centroid"), F.col("seq")).otherwise(F.col("centroid")).alias("centroid"))


def _cutoff(top: int, a: int, alpha: float) -> int:
    return min(math.floor((math.log2(top / a) - 1) / alpha) if a * 2 < top else 0, MAX_DISTANCE)


def kept(spark, df: DataFrame) -> DataFrame:
    """Cuts the lineage: a checkpoint in the session's shared folder, or a cache where there is none."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.cache()


def unoise_by_marker(tally: DataFrame, **options) -> DataFrame:
    """marker, seq, centroid over the totals of each marker in tally(marker, seq, abundance)."""
    totals = tally.groupBy("marker", "seq").agg(F.sum("abundance").alias("abundance"))
    markers = [r[0] for r in totals.select("marker").distinct().orderBy("marker").collect()]  # a handful of primer pairs
    out = None
    for m in markers:
        part = unoise(totals.where(F.col("marker") == m), **options).withColumn("marker", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else totals.select("marker", "seq", F.col("seq").alias("centroid"))


def parse_clusters(rows: DataFrame) -> DataFrame:
    """seq_id, centroid_id from cluster table rows of external tools: 'S' starts a cluster, 'H' is a hit on one."""
    f = F.split("value", "\t")
    return rows.select(F.get(f, F.lit(0)).alias("kind"), F.get(f, F.lit(8)).alias("seq_id"), F.get(f, F.lit(9)).alias("hit")).where(F.col("kind").isin("S", "H")).select("seq_id", F.when(F.col("kind") == "S", F.col("seq_id")).otherwise(F.col("hit")).alias("centroid_id"))
