"""Edit-distance joins by blocks: exact, and without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """l, r, dist: all pairs of left(l, l_seq) and right(r, r_seq) within k edits.

    A left sequence is cut into k + 1 blocks. k edits leave one block untouched, and it lies in the right sequence at
    its own place shifted by at most k, so an equi-join on (left length, block number, block text) finds every pair;
    a thresholded distance then decides. Sequences may be of any length; null ones match nothing.
    """
    n = F.length("l_seq")
    at = lambda i, size: F.floor(i * size / F.lit(k + 1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("i"), F.substring("l_seq", at(i, n) + 1, at(i + 1, n) - at(i, n)).alias("block")))
    cut = left.where(F.col("l_seq").isNotNull()).select("l", "l_seq", n.alias("size"), F.explode(blocks).alias("b")).select("l", "l_seq", "size", "b.*")
    m = F.length("r_seq")
    shifts = F.sequence(F.lit(-k), F.lit(k))
    sizes = F.filter(F.transform(shifts, lambda d: m + d), lambda s: s >= 0)

    def probes(size):
        return F.flatten(
            F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.transform(F.filter(shifts, lambda s: (at(i, size) + s >= 0) & (at(i + 1, size) + s <= m)), lambda s: F.struct(size.alias("size"), i.alias("i"), F.substring("r_seq", at(i, size) + s + 1, at(i + 1, size) - at(i, size)).alias("block"))))
        )

    probed = right.where(F.col("r_seq").isNotNull()).select("r", "r_seq", F.explode(F.array_distinct(F.flatten(F.transform(sizes, probes)))).alias("p")).select("r", "r_seq", "p.*")
    pairs = cut.join(probed, ["size", "i", "block"]).select("l", "l_seq", "r", "r_seq").distinct()
    return pairs.withColumn("dist", F.levenshtein("l_seq", "r_seq", k)).where(F.col("dist") >= 0).select("l", "r", "dist")


def all_distances(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r, dist without a bound; the result has as many rows as pairs, which is what a distance matrix is."""
    return left.join(right, F.length("l_seq") >= 0).select("l", "r", F.levenshtein("l_seq", "r_seq").alias("dist"))


def self_pairs(seqs: DataFrame, k: int) -> DataFrame:
    """a < b, dist: pairs of seqs(md5, seq) within k edits."""
    left = seqs.select(F.col("md5").alias("l"), F.col("seq").alias("l_seq"))
    right = seqs.select(F.col("md5").alias("r"), F.col("seq").alias("r_seq"))
    return near_pairs(left, right, k).where("l < r").select(F.col("l").alias("a"), F.col("r").alias("b"), "dist")
