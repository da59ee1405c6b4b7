"""Reads to sequence-by-sample counts, and filters on them.

The fact table is long: tally(marker, md5, seq, sample, abundance). Counts are sums with map-side combine throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import is_iupac, md5_key, reverse_complement


def dereplicate(reads: DataFrame, keys=("marker", "sample"), weight: str | None = "abundance") -> DataFrame:
    """Distinct sequences, upper-cased, with their counts by ``keys``; ``weight`` names a column of read counts."""
    seq = F.upper("seq")
    count = F.sum(weight) if weight else F.count(F.lit(1))
    return reads.groupBy(*keys, seq.alias("seq")).agg(count.cast("long").alias("abundance")).withColumn("md5", F.md5("seq"))


def pooled_nr(forward: DataFrame, reverse: DataFrame | None = None, min_abundance: int = 0, min_length: int = 0, max_length: int = 1 << 30) -> DataFrame:
    """Non-redundant sequences over all samples; ``reverse`` inputs are reverse-complemented first."""
    reads = forward.select("marker", "seq", "abundance")
    if reverse is not None:  # each distinct sequence is turned once
        turned = reverse.groupBy("marker", F.upper("seq").alias("seq")).agg(F.sum("abundance").alias("abundance"))
        reads = reads.unionByName(turned.select("marker", reverse_complement(F.col("seq")).alias("seq"), "abundance"))
    nr = dereplicate(reads.where(F.length("seq").between(min_length, max_length)), ("marker",))
    return nr.where(F.col("abundance") >= min_abundance)


def sample_stats(nr: DataFrame) -> DataFrame:
    """Accepted reads, unique sequences, singletons (before any filter) and the largest count per sample."""
    return nr.groupBy("marker", "sample").agg(
        F.sum("abundance").alias("accepted"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("abundance") == 1).alias("singletons"), F.max("abundance").alias("max_abundance")
    )


def with_totals(tally: DataFrame) -> DataFrame:
    """Each cell with its sequence's total over samples."""
    return tally.withColumn("total", F.sum("abundance").over(W.partitionBy("marker", "md5")))


def at_least(tally: DataFrame, minimum: int) -> DataFrame:
    return tally.where(F.col("abundance") >= minimum)


def without_ultra_low(tally: DataFrame, min_abundance: int) -> DataFrame:
    """Drops cells below half the threshold, which can neither be accepted nor raise a pool's threshold."""
    return tally.where(F.col("abundance") >= F.ceil(F.lit(0.5) * min_abundance))


def by_sample_threshold(tally: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells that reach their own sample's threshold (sample, threshold), by marker where the thresholds have one."""
    keys = ["marker", "sample"] if "marker" in thresholds.columns else ["sample"]
    return tally.join(thresholds.select(*keys, "threshold"), keys).where(F.col("abundance") >= F.col("threshold")).drop("threshold")


def by_total(tally: DataFrame, minimum: int) -> DataFrame:
    """Sequences whose total, after earlier filters, reaches a minimum."""
    return with_totals(tally).where(F.col("total") >= minimum).drop("total")


def by_length(tally: DataFrame, low: int, high: int) -> DataFrame:
    return tally.where(F.length("seq").between(low, high))


def valid_sequences(seqs: DataFrame) -> DataFrame:
    return seqs.where(is_iupac(F.col("seq")))


def corrected(tally: DataFrame, corrections: DataFrame) -> DataFrame:
    """Counts moved to centroids; sequences without a correction are dropped. corrections: (marker, seq, centroid)."""
    moved = tally.join(corrections, ["marker", "seq"]).groupBy("marker", "sample", F.col("centroid").alias("seq")).agg(F.sum("abundance").alias("abundance"))
    return moved.withColumn("md5", F.md5("seq"))


def sequence_stats(tally: DataFrame) -> DataFrame:
    """Total, largest count and number of samples per sequence."""
    return tally.groupBy("marker", "md5").agg(F.sum("abundance").alias("total"), F.max("abundance").alias("max_abundance"), F.countDistinct("sample").alias("n_samples"))


def wide(tally: DataFrame, columns: list[str], key: str = "sample") -> DataFrame:
    """One column per named value of ``key``; absent cells are 0."""
    return tally.groupBy("marker", "md5").pivot(key, columns).agg(F.sum("abundance")).na.fill(0, columns)


def long(table: DataFrame, samples: list[str]) -> DataFrame:
    """The inverse of wide(): nonzero cells only."""
    return table.unpivot(["marker", "md5"], samples, "sample", "abundance").where(F.col("abundance") > 0)


def titles_by_sequence(fasta: DataFrame, sep: str = ";") -> DataFrame:
    """Distinct titles of each sequence, sorted and joined; titles are cut at ``sep`` first."""
    parts = fasta.select("seq", F.explode(F.split("title", sep)).alias("title"))
    return parts.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set(F.trim("title"))), sep).alias("titles"))


def first_names(titles: DataFrame) -> DataFrame:
    """seq, name: of titles(seq, ordinal, name) the first seen name of each sequence."""
    return titles.groupBy(F.upper("seq").alias("seq")).agg(F.min_by("name", F.struct("ordinal", "name")).alias("name"))


def add_md5(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("md5", md5_key(F.col("seq")))
