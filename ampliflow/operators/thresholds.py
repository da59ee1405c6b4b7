"""Abundance thresholds of samples, raised per pool by what negative and synthetic controls show.

samples(sample, pool, is_negative, is_synthetic, primer_matched, threshold): the last is the file's own threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import K, kmers
from .joins import counted

FATAL_FRACTION = 0.5


def spike_matches(seqs: DataFrame, spikes: DataFrame, k: int = K) -> DataFrame:
    """md5, spike: each sequence's first spike-in (by spike_order) that equals it or shares enough k-mer positions.

    Enough is the larger of 10 and a third of the spike's k-mer count. k-mers are joined, not compared pairwise.
    """
    grams = spikes.select("spike", "spike_order", F.col("spike_seq"), F.explode(F.array_distinct(kmers(F.col("spike_seq"), k))).alias("kmer"))
    places = seqs.select("md5", F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    enough = F.greatest((F.length("spike_seq") - k) / 3, F.lit(10.0))
    shared = counted(places, grams, "kmer").groupBy("md5", "spike", "spike_order", "spike_seq").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
    same = counted(seqs.withColumn("_up", F.upper("seq")), spikes.withColumn("_up", F.upper("spike_seq")), "_up").select("md5", "spike", "spike_order")
    found = shared.select("md5", "spike", "spike_order").unionByName(same)
    return found.groupBy("md5").agg(F.min_by("spike", F.struct("spike_order", "spike")).alias("spike"))


def control_label(negative, synthetic):
    return F.when(negative & synthetic, "Neg/Synth").when(negative, "Negative").when(synthetic, "Synthetic").otherwise("Sample")


def max_abundances(tally: DataFrame, spike_md5: DataFrame) -> DataFrame:
    """Largest spike-in and other count per marker (where the tally has one) and sample."""
    marked = tally.join(spike_md5.select("md5", F.lit(True).alias("_spike")), "md5", "left")
    of = lambda cond: F.coalesce(F.max(F.when(cond, F.col("abundance"))), F.lit(0)).cast("long")
    by = ["marker"] if "marker" in tally.columns else []
    return marked.groupBy(*by, "sample").agg(of(F.col("_spike").isNotNull()).alias("max_spike_in"), of(F.col("_spike").isNull()).alias("max_non_spike"))


def sample_thresholds(samples: DataFrame, maxima: DataFrame, min_abundance: int, min_fraction: float, check: bool = True) -> DataFrame:
    """sample, pool, control, threshold, max_non_spike, max_spike_in, the latter two 0 where below the threshold, and marker where
    ``maxima`` has one: pools are then kept apart by marker, and a sample without reads has a null marker.

    A control's own threshold is halved in the respect it is a control for. A negative control above it raises its
    pool's absolute threshold to its largest non-spike count; a synthetic one raises the pool's fraction. Other samples
    get the pool's. A fraction above one half fails the query.
    """
    by = ["marker"] if "marker" in maxima.columns else []
    s = samples.join(maxima, [*by, "sample"] if "marker" in samples.columns and by else "sample", "left").na.fill(0, ["max_spike_in", "max_non_spike"])
    control = F.col("is_negative") | F.col("is_synthetic")
    own = F.greatest(
        F.col("threshold"),
        F.when(F.col("is_synthetic"), F.ceil(F.lit(min_abundance) * F.lit(0.5))).otherwise(F.lit(min_abundance)),
        F.ceil(F.col("primer_matched") * F.lit(min_fraction) * F.when(F.col("is_negative"), 0.5).otherwise(1.0)),
    ).cast("long")
    s = s.withColumn("_own", own)
    a = F.col("max_non_spike")
    above = control & (a >= F.col("_own"))
    fraction = F.when(F.col("is_synthetic") & above & (F.lit(min_fraction) * F.col("primer_matched") < a), a / F.col("primer_matched"))
    if check:
        fraction = F.when(fraction > FATAL_FRACTION, F.raise_error(F.concat(F.lit("control suggests too high a fraction: "), F.col("sample"))).cast("double")).otherwise(fraction)
    pools = s.groupBy(*by, "pool").agg(
        F.max(F.when(F.col("is_negative") & above & (a > min_abundance), a)).alias("_absolute"),
        F.max(fraction).alias("_fraction"),
    )
    s = s.join(pools, [*by, "pool"], "left")
    pooled = F.greatest(F.col("threshold"), F.greatest(F.coalesce("_absolute", F.lit(min_abundance)), F.lit(min_abundance)), F.ceil(F.col("primer_matched") * F.greatest(F.coalesce("_fraction", F.lit(min_fraction)), F.lit(min_fraction)))).cast("long")
    s = s.withColumn("threshold", F.when(control, F.col("_own")).otherwise(pooled))
    capped = lambda c: F.when(F.col(c) < F.col("threshold"), 0).otherwise(F.col(c)).cast("long").alias(c)
    return s.select(*by, "sample", "pool", control_label(F.col("is_negative"), F.col("is_synthetic")).alias("control"), "threshold", capped("max_non_spike"), capped("max_spike_in"))


def fractional_threshold(totals: DataFrame, min_abundance: int, min_fraction: float) -> DataFrame:
    """A sample's threshold from its primer-matched reads alone."""
    return totals.withColumn("threshold", F.greatest(F.lit(min_abundance), F.ceil(F.lit(min_fraction) * F.col("primer_matched"))).cast("long"))
