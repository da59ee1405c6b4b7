"""Sample preparation: read pairs to accepted non-redundant sequences per marker and sample, with their statistics.

trimmed(marker, sample, seq, abundance) are dereplicated reads between a marker's primers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reads, tally, thresholds


def sample_totals(trimmed: DataFrame, min_abundance: int, min_fraction: float = 0.0) -> DataFrame:
    """marker, sample, primer_matched, threshold: the larger of the absolute one and the fraction of primer-matched reads."""
    totals = trimmed.groupBy("marker", "sample").agg(F.sum("abundance").cast("long").alias("primer_matched"))
    return thresholds.fractional_threshold(totals, min_abundance, min_fraction)


def accepted(trimmed: DataFrame, min_abundance: int, min_fraction: float = 0.0) -> DataFrame:
    """The sequences that reach their marker's and sample's threshold, with md5."""
    return tally.by_sample_threshold(tally.dereplicate(trimmed), sample_totals(trimmed, min_abundance, min_fraction))


def statistics(trimmed: DataFrame, min_abundance: int, min_fraction: float = 0.0) -> DataFrame:
    """primer_matched, threshold, singletons, accepted and n_unique per marker and sample, also of those without accepted reads."""
    nr = tally.dereplicate(trimmed).join(sample_totals(trimmed, min_abundance, min_fraction), ["marker", "sample"])
    kept = F.col("abundance") >= F.col("threshold")
    return nr.groupBy("marker", "sample", "primer_matched", "threshold").agg(
        F.count_if(F.col("abundance") == 1).alias("singletons"), F.coalesce(F.sum(F.when(kept, F.col("abundance"))), F.lit(0)).cast("long").alias("accepted"), F.count_if(kept).alias("n_unique")
    )


def spike_sequences(refs: DataFrame, genera: list[str]) -> DataFrame:
    """marker, spike, spike_order, spike_seq: the reference sequences of some genera, whatever the case of their names.

    Those of a marker are tried in order of their sequences. A sequence with several accessions has its first one.
    """
    wanted = sorted({g.strip().lower() for g in genera if g.strip()})
    found = refs.where(F.lower("genus").isin(*wanted))
    return found.groupBy("marker", F.upper("seq").alias("spike_seq")).agg(F.min("accession").alias("spike")).select("marker", "spike", F.col("spike_seq").alias("spike_order"), "spike_seq")


def prepared(pairs: DataFrame, markers: list[tuple[str, str, str, int, int]], min_abundance: int = 100, min_fraction: float = 0.0, flip: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted sequences, statistics) of read pairs (sample, f_seq, f_qual, r_seq, r_qual): merged, trimmed, counted, filtered.

    ``markers`` are as for reads.trim_primers. Raw and merged reads are counted before trimming and are those of the whole
    sample; a sample of which nothing merges has statistics with a null marker and nothing accepted.
    """
    raw = pairs.groupBy("sample").agg(F.count(F.lit(1)).alias("raw"))
    merged = reads.merge_pairs(pairs).groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("abundance"))
    trimmed = reads.trim_primers(merged, markers, flip=flip)
    counts = merged.groupBy("sample").agg(F.sum("abundance").cast("long").alias("merged"))
    stats = raw.join(counts, "sample", "left").join(statistics(trimmed, min_abundance, min_fraction), "sample", "left")
    return accepted(trimmed, min_abundance, min_fraction), stats.na.fill(0, ["merged", "primer_matched", "singletons", "accepted", "n_unique"])
