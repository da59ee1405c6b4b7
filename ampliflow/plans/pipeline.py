"""Whole analyses: the chain from reads to reports, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assess, classify, denoise, reports, tally, thresholds


@dataclass
class Settings:
    min_abundance: int = 100
    min_fraction: float = 0.001
    total_min: int = 0
    method: str = "onebp"
    denoise: bool = False
    alpha: float = 2.0
    gamma: int = 4
    lengths: tuple[int, int] = (0, 1 << 30)
    genera: list[str] = field(default_factory=list)


def sample_tally(nr: DataFrame, samples: DataFrame, spikes: DataFrame | None, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(tally, sample thresholds): counts, noise correction, controls' thresholds, filters, in this order."""
    cells = tally.by_length(nr, *s.lengths)
    if s.denoise:
        cells = tally.corrected(cells, denoise.unoise_by_marker(cells, alpha=s.alpha, gamma=s.gamma))
    cells = tally.without_ultra_low(cells, s.min_abundance) if s.min_abundance > 2 else cells
    seqs = cells.select("md5", "seq").distinct()
    marked = thresholds.spike_matches(seqs, spikes) if spikes is not None else seqs.limit(0).select("md5")
    limits = thresholds.sample_thresholds(samples, thresholds.max_abundances(cells, marked), s.min_abundance, s.min_fraction)
    cells = tally.by_sample_threshold(cells, limits)
    return (tally.by_total(cells, s.total_min) if s.total_min else cells), limits


def run(reads: DataFrame, samples: DataFrame, refs: DataFrame, spikes: DataFrame | None = None, known: DataFrame | None = None, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Every report of an analysis: tally, thresholds, classified, samples, reads, and assessment where truth is given."""
    s = settings or Settings()
    nr = tally.dereplicate(reads)
    cells, limits = sample_tally(nr, samples, spikes, s)
    # all reports read these two, cells and the names of their sequences, so they are computed once
    cells = cells.persist()
    found = classify.found(cells, refs, s.method)
    classified = classify.with_names(cells, found)
    out = {"tally": cells, "thresholds": limits, "classified": classified, "samples": reports.sample_report(classified, reports.merged_limits(limits)), "reads": reports.read_report(cells, found=found)}
    if known is not None:
        pairs = assess.paired(assess.species_sets(known), assess.predicted_sets(assess.expected_only(cells, known), found))
        confusion = assess.confusion_tally(pairs)
        database = refs.where(F.col("species") != "").select(F.concat_ws(" ", "genus", "species").alias("species")).distinct()
        out["assessment"] = assess.assessment(assess.binary_counts(confusion, assess.species_classes(confusion, database)))
        out["confusion"] = assess.confusion_cells(confusion)
    return out
