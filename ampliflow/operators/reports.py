"""Sample and sequence reports over classified tallies: classified(marker, md5, seq, sample, abundance, names).

Where a report takes ``found`` (marker, md5, names; one row per sequence), classified needs no names: cells are summed first, and the
names, which may be long texts of a hundred species, are joined to the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import species_display, species_order
from .joins import counted

#: Species of a set in one word.
WORD = 63


def abundance_by_species(classified: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Reads per sample and species combination, over all markers."""
    if found is None:
        return classified.groupBy("sample", "names").agg(F.sum("abundance").cast("long").alias("abundance"))
    key = F.md5("names").alias("_key")
    cells = counted(classified, found.select("marker", "md5", key), ["marker", "md5"], "left")
    sums = cells.groupBy("sample", "_key").agg(F.sum("abundance").cast("long").alias("abundance"))
    return counted(sums, found.select(key, "names").distinct(), "_key", "left").select("sample", "names", "abundance")


def accepted_unique(tally: DataFrame, minimum: int = 1) -> DataFrame:
    """Accepted reads and unique sequences per sample, of cells that reach a minimum."""
    return tally.where(F.col("abundance") >= minimum).groupBy("sample").agg(F.sum("abundance").cast("long").alias("accepted"), F.count(F.lit(1)).alias("n_unique"))


def sample_species(classified: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """sample, sp, sure: the species of each sample's names, and whether one of its sequences has that name alone.

    With ``found``, species are numbered and sets of them are bits: a cell counts as the few words of its sequence's set, not as a
    row for each of its species.
    """
    if found is None:
        parts = classified.select("sample", F.explode(F.split("names", ";")).alias("sp"), (~F.col("names").contains(";")).alias("sure"))
        return parts.groupBy("sample", "sp").agg(F.bool_or("sure").alias("sure"))
    parts = found.select("marker", "md5", F.explode(F.split("names", ";")).alias("sp"), (~F.col("names").contains(";")).alias("sure"))
    # as many rows as there are species
    number = F.row_number().over(W.orderBy("sp")) - 1
    species = parts.select("sp").distinct().select("sp", F.floor(number / WORD).cast("int").alias("word"), (number % WORD).cast("int").alias("bit"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    both = lambda a, b: (F.bit_or(a).alias("bits"), F.bit_or(b).alias("alone"))
    words = counted(parts, species, "sp").groupBy("marker", "md5", "word").agg(*both(bit, F.when(F.col("sure"), bit).otherwise(F.lit(0).cast("long"))))
    cells = counted(classified.select("marker", "md5", "sample"), words, ["marker", "md5"])
    sets = cells.groupBy("sample", "word").agg(*both("bits", "alone"))
    return counted(sets, species, "word").where(F.col("bits").bitwiseAND(bit) != 0).select("sample", "sp", (F.col("alone").bitwiseAND(bit) != 0).alias("sure"))


def classification_summary(classified: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Each sample's species in report order; '(*)' follows those seen only in combinations, '-' means none."""
    per = sample_species(classified, found)
    # the bare name in front of '(*)', a display text only for what is sure
    text = F.when(F.col("sure"), species_display(F.col("sp"))).otherwise(F.concat("sp", F.lit("(*)")))
    named = per.select("sample", species_order(F.col("sp")).alias("o"), text.alias("t"))
    return named.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), ", ").alias("summary"))


def species_columns(classified: DataFrame) -> list[str]:
    """All species combinations in report order; one per report column, so few."""
    rows = classified.select("names").distinct().orderBy(species_order(F.col("names")), "names").collect()
    return [r[0] for r in rows]


def per_combination(classified: DataFrame) -> DataFrame:
    """sample, names, abundance, n_cells: sums that sample_report() takes in place of the cells."""
    return classified.groupBy("sample", "names").agg(F.sum("abundance").cast("long").alias("abundance"), F.count_if(F.col("abundance") >= 1).alias("n_cells"))


def sample_report(classified: DataFrame, stats: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per sample of ``stats``: its statistics, its summary, and one count column per species combination."""
    columns = species_columns(classified) if columns is None else columns
    counts = classified.groupBy("sample").pivot("names", columns).agg(F.sum("abundance"))
    summed = "n_cells" in classified.columns
    unique = classified.groupBy("sample").agg(F.sum("abundance").cast("long").alias("accepted"), F.sum("n_cells").alias("n_unique")) if summed else accepted_unique(classified)
    out = stats.join(classification_summary(classified), "sample", "left").join(counts, "sample", "left").join(unique, "sample", "left")
    return out.na.fill(0, [*columns, "accepted", "n_unique"]).na.fill("-", ["summary"])


def read_report(classified: DataFrame, samples: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row per sequence: prediction, sample count, largest and total count, and optionally one column per sample."""
    keys = ["marker", "md5"] if found is not None else ["marker", "md5", "names"]
    base = classified.groupBy(*keys).agg(F.countDistinct("sample").alias("sample_count"), F.max("abundance").alias("max_abundance"), F.sum("abundance").cast("long").alias("total_abundance"))
    if found is not None:
        base = counted(base, found.select("marker", "md5", "names"), ["marker", "md5"], "left").select("marker", "md5", "names", "sample_count", "max_abundance", "total_abundance")
    if samples:
        base = base.join(classified.groupBy("marker", "md5").pivot("sample", samples).agg(F.sum("abundance")).na.fill(0), ["marker", "md5"])
    return base


def read_order(report: DataFrame) -> DataFrame:
    """Report order: marker, species with blanks last, then the widest and largest sequences first."""
    return report.orderBy("marker", F.when(F.col("names") == "", "~").otherwise(F.col("names")), F.desc("sample_count"), F.desc("total_abundance"), "md5")


def totals_row(report: DataFrame) -> DataFrame:
    """'MAX or TOTAL': the largest sample count and cell, and the sum of totals."""
    return report.agg(F.max("sample_count").alias("sample_count"), F.max("max_abundance").alias("max_abundance"), F.sum("total_abundance").cast("long").alias("total_abundance"))


def with_rollup(tally: DataFrame) -> DataFrame:
    """Counts by marker and sample, with their subtotals and the grand total (nulls mark what is summed over)."""
    return tally.rollup("marker", "sample").agg(F.sum("abundance").cast("long").alias("abundance"), F.count(F.lit(1)).alias("cells"), F.grouping_id().cast("long").alias("level"))


def with_metadata(report: DataFrame, meta: DataFrame, unsequenced: bool = False, require: bool = False) -> DataFrame:
    """Metadata joined by sample; metadata without reads kept if ``unsequenced``, samples without metadata unless ``require``."""
    how = {(False, False): "left", (True, False): "full", (False, True): "inner", (True, True): "right"}[unsequenced, require]
    return report.join(meta, "sample", how)


def merged_stats(stats: DataFrame) -> DataFrame:
    """Statistics of samples over several markers: sums, maxima, and the threshold where all markers agree on it."""
    agree = F.when(F.countDistinct("threshold") == 1, F.first("threshold").cast("string")).otherwise("By marker")
    same_raw = F.when(F.countDistinct("raw") > 1, F.raise_error(F.concat(F.lit("raw reads differ for "), F.first("sample"))).cast("long")).otherwise(F.first("raw"))
    # what is the same for a sample's files comes along where it is known
    shared = [F.first(c, ignorenulls=True).alias(c) for c in ("merged", "control", "pool") if c in stats.columns]
    return stats.groupBy("sample").agg(same_raw.alias("raw"), *shared, F.sum("primer_matched").cast("long").alias("primer_matched"), F.sum("singletons").cast("long").alias("singletons"), F.max("max_non_spike").alias("max_non_spike"), F.max("max_spike_in").alias("max_spike_in"), agree.alias("threshold"))


def merged_limits(limits: DataFrame) -> DataFrame:
    """Thresholds per marker and sample (sample_thresholds) as one row per sample: maxima, and the threshold all markers agree on."""
    agree = F.when(F.countDistinct("threshold") == 1, F.first("threshold").cast("string")).otherwise("By marker")
    return limits.groupBy("sample", "pool", "control").agg(agree.alias("threshold"), F.max("max_non_spike").alias("max_non_spike"), F.max("max_spike_in").alias("max_spike_in"))


def complete_columns(stats: DataFrame, names: list[str]) -> list[str]:
    """The columns that no sample lacks; others are left out of reports."""
    row = stats.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    return [n for n in names if not row[n]]


def raised_threshold(stats: DataFrame, minimum: int) -> DataFrame:
    return stats.withColumn("threshold", F.greatest("threshold", F.lit(minimum)))


def color_bands(rows: DataFrame, value: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """rows with ``band``: the number of the run of equal values in order, and ``broken``: whether the value comes back later."""
    w = W.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    banded = rows.withColumn("_new", F.when(first, 1).otherwise(new)).withColumn("band", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = F.sum("_new").over(W.partitionBy(*(within or []), value))
    return banded.withColumn("broken", runs > 1).drop("_new")


def require_metadata(tally: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells of samples with metadata; sequences left without any disappear with them."""
    return tally.join(meta.select("sample").distinct(), "sample", "left_semi")
