"""Predicted against known species per sample: confusion counts and accuracy.

Both sides are (sample, names) with ';'-joined names. A pair table holds expected and predicted as sorted arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .denoise import kept
from .joins import counted
from .reports import sample_species


def species_sets(rows: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """sample, species: the sorted set of its species-level names; genera are left out, synonyms replaced."""
    each = rows.select("sample", F.explode(F.split(F.coalesce("names", F.lit("")), ";")).alias("name"))
    if synonyms is not None:
        each = each.join(synonyms.select(F.col("name"), F.col("canonical")), "name", "left").withColumn("name", F.coalesce("canonical", "name"))
    return each.groupBy("sample").agg(F.array_sort(F.collect_set(F.when(F.col("name").contains(" "), F.col("name")))).alias("species"))


def predicted_sets(tally: DataFrame, found: DataFrame) -> DataFrame:
    """species_sets() of a tally's samples by its sequences' names in found(marker, md5, names)."""
    per = sample_species(tally, found)
    return per.groupBy("sample").agg(F.array_sort(F.collect_list(F.when(F.col("sp").contains(" "), F.col("sp")))).alias("species"))


def expected_only(tally: DataFrame, known: DataFrame) -> DataFrame:
    """The cells of samples whose species are known; paired() leaves out all others."""
    return counted(tally, known.select("sample").distinct(), "sample", "left_semi")


def paired(known: DataFrame, predicted: DataFrame) -> DataFrame:
    """expected, predicted per sample that both sides have."""
    return known.select("sample", F.col("species").alias("expected")).join(predicted.select("sample", F.col("species").alias("predicted")), "sample")


def confusion_tally(pairs: DataFrame) -> DataFrame:
    """How many samples have each pair of expected and predicted lists; kept, as what follows reads it several times."""
    return kept(pairs.sparkSession, pairs.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n_samples")))


def species_classes(tally: DataFrame, database: DataFrame, check: bool = False) -> DataFrame:
    """All species that are expected, predicted or in the database(species); a predicted one outside it can fail the query."""
    expected = tally.select(F.explode("expected").alias("species"))
    predicted = tally.select(F.explode("predicted").alias("species"))
    if check:
        known = database.select("species", F.lit(True).alias("_in"))
        predicted = predicted.join(known, "species", "left").select(F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("predicted but not in the database: "), F.col("species"))).cast("string")).otherwise(F.col("species")).alias("species"))
    return database.select("species").union(expected).union(predicted).distinct()


def binary_counts(tally: DataFrame, classes: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per species. Only mentioned (list, species) pairs are joined; the rest are true negatives."""
    total = tally.agg(F.coalesce(F.sum("n_samples"), F.lit(0)).alias("_all"))
    each = tally.select("n_samples", "expected", "predicted", F.explode(F.array_union("expected", "predicted")).alias("species"))
    e, p = F.array_contains("expected", F.col("species")), F.array_contains("predicted", F.col("species"))
    of = lambda c: F.sum(F.when(c, F.col("n_samples")).otherwise(0))
    counts = each.groupBy("species").agg(of(e & p).alias("tp"), of(~e & p).alias("fp"), of(e & ~p).alias("fn"))
    out = classes.join(counts, "species", "left").na.fill(0, ["tp", "fp", "fn"]).join(F.broadcast(total))
    return out.select("species", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], (F.col("_all") - F.col("tp") - F.col("fp") - F.col("fn")).cast("long").alias("tn"))


def overall_counts(binary: DataFrame) -> DataFrame:
    """The counts of all species summed."""
    return binary.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])


def with_metrics(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity, precision, F1, Hamming and ad-hoc loss; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return (
        counts.withColumn("sensitivity", ratio(tp, tp + fn)).withColumn("specificity", ratio(tn, tn + fp)).withColumn("precision", ratio(tp, tp + fp))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("hamming_loss", ratio(fp + fn, tp + fp + fn + tn)).withColumn("ad_hoc_loss", ratio(fp + fn, tp + fp + fn))
    )


def assessment(binary: DataFrame) -> DataFrame:
    """OVERALL first, then species; those of tp = fp = fn are one last row of all others in the database."""
    binary = kept(binary.sparkSession, binary)
    boring = (F.col("tp") == F.col("fp")) & (F.col("fp") == F.col("fn"))
    rows = with_metrics(overall_counts(binary)).select(F.lit(0).alias("part"), F.lit("OVERALL").alias("species"), "*")
    own = with_metrics(binary.where(~boring)).select(F.lit(1).alias("part"), "*")
    rest = binary.where(boring).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tn"), F.lit(0)).cast("long").alias("tn")).where("n > 0")
    rest = rest.select(F.concat(F.lit("OTHER "), F.col("n"), F.lit(" SPECIES IN DB")).alias("species"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")], "tn")
    return rows.unionByName(own).unionByName(with_metrics(rest).select(F.lit(2).alias("part"), "*"))


def confusion_cells(tally: DataFrame) -> DataFrame:
    """expected list, label, samples: a label is a predicted species, or (FN) or (TN) where none is predicted."""
    none = F.when(F.size("expected") > 0, F.array(F.lit("(FN)"))).otherwise(F.array(F.lit("(TN)")))
    cells = tally.select(F.array_join("expected", ";").alias("expected"), F.explode(F.when(F.size("predicted") > 0, F.col("predicted")).otherwise(none)).alias("label"), "n_samples")
    return cells.groupBy("expected", "label").agg(F.sum("n_samples").cast("long").alias("n_samples"))
