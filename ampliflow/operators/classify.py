"""Species of query sequences from a reference database.

queries(md5, seq) of one marker; refs as in refdb. Every method returns md5, taxids, names; names is empty for no match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .denoise import kept
from .distance import near_pairs
from .joins import counted
from .refdb import species_lists

MIN_COVERAGE = 0.85
MIN_IDENTITY = 95.0


def _listed(queries: DataFrame, hits: DataFrame, refs: DataFrame) -> DataFrame:
    """The consolidated taxa of hits(md5, ref) per query, empty for queries without."""
    taxa = hits.join(refs.select(F.col("md5").alias("ref"), "genus", "species", "taxid").distinct(), "ref")
    return queries.select("md5").join(species_lists(taxa, ["md5"]), "md5", "left").na.fill({"taxids": "0", "names": ""})


def identity(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Equal sequences."""
    return _listed(queries, queries.join(refs.select(F.col("md5").alias("ref")).distinct(), F.col("md5") == F.col("ref")).select("md5", "ref"), refs)


def substring(queries: DataFrame, refs: DataFrame, seed: int = 16) -> DataFrame:
    """Queries that lie within a reference sequence.

    Queries are joined by their first ``seed`` letters to those at every place of the references; shorter queries, which
    are few in any amplicon set, are compared with all references.
    """
    subjects = refs.select(F.col("md5").alias("ref"), F.col("seq").alias("ref_seq")).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("ref_seq") - (seed - 1), F.lit(1)))
    grams = subjects.select("ref", "ref_seq", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("ref_seq", i, F.lit(seed))))).alias("gram"))
    long_ = queries.where(F.length("seq") >= seed).join(grams, F.substring("seq", 1, seed) == F.col("gram"))
    short = queries.where(F.length("seq") < seed).join(subjects, F.expr("contains(ref_seq, seq)"))
    hits = long_.where(F.expr("contains(ref_seq, seq)")).select("md5", "ref").unionByName(short.select("md5", "ref"))
    return _listed(queries, hits.distinct(), refs)


def by_distance(queries: DataFrame, refs: DataFrame, max_genus: int = 1, taxonomy: DataFrame | None = None) -> DataFrame:
    """Tiers: equal sequences on species level; else everything within one edit; else genera of the nearest within
    max_genus edits, each with its own taxid. Genus-only equals give way to, or are joined with, matches at one edit.

    ``taxonomy`` (genus, species, taxid) is where genera's taxids are looked up: all of the database's, by default refs.
    """
    subjects = refs.select(F.col("md5").alias("r"), F.col("seq").alias("r_seq")).distinct()
    near = near_pairs(queries.select(F.col("md5").alias("l"), F.col("seq").alias("l_seq")), subjects, max_genus).select(F.col("l").alias("md5"), F.col("r").alias("ref"), "dist")
    level = refs.groupBy(F.col("md5").alias("ref")).agg(F.bool_or(F.col("species") != "").alias("named"))
    near = near.join(level, "ref")
    per = W.partitionBy("md5")
    near = (
        near.withColumn("exact", F.bool_or(F.col("dist") == 0).over(per))
        .withColumn("exact_named", F.bool_or((F.col("dist") == 0) & F.col("named")).over(per))
        .withColumn("next", F.min(F.when(F.col("dist") > 0, F.col("dist"))).over(per))
    )
    tier = F.when(F.col("exact_named"), "exact").when(F.col("next") == 1, "one").when(F.col("exact"), "exact").otherwise("genus")
    near = near.withColumn("tier", tier)
    whole = near.where(((F.col("tier") == "exact") & (F.col("dist") == 0)) | ((F.col("tier") == "one") & (F.col("dist") <= 1)))
    taxa = whole.select("md5", "ref").join(refs.select(F.col("md5").alias("ref"), "genus", "species", "taxid").distinct(), "ref")
    far = near.where((F.col("tier") == "genus") & (F.col("dist") == F.col("next"))).select("md5", "ref")
    genus_ids = (refs if taxonomy is None else taxonomy).where((F.col("species") == "") & (F.col("taxid") != 0)).groupBy("genus").agg(F.max("taxid").alias("taxid"))
    far = far.join(refs.select(F.col("md5").alias("ref"), "genus").distinct(), "ref").select("md5", "genus").distinct().join(genus_ids, "genus", "left")
    # one taxid per genus, equal ones too; a query is in this tier or in the others
    far = far.groupBy("md5").agg(F.array_sort(F.collect_list(F.struct("genus", F.coalesce("taxid", F.lit(0)).cast("string").alias("id")))).alias("g"))
    far = far.select("md5", F.array_join("g.id", ";").alias("taxids"), F.array_join("g.genus", ";").alias("names"))
    found = species_lists(taxa.select("md5", "genus", "species", "taxid"), ["md5"]).unionByName(far)
    return queries.select("md5").join(found, "md5", "left").na.fill({"taxids": "0", "names": ""})


def scored_hits(queries: DataFrame, refs: DataFrame, k: int = 4) -> DataFrame:
    """query, ref, aln_len, pident, score from edit distances, in place of an external aligner's table."""
    subjects = refs.select(F.col("md5").alias("r"), F.col("seq").alias("r_seq")).distinct()
    near = near_pairs(queries.select(F.col("md5").alias("l"), F.col("seq").alias("l_seq")), subjects, k)
    near = near.join(queries.select(F.col("md5").alias("l"), F.length("seq").alias("n")), "l")
    return near.select(F.col("l").alias("md5"), F.col("r").alias("ref"), F.col("n").alias("aln_len"), "n", (100.0 * (F.col("n") - F.col("dist")) / F.col("n")).alias("pident"), (2.0 * F.col("n") - 5.0 * F.col("dist")).alias("score"))


def top_score(queries: DataFrame, refs: DataFrame, hits: DataFrame) -> DataFrame:
    """The taxa of a query's equally best hits, of those that cover and match it enough."""
    good = hits.where((F.col("aln_len") / F.col("n") >= MIN_COVERAGE) & (F.col("pident") >= MIN_IDENTITY))
    best = good.withColumn("_rank", F.rank().over(W.partitionBy("md5").orderBy(F.desc("score")))).where("_rank = 1")
    return _listed(queries, best.select("md5", "ref").distinct(), refs)


METHODS = {
    "identity": identity,
    "substr": substring,
    "onebp": lambda q, r, t=None: by_distance(q, r, 1, t),
    **{f"1s{k}g": (lambda q, r, t=None, k=k: by_distance(q, r, k, t)) for k in range(2, 10)},
    "topscore": lambda q, r: top_score(q, r, scored_hits(q, r)),
}


def found(tally: DataFrame, refs: DataFrame, method: str = "onebp") -> DataFrame:
    """marker, md5, taxids, names: each distinct sequence of tally classified once per marker, and kept; genera's taxids are looked up over all markers."""
    seqs = kept(tally.sparkSession, tally.select("marker", "md5", "seq").distinct())
    markers = [r[0] for r in seqs.select("marker").distinct().orderBy("marker").collect()]  # a handful of primer pairs
    out = None
    for m in markers:
        given = [seqs.where(F.col("marker") == m).select("md5", "seq"), refs.where(F.col("marker") == m)]
        own = METHODS[method](*given, *([refs] if method == "onebp" or method[:2] == "1s" else [])).withColumn("marker", F.lit(m))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return seqs.select("marker", "md5", F.lit("0").alias("taxids"), F.lit("").alias("names"))
    return kept(tally.sparkSession, out)


def with_names(tally: DataFrame, names: DataFrame) -> DataFrame:
    """tally with the columns of names(marker, md5, ...), as of found(). Texts of many names are long: reports that sum cells join them later."""
    return counted(tally, names, ["marker", "md5"], "left")


def classify(tally: DataFrame, refs: DataFrame, method: str = "onebp") -> DataFrame:
    """tally with taxids and names."""
    return with_names(tally, found(tally, refs, method))
