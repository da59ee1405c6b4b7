"""The reference database: star view, name look-ups, import rules, conflicts, dumps and the taxonomy tree.

refs(marker, md5, seq, accession, taxid, genus, species) is the joined view that classifiers use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import binomial, is_rejected_name
from .denoise import kept


def star_view(sources: DataFrame, sequences: DataFrame, markers: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The fact table (sequence_source) with its three dimensions by id."""
    return (
        sources.join(sequences.select(F.col("id").alias("marker_sequence_id"), "md5", F.col("sequence").alias("seq")), "marker_sequence_id")
        .join(markers.select(F.col("id").alias("marker_definition_id"), F.col("name").alias("marker")), "marker_definition_id")
        .join(taxonomy.select(F.col("id").alias("taxonomy_id"), F.col("ncbi_taxid").alias("taxid"), "genus", "species"), "taxonomy_id")
        .select("marker", "md5", "seq", F.col("source_accession").alias("accession"), "taxid", "genus", "species")
    )


def consolidated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Distinct (genus, species, taxid) per key, without genus-only rows whose genus has a species, and without
    taxid 0 rows that have a twin with a taxid."""
    rows = rows.select(*key, "genus", "species", "taxid").distinct()
    by_genus, by_name = W.partitionBy(*key, "genus"), W.partitionBy(*key, "genus", "species")
    rows = rows.withColumn("_named", F.max(F.col("species") != "").over(by_genus)).withColumn("_known", F.max(F.col("taxid") != 0).over(by_name))
    return rows.where(((F.col("species") != "") | ~F.col("_named")) & ((F.col("taxid") != 0) | ~F.col("_known"))).drop("_named", "_known")


def species_lists(rows: DataFrame, key: list[str]) -> DataFrame:
    """taxids and names of each key's consolidated taxa, parallel and sorted by name; a list of equals is one value."""
    listed = consolidated(rows, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("genus", "species", "taxid"))).alias("t"))
    names = F.transform("t", lambda x: binomial(x["genus"], x["species"]))
    ids = F.transform("t", lambda x: x["taxid"].cast("string"))
    one = lambda v: F.when(F.size(F.array_distinct(v)) == 1, F.element_at(v, 1)).otherwise(F.array_join(v, ";"))
    return listed.select(*key, one(ids).alias("taxids"), one(names).alias("names"))


def conflicts(refs: DataFrame) -> DataFrame:
    """md5, level, conflicts: sequences of several markers, or of several genera or species within the table."""
    def level(name: str, order: int, value, rows: DataFrame) -> DataFrame:
        found = rows.groupBy("md5").agg(F.array_sort(F.collect_set(value)).alias("v")).where(F.size("v") > 1)
        return found.select("md5", F.lit(name).alias("level"), F.array_join("v", ";").alias("conflicts"), F.lit(order).alias("level_order"))

    named = refs.where(F.col("species") != "")
    return (
        level("marker", 0, F.col("marker"), refs)
        .unionByName(level("genus", 1, F.col("genus"), refs))
        .unionByName(level("species", 2, binomial(F.col("genus"), F.col("species")), named))
    )


def dump(refs: DataFrame, genera: list[str] | None = None, species: list[str] | None = None, marker: str | None = None) -> DataFrame:
    """Rows by marker, genus and species; a species filter needs exactly one genus."""
    if species and len(genera or []) != 1:
        raise ValueError("a species filter needs exactly one genus")
    if marker:
        refs = refs.where(F.col("marker") == marker)
    if genera:
        refs = refs.where(F.col("genus").isin(*genera))
    if species:
        refs = refs.where(F.col("species").isin(*species))
    return refs.select("marker", "accession", "taxid", "genus", "species", "md5", "seq")


def minimal_dump(refs: DataFrame) -> DataFrame:
    """One row per sequence with its consolidated names."""
    return species_lists(refs, ["md5"])


def fasta_titles(refs: DataFrame, sep: str = ";") -> DataFrame:
    """One title per sequence: its sorted distinct 'accession genus species taxid=N' entries; no taxid for 0."""
    entry = F.concat_ws(" ", "accession", binomial(F.col("genus"), F.col("species")), F.when(F.col("taxid") != 0, F.concat(F.lit("taxid="), F.col("taxid"))))
    return refs.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set(entry)), sep).alias("title"))


def marker_counts(refs: DataFrame) -> DataFrame:
    """Distinct sequences, species and genera per marker, the sanity counts before classifying."""
    return refs.groupBy("marker").agg(
        F.countDistinct("md5").alias("n_sequences"), F.countDistinct(F.when(F.col("species") != "", F.struct("genus", "species"))).alias("n_species"), F.countDistinct("genus").alias("n_genera")
    )


def by_name(names: DataFrame, taxonomy: DataFrame, synonyms: DataFrame) -> DataFrame:
    """names(name) with taxonomy_id: an exact name first, else a synonym; null where there is neither."""
    exact = taxonomy.select(F.col("id").alias("_exact"), binomial(F.col("genus"), F.col("species")).alias("name"))
    other = synonyms.select(F.col("taxonomy_id").alias("_other"), "name")
    return names.join(exact, "name", "left").join(other, "name", "left").withColumn("taxonomy_id", F.coalesce("_exact", "_other")).drop("_exact", "_other")


def by_taxid(ids: DataFrame, taxonomy: DataFrame, synonyms: DataFrame) -> DataFrame:
    """ids(taxid) with taxonomy_id: the taxonomy's own, else through a synonym 'NCBI:taxidN'."""
    own = taxonomy.where("ncbi_taxid <> 0").groupBy(F.col("ncbi_taxid").alias("taxid")).agg(F.min("id").alias("_own"))
    other = synonyms.where(F.col("name").startswith("NCBI:taxid")).select(F.substring("name", 11, 20).cast("int").alias("taxid"), F.col("taxonomy_id").alias("_other"))
    return ids.join(own, "taxid", "left").join(other, "taxid", "left").withColumn("taxonomy_id", F.coalesce("_own", "_other")).drop("_own", "_other")


def among(refs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The references whose sequence is one of seqs(md5)."""
    return refs.join(seqs.select("md5").distinct(), "md5", "left_semi")


def unknown(seqs: DataFrame, refs: DataFrame) -> DataFrame:
    """The sequences that are no reference's."""
    return seqs.join(refs.select("md5").distinct(), "md5", "left_anti")


def import_entries(entries: DataFrame, taxonomy: DataFrame, synonyms: DataFrame, mode: str = "validate", min_length: int = 0, max_length: int = 1 << 30) -> DataFrame:
    """entries(accession, seq, taxid, name) resolved to genus and species; unresolved ones are dropped.

    taxid first, then exact name, then synonym. 'validate' falls back to a known genus; 'lax' adds the name as it is;
    'genus' keeps the genus alone. Sequences are upper-cased, and those with other letters than IUPAC codes left out.
    """
    rows = entries.withColumn("seq", F.upper("seq")).where(F.col("seq").rlike("^[GATCRYWSMKHBVDN]+$") & F.length("seq").between(min_length, max_length))
    rows = by_taxid(rows, taxonomy, synonyms).withColumnRenamed("taxonomy_id", "_by_id")
    rows = by_name(rows, taxonomy, synonyms).withColumn("_id", F.coalesce("_by_id", "taxonomy_id"))
    known = taxonomy.select(F.col("id").alias("_id"), F.col("genus").alias("_genus"), F.col("species").alias("_species"), F.col("ncbi_taxid").alias("_taxid"))
    rows = rows.join(known, "_id", "left")
    genus = F.split("name", " ", 2)[0]
    genera = taxonomy.where("species = ''").select(F.col("genus").alias("_g"), F.col("ncbi_taxid").alias("_gt")).dropDuplicates(["_g"])
    rows = rows.join(genera, genus == F.col("_g"), "left")
    bad = is_rejected_name(F.col("name"))
    found = F.col("_id").isNotNull()
    if mode == "lax":
        g, s = F.when(found, F.col("_genus")).when(~bad, genus), F.when(found, F.col("_species")).otherwise(F.coalesce(F.get(F.split("name", " ", 2), F.lit(1)), F.lit("")))
        t = F.when(found, F.col("_taxid")).otherwise(F.col("taxid"))
    else:
        g, s, t = F.coalesce("_genus", F.when(~bad, F.col("_g"))), F.coalesce("_species", F.lit("")), F.coalesce("_taxid", "_gt", F.lit(0))
    if mode == "genus":
        s, t = F.lit(""), F.coalesce("_gt", F.lit(0))
    return rows.select("accession", F.md5("seq").alias("md5"), "seq", t.cast("int").alias("taxid"), g.alias("genus"), s.alias("species")).where(F.col("genus").isNotNull()).distinct()


def subtree(nodes: DataFrame, roots: DataFrame, steps: int = 60) -> DataFrame:
    """taxid, root, depth of all nodes at or below roots(taxid); nodes(taxid, parent).

    One join per level, whose lineage is cut; levels are few in a taxonomy. A node that is its own parent is not followed.
    """
    spark = nodes.sparkSession
    level = roots.select("taxid", F.col("taxid").alias("root"), F.lit(0).alias("depth"))
    edges = nodes.where("taxid <> parent").select(F.col("taxid").alias("child"), "parent")
    out = level
    for depth in range(1, steps):
        level = kept(spark, level.join(edges, level["taxid"] == edges["parent"]).select(F.col("child").alias("taxid"), "root", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError("the tree is deeper than expected, or has a cycle")


def load_taxonomy(nodes: DataFrame, names: DataFrame, merged: DataFrame, ancestors: list[int]) -> tuple[DataFrame, DataFrame]:
    """(taxonomy(ncbi_taxid, genus, species), synonyms(ncbi_taxid, name)) below some ancestors.

    nodes(taxid, parent, rank), names(taxid, name, class), merged(old, new). Genera, and species or species groups right
    below them; ranks under a species become its synonyms, as do other names and merged ids.
    """
    spark = nodes.sparkSession
    inside = subtree(nodes, spark.createDataFrame([(a,) for a in ancestors], "taxid int")).select("taxid").distinct()
    tree = nodes.join(inside, "taxid")
    scientific = names.where("class = 'scientific name'").select("taxid", "name")
    genera = tree.where("rank = 'genus'").join(scientific, "taxid").select("taxid", F.col("name").alias("genus"))
    below = subtree(tree, genera.select("taxid")).withColumnRenamed("root", "genus_id").where("depth > 0")
    top = below.join(tree.where("rank in ('species', 'species group', 'species subgroup')").select("taxid", "rank"), "taxid").join(scientific, "taxid")
    named = top.join(genera.withColumnRenamed("taxid", "genus_id"), "genus_id").where(~is_rejected_name(F.col("name")))
    # 'A x Genus b' as 'A x b'; the genus in front of the species name is taken off
    short0 = F.when(F.col("name").startswith(F.concat(F.col("genus"), F.lit(" "))), F.expr("substring(name, length(genus) + 2)")).otherwise(F.col("name"))
    short = F.expr("replace(concat(' ', _short), concat(' x ', genus, ' '), ' x ')")
    species = named.withColumn("_short", short0).select(F.col("taxid").alias("ncbi_taxid"), "genus", F.trim(short).alias("species"))
    taxonomy = genera.select(F.col("taxid").alias("ncbi_taxid"), "genus", F.lit("").alias("species")).unionByName(species)
    minor = subtree(tree, species.select(F.col("ncbi_taxid").alias("taxid"))).where("depth > 0").select("taxid", "root")
    minor = minor.join(species.select(F.col("ncbi_taxid").alias("taxid")), "taxid", "left_anti")
    own = taxonomy.select(F.col("ncbi_taxid").alias("root"), F.col("ncbi_taxid").alias("taxid"))
    held = own.unionByName(minor.select("root", "taxid"))
    alias = held.join(names, "taxid").where((F.col("class") != "scientific name") & F.col("class").isin("synonym", "equivalent name", "includes") | (F.col("taxid") != F.col("root")) & (F.col("class") == "scientific name"))
    synonyms = alias.select(F.col("root").alias("ncbi_taxid"), "name").unionByName(
        held.join(merged, F.col("taxid") == F.col("new")).select(F.col("root").alias("ncbi_taxid"), F.concat(F.lit("NCBI:taxid"), F.col("old")).alias("name"))
    ).unionByName(minor.select(F.col("root").alias("ncbi_taxid"), F.concat(F.lit("NCBI:taxid"), F.col("taxid")).alias("name")))
    return taxonomy.distinct(), synonyms.where(~F.col("name").contains(";")).distinct()
