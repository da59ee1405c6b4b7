"""FASTA titles to (taxid, name), one rule set per naming convention; columns, or joins where names are looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import taxid_in


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r" {2,}", " "))


def _pair(taxid: Column, name: Column) -> Column:
    return F.struct(taxid.cast("int").alias("taxid"), name.alias("name"))


def simple(title: Column) -> Column:
    """'Accession Genus species taxid=1 ...': what follows the accession, up to a taxid."""
    rest = F.regexp_replace(title, r"^\s*\S+\s+", "")
    name = F.regexp_replace(rest, r"(?s)(?:ncbi|[ _:;({\[\-\t])taxid=\d+.*$", "")
    return _pair(taxid_in(rest), _squeezed(name))


def taxid_only(title: Column) -> Column:
    return _pair(taxid_in(title), F.lit(""))


def sintax(title: Column) -> Column:
    """';tax=d:...,g:Genus,s:Genus_species': the species, its genus put in front where missing, else the genus."""
    parts = F.transform(F.split(title, ";"), lambda p: _squeezed(F.translate(p, "_", " ")))
    tax = F.array_join(F.filter(parts, lambda p: p.startswith("tax=")), ",")
    fields = F.transform(F.split(tax, ","), lambda f: F.trim(f))
    last = lambda rank: F.coalesce(F.substring(F.element_at(F.filter(fields, lambda f: f.startswith(rank)), -1), 3, 1000), F.lit(""))
    has = lambda rank: F.size(F.filter(fields, lambda f: f.startswith(rank))) > 0
    genus = F.when(has("g:"), last("g:")).otherwise("")
    species = F.when(has("s:"), last("s:")).otherwise("")
    present = species.startswith(genus) | genus.contains(F.split(species, " ")[0])
    bare = ~species.contains(" ") | F.substring(species, 1, 1).rlike("[a-z]")
    both = F.when(present, species).when(bare, F.concat_ws(" ", genus, species)).otherwise(species)
    return _pair(F.lit(0), F.when((genus != "") & (species != ""), both).otherwise(F.concat(genus, species)))


def obitools(title: Column) -> Column:
    """'id species_name=...; taxid=...;': the last species name, else the genus name."""
    rest = F.regexp_replace(title, r"^\s*\S+\s+", "")
    parts = F.transform(F.split(rest, ";"), lambda p: F.trim(p))
    value = lambda key, at: F.trim(F.substring(F.get(F.filter(parts, lambda p: p.startswith(key)), at), len(key) + 1, 10_000))
    count = lambda key: F.size(F.filter(parts, lambda p: p.startswith(key)))
    taxid = F.when(count("taxid=") > 0, value("taxid=", count("taxid=") - 1)).otherwise("0")
    name = F.when(count("species_name=") > 0, value("species_name=", count("species_name=") - 1)).otherwise(F.coalesce(value("genus_name=", F.lit(0)), F.lit("")))
    return _pair(taxid, name)


def ncbi_words(title: Column) -> Column:
    """'Accession Genus species description': two words by rule, more after each 'cf.' and the like, and both parents of a hybrid."""
    words = F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != "")
    w = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    # after two words, one more for each of them in a row that announces another
    unlinked = F.transform(F.slice(words, 3, 1 << 20), lambda x: (~x.isin("taxon", "aff.", "cf.", "x")).cast("int"))
    links = F.when(F.array_position(unlinked, 1) > 0, F.array_position(unlinked, 1) - 1).otherwise(F.size(unlinked))
    taken = F.least(3 + links, F.greatest(F.size(words), F.lit(3))).cast("int")
    base = F.array_join(F.slice(words, F.lit(2), taken - 1), " ")
    after = lambda k: F.coalesce(F.get(words, taken + k), F.lit(""))
    hybrid = (after(0) == "x") & (after(1) != "")
    again = hybrid & (after(1) == w(1)) & (after(2) != "")
    name = F.when(again, F.concat_ws(" ", base, F.lit("x"), after(2))).when(hybrid, F.concat_ws(" ", base, F.lit("x"), after(1))).otherwise(base)
    initial = (F.length(w(1)) > 2) & w(1).rlike(r"^\p{Lu}\.")
    return _pair(F.lit(0), F.when(initial | (w(1) == "Sequence"), "").otherwise(name))


def ncbi(titles: DataFrame, known: DataFrame) -> DataFrame:
    """``titles`` (title, ...) with taxid and name: the longest leading words that are a known name, else ncbi_words.

    Each title's prefixes are joined to ``known`` (name), so the names need not fit anywhere.
    """
    rows = titles.withColumn("_row", F.monotonically_increasing_id())
    words = F.filter(F.split(F.trim("title"), r"\s+"), lambda w: w != "")
    sizes = F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))
    prefixes = rows.select("_row", F.explode(F.transform(sizes, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(2), n), " ").alias("name")))).alias("p")).select("_row", "p.*")
    best = prefixes.join(known.select("name").distinct(), "name").groupBy("_row").agg(F.max_by("name", "n").alias("_best"))
    out = rows.join(best, "_row", "left").withColumn("_rule", ncbi_words(F.col("title")))
    longer = F.col("_best").contains(" ")
    return out.withColumn("taxid", F.lit(0)).withColumn("name", F.when(longer, F.col("_best")).otherwise(F.col("_rule.name"))).drop("_row", "_best", "_rule")


CONVENTIONS = {"simple": simple, "taxid": taxid_only, "sintax": sintax, "obitools": obitools, "ncbi": ncbi_words}
