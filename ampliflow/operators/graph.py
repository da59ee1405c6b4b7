"""Edit-distance networks: node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distance import self_pairs

MAX_EDGE = 3


def wanted(stats: DataFrame, edges: DataFrame, min_samples: int = 0, min_total: int = 0, keep_total: int = 0) -> DataFrame:
    """Sequences that are common enough, and have a neighbour or a total of keep_total."""
    stats = stats.where((F.col("n_samples") >= min_samples) & (F.col("total") >= min_total))
    ends = edges.select(F.explode(F.array("a", "b")).alias("md5")).distinct().withColumn("_near", F.lit(True))
    return stats.join(ends, "md5", "left").where(F.col("_near").isNotNull() | (F.col("total") >= keep_total if keep_total else F.lit(False))).drop("_near")


def edges(seqs: DataFrame, k: int = MAX_EDGE) -> DataFrame:
    """a < b, dist for seqs(md5, seq) within k edits."""
    return self_pairs(seqs, k)


def irredundant(all_edges: DataFrame) -> DataFrame:
    """Edges of distance 2 without a path of 1 + 1, and of 3 without one of 1 + 2, over all sequences."""
    both = all_edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("dist").alias("d")).union(all_edges.select("b", "a", "dist"))
    first, second = both.where("d <= 2").alias("p"), both.where("d <= 2").alias("q")
    paths = first.join(second, (F.col("p.y") == F.col("q.x")) & (F.col("p.x") < F.col("q.y")) & (F.col("p.d") + F.col("q.d") <= MAX_EDGE))
    paths = paths.select(F.col("p.x").alias("a"), F.col("q.y").alias("b"), (F.col("p.d") + F.col("q.d")).alias("dist")).distinct()
    return all_edges.join(paths, ["a", "b", "dist"], "left_anti")


def edge_attributes(found: DataFrame, k: int = MAX_EDGE) -> DataFrame:
    """Weight, drawn length and line style by distance."""
    style = F.when(F.col("dist") == 1, "solid").when(F.col("dist") == 2, "dashed").otherwise("dotted")
    return found.select("a", "b", "dist", (k - F.col("dist") + 1).alias("weight"), (F.lit(0.3) * F.col("dist") / k).alias("length"), style.alias("style"))


def nodes(stats: DataFrame, taxa: DataFrame) -> DataFrame:
    """size, label and colour per sequence of stats(md5, n_samples, ...); taxa(md5, names) is what the database has."""
    largest = stats.agg(F.max("n_samples").alias("_most"))
    out = stats.join(taxa, "md5", "left").join(F.broadcast(largest))
    many, named = F.col("names").contains(";"), F.col("names").contains(" ")
    colour = F.when(F.coalesce("names", F.lit("")) == "", "#808080").when(many, "#ff8c00").when(named, "#ff0000").otherwise("#8b0000")
    return out.select("md5", F.greatest(F.lit(1.0), F.lit(100.0) / F.col("_most") * F.col("n_samples")).alias("size"), F.when(F.coalesce("names", F.lit("")) == "", F.substring("md5", 1, 6)).otherwise(F.replace("names", F.lit(";"), F.lit("\n"))).alias("label"), colour.alias("colour"), F.col("names").isNotNull().alias("in_db"))


def without_genus_only(taxa: DataFrame) -> DataFrame:
    """taxa(md5, genus, species) without genus rows of sequences that have a species of that genus."""
    named = taxa.where("species <> ''").select("md5", "genus").distinct()
    return taxa.where("species <> ''").unionByName(taxa.where("species = ''").join(named, ["md5", "genus"], "left_anti"))


def xgmml_lines(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """part, value: the graph's XML lines in order of part and value, between a head and a foot."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit(";"))
    n = node_rows.select(F.lit(1).alias("part"), F.format_string('  <node id="%s" label="%s"><graphics type="CIRCLE" fill="%s" w="%.2f" h="%.2f"/></node>', "md5", escape(F.col("label")), "colour", "size", "size").alias("value"))
    e = edge_rows.select(F.lit(2).alias("part"), F.format_string('  <edge source="%s" target="%s" weight="%d"><att type="integer" name="dist" value="%d"/></edge>', "a", "b", "weight", "dist").alias("value"))
    spark = node_rows.sparkSession
    ends = spark.createDataFrame([(0, '<graph directed="0" xmlns="http://www.cs.rpi.edu/XGMML">'), (3, "</graph>")], "part int, value string")
    return ends.unionByName(n).unionByName(e)
