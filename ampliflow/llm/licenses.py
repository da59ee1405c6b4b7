"""License scans by diagonal voting (DataFrame functions only).

Templates are whole license texts and notices, cut into rolling grams of K words; base phrases, which are shorter, are one
gram each. Every gram of every text is joined by hash to the places of that gram in the templates, and the words are
compared in the same join, so a hash collision has no effect. A hit at text word p and template word t lies on diagonal
p - t; hits are counted by (text, template, diagonal), diagonals next to each other are merged, so that a word put in or
left out does not break a license, and a merged span is verified: the template's words found in it must cover enough of
the template, and it must not be much longer than that.

One scan: each text also sends one row without a gram, which carries its word count to the end. Only those
rows and the hits are shuffled, once, by text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grams import SEPARATORS, gram_hash, placed_grams, plain_words
from .license_texts import TEXTS

K = 4
SLACK = 2
COVERAGE = 0.8
STRETCH = 1.25

#: Phrases that count only whole and unbroken.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def template_grams(spark: SparkSession, base: dict[str, str] = BASE, texts=TEXTS, k: int = K) -> DataFrame:
    """One row per place of a gram in a template; as many as the templates have words. Grams have k words, or all of a shorter template's."""
    known = [(label, phrase, True) for label, phrase in base.items()] + [(label, text, False) for label, text in texts]
    rows = [(i, label, exact, len(w), n, t, w[t : t + n]) for i, (label, text, exact) in enumerate(known) for w in [template_words(text)] for n in [min(k, len(w))] for t in range(len(w) - n + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, exact boolean, length int, k int, tpos int, gram_words array<string>")
    sizes = sorted({r[4] for r in rows})
    return frame.withColumn("gram", F.coalesce(*[F.when(F.col("k") == n, gram_hash(F.col("gram_words"), F.lit(0), n)) for n in sizes]))


def scan(docs: DataFrame, templates: DataFrame, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (array of label, exact, start, end, cover).

    Null or empty text: 0 words, no spans. Null doc_id and repeated rows: each row has its own result. No rows in: no rows
    out. Other columns are ignored. ``templates`` has the form of template_grams; it must be small enough to broadcast, as
    a fixed list is. Texts are read whole.
    """
    sizes = sorted(r[0] for r in templates.select("k").distinct().collect())  # at most K values
    words = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", plain_words(F.col("text")).alias("_words"))
    placed = placed_grams(words, sizes)
    same = F.col("_gram") == F.col("gram")
    for j in range(max(sizes)):
        same &= F.coalesce(F.get("_words", F.col("_at") + j) == F.get("gram_words", F.lit(j)), F.col("k") <= j)
    hits = placed.join(F.broadcast(templates), same, "left").where((F.col("_at") == -1) | F.col("template").isNotNull())
    hits = hits.select("_row", "doc_id", F.size("_words").cast("long").alias("n_words"), "template", "label", "exact", "length", "k", "tpos", F.col("_at").alias("pos"), (F.col("_at") - F.col("tpos")).alias("diagonal"))
    hits = hits.repartition(F.col("_row"))
    keys = ["_row", "doc_id", "n_words", "template", "label", "exact", "length", "k"]
    votes = hits.groupBy(*keys, "diagonal").agg(F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    near = W.partitionBy(*keys).orderBy("diagonal")
    # phrases that count only unbroken keep each diagonal to itself
    new = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(near) > slack), F.lit(True))
    votes = votes.withColumn("_run", F.sum(new.cast("int")).over(near.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = votes.groupBy(*keys, "_run").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("first").alias("start"), (F.max("last") + F.col("k")).alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    runs = runs.withColumn("cover", covered / F.col("length"))
    grams_all = F.size("seen") == F.col("length") - F.col("k") + 1
    good = F.when(F.col("exact"), grams_all).otherwise((F.col("cover") >= coverage) & (F.col("end") - F.col("start") <= F.ceil(F.col("length") * STRETCH) + slack))
    span = F.when(F.col("template").isNotNull() & good, F.struct("label", "exact", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "cover"))
    return runs.groupBy("_row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("_row")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    found = scan(table(spark, sf_dir, "documents"), template_grams(spark))
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
