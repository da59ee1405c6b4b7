"""Words and word k-grams of whole texts as DataFrame expressions: one split per text, grams hashed by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Words of letters, digits and characters outside ASCII, with A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    # for texts within ASCII the faster function does the same
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def gram_hash(words: Column, at: Column, size: int) -> Column:
    """A hash of the ``size`` words from ``at`` (from 0); null where they don't all exist."""
    parts = [F.get(words, at + j) for j in range(size)]
    return F.when(at + size <= F.size(words), F.xxhash64(F.lit(size), *parts))


def placed_grams(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``texts`` (any columns and ``_words``) with _at and _gram: a row per word place from 0 and gram size.

    Each text also has one row with _at -1 and no gram, so that texts without hits stay in one and the same scan.
    Places are generated as numbers beside the one array of words, which keeps the whole chain in generated code.
    """
    placed = texts.select("*", F.explode(F.sequence(F.lit(-1), F.size("_words") - 1)).alias("_at"))
    at = F.col("_at")
    hashes = [F.when(at >= 0, gram_hash(F.col("_words"), at, n)) for n in sizes]
    if len(hashes) == 1:
        return placed.withColumn("_gram", hashes[0])
    # the row without a gram comes once, not once per size
    each = F.when(at >= 0, F.array(*hashes)).otherwise(F.array(F.lit(None).cast("long")))
    return placed.select("*", F.explode(each).alias("_gram"))
