"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is a benchmark item's run of ``size`` words; its tokens are its shingles of SHINGLE words (a shorter window is
one shingle). A text contains a window only if it contains all of its shingles, so the rarest one alone is the window's
necessary prefix.

1. One scan: every shingle of every text is joined by hash to the benchmark's shingles. A hit keeps its place and the
   words around it, as many as any window through it can reach.
2. Shingles are ordered by rarity: exact counts of their hits over all texts. Each window keeps its rarest one; a window
   with a shingle that no text has cannot occur and leaves.
3. Hits of prefix shingles fix where the window would start, which must lie inside the text (position and length
   bounds); what is left is compared word for word with the kept words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import gram_hash, placed_grams, plain_words
from .shared import table, written

WINDOW = 8
SHINGLE = 4
CONTAMINATED = 2
#: Shingles (distinct hashes) that one scan broadcasts; more are searched in blocks of so many, one scan each.
BROADCAST_SHINGLES = 2_000_000
#: Windows, and texts with hits, up to which they are broadcast; beyond it they are shuffled.
BROADCAST_WINDOWS = 100_000
BROADCAST_FOUND = 200_000


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: words (array), items (ids as strings)."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words"))
    return w.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _id and _h: rows that agree in both have the same text. Without an id, _h is the whole SHA-256."""
    h = F.when(F.col("doc_id").isNull(), F.sha2("text", 256)).otherwise(F.hex(F.xxhash64("text")))
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_h", F.coalesce(h, F.lit("")))


def searched(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts, found). texts: doc_id, _id, _h, n_words for every row of ``docs``. found: _id, _h, n_hit, hit_items for every
    distinct (_id, _h) with a hit word; hit_items is the sorted array of item ids as strings."""
    wins = written(windows(items, size), "windows")
    n_windows = wins.count()
    small = (lambda x: F.broadcast(x)) if n_windows <= BROADCAST_WINDOWS else (lambda x: x)
    width = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in wins.select(width).distinct().collect()) or [SHINGLE]  # SHINGLE values at most
    offsets = wins.select("words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("off"))
    by_width = F.coalesce(*[F.when(width == n, gram_hash(F.col("words"), F.col("off"), n)) for n in sizes])
    shingles = written(offsets.select("words", "off", by_width.alias("gram")), "window-shingles")
    vocabulary = written(shingles.select("gram").distinct(), "shingles")
    blocks = max(1, -(-vocabulary.count() // BROADCAST_SHINGLES))

    texts = keyed(docs.select("doc_id", "text")).select("doc_id", "_id", "_h", plain_words(F.col("text")).alias("_words"))
    n, low = F.size("_words"), F.greatest(F.col("_at") - (size - 1), F.lit(0))
    hits = None
    for block in range(blocks):
        part = vocabulary.where(F.pmod("gram", F.lit(blocks)) == block) if blocks > 1 else vocabulary
        grams = placed_grams(texts, sizes)
        if block:
            grams = grams.where("_at >= 0")
        hit = grams.join(F.broadcast(part), F.col("_gram") == F.col("gram"), "left").where("_at = -1 or gram is not null")
        around = F.when(F.col("_at") >= 0, F.slice("_words", low + 1, F.col("_at") + size - low))
        hit = hit.select("doc_id", "_id", "_h", n.cast("long").alias("n_words"), F.col("_at").alias("at"), "gram", low.alias("low"), around.alias("around"))
        hits = hit if hits is None else hits.unionByName(hit)
    hits = written(hits, "shingle-hits")
    texts, hits = hits.where("at = -1").select("doc_id", "_id", "_h", "n_words"), hits.where("at >= 0")

    df = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = shingles.join(df, "gram", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "off")).alias("r"))
    prefixes = written(ranked.where("r.df > 0").select("words", F.col("r.gram").alias("gram"), F.col("r.off").alias("off")), "prefixes")
    start = F.col("at") - F.col("off")
    inside = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    kept = hits.join(small(prefixes), "gram").where(inside & (F.slice("around", start - F.col("low") + 1, F.size("words")) == F.col("words")))
    # repeated rows of one text give equal hits
    kept = written(kept.select("_id", "_h", start.alias("start"), "words").distinct(), "occurrences")
    places = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.size("words") - 1))))
    hit_words = kept.groupBy("_id", "_h").agg(F.size(places).cast("long").alias("n_hit"))
    of = kept.select("_id", "_h", "words").distinct().join(small(wins), "words").select("_id", "_h", F.explode("items").alias("item"))
    of = of.groupBy("_id", "_h").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    return texts, written(hit_words.join(of, ["_id", "_h"]), "found")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, hit_items (sorted array of item ids as strings) for every row of ``docs``.

    A word is hit if it lies in any occurrence of any window. Null or empty text or item: no words. An item of
    fewer than ``size`` words is one window; a null item_id counts as "null". Null doc_id, repeated rows: each row is
    judged by its own text. Empty tables give no rows or no hits. Other columns of ``docs``, whatever their names, are
    ignored. Texts are read whole.
    """
    texts, found = searched(docs, items, size)
    if found.count() <= BROADCAST_FOUND:
        found = F.broadcast(found)
    none = F.array().cast("array<string>")
    return texts.join(found, ["_id", "_h"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hit_items", none).alias("hit_items"))


def without_leaks(docs: DataFrame, items: DataFrame, most: int, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds windows of at most ``most`` items; odd rows as in decontaminate."""
    _, found = searched(docs, items, size)
    leaked = found.where(F.size("hit_items") > most).select(F.col("_id").alias("_leaked_id"), F.col("_h").alias("_leaked_h"))
    if leaked.count() <= BROADCAST_FOUND:
        leaked = F.broadcast(leaked)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")  # no name of docs can clash
    key = keyed(docs.select("doc_id", "text", row))
    kept = key.join(leaked, (F.col("_id") == F.col("_leaked_id")) & (F.col("_h") == F.col("_leaked_h")), "left_anti")
    return kept.select("_row.*")


def op10_decontam(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("hit_items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n >= CONTAMINATED).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + 7], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins))),
hit AS (SELECT rid, i, n, item_id FROM grams JOIN wins USING (n, win)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN its USING (rid)
"""
