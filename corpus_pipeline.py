"""A corpus pipeline over documents: quality, toxicity, near copies, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's result
as Parquet to the shared folder and reads it again. All stages but the last keep the columns of documents, and any others;
the last returns training rows: text, copies and positions. No rows in: no rows out. Very long texts are read whole. Models are
fitted on labelled rows of the whole documents table, whatever earlier stages left of it.

Null texts: judged as empty. Rows with a null doc_id are never dropped as copies, since no id tells them apart; repeated
rows of one doc_id and text count as one document from the third stage on.

Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more (op3_ngram_join on its own
takes four words and 0.85).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.llm import decontam, mixing, ngram_join, quality, toxicity
from ampliflow.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids to leave out up to which they are broadcast; beyond it documents are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Benchmark items with an occurring window from which a document is left out of training data.
LEAKED_ITEMS = 1
#: Words of a shingle and percent of Jaccard similarity from which texts are near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, "_score").where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "_score", "_where").where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays."""
    found = written(ngram_join.near_components(docs, NEAR_WORDS, NEAR_PERCENT), "components")
    out = found.where("component_id <> doc_id").select("doc_id").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    again = small(again)
    left = docs.join(small(out), "doc_id", "left_anti")
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"), LEAKED_ITEMS - 1).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training rows in order of position: the text, how often it is taken, and the training times of all its copies."""
    return mixing.mix(docs, texts=True)


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
]
#: SQL can't express the models; tests/llm/test_pipeline.py holds run() against a brute-force version, and every stage on odd tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
