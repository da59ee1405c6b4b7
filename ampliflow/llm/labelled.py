"""Bounded samples of labelled texts, on which one executor task fits a classifier."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Most characters of text that a classifier is fitted on; of the sample's rows, those that come later are left out.
FIT_TOTAL = 40_000_000
#: Rows of an Arrow batch in fitting.
FIT_BATCH = 500


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo the number of parts."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int, chars: int) -> DataFrame:
    """text, _y (0 or 1) of at most ``rows`` labelled documents for which ``keep`` holds, in one partition.

    The rows are the first by a hash of the id; documents longer than ``chars`` characters are left out of fitting
    (not of scoring). Rows without text or label are left out. Of repeated rows of one id the largest label and the
    smallest text count.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & keep).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    # only ids are shuffled to find labelled documents; twice the rows are drawn, so that long ones can be left out
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where(F.length("text") <= chars)
    joined = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y"))
    # sorted in one task, which spills; an ordered limit would hold that many texts in every task
    return joined.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").limit(rows).select("text", "_y")


def as_texts(texts) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


def fitted(found: DataFrame, make: Callable, total: int = FIT_TOTAL):
    """``make(texts, labels)``, called in one executor task over the sample; only the model comes to the driver.

    ``texts`` is an Arrow array. ``found`` is in one partition."""

    def fit(batches):
        texts, labels, held = [], [], 0
        for batch in batches:
            taken = []
            for i, n in enumerate(pc.utf8_length(batch.column(0)).to_pylist()):
                if held + n <= total:
                    held += n
                    taken.append(i)
            texts.append(batch.column(0).take(pa.array(taken, pa.int64())))
            labels += batch.column(1).take(pa.array(taken, pa.int64())).to_pylist()
        texts = pa.concat_arrays(texts) if texts else as_texts([])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(texts, labels))], pa.binary())], ["model"])

    with small_batches(found.sparkSession, FIT_BATCH):
        models = found.mapInArrow(fit, "model binary").collect()
    return pickle.loads(bytes(models[0].model)) if models else make([], [])  # noqa: S301
