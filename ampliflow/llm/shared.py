"""The folder that driver and executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which lookup() broadcasts, and the salts of a key beyond that.
LOOKUP_ROWS = 200_000
SALTS = 32
#: Rows of narrow tables, and of tables with arrays, that written() puts in a file at least.
FILE_ROWS, WIDE_ROWS = 1 << 17, 1 << 13


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's spark.checkpoint.dir; an error where that is unset, as no other folder is shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    return f"{base.rstrip('/')}/ampliflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost executor costs no recomputation.

    With ``rows``, about the most rows it can have, its last stage has a task, and so a file, for ``each`` of them at most.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, records: int):
    """Arrow batches of at most ``records`` rows for jobs run inside, where rows hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(records, int(before)) if int(before) > 0 else records))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], spread, how: str = "inner", limit: int | None = None) -> DataFrame:
    """``rows`` joined to ``found`` (one row per key, counted here): by broadcast up to ``limit`` rows (LOOKUP_ROWS), and beyond it
    on the keys and one of SALTS salts of ``spread``, so that the rows of a hot key go to that many tasks."""
    if found.count() <= (LOOKUP_ROWS if limit is None else limit):
        return rows.join(F.broadcast(found), keys, how)
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
