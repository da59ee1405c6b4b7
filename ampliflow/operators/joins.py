"""Joins to tables whose size is counted, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000


def counted(rows: DataFrame, found: DataFrame, keys, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to ``found``: by broadcast up to ``limit`` rows of it, counted here, and by merging beyond.

    Spark guesses the size of computed columns, so that tables of long texts made from small files would be broadcast.
    """
    return rows.join(F.broadcast(found) if found.count() <= limit else found.hint("merge"), keys, how)
