"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_fold(id_col: str | Column, folds: int = 5) -> Column:
    """The fold of an id, 0 to ``folds`` - 1: the CRC-32 of its decimal text, modulo ``folds``; a null id is in fold 1."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(1)).cast("int")


def label_sample(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, label_col)`` of at most ``most`` labelled ids, the same ones at every run.

    Rows without an id or a label are no labels; an id that has several keeps the least. Where there are more
    than ``most``, ids are kept below a hash threshold (so the choice follows no order of the table), then
    the lowest hashes of those. The bound makes the result safe to broadcast.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label_col))
    share = most / max(1, known.count())
    drawn = known.withColumn("_draw", F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 30)))
    if share < 1:
        drawn = drawn.where(F.col("_draw") < int(1.2 * share * (1 << 30)))
    return drawn.orderBy("_draw", id_col).limit(most).drop("_draw")
