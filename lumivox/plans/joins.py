"""Joins with an aggregate of one of their sides, which hot keys can't hold up, and joins that the driver never holds a side of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(rows: DataFrame, few: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` (or several) with ``few``, an aggregate that has a key once: a plain join that adaptive execution can split.

    Skewed partitions are split only where both inputs come right from an exchange. An aggregate by the join's key alone comes
    from its own, so none is put between it and the join; a second key, which is always zero, asks for one. What is
    exchanged once more has a row a key.
    """
    keys = [key] if isinstance(key, str) else key
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))
    met = rows.withColumn("_zero", zero).join(few.withColumn("_zero", zero), [*keys, "_zero"], how)
    return met.drop("_zero")


def merge_join(first: DataFrame, *others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``first`` joined by ``on`` with each of ``others``, tables with a row a segment or so, none of them broadcast.

    Such tables often are below the broadcast threshold each, but a profile joins a score of them, and all that are broadcast are in the
    driver at once. They mostly come from an exchange by their key, so that merging them needs no other.
    """
    for other in others:
        first = first.join(other.hint("merge"), on, how)
    return first
