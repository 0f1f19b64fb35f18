"""Places of rows within groups of any size: one range exchange and prefix sums over its parts, no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumivox.plans.scratch import written


def laid_out(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` by group and order over all parts, with ``_part`` and ``_at`` (the place in the whole layout, with gaps between parts).

    Rows that agree in all those columns are parted by where they are read, so none of them fills a part. To be written
    before ``placed`` reads it: the places are those of the attempt that was committed.
    """
    keys = [*group, *order, "_salt"]
    spread = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    return spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))


def placed(table: DataFrame, group: list[str], rank: str = "rank", members: str | None = None, most: int = 200_000) -> DataFrame:
    """A written ``laid_out`` table with each row's ``rank`` in its group, from 0 and gapless, and the group's ``members``.

    What is joined has a row for each group in each part, which is parts and groups together at most; it is broadcast
    up to ``most`` rows and shuffled beyond. Null groups are groups.
    """
    counted = table.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counted.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_all")), "starts")
    small = starts.count() <= most
    starts = starts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(group)], F.col("_part").alias("_in"), "_shift", "_all")
    same = F.col("_part") == F.col("_in")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    found = table.join(F.broadcast(starts) if small else starts, same)
    kept = [c for c in table.columns if c not in ("_part", "_at")]
    return found.select(*kept, (F.col("_at") + F.col("_shift")).alias(rank), *([F.col("_all").alias(members)] if members else []))
