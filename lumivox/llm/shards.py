"""Operator 12: shards by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.plans.ranks import laid_out, placed

#: Fixed values of jump consistent hashing: the multiplier of its generator, and the numbers that 64 bits hold.
_MULTIPLIER, _WORD = 2862933555777941757, 1 << 64


def _decimal(number: int, digits: int) -> Column:
    return F.lit(str(number)).cast(f"decimal({digits},0)")


def _unsigned(key: Column) -> Column:
    """A 64-bit key as a number without sign."""
    exact = key.cast("decimal(20,0)")
    return F.when(key < 0, exact + _decimal(_WORD, 20)).otherwise(exact).cast("decimal(20,0)")


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a 64-bit integer key, 0 to ``shards`` - 1; a null key is in shard 0.

    From shard b the key jumps to a later one that a generator seeded with the key draws, until it would jump past the last: so one
    more shard takes its share of keys from all the others, and no key moves between those. A jump leads onward
    by one shard at least, so ``shards`` steps are enough; a step after the last jump computes nothing.
    """
    def step(state: Column, _: Column) -> Column:
        drawn = ((state["seed"] * _decimal(_MULTIPLIER, 19) + _decimal(1, 1)) % _decimal(_WORD, 20)).cast("decimal(20,0)")
        upper = F.floor(drawn / _decimal(1 << 33, 10)).cast("double")
        ahead = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (upper + 1))).cast("long")
        jumped = F.struct(drawn.alias("seed"), state["next"].alias("shard"), ahead.alias("next"))
        return F.when(state["next"] < shards, jumped).otherwise(state)

    start = F.struct(_unsigned(key).alias("seed"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"]), F.lit(0)).cast("int")


def write_shards(docs: DataFrame, folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row to ``folder`` as Parquet, a directory a shard (``shard=7``), each shard's rows over several files.

    The shard is the jump hash of the id alone (an integer), so repeated ids are together, and a null id is in shard 0. In a shard rows are in
    order of id (null first), then of the text's hash, then as they are read, whatever the number of partitions. Shards are laid out over all tasks
    by one range exchange, also where one id has a third of all rows. Its sample reads the table once more. Empty and very long texts are
    rows as any other; an empty table gives a folder without rows. All columns are kept but those called ``shard``, ``_part`` and ``_at``, which are
    the operator's.
    """
    if shards < 1:
        raise ValueError("there is no shard")
    own = docs.drop("shard", "_part", "_at", "_id", "_draw")
    keyed = own.withColumn("shard", jump_hash(F.col(id_col).cast("long"), shards)).withColumn("_draw", F.xxhash64(text_col))
    laid_out(keyed, ["shard"], [id_col, "_draw"]).drop("_draw").write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a folder of shards, with ``shard`` and ``slot``: their place in it, from 0 and gapless."""
    return placed(spark.read.parquet(folder), ["shard"], rank="slot")
