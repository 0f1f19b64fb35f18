"""Audit entries, review decisions and states of workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ["workspace", "item"]


def append_audit(entries: DataFrame, folder: str, now: Column | None = None) -> None:
    """Appends entries to a log of JSON lines, a folder a day; an entry without a time has that of the writing."""
    timed = entries.withColumn("time", F.coalesce("time", now if now is not None else F.current_timestamp()))
    timed.withColumn("date", F.to_date("time")).write.mode("append").partitionBy("date").json(folder)


def latest_reviews(audit: DataFrame) -> DataFrame:
    """The state of each reviewed item after its last decision: confirmed or rejected if that went through, else proposed."""
    decided = audit.where(F.col("command").startswith("review "))
    last = decided.groupBy(*ITEM).agg(F.max_by(F.struct("command", "ok", "time"), F.struct("time", "event_id")).alias("d"))
    status = F.when(~F.col("d.ok"), "proposed").when(F.col("d.command") == "review confirm", "confirmed").otherwise("rejected")
    return last.select(*ITEM, status.alias("status"), F.when(F.col("d.ok"), F.col("d.time")).alias("reviewed"))


EDITS = ("segment edit", "annotate add")


def first_valid_decisions(entries: DataFrame) -> DataFrame:
    """Every decision with its verdict and two hashes: what the reviewer saw of the item, and what it was then.

    ``entries`` are audit entries with ``stale``, by how many edits the reviewer's view of the item was behind. The first decision that goes through
    is accepted; those on another revision are refused as stale, later ones as decided, and the others have failed.
    """
    by = Window.partitionBy(*ITEM).orderBy("time", "event_id")
    edits = F.coalesce(F.sum(F.col("command").isin(*EDITS).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = entries.withColumn("now", edits).withColumn("seen", F.greatest(F.lit(0), F.col("now") - F.col("stale"))).where(F.col("command").startswith("review "))
    goes = F.col("ok") & (F.col("seen") == F.col("now"))
    before = F.coalesce(F.max(goes.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    verdict = F.when(F.col("seen") != F.col("now"), "stale").when(before, "decided").when(F.col("ok"), "accepted").otherwise("failed")
    hashed = lambda c: F.sha2(F.concat_ws("/", *ITEM, c), 256).alias(f"{c}_revision")
    return told.select("event_id", *ITEM, "command", verdict.alias("verdict"), hashed("seen"), hashed("now"))


def snapshot(audit: DataFrame, until: str) -> DataFrame:
    """What each item looked like at a time: how often it was edited, and whether it was decided. Items are there from their first edit."""
    seen = audit.where(F.col("time") < F.lit(until).cast("timestamp"))
    edited = F.count(F.when(F.col("command").isin("segment edit", "annotate add"), 1))
    return seen.groupBy(*ITEM).agg(edited.alias("edits"), F.max(F.when(F.col("ok") & F.col("command").startswith("review"), F.col("command"))).alias("review")).where("edits > 0")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row a change between two snapshots: added, removed, revised, reviewed."""
    a = before.select(*ITEM, F.col("edits").alias("edits_a"), F.col("review").alias("review_a"), F.lit(True).alias("a"))
    b = after.select(*ITEM, F.col("edits").alias("edits_b"), F.col("review").alias("review_b"), F.lit(True).alias("b"))
    both = a.join(b, ITEM, "full_outer")
    kinds = F.array_compact(F.array(
        F.when(F.col("a").isNull(), "added"), F.when(F.col("b").isNull(), "removed"),
        F.when(F.col("a") & F.col("b") & (F.col("edits_a") != F.col("edits_b")), "revised"),
        F.when(F.col("a") & F.col("b") & ~F.col("review_a").eqNullSafe(F.col("review_b")), "reviewed"),
    ))
    return both.select(*ITEM, F.explode(kinds).alias("change"))


def command_counts(audit: DataFrame, every: str = "1 day") -> DataFrame:
    """Entries and failures of each command in tumbling windows."""
    return audit.groupBy(F.window("time", every).alias("w"), "command").agg(F.count("*").alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("failed")).select(F.col("w.start").alias("start"), "command", "n", "failed")


def last_entries(audit: DataFrame, most: int, after: int) -> DataFrame:
    """The last ``most`` entries of each workspace behind an entry number, and how many earlier ones are left out."""
    by = Window.partitionBy("workspace")
    ranked = audit.where(F.col("event_id") > after).withColumn("place", F.row_number().over(by.orderBy(F.desc("event_id")))).withColumn("all", F.count("*").over(by))
    return ranked.where(F.col("place") <= most).select("workspace", "event_id", "command", F.greatest(F.lit(0), F.col("all") - most).alias("dropped"))


def state_at(edits: DataFrame, versions: DataFrame) -> DataFrame:
    """The last write of each voxel up to its series' version, cleared voxels left out: what undoing the later edits gives. ``versions`` has one row a series."""
    kept = edits.join(versions.withColumnRenamed("version", "until"), "series_id").where(F.col("version") <= F.col("until"))
    return kept.groupBy("series_id", "vox").agg(F.max_by("label", F.struct("version", "label")).alias("label")).where("label > 0")


def undo(edits: DataFrame, newest: int, most: int = 32) -> DataFrame:
    """``series_id, version``: where each series stands when its ``newest`` edits are undone; no more than ``most`` are kept for it."""
    versions = edits.select("series_id", "version").distinct()
    ranked = versions.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("version"))))
    return ranked.where(F.col("place") == min(newest, most) + 1).select("series_id", "version")
