"""Structured Streaming jobs over audit entries and arriving headers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumivox.plans.scratch import scratch_path


def command_counts(audit: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Entries and failures of each command in tumbling windows of event time.

    In append mode a window goes out once, when the watermark has passed it, and its state is dropped; entries that come
    for it after that are left out, so state holds the open windows only.
    """
    windowed = audit.withWatermark("time", late).groupBy(F.window("time", every).alias("w"), "command")
    return windowed.agg(F.count("*").alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("failed")).select(F.col("w.start").alias("start"), "command", "n", "failed")


def _frame(rows: list[tuple], columns: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns)).astype(columns)


def change_feed(audit: DataFrame) -> DataFrame:
    """One row a change of an item: ``added`` at its first edit, ``revised`` at later ones, ``reviewed`` where a review that went through changes its state, ``removed`` where it is deleted.

    State is kept for each item that is there (its edits and its last review), so a change is told once, whatever batch it comes in; a
    removed item's state goes, and a later edit adds it anew.
    """
    columns = {"event_id": "int64", "workspace": "int64", "item": "int64", "change": "object"}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        edits, review = state.get if state.exists else (0, "")
        out = []
        rows = pd.concat(list(frames)).sort_values(["time", "event_id"])
        for event, command, ok in zip(rows["event_id"], rows["command"], rows["ok"]):
            if command in ("segment edit", "annotate add"):
                out.append((event, *key, "added" if edits == 0 else "revised"))
                edits += 1
            elif command == "item delete" and edits:
                out.append((event, *key, "removed"))
                edits, review = 0, ""
            elif command.startswith("review ") and ok and command != review:
                out.append((event, *key, "reviewed"))
                review = command
        if edits or review:
            state.update((edits, review))
        elif state.exists:
            state.remove()
        yield _frame(out, columns)

    return audit.groupBy("workspace", "item").applyInPandasWithState(step, "event_id long, workspace long, item long, change string", "edits long, review string", "append", GroupStateTimeout.NoTimeout)


def snapshot_feed(snapshots: DataFrame, parts: int = 4) -> DataFrame:
    """``workspace, snapshot, item, change, status``: what each new snapshot of a workspace has that the one before hadn't, or lacks.

    ``snapshots`` are ``workspace, snapshot, item, content, status``: all the items of a workspace with a hash of their content and their review
    status, and a row without an item for each snapshot, which tells of those that are empty. An item is ``added``; or ``removed``, where a snapshot is without it;
    or ``revised``, where its content is another; and ``reviewed``, also besides, where its status is. The first snapshot of a workspace is what its watch begins
    with and tells nothing. State is the last snapshot, by ``parts`` of each workspace's items, so a large one is spread; a removed item's state goes.
    """
    columns = {"workspace": "int64", "snapshot": "int64", "item": "int64", "change": "object", "status": "object"}
    marks = snapshots.where("item IS NULL").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    items = snapshots.where("item IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        out = []
        rows = pd.concat(list(frames))
        for number, some in rows.groupby("snapshot", sort=True):
            known = some[some["item"].notna()]
            now = {str(int(i)): [c, s] for i, c, s in zip(known["item"], known["content"], known["status"])}
            for item in sorted({*now, *held}, key=int) if held is not None else ():
                was, then = held.get(item), now.get(item)
                told = (int(key[0]), int(number), int(item))
                if then is None:
                    out.append((*told, "removed", was[1]))
                elif was is None:
                    out.append((*told, "added", then[1]))
                else:
                    out += [(*told, "revised", then[1])] * (was[0] != then[0]) + [(*told, "reviewed", then[1])] * (then[1] is not None and was[1] != then[1])
            held = now
        state.update((json.dumps(held),))
        yield _frame(out, columns)

    rows = items.unionByName(marks).groupBy("workspace", "part")
    return rows.applyInPandasWithState(step, "workspace long, snapshot long, item long, change string, status string", "held string", "append", GroupStateTimeout.NoTimeout)


def decisions(entries: DataFrame) -> DataFrame:
    """``event_id, workspace, item, verdict, seen_revision, now_revision`` of every review decision as it comes.

    ``entries`` have a ``revision``: the hash of what an edit makes of its item, and of what a reviewer saw of it. State is an item's revision, which its
    edits bring, and whether it is decided. A decision on an item that nothing was made of is ``unknown``, on another revision than the present one
    ``stale``, on what has been decided ``decided``; of the others those that went through are ``accepted``, and the rest ``failed``. None but the
    accepted one changes anything.
    """
    columns = {"event_id": "int64", "workspace": "int64", "item": "int64", "verdict": "object", "seen_revision": "object", "now_revision": "object"}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, decided = state.get if state.exists else (None, False)
        out = []
        rows = pd.concat(list(frames)).sort_values(["time", "event_id"])
        for event, command, ok, revision in zip(rows["event_id"], rows["command"], rows["ok"], rows["revision"]):
            if command in ("segment edit", "annotate add"):
                now = revision
            elif command.startswith("review "):
                verdict = "unknown" if now is None else "stale" if revision != now else "decided" if decided else "accepted" if ok else "failed"
                out.append((event, *key, verdict, revision, now))
                decided = decided or verdict == "accepted"
        if now is not None:
            state.update((now, decided))
        yield _frame(out, columns)

    told = "event_id long, workspace long, item long, verdict string, seen_revision string, now_revision string"
    return entries.groupBy("workspace", "item").applyInPandasWithState(step, told, "now string, decided boolean", "append", GroupStateTimeout.NoTimeout)


def deferred_changes(polls: DataFrame) -> DataFrame:
    """``workspace, poll, change``: what each poll of a workspace's label map and metadata tells.

    ``polls`` are ``workspace, poll, labels, metadata`` (hashes). A label map that changed without its metadata waits for one poll: if the
    metadata follow, both are told together, else the label map by itself. State is the last told pair, and what waits.
    """
    columns = {"workspace": "int64", "poll": "int64", "change": "object"}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labels, metadata, waiting = state.get if state.exists else (None, None, False)
        out = []
        rows = pd.concat(list(frames)).sort_values("poll")
        for poll, new_labels, new_metadata in zip(rows["poll"], rows["labels"], rows["metadata"]):
            told = ""
            if labels is None:
                labels, metadata = new_labels, new_metadata
                continue
            moved, described = new_labels != labels, new_metadata != metadata
            if described:
                told, waiting = ("labels and metadata" if moved else "metadata"), False
            elif moved and waiting:
                told, waiting = "labels alone", False
            elif moved:
                waiting = True
                continue
            if told:
                out.append((*key, poll, told))
                labels, metadata = new_labels, new_metadata
        state.update((labels, metadata, waiting))
        yield _frame(out, columns)

    return polls.groupBy("workspace").applyInPandasWithState(step, "workspace long, poll long, change string", "labels long, metadata long, waiting boolean", "append", GroupStateTimeout.NoTimeout)


def readable_states(rows: DataFrame) -> DataFrame:
    """``source, version, value, state``: of each version of a source its value if it reads; where it doesn't, ``rejected`` once and the last good value.

    ``rows`` are ``source, version, value``, the value null where it can't be read. Further unreadable versions on end say nothing new.
    """
    columns = {"source": "int64", "version": "int64", "value": "Int64", "state": "object"}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good, bad = state.get if state.exists else (None, False)
        out = []
        rows = pd.concat(list(frames)).sort_values("version")
        for version, value in zip(rows["version"], rows["value"]):
            if pd.isna(value):
                if not bad:
                    out.append((*key, version, good, "rejected"))
                bad = True
            else:
                good, bad = int(value), False
                out.append((*key, version, good, "read"))
        state.update((good, bad))
        yield _frame(out, columns)

    return rows.groupBy("source").applyInPandasWithState(step, "source long, version long, value long, state string", "good long, bad boolean", "append", GroupStateTimeout.NoTimeout)


def arrivals(slices: DataFrame, quiet: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``series_uid, start, images, positions, most, fewest``: a row for the slices of a series that came with no longer pause than ``quiet``, once the watermark has passed it.

    ``slices`` are ``series_uid, position, arrived``. Session windows hold what they count until they are closed, and then nothing: so state follows the series that
    still come in, not all that ever came. Slices that come after their series was closed make a session of their own, which ``completeness`` tells as late.
    """
    sessions = slices.withWatermark("arrived", late).groupBy(F.session_window("arrived", quiet).alias("w"), "series_uid").agg(F.count("*").alias("images"), F.sort_array(F.collect_list("position")).alias("at"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("long").alias("place"), zero.alias("run"), zero.alias("n"), zero.alias("most"), F.lit(1 << 62).cast("long").alias("fewest"))

    def step(a: Column, place: Column) -> Column:
        """The runs of equal places so far, the last of which may go on."""
        same = a["place"] == place
        ended = F.when(same | a["place"].isNull(), a["fewest"]).otherwise(F.least(a["fewest"], a["run"]))
        run = F.when(same, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(place.cast("long").alias("place"), run.alias("run"), F.when(same, a["n"]).otherwise(a["n"] + 1).alias("n"), F.greatest(a["most"], run).alias("most"), ended.alias("fewest"))

    runs = F.aggregate("at", start, step)
    return sessions.select("series_uid", F.col("w.start").alias("start"), "images", runs.alias("r")).select(
        "series_uid", "start", "images", F.col("r.n").alias("positions"), F.col("r.most").alias("most"), F.least("r.fewest", "r.run").alias("fewest"))


def completeness(sessions: DataFrame) -> DataFrame:
    """``series_uid, images, positions, most, complete, late`` of the rows that ``arrivals`` has written: a series by its first session, and how many slices came after that."""
    first = F.min_by(F.struct("images", "positions", "most", "fewest"), "start").alias("f")
    found = sessions.groupBy("series_uid").agg(first, F.sum("images").alias("all"))
    return found.select("series_uid", "f.images", "f.positions", "f.most", (F.col("f.most") == F.col("f.fewest")).alias("complete"), (F.col("all") - F.col("f.images")).alias("late"))


def run_once(stream: DataFrame, folder: str, state: str) -> None:
    """Runs a stream over what has arrived since its last run, and appends what it tells to ``folder``, a table a batch."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def replay(batches: list[DataFrame], step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream tells of batches that arrive one after another, each of as many files as it has partitions; the stream is run again for each and goes on from its state."""
    spark: SparkSession = batches[0].sparkSession
    source, folder = scratch_path(spark, f"{name}-source"), scratch_path(spark, name)
    for batch in batches:
        batch.write.mode("append").parquet(source)
        stream = step(spark.readStream.schema(batches[0].schema).parquet(source))
        run_once(stream, folder, f"{folder}-state")
    return spark.read.schema(stream.schema).parquet(folder).select(*stream.columns)


def ranges(table: DataFrame, order: str, number: int) -> list[DataFrame]:
    """A table in ``number`` parts by even ranges of ``order``."""
    low, high = table.agg(F.min(order), F.max(order)).first()
    if low is None:
        low = high = 0
    place = F.floor((F.col(order) - F.lit(low)) / ((high - low) // number + 1))
    return [table.where(place == n) for n in range(number)]
