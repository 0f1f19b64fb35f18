"""Slice headers into series and volumes: grouping, order, gaps, and the parts of a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumivox.plans.groups import over_groups

#: Places nearer than this to the first of a position are that position.
SAME_POSITION = 1e-4
UID = ["series_uid"]
#: Complex components in the order that volumes are listed in; any other comes after them.
COMPONENTS = ["MAGNITUDE", "PHASE", "REAL", "IMAGINARY", "MIXED"]


def stack_order() -> list[Column]:
    """How images at one position follow one another: eight fields (missing ones last, but a missing isotropic mark first), number, file."""
    last = ("temporal_position", "echo_number", "echo_time", "b_value", "acquisition_number", "trigger_time", "frame_reference_time")
    return [*map(F.asc_nulls_last, last), F.asc_nulls_first("isotropic"), F.asc_nulls_last("instance_number"), F.col("path")]


def stack_fields() -> dict[str, Column]:
    """What can tell volumes apart, as numbers by the letters that name it, in the order that volumes are sorted by."""
    known = F.array(*map(F.lit, COMPONENTS))
    component = F.when(F.col("component").isNotNull(), F.pmod(F.array_position(known, F.upper("component")) - 1 + len(COMPONENTS) + 1, F.lit(len(COMPONENTS) + 1)))
    columns = {"c": component, "t": "temporal_position", "e": "echo_number", "te": "echo_time", "b": "b_value", "tr": "trigger_time", "f": "frame_reference_time", "a": "acquisition_number", "iso": F.col("isotropic").cast("int")}
    return {k: (F.col(v) if isinstance(v, str) else v).cast("double") for k, v in columns.items()}


def with_fallbacks(headers: DataFrame) -> DataFrame:
    """Pixel spacing else imager spacing else that of the functional group else one; a window needs a centre and a width above zero; how values read as grey, which is where nothing is said, too."""
    spacing = F.coalesce("pixel_spacing", "imager_spacing", "group_spacing", F.lit(1.0))
    kind = F.when(F.col("photometric") == "MONOCHROME1", "inverted").when(F.coalesce("photometric", F.lit("MONOCHROME2")) == "MONOCHROME2", "grey").otherwise("colour")
    window = (F.col("window_width") > 0) & F.col("window_center").isNotNull()
    return headers.select(*UID, "path", spacing.alias("spacing"), F.when(window, F.col("window_center")).alias("center"), F.when(window, F.col("window_width")).alias("width"), kind.alias("reading"))


def series_keys(headers: DataFrame) -> DataFrame:
    """The distinct series: identifier, matrix and the tilt rounded to thousandths, with their images."""
    return headers.groupBy(*UID, "matrix", F.round(F.col("tilt") * 1000).cast("long").alias("tilt_key")).agg(F.count("*").alias("images"))


def order_by_position(headers: DataFrame) -> DataFrame:
    """``position`` (from zero) of each header with a place, and ``rank`` among the images there.

    Positions follow the projection on the normal. A place is of the position before it if it is within
    ``SAME_POSITION`` of that position's first place, so small steps don't chain: one scan of each series' images in order of place, many series at a time.
    """
    placed = headers.where("z IS NOT NULL")

    def step(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        z = table.column("z").to_pylist()
        out, new, first, position = [], set(begins.tolist()), 0.0, 0
        for n, place in enumerate(z):
            if n in new:
                first, position = place, 0
            elif place - first >= SAME_POSITION:
                first, position = place, position + 1
            out.append(position)
        for batch in table.append_column("position", pa.array(out, pa.int64())).combine_chunks().to_batches():
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    stepped = over_groups(placed, UID, ["z"], step, f"{fields}, position long")
    return stepped.withColumn("rank", F.row_number().over(Window.partitionBy(*UID, "position").orderBy(*stack_order())))


def gaps(ordered: DataFrame) -> DataFrame:
    """Of each series its positions, most and fewest images at one, upper median gap, and whether any gap is off by more than the larger of 2 % and 0.01."""
    at = ordered.groupBy(*UID, "position").agg(F.min("z").alias("z"), F.count("*").alias("images"))
    gap = at.withColumn("gap", F.col("z") - F.lag("z").over(Window.partitionBy(*UID).orderBy("position")))
    found = gap.groupBy(*UID).agg(F.count("*").alias("positions"), F.min("images").alias("fewest"), F.max("images").alias("most"), F.sort_array(F.collect_list("gap")).alias("gaps"))
    median = F.when(F.size("gaps") > 0, F.element_at("gaps", (F.floor(F.size("gaps") / 2) + 1).cast("int")))
    out = found.withColumn("median", median)
    irregular = F.exists("gaps", lambda g: F.abs(g - F.col("median")) > F.greatest(F.lit(0.01), F.col("median") * 0.02))
    return out.select(*UID, "positions", "fewest", "most", "median", irregular.alias("irregular"))


def order_without_positions(headers: DataFrame) -> DataFrame:
    """For series in which some image has no place, or all have one: by instance number if all have one, else by slice location, else by file.

    ``spacing`` is the upper median gap of the locations they are ordered by, if that is more than nothing, else of the first file that has it the header's spacing between slices
    or thickness, else one. ``stacked`` tells series of images at a single place, whose slice axis is no distance.
    """
    by = Window.partitionBy(*UID)
    lost = headers.withColumn("lost", F.bool_or(F.col("z").isNull()).over(by)).withColumn("width", F.max("z").over(by) - F.min("z").over(by)).withColumn("images", F.count("*").over(by))
    stacked = ~F.col("lost") & (F.col("width") < SAME_POSITION) & (F.col("images") > 1)
    lost = lost.withColumn("stacked", stacked).where(F.col("lost") | F.col("stacked"))
    have = lambda c: F.bool_and(F.col(c).isNotNull()).over(by)
    method = F.when(have("instance_number"), "Instance Number").when(have("slice_location"), "Slice Location").otherwise("file order")
    told = lost.withColumn("method", method)
    key = F.when(F.col("method") == "Instance Number", F.col("instance_number").cast("double")).when(F.col("method") == "Slice Location", F.col("slice_location")).otherwise(F.lit(0.0))
    told = told.withColumn("key", key)
    order = by.orderBy("key", "path")
    placed = told.withColumn("place", F.row_number().over(order)).withColumn("gap", F.when(F.col("method") == "Slice Location", F.col("key") - F.lag("key").over(order)))
    field = F.coalesce("spacing_between_slices", "slice_thickness")
    found = placed.groupBy(*UID).agg(F.sort_array(F.collect_list("gap")).alias("gaps"), F.min_by(field, F.when(field.isNotNull(), F.col("path"))).alias("field"))
    median = F.when(F.size("gaps") > 0, F.element_at("gaps", (F.floor(F.size("gaps") / 2) + 1).cast("int")))
    spacing = found.select(*UID, F.when(median > SAME_POSITION, median).otherwise(F.coalesce("field", F.lit(1.0))).alias("spacing"))
    return placed.join(spacing, UID).select(*UID, "path", F.col("place").cast("long").alias("place"), "method", "spacing", "stacked")


def _plain(x: Column) -> Column:
    """A number as text without a useless fraction."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def volumes(ordered: DataFrame) -> DataFrame:
    """``series_uid, volume, images, complete``: the volumes of each series, by the stack's fields that differ at some position.

    A volume's key has the letters and values of those fields (``x`` for a missing one); where it still has several
    images at a position they are parted by rank there (``-n2``), and so they are where no field differs (``n2``). A series with
    one image a position is one volume, ``all``. All is one pass over the images and windows within positions.
    """
    fields = stack_fields()
    values = ordered.select("*", *[c.alias(f"v_{k}") for k, c in fields.items()])
    at = values.groupBy(*UID, "position").agg(F.count("*").alias("n"), *[(~F.min(f"v_{k}").eqNullSafe(F.max(f"v_{k}")) | F.count(f"v_{k}").between(1, F.count("*") - 1)).alias(f"d_{k}") for k in fields])
    differs = at.groupBy(*UID).agg(F.count("*").alias("positions"), F.max("n").alias("most"), *[F.bool_or(f"d_{k}").alias(f"d_{k}") for k in fields])
    named = values.join(differs, UID)
    key = F.concat_ws("-", *[F.when(F.col(f"d_{k}"), F.concat(F.lit(k), F.coalesce(_plain(F.col(f"v_{k}")), F.lit("x")))) for k in fields])
    keyed = named.select(*UID, "position", "positions", "most", key.alias("key"), F.row_number().over(Window.partitionBy(*UID, "position", key).orderBy(*stack_order())).alias("nth"))
    split = keyed.groupBy(*UID, "key", "nth").agg(F.count("*").alias("images"), F.first("positions").alias("positions"), F.first("most").alias("most"))
    several = F.max("nth").over(Window.partitionBy(*UID, "key")) > 1
    name = F.when(F.col("most") == 1, "all").when(F.col("key") == "", F.concat(F.lit("n"), "nth")).when(several, F.concat("key", F.lit("-n"), "nth")).otherwise(F.col("key"))
    return split.select(*UID, name.alias("volume"), "images", (F.col("images") == F.col("positions")).alias("complete"))
