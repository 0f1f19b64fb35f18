"""Operators on files, frames, prompts and planes of studies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumivox.operators.lattice import filled_slices, run_voxels
from lumivox.operators.masks import KEY, VOX
from lumivox.plans.scratch import tabled


def positioned_frames(files: DataFrame) -> DataFrame:
    """The frames of the files in which every frame has a place; the file's thickness, else one."""
    whole = files.where(F.forall("frames", lambda f: f["z"].isNotNull()))
    return whole.select("file", F.coalesce("shared_thickness", F.lit(1.0)).alias("thickness"), F.inline("frames")).select("file", F.col("number").cast("long").alias("number"), "z", "thickness")


def sidecar_names(sidecars: DataFrame) -> DataFrame:
    """``file, volume, name`` by b-value, repeats numbered; a sidecar with another count than the volumes' isn't used."""
    listed = sidecars.withColumn("b", F.split(F.trim("text"), r"\s+")).where(F.size("b") == F.col("volumes"))
    rows = listed.select("file", F.posexplode("b").alias("volume", "b"))
    same = Window.partitionBy("file", "b")
    nth, n = F.row_number().over(same.orderBy("volume")), F.count("*").over(same)
    return rows.select("file", F.col("volume").cast("long").alias("volume"), F.when(n > 1, F.concat(F.lit("b"), "b", F.lit(" "), nth, F.lit("/"), n)).otherwise(F.concat(F.lit("b"), "b")).alias("name"))


def frame_times(sidecars: DataFrame) -> DataFrame:
    """``file, volume, name, start`` by the frame starts (seconds) of JSON sidecars, a frame a volume; a list of another length than the volumes' isn't used."""
    read = sidecars.withColumn("starts", F.from_json("text", "FrameTimesStart array<double>")["FrameTimesStart"]).where(F.size("starts") == F.col("volumes"))
    rows = read.select("file", F.size("starts").alias("n"), F.posexplode("starts").alias("volume", "start"))
    return rows.select("file", F.col("volume").cast("long").alias("volume"), F.concat_ws("/", F.concat(F.lit("frame "), F.col("volume") + 1), "n").alias("name"), "start")


def members(headers: DataFrame, volumes: DataFrame, series: DataFrame) -> DataFrame:
    """Headers with the series they are of and the volume they belong to; headers of no series are left out. Series are few and joined by their key."""
    return headers.join(series, "series_uid").join(volumes, ["series_uid", "path"])


def not_empty(rows: DataFrame) -> DataFrame:
    """The rows; an error if there is none, as a catalogue that finds nothing is a mistake."""
    if rows.isEmpty():
        raise ValueError("no format finds anything")
    return rows


def rasterised_strokes(strokes: DataFrame, width: int, height: int) -> DataFrame:
    """``id, x, y``: the pixels within ``r`` of each stroke ``x0, y0, x1, y1``; only those of its box are looked at."""
    span = lambda a, b, most: F.sequence(F.greatest(F.lit(0), F.floor(F.least(a, b) - F.col("r"))).cast("int"), F.least(F.lit(most - 1), F.ceil(F.greatest(a, b) + F.col("r"))).cast("int"))
    cells = strokes.withColumn("x", F.explode(span("x0", "x1", width))).withColumn("y", F.explode(span("y0", "y1", height)))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.greatest(((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.nullif(long, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    off = F.pow(F.col("x") - (F.col("x0") + t * dx), F.lit(2)) + F.pow(F.col("y") - (F.col("y0") + t * dy), F.lit(2))
    return cells.where(off <= F.col("r") * F.col("r")).select("id", "x", "y")


#: Crossings of lassos' edges with lines that are worked on at a time, about; one lasso at least.
CROSSINGS = 1 << 20


def lasso_runs(lassos: DataFrame, width: int, height: int) -> DataFrame:
    """``id, y, x0, x1`` (inclusive): the runs of pixels whose centres are inside each lasso's ``corners`` by the even-odd rule.

    A pixel is inside where an odd number of edges cross its line behind it, so a line's crossings in order are the ends of its runs: a row a
    run, and nothing is done for a pixel. Edges with a null corner count for none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = compute.max(compute.list_value_length(batch.column("corners"))).as_py() or 1
            step = max(1, CROSSINGS // (most * height))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                corners = some.column("corners")
                x, y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in corners.flatten().flatten())
                many = compute.fill_null(compute.list_value_length(corners), 0).to_numpy().astype(np.int64)
                held = np.flatnonzero(many)
                first = (np.cumsum(many) - many)[held]
                behind = np.arange(1, len(x) + 1)
                behind[first + many[held] - 1] = first
                bx, by, of = x[behind], y[behind], np.repeat(np.arange(len(many)), many)
                known = np.isfinite(x + y + bx + by)
                low, high = (np.clip(np.ceil(np.where(known, ends(y, by), 0)), 0, height).astype(np.int64) for ends in (np.minimum, np.maximum))
                edge = np.repeat(np.arange(len(x)), high - low)
                line = low[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                place = (bx - x)[edge] * (line - y[edge]) / (by - y)[edge] + x[edge]
                end = np.clip(np.ceil(place), 0, width).astype(np.int64)
                order = np.lexsort((end, line, of[edge]))
                lasso, line, end = of[edge][order], line[order], end[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (lasso[1:] != lasso[:-1]) | (line[1:] != line[:-1])
                sizes = np.diff(np.append(np.flatnonzero(fresh), len(order)))
                rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(order))  # crossings from this one on
                left = np.zeros(len(many), np.int64)
                left[held] = np.clip(np.floor(np.nan_to_num(np.fmin.reduceat(x, first))), 0, width) if len(held) else 0
                start = np.where(fresh, left[lasso], np.concatenate([[0], end[:-1]]) if len(end) else end)
                run = np.flatnonzero((rest % 2 == 1) & (start < end))
                yield pa.record_batch([some.column("id").take(pa.array(lasso[run])), *[pa.array(c[run].astype(np.int32)) for c in (line, start, end - 1)]], names=["id", "y", "x0", "x1"])

    return lassos.select("id", "corners").mapInArrow(scan, f"id {lassos.schema['id'].dataType.simpleString()}, y int, x0 int, x1 int")


def rasterised_lassos(lassos: DataFrame, width: int, height: int) -> DataFrame:
    """``id, x, y``: the pixels of ``lasso_runs``."""
    return lasso_runs(lassos, width, height).select("id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def fill_by_slices(mask: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """The voxels of ``fill_runs_by_slices``, of a mask's voxels."""
    return run_voxels(fill_runs_by_slices(mask.select(*KEY, "j", "k", F.col("i").alias("i0"), F.col("i").alias("i1")), free))


def fill_runs_by_slices(runs: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """Fills what single slices enclose, across i, then j, then k; each pass sees what those before it filled. Only ``free`` voxels (``series_id, i, j, k``) are filled, if given.

    Segments are runs (``KEY, j, k, i0, i1``), and so is what comes back; each filled voxel is a run of its own.
    """
    filled = tabled(runs.select(*KEY, *[F.col(c).cast("int").alias(c) for c in ("j", "k", "i0", "i1")]), "filled")
    for axis in VOX:
        inner = filled_slices(filled, axis)
        inner = inner if free is None else inner.join(free, ["series_id", *VOX], "left_semi")
        filled = tabled(filled.unionByName(inner.select(*KEY, "j", "k", F.col("i").alias("i0"), F.col("i").alias("i1"))), "filled")
    return filled


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows with the fields of their JSON, null where it doesn't read."""
    good = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = [part.split()[0] for part in schema.split(", ")]
    held = rows.withColumn("_parsed", good)
    fields = [F.when(F.col("_parsed._corrupt").isNull(), F.col(f"_parsed.{n}")).alias(n) for n in names]
    return held.select(*[c for c in rows.columns if c != column], *fields)


def revision(fields: list[Column]) -> Column:
    """A hash of an item's fields, for telling whether it has changed since it was reviewed: each field's length in bytes, a colon, and its text."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat(*[part for t in texts for part in (F.octet_length(t).cast("string"), F.lit(":"), t)]), 256)
