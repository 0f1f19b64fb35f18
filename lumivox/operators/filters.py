"""Filters of volumes along their axes, and smoothed histograms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumivox.operators.lattice import over_bricks, placed_cells
from lumivox.operators.masks import VOX, box_mean
from lumivox.plans.scratch import written


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian out to three deviations; their sum is one."""
    sigma = max(sigma, 1e-3)
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(x * x) / (2 * sigma * sigma)) for x in range(-reach, reach + 1)]
    return [w / sum(weights) for w in weights]


def convolve(rows: DataFrame, axis: str, made: dict[str, tuple[str, list[float]]], key: list[str] = ["series_id"]) -> DataFrame:  # noqa: B006
    """``key, i, j, k`` and a column for each of ``made``: name -> (column, weights), summed along an axis; the border's value holds beyond it.

    A line of the grid is gathered as an array, in one shuffle whatever the columns and the width, so a voxel's neighbours cost no join.
    """
    line = [*key, *[a for a in VOX if a != axis]]
    taken = sorted({c for c, _ in made.values()})
    packed = rows.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(axis, *taken))).alias("line"))

    def at(place: Column, column: str) -> Column:
        return F.get("line", F.greatest(F.lit(0), F.least(place, F.size("line") - 1)))[column]

    def summed(place: Column, column: str, weights: list[float]) -> Column:
        half = len(weights) // 2
        return sum((at(place + (n - half), column) * w for n, w in enumerate(weights) if w), F.lit(0.0))

    cells = F.transform("line", lambda c, n: F.struct(c[axis].alias(axis), *[summed(n, column, weights).alias(name) for name, (column, weights) in made.items()]))
    return packed.select(*line, F.inline(cells))


def gaussian_smooth(voxels: DataFrame, sigma: float, value: str = "value") -> DataFrame:
    """``smooth``: a Gaussian of ``sigma`` voxels along i, then j, then k."""
    weights, column = gaussian_kernel(sigma), value
    for axis in VOX:
        voxels, column = convolve(voxels, axis, {"smooth": (column, weights)}), "smooth"
    return voxels


def box_smooth(voxels: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """``mean`` over the box of ``radius`` voxels to either side along every axis; what is beyond the grid doesn't count."""
    rows = voxels.select("series_id", *VOX, F.col(value).alias("mean"))
    for axis in VOX:
        rows = box_mean(rows, axis, radius, "mean")
    return rows


def sobel(voxels: DataFrame, value: str = "value") -> DataFrame:
    """``edge``: the size of the gradient by Sobel's kernels in three dimensions, as a share of the series' strongest; the border's value holds beyond it.

    Series are whole boxes; a voxel that isn't there counts as zero and has no edge. They are dealt into bricks of lines with the lines beside them, once for the three axes; a line of sizes is a row until the strongest is known.
    """
    rows = voxels.select("series_id", *[F.col(a).cast("int").alias(a) for a in VOX], F.col(value).cast("double").alias("value"))

    def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        places = np.stack([table.column(a).to_numpy().astype(np.int64) for a in ("k", "j", "i")])
        value, bj, bk = (table.column(c).to_numpy() for c in ("value", "bj", "bk"))
        row, lines, found, held = [], [], [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows]):
            placed = placed_cells(places[:, a:b], (int(bk[a]), int(bj[a])))
            if placed is None:
                continue
            corner, shape, at, own = placed
            grid, there = np.zeros(shape), np.zeros(shape, bool)
            grid.ravel()[at] = value[a:b]
            there.ravel()[at] = True
            wide = np.pad(grid, 1, mode="edge")
            total = np.zeros(shape)
            for axis in range(3):
                slope = wide
                for other in range(3):
                    n, cut = shape[other], lambda lo, x: tuple(slice(lo, lo + x[1]) if d == x[0] else slice(None) for d in range(3))
                    before, here, behind = (slope[cut(lo, (other, n))] for lo in (0, 1, 2))
                    slope = behind - before if other == axis else before + 2.0 * here + behind
                total += slope * slope
            sizes = np.where(there, np.sqrt(total), 0.0)[own]
            z, y = np.meshgrid(*[np.arange(x.start, x.stop) + c for x, c in zip(own, corner)], indexing="ij")
            row.append(np.full(z.size, a))
            lines.append(np.stack([y.ravel(), z.ravel(), np.full(z.size, corner[2])]))
            found.append(sizes.reshape(-1, shape[2]))
            held.append(there[own].ravel())
        if row:
            long = np.concatenate([np.full(len(x), x.shape[1]) for x in found])
            j, k, low = np.concatenate(lines, axis=1).astype(np.int32)
            sizes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)]).astype(np.int32)), pa.array(np.concatenate([x.ravel() for x in found]), mask=~np.concatenate(held)))
            strongest = pa.array(np.concatenate([x.max(axis=1) for x in found]))
            named = table.column("series_id").combine_chunks().take(pa.array(np.concatenate(row)))
            yield pa.record_batch([named, pa.array(j), pa.array(k), pa.array(low), sizes, strongest], names=["series_id", "j", "k", "low", "sizes", "strongest"])

    kind = rows.schema["series_id"].dataType.simpleString()
    lines = written(over_bricks(rows, ["series_id"], (1, 1), work, f"series_id {kind}, j int, k int, low int, sizes array<double>, strongest double"), "lines").hint("merge")
    most = lines.groupBy("series_id").agg(F.max("strongest").alias("most"))  # one row a series
    cells = lines.join(most, "series_id").select("series_id", "j", "k", "low", "most", F.posexplode("sizes").alias("at", "g")).where("g IS NOT NULL")
    return cells.select("series_id", (F.col("low") + F.col("at")).alias("i"), "j", "k", F.when(F.col("most") > 0, F.col("g") / F.col("most")).otherwise(0.0).alias("edge"))


def smoothed_histogram(bins: DataFrame, sigma: float, key: list[str], total: int) -> DataFrame:
    """``key, bin, height`` for every one of ``total`` bins: counts ``n`` smoothed by a Gaussian that is made whole at the ends.

    Each count goes out to the bins that it reaches and is summed there, so no histogram is gathered.
    """
    reach = math.ceil(3 * sigma)
    spread = [math.exp(-(x * x) / (2 * sigma * sigma)) for x in range(-reach, reach + 1)]
    out = F.array(*[F.struct(F.lit(x - reach).alias("off"), F.lit(w).alias("w")) for x, w in enumerate(spread)])
    sent = bins.select(*key, "bin", "n", F.inline(out)).select(*key, (F.col("bin") + F.col("off")).alias("bin"), (F.col("n") * F.col("w")).alias("sum"))
    sums = sent.where(F.col("bin").between(0, total - 1)).groupBy(*key, "bin").agg(F.sum("sum").alias("sum"))
    weight = sum((F.when((F.col("bin") + (x - reach)).between(0, total - 1), w).otherwise(0.0) for x, w in enumerate(spread)), F.lit(0.0))
    dense = bins.select(*key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))).withColumn("bin", F.col("bin").cast("long"))
    return dense.join(sums, [*key, "bin"], "left").select(*key, "bin", F.round(F.coalesce("sum", F.lit(0.0)) / weight, 9).alias("height"))


def peaks(heights: DataFrame, key: list[str]) -> DataFrame:
    """The bins behind the second that are higher than the bin before and no lower than the one behind, the highest ``rank`` first."""
    by = Window.partitionBy(*key).orderBy("bin")
    beside = heights.withColumn("before", F.lag("height").over(by)).withColumn("behind", F.lead("height").over(by))
    found = beside.where((F.col("bin") >= 2) & (F.col("height") > F.col("before")) & (F.col("height") >= F.col("behind")) & (F.col("height") > 0))
    return found.select(*key, "bin", "height", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("height"), "bin")).alias("rank"))
