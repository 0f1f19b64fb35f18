"""Surface area and enclosed volume of masks by cubes between voxel centres, and the principal directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.operators.lattice import cell_runs, label_runs, mask_runs, opening, over_bricks, placed_cells, run_voxels
from lumivox.operators.masks import AROUND, KEY, VOX, box_mean, shifted
from lumivox.operators.studies import fill_by_slices
from lumivox.plans.scratch import tabled

#: Corner b of a cube is at (b & 1, b >> 1 & 1, b >> 2 & 1).
CORNERS = np.array([[b & 1, b >> 1 & 1, b >> 2 & 1] for b in range(8)], float)


def _faces() -> list[list[int]]:
    """The corners of the six faces, each anticlockwise as seen from outside."""
    faces = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        for side in (0, 1):
            turn = [(0, 0), (1, 0), (1, 1), (0, 1)] if side else [(0, 0), (0, 1), (1, 1), (1, 0)]
            faces.append([(side << axis) | (a << u) | (b << v) for a, b in turn])
    return faces


def polygons(pattern: int) -> list[list[tuple[int, int]]]:
    """The loops of cut edges that part a cube's inside corners (bits of ``pattern``) from the others, inside on their right.

    On each face a step goes from the edge where the walk round the face leaves the inside to the edge where it
    entered it; where a face has two inside corners across, each is cut off by itself, as its neighbour cube does.
    """
    step = {}
    for face in _faces():
        inside = [bool(pattern >> c & 1) for c in face]
        for n in range(4):
            if not inside[n - 1] and inside[n]:  # enters at edge (n - 1, n)
                m = n
                while inside[(m + 1) % 4]:
                    m = (m + 1) % 4
                step[tuple(sorted((face[m], face[(m + 1) % 4])))] = tuple(sorted((face[n - 1], face[n])))
    loops = []
    while step:
        first = at = min(step)
        loop = []
        while True:
            loop.append(at)
            at = step.pop(at)
            if at == first:
                break
        loops.append(loop)
    return loops


def pattern_table(spacing: tuple[float, float, float]) -> list[tuple[int, float, float, float, float, float]]:
    """For each of the 256 patterns its area, the three parts of its area vector, and its volume moment, at a spacing."""
    rows = []
    for pattern in range(256):
        area, vector, moment = 0.0, np.zeros(3), 0.0
        for loop in polygons(pattern):
            points = [(CORNERS[a] + CORNERS[b]) / 2 * spacing for a, b in loop]
            middle = np.mean(points, axis=0)  # loops aren't flat: triangles go out from their middle
            for p, q in zip(points, points[1:] + points[:1]):
                cross = np.cross(q - middle, p - middle)
                area += np.linalg.norm(cross) / 2
                vector += cross / 2
                moment += middle @ cross / 6
        rows.append((pattern, float(area), *map(float, vector), float(moment)))
    return rows


def mesh(mask: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """``area_mm2, volume_mm3`` and what follows from them: surface by volume, sphericity, compactness, disproportion.

    Every voxel sets its bit in the eight cubes about it; a cube's bits are a pattern that the fixed table of 256 rows
    prices, so no mesh is made and the work is one pre-aggregated shuffle.
    """
    spark = mask.sparkSession
    votes = F.array(*[F.struct(*[(F.col(a) - int(c)).alias(f"c{a}") for a, c in zip(VOX, CORNERS[b])], F.lit(1 << b).alias("bit")) for b in range(8)])
    cubes = mask.select(*KEY, F.inline(votes)).groupBy(*KEY, *[f"c{a}" for a in VOX]).agg(F.bit_or("bit").alias("pattern"))
    table = F.broadcast(spark.createDataFrame(pattern_table(spacing), "pattern int, area double, ax double, ay double, az double, moment double"))
    at = sum((F.col(f"c{a}") * s * F.col(v) for a, s, v in zip(VOX, spacing, ("ax", "ay", "az"))), F.lit(0.0))
    sums = cubes.join(table, "pattern").groupBy(*KEY).agg(F.sum("area").alias("area_mm2"), F.sum(F.col("moment") + at / 3).alias("volume_mm3"))
    a, v = F.col("area_mm2"), F.col("volume_mm3")
    sphericity = F.pow(36 * np.pi * v * v, F.lit(1 / 3)) / a
    return sums.select(*KEY, "area_mm2", "volume_mm3", (a / v).alias("surface_by_volume"), sphericity.alias("sphericity"), F.pow(sphericity, F.lit(3)).alias("compactness_2"), (v / F.sqrt(np.pi * F.pow(a, F.lit(3)))).alias("compactness_1"), (1 / sphericity).alias("disproportion"))


def directions(covariance: DataFrame, same: float = 1e-9) -> DataFrame:
    """``axes``: the unit directions of each segment's axes, the longest first, each with its largest part positive; null where another axis is as long. ``axis`` is the first. One row a segment."""

    @F.pandas_udf("array<array<double>>")
    def turned(*parts: pd.Series) -> pd.Series:
        out = []
        for ii, jj, kk, ij, ik, jk in zip(*parts):
            values, vectors = np.linalg.eigh(np.array([[ii, ij, ik], [ij, jj, jk], [ik, jk, kk]]))
            alike = [abs(values[n] - values[n - 1]) <= same * max(1.0, values[2]) for n in (1, 2)]
            known = [not (alike[1]), not (alike[0] or alike[1]), not alike[0]]
            signed = [vectors[:, n] * np.sign(vectors[np.argmax(np.abs(vectors[:, n])), n]) for n in (2, 1, 0)]
            out.append([list(axis) if there else None for axis, there in zip(signed, known)])
        return pd.Series(out)

    axes = turned("cii", "cjj", "ckk", "cij", "cik", "cjk")
    return covariance.select(*KEY, axes.alias("axes")).withColumn("axis", F.get("axes", 0))


def _box_means(value: np.ndarray, known: np.ndarray, there: np.ndarray, radius: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means of the known values over ``radius`` cells to either side along i, then j, then k (the last axis first), for the cells that are there; and where there is one."""
    for axis, r in zip((2, 1, 0), radius):
        if not r:
            continue
        held, total, n = np.where(known, value, 0.0), np.zeros(value.shape), np.zeros(value.shape)
        size = value.shape[axis]
        for off in range(max(-r, 1 - size), min(r, size - 1) + 1):
            to, at = (tuple(slice(max(0, x), size + min(0, x)) if d == axis else slice(None) for d in range(3)) for x in (-off, off))
            total[to] += held[at]
            n[to] += known[at]
        known = there & (n > 0)
        value = np.divide(total, n, out=np.zeros(value.shape), where=known)
    return value, known


def band_runs(voxels: DataFrame, seeds: DataFrame, radius: list[int], tolerance: float) -> DataFrame:
    """``series_id, j, k, i0, i1, core``: the runs of the free voxels whose smoothed (``core``) or else own value is within the tolerance of their series' level, and of the seeds, which are core whatever they are.

    Values are smoothed over the box of ``radius`` voxels; the level is the median of the smoothed values about the seed, so it is taken from what is near the seed. Voxels are
    dealt into bricks with what the radius reaches around them, and smoothed, compared and made runs there: neither the smoothed values nor the band are rows of voxels.
    """
    start = seeds.select("series_id", *[F.col(a).cast("int").alias(f"s{a}") for a in VOX])
    off = [F.abs(F.col(a) - F.col(f"s{a}")) for a in VOX]
    near = voxels.join(start, "series_id").where((off[0] <= radius[0] + 1) & (off[1] <= radius[1] + 1) & (off[2] <= radius[2] + 1)).drop("label")
    for axis, r in zip(VOX, radius):
        if r:
            near = box_mean(near, axis, r).drop("value").withColumnRenamed("mean", "value")
    ranked = near.where((off[0] <= 1) & (off[1] <= 1) & (off[2] <= 1)).groupBy("series_id").agg(F.sort_array(F.collect_list("value")).alias("v"))  # 27 values at most
    level = tabled(ranked.select("series_id", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("level")), "level")
    places = [F.col(a).cast("int").alias(a) for a in VOX]
    rows = voxels.join(level, "series_id").select("series_id", *places, F.col("value").cast("double").alias("value"), F.coalesce(F.col("label") == 0, F.lit(False)).alias("free"), "level", F.lit(False).alias("seed"))
    none = F.lit(None).cast("double")
    rows = rows.unionByName(seeds.select("series_id", *places, none.alias("value"), F.lit(False).alias("free"), none.alias("level"), F.lit(True).alias("seed")))

    def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        places = np.stack([table.column(a).to_numpy().astype(np.int64) for a in ("k", "j", "i")])
        value, free, level, seed, bj, bk = (table.column(c).to_numpy() for c in ("value", "free", "level", "seed", "bj", "bk"))
        told, out, row = ~np.isnan(value), [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows]):
            found = placed_cells(places[:, a:b], (int(bk[a]), int(bj[a])))
            if found is None:
                continue
            corner, shape, at, own = found
            is_seed = seed[a:b]
            there, raw, known, open_ = (np.zeros(shape, kind) for kind in (bool, float, bool, bool))
            for box, given in ((there, ~is_seed), (raw, value[a:b]), (known, told[a:b]), (open_, free[a:b])):
                box.ravel()[at[~is_seed]] = given[~is_seed]
            wanted = np.nan if is_seed.all() else np.nanmax(level[a:b])
            smooth, smoothed = _box_means(raw, known, there, radius)
            core = open_ & smoothed & (np.abs(smooth - wanted) <= tolerance)
            edge = open_ & known & (np.abs(raw - wanted) <= tolerance) & ~core
            core.ravel()[at[is_seed]] = True
            edge.ravel()[at[is_seed]] = False
            inner = corner + [own[0].start, own[1].start, 0]
            for kind, cells in ((True, core), (False, edge)):
                runs = cell_runs(cells[own], inner)
                out.append(np.concatenate([runs, np.full((1, runs.shape[1]), kind)]))
                row.append(np.full(runs.shape[1], a))
        if out:
            j, k, i0, i1, core = np.concatenate(out, axis=1)
            named = table.column("series_id").combine_chunks().take(pa.array(np.concatenate(row)))
            yield pa.record_batch([named, *[pa.array(c.astype(np.int32)) for c in (j, k, i0, i1)], pa.array(core.astype(bool))], names=["series_id", "j", "k", "i0", "i1", "core"])

    return over_bricks(rows, ["series_id"], (radius[1], radius[2]), work, f"series_id {rows.schema['series_id'].dataType.simpleString()}, j int, k int, i0 int, i1 int, core boolean")


def _with_edges(core: DataFrame, band: DataFrame) -> DataFrame:
    """A grown core and the voxels beside it, by 26 neighbours, that only their own value lets in.

    Those voxels, which are few, look for the core; a core voxel makes no rows for its neighbours.
    """
    outer = band.where("NOT core").select("series_id", *VOX).join(core, ["series_id", *VOX], "left_anti")
    looks = shifted(outer.select("series_id", F.struct(*VOX).alias("own"), *VOX), AROUND, ["series_id", "own"])
    edge = looks.join(core, ["series_id", *VOX], "left_semi").select("series_id", "own.*").distinct()
    return core.withColumn("core", F.lit(True)).unionByName(edge.withColumn("core", F.lit(False)))


def _edge_runs(core: DataFrame, outer: DataFrame) -> DataFrame:
    """The voxels of ``outer`` runs beside a grown core's runs by 26 neighbours, as runs of one voxel; a run looks at its line and the eight around it."""
    lines = F.array(*[F.struct((F.col("j") + dj).alias("lj"), (F.col("k") + dk).alias("lk")) for dj in (-1, 0, 1) for dk in (-1, 0, 1)])
    looks = outer.select("series_id", "j", "k", F.col("i0").alias("o0"), F.col("i1").alias("o1"), F.inline(lines))
    held = core.select("series_id", F.col("j").alias("lj"), F.col("k").alias("lk"), (F.col("i0") - 1).alias("c0"), (F.col("i1") + 1).alias("c1"))
    met = looks.join(held, ["series_id", "lj", "lk"]).where("c0 <= o1 AND c1 >= o0")
    return met.select("series_id", "j", "k", F.explode(F.sequence(F.greatest("o0", "c0"), F.least("o1", "c1"))).alias("i0")).distinct().withColumn("i1", F.col("i0"))


def robust_runs(voxels: DataFrame, seeds: DataFrame, radius: int, tolerance: float) -> DataFrame:
    """``series_id, j, k, i0, i1, core``: growth that noise doesn't stop, as runs; edge voxels are runs of their own. All seeds in one job, one a series.

    The reference is the median of the box-smoothed values about the seed. Core voxels are 6-connected with the seed, which is one whatever its value,
    by smoothed values within the tolerance; edge voxels are beside a core by 26 neighbours and within it by
    their own value alone, and nothing grows from them. Voxels with a label are never taken.
    """
    band = tabled(band_runs(voxels, seeds, [radius] * 3, tolerance), "band")
    start = seeds.select("series_id", *[F.col(a).alias(f"s{a}") for a in VOX])
    pieces = tabled(label_runs(band.where("core").drop("core"), False, ["series_id"]), "pieces")
    held = (F.col("j") == F.col("sj")) & (F.col("k") == F.col("sk")) & F.col("si").between(F.col("i0"), F.col("i1"))
    chosen = pieces.join(start, "series_id").where(held).select("series_id", "piece").distinct()
    core = tabled(pieces.join(chosen, ["series_id", "piece"], "left_semi").drop("piece"), "core")
    return core.withColumn("core", F.lit(True)).unionByName(_edge_runs(core, band.where("NOT core")).withColumn("core", F.lit(False)))


def grow_robust(voxels: DataFrame, seeds: DataFrame, radius: int, tolerance: float) -> DataFrame:
    """``series_id, i, j, k, core``: the voxels of ``robust_runs``."""
    return run_voxels(robust_runs(voxels, seeds, radius, tolerance), "core", key=["series_id"])


#: The most voxels to either side that values are smoothed over.
MOST_SMOOTHED = 6


def grow_region(
    voxels: DataFrame, seeds: DataFrame, spacing: tuple[float, float, float], tolerance: float, most: int, smoothing_mm: float = 1.5, opening_mm: float = 5.0, fill: bool = True, reach: int = 32
) -> tuple[DataFrame, DataFrame]:
    """The region about each seed (``series_id, i, j, k``, one a series), as ``series_id, i, j, k``; and ``series_id, reason`` of the seeds that are refused.

    The whole chain of ``grow_robust`` in millimetres: values are smoothed over as many voxels of each axis as ``smoothing_mm`` holds, what grows is opened at
    the seed by ``opening_mm``, and what its slices enclose is filled where no other label is. Refused are seeds outside the grid, seeds that have a label, and
    regions of more than ``most`` voxels (before they are opened), which have leaked. Growth is bounded: pieces are sought in a box about
    the seed that reaches ``reach`` voxels to either side, and twice as far in each round for those series whose region goes on through its sides and isn't too large yet.
    """
    key = ["series_id"]
    start = seeds.select("series_id", *VOX)
    found = start.join(voxels.select("series_id", *VOX, "label"), ["series_id", *VOX], "left")
    refused = found.where("label IS NULL OR label > 0").select("series_id", F.when(F.col("label").isNull(), "outside the grid").otherwise("has a label").alias("reason"))
    start = tabled(found.where("label = 0").select("series_id", *VOX), "start")
    band = run_voxels(tabled(band_runs(voxels, start, [max(0, min(MOST_SMOOTHED, int(smoothing_mm // max(s, 1e-6)))) for s in spacing], tolerance), "band"), "core", key=key)
    spots = start.select("series_id", *[F.col(a).alias(f"s{a}") for a in VOX])
    waiting, done, large = start.select("series_id"), None, None
    while True:
        inside = F.lit(True)
        for a in VOX:
            inside = inside & F.col(a).between(F.col(f"s{a}") - reach, F.col(f"s{a}") + reach)
        here = spots.join(waiting, key, "left_semi")
        cells = band.where("core").join(here, key).where(inside).select("series_id", *VOX).unionByName(start.join(waiting, key, "left_semi")).distinct()
        runs = tabled(label_runs(mask_runs(cells, key), False, key).join(here, key), "region")
        mine = runs.where((F.col("j") == F.col("sj")) & (F.col("k") == F.col("sk")) & F.col("si").between(F.col("i0"), F.col("i1"))).select("series_id", "piece")
        region = tabled(runs.join(mine, ["series_id", "piece"], "left_semi"), "region")
        side = (F.col("i0") == F.col("si") - reach) | (F.col("i1") == F.col("si") + reach)
        for a in ("j", "k"):
            side = side | (F.abs(F.col(a) - F.col(f"s{a}")) == reach)
        sized = tabled(region.groupBy("series_id").agg(F.sum(F.col("i1") - F.col("i0") + 1).alias("n"), F.bool_or(side).alias("open")), "sizes")
        whole = region.join(sized.where(f"n <= {most} AND NOT open"), key, "left_semi").select("series_id", "j", "k", "i0", "i1")
        leaked = sized.where(f"n > {most}").select("series_id")
        done, large = (whole, leaked) if done is None else (done.unionByName(whole), large.unionByName(leaked))
        waiting = tabled(sized.where(f"n <= {most} AND open").select("series_id"), "waiting")
        if waiting.isEmpty():
            break
        reach *= 2
    grown = tabled(_with_edges(run_voxels(done, key=key).select("series_id", *VOX), band).drop("core"), "grown")
    too = grown.groupBy("series_id").count().where(F.col("count") > most).select("series_id")
    too = tabled(too.unionByName(large), "large")
    out = grown.join(too, key, "left_anti").select("series_id", F.lit(1).alias("label"), *VOX)
    if opening_mm > 0:
        out = opening(tabled(out, "grown"), spacing, opening_mm, start.withColumn("label", F.lit(1)))
    if fill:
        out = fill_by_slices(out, voxels.where("label = 0").select("series_id", *VOX))
    return out.select("series_id", *VOX), refused.unionByName(too.withColumn("reason", F.lit("too large")))
