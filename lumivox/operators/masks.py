"""Measures of segments: masks are tables of their inside voxels, so the work follows the segments, not the grid."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumivox.plans.groups import over_groups
from lumivox.plans.scratch import tabled

KEY = ["series_id", "label"]
VOX = ["i", "j", "k"]
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def size(mask: DataFrame, voxel_mm3: float) -> DataFrame:
    """Voxels and volume of each segment."""
    return mask.groupBy(*KEY).agg(F.count("*").alias("voxels")).withColumn("ml", F.col("voxels") * voxel_mm3 / 1000)


def bounds(mask: DataFrame) -> DataFrame:
    """The half-open box of each segment: ``i0 i1 j0 j1 k0 k1``."""
    return mask.groupBy(*KEY).agg(*[e for a in VOX for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))])


def centroid(mask: DataFrame) -> DataFrame:
    return mask.groupBy(*KEY).agg(*[F.avg(a).alias(f"c{a}") for a in VOX])


def slice_counts(mask: DataFrame) -> DataFrame:
    """``axis, slice, n``: voxels of each slice along the three axes, in one pass over the mask."""
    axes = F.array(*[F.struct(F.lit(n).alias("axis"), F.col(a).alias("slice")) for n, a in (("sagittal", "i"), ("coronal", "j"), ("axial", "k"))])
    return mask.select(*KEY, F.inline(axes)).groupBy(*KEY, "axis", "slice").agg(F.count("*").alias("n"))


def largest_slice(mask: DataFrame) -> DataFrame:
    """Of each axis the slice with the most voxels, counted from one; the first of equals."""
    return slice_counts(mask).groupBy(*KEY, "axis").agg(F.max(F.struct("n", (-F.col("slice")).alias("back"))).alias("m")).select(*KEY, "axis", (1 - F.col("m.back")).alias("slice"), F.col("m.n").alias("n"))


def border(mask: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    """How many sides of the image a segment touches, and whether any."""
    touched = sum((F.max((F.col(a) == 0).cast("int")) + F.max((F.col(a) == n - 1).cast("int")) for a, n in zip(VOX, grid)), F.lit(0))
    return mask.groupBy(*KEY).agg(touched.alias("sides")).withColumn("touches", F.col("sides") > 0)


def covariance(mask: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """The population covariances of the voxel centres in mm."""
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
    return mask.groupBy(*KEY).agg(*[(F.covar_pop(VOX[a], VOX[b]) * spacing[a] * spacing[b]).alias(f"c{VOX[a]}{VOX[b]}") for a, b in pairs])


def axis_lengths(cov: DataFrame) -> DataFrame:
    """Axis lengths (four times the roots of the eigenvalues), elongation and flatness, by the closed form of a symmetric 3 x 3 matrix."""
    off = F.pow("cij", F.lit(2)) + F.pow("cik", F.lit(2)) + F.pow("cjk", F.lit(2))
    q = (F.col("cii") + F.col("cjj") + F.col("ckk")) / 3
    p = F.sqrt((F.pow(F.col("cii") - q, F.lit(2)) + F.pow(F.col("cjj") - q, F.lit(2)) + F.pow(F.col("ckk") - q, F.lit(2)) + 2 * off) / 6)
    step = cov.withColumn("q", q).withColumn("p", p)
    a, b, c = ((F.col(x) - F.col("q")) / F.col("p") for x in ("cii", "cjj", "ckk"))
    d, e, f = (F.col(x) / F.col("p") for x in ("cij", "cik", "cjk"))
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.when(F.col("p") > 0, F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3).otherwise(0.0)
    step = step.withColumn("angle", angle)
    big = F.col("q") + 2 * F.col("p") * F.cos("angle")
    small = F.col("q") + 2 * F.col("p") * F.cos(F.col("angle") + F.lit(2.0943951023931953))
    length = lambda x: 4 * F.sqrt(F.greatest(x, F.lit(0.0)))
    out = step.select(*KEY, length(big).alias("major"), length(3 * F.col("q") - big - small).alias("middle"), length(small).alias("minor"))
    ratio = lambda x: F.when(F.col("major") > 0, F.col(x) / F.col("major"))
    return out.withColumn("elongation", ratio("middle")).withColumn("flatness", ratio("minor"))


def euler_number(mask: DataFrame) -> DataFrame:
    """Corners less edges plus faces less voxels of the closed complex: components less tunnels plus cavities.

    A cell of the complex is a point of the doubled grid; its kind is in its coordinates' parity.
    """
    cells = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    around = F.array(*[F.struct((2 * F.col("i") + a).alias("x"), (2 * F.col("j") + b).alias("y"), (2 * F.col("k") + c).alias("z")) for a, b, c in cells])
    distinct = mask.select(*KEY, F.inline(around)).distinct()
    even = sum((F.when(F.pmod(F.col(x), F.lit(2)) == 0, 1).otherwise(0) for x in "xyz"), F.lit(0))
    return distinct.groupBy(*KEY).agg(F.sum(F.when(even % 2 == 1, -1).otherwise(1)).alias("euler"))


def shifted(mask: DataFrame, offsets: list[tuple[int, int, int]], keep: list[str]) -> DataFrame:
    """A row for each voxel and offset, at the place beside it; ``keep`` names columns that stay."""
    places = F.array(*[F.struct(*[(F.col(a) + o).alias(a) for a, o in zip(VOX, offset)]) for offset in offsets])
    return mask.select(*keep, F.inline(places))


def surface(mask: DataFrame) -> DataFrame:
    """The voxels with a face on the outside (what is beyond the grid is outside)."""
    beside = shifted(mask.select(*KEY, *VOX), FACES, KEY).groupBy(*KEY, *VOX).agg(F.count("*").alias("inside"))
    return mask.select(*KEY, *VOX).join(beside, [*KEY, *VOX], "left").where(F.coalesce("inside", F.lit(0)) < 6).select(*KEY, *VOX)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxels of both, overlap, Dice and Jaccard of two masks of the same segments; 1 where both are empty."""
    both = a.select(*KEY, *VOX, F.lit(1).alias("a")).join(b.select(*KEY, *VOX, F.lit(1).alias("b")), [*KEY, *VOX], "full_outer")
    n = both.groupBy(*KEY).agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("overlap"))
    total = F.col("n_a") + F.col("n_b")
    return n.withColumn("dice", F.when(total > 0, 2 * F.col("overlap") / total).otherwise(1.0)).withColumn("jaccard", F.when(total > 0, F.col("overlap") / (total - F.col("overlap"))).otherwise(1.0))


def distances(a: DataFrame, b: DataFrame, spacing: tuple[float, float, float], on: list[str] = ["series_id"], levels: tuple[int, ...] = (64, 16)) -> DataFrame:  # noqa: B006
    """``KEY, i, j, k, mm, ti, tj, tk``: of each voxel of ``a`` the distance to the nearest of ``b`` that is alike in ``on``, and which that is.

    Both masks are cut into cubes of ``levels`` voxels, each with the box of what is in it. From the coarsest level down a
    source cube keeps the target cubes that may hold the nearest voxel: those no farther at least than another is at most.
    Only the cubes within kept pairs meet on the next level, so far parts never meet. A source cube of the last level gets the voxels of the
    target cubes that it kept, and is compared with them by itself, in blocks: pairs of voxels are never rows. Of equally near
    ones the first in grid order is named. A voxel without any target isn't given.
    """
    source = tabled(a.select(*KEY, *VOX).distinct(), "sources")
    target = tabled(b.select(*on, *VOX).distinct(), "targets")

    def cube(side: str, level: int) -> list[Column]:
        return [F.floor(F.col(x) / level).cast("int").alias(f"{side}{x}") for x in VOX]

    def cubes(rows: DataFrame, key: list[str], level: int, side: str) -> DataFrame:
        return rows.groupBy(*key, *cube(side, level)).agg(*[e for x in VOX for e in (F.min(x).alias(f"{side}{x}0"), F.max(x).alias(f"{side}{x}1"))])

    def far(x: str) -> Column:
        return F.greatest(F.abs(F.col(f"s{x}1") - F.col(f"t{x}0")), F.abs(F.col(f"t{x}1") - F.col(f"s{x}0")))

    def near(x: str) -> Column:
        return F.greatest(F.col(f"t{x}0") - F.col(f"s{x}1"), F.col(f"s{x}0") - F.col(f"t{x}1"), F.lit(0))

    total = lambda f: sum((F.pow(f(x) * s, F.lit(2)) for x, s in zip(VOX, spacing)), F.lit(0.0))
    mine, theirs = [f"s{x}" for x in VOX], [f"t{x}" for x in VOX]
    kept, before = None, None
    for level in levels:
        s, t = cubes(source, KEY, level, "s"), cubes(target, on, level, "t")
        if kept is None:
            pairs = s.join(t, on)
        else:
            up = lambda side: [F.floor(F.col(f"{side}{x}") * level / before).cast("int").alias(f"{side}p{x}") for x in VOX]  # noqa: B023, E731
            above = kept.select(*[c for c in kept.columns if c not in mine + theirs], *[F.col(f"{side}{x}").alias(f"{side}p{x}") for side in "st" for x in VOX])
            pairs = above.join(s.select("*", *up("s")), [*KEY, *[f"sp{x}" for x in VOX]])
            pairs = pairs.join(t.select("*", *up("t")), [*on, *[f"tp{x}" for x in VOX]])
        ranged = pairs.withColumn("near", total(near)).withColumn("most", F.min(total(far)).over(Window.partitionBy(*KEY, *mine)))
        kept = tabled(ranged.where("near <= most").select(*KEY, *[c for c in on if c not in KEY], *mine, *theirs), "cubes")
        before = level
    own = source.select(*KEY, *cube("s", levels[-1]), F.lit(0).alias("side"), *VOX)
    dealt = target.select(*on, *VOX, *cube("t", levels[-1])).join(kept, [*on, *theirs]).select(*KEY, *mine, F.lit(1).alias("side"), *VOX)

    def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        side = table.column("side").to_numpy()
        places = np.stack([table.column(x).to_numpy().astype(np.int32) for x in VOX], axis=1)
        where, d2, found = [], [], []
        for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(side)]):
            middle = start + int(np.searchsorted(side[start:stop], 1))
            if start < middle < stop:
                least, at = _nearest(places[start:middle], places[middle:stop], spacing)
                where.append(np.arange(start, middle))
                d2.append(least)
                found.append(at + middle)
        if where:
            rows, named = pa.array(np.concatenate(where)), pa.array(np.concatenate(found))
            columns = [*[table.column(c).combine_chunks().take(rows) for c in [*KEY, *VOX]], pa.array(np.sqrt(np.concatenate(d2))), *[table.column(x).combine_chunks().take(named) for x in VOX]]
            yield pa.record_batch(columns, names=[*KEY, *VOX, "mm", *theirs])

    rows = own.unionByName(dealt)
    kinds = lambda names, of: "".join(f"{n} {rows.schema[c].dataType.simpleString()}, " for n, c in zip(names, of))
    return over_groups(rows, [*KEY, *mine], ["side", "k", "j", "i"], work, (kinds([*KEY, *VOX], [*KEY, *VOX]) + "mm double, " + kinds(theirs, VOX)).rstrip(", "))


def _nearest(own: np.ndarray, others: np.ndarray, spacing: tuple[float, float, float], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of each place of ``own`` the least squared distance in mm to one of ``others``, and which that is, the first of equals; ``block`` pairs at a time."""
    d2, at = np.empty(len(own)), np.empty(len(own), np.int64)
    step = max(1, block // len(others))
    for i in range(0, len(own), step):
        some = own[i : i + step]
        pairs = np.zeros((len(some), len(others)))
        for x, s in enumerate(spacing):
            off = np.subtract.outer(some[:, x], others[:, x]) * s
            pairs += off * off
        at[i : i + step] = pairs.argmin(axis=1)
        d2[i : i + step] = pairs[np.arange(len(some)), at[i : i + step]]
    return d2, at


def hausdorff(forth: DataFrame, back: DataFrame) -> DataFrame:
    """Hausdorff distance and its 95th percentile (sorted place round((n - 1) * 0.95)), the larger of both directions."""

    def one(d: DataFrame) -> DataFrame:
        by = Window.partitionBy(*KEY)
        ranked = d.withColumn("place", F.row_number().over(by.orderBy("mm")) - 1).withColumn("n", F.count("*").over(by))
        return ranked.groupBy(*KEY).agg(F.max("mm").alias("hd"), F.max(F.when(F.col("place") == F.round((F.col("n") - 1) * 0.95), F.col("mm"))).alias("hd95"))

    return one(forth).unionByName(one(back)).groupBy(*KEY).agg(F.max("hd").alias("hausdorff"), F.max("hd95").alias("hd95"))


def runs(mask: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    """Run lengths of each segment in grid order: ``start, length``."""
    linear = mask.select(*KEY, (F.col("i") + grid[0] * (F.col("j") + grid[1] * F.col("k"))).cast("long").alias("vox"))
    island = F.col("vox") - F.row_number().over(Window.partitionBy(*KEY).orderBy("vox"))
    return linear.withColumn("island", island).groupBy(*KEY, "island").agg(F.min("vox").alias("start"), F.count("*").alias("length")).drop("island")


def from_runs(found: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    """The voxels of run lengths."""
    vox = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("vox"))
    return vox.select(*KEY, (F.col("vox") % grid[0]).cast("int").alias("i"), F.floor(F.col("vox") / grid[0] % grid[1]).cast("int").alias("j"), F.floor(F.col("vox") / (grid[0] * grid[1])).cast("int").alias("k"))


def within_box(rows: DataFrame, a: tuple[int, int, int], b: tuple[int, int, int]) -> DataFrame:
    """Rows in the box of two inclusive corners in any order."""
    return rows.where(F.lit(True) & F.col("i").between(min(a[0], b[0]), max(a[0], b[0])) & F.col("j").between(min(a[1], b[1]), max(a[1], b[1])) & F.col("k").between(min(a[2], b[2]), max(a[2], b[2])))


def cylinder(rows: DataFrame, centre: list[Column], direction: list[Column], spacing: tuple[float, float, float], radius: float, depth: float) -> DataFrame:
    """Rows within ``radius`` mm of a line that runs ``depth`` mm from ``centre`` along a unit ``direction``, and the largest spacing behind it."""
    off = [(F.col(a) - c) * s for a, c, s in zip(VOX, centre, spacing)]
    along = F.round(sum((o * d for o, d in zip(off, direction)), F.lit(0.0)), 9)
    across = sum((o * o for o in off), F.lit(0.0)) - along * along
    return rows.where(along.between(-max(spacing), depth) & (across <= radius * radius + 1e-9))


def oblique_plane(azimuth: float, elevation: float, offset: float) -> tuple[float, float, float, float]:
    """The half space on the far side of a plane whose normal has an azimuth and an elevation in degrees, ``offset`` from the first voxel."""
    a, e = math.radians(azimuth), math.radians(elevation)
    return math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e), -offset


#: Montages have so many tiles by default, about.
TILES = 16


def montage(asked: DataFrame) -> DataFrame:
    """``series_id, slice, tile, reason`` of what is asked: slices ``first`` to ``last`` (from 1) of ``slices``, every ``step`` of them (null: as many as give ``TILES`` tiles or fewer).

    Refused, with a row that says why and slice 0, are slices that aren't there, and more tiles than ``most``.
    """
    span = F.col("last") - F.col("first") + 1
    step = F.greatest(F.lit(1), F.coalesce("step", F.ceil(span / TILES))).cast("int")
    tiles = F.floor((F.col("last") - F.col("first")) / F.col("step")) + 1
    away = (F.col("first") == 0) | (F.col("first") > F.col("last")) | (F.col("last") > F.col("slices"))
    reason = F.when(away, F.concat(F.lit("slices "), "first", F.lit(".."), "last", F.lit(" of "), "slices")).when(tiles > F.col("most"), F.concat(tiles, F.lit(" tiles; at most "), "most")).otherwise("")
    told = asked.withColumn("step", step).withColumn("reason", reason)
    chosen = F.when(F.col("reason") == "", F.sequence(F.col("first").cast("int"), F.col("last").cast("int"), F.col("step"))).otherwise(F.array(F.lit(0)))
    return told.select("series_id", F.posexplode(chosen).alias("at", "slice"), "reason").select("series_id", "slice", F.when(F.col("reason") == "", F.col("at") + 1).otherwise(0).alias("tile"), "reason")


def box_union(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The least box around a key's half-open boxes ``i0 .. k1``; empty ones don't count, and a key of empty boxes has an empty one of zeros."""
    full = F.lit(True)
    for a in VOX:
        full = full & (F.col(f"{a}0") < F.col(f"{a}1"))
    ends = [e for a in VOX for e in (F.coalesce(F.min(F.when(full, F.col(f"{a}0"))), F.lit(0)).alias(f"{a}0"), F.coalesce(F.max(F.when(full, F.col(f"{a}1"))), F.lit(0)).alias(f"{a}1"))]
    return boxes.groupBy(*key).agg(*ends)


def half_spaces(rows: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Rows on the inner side of every plane: n . p + d >= 0."""
    for x, y, z, d in planes:
        rows = rows.where(F.col("i") * x + F.col("j") * y + F.col("k") * z + d >= 0)
    return rows


def in_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Even-odd rule for a point and an array of ``x, y``."""
    n = F.size(corners)
    edge = lambda p, q: (
        ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])
    )
    crossings = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(edge(F.get(corners, i), F.get(corners, (i + 1) % n)), F.lit(False)))
    return F.size(crossings) % 2 == 1


def brick_ranges(voxels: DataFrame, grid: tuple[int, int, int], edge: int = 8) -> DataFrame:
    """Least and largest value of each brick with an apron of one voxel: a voxel counts for every brick whose apron holds it, mostly one."""
    ends = {a: (F.greatest(F.floor((F.col(a) - 1) / edge), F.lit(0)).cast("int"), F.least(F.floor((F.col(a) + 1) / edge), F.lit((n - 1) // edge)).cast("int")) for a, n in zip(VOX, grid)}
    bricks = F.array_distinct(F.array(*[F.struct(*[ends[a][o].alias(f"b{a}") for a, o in zip(VOX, (x, y, z))]) for x in (0, 1) for y in (0, 1) for z in (0, 1)]))
    return voxels.select("series_id", "value", F.inline(bricks)).groupBy("series_id", "bi", "bj", "bk").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def reoriented(rows: DataFrame, orientation: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    """Voxels of stored grids on the canonical one: ``orientation`` has for each series the axis that each stored axis becomes, and whether it is turned.

    It has one row a series; voxels change their coordinates where they are.
    """
    joined = rows.join(orientation, "series_id")
    stored = [F.when(F.get("flip", a), n - 1 - F.col(x)).otherwise(F.col(x)) for a, (x, n) in enumerate(zip(VOX, grid))]
    moved = [F.when(F.get("target", F.lit(0)) == t, stored[0]).when(F.get("target", F.lit(1)) == t, stored[1]).otherwise(stored[2]).alias(x) for t, x in enumerate(VOX)]
    return joined.select(*[c for c in rows.columns if c not in VOX], *moved)


def downsample(voxels: DataFrame, factors: tuple[int, int, int]) -> DataFrame:
    """Rounded box means of stored numbers: (sum + n div 2) div n."""
    cells = [F.floor(F.col(a) / f).cast("int").alias(a) for a, f in zip(VOX, factors)]
    return voxels.groupBy("series_id", *cells).agg(F.sum("stored").alias("s"), F.count("*").alias("n")).select("series_id", *VOX, F.floor((F.col("s") + F.floor(F.col("n") / 2)) / F.col("n")).alias("stored"))


def box_mean(voxels: DataFrame, axis: str, radius: int, value: str = "value") -> DataFrame:
    """Means over ``radius`` voxels to either side along an axis, fewer at the borders."""
    line = [a for a in VOX if a != axis]
    return voxels.withColumn("mean", F.avg(value).over(Window.partitionBy("series_id", *line).orderBy(axis).rangeBetween(-radius, radius)))
