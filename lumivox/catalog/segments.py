"""Segments and regions: AGG15 to AGG31, JOIN1 to JOIN6, FLT, SET, TOP and WIN7, WIN12 over the cohort's masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox.catalog.intensity import _rounded
from lumivox.functions import grid as G
from lumivox.functions import text as T
from lumivox.operators import filters as X
from lumivox.operators import hull as H
from lumivox.operators import intensity as I
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.plans.joins import merge_join
from lumivox.plans.scratch import tabled
from lumivox.sources import cohort as C

GRID = (C.NX, C.NY, C.NZ)
S = C.SPACING


def _long(df):
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "tinyint", "smallint") else F.col(c) for c, t in df.dtypes])


def _shifted(s, d):
    return C.mask(s, d).withColumn("i", F.col("i") + 1)


def _centroid_mm(s, d):
    c = M.centroid(C.mask(s, d)).join(C.series(s, d), "series_id")
    mm = G.to_patient([F.col("ci"), F.col("cj"), F.col("ck")], [F.col("ox"), F.col("oy"), F.col("oz")], [F.col("sx"), F.col("sy"), F.col("sz")])
    return _rounded(c.select("series_id", "label", "ci", "cj", "ck", mm[0].alias("x"), mm[1].alias("y"), mm[2].alias("z")), 5)


def _probe(s, d):
    points = C.table(s, d, "lineitem").selectExpr(
        "CAST(l_suppkey AS BIGINT) AS series_id", "CAST(l_orderkey % 19 - 9.25D AS DOUBLE) AS x", "CAST(l_partkey % 15 - 7.75D AS DOUBLE) AS y0", "CAST(100 + l_linenumber * 2.3D AS DOUBLE) AS z").distinct()
    at = points.join(C.series(s, d), "series_id").withColumn("y", F.col("y0") + F.col("oy") + 8)
    index = G.to_voxel([F.col("x"), F.col("y"), F.col("z")], [F.col("ox"), F.col("oy"), F.col("oz")], [F.col("sx"), F.col("sy"), F.col("sz")])
    placed = at.select("series_id", "x", "y", "z", G.inside_grid(index, list(GRID)).alias("inside"), *[F.round(v).cast("int").alias(a) for v, a in zip(index, M.VOX)])
    found = placed.join(C.voxels(s, d).select("series_id", *M.VOX, "value"), ["series_id", *M.VOX], "left")
    return _long(found.select("series_id", "x", "y", "z", *M.VOX, "value", F.when(~F.col("inside"), "outside the volume").alias("error")))


def _sphere(s, d):
    d2 = F.pow((F.col("i") - 5) * S[0], F.lit(2)) + F.pow((F.col("j") - 7) * S[1], F.lit(2)) + F.pow((F.col("k") - 5) * S[2], F.lit(2))
    boxed = M.within_box(C.voxels(s, d), (1, 3, 3), (9, 11, 7))
    return I.first_order(I.value_counts(boxed.where(d2 <= 16.0), ["series_id"]), ["series_id"]).select("series_id", "count", "min", "max", F.round("mean", 5).alias("mean"))


def _polygon(s, d):
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((2, 2), (12.5, 3), (10, 12.5), (3, 9))])
    inside = M.in_polygon(F.col("i").cast("double"), F.col("j").cast("double"), corners)
    return C.voxels(s, d).where((F.col("k") == 5) & inside).groupBy("series_id").agg(F.count("*").alias("pixels"), F.round(F.avg("value"), 5).alias("mean"))


def _thirds(s, d):
    v = C.voxels(s, d)
    ends = v.groupBy("series_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    third = F.least(F.lit(2), F.floor((F.col("value") - F.col("lo")) * 3 / (F.col("hi") - F.col("lo")))).cast("long")
    return v.join(ends, "series_id").groupBy("series_id", third.alias("band")).agg(F.count("*").alias("n"))


def _erase(s, d):
    """What a cylinder along an oblique direction leaves; its centre differs by series."""
    m = C.mask(s, d)
    erased = M.cylinder(m, [F.lit(11.0), F.col("series_id") % 4 + 9.0, F.lit(3.0)], [F.lit(0.6), F.lit(0.0), F.lit(0.8)], S, 2.0, 6.0)
    return M.size(m.join(erased.select(*M.KEY, *M.VOX), [*M.KEY, *M.VOX], "left_anti"), 2.0).select(*M.KEY, "voxels")


def _named(s, d):
    """The segments' names: a side in the first, and in every third series a structure of the midline as the second."""
    segments = C.series(s, d).select("series_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("label"))
    side = F.when(F.col("series_id") % 2 == 0, "left kidney").otherwise("Right kidney")
    return segments.select("series_id", "label", F.when(F.col("label") == 1, side).when(F.col("series_id") % 3 == 0, "Spinal_cord").otherwise("mass").alias("name"))


def _laterality(s, d):
    """For segments that name a side: where they lie of the midline structure's centroid, the first in label order, else of the volume's centre."""
    c = merge_join(_centroid_mm(s, d), _named(s, d), on=M.KEY)
    structure = F.lower("name").rlike("spinal_cord|spinal cord|vertebra|sacrum|sternum|spine") & T.named_side(F.col("name")).isNull()
    middle = c.where(structure).groupBy("series_id").agg(F.min_by("x", "label").alias("structure"))
    centre = C.series(s, d).select("series_id", (F.col("ox") + (C.NX - 1) / 2 * F.col("sx")).alias("centre"))
    placed = merge_join(c.join(centre, "series_id"), middle, on="series_id", how="left").withColumn("mid", F.coalesce("structure", "centre")).withColumn("named", T.named_side(F.col("name"))).where("named IS NOT NULL")
    seen = F.when(F.col("x") > F.col("mid"), "left").otherwise("right")
    return placed.select("series_id", "label", "named", seen.alias("observed"), (F.col("named") == seen).alias("consistent"), F.round("mid", 4).alias("midline"))


def _remap(s, d):
    mapping = F.create_map(F.lit(0), F.lit(2), F.lit(1), F.lit(3))  # bands of the value; others are ignored
    band = F.when(F.col("value") > 700, 1).when(F.col("value") > 120, 0).otherwise(5)
    new = F.when((F.col("label") == 0) & mapping[band].isNotNull(), mapping[band]).when(F.col("label") == 1, F.lit(1)).otherwise(F.col("label"))
    return C.voxels(s, d).groupBy("series_id", new.cast("long").alias("new_label")).agg(F.count("*").alias("n"))


def _overlap(s, d):
    value = F.when(F.col("value") > 700, 2).when(F.col("value") > 60, 1)
    return C.voxels(s, d).where(value.isNotNull()).groupBy("series_id", value.cast("long").alias("found")).agg(F.count("*").alias("voxels"), F.count(F.when(F.col("label") > 0, 1)).alias("taken"))


def _upsert(s, d):
    keys = ["series_id", *M.VOX]
    old = C.mask(s, d).where("label = 1").select(*keys, F.lit(1).alias("old"))
    new = M.within_box(C.voxels(s, d), (3, 4, 4), (9, 12, 6)).where("value > 100").select(*keys, F.lit(1).alias("new"))
    boxed = F.col("i").between(3, 9) & F.col("j").between(4, 12) & F.col("k").between(4, 6)
    joined = old.join(new, keys, "full_outer").where(F.col("new").isNotNull() | ~boxed)
    return joined.groupBy("series_id").agg(F.count("*").alias("voxels"), F.count("new").alias("from_new"))


def _profile(s, d):
    """Samples along a line: a sample a least spacing and one more, 2 to 2,000, each the nearest voxel's value."""
    n = F.col("series_id") % 7
    ends = C.series(s, d).select("series_id", F.lit(1.0).alias("x0"), F.lit(14.0).alias("x1"), (n + 2.0).alias("y0"), F.lit(12.0).alias("y1"), F.lit(2.0).alias("z0"), (n + 3.0).alias("z1"))
    length = F.sqrt(sum((F.pow((F.col(f"{a}1") - F.col(f"{a}0")) * m, F.lit(2)) for a, m in zip("xyz", S)), F.lit(0.0)))
    count = F.least(F.greatest(F.ceil(length / min(S)) + 1, F.lit(2)), F.lit(2000))
    steps = ends.withColumn("n", count).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("step"))
    t = F.col("step") / (F.col("n") - 1)
    at = steps.select("series_id", "step", *[F.round(F.col(f"{a}0") + t * (F.col(f"{a}1") - F.col(f"{a}0")), 6).alias(v) for a, v in zip("xyz", M.VOX)])
    at = at.select("series_id", "step", *[F.round(v).cast("int").alias(v) for v in M.VOX])
    return _long(at.join(C.voxels(s, d).select("series_id", *M.VOX, "value"), ["series_id", *M.VOX]).select("series_id", "step", "value"))


def _roi(s, d):
    """The region around prompts: the box of two boxes of which one is empty in some series, 3 mm wider, and what of the volume is in it."""
    n = F.col("series_id")
    ends = C.series(s, d).select("series_id", F.inline(F.array(
        F.struct((n % 5 + 3).alias("i0"), (n % 5 + 7).alias("i1"), F.lit(4).alias("j0"), F.lit(8).alias("j1"), F.lit(2).alias("k0"), (n % 4 + 2).alias("k1")),
        F.struct(F.lit(9).alias("i0"), F.lit(11).alias("i1"), (n % 6).alias("j0"), F.lit(5).alias("j1"), F.lit(5).alias("k0"), F.lit(6).alias("k1")))))
    b = M.box_union(ends, ["series_id"])
    wide = [-(-3 // m) for m in S]
    lo = lambda a, w: F.greatest(F.lit(0), F.col(f"{a}0") - int(w)).alias(f"{a}0")
    hi = lambda a, w, g: F.least(F.lit(g), F.col(f"{a}1") + int(w)).alias(f"{a}1")
    box = b.select("series_id", *[e for a, w, g in zip(M.VOX, wide, GRID) for e in (lo(a, w), hi(a, w, g))])
    inside = [(F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in M.VOX]
    crop = C.voxels(s, d).join(box, "series_id").where(inside[0] & inside[1] & inside[2])
    names = [f"{a}{e}" for a in M.VOX for e in (0, 1)]
    origin = C.series(s, d).select("series_id", "ox", "oy", "oz")
    summed = crop.groupBy("series_id", *names).agg(F.count("*").alias("voxels"), F.sum("value").alias("total")).join(origin, "series_id")
    return _long(summed.select("series_id", *names, "voxels", "total", *[(F.col(o) + F.col(f"{a}0") * m).alias(o) for o, a, m in zip(("ox", "oy", "oz"), M.VOX, S)]))


def _trilinear(s, d):
    """The value between voxels, and its slope along each axis by central differences a voxel to either side, as steps of the value."""
    n = F.col("series_id")
    at = C.series(s, d).select("series_id", (n % 7 + 3.25).alias("x"), (n % 5 + 4.5).alias("y"), (n % 6 + 2.75).alias("z"))
    steps = [("value", 0.0, 0.0, 0.0), *[(f"{a}{sign}", *(1.0 * o * (b == a) for b in "xyz")) for a in "xyz" for sign, o in (("+", 1), ("-", -1))]]
    shifted = F.array(*[F.struct(F.lit(name).alias("what"), F.lit(float(x)).alias("ax"), F.lit(float(y)).alias("ay"), F.lit(float(z)).alias("az")) for name, x, y, z in steps])
    points = at.select("series_id", "x", "y", "z", F.inline(shifted)).select("series_id", "what", *[(F.col(p) + F.col(f"a{p}")).alias(p) for p in "xyz"])
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    w = lambda p, o: F.when(F.col(o) == 1, F.col(p) - F.floor(p)).otherwise(1 - (F.col(p) - F.floor(p)))
    eight = points.select("*", F.inline(corners)).withColumn("w", w("x", "a") * w("y", "b") * w("z", "c"))
    placed = eight.select("series_id", "what", "w", *[F.least(F.floor(p) + F.col(o), F.lit(m - 1)).cast("int").alias(v) for p, o, m, v in zip("xyz", "abc", GRID, M.VOX)])
    sampled = placed.join(C.voxels(s, d).select("series_id", *M.VOX, "value"), ["series_id", *M.VOX]).groupBy("series_id", "what").agg(F.sum(F.col("w") * F.col("value")).alias("v"))
    one = lambda name: F.max(F.when(F.col("what") == name, F.col("v")))
    return _rounded(sampled.groupBy("series_id").agg(one("value").alias("value"), *[(one(f"{a}+") - one(f"{a}-")).alias(f"g{a}") for a in "xyz"]))


def _hausdorff(s, d):
    a, b = tabled(M.surface(C.mask(s, d)), "surface"), tabled(M.surface(_shifted(s, d)), "surface")
    return _rounded(M.hausdorff(M.distances(a, b, S, M.KEY), M.distances(b, a, S, M.KEY)))


def _gap(s, d):
    """From the box to the outer surface of the ball with its hole filled: millimetres, the voxels at either end, and whether the box is within."""
    a = C.mask(s, d).where("label = 2")
    filled = tabled(N.fill_holes(C.mask(s, d).where("label = 1")), "filled")
    near = M.distances(a, M.surface(filled), S)
    order = F.struct("mm", "k", "j", "i")
    ends = near.groupBy("series_id").agg(F.min_by(F.struct(*M.VOX, "ti", "tj", "tk", "mm"), order).alias("m"))
    beyond = a.join(filled.select("series_id", *M.VOX), ["series_id", *M.VOX], "left_anti").select("series_id").distinct().withColumn("beyond", F.lit(True))
    return _long(ends.join(beyond, "series_id", "left").select("series_id", F.round("m.mm", 6).alias("gap_mm"), *[F.col(f"m.{c}").alias(c) for c in (*M.VOX, "ti", "tj", "tk")], F.col("beyond").isNull().alias("inside")))


def _stored(s, d):
    return C.voxels(s, d).withColumn("stored", G.to_storage(F.col("value"), F.lit(-1000.0), F.lit(1000.0)))


def _montage(s, d):
    """Montages of stacks of 36 slices: from and to, and for some series the step, as asked; refused where the slices aren't there or the tiles are too many. Tiles have the slice's total."""
    n = F.col("series_id")
    first, last = F.when(n % 9 == 8, 0).otherwise(n % 5 + 1), F.when(n % 9 == 7, 40).otherwise(36 - n % 4)
    asked = C.series(s, d).select("series_id", first.alias("first"), last.alias("last"), F.when(n % 3 == 0, n % 4).alias("step"), F.lit(3 * C.NZ).alias("slices"), F.when(n % 2 == 0, 64).otherwise(12).alias("most"))
    tiles = M.montage(asked)
    stack = C.voxels(s, d).select("series_id", "k", "value", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")).select("series_id", (F.col("k") + C.NZ * F.col("n") + 1).alias("slice"), (F.col("value") + F.col("n")).alias("value"))
    totals = stack.join(tiles.where("reason = ''").select("series_id", "slice"), ["series_id", "slice"], "left_semi").groupBy("series_id", "slice").agg(F.sum("value").alias("total"))
    return _long(tiles.join(totals, ["series_id", "slice"], "left").select("series_id", "slice", "tile", F.coalesce("total", F.lit(0.0)).alias("total"), "reason"))


def _projections(s, d):
    """Largest values along each of the three axes, from one pass over the voxels."""
    views = F.array(*[F.struct(F.lit(n).alias("along"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in (("k", "i", "j"), ("j", "i", "k"), ("i", "j", "k"))])
    return _long(C.voxels(s, d).select("series_id", "value", F.inline(views)).groupBy("series_id", "along", "a", "b").agg(F.max("value").alias("value")))


def _slices(s, d):
    """The middle slice of each plane, head up where the plane stands, with 8-bit grey of the soft-tissue window."""
    v = C.voxels(s, d)
    planes = (("axial", "k", F.col("i"), F.col("j")), ("coronal", "j", F.col("i"), C.NZ - 1 - F.col("k")), ("sagittal", "i", F.col("j"), C.NZ - 1 - F.col("k")))
    cells = [F.when(F.col(axis) == n // 2, F.struct(F.lit(name).alias("plane"), px.alias("px"), py.alias("py"))) for (name, axis, px, py), n in zip(planes, reversed(GRID))]
    grey = G.grey(G.window_level(F.col("value"), F.lit(50.0), F.lit(400.0)))
    return _long(v.select("series_id", "value", grey.alias("grey"), F.inline(F.array_compact(F.array(*cells)))))


def _regions(s, d):
    """Statistics of many regions in one job: a box, a sphere, a segment, a segment within the box, and a polygon's pixels on a slice."""
    v = C.voxels(s, d)
    boxed = F.col("i").between(3, 12) & F.col("j").between(3, 12) & F.col("k").between(2, 6)
    d2 = F.pow((F.col("i") - 5) * S[0], F.lit(2)) + F.pow((F.col("j") - 7) * S[1], F.lit(2)) + F.pow((F.col("k") - 5) * S[2], F.lit(2))
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((2.0, 2.0), (12.5, 3.0), (10.0, 12.5), (3.0, 9.0))])
    area = (F.col("k") == 5) & M.in_polygon(F.col("i").cast("double"), F.col("j").cast("double"), corners)
    kinds = [(boxed, F.lit("box")), (d2 <= 16.0, F.lit("sphere")), (F.col("label") > 0, F.concat(F.lit("segment "), "label")), (boxed & (F.col("label") > 0), F.concat(F.lit("in box "), "label")), (area, F.lit("area"))]
    tagged = v.select("series_id", "value", F.explode(F.array(*[F.when(where, name) for where, name in kinds])).alias("region")).where("region IS NOT NULL")  # no array_compact: it isn't compiled, nor what is in it
    counts = tabled(I.value_counts(tagged, ["series_id", "region"]), "counts")
    key = ["series_id", "region"]
    stats = I.first_order(counts, key).join(I.percentiles(counts, key, [0.05, 0.5, 0.95]), key)
    return _rounded(stats.select(*key, "count", (F.col("count") * 2.0 / 1000).alias("ml"), "mean", "std", "min", "max", "p5", "p50", "p95"), 5)


QUERIES = {
    "agg15_volume": lambda s, d: _rounded(M.size(C.mask(s, d), 2.0)),
    "agg16_label_histogram": lambda s, d: C.voxels(s, d).groupBy("series_id", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n")),
    "agg17_bounds": lambda s, d: _long(M.bounds(C.mask(s, d))),
    "agg18_prj09_centroid": lambda s, d: _long(_centroid_mm(s, d)),
    "agg19_slice_counts": lambda s, d: _long(M.slice_counts(C.mask(s, d))),
    "agg20_axis_lengths": lambda s, d: _rounded(M.axis_lengths(M.covariance(C.mask(s, d), S)), 4),
    "agg24_euler_number": lambda s, d: _long(M.euler_number(C.mask(s, d))),
    "agg25_border": lambda s, d: _long(M.border(C.mask(s, d), GRID)),
    "agg26_join02_agreement": lambda s, d: _rounded(M.agreement(C.mask(s, d), _shifted(s, d))),
    "agg27_join05_hausdorff": _hausdorff,
    "agg28_brick_ranges": lambda s, d: _long(M.brick_ranges(C.voxels(s, d), GRID)),
    "agg29_brick_pruning": lambda s, d: _long(M.brick_ranges(C.voxels(s, d), GRID).select("series_id", "bi", "bj", "bk", F.when(F.col("high") >= 820, 255).otherwise(0).alias("visible"))),
    "agg30_downsample": lambda s, d: _long(M.downsample(_stored(s, d), (2, 2, 3))),
    "agg31_projection": _projections,
    "agg32_region_statistics": _regions,
    "agg34_overlap": _overlap,
    "agg35_slices_with_labels": lambda s, d: _long(C.mask(s, d).select("series_id", "label", "k").distinct()),
    "flt01_set03_box": lambda s, d: _long(M.size(M.within_box(C.mask(s, d), (12, 12, 6), (3, 3, 2)), 2.0).select(*M.KEY, "voxels")),
    "flt02_sphere": _sphere,
    "flt03_polygon": _polygon,
    "flt04_solid_part": lambda s, d: _long(C.mask(s, d).groupBy(*M.KEY).agg(F.count(F.when(F.col("value") >= 110, 1)).alias("solid"), F.count(F.when(F.col("value").between(80, 120), 1)).alias("band"))),
    "flt05_half_spaces": lambda s, d: _long(M.size(M.half_spaces(C.mask(s, d), [(1.0, 0.0, 0.0, -4.0), (0.0, -1.0, 0.5, 9.0), M.oblique_plane(60.0, 30.0, 5.1)]), 2.0).select(*M.KEY, "voxels")),
    "flt06_set02_erase": lambda s, d: _long(_erase(s, d)),
    "flt07_thirds": _thirds,
    "geo06_trilinear": _trilinear,
    "join01_segment_values": lambda s, d: _long(C.mask(s, d).select("series_id", "label", *M.VOX).join(C.voxels(s, d).select("series_id", *M.VOX, "value"), ["series_id", *M.VOX])),
    "join03_containment": lambda s, d: _long(C.mask(s, d).groupBy(*M.KEY).agg(F.count("*").alias("n")).join(M.within_box(C.mask(s, d), (0, 0, 0), (13, 13, 9)).groupBy(*M.KEY).agg(F.count("*").alias("m")), M.KEY, "left").select(*M.KEY, (F.col("n") == F.coalesce("m", F.lit(0))).alias("within"))),
    "join04_surface": lambda s, d: _long(M.surface(C.mask(s, d))),
    "join06_gap": _gap,
    "join07_prj10_probe": _probe,
    "join08_profile": _profile,
    "join09_label_mapping": _remap,
    "join10_upsert": _upsert,
    "join11_laterality": lambda s, d: _long(_laterality(s, d)),
    "join16_region_of_interest": _roi,
    "set01_union": lambda s, d: _long(C.mask(s, d).select(*M.KEY, *M.VOX).union(_shifted(s, d).select(*M.KEY, *M.VOX)).distinct().groupBy(*M.KEY).agg(F.count("*").alias("voxels"))),
    "top01_largest_slice": lambda s, d: _long(M.largest_slice(C.mask(s, d))),
    "top03_top04_axial_axes": lambda s, d: _rounded(H.axial_axes(C.mask(s, d), S).drop("i0", "j0", "i1", "j1"), 4),
    "top05_max_diameter": lambda s, d: _rounded(H.max_diameter(C.mask(s, d), S)),
    "geo04_hull": lambda s, d: _rounded(H.convex_hull(C.mask(s, d), S).drop("corners"), 2),
    "top06_montage": _montage,
    "top07_slices": _slices,
    "win07_box_mean": lambda s, d: _long(_rounded(X.box_smooth(C.voxels(s, d), 2))),
    "win12_runs": lambda s, d: _long(M.runs(C.mask(s, d), GRID)),
    "win12_runs_decoded": lambda s, d: _long(M.from_runs(M.runs(C.mask(s, d), GRID), GRID)),
}

W = f"WITH {C.VOXELS_SQL}"
L = "series_id, CAST(label AS BIGINT) AS label"
IJK = "CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k"
B8 = "e AS (SELECT series_id, max(i) // 8 AS li, max(j) // 8 AS lj, max(k) // 8 AS lk FROM voxels GROUP BY 1), b AS (SELECT v.series_id, CAST(x.b AS BIGINT) AS bi, CAST(y.b AS BIGINT) AS bj, CAST(z.b AS BIGINT) AS bk, min(value) AS low, max(value) AS high FROM voxels v JOIN e ON v.series_id = e.series_id, range(2) AS x(b), range(2) AS y(b), range(2) AS z(b) WHERE x.b <= li AND y.b <= lj AND z.b <= lk AND i BETWEEN x.b*8-1 AND x.b*8+8 AND j BETWEEN y.b*8-1 AND y.b*8+8 AND k BETWEEN z.b*8-1 AND z.b*8+8 GROUP BY ALL)"
_SURFACE = lambda name, source: f"{name} AS (SELECT m.series_id, m.label, m.i, m.j, m.k FROM {source} m LEFT JOIN {source} n ON n.series_id = m.series_id AND n.label = m.label AND n.i BETWEEN m.i-1 AND m.i+1 AND n.j BETWEEN m.j-1 AND m.j+1 AND n.k BETWEEN m.k-1 AND m.k+1 AND abs(n.i-m.i)+abs(n.j-m.j)+abs(n.k-m.k) = 1 GROUP BY ALL HAVING count(n.i) < 6)"
_POLYGON = """p(n, x, y) AS (VALUES (0, 2.0, 2.0), (1, 12.5, 3.0), (2, 10.0, 12.5), (3, 3.0, 9.0)), g AS (SELECT DISTINCT i, j FROM voxels),
    c AS (SELECT i, j, count(*) AS crossings FROM g, p a JOIN p b ON b.n = (a.n + 1) % 4 WHERE (a.y > j) <> (b.y > j) AND i < (b.x - a.x) * (j - a.y) / (b.y - a.y) + a.x GROUP BY ALL)"""
_AT = lambda q: f"max(CASE WHEN place = round((total - 1) * {q}) THEN value END)"
_D2 = "((a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j) + 4*(a.k-b.k)*(a.k-b.k))"

ORACLE_SQL = {
    "agg15_volume": f"{W} SELECT {L}, count(*) AS voxels, round(count(*) * 2.0 / 1000, 6) AS ml FROM mask GROUP BY ALL",
    "agg16_label_histogram": f"{W} SELECT {L}, count(*) AS n FROM voxels GROUP BY ALL",
    "agg17_bounds": f"{W} SELECT {L}, CAST(min(i) AS BIGINT) AS i0, CAST(max(i)+1 AS BIGINT) AS i1, CAST(min(j) AS BIGINT) AS j0, CAST(max(j)+1 AS BIGINT) AS j1, CAST(min(k) AS BIGINT) AS k0, CAST(max(k)+1 AS BIGINT) AS k1 FROM mask GROUP BY ALL",
    "agg18_prj09_centroid": f"{W}, c AS (SELECT series_id, label, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM mask GROUP BY ALL) SELECT c.series_id, CAST(label AS BIGINT) AS label, round(ci, 5) AS ci, round(cj, 5) AS cj, round(ck, 5) AS ck, round(ox + ci*sx, 5) AS x, round(oy + cj*sy, 5) AS y, round(oz + ck*sz, 5) AS z FROM c JOIN series s ON s.series_id = c.series_id",
    "agg19_slice_counts": f"{W} SELECT {L}, 'sagittal' AS axis, CAST(i AS BIGINT) AS slice, count(*) AS n FROM mask GROUP BY ALL UNION ALL SELECT {L}, 'coronal', CAST(j AS BIGINT), count(*) FROM mask GROUP BY ALL UNION ALL SELECT {L}, 'axial', CAST(k AS BIGINT), count(*) FROM mask GROUP BY ALL",
    "agg20_axis_lengths": f"""{W}, c AS (SELECT series_id, label, covar_pop(i, i) AS a, covar_pop(j, j) AS b, 4*covar_pop(k, k) AS c, covar_pop(i, j) AS d, 2*covar_pop(i, k) AS e, 2*covar_pop(j, k) AS f FROM mask GROUP BY ALL),
        q AS (SELECT *, (a+b+c)/3 AS q FROM c), p AS (SELECT *, sqrt(((a-q)**2 + (b-q)**2 + (c-q)**2 + 2*(d*d+e*e+f*f)) / 6) AS p FROM q),
        t AS (SELECT *, acos(least(greatest(((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (2*p**3), -1), 1)) / 3 AS t FROM p),
        l AS (SELECT series_id, label, q, q + 2*p*cos(t) AS hi, q + 2*p*cos(t + 2.0943951023931953) AS lo FROM t), m AS (SELECT series_id, label, 4*sqrt(hi) AS major, 4*sqrt(3*q-hi-lo) AS middle, 4*sqrt(lo) AS minor FROM l)
        SELECT {L}, round(major, 4) AS major, round(middle, 4) AS middle, round(minor, 4) AS minor, round(middle/major, 4) AS elongation, round(minor/major, 4) AS flatness FROM m""",
    "agg24_euler_number": f"{W}, c AS (SELECT DISTINCT series_id, label, 2*i+x.o AS x, 2*j+y.o AS y, 2*k+z.o AS z FROM mask, range(-1, 2) AS x(o), range(-1, 2) AS y(o), range(-1, 2) AS z(o)) SELECT {L}, CAST(sum(CASE WHEN (abs(x)+abs(y)+abs(z)) % 2 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS euler FROM c GROUP BY ALL",
    "agg25_border": f"{W} SELECT {L}, CAST(max(CAST(i=0 AS INT)) + max(CAST(i=15 AS INT)) + max(CAST(j=0 AS INT)) + max(CAST(j=15 AS INT)) + max(CAST(k=0 AS INT)) + max(CAST(k=11 AS INT)) AS BIGINT) AS sides, bool_or(i=0 OR i=15 OR j=0 OR j=15 OR k=0 OR k=11) AS touches FROM mask GROUP BY ALL",
    "agg26_join02_agreement": f"{W}, o AS (SELECT series_id, label, count(*) AS n FROM mask GROUP BY ALL), b AS (SELECT a.series_id, a.label, count(*) AS overlap FROM mask a JOIN mask b ON a.series_id = b.series_id AND a.label = b.label AND a.i = b.i+1 AND a.j = b.j AND a.k = b.k GROUP BY ALL) SELECT o.series_id, CAST(o.label AS BIGINT) AS label, n AS n_a, n AS n_b, coalesce(overlap, 0) AS overlap, round(2.0*coalesce(overlap, 0)/(2*n), 6) AS dice, round(1.0*coalesce(overlap, 0)/(2*n-coalesce(overlap, 0)), 6) AS jaccard FROM o LEFT JOIN b ON o.series_id = b.series_id AND o.label = b.label",
    "agg27_join05_hausdorff": f"""{W}, b0 AS (SELECT series_id, label, i+1 AS i, j, k FROM mask), {_SURFACE('a', 'mask')}, {_SURFACE('b', 'b0')},
        f AS (SELECT a.series_id, a.label, a.i, a.j, a.k, sqrt(min({_D2})) AS mm FROM a JOIN b ON a.series_id = b.series_id AND a.label = b.label GROUP BY ALL), g AS (SELECT b.series_id, b.label, b.i, b.j, b.k, sqrt(min({_D2})) AS mm FROM a JOIN b ON a.series_id = b.series_id AND a.label = b.label GROUP BY ALL),
        u AS (SELECT 1 AS way, * FROM f UNION ALL SELECT 2, * FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY series_id, label, way ORDER BY mm) - 1 AS place, count(*) OVER (PARTITION BY series_id, label, way) AS n FROM u)
        SELECT {L}, round(max(mm), 6) AS hausdorff, round(max(CASE WHEN place = round((n-1)*0.95) THEN mm END), 6) AS hd95 FROM r GROUP BY ALL""",
    "agg28_brick_ranges": f"{W}, {B8} SELECT * FROM b",
    "agg29_brick_pruning": f"{W}, {B8} SELECT series_id, bi, bj, bk, CAST(CASE WHEN high >= 820 THEN 255 ELSE 0 END AS BIGINT) AS visible FROM b",
    "agg30_downsample": f"{W}, s AS (SELECT *, CAST(least(greatest(round((value + 1000) / (2000.0 / 65535)), 0), 65535) AS BIGINT) AS stored FROM voxels) SELECT series_id, CAST(i // 2 AS BIGINT) AS i, CAST(j // 2 AS BIGINT) AS j, CAST(k // 3 AS BIGINT) AS k, CAST((sum(stored) + count(*) // 2) // count(*) AS BIGINT) AS stored FROM s GROUP BY ALL",
    "agg31_projection": f"{W} SELECT series_id, 'k' AS along, CAST(i AS BIGINT) AS a, CAST(j AS BIGINT) AS b, max(value) AS value FROM voxels GROUP BY ALL UNION ALL SELECT series_id, 'j', CAST(i AS BIGINT), CAST(k AS BIGINT), max(value) FROM voxels GROUP BY ALL UNION ALL SELECT series_id, 'i', CAST(j AS BIGINT), CAST(k AS BIGINT), max(value) FROM voxels GROUP BY ALL",
    "agg32_region_statistics": f"""{W}, {_POLYGON}, b AS (SELECT *, i BETWEEN 3 AND 12 AND j BETWEEN 3 AND 12 AND k BETWEEN 2 AND 6 AS boxed FROM voxels),
        u AS (SELECT series_id, 'box' AS region, value FROM b WHERE boxed UNION ALL SELECT series_id, 'sphere', value FROM b WHERE (i-5)*(i-5)+(j-7)*(j-7)+4*(k-5)*(k-5) <= 16 UNION ALL SELECT series_id, 'segment ' || label, value FROM b WHERE label > 0
        UNION ALL SELECT series_id, 'in box ' || label, value FROM b WHERE label > 0 AND boxed UNION ALL SELECT series_id, 'area', value FROM b JOIN c ON b.i = c.i AND b.j = c.j WHERE k = 5 AND crossings % 2 = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY series_id, region ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY series_id, region) AS total FROM u)
        SELECT series_id, region, count(*) AS count, round(CAST(count(*) * 2.0 / 1000 AS DOUBLE), 5) AS ml, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS min, max(value) AS max, {_AT(0.05)} AS p5, {_AT(0.5)} AS p50, {_AT(0.95)} AS p95 FROM r GROUP BY ALL""",
    "agg34_overlap": f"{W} SELECT series_id, CAST(CASE WHEN value > 700 THEN 2 ELSE 1 END AS BIGINT) AS found, count(*) AS voxels, count(*) FILTER (WHERE label > 0) AS taken FROM voxels WHERE value > 60 GROUP BY ALL",
    "agg35_slices_with_labels": f"{W} SELECT DISTINCT {L}, CAST(k AS BIGINT) AS k FROM mask",
    "flt01_set03_box": f"{W} SELECT {L}, count(*) AS voxels FROM mask WHERE i BETWEEN 3 AND 12 AND j BETWEEN 3 AND 12 AND k BETWEEN 2 AND 6 GROUP BY ALL",
    "flt02_sphere": f"{W} SELECT series_id, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 5) AS mean FROM voxels WHERE (i-5)*(i-5)+(j-7)*(j-7)+4*(k-5)*(k-5) <= 16 GROUP BY ALL",
    "flt04_solid_part": f"{W} SELECT {L}, count(*) FILTER (WHERE value >= 110) AS solid, count(*) FILTER (WHERE value BETWEEN 80 AND 120) AS band FROM mask GROUP BY ALL",
    "flt05_half_spaces": f"{W} SELECT {L}, count(*) AS voxels FROM mask WHERE i - 4 >= 0 AND -j + 0.5*k + 9 >= 0 AND cos(radians(30))*cos(radians(60))*i + cos(radians(30))*sin(radians(60))*j + sin(radians(30))*k >= 5.1 GROUP BY ALL",
    "flt06_set02_erase": f"{W}, o AS (SELECT *, i - 11 AS x, j - (series_id % 4 + 9) AS y, (k - 3) * 2 AS z, round(0.6 * (i - 11) + 0.8 * (k - 3) * 2, 9) AS along FROM mask) SELECT {L}, count(*) AS voxels FROM o WHERE NOT (along BETWEEN -2 AND 6 AND x*x + y*y + z*z - along*along <= 4.000000001) GROUP BY ALL",
    "flt07_thirds": f"{W}, e AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM voxels GROUP BY ALL) SELECT v.series_id, CAST(least(2, floor((value-lo)*3/(hi-lo))) AS BIGINT) AS band, count(*) AS n FROM voxels v JOIN e ON e.series_id = v.series_id GROUP BY ALL",
    "flt03_polygon": f"{W}, {_POLYGON} SELECT series_id, count(*) AS pixels, round(avg(value), 5) AS mean FROM voxels v JOIN c ON v.i = c.i AND v.j = c.j WHERE k = 5 AND crossings % 2 = 1 GROUP BY ALL",
    "geo06_trilinear": f"""{W}, p AS (SELECT series_id, 3.25 + series_id % 7 AS x, 4.5 + series_id % 5 AS y, 2.75 + series_id % 6 AS z FROM series), o(n, a, b, c) AS (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, -1, 0, 0), (3, 0, 1, 0), (4, 0, -1, 0), (5, 0, 0, 1), (6, 0, 0, -1)),
        t AS (SELECT p.series_id, o.n, CAST(sum(value * greatest(0, 1-abs(x+a-i)) * greatest(0, 1-abs(y+b-j)) * greatest(0, 1-abs(z+c-k))) AS DOUBLE) AS v FROM p, o JOIN voxels v ON v.series_id = p.series_id AND abs(x+a-i) < 1 AND abs(y+b-j) < 1 AND abs(z+c-k) < 1 GROUP BY ALL)
        SELECT series_id, round(max(v) FILTER (WHERE n = 0), 6) AS value, round(max(v) FILTER (WHERE n = 1) - max(v) FILTER (WHERE n = 2), 6) AS gx, round(max(v) FILTER (WHERE n = 3) - max(v) FILTER (WHERE n = 4), 6) AS gy, round(max(v) FILTER (WHERE n = 5) - max(v) FILTER (WHERE n = 6), 6) AS gz FROM t GROUP BY 1""",
    "join01_segment_values": f"{W} SELECT {L}, {IJK}, value FROM mask",
    "join03_containment": f"{W} SELECT {L}, bool_and(i <= 13 AND j <= 13 AND k <= 9) AS within FROM mask GROUP BY ALL",
    "join04_surface": f"{W}, {_SURFACE('s', 'mask')} SELECT {L}, {IJK} FROM s",
    "join06_gap": f"""{W}, a AS (SELECT series_id, i, j, k FROM mask WHERE label = 2), b0 AS (SELECT series_id, label, i, j, k FROM mask WHERE label = 1 UNION ALL SELECT series_id, 1, 5, CAST(6 + series_id % 3 AS INTEGER), 5 FROM series), {_SURFACE('b', 'b0')},
        n AS (SELECT a.series_id, sqrt({_D2}) AS mm, a.i, a.j, a.k, b.i AS ti, b.j AS tj, b.k AS tk FROM a JOIN b ON a.series_id = b.series_id),
        m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mm, k, j, i, tk, tj, ti) = 1), w AS (SELECT a.series_id, count(b0.i) = count(*) AS inside FROM a LEFT JOIN b0 ON b0.series_id = a.series_id AND b0.i = a.i AND b0.j = a.j AND b0.k = a.k GROUP BY 1)
        SELECT m.series_id, round(mm, 6) AS gap_mm, {IJK}, CAST(ti AS BIGINT) AS ti, CAST(tj AS BIGINT) AS tj, CAST(tk AS BIGINT) AS tk, inside FROM m JOIN w ON w.series_id = m.series_id""",
    "join07_prj10_probe": f"""{W}, p AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS series_id, CAST(l_orderkey % 19 - 9.25 AS DOUBLE) AS x, CAST(l_partkey % 15 - 7.75 AS DOUBLE) AS y0, CAST(100 + l_linenumber * CAST(2.3 AS DOUBLE) AS DOUBLE) AS z FROM lineitem),
        q AS (SELECT p.series_id, x, y0 + oy + 8 AS y, z, round((x-ox)/sx) AS a, round((y0 + oy + 8 - oy)/sy) AS b, round((z-oz)/sz) AS c FROM p JOIN series s ON s.series_id = p.series_id)
        SELECT q.series_id, x, y, z, CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, CAST(c AS BIGINT) AS k, value, CASE WHEN v.i IS NULL THEN 'outside the volume' END AS error FROM q LEFT JOIN voxels v ON v.series_id = q.series_id AND i = a AND j = b AND k = c""",
    "join08_profile": f"""{W}, e AS (SELECT series_id, series_id % 7 AS n FROM series), c AS (SELECT *, CAST(least(greatest(ceil(sqrt(13.0**2 + (10.0 - n)**2 + (2.0*(n + 1))**2)) + 1, 2), 2000) AS BIGINT) AS m FROM e),
        p AS (SELECT series_id, t.step, round(round(1.0 + step / (m - 1) * 13.0, 6)) AS a, round(round(n + 2.0 + step / (m - 1) * (10.0 - n), 6)) AS b, round(round(2.0 + step / (m - 1) * (n + 1.0), 6)) AS c FROM c, range(2000) AS t(step) WHERE step < m)
        SELECT p.series_id, step, value FROM p JOIN voxels v ON v.series_id = p.series_id AND i = a AND j = b AND k = c""",
    "join09_label_mapping": f"{W} SELECT series_id, CAST(CASE WHEN label = 0 AND value > 700 THEN 3 WHEN label = 0 AND value > 120 THEN 2 ELSE label END AS BIGINT) AS new_label, count(*) AS n FROM voxels GROUP BY ALL",
    "join10_upsert": f"{W} SELECT series_id, count(*) AS voxels, count(*) FILTER (WHERE inbox) AS from_new FROM (SELECT *, i BETWEEN 3 AND 9 AND j BETWEEN 4 AND 12 AND k BETWEEN 4 AND 6 AS inbox FROM voxels) WHERE (inbox AND value > 100) OR (NOT inbox AND label = 1) GROUP BY ALL",
    "join11_laterality": f"""{W}, c AS (SELECT series_id, label, -8 + avg(i) AS x FROM mask GROUP BY ALL), m AS (SELECT s.series_id, CASE WHEN s.series_id % 3 = 0 THEN c.x ELSE -0.5 END AS mid FROM series s LEFT JOIN c ON c.series_id = s.series_id AND c.label = 2),
        n AS (SELECT c.series_id, c.label, CASE WHEN c.series_id % 2 = 0 THEN 'left' ELSE 'right' END AS named, CASE WHEN round(x, 5) > round(mid, 5) THEN 'left' ELSE 'right' END AS observed, mid FROM c JOIN m ON m.series_id = c.series_id WHERE c.label = 1)
        SELECT {L}, named, observed, named = observed AS consistent, round(mid, 4) AS midline FROM n""",
    "join16_region_of_interest": f"""{W}, p AS (SELECT series_id, series_id % 5 + 3 AS i0, series_id % 5 + 7 AS i1, 4 AS j0, 8 AS j1, 2 AS k0, series_id % 4 + 2 AS k1 FROM series UNION ALL SELECT series_id, 9, 11, series_id % 6, 5, 5, 6 FROM series),
        u AS (SELECT series_id, greatest(0, min(i0) - 3) AS i0, least(16, max(i1) + 3) AS i1, greatest(0, min(j0) - 3) AS j0, least(16, max(j1) + 3) AS j1, greatest(0, min(k0) - 2) AS k0, least(12, max(k1) + 2) AS k1 FROM p WHERE i0 < i1 AND j0 < j1 AND k0 < k1 GROUP BY 1),
        x AS (SELECT u.*, count(*) AS voxels, sum(value) AS total FROM u JOIN voxels v ON v.series_id = u.series_id AND i >= i0 AND i < i1 AND j >= j0 AND j < j1 AND k >= k0 AND k < k1 GROUP BY ALL)
        SELECT x.series_id, i0, i1, j0, j1, k0, k1, voxels, total, ox + i0 AS ox, oy + j0 AS oy, oz + 2 * k0 AS oz FROM x JOIN series s ON s.series_id = x.series_id""",
    "set01_union": f"{W}, u AS (SELECT series_id, label, i, j, k FROM mask UNION SELECT series_id, label, i+1, j, k FROM mask) SELECT {L}, count(*) AS voxels FROM u GROUP BY ALL",
    "top01_largest_slice": f"{W}, c AS (SELECT {L}, 'sagittal' AS axis, i AS slice, count(*) AS n FROM mask GROUP BY ALL UNION ALL SELECT {L}, 'coronal', j, count(*) FROM mask GROUP BY ALL UNION ALL SELECT {L}, 'axial', k, count(*) FROM mask GROUP BY ALL) SELECT series_id, label, axis, CAST(slice + 1 AS BIGINT) AS slice, n FROM c QUALIFY row_number() OVER (PARTITION BY series_id, label, axis ORDER BY n DESC, slice) = 1",
    "top03_top04_axial_axes": f"""{W}, c AS (SELECT series_id, label, k, count(*) AS n FROM mask GROUP BY series_id, label, k QUALIFY row_number() OVER (PARTITION BY series_id, label ORDER BY n DESC, k) = 1), m AS (SELECT x.* FROM mask x JOIN c ON x.series_id = c.series_id AND x.label = c.label AND x.k = c.k),
        p AS (SELECT a.series_id, a.label, a.k, a.i AS i0, a.j AS j0, b.i - a.i AS dx, b.j - a.j AS dy, sqrt((a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)) AS long_mm FROM m a JOIN m b ON a.series_id = b.series_id AND a.label = b.label QUALIFY row_number() OVER (PARTITION BY a.series_id, a.label ORDER BY long_mm DESC, a.j, a.i, b.j, b.i) = 1),
        w AS (SELECT p.series_id, p.label, p.k, long_mm, max(((m.j-j0)*dx - (m.i-i0)*dy) / CASE WHEN long_mm > 0 THEN long_mm ELSE 1 END) - min(((m.j-j0)*dx - (m.i-i0)*dy) / CASE WHEN long_mm > 0 THEN long_mm ELSE 1 END) AS wide FROM p JOIN m ON m.series_id = p.series_id AND m.label = p.label GROUP BY p.series_id, p.label, p.k, long_mm, round(((m.i-i0)*dx + (m.j-j0)*dy) / CASE WHEN long_mm > 0 THEN long_mm ELSE 1 END))
        SELECT {L}, CAST(k AS BIGINT) AS k, round(long_mm, 4) AS long_mm, round(max(wide), 4) AS short_mm FROM w GROUP BY ALL""",
    "top05_max_diameter": f"{W} SELECT a.series_id, CAST(a.label AS BIGINT) AS label, round(sqrt(max({_D2})), 6) AS diameter_mm FROM mask a JOIN mask b ON a.series_id = b.series_id AND a.label = b.label GROUP BY ALL",
    "top06_montage": f"""{W}, q AS (SELECT series_id, CASE WHEN series_id % 9 = 8 THEN 0 ELSE series_id % 5 + 1 END AS a, CASE WHEN series_id % 9 = 7 THEN 40 ELSE 36 - series_id % 4 END AS b, CASE WHEN series_id % 3 = 0 THEN series_id % 4 END AS asked, CASE WHEN series_id % 2 = 0 THEN 64 ELSE 12 END AS most FROM series),
        p AS (SELECT *, greatest(1, coalesce(asked, (b - a + 16) // 16)) AS step FROM q), r AS (SELECT *, CASE WHEN a = 0 OR a > b OR b > 36 THEN 'slices ' || a || '..' || b || ' of 36' WHEN len(range(a, b + 1, step)) > most THEN len(range(a, b + 1, step)) || ' tiles; at most ' || most ELSE '' END AS reason FROM p),
        t AS (SELECT series_id, unnest(range(a, b + 1, step)) AS slice, unnest(range(1, len(range(a, b + 1, step)) + 1)) AS tile FROM r WHERE reason = '')
        SELECT t.series_id, slice, tile, sum(value + (slice - 1) // 12) AS total, '' AS reason FROM t JOIN voxels v ON v.series_id = t.series_id AND v.k = (slice - 1) % 12 GROUP BY ALL UNION ALL SELECT series_id, 0, 0, 0, reason FROM r WHERE reason <> ''""",
    "top07_slices": f"{W}, p AS (SELECT series_id, 'axial' AS plane, i AS px, j AS py, value FROM voxels WHERE k = 6 UNION ALL SELECT series_id, 'coronal', i, 11 - k, value FROM voxels WHERE j = 8 UNION ALL SELECT series_id, 'sagittal', j, 11 - k, value FROM voxels WHERE i = 8) SELECT series_id, plane, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, value, CAST(round(least(greatest((value + 150) / 400, 0), 1) * 255) AS BIGINT) AS grey FROM p",
    "win07_box_mean": f"{W} SELECT a.series_id, CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, CAST(a.k AS BIGINT) AS k, round(avg(b.value), 6) AS mean FROM voxels a JOIN voxels b ON b.series_id = a.series_id AND b.i BETWEEN a.i-2 AND a.i+2 AND b.j BETWEEN a.j-2 AND a.j+2 AND b.k BETWEEN a.k-2 AND a.k+2 GROUP BY ALL",
    "win12_runs": f"{W}, v AS (SELECT series_id, label, CAST(i + 16*(j + 16*k) AS BIGINT) AS vox FROM mask), r AS (SELECT *, vox - row_number() OVER (PARTITION BY series_id, label ORDER BY vox) AS island FROM v) SELECT {L}, min(vox) AS start, count(*) AS length FROM r GROUP BY series_id, label, island",
    "win12_runs_decoded": f"{W} SELECT {L}, {IJK} FROM mask",
}
