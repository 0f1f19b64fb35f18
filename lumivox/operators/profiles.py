"""Profiles of features: what is asked for of segments, in one long table with reasons for what has no value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.functions import grid as G
from lumivox.operators import hull as H
from lumivox.operators import intensity as I
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.operators import surface as X
from lumivox.operators.masks import KEY
from lumivox.plans.joins import merge_join
from lumivox.plans.scratch import tabled

#: The features of the two profiles by family (fixed values).
QUICK = {
    "size": "voxels volume_mm3 volume_ml extent_i_mm extent_j_mm extent_k_mm centroid_x_mm centroid_y_mm centroid_z_mm long_axis_mm short_axis_mm largest_slice_axial largest_slice_coronal largest_slice_sagittal".split(),
    "intensity": "mean std min max range p5 p25 p50 p75 p95 iqr".split(),
}
CLINICAL = {
    "size": [*QUICK["size"], "max_diameter_mm"],
    "shape": (
        "mesh_volume_ml surface_area_mm2 surface_to_volume_per_mm compactness_1 compactness_2 sphericity spherical_disproportion major_axis_mm minor_axis_mm least_axis_mm elongation flatness "
        "major_axis_dir_x major_axis_dir_y major_axis_dir_z minor_axis_dir_x minor_axis_dir_y minor_axis_dir_z least_axis_dir_x least_axis_dir_y least_axis_dir_z hull_volume_ml hull_area_mm2 solidity convexity"
    ).split(),
    "topology": "components largest_component_share holes hole_volume_mm3 euler_number border_sides".split(),
    "intensity": [*QUICK["intensity"], *"skewness kurtosis energy rms mad rmad entropy uniformity ivh_v10 ivh_v90 ivh_i10 ivh_i90".split()],
}
PROFILES = {"quick": QUICK, "clinical": CLINICAL}
#: The largest piece's share below which a segment counts as fragmented.
FRAGMENTED = 0.95


def _size(mask: DataFrame, series: DataFrame, spacing: tuple[float, float, float], asked: list[str]) -> DataFrame:
    volume = spacing[0] * spacing[1] * spacing[2]
    extent = [((F.max(a) - F.min(a) + 1) * s).alias(f"extent_{a}_mm") for a, s in zip(M.VOX, spacing)]
    sums = mask.groupBy(*KEY).agg(F.count("*").alias("voxels"), *extent, *[F.avg(a).alias(f"c{a}") for a in M.VOX])
    mm = G.to_patient([F.col(f"c{a}") for a in M.VOX], [F.col(o) for o in ("ox", "oy", "oz")], [F.lit(s) for s in spacing])
    placed = sums.join(series.select("series_id", "ox", "oy", "oz"), "series_id")
    placed = placed.withColumn("volume_mm3", F.col("voxels") * volume).withColumn("volume_ml", F.col("voxels") * volume / 1000)
    placed = placed.select("*", *[m.alias(f"centroid_{x}_mm") for m, x in zip(mm, "xyz")])
    largest = M.largest_slice(mask).groupBy(*KEY).agg(*[F.max(F.when(F.col("axis") == a, F.col("slice"))).alias(f"largest_slice_{a}") for a in ("axial", "coronal", "sagittal")])
    axes = H.axial_axes(mask, spacing).select(*KEY, F.col("long_mm").alias("long_axis_mm"), F.col("short_mm").alias("short_axis_mm"))
    out = merge_join(placed, largest, axes, on=KEY)
    return merge_join(out, H.max_diameter(mask, spacing).withColumnRenamed("diameter_mm", "max_diameter_mm"), on=KEY) if "max_diameter_mm" in asked else out


def _shape(mask: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    mesh = X.mesh(mask, spacing)
    cov = tabled(M.covariance(mask, spacing), "covariance")
    lengths = M.axis_lengths(cov).select(*KEY, F.col("major").alias("major_axis_mm"), F.col("middle").alias("minor_axis_mm"), F.col("minor").alias("least_axis_mm"), "elongation", "flatness")
    names = [(n, name) for n, name in enumerate(("major", "minor", "least"))]
    turned = X.directions(cov).select(*KEY, *[F.get(F.get("axes", n), c).alias(f"{name}_axis_dir_{x}") for n, name in names for c, x in enumerate("xyz")])
    both = merge_join(mesh, lengths, turned, H.convex_hull(mask, spacing), on=KEY)
    return both.select(
        *KEY, (F.col("volume_mm3") / 1000).alias("mesh_volume_ml"), F.col("area_mm2").alias("surface_area_mm2"), F.col("surface_by_volume").alias("surface_to_volume_per_mm"), "compactness_1", "compactness_2", "sphericity",
        F.col("disproportion").alias("spherical_disproportion"), "major_axis_mm", "minor_axis_mm", "least_axis_mm", "elongation", "flatness", *[f"{name}_axis_dir_{x}" for _, name in names for x in "xyz"],
        (F.col("hull_volume_mm3") / 1000).alias("hull_volume_ml"), "hull_area_mm2", (F.col("volume_mm3") / F.col("hull_volume_mm3")).alias("solidity"), (F.col("hull_area_mm2") / F.col("area_mm2")).alias("convexity"),
    )


def topology(mask: DataFrame, grid: tuple[int, int, int], voxel_mm3: float) -> DataFrame:
    """``components, largest_component_share, holes, hole_voxels, hole_volume_mm3, euler_number, border_sides`` of each segment."""
    pieces = N.components(mask).groupBy(*KEY).agg(F.count("*").alias("components"), (F.max("voxels") / F.sum("voxels")).alias("largest_component_share"))
    holes = N.cavities(mask).select(*KEY, F.col("cavities").alias("holes"), F.col("voxels").alias("hole_voxels"), (F.col("voxels") * voxel_mm3).alias("hole_volume_mm3"))
    found = merge_join(pieces, holes, on=KEY, how="left").fillna(0, ["holes", "hole_voxels", "hole_volume_mm3"])
    return merge_join(found, M.euler_number(mask).withColumnRenamed("euler", "euler_number"), M.border(mask, grid).select(*KEY, F.col("sides").alias("border_sides")), on=KEY)


def _intensity(mask: DataFrame, asked: list[str]) -> DataFrame:
    counts = tabled(I.value_counts(mask, KEY), "counts")
    out = merge_join(I.first_order(counts, KEY).drop("count"), I.percentiles(counts, KEY, [0.05, 0.25, 0.5, 0.75, 0.95]), on=KEY).withColumn("iqr", F.col("p75") - F.col("p25"))
    if "skewness" not in asked:
        return out
    out = merge_join(out, I.shape_of_distribution(counts, KEY), I.robust_mad(counts, KEY).withColumnRenamed("robust_mad", "rmad"), on=KEY)
    out = merge_join(out, I.histogram_measures(counts, KEY), I.volume_histogram(counts, KEY), on=KEY)
    for name in ("v10", "v90", "i10", "i90"):
        out = out.withColumnRenamed(name, f"ivh_{name}")
    return out


def metrics(mask: DataFrame, series: DataFrame, grid: tuple[int, int, int], spacing: tuple[float, float, float], profile: str = "quick") -> DataFrame:
    """``series_id, label, feature, value, reason`` of each segment of ``mask`` (with ``value``) for every feature of a profile; of a profile that isn't known, an error.

    Only the families that are asked for are computed, each from tables as small as it allows: intensity from counts of distinct values, shape
    from patterns of cubes and ends of lines. ``series`` has an origin and a modality; only CT values have a known unit.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known are {', '.join(PROFILES)}")
    families = PROFILES[profile]
    mask = tabled(mask, "mask")
    made = {"size": lambda n: _size(mask, series, spacing, n), "shape": lambda n: _shape(mask, spacing), "topology": lambda n: topology(mask, grid, spacing[0] * spacing[1] * spacing[2]), "intensity": lambda n: _intensity(mask, n)}
    known = F.col("modality") == "CT"
    out = None
    for family, names in families.items():
        wide = made[family](names)
        pairs = F.array(*[F.struct(F.lit(f"{family}.{n}").alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
        long = wide.select(*KEY, F.inline(pairs))
        out = long if out is None else out.unionByName(long)
    told = out.join(series.select("series_id", "modality"), "series_id")
    blank = F.when(F.col("feature").isin("intensity.skewness", "intensity.kurtosis"), "all values are equal").when(F.contains("feature", F.lit("_dir_")), "another axis is as long").otherwise("not defined for this segment")
    reason = F.when(F.col("feature").startswith("intensity.") & ~known, "the unit of the values is unknown").when(F.col("value").isNull(), blank)
    told = told.withColumn("reason", reason)
    return told.select(*KEY, "feature", F.when(F.col("reason").isNull(), F.col("value")).alias("value"), "reason")


def warnings(found: DataFrame) -> DataFrame:
    """``series_id, label, warning, message``: of segments in pieces, with holes, and at the image's border, from ``topology``."""
    percent = lambda x: F.format_string("%.1f", 100 * x)
    pieces = F.concat(F.lit("fragmented: "), "components", F.lit(" pieces, the largest holds "), percent(F.col("largest_component_share")), F.lit(f" % of the voxels (warns below {100 * FRAGMENTED:.0f} %)"))
    holes = F.concat(F.lit("has_holes: "), "holes", F.lit(" cavities of "), "hole_voxels", F.lit(" voxels enclosed by the segment"))
    border = F.concat(F.lit("touches_border: the segment reaches "), "border_sides", F.lit(" side(s) of the image and may be cut off"))
    told = F.array_compact(F.array(F.when(F.col("largest_component_share") < FRAGMENTED, pieces), F.when(F.col("holes") > 0, holes), F.when(F.col("border_sides") > 0, border)))
    return found.select(*KEY, F.explode(told).alias("message")).select(*KEY, F.substring_index("message", ":", 1).alias("warning"), "message")


def curves(mask: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The intensity-volume curve (``KEY, point, fraction``) and the shares of the default value ranges (``KEY, low, high, voxels, share``) of each segment of values with a known unit."""
    known = mask.join(series.where("modality = 'CT'").select("series_id"), "series_id", "left_semi")
    counts = tabled(I.value_counts(known, KEY), "counts")
    return I.volume_curve(counts, KEY), I.range_shares(counts, KEY)
