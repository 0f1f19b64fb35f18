"""First-order and distribution features of groups of values, all from one table of value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the half-open value ranges whose shares are given by default (fixed values).
BOUNDS = [-1000.0, -500.0, -100.0, 0.0, 100.0, 300.0, 1000.0]
RANGES = list(zip(BOUNDS, BOUNDS[1:]))


def value_counts(values: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """``group, value, n``: the exact reduction that every feature below needs; null values are left out."""
    return values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def _ranked(counts: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``upto`` (values at or below) and ``total``."""
    by = Window.partitionBy(*group)
    return counts.withColumn("upto", F.sum("n").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))


def first_order(counts: DataFrame, group: list[str]) -> DataFrame:
    """Count, mean, population deviation, least, largest, range, energy and root mean square."""
    n, v = F.col("n"), F.col("value")
    sums = counts.groupBy(*group).agg(F.sum("n").alias("count"), F.sum(n * v).alias("s1"), F.sum(n * v * v).alias("energy"), F.min("value").alias("min"), F.max("value").alias("max"))
    mean = F.col("s1") / F.col("count")
    return sums.select(*group, "count", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("energy") / F.col("count") - mean * mean)).alias("std"), "min", "max", (F.col("max") - F.col("min")).alias("range"), "energy", F.sqrt(F.col("energy") / F.col("count")).alias("rms"))


def percentiles(counts: DataFrame, group: list[str], shares: list[float]) -> DataFrame:
    """Nearest-rank percentiles ``p<share>``: the value at sorted place round((n - 1) * share)."""
    ranked = _ranked(counts, group)
    at = [F.min(F.when(F.col("upto") > F.round((F.col("total") - 1) * F.lit(q)), F.col("value"))).alias(f"p{round(q * 100)}") for q in shares]
    return ranked.groupBy(*group).agg(*at)


def shape_of_distribution(counts: DataFrame, group: list[str]) -> DataFrame:
    """Skewness, excess kurtosis and mean absolute deviation; the first two are null where all values are equal."""
    means = counts.groupBy(*group).agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    d = F.col("value") - F.col("mean")
    share = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    moments = counts.join(means, group).groupBy(*group).agg(share(d * d).alias("m2"), share(d * d * d).alias("m3"), share(d * d * d * d).alias("m4"), share(F.abs(d)).alias("mad"))
    spread = F.col("m2") > 0
    return moments.select(*group, F.when(spread, F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skewness"), F.when(spread, F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias("kurtosis"), "mad")


def robust_mad(counts: DataFrame, group: list[str]) -> DataFrame:
    """Mean absolute deviation, from their own mean, of the values from the 10th to the 90th percentile."""
    bounds = percentiles(counts, group, [0.1, 0.9])
    inner = counts.join(bounds, group).where(F.col("value").between(F.col("p10"), F.col("p90"))).drop("p10", "p90")
    return shape_of_distribution(inner, group).select(*group, F.col("mad").alias("robust_mad"))


def histogram_measures(counts: DataFrame, group: list[str], width: float = 25.0) -> DataFrame:
    """Entropy in bits and uniformity of bins of ``width`` that are anchored at zero."""
    bins = counts.groupBy(*group, F.floor(F.col("value") / width).alias("bin")).agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*group))
    return bins.withColumn("p", p).groupBy(*group).agg((F.lit(0.0) - F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("uniformity"))


def volume_histogram(counts: DataFrame, group: list[str]) -> DataFrame:
    """V10 and V90 (share of values at or above so much of the range) and I10 and I90 (the value that so large a share reaches)."""
    by = Window.partitionBy(*group)
    low, high = F.min("value").over(by), F.max("value").over(by)
    ranked = _ranked(counts, group).withColumn("place", F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.0)).withColumn("above", F.col("total") - F.col("upto") + F.col("n"))
    part = lambda q: (F.sum(F.when(F.col("place") >= q, F.col("n")).otherwise(0)) / F.first("total")).alias(f"v{round(q * 100)}")
    reach = lambda q: F.max(F.when(F.col("above") >= F.ceil(F.col("total") * q / 100), F.col("value"))).alias(f"i{q}")
    return ranked.groupBy(*group).agg(part(0.1), part(0.9), reach(10), reach(90))


def volume_curve(counts: DataFrame, group: list[str], points: int = 101) -> DataFrame:
    """``group, point, fraction``: the share of values at or above each of ``points`` even places in the range."""
    ends = counts.groupBy(*group).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    placed = counts.join(ends, group).withColumn("last", F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) * (points - 1) / (F.col("high") - F.col("low")))).otherwise(points - 1))
    binned = placed.groupBy(*group, "last").agg(F.sum("n").alias("n"))  # the last point that a value reaches
    dense = ends.select(*group, "total", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    joined = dense.join(binned.withColumn("last", F.col("last").cast("int")).withColumnRenamed("last", "point"), [*group, "point"], "left")
    above = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*group).orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(*group, F.col("point").cast("long").alias("point"), (above / F.col("total")).alias("fraction"))


def range_shares(counts: DataFrame, group: list[str], ranges: list[tuple[float, float]] = RANGES) -> DataFrame:
    """``group, low, high, voxels, share`` of every half-open value range, and of what is in none (``low`` and ``high`` null); ranges that overlap are refused."""
    ordered = sorted(ranges)
    if any(low >= high for low, high in ordered) or any(a[1] > b[0] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("value ranges are empty or overlap")
    held = [F.sum(F.when((F.col("value") >= low) & (F.col("value") < high), F.col("n")).otherwise(0)).alias(f"n{i}") for i, (low, high) in enumerate(ordered)]
    sums = counts.groupBy(*group).agg(*held, F.sum("n").alias("total"))
    inside = sum((F.col(f"n{i}") for i in range(len(ordered))), F.lit(0))
    bound = lambda x, name: F.lit(x).cast("double").alias(name)
    rows = [F.struct(bound(low, "low"), bound(high, "high"), F.col(f"n{i}").alias("voxels")) for i, (low, high) in enumerate(ordered)]
    rows.append(F.struct(bound(None, "low"), bound(None, "high"), (F.col("total") - inside).alias("voxels")))
    return sums.select(*group, "total", F.inline(F.array(*rows))).select(*group, "low", "high", "voxels", (F.col("voxels") / F.col("total")).alias("share"))


def storage_histogram(stored: DataFrame, group: list[str], bins: int = 64) -> DataFrame:
    """``group, bin, n`` of stored numbers for every bin (stored * bins) >> 16, zero counts too."""
    counts = stored.groupBy(*group, F.shiftright(F.col("stored") * bins, 16).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dense = counts.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return dense.join(counts, [*group, "bin"], "left").select(*group, F.col("bin").cast("long").alias("bin"), F.coalesce("n", F.lit(0)).alias("n"))


def plot_heights(histogram: DataFrame, group: list[str]) -> DataFrame:
    """Bars of a histogram as shares of the largest, plain and of logarithms."""
    most = F.max("n").over(Window.partitionBy(*group))
    return histogram.select(*group, "bin", F.when(most > 0, F.col("n") / most).otherwise(0.0).alias("height"), F.when(most > 0, F.log1p("n") / F.log1p(most)).otherwise(0.0).alias("log_height"))


def auto_window(histogram: DataFrame, group: list[str], bins: int = 64, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """The upper edges of the bins, as shares of the whole scale, that hold the lower and the upper percentile."""
    by = Window.partitionBy(*group)
    ranked = histogram.withColumn("upto", F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    edge = lambda q: (F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q))), F.col("bin") + 1)) / F.lit(bins))
    return ranked.groupBy(*group).agg(edge(low).alias("low"), edge(high).alias("high"))
