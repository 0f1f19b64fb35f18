"""Values of groups and segments: AGG1 to AGG14, WIN10, and the scalar functions PRJ1 to PRJ8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.functions import grid
from lumivox.operators import intensity as I
from lumivox.sources import cohort as C

G = ["label"]


def _counts(spark, sf_dir) -> DataFrame:
    return I.value_counts(C.group_values(spark, sf_dir), G)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _stored(spark, sf_dir) -> DataFrame:
    return C.voxels(spark, sf_dir).select("series_id", grid.to_storage(F.col("value"), F.lit(-1000.0), F.lit(1000.0)).alias("stored"), "value")


def scalars(spark, sf_dir) -> DataFrame:
    v, lo, hi = F.col("value"), F.lit(-1000.0), F.lit(1000.0)
    stored = grid.to_storage(v, lo, hi)
    return _rounded(C.group_values(spark, sf_dir).distinct().select(
        "label", "value", stored.cast("long").alias("stored"), grid.from_storage(stored, lo, hi).cast("double").alias("restored"), grid.normalize(v, lo, hi).alias("share"),
        grid.denormalize(grid.normalize(v, lo, hi), lo, hi).alias("back"), grid.grey(grid.window_level(v, F.lit(50.0), F.lit(400.0))).cast("long").alias("soft_grey"),
    ), 4)


def presets(spark, sf_dir) -> DataFrame:
    """Every value in the four fixed windows and in that of the full range; the range is one row, so it is broadcast."""
    rows = [("brain", 40.0, 80.0), ("soft_tissue", 50.0, 400.0), ("lung", -600.0, 1500.0), ("bone", 400.0, 1800.0)]
    values = C.group_values(spark, sf_dir).select("value").distinct()
    whole = values.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    fixed = [F.struct(F.lit(name).alias("preset"), F.lit(center).alias("center"), F.lit(width).alias("width")) for name, center, width in rows]
    full = F.struct(F.lit("full_range").alias("preset"), ((F.col("low") + F.col("high")) / 2).alias("center"), (F.col("high") - F.col("low")).alias("width"))
    joined = values.crossJoin(F.broadcast(whole)).select("value", F.inline(F.array(*fixed, full)))
    return joined.select("preset", "value", grid.grey(grid.window_level(F.col("value"), F.col("center"), F.col("width"))).cast("long").alias("grey"))


#: Control points of the example's transfer function: place, then red, green, blue and opacity.
POINTS = [(0.0, 0.0, 0.0, 0.0, 0.0), (0.3, 0.55, 0.25, 0.15, 0.1), (0.6, 0.88, 0.6, 0.29, 0.8), (1.0, 1.0, 0.94, 0.95, 1.0)]


def transfer(spark, sf_dir) -> DataFrame:
    x = grid.normalize(F.col("value"), F.lit(-1000.0), F.lit(1000.0))
    parts = [grid.piecewise(x, [(p[0], p[n]) for p in POINTS]).alias(name) for n, name in enumerate(("red", "green", "blue", "opacity"), 1)]
    return _rounded(C.group_values(spark, sf_dir).select("value").distinct().select("value", *parts))


def lossless(spark, sf_dir) -> DataFrame:
    """Whole numbers, halves and thirds by label: the step of each group, whether all its values are on the grid from its least, and the range that stores them."""
    values = C.group_values(spark, sf_dir).select("label", (F.col("value") / (F.col("label") % 3 + 1)).alias("value"))
    ends = values.groupBy("label").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    exponent = grid.grid_exponent(F.col("low"), F.col("high"))
    checked = values.join(ends.withColumn("exponent", exponent), "label").groupBy("label").agg(*[F.first(c).alias(c) for c in ("low", "high", "exponent")], F.bool_and(grid.on_grid(F.col("value"), F.col("low"), F.col("exponent"))).alias("lossless"))
    most = F.when(F.col("lossless"), F.col("low") + F.pow(F.lit(2.0), "exponent") * grid.STORED).otherwise(F.col("high"))
    return _rounded(checked.select("label", "exponent", "lossless", most.alias("range_max")), 4)


def monochrome1(spark, sf_dir) -> DataFrame:
    """Inverted within their group's range where low is bright, else the luminance of a colour that the value is the red of."""
    v = C.group_values(spark, sf_dir)
    ends = v.groupBy("label").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    grey = F.when(F.col("label") % 2 == 0, F.col("low") + F.col("high") - F.col("value")).otherwise(grid.luminance(F.col("value"), F.col("value") / 2, F.col("low")))
    return _rounded(v.distinct().join(ends, "label").select("label", "value", grey.alias("grey")))


QUERIES = {
    "agg01_value_counts": lambda s, d: _counts(s, d),
    "agg02_storage_histogram": lambda s, d: I.storage_histogram(_stored(s, d), ["series_id"]),
    "agg03_plot_heights": lambda s, d: _rounded(I.plot_heights(I.storage_histogram(_stored(s, d), ["series_id"]), ["series_id"])),
    "agg04_first_order": lambda s, d: _rounded(I.first_order(_counts(s, d), G).drop("energy", "rms"), 4),
    "agg05_percentiles": lambda s, d: I.percentiles(_counts(s, d), G, [0.05, 0.25, 0.5, 0.75, 0.95]).withColumn("iqr", F.col("p75") - F.col("p25")),
    "agg06_skewness_kurtosis": lambda s, d: _rounded(I.shape_of_distribution(_counts(s, d), G).drop("mad"), 5),
    "agg07_energy_rms": lambda s, d: _rounded(I.first_order(_counts(s, d), G).select("label", "energy", "rms"), 4),
    "agg08_mean_absolute_deviation": lambda s, d: _rounded(I.shape_of_distribution(_counts(s, d), G).select("label", "mad"), 5),
    "agg09_robust_mad": lambda s, d: _rounded(I.robust_mad(_counts(s, d), G), 5),
    "agg10_entropy_uniformity": lambda s, d: _rounded(I.histogram_measures(_counts(s, d), G)),
    "agg11_agg12_volume_histogram": lambda s, d: _rounded(I.volume_histogram(_counts(s, d), G)),
    "agg13_volume_curve": lambda s, d: _rounded(I.volume_curve(_counts(s, d), G)),
    "agg14_range_shares": lambda s, d: _rounded(I.range_shares(_counts(s, d), G)),
    "prj01_prj05_scalars": scalars,
    "prj03_lossless_grid": lossless,
    "prj06_window_presets": presets,
    "prj07_transfer_function": transfer,
    "prj08_monochrome1": monochrome1,
    "win10_auto_window": lambda s, d: _rounded(I.auto_window(I.storage_histogram(_stored(s, d), ["series_id"]), ["series_id"])),
}

_V = f"WITH {C.VALUES_SQL}"
_R = f"{_V}, r AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY label) AS total FROM group_values)"
_STORED = f"""WITH {C.VOXELS_SQL}, stored AS (SELECT series_id, CAST(least(greatest(round((value + 1000) / (2000.0 / 65535)), 0), 65535) AS BIGINT) AS stored FROM voxels),
h AS (SELECT s.series_id, b.bin, count(x.stored) AS n FROM (SELECT DISTINCT series_id FROM stored) s CROSS JOIN range(64) AS b(bin) LEFT JOIN stored x ON x.series_id = s.series_id AND (x.stored * 64) >> 16 = b.bin GROUP BY ALL)"""
_AT = lambda q: f"max(CASE WHEN place = round((total - 1) * {q}) THEN value END)"

ORACLE_SQL = {
    "agg01_value_counts": f"{_V} SELECT label, value, count(*) AS n FROM group_values GROUP BY ALL",
    "agg02_storage_histogram": f"{_STORED} SELECT series_id, CAST(bin AS BIGINT) AS bin, n FROM h",
    "agg03_plot_heights": f"{_STORED} SELECT series_id, CAST(bin AS BIGINT) AS bin, round(n / max(n) OVER w, 6) AS height, round(ln(1 + n) / ln(1 + max(n) OVER w), 6) AS log_height FROM h WINDOW w AS (PARTITION BY series_id)",
    "agg04_first_order": f"{_V} SELECT label, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range FROM group_values GROUP BY label",
    "agg05_percentiles": f"{_R} SELECT label, {_AT(0.05)} AS p5, {_AT(0.25)} AS p25, {_AT(0.5)} AS p50, {_AT(0.75)} AS p75, {_AT(0.95)} AS p95, {_AT(0.75)} - {_AT(0.25)} AS iqr FROM r GROUP BY label",
    "agg06_skewness_kurtosis": f"{_V}, m AS (SELECT *, avg(value) OVER (PARTITION BY label) AS mu FROM group_values), c AS (SELECT label, avg((value-mu)*(value-mu)) AS m2, avg((value-mu)**3) AS m3, avg((value-mu)**4) AS m4 FROM m GROUP BY label) SELECT label, round(CASE WHEN m2 > 0 THEN m3 / m2**1.5 END, 5) AS skewness, round(CASE WHEN m2 > 0 THEN m4 / (m2*m2) - 3 END, 5) AS kurtosis FROM c",
    "agg07_energy_rms": f"{_V} SELECT label, round(sum(value*value), 4) AS energy, round(sqrt(avg(value*value)), 4) AS rms FROM group_values GROUP BY label",
    "agg08_mean_absolute_deviation": f"{_V}, m AS (SELECT *, avg(value) OVER (PARTITION BY label) AS mu FROM group_values) SELECT label, round(avg(abs(value - mu)), 5) AS mad FROM m GROUP BY label",
    "agg09_robust_mad": f"{_R}, b AS (SELECT label, {_AT(0.1)} AS lo, {_AT(0.9)} AS hi FROM r GROUP BY label), m AS (SELECT r.label, value, avg(value) OVER (PARTITION BY r.label) AS mu FROM r JOIN b ON r.label = b.label WHERE value BETWEEN lo AND hi) SELECT label, round(avg(abs(value - mu)), 5) AS robust_mad FROM m GROUP BY label",
    "agg10_entropy_uniformity": f"{_V}, b AS (SELECT label, floor(value / 25) AS bin, count(*) AS n FROM group_values GROUP BY ALL), p AS (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p FROM b) SELECT label, round(-sum(p * log2(p)), 6) AS entropy, round(sum(p * p), 6) AS uniformity FROM p GROUP BY label",
    "agg11_agg12_volume_histogram": f"""{_V}, e AS (SELECT label, value, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS total, row_number() OVER (PARTITION BY label ORDER BY value DESC) AS place FROM group_values WINDOW w AS (PARTITION BY label))
        SELECT label, round(avg(CASE WHEN (value - lo) / (hi - lo) >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS v10, round(avg(CASE WHEN (value - lo) / (hi - lo) >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS v90,
        max(CASE WHEN place = ceil(total * 10 / 100) THEN value END) AS i10, max(CASE WHEN place = ceil(total * 90 / 100) THEN value END) AS i90 FROM e GROUP BY label""",
    "agg13_volume_curve": f"""{_V}, e AS (SELECT label, min(value) AS lo, max(value) AS hi, count(*) AS total FROM group_values GROUP BY label),
        f AS (SELECT g.label, CAST(floor((value - lo) * 100 / (hi - lo)) AS BIGINT) AS last, count(*) AS n FROM group_values g JOIN e ON g.label = e.label GROUP BY ALL)
        SELECT e.label, CAST(p.point AS BIGINT) AS point, round(sum(CASE WHEN f.last >= p.point THEN n ELSE 0 END) / any_value(total), 6) AS fraction FROM e CROSS JOIN range(101) AS p(point) JOIN f ON f.label = e.label GROUP BY e.label, p.point""",
    "agg14_range_shares": f"""{_V}, r(low, high) AS (VALUES (-1000, -500), (-500, -100), (-100, 0), (0, 100), (100, 300), (300, 1000), (NULL, NULL)), t AS (SELECT label, count(*) AS total FROM group_values GROUP BY 1)
        SELECT t.label, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(v.value) AS voxels, round(count(v.value) / any_value(total), 6) AS share FROM t CROSS JOIN r
        LEFT JOIN group_values v ON v.label = t.label AND CASE WHEN low IS NULL THEN v.value < -1000 OR v.value >= 1000 ELSE v.value >= low AND v.value < high END GROUP BY ALL""",
    "prj01_prj05_scalars": f"""{_V}, d AS (SELECT DISTINCT label, value, CAST(least(greatest(round((value + 1000) / (2000.0 / 65535)), 0), 65535) AS BIGINT) AS stored FROM group_values)
        SELECT label, value, stored, round(CAST(CAST(-1000 + stored * (2000.0 / 65535) AS FLOAT) AS DOUBLE), 4) AS restored, round(least(greatest((value + 1000) / 2000, 0), 1), 4) AS share,
        round(-1000 + least(greatest((value + 1000) / 2000, 0), 1) * 2000, 4) AS back, CAST(round(least(greatest((value + 150) / 400, 0), 1) * 255) AS BIGINT) AS soft_grey FROM d""",
    "prj03_lossless_grid": f"""{_V}, v AS (SELECT label, value / (label % 3 + 1) AS value FROM group_values), e AS (SELECT label, min(value) AS low, max(value) AS high FROM v GROUP BY 1),
        x AS (SELECT *, CASE WHEN high > low THEN CAST(ceil(log2((high - low) / 65535)) AS BIGINT) END AS exponent FROM e),
        o AS (SELECT v.label, bool_and((value - low) / pow(2, exponent) = floor((value - low) / pow(2, exponent))) AS lossless FROM v JOIN x ON x.label = v.label GROUP BY 1)
        SELECT x.label, exponent, lossless, round(CASE WHEN lossless THEN low + pow(2, exponent) * 65535 ELSE high END, 4) AS range_max FROM x JOIN o ON o.label = x.label""",
    "prj06_window_presets": f"{_V}, p(preset, center, width) AS (VALUES ('brain', 40.0, 80.0), ('soft_tissue', 50.0, 400.0), ('lung', -600.0, 1500.0), ('bone', 400.0, 1800.0) UNION ALL SELECT 'full_range', (min(value) + max(value)) / 2, max(value) - min(value) FROM group_values) SELECT preset, value, CAST(round(least(greatest((value - (CAST(center AS DOUBLE) - CAST(width AS DOUBLE) / 2)) / CAST(width AS DOUBLE), 0), 1) * 255) AS BIGINT) AS grey FROM (SELECT DISTINCT value FROM group_values) CROSS JOIN p",
    "prj07_transfer_function": f"""{_V}, x AS (SELECT DISTINCT value, least(greatest((value + 1000) / 2000, 0), 1) AS x FROM group_values),
        p(n, pos, red, green, blue, opacity) AS (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.3, 0.55, 0.25, 0.15, 0.1), (2, 0.6, 0.88, 0.6, 0.29, 0.8), (3, 1.0, 1.0, 0.94, 0.95, 1.0)),
        s AS (SELECT x.value, (x - a.pos) / (b.pos - a.pos) AS t, a, b, row_number() OVER (PARTITION BY x.value ORDER BY a.n) AS first FROM x, p a JOIN p b ON b.n = a.n + 1 WHERE x BETWEEN a.pos AND b.pos)
        SELECT value, {', '.join(f"round(a.{c} + t * (b.{c} - a.{c}), 6) AS {c}" for c in ('red', 'green', 'blue', 'opacity'))} FROM s WHERE first = 1""",
    "prj08_monochrome1": f"{_V}, e AS (SELECT DISTINCT label, value, min(value) OVER w AS low, max(value) OVER w AS high FROM group_values WINDOW w AS (PARTITION BY label)) SELECT label, value, round(CASE WHEN label % 2 = 0 THEN low + high - value ELSE 0.299 * value + 0.587 * value / 2 + 0.114 * low END, 6) AS grey FROM e",
    "win10_auto_window": f"""{_STORED}, c AS (SELECT *, sum(n) OVER (PARTITION BY series_id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY series_id) AS total FROM h)
        SELECT series_id, round(min(CASE WHEN upto >= greatest(1, ceil(total * 0.005)) THEN bin + 1 END) / 64, 6) AS low, round(min(CASE WHEN upto >= greatest(1, ceil(total * 0.995)) THEN bin + 1 END) / 64, 6) AS high FROM c GROUP BY series_id""",
}
