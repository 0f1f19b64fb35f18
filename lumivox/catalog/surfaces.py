"""Surface and volume by cubes, directions, robust growth, study information: AGG21 to AGG23, GRA8, PIP2."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox.catalog.intensity import _rounded
from lumivox.catalog.segments import S, _long
from lumivox.catalog.workspaces import _GAPS, _O, _VOL
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.operators import series as R
from lumivox.operators import studies as U
from lumivox.operators import surface as X
from lumivox.plans.scratch import tabled
from lumivox.sources import cohort as C


def _directions(s, d):
    found = X.directions(M.covariance(C.mask(s, d), S))
    return _long(found.select(*M.KEY, *[F.round(F.get("axis", n), 4).alias(a) for n, a in enumerate("xyz")]))


def _robust(s, d):
    seeds = C.series(s, d).selectExpr("series_id", "2 AS i", "13 AS j", "5 AS k")
    return _long(X.grow_robust(C.voxels(s, d), seeds, 1, 12.0))


def _regions(s, d):
    """The whole chain with what is used in practice (1.5 mm, 5 mm, holes filled), and the seeds that are refused: outside the grid, with a label, and too large a region."""
    n = F.col("series_id")
    seeds = C.series(s, d).select("series_id", F.when(n % 7 == 0, 12).when(n % 7 == 1, 40).otherwise(2).alias("i"), F.when(n % 7 == 0, 12).otherwise(13).alias("j"), F.when(n % 7 == 0, 6).otherwise(5).alias("k"))
    grown, refused = X.grow_region(C.voxels(s, d), seeds, S, 12.0, 2500)
    return M.size(grown.withColumn("label", F.lit(1)), 2.0).select("series_id", "voxels", F.lit("").alias("refused")).unionByName(refused.select("series_id", F.lit(0).cast("long").alias("voxels"), F.col("reason").alias("refused")))


def _field_defaults(s, d):
    """Growth with what follows it in practice: opened at the seed by 2 mm, and what slices enclose filled."""
    seeds = C.series(s, d).selectExpr("series_id", "1 AS label", "2 AS i", "13 AS j", "5 AS k")
    grown = X.robust_runs(C.voxels(s, d), seeds.drop("label"), 1, 12.0).select("series_id", F.lit(1).alias("label"), "j", "k", "i0", "i1")
    opened = N.opening_runs(tabled(grown, "grown"), S, 2.0, seeds)
    return M.size(N.run_voxels(U.fill_runs_by_slices(opened)), 2.0).select("series_id", "voxels")


def _information(s, d):
    """Each series' grid, spacing, values, unit, volumes and what its data warn of, from its stored numbers and its header volumes."""
    v = C.voxels(s, d)
    ends = v.groupBy("series_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("voxels"), *[(F.max(a) + 1).cast("long").alias(f"n{a}") for a in M.VOX])
    ordered = R.order_by_position(C.headers(s, d).distinct())
    volumes = R.volumes(ordered).groupBy(F.col("series_uid").alias("series_id")).agg(F.count("*").alias("volumes"), F.bool_and("complete").alias("complete"))
    gaps = R.gaps(ordered).select(F.col("series_uid").alias("series_id"), "irregular", "most")
    joined = C.series(s, d).join(ends, "series_id").join(volumes, "series_id", "left").join(gaps, "series_id", "left")
    codes = F.array_compact(F.array(F.when(F.col("irregular"), "irregular spacing"), F.when(F.col("most") > 1, "several images at a position"), F.when(~F.col("complete"), "incomplete volumes"), F.when(F.col("modality") != "CT", "unit unknown")))
    return joined.select("series_id", "ni", "nj", "nk", "sx", "sy", "sz", "low", "high", "voxels", F.when(F.col("modality") == "CT", "HU").otherwise("unknown").alias("unit"), F.coalesce("volumes", F.lit(0)).alias("volumes"), F.array_join(codes, ", ").alias("warnings"))


QUERIES = {
    "agg21_directions": _directions,
    "agg22_agg23_mesh": lambda s, d: _rounded(X.mesh(C.mask(s, d), S), 5),
    "gra08_robust_growing": _robust,
    "gra08_opened_and_filled": _field_defaults,
    "gra08_regions": _regions,
    "pip02_study_information": _information,
}

_SMOOTH = "avg({v}) OVER (PARTITION BY series_id, {a}, {b} ORDER BY {x} RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"

_PATTERNS = ", ".join(f"({n}, {', '.join(f'CAST({x!r} AS DOUBLE)' for x in row)})" for n, *row in X.pattern_table(S))

ORACLE_SQL = {
    "agg21_directions": f"""WITH {C.VOXELS_SQL}, c AS (SELECT series_id, label, covar_pop(i, i) AS a, covar_pop(j, j) AS b, 4*covar_pop(k, k) AS c, covar_pop(i, j) AS d, 2*covar_pop(i, k) AS e, 2*covar_pop(j, k) AS f FROM mask GROUP BY ALL),
        q AS (SELECT *, (a+b+c)/3 AS q FROM c), p AS (SELECT *, sqrt(((a-q)**2 + (b-q)**2 + (c-q)**2 + 2*(d*d+e*e+f*f)) / 6) AS p FROM q),
        t AS (SELECT *, acos(least(greatest(((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (2*p**3), -1), 1)) / 3 AS t FROM p),
        l AS (SELECT *, q + 2*p*cos(t) AS hi, 3*q - (q + 2*p*cos(t)) - (q + 2*p*cos(t + 2.0943951023931953)) AS mid FROM t),
        r AS (SELECT *, [d*f - e*(b-hi), e*d - (a-hi)*f, (a-hi)*(b-hi) - d*d] AS v1, [d*(c-hi) - e*f, e*e - (a-hi)*(c-hi), (a-hi)*f - d*e] AS v2, [(b-hi)*(c-hi) - f*f, f*e - d*(c-hi), d*f - (b-hi)*e] AS v3 FROM l),
        n AS (SELECT *, list_sum(list_transform(v1, lambda x: x*x)) AS n1, list_sum(list_transform(v2, lambda x: x*x)) AS n2, list_sum(list_transform(v3, lambda x: x*x)) AS n3 FROM r),
        b AS (SELECT series_id, label, hi, mid, CASE WHEN n1 >= n2 AND n1 >= n3 THEN v1 WHEN n2 >= n3 THEN v2 ELSE v3 END AS v, sqrt(greatest(n1, n2, n3)) AS n FROM n),
        s AS (SELECT *, CASE WHEN abs(v[1]) >= abs(v[2]) AND abs(v[1]) >= abs(v[3]) THEN sign(v[1]) WHEN abs(v[2]) >= abs(v[3]) THEN sign(v[2]) ELSE sign(v[3]) END AS g, hi - mid <= 1e-9 * greatest(1, hi) AS same FROM b)
        SELECT series_id, CAST(label AS BIGINT) AS label, {', '.join(f'CASE WHEN NOT same THEN round(g * v[{n}] / n, 4) + 0.0 END AS {x}' for n, x in enumerate('xyz', 1))} FROM s""",
    "agg22_agg23_mesh": f"""WITH {C.VOXELS_SQL}, t(pattern, area, ax, ay, az, moment) AS (VALUES {_PATTERNS}), c AS (SELECT series_id, label, i - x.o AS ci, j - y.o AS cj, k - z.o AS ck, CAST(bit_or(CAST(1 << (x.o + 2*y.o + 4*z.o) AS INTEGER)) AS INTEGER) AS pattern FROM mask, range(2) AS x(o), range(2) AS y(o), range(2) AS z(o) GROUP BY ALL),
        m AS (SELECT series_id, label, sum(area) AS a, sum(moment + (ci*ax + cj*ay + 2*ck*az) / 3) AS v FROM c JOIN t ON t.pattern = c.pattern GROUP BY ALL), s AS (SELECT *, pow(36 * pi() * v * v, 1.0/3) / a AS s FROM m)
        SELECT series_id, CAST(label AS BIGINT) AS label, round(a, 5) AS area_mm2, round(v, 5) AS volume_mm3, round(a / v, 5) AS surface_by_volume, round(s, 5) AS sphericity, round(s**3, 5) AS compactness_2, round(v / sqrt(pi() * a**3), 5) AS compactness_1, round(1 / s, 5) AS disproportion FROM s""",
    "gra08_robust_growing": f"""WITH RECURSIVE {C.VOXELS_SQL}, s1 AS (SELECT *, {_SMOOTH.format(v='value', x='i', a='j', b='k')} AS m1 FROM voxels), s2 AS (SELECT *, {_SMOOTH.format(v='m1', x='j', a='i', b='k')} AS m2 FROM s1), s3 AS (SELECT *, {_SMOOTH.format(v='m2', x='k', a='i', b='j')} AS m3 FROM s2),
        l AS (SELECT series_id, list_sort(list(m3)) AS v FROM s3 WHERE i BETWEEN 1 AND 3 AND j BETWEEN 12 AND 14 AND k BETWEEN 4 AND 6 GROUP BY 1), f AS (SELECT s3.*, v[len(v) // 2 + 1] AS level FROM s3 JOIN l ON l.series_id = s3.series_id WHERE label = 0),
        band AS (SELECT series_id, i, j, k FROM f WHERE abs(m3 - level) <= 12), core AS (SELECT series_id, i, j, k FROM f WHERE i = 2 AND j = 13 AND k = 5 UNION SELECT b.series_id, b.i, b.j, b.k FROM core c JOIN band b ON b.series_id = c.series_id AND abs(b.i-c.i)+abs(b.j-c.j)+abs(b.k-c.k) = 1),
        e AS (SELECT DISTINCT f.series_id, f.i, f.j, f.k FROM f JOIN core c ON c.series_id = f.series_id AND f.i BETWEEN c.i-1 AND c.i+1 AND f.j BETWEEN c.j-1 AND c.j+1 AND f.k BETWEEN c.k-1 AND c.k+1 WHERE abs(f.value - level) <= 12 AND NOT abs(m3 - level) <= 12)
        SELECT series_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, true AS core FROM core UNION ALL SELECT e.series_id, CAST(e.i AS BIGINT), CAST(e.j AS BIGINT), CAST(e.k AS BIGINT), false FROM e ANTI JOIN core c ON c.series_id = e.series_id AND c.i = e.i AND c.j = e.j AND c.k = e.k""",
    "pip02_study_information": f"""{_O}, {_GAPS}, {_VOL}, {C.VOXELS_SQL}, ev AS (SELECT series_id, min(value) AS low, max(value) AS high, count(*) AS voxels FROM voxels GROUP BY 1), nv AS (SELECT series_uid, count(*) AS volumes, bool_and(complete) AS complete FROM vol GROUP BY 1)
        SELECT s.series_id, CAST(16 AS BIGINT) AS ni, CAST(16 AS BIGINT) AS nj, CAST(12 AS BIGINT) AS nk, sx, sy, sz, low, high, voxels, CASE WHEN modality = 'CT' THEN 'HU' ELSE 'unknown' END AS unit, coalesce(volumes, 0) AS volumes,
        concat_ws(', ', CASE WHEN irregular THEN 'irregular spacing' END, CASE WHEN most > 1 THEN 'several images at a position' END, CASE WHEN NOT complete THEN 'incomplete volumes' END, CASE WHEN modality <> 'CT' THEN 'unit unknown' END) AS warnings
        FROM series s JOIN ev e ON e.series_id = s.series_id LEFT JOIN nv ON nv.series_uid = s.series_id LEFT JOIN r ON r.series_uid = s.series_id""",
}
