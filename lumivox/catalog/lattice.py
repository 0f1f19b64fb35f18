"""Pieces, holes, growth and distances: GRA1 to GRA7, GRA9, GEO2, TOP2, SET2."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox.catalog.intensity import _rounded
from lumivox.catalog.segments import _long
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.sources import cohort as C

KEYS = M.KEY


def _seeds(s, d):
    return C.series(s, d).selectExpr("series_id", "0 AS i", "15 AS j", "CAST(series_id % 12 AS INT) AS k")


def _distance(s, d):
    cells = C.voxels(s, d).withColumn("inside", F.col("label") == 2)
    return N.squared_distances(cells, C.SPACING, ["series_id"])


def _narrow(s, d):
    """A box with a thin bridge to it, so that an opening has something to cut."""
    return C.voxels(s, d).where("label = 2 OR (j = 11 AND k = 5 AND i BETWEEN 7 AND 9)").select("series_id", F.lit(2).alias("label"), "i", "j", "k")


def _two(s, d):
    """Two boxes and a thin bridge between them: an opening at a seed keeps the one near it."""
    return C.voxels(s, d).where("(i BETWEEN 9 AND 13 AND j BETWEEN 9 AND 13 AND k BETWEEN 3 AND 7) OR (i BETWEEN 1 AND 5 AND j BETWEEN 9 AND 13 AND k BETWEEN 3 AND 7) OR (j = 11 AND k = 5 AND i BETWEEN 6 AND 8)").select("series_id", F.lit(2).alias("label"), "i", "j", "k")


def _beside(s, d):
    return C.series(s, d).selectExpr("series_id", "2 AS label", "CASE WHEN series_id % 2 = 0 THEN 0 ELSE 15 END AS i", "11 AS j", "5 AS k")


QUERIES = {
    "gra01_top02_components": lambda s, d: _long(_rounded(N.components(C.mask(s, d)), 5)),
    "gra02_split": lambda s, d: _long(N.split_segments(C.mask(s, d), 2)),
    "gra03_keep_largest": lambda s, d: _long(N.keep_pieces(C.mask(s, d), largest=True)),
    "gra03_remove_small": lambda s, d: _long(N.keep_pieces(C.mask(s, d), least=3)),
    "gra04_largest_share": lambda s, d: _rounded(N.components(C.mask(s, d)).groupBy(*KEYS).agg((F.max("voxels") / F.sum("voxels")).alias("share")).withColumn("fragmented", F.col("share") < 0.95)),
    "gra05_set02_fill_holes": lambda s, d: _long(N.fill_holes(C.mask(s, d))),
    "gra06_cavities": lambda s, d: _long(N.cavities(C.mask(s, d))),
    "gra07_region_growing": lambda s, d: _long(N.grow(C.voxels(s, d), _seeds(s, d), -930.0, -870.0, 2600)),
    "gra09_opening": lambda s, d: _long(N.opening(_narrow(s, d), C.SPACING, 2.0)),
    "gra09_opening_at_seeds": lambda s, d: _long(N.opening(_two(s, d), C.SPACING, 2.0, _beside(s, d))),
    "geo02_distance_transform": lambda s, d: _long(_distance(s, d)),
}

W = f"WITH RECURSIVE {C.VOXELS_SQL}"
L = "series_id, CAST(label AS BIGINT) AS label"
IJK = "CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k"
_PIECES = """links AS (SELECT a.series_id, a.label, a.i + 16*(a.j + 16*a.k) AS a, b.i + 16*(b.j + 16*b.k) AS b FROM mask a JOIN mask b ON a.series_id = b.series_id AND a.label = b.label AND b.i BETWEEN a.i-1 AND a.i+1 AND b.j BETWEEN a.j-1 AND a.j+1 AND b.k BETWEEN a.k-1 AND a.k+1),
    reach AS (SELECT series_id, label, a, b FROM links UNION SELECT r.series_id, r.label, r.a, l.b FROM reach r JOIN links l ON l.series_id = r.series_id AND l.label = r.label AND l.a = r.b),
    piece AS (SELECT series_id, label, a AS vox, min(b) AS piece FROM reach GROUP BY ALL),
    comp AS (SELECT series_id, label, piece, count(*) AS voxels, min(vox % 16) AS i0, max(vox % 16) AS i1, avg(vox % 16) AS ci, min(vox // 16 % 16) AS j0, max(vox // 16 % 16) AS j1, avg(vox // 16 % 16) AS cj, min(vox // 256) AS k0, max(vox // 256) AS k1, avg(vox // 256) AS ck,
        row_number() OVER (PARTITION BY series_id, label ORDER BY count(*) DESC, piece) AS rank FROM piece GROUP BY series_id, label, piece)"""
_HOLES = """box AS (SELECT series_id, label, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1 FROM mask GROUP BY ALL),
    cell AS (SELECT b.series_id, b.label, v.i, v.j, v.k, v.i IN (i0, i1) OR v.j IN (j0, j1) OR v.k IN (k0, k1) AS edge FROM box b JOIN voxels v ON v.series_id = b.series_id AND v.i BETWEEN i0 AND i1 AND v.j BETWEEN j0 AND j1 AND v.k BETWEEN k0 AND k1 WHERE v.label <> b.label),
    way AS (SELECT series_id, label, i, j, k FROM cell WHERE edge UNION SELECT c.series_id, c.label, c.i, c.j, c.k FROM way w JOIN cell c ON c.series_id = w.series_id AND c.label = w.label AND abs(c.i-w.i)+abs(c.j-w.j)+abs(c.k-w.k) = 1),
    hole AS (SELECT c.series_id, c.label, c.i, c.j, c.k FROM cell c ANTI JOIN way w ON c.series_id = w.series_id AND c.label = w.label AND c.i = w.i AND c.j = w.j AND c.k = w.k)"""

ORACLE_SQL = {
    "gra01_top02_components": f"{W}, {_PIECES} SELECT {L}, rank, voxels, CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, round(ci, 5) AS ci, CAST(j0 AS BIGINT) AS j0, CAST(j1 AS BIGINT) AS j1, round(cj, 5) AS cj, CAST(k0 AS BIGINT) AS k0, CAST(k1 AS BIGINT) AS k1, round(ck, 5) AS ck FROM comp",
    "gra02_split": f"{W}, {_PIECES}, f AS (SELECT series_id, label, rank, row_number() OVER (PARTITION BY series_id ORDER BY label, rank) AS n FROM comp WHERE rank > 1 AND voxels >= 2) SELECT {L}, rank, 2 + n AS new_label FROM f",
    "gra03_keep_largest": f"{W}, {_PIECES} SELECT p.series_id, CAST(p.label AS BIGINT) AS label, CAST(vox % 16 AS BIGINT) AS i, CAST(vox // 16 % 16 AS BIGINT) AS j, CAST(vox // 256 AS BIGINT) AS k FROM piece p JOIN comp c ON c.series_id = p.series_id AND c.label = p.label AND c.piece = p.piece WHERE rank = 1",
    "gra03_remove_small": f"{W}, {_PIECES} SELECT p.series_id, CAST(p.label AS BIGINT) AS label, CAST(vox % 16 AS BIGINT) AS i, CAST(vox // 16 % 16 AS BIGINT) AS j, CAST(vox // 256 AS BIGINT) AS k FROM piece p JOIN comp c ON c.series_id = p.series_id AND c.label = p.label AND c.piece = p.piece WHERE voxels >= 3",
    "gra04_largest_share": f"{W}, {_PIECES} SELECT {L}, round(max(voxels) / sum(voxels), 6) AS share, max(voxels) / sum(voxels) < 0.95 AS fragmented FROM comp GROUP BY ALL",
    "gra05_set02_fill_holes": f"{W}, {_HOLES} SELECT {L}, {IJK} FROM mask UNION ALL SELECT {L}, {IJK} FROM hole",
    "gra06_cavities": f"{W}, {_HOLES} SELECT {L}, count(*) AS cavities, count(*) AS voxels FROM hole GROUP BY ALL",
    "gra07_region_growing": f"""{W}, band AS (SELECT series_id, i, j, k FROM voxels WHERE label = 0 AND value BETWEEN -930 AND -870),
        region AS (SELECT series_id, i, j, k FROM band WHERE i = 0 AND j = 15 AND k = series_id % 12 UNION SELECT b.series_id, b.i, b.j, b.k FROM region r JOIN band b ON b.series_id = r.series_id AND abs(b.i-r.i)+abs(b.j-r.j)+abs(b.k-r.k) = 1), n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM region)
        SELECT DISTINCT series_id, CAST(CASE WHEN n <= 2600 THEN i END AS BIGINT) AS i, CAST(CASE WHEN n <= 2600 THEN j END AS BIGINT) AS j, CAST(CASE WHEN n <= 2600 THEN k END AS BIGINT) AS k, n > 2600 AS refused FROM n""",
    "gra09_opening": f"""WITH {C.VOXELS_SQL}, m AS (SELECT series_id, i, j, k FROM voxels WHERE label = 2 OR (j = 11 AND k = 5 AND i BETWEEN 7 AND 9)),
        o AS (SELECT m.series_id, m.i, m.j, m.k, m.i + x.d AS a, m.j + y.d AS b, m.k + z.d AS c FROM m, range(-1, 2) AS x(d), range(-1, 2) AS y(d), range(-1, 2) AS z(d) WHERE x.d*x.d + y.d*y.d + 4*z.d*z.d < 4),
        core AS (SELECT o.series_id, o.i, o.j, o.k FROM o LEFT JOIN m ON m.series_id = o.series_id AND m.i = a AND m.j = b AND m.k = c GROUP BY ALL HAVING count(m.i) = count(*))
        SELECT DISTINCT m.series_id, CAST(2 AS BIGINT) AS label, CAST(m.i AS BIGINT) AS i, CAST(m.j AS BIGINT) AS j, CAST(m.k AS BIGINT) AS k FROM m JOIN core c ON c.series_id = m.series_id AND (m.i-c.i)*(m.i-c.i) + (m.j-c.j)*(m.j-c.j) + 4*(m.k-c.k)*(m.k-c.k) <= 4""",
    "gra09_opening_at_seeds": f"""WITH {C.VOXELS_SQL}, m AS (SELECT series_id, i, j, k FROM voxels WHERE (i BETWEEN 9 AND 13 AND j BETWEEN 9 AND 13 AND k BETWEEN 3 AND 7) OR (i BETWEEN 1 AND 5 AND j BETWEEN 9 AND 13 AND k BETWEEN 3 AND 7) OR (j = 11 AND k = 5 AND i BETWEEN 6 AND 8)),
        o AS (SELECT m.series_id, m.i, m.j, m.k, m.i + x.d AS a, m.j + y.d AS b, m.k + z.d AS c FROM m, range(-1, 2) AS x(d), range(-1, 2) AS y(d), range(-1, 2) AS z(d) WHERE x.d*x.d + y.d*y.d + 4*z.d*z.d < 4),
        core AS (SELECT o.series_id, o.i, o.j, o.k FROM o LEFT JOIN m ON m.series_id = o.series_id AND m.i = a AND m.j = b AND m.k = c WHERE (o.i < 7) = (o.series_id % 2 = 0) GROUP BY ALL HAVING count(m.i) = count(*))
        SELECT DISTINCT m.series_id, CAST(2 AS BIGINT) AS label, CAST(m.i AS BIGINT) AS i, CAST(m.j AS BIGINT) AS j, CAST(m.k AS BIGINT) AS k FROM m JOIN core c ON c.series_id = m.series_id AND (m.i-c.i)*(m.i-c.i) + (m.j-c.j)*(m.j-c.j) + 4*(m.k-c.k)*(m.k-c.k) <= 4""",
    "geo02_distance_transform": f"WITH {C.VOXELS_SQL} SELECT v.series_id, CAST(v.i AS BIGINT) AS i, CAST(v.j AS BIGINT) AS j, CAST(v.k AS BIGINT) AS k, CAST(min((v.i-m.i)*(v.i-m.i) + (v.j-m.j)*(v.j-m.j) + 4*(v.k-m.k)*(v.k-m.k)) AS DOUBLE) AS d2 FROM voxels v JOIN mask m ON m.series_id = v.series_id AND m.label = 2 GROUP BY ALL",
}
