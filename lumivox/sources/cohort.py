"""An imaging cohort derived from the business tables, by formulas that any SQL engine can repeat.

One series a supplier on a 16 x 16 x 12 grid, a slice header a line item, a value group a supplier, an
annotation an order, an audit entry an event: every table grows with those it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NX, NY, NZ = 16, 16, 12
SPACING = (1.0, 1.0, 2.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, modality, sx, sy, sz, ox, oy, oz, range_min, range_max``."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS BIGINT) AS series_id", "IF(s_nationkey % 2 = 0, 'CT', 'MR') AS modality", "1.0D AS sx", "1.0D AS sy", "2.0D AS sz",
        "-8.0D AS ox", "-8.0D + s_nationkey AS oy", "100.0D AS oz", "-1000.0D AS range_min", "1000.0D AS range_max",
    )


SERIES_SQL = """series AS (
    SELECT CAST(s_suppkey AS BIGINT) AS series_id, CASE WHEN s_nationkey % 2 = 0 THEN 'CT' ELSE 'MR' END AS modality,
           CAST(1 AS DOUBLE) AS sx, CAST(1 AS DOUBLE) AS sy, CAST(2 AS DOUBLE) AS sz, CAST(-8 AS DOUBLE) AS ox,
           CAST(-8 + s_nationkey AS DOUBLE) AS oy, CAST(100 AS DOUBLE) AS oz, CAST(-1000 AS DOUBLE) AS range_min, CAST(1000 AS DOUBLE) AS range_max
    FROM supplier)"""

_LABEL = """CASE WHEN (i-5)*(i-5) + (j-6-series_id%3)*(j-6-series_id%3) + 4*(k-5)*(k-5) <= 16
                      AND NOT (i = 5 AND j = 6 + series_id%3 AND k = 5) THEN 1
                 WHEN i BETWEEN 10 AND 13 AND j BETWEEN 10 AND 13 AND k BETWEEN 3 AND 7 THEN 2
                 WHEN i = 15 AND j < 1 + series_id%4 AND k = 0 THEN 1 ELSE 0 END"""
_BASE = "CASE label WHEN 1 THEN 100 WHEN 2 THEN 800 ELSE -900 END"
_PLACE = "i*37 + j*11 + k*5"
_VALUE = f"{_BASE} + ({_PLACE} + series_id*13) % 91 - 45"


#: Series in a part of the grid, about: some 800,000 voxels.
SERIES_A_PART = 256


def _grids(spark: SparkSession) -> DataFrame:
    """``kind, i, j, k, label, base, place``: the grid of each kind of series. A label follows from the rest of the series' number by 3 and by 4, so from that by 12 (of either sign; 12 stands for no number)."""
    cells = spark.range(-11 * NX * NY * NZ, 13 * NX * NY * NZ).selectExpr(f"CAST(FLOOR(id / {NX * NY * NZ}) AS BIGINT) AS kind", f"PMOD(id, {NX * NY * NZ}) AS vox")
    placed = cells.selectExpr("kind", "NULLIF(kind, 12) AS series_id", f"CAST(vox % {NX} AS INT) AS i", f"CAST(vox DIV {NX} % {NY} AS INT) AS j", f"CAST(vox DIV {NX * NY} AS INT) AS k")
    return placed.withColumn("label", F.expr(_LABEL)).selectExpr("kind", "i", "j", "k", "label", f"CAST({_BASE} AS BIGINT) AS base", f"CAST({_PLACE} AS BIGINT) AS place")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, i, j, k, label, value``: a ball with a hole, a few voxels apart from it, a box, and noise.

    The suppliers' file is small, often one group of rows, so series are dealt out before their grids are made: in as many parts as shuffles have,
    more where there are many series. What groups, joins or orders voxels within series finds them together. Grids are joined, not exploded: Spark takes an
    exploded table to be as small as its file and would broadcast it, a join as large as its sides' product. What is asked of places and labels is
    then asked of the kinds' grids, before they meet the series.
    """
    ids = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS series_id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // SERIES_A_PART))
    dealt = ids.repartition(parts, "series_id").withColumn("kind", F.expr("COALESCE(series_id % 12, 12)"))
    met = dealt.join(F.broadcast(_grids(spark)), "kind")
    return met.selectExpr("series_id", "i", "j", "k", "label", "CAST(base + (place + series_id * 13) % 91 - 45 AS DOUBLE) AS value")


VOXELS_SQL = f"""{SERIES_SQL}, grid AS (
    SELECT series_id, CAST(vox % {NX} AS INTEGER) AS i, CAST(vox // {NX} % {NY} AS INTEGER) AS j, CAST(vox // {NX * NY} AS INTEGER) AS k
    FROM series, range({NX * NY * NZ}) AS r(vox)),
labelled AS (SELECT *, {_LABEL} AS label FROM grid),
voxels AS (SELECT *, CAST({_VALUE} AS DOUBLE) AS value FROM labelled),
mask AS (SELECT series_id, label, i, j, k, value FROM voxels WHERE label > 0)"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inside voxels of the segments, with their values."""
    return voxels(spark, sf_dir).where("label > 0").select("series_id", "label", "i", "j", "k", "value")


def group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, value``: a group a supplier, whole numbers."""
    return table(spark, sf_dir, "lineitem").selectExpr("CAST(l_suppkey AS BIGINT) AS label", "CAST(FLOOR(l_extendedprice / 100) - 500 AS DOUBLE) AS value")


VALUES_SQL = "group_values AS (SELECT CAST(l_suppkey AS BIGINT) AS label, CAST(floor(l_extendedprice / 100) - 500 AS DOUBLE) AS value FROM lineitem)"


#: Fields of slice headers that both engines derive by the same expression.
_FIELDS = {
    "series_uid": "CAST(l_orderkey AS BIGINT)",
    "path": "CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT)",
    "z": """CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN CAST(7 AS DOUBLE)
        ELSE l_linenumber * CAST(2.5 AS DOUBLE) + CASE WHEN l_partkey % 7 = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + l_suppkey % 4 * CAST(0.00007 AS DOUBLE) END""",
    "instance_number": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END",
    "slice_location": "CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_linenumber * CAST(1.5 AS DOUBLE) END",
    "spacing_between_slices": "CASE WHEN l_partkey % 3 = 0 THEN CAST(2.5 AS DOUBLE) END",
    "slice_thickness": "CASE WHEN l_partkey % 2 = 0 THEN CAST(3 AS DOUBLE) END",
    "temporal_position": "CASE WHEN l_orderkey % 9 = 0 AND l_partkey % 11 > 0 THEN CAST(1 + l_suppkey % 3 AS BIGINT) END",
    "echo_number": "CASE WHEN l_orderkey % 3 = 0 THEN CAST(1 + l_suppkey % 2 AS BIGINT) END",
    "echo_time": "CASE WHEN l_orderkey % 3 = 1 THEN 30 + l_partkey % 2 * CAST(50.5 AS DOUBLE) END",
    "b_value": "CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_partkey % 3 * 500 AS DOUBLE) END",
    "acquisition_number": "CAST(1 + l_orderkey % 4 AS BIGINT)",
    "trigger_time": "CASE WHEN l_orderkey % 7 = 1 THEN CAST(l_partkey % 3 * 40 AS DOUBLE) END",
    "frame_reference_time": "CASE WHEN l_orderkey % 6 = 5 THEN CAST(l_linenumber * 1000 AS DOUBLE) END",
    "isotropic": "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END",
    "component": "CASE WHEN l_orderkey % 8 = 3 THEN CASE l_suppkey % 3 WHEN 0 THEN 'PHASE' WHEN 1 THEN 'magnitude' ELSE 'OTHER' END END",
    "photometric": "CASE WHEN l_linenumber % 5 = 4 THEN NULL WHEN l_returnflag = 'A' THEN 'MONOCHROME1' WHEN l_returnflag = 'N' THEN 'MONOCHROME2' ELSE 'RGB' END",
    "pixel_spacing": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) + l_partkey % 3 END",
    "imager_spacing": "CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(0.7 AS DOUBLE) END",
    "group_spacing": "CASE WHEN l_partkey % 16 = 0 THEN NULL ELSE CAST(0.9 AS DOUBLE) END",
    "window_width": "CAST(l_quantity - 10 AS DOUBLE)",
    "window_center": "CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE CAST(l_partkey % 400 AS DOUBLE) END",
    "matrix": "CAST(256 + 256 * (l_orderkey % 2) AS BIGINT)",
    "tilt": "l_orderkey % 3 * CAST(0.0004 AS DOUBLE)",
}


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice header a line item: series an order, several images at some positions, some without position or number, some at one place only."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _FIELDS.items()])


HEADERS_SQL = f"headers AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FIELDS.items())} FROM lineitem)"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, time, workspace, command, item, ok``: an audit entry an event."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS BIGINT) AS event_id", "CAST(ts AS TIMESTAMP) AS time", "CAST(user_id % 20 AS BIGINT) AS workspace", "CAST(event_id % 97 AS BIGINT) AS item",
        "CASE event_type WHEN 'view' THEN 'probe' WHEN 'click' THEN 'segment edit' WHEN 'signup' THEN 'annotate add' WHEN 'purchase' THEN 'review confirm' ELSE 'review reject' END AS command",
        "COALESCE(value > 50, false) AS ok",
    )


AUDIT_SQL = """audit AS (SELECT CAST(event_id AS BIGINT) AS event_id, CAST(ts AS TIMESTAMP) AS time, CAST(user_id % 20 AS BIGINT) AS workspace,
    CAST(event_id % 97 AS BIGINT) AS item, CASE event_type WHEN 'view' THEN 'probe' WHEN 'click' THEN 'segment edit' WHEN 'signup' THEN 'annotate add'
    WHEN 'purchase' THEN 'review confirm' ELSE 'review reject' END AS command, COALESCE(value > 50, false) AS ok FROM events)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation an order: a kind, a plane, and a quadrilateral's corners in mm."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS id", "CAST(o_custkey % 50 AS BIGINT) AS workspace", "element_at(array('Distance','Angle','Area','Rectangle','Text'), CAST(o_orderkey % 5 + 1 AS INT)) AS kind",
        "CAST(o_orderkey % 12 AS BIGINT) AS slice_index", "element_at(array('axial','coronal','sagittal'), CAST(o_orderkey % 3 + 1 AS INT)) AS plane",
        "element_at(array('Distance','Angle','Area','Rectangle','Text'), CAST(o_orderkey % 5 + 1 AS INT)) || ' ' || o_orderkey AS name", "IF(o_orderkey % 5 = 4, o_orderpriority, '') AS text",
        "array(named_struct('x', CAST(o_custkey % 97 AS DOUBLE), 'y', CAST(o_orderkey % 31 AS DOUBLE)), named_struct('x', CAST(o_custkey % 89 + 3 AS DOUBLE), 'y', CAST(o_orderkey % 37 + 5 AS DOUBLE)), named_struct('x', CAST(o_custkey % 83 + 11 AS DOUBLE), 'y', CAST(o_orderkey % 41 + 20 AS DOUBLE)), named_struct('x', CAST(o_custkey % 79 AS DOUBLE), 'y', CAST(o_orderkey % 43 + 40 AS DOUBLE))) AS points",
        "CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END AS status", "IF(o_orderkey % 2 = 0, 'agent', 'human') AS author",
    )


ANNOTATIONS_SQL = """annotations AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 50 AS BIGINT) AS workspace,
    ['Distance','Angle','Area','Rectangle','Text'][o_orderkey % 5 + 1] AS kind, CAST(o_orderkey % 12 AS BIGINT) AS slice_index, ['axial','coronal','sagittal'][o_orderkey % 3 + 1] AS plane,
    ['Distance','Angle','Area','Rectangle','Text'][o_orderkey % 5 + 1] || ' ' || o_orderkey AS name, CASE WHEN o_orderkey % 5 = 4 THEN o_orderpriority ELSE '' END AS text,
    CAST(o_custkey % 97 AS DOUBLE) AS x1, CAST(o_orderkey % 31 AS DOUBLE) AS y1, CAST(o_custkey % 89 + 3 AS DOUBLE) AS x2, CAST(o_orderkey % 37 + 5 AS DOUBLE) AS y2,
    CAST(o_custkey % 83 + 11 AS DOUBLE) AS x3, CAST(o_orderkey % 41 + 20 AS DOUBLE) AS y3, CAST(o_custkey % 79 AS DOUBLE) AS x4, CAST(o_orderkey % 43 + 40 AS DOUBLE) AS y4,
    CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'agent' ELSE 'human' END AS author FROM orders)"""

#: The segments' boxes and content hashes where one brick holds a series.
HASHED_SQL = """runs AS (SELECT series_id, label, j, k, min(i) AS i0, max(i) AS i1 FROM (SELECT *, i - row_number() OVER (PARTITION BY series_id, label, j, k ORDER BY i) AS r FROM mask) GROUP BY series_id, label, j, k, r),
    hashed AS (SELECT series_id, label, min(i0) AS i0, max(i1) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1, sha256('0:0:' || sha256(string_agg(k || ',' || j || ',' || i0 || ',' || i1, ';' ORDER BY k, j, i0))) AS hash FROM runs GROUP BY ALL)"""
