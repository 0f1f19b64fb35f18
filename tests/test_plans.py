"""Plans that cut lineage, split hot keys and connect components."""

import random

import pytest
from pyspark.sql import functions as F

from lumivox.plans.components import connected_components
from lumivox.plans.joins import split_join

#: Skewed from a few kB on, as little data shows it.
SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    for k, v in SKEWED.items():
        spark.conf.set(k, v)
    yield spark
    for k in SKEWED:
        spark.conf.unset(k)


def ran(frame):
    """The final plan, after the join has been run."""
    frame.write.format("noop").mode("overwrite").save()
    frame.count()
    execution = frame._jdf.queryExecution()
    frame.collect()
    return execution.executedPlan().toString()


def test_a_hub_is_split(skewed):
    rows = skewed.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 10 < 9, -1).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    few = rows.groupBy("a").agg(F.min("b").alias("m"))
    assert "skew=true" in ran(split_join(rows, few, "a"))
    assert "skew=true" not in ran(rows.join(few, "a"))  # by the key alone: the aggregate's exchange isn't right below the join
    assert "skew=true" in ran(split_join(rows, few, ["a"], "left"))


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(5, 5), (7, 1000)] + [(i, i + 1) for i in range(400, 470)]
    got = connected_components(spark.createDataFrame(edges + [(None, 3)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute_components(edges)


def test_star_of_many_edges(skewed):
    star = skewed.range(1, 200_001, 1, 4).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert connected_components(star).agg(F.max("component"), F.count("*")).first()[:] == (0, 200_001)


def test_grids_are_dealt_out_and_never_taken_for_small(spark, tmp_path):
    """Series of either sign, and one without a number, from one group of rows: in many parts, whole series in each, as large to the planner as they are, with SQL's rows."""
    import duckdb

    from lumivox.sources import cohort as C

    spark.sql("SELECT CAST(id AS BIGINT) AS s_suppkey, 1 AS s_nationkey FROM VALUES (-25L), (-7L), (0L), (5L), (13L), (1000003L), (NULL) t(id)").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    voxels = C.voxels(spark, str(tmp_path))
    assert voxels.rdd.getNumPartitions() >= 4
    assert voxels.withColumn("part", F.spark_partition_id()).groupBy("series_id").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    assert voxels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 10 * 2**20
    expected = duckdb.sql(f"WITH supplier AS (SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'), {C.VOXELS_SQL.removeprefix('WITH ')} SELECT series_id, i, j, k, label, value FROM voxels").fetchall()
    key = lambda r: tuple((c is None, c or 0) for c in r)
    assert sorted(map(tuple, voxels.collect()), key=key) == sorted(expected, key=key)


def test_few_rows_of_much_work_stay_in_many_tasks(spark):
    from lumivox.plans.groups import over_groups

    def work(table, first):
        yield table.slice(0, 1).to_batches()[0]

    rows = spark.range(64).selectExpr("id AS g", "id")
    assert over_groups(rows, ["g"], [], work, "g long, id long").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_many_rows_in_small_files_are_never_broadcast(spark):
    """A table of many voxels has small files; Spark would take it for small and broadcast it whole."""
    from lumivox.plans.scratch import tabled

    voxels = spark.range(30_000).selectExpr("id DIV 1000 AS series_id", "CAST(id % 1000 AS INT) AS i")
    told = lambda most: voxels.join(tabled(voxels, "voxels", most), ["series_id", "i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in told(10_000)
    assert "strategy=merge" not in told(30_000)
    few = tabled(voxels.where("i < 0"), "none", 0)
    assert few.isEmpty()


def test_edges_of_a_core_are_found_from_the_band(spark):
    """Voxels that only their own value lets in, beside a core by any of 26 neighbours, once each; none of the core itself, and none from another series."""
    from lumivox.operators.surface import _with_edges

    core = spark.createDataFrame([(1, 5, 5, 5), (1, 6, 5, 5), (2, 0, 0, 0)], "series_id long, i int, j int, k int")
    band = spark.createDataFrame([(1, 6, 6, 6, False), (1, 5, 5, 5, False), (1, 8, 5, 5, False), (1, 7, 5, 5, True), (2, 1, 1, 1, False), (3, 5, 5, 6, False)], "series_id long, i int, j int, k int, core boolean")
    got = sorted(map(tuple, _with_edges(core, band).collect()))
    assert got == [(1, 5, 5, 5, True), (1, 6, 5, 5, True), (1, 6, 6, 6, False), (2, 0, 0, 0, True), (2, 1, 1, 1, False)]


def test_nearest_annotations_make_a_row_a_segment(spark):
    """Distances from a line's segments are compiled (no lambda makes the points anew for each); lines of one point, of none and without points have no segment."""
    from lumivox.operators.annotations import nearest

    lines = [(1, 0, 7, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), (1, 0, 3, [(0.0, 8.0), (10.0, 8.0)]), (1, 0, 1, [(6.0, 4.0)]), (1, 1, 2, []), (1, 1, 4, None), (2, 0, 9, [(6.0, 5.0), (6.0, 5.0)]), (2, 1, 8, [(90.0, 0.0), (90.0, 9.0)])]
    found = nearest(spark.createDataFrame(lines, "workspace long, slice_index long, id long, points array<struct<x: double, y: double>>"), 6.0, 4.0, 12.0)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 3, 4.0), (2, 0, 9, 1.0)]
    assert "lambdafunction" not in found._jdf.queryExecution().executedPlan().toString()


def test_tables_of_segments_are_merged_not_held_by_the_driver(spark):
    """A profile joins many tables with a row a segment; each is below the broadcast threshold, all together fill the driver."""
    from lumivox.operators import hull as H
    from lumivox.operators import profiles as P
    from lumivox.plans.joins import merge_join

    mask = spark.range(80).selectExpr("id DIV 8 AS series_id", "1 AS label", "CAST(id % 2 AS INT) AS i", "CAST(id % 4 DIV 2 AS INT) AS j", "CAST(id % 8 DIV 4 AS INT) AS k")
    for found in (H.axial_axes(mask, (1.0, 1.0, 2.0)), P.topology(mask, (16, 16, 12), 2.0)):
        assert "BroadcastHashJoin [series_id" not in ran(found).split("Initial Plan")[0]
        assert found.count() == 10
    few = mask.groupBy("series_id").count()
    assert "BroadcastHashJoin" not in ran(merge_join(mask, few, few.withColumnRenamed("count", "n"), on="series_id", how="left"))
