"""Growth, order, hashes, montages, measures and checks of texts against brute force and known answers."""

import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumivox.functions import text as T
from lumivox.operators import annotations as A
from lumivox.operators import intensity as I
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.operators import series as R
from lumivox.operators import surface as X
from test_lattice import MASK, brute_opened, frame

SPACING = np.array([1.0, 0.75, 1.5])


def brute_smooth(value, radius):
    out = np.zeros_like(value)
    for p in np.ndindex(value.shape):
        out[p] = value[tuple(slice(max(0, x - r), x + r + 1) for x, r in zip(p, radius))].mean()
    return out


def brute_region(value, label, seed, tolerance, smoothing, opening):
    """The flood from the seed and the chain behind it, voxel by voxel."""
    smooth = brute_smooth(value, [int(smoothing // s) for s in SPACING])
    about = smooth[tuple(slice(max(0, x - 1), x + 2) for x in seed)].ravel()
    level = np.sort(about)[len(about) // 2]
    core = (np.abs(smooth - level) <= tolerance) & (label == 0)
    edge = (np.abs(value - level) <= tolerance) & (label == 0) & ~core
    inside, todo = {seed}, deque([seed])
    beside = [d for d in np.ndindex(3, 3, 3) if d != (1, 1, 1)]
    edges = set()
    while todo:
        p = todo.popleft()
        for d in beside:
            q = tuple(x + y - 1 for x, y in zip(p, d))
            if not all(0 <= x < n for x, n in zip(q, value.shape)):
                continue
            if core[q] and q not in inside and sum(y != 1 for y in d) == 1:
                inside.add(q)
                todo.append(q)
            elif edge[q]:
                edges.add(q)
    region = np.zeros(value.shape, bool)
    region[tuple(np.array(sorted(inside | edges)).T)] = True
    grown = len(inside | edges)
    opened = np.zeros_like(region)
    opened[tuple(np.array(sorted(brute_opened(region, SPACING, opening))).T)] = True
    for axis in range(3):
        planes, free = np.moveaxis(opened, axis, 0), np.moveaxis(label == 0, axis, 0)
        for n in range(len(planes)):
            if planes[n].any():
                planes[n] |= brute_flat_holes(planes[n]) & free[n]
    return grown, {tuple(int(x) for x in p) for p in np.argwhere(opened)}


def brute_flat_holes(plane):
    out = np.zeros_like(plane)
    box = tuple(slice(x.min(), x.max() + 1) for x in np.nonzero(plane))
    outside = ~plane[box]
    seen = np.zeros_like(outside)
    todo = deque(p for p in map(tuple, np.argwhere(outside)) if any(x in (0, e - 1) for x, e in zip(p, outside.shape)))
    for p in todo:
        seen[p] = True
    while todo:
        p = todo.popleft()
        for d in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            q = (p[0] + d[0], p[1] + d[1])
            if all(0 <= x < n for x, n in zip(q, outside.shape)) and outside[q] and not seen[q]:
                seen[q] = True
                todo.append(q)
    out[box] = outside & ~seen
    return out


def test_regions_equal_a_flood_and_its_chain(spark):
    """A noisy ball with a labelled core, cavities and a bridge to another ball; rounds of growing boxes; and the refusals."""
    shape = (20, 18, 12)
    x, y, z = np.mgrid[: shape[0], : shape[1], : shape[2]]
    ball = ((x - 7) * 1.0) ** 2 + ((y - 8) * 0.75) ** 2 + ((z - 5) * 1.5) ** 2 <= 36
    value = np.where(ball | ((x > 12) & (abs(y - 8) <= 1) & (z == 5)), 100.0, -50.0) + np.random.default_rng(4).integers(-8, 9, shape)
    value[6:8, 8:10, 4:6] = -50.0
    label = np.zeros(shape, int)
    label[9:11, 6:8, 5] = 3
    seed = (5, 6, 5)
    rows = [(s, int(i), int(j), int(k), int(label[i, j, k]), float(value[i, j, k])) for s in range(5) for i, j, k in np.ndindex(shape)]
    voxels = spark.createDataFrame(rows, "series_id long, i int, j int, k int, label int, value double")
    seeds = spark.createDataFrame([(0, *seed), (1, 9, 6, 5), (2, 40, 6, 5), (3, 1, 16, 1)], "series_id long, i int, j int, k int")
    grown, expected = brute_region(value, label, seed, 25.0, 1.5, 2.0)
    assert brute_region(value, label, (1, 16, 1), 25.0, 1.5, 2.0)[0] > 1500 > grown
    for reach in (4,):
        got, refused = X.grow_region(voxels, seeds, tuple(SPACING), 25.0, 1500, 1.5, 2.0, reach=reach)
        assert {r["series_id"]: r["reason"] for r in refused.collect()} == {1: "has a label", 2: "outside the grid", 3: "too large"}
        found = {(r["i"], r["j"], r["k"]) for r in got.collect() if r["series_id"] == 0}
        assert found == expected and {r["series_id"] for r in got.select("series_id").distinct().collect()} == {0}
    assert not any(label[p] for p in expected) and any(value[p] < 0 for p in expected)  # filled, but no other label's voxels


def test_long_series_are_ordered_by_one_scan(spark):
    """100,000 images of a series at 50,000 positions, some within the step of a position's first and some chained beyond it."""
    n = 100_000
    z = F.floor(F.col("id") / 2) * 0.5 + F.col("id") % 2 * 0.00006
    columns = {c: "cast(null as double)" for c in ("temporal_position", "echo_number", "echo_time", "b_value", "acquisition_number", "trigger_time", "frame_reference_time", "instance_number")}
    headers = spark.range(n).select(F.lit(1).cast("long").alias("series_uid"), F.col("id").alias("path"), z.alias("z"), *[F.expr(e).alias(c) for c, e in columns.items()], F.lit(None).cast("boolean").alias("isotropic"))
    begin = time.time()
    got = R.order_by_position(headers).agg(F.max("position"), F.max("rank"), F.count("*")).first()
    assert tuple(got) == (n // 2 - 1, 2, n) and time.time() - begin < 60
    few = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.00006), (1, 3, 0.00012), (1, 4, 0.00021), (2, 5, 5.0), (2, 6, None)], "series_uid long, path long, z double")
    few = few.select("*", *[F.expr(e).alias(c) for c, e in columns.items()], F.lit(None).cast("boolean").alias("isotropic"))
    assert {r["path"]: r["position"] for r in R.order_by_position(few).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}


def test_a_voxel_changes_the_content_hash(spark, monkeypatch):
    monkeypatch.setattr(N, "BRICK", 4)
    mask = np.random.default_rng(1).random((9, 11, 10)) < 0.5
    other = mask.copy()
    other[8, 10, 9] = ~other[8, 10, 9]
    moved = np.roll(mask, 1, axis=0)
    hashes = {r["series_id"]: r["hash"] for r in N.content_hash(frame(spark, [mask, other, mask, moved])).collect()}
    assert hashes[0] == hashes[2] and len(set(hashes.values())) == 3
    box = N.content_hash(frame(spark, [mask])).first()
    ends = [x for a in np.nonzero(mask) for x in (a.min(), a.max())]
    assert [box[f"{a}{e}"] for a in "ijk" for e in (0, 1)] == ends
    assert N.content_hash(spark.createDataFrame([], MASK)).count() == 0


def test_montage(spark):
    asked = [(1, 1, 40, None, 40, 64), (2, 3, 9, 2, 40, 64), (3, 0, 5, None, 40, 64), (4, 5, 4, None, 40, 64), (5, 1, 41, None, 40, 64), (6, 1, 40, 1, 40, 30), (7, 2, 5, 0, 40, 64)]
    got = M.montage(spark.createDataFrame(asked, "series_id int, first int, last int, step int, slices int, most int")).collect()
    slices = {}
    for r in got:
        slices.setdefault(r["series_id"], []).append((r["tile"], r["slice"], r["reason"]))
    assert [s for _, s, _ in sorted(slices[1])] == list(range(1, 41, 3)) and [s for _, s, _ in sorted(slices[2])] == [3, 5, 7, 9] and len(slices[7]) == 4
    assert {n: slices[n][0][2] for n in (3, 4, 5, 6)} == {3: "slices 0..5 of 40", 4: "slices 5..4 of 40", 5: "slices 1..41 of 40", 6: "40 tiles; at most 30"}


def test_measures_in_space(spark):
    axes, spacing = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 1.0, 2.0]
    square = [[0.0, 0.0, 0.0], [3.0, 0.0, 0.0], [3.0, 0.0, 2.0], [0.0, 0.0, 2.0]]  # upright: nothing of it is seen in the plane
    rows = [(1, "Distance", [[0.0, 0.0, 0.0], [3.0, 0.0, 2.0]]), (2, "Angle", [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), (3, "Area", square), (4, "Distance", square), (5, "Angle", [[1.0, 1.0, 1.0]] * 3), (6, "Area", square[:2])]
    held = spark.createDataFrame([(*r, [5.0, 5.0, 5.0], axes, spacing) for r in rows], "id long, kind string, voxels array<array<double>>, origin array<double>, axes array<array<double>>, spacing array<double>")
    got = {r["id"]: r for r in A.in_space(held).collect()}
    assert got[1]["value"] == pytest.approx(5.0) and got[1]["uncertainty_mm"] == 2.0 and got[2]["value"] == pytest.approx(90.0) and got[3]["value"] == pytest.approx(12.0)
    assert [got[n]["reason"] for n in (4, 5, 6)] == ["a distance needs 2 points, got 4", "the arms of the angle must have length", "an area needs at least 3 points, got 2"]


def test_range_shares_of_known_values(spark):
    values = [-1100.0, -1000.0, -501.0, -500.0, -1.0, 0.0, 99.0, 100.0, 999.0, 1000.0]
    counts = I.value_counts(spark.createDataFrame([(1, v) for v in values], "g int, value double"), ["g"])
    got = [(r["low"], r["voxels"]) for r in I.range_shares(counts, ["g"]).collect()]
    assert got == [(-1000.0, 2), (-500.0, 1), (-100.0, 1), (0.0, 2), (100.0, 1), (300.0, 1), (None, 2)]
    with pytest.raises(ValueError, match="overlap"):
        I.range_shares(counts, ["g"], [(0.0, 10.0), (5.0, 20.0)])


def test_texts(spark):
    one = spark.range(1)
    read = lambda t: one.select(T.numbers(F.lit(t))).first()[0]
    assert read("10-12") == [10.0, 12.0] and read("-12.5 1,000") == [-12.5, 1.0, 0.0] and read("--7. -.5 - 1.2.3") == [7.0, -0.5, 1.2, 3.0] and read("none") == []
    keys = ["b1000", "te80.5-tr40", "ex", "iso1-a3-n2", "Smith", "b", "b1-", "abcd1", "b1\n", "a1-" * 21 + "a1", None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(T.checked_volume_key(F.col("k"))).collect()
    assert [r[0] for r in got] == keys[:4] + ["other"] * 6 + [None]
    codes = one.select(*[T.checked_code(F.lit(c)).alias(f"c{n}") for n, c in enumerate((" ct ", "", "A" * 17, "C-T"))]).first()
    assert tuple(codes) == ("ct", None, None, None)
    assert one.select(T.checked_hash(F.lit("AB" * 32)), T.checked_hash(F.lit("g" * 64))).first()[:] == ("ab" * 32, None)


def test_secrets_are_found_in_any_column(spark):
    secrets = spark.createDataFrame([(1, "Jane Doe, born 1970"), (2, 'the "second" secret')], "secret_id long, secret string")
    table = spark.createDataFrame([(1, "nothing", ["x", "by Jane Doe, born 1970!"], {"k": 'see the "second" secret'}), (2, None, None, None)], "id int, a string, b array<string>, c map<string, string>")
    got = T.scan({"table": table, "numbers": spark.range(3), "clean": table.select("a")}, secrets).collect()
    assert sorted(map(tuple, got)) == [("table", "b", 1, 1), ("table", "c", 2, 1)]
    assert T.scan({"numbers": spark.range(3)}, secrets).count() == 0
