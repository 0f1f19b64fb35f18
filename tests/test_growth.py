"""What grows with the voxels: nearest places, regions, slices that are filled and lists of files."""

from collections import deque

import numpy as np
import pytest

from lumivox.catalog import flows, studies
from lumivox.functions import text as T
from lumivox.operators import filters as L
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.operators import studies as U
from lumivox.operators import surface as X

MASK = "series_id int, label int, i int, j int, k int"


def rows_written(monkeypatch, module):
    """The rows of each table that a module's operators write on their way."""
    seen, plain = [], module.tabled

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        seen.append(out.count())
        return out

    monkeypatch.setattr(module, "tabled", counted)
    return seen


def test_pairs_of_voxels_are_never_rows(spark, monkeypatch):
    block = [(1, 1, i, j, k) for i in range(6) for j in range(6) for k in range(6)]
    a, b = spark.createDataFrame(block, MASK), spark.createDataFrame([(n, 2, i + 9, j, k) for n, _, i, j, k in block], MASK)
    seen = rows_written(monkeypatch, M)
    got = M.distances(a, b, (1.0, 1.0, 2.0))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert max(seen) == len(block)
    assert {(r["i"], r["j"], r["k"]): (r["mm"], r["ti"], r["tj"], r["tk"]) for r in got.collect()} == {(i, j, k): (9.0 - i, 9, j, k) for _, _, i, j, k in block}


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_the_first_of_equals_is_nearest(block):
    rng = np.random.default_rng(3)
    own, others = rng.integers(0, 9, (40, 3)), rng.integers(0, 9, (30, 3))
    d2, at = M._nearest(own, others, (1.0, 0.5, 2.0), block)
    all_ = (((own[:, None] - others[None]) * (1.0, 0.5, 2.0)) ** 2).sum(axis=2)
    assert (d2 == all_.min(axis=1)).all() and (at == all_.argmin(axis=1)).all()


def test_regions_grow_on_runs(spark, monkeypatch):
    rows = [(n, i, j, k, 1 if (i, j) == (5, 5) else 0, 10.0 if j < 4 else 50.0) for n in (1, 2, 3) for i in range(12) for j in range(8) for k in range(4)]
    voxels = spark.createDataFrame(rows, "series_id int, i int, j int, k int, label int, value double")
    seeds = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 7, 1), (3, 5, 5, 0)], "series_id int, i int, j int, k int")
    seen = rows_written(monkeypatch, N)
    got = {(r["series_id"], r["i"], r["j"], r["k"], r["refused"]) for r in N.grow(voxels, seeds, 0.0, 20.0, 500).collect()}
    assert got == {(1, i, j, k, False) for i in range(12) for j in range(4) for k in range(4)}
    assert max(seen) <= 3 * 4 * 4  # a row a run of the band, none a voxel
    assert N.grow(voxels, seeds, 0.0, 20.0, 100).collect() == [(1, None, None, None, True)]


def flood(plane):
    """What four neighbours from the sides of its box don't reach of a plane."""
    out = np.zeros_like(plane)
    if not plane.any():
        return out
    box = tuple(slice(x.min(), x.max() + 1) for x in np.nonzero(plane))
    held = plane[box]
    way, todo = np.zeros_like(held), deque(p for p in map(tuple, np.argwhere(~held)) if p[0] in (0, held.shape[0] - 1) or p[1] in (0, held.shape[1] - 1))
    for p in todo:
        way[p] = True
    while todo:
        y, x = todo.popleft()
        for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= q[0] < held.shape[0] and 0 <= q[1] < held.shape[1] and not held[q] and not way[q]:
                way[q] = True
                todo.append(q)
    out[box] = ~held & ~way
    return out


@pytest.mark.parametrize("cells", [1, 1 << 21])
def test_slices_are_filled_without_rows_for_the_outside(spark, monkeypatch, cells):
    monkeypatch.setattr(N, "CELLS", cells)
    grids = [np.random.default_rng(n).random((13, 11, 6)) < share for n, share in enumerate((0.3, 0.6, 0.8))]
    grids.append(np.zeros((60, 50, 6), bool))
    grids[3][::59, :, 2] = grids[3][:, ::49, 2] = True  # a frame about much that is filled
    grids.append(np.zeros((60, 50, 6), bool))
    grids[4][0, 0, 0] = grids[4][59, 49, 0] = True  # two voxels far apart
    mask = spark.createDataFrame([(n, 1, *map(int, p)) for n, g in enumerate(grids) for p in np.argwhere(g)], MASK)
    wanted = []
    for g in grids:
        g = g.copy()
        for axis in range(3):
            planes = np.moveaxis(g, axis, 0)
            for plane in planes:
                plane |= flood(plane)
        wanted.append({tuple(map(int, p)) for p in np.argwhere(g)})
    seen = rows_written(monkeypatch, U)
    got = U.fill_by_slices(mask)
    assert max(seen) == sum(map(len, wanted))
    found = got.collect()
    assert len(found) == sum(map(len, wanted))
    assert [{(r["i"], r["j"], r["k"]) for r in found if r["series_id"] == n} for n in range(len(grids))] == wanted


def test_lists_of_files_are_not_gathered(spark):
    one = [(1, 0, "a", "x"), (1, 0, "b", "y"), (1, 1, "b", "y"), (1, 1, "a", "x")]
    two = [(2, 0, "a", "x"), (2, 1, "a", "z")]
    three = [(3, 0, "a", "x"), (3, 1, "a", "x"), (3, 1, "b", None)]
    four = [(4, 0, "a", None), (4, 1, "a", None), (5, 0, "a", "x"), (6, 1, "a", "x")]
    repeated = [(7, 0, "a", "x"), (7, 0, "a", "x"), (7, 1, "a", "x")]
    same = flows._same_files(spark.createDataFrame(one + two + three + four + repeated, "series int, workspace int, path string, sha256 string"))
    assert "collect_list" not in same._jdf.queryExecution().toString()
    assert {(r["series"], r["same"], r["files"]) for r in same.collect()} == {(1, True, 2), (2, False, 1), (3, False, 1), (4, True, 1), (7, False, 2)}


def by_even_odd(corners, width, height):
    """The pixels inside a polygon, each tested against every edge."""
    out = set()
    for y in range(height):
        for x in range(width):
            n = sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]))
            if n % 2:
                out.add((x, y))
    return out


@pytest.mark.parametrize("crossings", [1, 1 << 20])
def test_lassos_are_runs(spark, monkeypatch, crossings):
    monkeypatch.setattr(U, "CROSSINGS", crossings)
    rng = np.random.default_rng(5)
    shapes = [(rng.integers(-20, 80, (n, 2)) / 4 - (n == 7) * 30).tolist() for n in (1, 2, 3, 3, 4, 4, 5, 6, 7, 9, 12)]
    shapes += [[], [[2.0, 3.0], [8.0, 3.0], [8.0, 9.0], [2.0, 9.0]], [[-5.0, -5.0], [50.0, -5.0], [50.0, 50.0], [-5.0, 50.0]]]
    table = spark.createDataFrame([(n, [tuple(p) for p in s]) for n, s in enumerate(shapes)] + [(99, None)], "id int, corners array<struct<x: double, y: double>>")
    wanted = {(n, x, y) for n, s in enumerate(shapes) for x, y in by_even_odd(s, 16, 12)}
    assert len(wanted) > 300
    got = [tuple(r) for r in U.rasterised_lassos(table, 16, 12).select("id", "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    runs = U.lasso_runs(table, 16, 12).collect()
    assert sum(r["x1"] - r["x0"] + 1 for r in runs) == len(wanted) and len(runs) < len(wanted) / 2


def test_strokes_are_dealt_out_and_lassos_make_no_pixels(spark):
    plan = studies.QUERIES["geo07_strokes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "MapInArrow" in plan
    assert "lambdafunction" not in plan


def test_robust_growth_makes_no_rows_of_the_band(spark, monkeypatch):
    """Across bricks: smoothed by the box, 6-connected with the seed, and what lies beside it by its own value."""
    shape = (6, 70, 5)
    raw = np.random.default_rng(8).integers(0, 30, shape).astype(float)
    raw[:, :, 4] = 500.0
    raw[3, 40:66, 2] = 300.0
    there = np.random.default_rng(9).random(shape) < 0.97
    label = np.zeros(shape, int)
    label[:, 20, :3] = 1
    there[1, 5, 1] = True
    rows = [(7, *map(int, p), int(label[tuple(p)]), float(raw[tuple(p)])) for p in np.argwhere(there)]
    voxels = spark.createDataFrame(rows, "series_id bigint, i int, j int, k int, label int, value double")
    smooth, known = raw.copy(), there
    for axis in range(3):
        pads = [(1, 1) if a == axis else (0, 0) for a in range(3)]
        parts = [np.moveaxis(np.pad(np.where(known, x, 0.0), pads), axis, 0) for x in (smooth, np.ones(shape))]
        total, n = (np.moveaxis(p[:-2] + p[1:-1] + p[2:], 0, axis) for p in parts)
        smooth = np.divide(total, n, out=np.zeros(shape), where=there)
    near = sorted(smooth[tuple(p)] for p in np.argwhere(there) if (abs(p - (1, 5, 1)) <= 1).all())
    level = near[len(near) // 2]
    free = there & (label == 0)
    core, own = free & (abs(smooth - level) <= 4.0), free & (abs(raw - level) <= 4.0)
    core[1, 5, 1] = True
    grown, todo = {(1, 5, 1)}, deque([(1, 5, 1)])
    while todo:
        p = todo.popleft()
        for d in M.FACES:
            q = tuple(a + b for a, b in zip(p, d))
            if all(0 <= a < n for a, n in zip(q, shape)) and core[q] and q not in grown:
                grown.add(q)
                todo.append(q)
    edge = {tuple(map(int, p)) for p in np.argwhere(own & ~core) if any(tuple(int(a + b) for a, b in zip(p, d)) in grown for d in M.AROUND)}
    seen = rows_written(monkeypatch, X)
    got = X.grow_robust(voxels, spark.createDataFrame([(7, 1, 5, 1)], "series_id bigint, i int, j int, k int"), 1, 4.0).collect()
    assert {(r["i"], r["j"], r["k"], r["core"]) for r in got} == {(*p, True) for p in grown} | {(*p, False) for p in edge}
    assert len(got) == len(grown) + len(edge) > 100
    assert max(seen) < len(rows)  # before, the smoothed values were written


def test_openings_look_no_farther_than_the_radius():
    d2 = np.where(np.random.default_rng(4).random((9, 14, 11)) < 0.02, 0.0, np.inf)
    near, whole = d2, d2
    for axis, reach, step in ((2, 3, 1.0), (1, 2, 1.25), (0, 2, 2.0)):
        near, whole = N._least_within(near, axis, reach, step), N._along(whole, axis, step)
    assert (np.where(near <= 6.25, near, -1) == np.where(whole <= 6.25, whole, -1)).all()
    assert ((near < 6.25) == (whole < 6.25)).all()


def test_edges_are_sought_in_bricks(spark):
    """Across bricks and with a voxel that isn't there; no line is summed by a lambda."""
    shape = (5, 67, 4)
    value = np.random.default_rng(6).integers(-50, 50, shape).astype(float)
    rows = [(3, *map(int, p), float(value[tuple(p)])) for p in np.ndindex(shape) if p != (2, 30, 1)]
    value[2, 30, 1] = 0.0
    wide, flat, step = np.pad(value, 1, mode="edge"), (1, 2, 1), (-1, 0, 1)
    total = np.zeros(shape)
    for axis in range(3):
        slope = np.zeros(shape)
        for off in np.ndindex(3, 3, 3):
            weight = np.prod([(step if a == axis else flat)[o] for a, o in enumerate(off)])
            slope += weight * wide[tuple(slice(o, o + n) for o, n in zip(off, shape))]
        total += slope**2
    total[2, 30, 1] = 0.0
    edge = np.sqrt(total) / np.sqrt(total.max())
    got = L.sobel(spark.createDataFrame(rows, "series_id bigint, i int, j int, k int, value double"))
    assert "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["i"], r["j"], r["k"]): r["edge"] for r in got.collect()}
    assert len(found) == len(rows)
    assert all(abs(e - edge[p]) < 1e-12 for p, e in found.items())


def test_secrets_are_found_across_blocks(spark, monkeypatch):
    """Wherever they begin, also repetitive ones; a text with a part of a secret is not looked through."""
    monkeypatch.setattr(T, "BLOCK", 30)
    secrets = [(1, "Customer#000000017"), (2, "abcabcabcabcabcabcabcabcabcabcabc"), (3, "the quick brown fox jumps over the lazy dog"), (4, "\u00e9\U0001f600" * 12)]
    texts = [(100 * n + at, "x" * at + s + "\n" + "y" * (at % 5)) for n, s in secrets for at in range(40)] + [(9000, "the quick brown fox"), (9001, None), (9002, ""), (9003, "Customer#000000018 " * 9)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = T.find_secrets(table, spark.createDataFrame(secrets, "secret_id bigint, secret string"))
    assert {tuple(r) for r in got.collect()} == {(d, n) for d, t in texts for n, s in secrets if t and s in t}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "needed" in plan and "regexp_extract_all" in plan
