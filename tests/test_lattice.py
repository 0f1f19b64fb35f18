"""Runs, bricks and distances on the lattice against brute force."""

from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumivox.operators import lattice as N

MASK = "series_id int, label int, i int, j int, k int"


def random_mask(seed, shape=(11, 9, 7), share=0.55):
    return np.random.default_rng(seed).random(shape) < share


def frame(spark, masks):
    rows = [(n, 1, *map(int, p)) for n, m in enumerate(masks) for p in np.argwhere(m)]
    return spark.createDataFrame(rows, MASK)


def found(rows, shape, count):
    out = np.zeros((count, *shape), bool)
    for r in rows.collect():
        out[r["series_id"], r["i"], r["j"], r["k"]] = True
    return out


def box_of(m):
    return tuple(slice(x.min(), x.max() + 1) for x in np.nonzero(m))


def brute_enclosed(m):
    """What no 6-connected way leads out of the mask's box."""
    out, box = np.zeros_like(m), box_of(m)
    outside = ~m[box]
    seen = np.zeros_like(outside)
    ends = [n - 1 for n in outside.shape]
    todo = deque(p for p in map(tuple, np.argwhere(outside)) if any(x in (0, e) for x, e in zip(p, ends)))
    for p in todo:
        seen[p] = True
    while todo:
        p = todo.popleft()
        for axis in range(3):
            for d in (-1, 1):
                q = tuple(x + d * (a == axis) for a, x in enumerate(p))
                if all(0 <= x <= e for x, e in zip(q, ends)) and outside[q] and not seen[q]:
                    seen[q] = True
                    todo.append(q)
    out[box] = outside & ~seen
    return out


@pytest.mark.parametrize("brick", [2, 64])
def test_enclosed_equals_a_flood(spark, monkeypatch, brick):
    monkeypatch.setattr(N, "BRICK", brick)
    masks = [random_mask(s, share=p) for s, p in ((1, 0.55), (2, 0.75), (3, 0.9))] + [np.ones((11, 9, 7), bool)]
    masks[3][3:6, 3:6, 3:5] = False
    got = found(N.enclosed(frame(spark, masks)), (11, 9, 7), 4)
    assert all((got[n] == brute_enclosed(m)).all() for n, m in enumerate(masks)) and got.any()
    cavities = {r["series_id"]: (r["cavities"], r["voxels"]) for r in N.cavities(frame(spark, masks)).collect()}
    assert cavities[3] == (1, 18) and {n: v for n, (_, v) in cavities.items()} == {n: int(brute_enclosed(m).sum()) for n, m in enumerate(masks) if brute_enclosed(m).any()}


def test_gaps_are_runs(spark):
    """A hollow ball's outside is a few runs a line, not a row a voxel."""
    x, y, z = np.mgrid[:30, :30, :30] - 14
    ball = (x * x + y * y + z * z <= 190) & (x * x + y * y + z * z > 60)
    runs = N.mask_runs(frame(spark, [ball]))
    gaps = N.enclosed_runs(frame(spark, [ball]))
    lines = 27 * 27
    assert runs.count() < 2 * lines and gaps.count() < lines
    assert gaps.selectExpr("sum(i1 - i0 + 1)").first()[0] == int((x * x + y * y + z * z <= 60).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.0, 1.0, 4.0, 9.0, 30.25, float("inf")]), min_size=9, max_size=9), min_size=1, max_size=6), st.sampled_from([0.5, 1.0, 2.5]))
def test_envelope_equals_brute_force(rows, step):
    f = np.array(rows)
    places = np.arange(9)
    expected = (f[:, None, :] + ((places[:, None] - places[None]) * step) ** 2).min(axis=2)
    got = N._envelope(f, step)
    assert np.array_equal(np.isinf(got), np.isinf(expected)) and np.allclose(got[np.isfinite(got)], expected[np.isfinite(expected)])


def brute_opened(m, spacing, radius):
    grid = np.stack(np.meshgrid(*[np.arange(-9, 20)] * 3, indexing="ij"), axis=-1)
    own = {tuple(p) for p in np.argwhere(m)}
    reach = [tuple(p) for p in grid.reshape(-1, 3) if (p != 0).any() and ((p * spacing) ** 2).sum() < radius**2]
    near = [(0, 0, 0), *[tuple(p) for p in grid.reshape(-1, 3) if (p != 0).any() and ((p * spacing) ** 2).sum() <= radius**2]]
    core = {p for p in own if all(tuple(np.add(p, d)) in own for d in reach)}
    return {tuple(np.add(p, d)) for p in core for d in near} & own if core else own


@pytest.mark.parametrize("brick, radius", [(8, 2.0), (64, 3.1)])
def test_opening_equals_brute_force(spark, monkeypatch, brick, radius):
    monkeypatch.setattr(N, "BRICK", brick)
    one = np.zeros((18, 16, 14), bool)
    one[1:8, 2:14, 1:9] = one[11:17, 3:12, 2:12] = True
    one[7:12, 5:6, 4:5] = True
    thin = np.zeros_like(one)
    thin[2, 3, 1:9] = True
    spacing = np.array([1.0, 0.8, 1.5])
    got = found(N.opening(frame(spark, [one, thin]), tuple(spacing), radius), one.shape, 2)
    for n, m in enumerate((one, thin)):
        assert {tuple(p) for p in np.argwhere(got[n])} == brute_opened(m, spacing, radius)


def test_of_equally_near_cores_the_larger_stays(spark):
    """Grid order would choose the one at the begin of the line."""
    m = np.zeros((21, 7, 7), bool)
    m[0:5, 1:6, 1:6] = m[14:19, 0:7, 0:7] = True
    m[5:14, 3:4, 3:4] = True
    seed = spark.createDataFrame([(0, 1, 9, 3, 3), (1, 1, 11, 3, 3)], MASK)
    got = found(N.opening(frame(spark, [m, m[::-1]]), (1.0, 1.0, 1.0), 2.0, seed), m.shape, 2)
    assert not got[0, :5].any() and got[0, 14:19].any()
    assert got[1, 2:7].any() and not got[1, 16:].any()
