"""Convex hulls of segments, and the farthest pairs that lie on them.

Only what is first or last on its line along every axis can be a corner, so a segment is cut down to such ends by
pre-aggregated minima and maxima before anything is gathered: some thousands of points of a segment of millions of voxels,
and never more than the grid has lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.operators.masks import FACES, KEY, VOX, largest_slice
from lumivox.plans.groups import over_groups
from lumivox.plans.joins import merge_join


def line_ends(points: DataFrame, axes: list[str] = VOX, key: list[str] = KEY) -> DataFrame:
    """The points that are first or last on their lines along every one of ``axes``: all corners of the hull are among them."""
    for axis in axes:
        line = [*key, *[a for a in VOX if a != axis]]
        ends = points.groupBy(*line).agg(F.min(axis).alias("low"), F.max(axis).alias("high"))
        points = ends.select(*line, F.explode(F.array_distinct(F.array("low", "high"))).alias(axis))
    return points.select(*key, *VOX)


def mesh_points(mask: DataFrame) -> DataFrame:
    """The corners of the mesh between inside and outside voxel centres, in half voxels: the middles of the edges that are cut."""
    inside = mask.select(*KEY, *VOX).distinct()
    beside = inside.select(*KEY, *VOX, F.explode(F.array(*[F.array(*map(F.lit, face)) for face in FACES])).alias("face"))
    moved = beside.select(*KEY, *[(F.col(a) + F.get("face", n)).alias(a) for n, a in enumerate(VOX)], "face")
    cut = merge_join(moved, inside, on=[*KEY, *VOX], how="left_anti")
    return cut.select(*KEY, *[(2 * F.col(a) - F.get("face", n)).alias(a) for n, a in enumerate(VOX)])


def _facets(points: np.ndarray) -> np.ndarray:
    """The triangles (three places in ``points`` each, seen from outside) of a hull in space, by quickhull.

    Points are first moved by a millionth of a voxel, so that no four lie in one plane.
    """
    p = points + np.random.default_rng(0).uniform(-1e-6, 1e-6, points.shape)
    a, b = int(p[:, 0].argmin()), int(p[:, 0].argmax())
    line = (p[b] - p[a]) / np.linalg.norm(p[b] - p[a])
    off = p - p[a]
    c = int(np.linalg.norm(off - np.outer(off @ line, line), axis=1).argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.abs(off @ normal).argmax())
    if (p[d] - p[a]) @ normal > 0:
        b, c = c, b
    faces = {n: f for n, f in enumerate([(a, b, c), (a, d, b), (b, d, c), (c, d, a)])}
    planes = {}

    def plane(f: tuple[int, int, int]) -> tuple[np.ndarray, float]:
        normal = np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])
        return normal, float(normal @ p[f[0]])

    def deal(places: np.ndarray, names: list[int]) -> None:
        """Gives each point to the first of the faces that it is outside of."""
        for n in names:
            normal, level = planes[n]
            out = p[places] @ normal - level > 1e-9 * np.linalg.norm(normal)
            outside[n] = places[out]
            places = places[~out]

    planes = {n: plane(f) for n, f in faces.items()}
    outside: dict[int, np.ndarray] = {}
    deal(np.setdiff1d(np.arange(len(p)), [a, b, c, d]), list(faces))
    edge_of = {(f[k], f[(k + 1) % 3]): n for n, f in faces.items() for k in range(3)}
    name = len(faces)
    waiting = [n for n in faces if len(outside[n])]
    while waiting:
        n = waiting.pop()
        if n not in faces or not len(outside[n]):
            continue
        normal, level = planes[n]
        top = int(outside[n][(p[outside[n]] @ normal).argmax()])
        seen, stack, horizon = {n}, [n], []
        while stack:
            m = stack.pop()
            for k in range(3):
                u, v = faces[m][k], faces[m][(k + 1) % 3]
                other = edge_of[v, u]
                if other in seen:
                    continue
                if p[top] @ planes[other][0] - planes[other][1] > 0:
                    seen.add(other)
                    stack.append(other)
                else:
                    horizon.append((u, v))
        freed = np.concatenate([outside.pop(m) for m in seen])
        for m in seen:
            for k in range(3):
                edge_of.pop((faces[m][k], faces[m][(k + 1) % 3]), None)
            faces.pop(m), planes.pop(m)
        new = []
        for u, v in horizon:
            faces[name] = (u, v, top)
            planes[name] = plane(faces[name])
            for k in range(3):
                edge_of[faces[name][k], faces[name][(k + 1) % 3]] = name
            new.append(name)
            name += 1
        deal(freed[freed != top], new)
        waiting += [m for m in new if len(outside[m])]
    return np.array(list(faces.values()))


def _each(points: DataFrame, columns: str, measure: Callable[[np.ndarray], tuple], names: list[str]) -> DataFrame:
    """``measure`` of every segment's points, in grid order, many segments to a table."""

    def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        places = np.stack([table.column(a).to_numpy().astype(float) for a in VOX], axis=1)
        found = zip(*[measure(some) for some in np.split(places, first[1:])])
        yield pa.record_batch([*[table.column(k).combine_chunks().take(pa.array(first)) for k in KEY], *[pa.array(c, kind) for c, kind in zip(found, types)]], names=[*KEY, *names])

    types = [{"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in columns.split(", ")]
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in KEY)
    return over_groups(points.select(*KEY, *VOX), KEY, ["k", "j", "i"], work, f"{kinds}, {columns}")


def convex_hull(mask: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """``hull_volume_mm3, hull_area_mm2, corners`` of the hull of each segment's mesh."""
    scale = np.array(spacing) / 2

    def measure(points: np.ndarray) -> tuple:
        faces = _facets(points)
        a, b, c = (points[faces[:, k]] * scale for k in range(3))
        cross = np.cross(b - a, c - a)
        return float((a * cross).sum() / 6), float(np.linalg.norm(cross, axis=1).sum() / 2), len(np.unique(faces))

    return _each(line_ends(mesh_points(mask)), "hull_volume_mm3 double, hull_area_mm2 double, corners long", measure, ["hull_volume_mm3", "hull_area_mm2", "corners"])


def _farthest(points: np.ndarray, scale: np.ndarray, block: int = 1024) -> tuple[float, np.ndarray, np.ndarray]:
    """The squared distance and the ends of the farthest pair; of equals the one whose ends come first, row after row."""
    order = np.lexsort(points.T)
    p = points[order] * scale
    best, at = -1.0, (0, 0)
    for i in range(0, len(p), block):
        d2 = ((p[i : i + block, None, :] - p[None, :, :]) ** 2).sum(axis=2)
        k = int(d2.argmax())
        if d2.flat[k] > best:
            best, at = float(d2.flat[k]), (i + k // len(p), k % len(p))
    return best, points[order][at[0]], points[order][at[1]]


def _corners(points: np.ndarray) -> np.ndarray:
    """Of many points only the corners of their hull; few, or flat ones, as they are."""
    if len(points) < 400 or np.linalg.matrix_rank(points - points[0]) < 3:
        return points
    return points[np.unique(_facets(points))]


def max_diameter(mask: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """``diameter_mm``: the farthest pair of voxel centres of each segment, among the corners of their hull."""
    scale = np.array(spacing)
    return _each(line_ends(mask.select(*KEY, *VOX)), "diameter_mm double", lambda p: (float(np.sqrt(_farthest(_corners(p), scale)[0])),), ["diameter_mm"])


def axial_axes(mask: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """``k, long_mm, i0, j0, i1, j1, short_mm``: on the largest axial slice the farthest pair of pixel centres, and the widest extent across it.

    The pair is the first of equals in grid order. Bands one pixel wide along it are compared, and their extents
    across it; the pair has one row a segment, so the slice's pixels meet it in a join that needs no gathering.
    """
    at = largest_slice(mask).where("axis = 'axial'").select(*KEY, (F.col("slice") - 1).cast("int").alias("k"))
    here = merge_join(mask.select(*KEY, *VOX), at, on=[*KEY, "k"])
    scale = np.array(spacing)

    def pair(points: np.ndarray) -> tuple:
        d2, a, b = _farthest(points, scale)
        return float(np.sqrt(d2)), int(a[0]), int(a[1]), int(b[0]), int(b[1]), int(a[2])

    names = ["long_mm", "i0", "j0", "i1", "j1", "k"]
    axis = _each(line_ends(here, ["i", "j"]), "long_mm double, i0 int, j0 int, i1 int, j1 int, k int", pair, names)
    dx, dy = (F.col("i1") - F.col("i0")) * spacing[0], (F.col("j1") - F.col("j0")) * spacing[1]
    x, y = (F.col("i") - F.col("i0")) * spacing[0], (F.col("j") - F.col("j0")) * spacing[1]
    unit = F.when(F.col("long_mm") > 0, F.col("long_mm")).otherwise(1.0)
    along, across = (x * dx + y * dy) / unit, (y * dx - x * dy) / unit
    bands = merge_join(here, axis, on=[*KEY, "k"]).groupBy(*KEY, *names, F.round(along / min(spacing[:2]), 0).alias("band")).agg((F.max(across) - F.min(across)).alias("wide"))
    return bands.groupBy(*KEY, *names).agg(F.max("wide").alias("short_mm"))

