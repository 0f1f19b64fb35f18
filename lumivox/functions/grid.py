"""Column functions on stored values, windows, transfer functions and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORED = 65535


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def step(low: Column, high: Column) -> Column:
    """The value of one stored unit; a range without extent counts as one wide."""
    return F.when(high > low, high - low).otherwise(1.0) / STORED


def to_storage(value: Column, low: Column, high: Column) -> Column:
    """The stored number nearest to a value, within 0 to 65535."""
    return clamp(F.round((value - low) / step(low, high)), 0.0, float(STORED)).cast("int")


def from_storage(stored: Column, low: Column, high: Column) -> Column:
    """The value of a stored number, in single precision."""
    return (low + stored * step(low, high)).cast("float")


def normalize(value: Column, low: Column, high: Column) -> Column:
    """A value's place in its range, 0 to 1."""
    return clamp((value - low) / F.when(high > low, high - low).otherwise(1.0), 0.0, 1.0)


def denormalize(share: Column, low: Column, high: Column) -> Column:
    return low + clamp(share, 0.0, 1.0) * F.when(high > low, high - low).otherwise(1.0)


def window_level(value: Column, center: Column, width: Column) -> Column:
    """A value's place in a display window, 0 to 1; a width below one counts as one."""
    wide = F.greatest(width, F.lit(1.0))
    return clamp((value - (center - wide / 2)) / wide, 0.0, 1.0)


def grey(share: Column) -> Column:
    return F.round(share * 255).cast("int")


def to_patient(index: list[Column], origin: list[Column], spacing: list[Column], direction: list[list[float]] | None = None) -> list[Column]:
    """Millimetres of a voxel's centre: origin + D (index * spacing)."""
    mm = [a * b for a, b in zip(index, spacing)]
    d = direction or [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    return [origin[r] + sum((F.lit(float(d[r][c])) * mm[c] for c in range(3)), F.lit(0.0)) for r in range(3)]


def to_voxel(mm: list[Column], origin: list[Column], spacing: list[Column], direction: list[list[float]] | None = None) -> list[Column]:
    """The continuous voxel index of a point: the transposed direction of what lies beyond the origin, by spacing."""
    d = direction or [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    off = [mm[r] - origin[r] for r in range(3)]
    return [sum((F.lit(float(d[r][c])) * off[r] for r in range(3)), F.lit(0.0)) / spacing[c] for c in range(3)]


def inside_grid(index: list[Column], size: list[int]) -> Column:
    """Whether the nearest voxel of a continuous index is on the grid."""
    flags = [F.round(x).between(0, n - 1) for x, n in zip(index, size)]
    return flags[0] & flags[1] & flags[2]


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """The grey of a colour, by the weights of its parts (fixed values)."""
    return red * 0.299 + green * 0.587 + blue * 0.114


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Straight lines between control points of rising places; the ends hold beyond them."""
    y = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        y = F.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(y)
    return F.when(x <= points[0][0], F.lit(points[0][1])).otherwise(y)


def grid_exponent(low: Column, high: Column) -> Column:
    """The power of two of the least step whose 65,535 steps cover a range; null for a range without extent."""
    return F.when(high > low, F.ceil(F.log2((high - low) / STORED)).cast("long"))


def on_grid(value: Column, low: Column, exponent: Column) -> Column:
    """Whether a value is a whole number of steps above the range's begin."""
    steps = (value - low) / F.pow(F.lit(2.0), exponent)
    return steps == F.floor(steps)
