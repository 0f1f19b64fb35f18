"""Annotations: values and units, distance from a point, ownership, names and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _p(i: int, axis: str) -> Column:
    return F.col("points")[i][axis]


def polygon_area(points: Column) -> Column:
    """Area of a polygon by its corners' cross products."""
    n = F.size(points)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def angle(points: Column) -> Column:
    """Degrees at the second of three points; null where two are the same."""
    a, b, c = (points[i] for i in range(3))
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    norm = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    return F.when(norm > 0, F.degrees(F.acos(F.least(F.greatest((ux * vx + uy * vy) / norm, F.lit(-1.0)), F.lit(1.0)))))


def value(kind: Column, points: Column) -> Column:
    """Millimetres of a distance, degrees of an angle, square millimetres of an area or a rectangle; text has none."""
    a, b = points[0], points[1]
    distance = F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2)))
    rectangle = F.abs((b["x"] - a["x"]) * (b["y"] - a["y"]))
    return F.when(kind == "Distance", distance).when(kind == "Angle", angle(points)).when(kind == "Area", polygon_area(points)).when(kind == "Rectangle", rectangle)


def unit(kind: Column) -> Column:
    return F.when(kind == "Distance", "mm").when(kind == "Angle", "deg").when(kind.isin("Area", "Rectangle"), "mm2")


def values(annotations: DataFrame) -> DataFrame:
    return annotations.select("id", "kind", value(F.col("kind"), F.col("points")).alias("value"), unit(F.col("kind")).alias("unit"))


def _from_segment(x: float, y: float, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(long, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.sqrt(F.pow(x - (a["x"] + t * dx), F.lit(2)) + F.pow(y - (a["y"] + t * dy), F.lit(2)))


def nearest(annotations: DataFrame, x: float, y: float, tolerance: float) -> DataFrame:
    """On each slice the annotation whose line is nearest to a point, if within the tolerance.

    Each of a line's segments is a row: their distances are compiled, and the points aren't made anew for each of them.
    """
    points = F.col("points")
    most = F.greatest(F.size(points) - 1, F.lit(0))
    segments = annotations.select("workspace", "slice_index", "id", F.inline(F.arrays_zip(F.slice(points, F.lit(1), most).alias("a"), F.slice(points, F.lit(2), most).alias("b"))))
    reached = segments.select("workspace", "slice_index", "id", _from_segment(x, y, F.col("a"), F.col("b")).alias("mm")).where(F.col("mm") <= tolerance)
    return reached.groupBy("workspace", "slice_index").agg(F.min(F.struct("mm", "id")).alias("m")).select("workspace", "slice_index", F.col("m.id").alias("id"), F.col("m.mm").alias("mm"))


def voxel_points(slices: int = 12) -> Column:
    """The points as ``(i, j, k)``: on axial slices as they are, on coronal and sagittal ones with k upwards (``slices`` of it), as the planes are shown."""
    at = F.col("slice_index").cast("double")
    up = lambda y: F.lit(slices - 1.0) - y
    plane = F.lower("plane")
    return F.transform("points", lambda p: F.when(plane == "axial", F.array(p["x"], p["y"], at)).when(plane == "coronal", F.array(p["x"], at, up(p["y"]))).otherwise(F.array(at, p["x"], up(p["y"]))))


def in_space(measures: DataFrame) -> DataFrame:
    """``id, value, unit, uncertainty_mm, reason`` of ``id, kind, voxels`` on grids (``origin``, ``axes``: the directions of i, j and k, ``spacing``), in patient millimetres.

    A distance needs two points and is sure to one voxel along the largest spacing; an angle, at the second, three, with arms that have a length;
    an area three or more: half the length of the corners' summed cross products, so that polygons in any plane have theirs. What is refused says why.
    """
    place = lambda p, n: F.get("origin", F.lit(n)) + sum((F.get(p, F.lit(a)) * F.get("spacing", F.lit(a)) * F.get(F.get("axes", F.lit(a)), F.lit(n)) for a in range(3)), F.lit(0.0))
    mm = measures.withColumn("mm", F.transform("voxels", lambda p: F.array(*[place(p, n) for n in range(3)])))
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    at = lambda n: F.get("mm", F.lit(n))
    u, w = less(at(0), at(1)), less(at(2), at(1))
    arms = norm(u) * norm(w)
    bend = F.degrees(F.acos(F.least(F.greatest(dot(u, w) / F.nullif(arms, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))))
    following = lambda i: F.get("mm", (i + 1) % F.size("mm"))
    part = lambda a, b, n: F.get(a, F.lit((n + 1) % 3)) * F.get(b, F.lit((n + 2) % 3)) - F.get(a, F.lit((n + 2) % 3)) * F.get(b, F.lit((n + 1) % 3))
    crosses = F.transform("mm", lambda a, i: F.array(*[part(a, following(i), n) for n in range(3)]))
    area = norm(F.aggregate(crosses, F.array(*[F.lit(0.0)] * 3), lambda s, c: F.zip_with(s, c, lambda x, y: x + y))) / 2
    size, kind = F.size("voxels"), F.col("kind")
    reason = F.when((kind == "Distance") & (size != 2), F.concat(F.lit("a distance needs 2 points, got "), size)).when((kind == "Angle") & (size != 3), F.concat(F.lit("an angle needs 3 points, got "), size))
    reason = reason.when((kind == "Area") & (size < 3), F.concat(F.lit("an area needs at least 3 points, got "), size)).when((kind == "Angle") & (arms == 0), "the arms of the angle must have length")
    known = mm.withColumn("reason", reason)
    value_ = F.when(F.col("reason").isNull(), F.when(kind == "Distance", norm(less(at(0), at(1)))).when(kind == "Angle", bend).when(kind == "Area", area))
    sure = F.when((kind == "Distance") & F.col("reason").isNull(), F.round(F.array_max("spacing"), 3))
    return known.select("id", value_.alias("value"), F.when(F.col("reason").isNull(), unit(kind)).alias("unit"), sure.alias("uncertainty_mm"), "reason")


def changeable() -> Column:
    """An agent may change what an agent made and nobody confirmed."""
    return (F.col("author") == "agent") & (F.col("status") != "confirmed")


def refusal() -> Column:
    return F.when(F.col("author") != "agent", "made by a person").when(F.col("status") == "confirmed", "confirmed")


def default_names(annotations: DataFrame) -> DataFrame:
    """"Kind n", counted in each workspace."""
    return annotations.select("id", F.concat_ws(" ", "kind", F.row_number().over(Window.partitionBy("workspace", "kind").orderBy("id")).cast("string")).alias("name"))


#: How many points each kind has: at least, and at most (fixed values).
POINTS = {"Distance": (2, 2), "Rectangle": (2, 2), "Angle": (3, 3), "Area": (3, 1 << 20), "Text": (1, 1)}


def asked_change(annotations: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``id, asked, kind, points, slices, new_name`` applied to ``annotations``: each request with its outcome, and the item as it is then.

    ``add`` wants a known kind, as many points as it has, all on one slice, and an id that isn't there; ``rename`` and ``delete`` want an item that an
    agent made and nobody has confirmed. Refused requests say why and change nothing. One row a request; an item that isn't asked about isn't given.
    """
    there = annotations.select("id", F.col("kind").alias("old_kind"), F.col("name").alias("old_name"), "author", "status", F.lit(True).alias("there"))
    both = requests.join(there, "id", "left")
    least = F.create_map(*[F.lit(x) for k, (n, _) in POINTS.items() for x in (k, n)])
    most = F.create_map(*[F.lit(x) for k, (_, n) in POINTS.items() for x in (k, n)])
    add = (
        F.when(F.col("there"), "there already").when(least[F.col("kind")].isNull(), "unknown kind")
        .when(~F.size("points").between(least[F.col("kind")], most[F.col("kind")]), "wrong number of points").when(F.size(F.array_distinct("slices")) > 1, "points on several slices")
    )
    change = F.when(F.col("there").isNull(), "not found").otherwise(refusal())
    reason = F.when(F.col("asked") == "add", add).otherwise(change)
    done = both.withColumn("reason", reason)
    name = F.when(F.col("reason").isNotNull() | (F.col("asked") == "delete"), F.col("old_name")).otherwise(F.col("new_name"))
    gone = F.col("reason").isNull() & (F.col("asked") == "delete")
    return done.select("id", "asked", "reason", F.when(F.col("asked") == "add", F.col("kind")).otherwise(F.col("old_kind")).alias("kind"), F.when(~gone, name).alias("name"), (~gone & (F.col("reason").isNull() | F.col("there"))).alias("kept"))


def report(annotations: DataFrame) -> DataFrame:
    """The report's rows as JSON: values and points to thousandths, the ``spacing`` to millionths, the slice by index and number, and whether they are confirmed."""
    rounded = lambda points: F.transform(points, lambda p: F.transform(p, lambda x: F.round(x, 3)))
    row = F.struct(
        "id", "name", "kind", F.lower("plane").alias("plane"), "slice_index", (F.col("slice_index") + 1).alias("slice_number"), F.round(value(F.col("kind"), F.col("points")), 3).alias("value"), unit(F.col("kind")).alias("unit"),
        rounded(F.transform("points", lambda p: F.array(p["x"], p["y"]))).alias("points_mm"), rounded(voxel_points()).alias("points_voxel"),
        F.transform("spacing", lambda x: F.round(x, 6)).alias("spacing_mm"), (F.col("status") == "confirmed").alias("confirmed"),
    )
    return annotations.select("workspace", F.to_json(row).alias("row"))
