"""Study-level queries: frames, sidecars, prompts, catalogues over formats, filters, rasterised strokes, holes by slice, proposals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumivox.catalog.intensity import _rounded
from lumivox.catalog.segments import _long
from lumivox.operators import annotations as A
from lumivox.operators import filters as X
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.operators import profiles as P
from lumivox.operators import series as S
from lumivox.operators import studies as U
from lumivox.plans.scratch import scratch_path, tabled, written
from lumivox.sources import cohort as C
from lumivox.sources import volumes as V
from lumivox.streaming import feeds


def _frames(s, d):
    """A multi-frame file an order: its lines are its frames; the file's own values stand in where a frame has none."""
    lines = C.table(s, d, "lineitem")
    frame = F.struct(F.col("l_linenumber").alias("number"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber") * 2.5).alias("z"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))
    return lines.groupBy(F.col("l_orderkey").alias("file")).agg(F.array_sort(F.collect_list(frame)).alias("frames"), F.max(F.when(F.col("l_partkey") % 5 == 0, F.lit(1.5))).alias("shared_thickness"))


def _sidecars(s, d):
    """A sidecar a customer, b-values as text or frame starts as JSON, used only if there are as many as volumes."""
    o = C.table(s, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.count("*").alias("volumes"), F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    o = o.withColumn("volumes", F.col("volumes") + (F.col("file") % 7 == 0).cast("int"))
    b = o.where("file % 2 = 0").select("file", "volumes", F.concat_ws(" ", F.transform("keys", lambda k: (k % 3 * 500).cast("string"))).alias("text"))
    starts = F.transform("keys", lambda k: k % 50 + 0.5)
    t = o.where("file % 2 = 1").select("file", "volumes", F.to_json(F.struct(starts.alias("FrameTimesStart"), F.lit("x").alias("Units"))).alias("text"))
    return U.sidecar_names(b).withColumn("start", F.lit(-1.0)).unionByName(U.frame_times(t))


def _prompts(s, d):
    """A history of prompts a customer, written as JSON and read back; lasso masks are run lengths."""
    o = C.table(s, d, "orders")
    prompt = F.struct(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, "lasso").otherwise("point").alias("type"), F.when(F.col("o_orderkey") % 2 == 0, F.array((F.col("o_orderkey") % 50).cast("long"), (F.col("o_orderkey") % 7 + 1).cast("long"))).alias("runs"))
    folder = scratch_path(s, "prompts")
    o.groupBy("o_custkey").agg(F.collect_list(prompt).alias("prompts")).write.json(folder)
    back = s.read.schema("o_custkey long, prompts array<struct<seq: long, type: string, runs: array<long>>>").json(folder).select("o_custkey", F.inline("prompts"))
    return back.where("type = 'lasso'").select("o_custkey", "seq", F.explode(F.sequence(F.get("runs", 0), F.get("runs", 0) + F.get("runs", 1) - 1)).alias("pixel"))


def _catalogue(s, d):
    headers = C.headers(s, d).groupBy("series_uid").agg(F.count("*").alias("images")).select(F.lit("headers").alias("format"), F.col("series_uid").cast("string").alias("series"), "images")
    volumes = C.series(s, d).select(F.lit("volumes").alias("format"), F.concat(F.lit("v"), "series_id").alias("series"), F.lit(C.NZ).cast("long").alias("images"))
    return U.not_empty(headers.unionByName(volumes))


def _members(s, d):
    """The images of each first volume (the one shown) with their series' description."""
    h = C.headers(s, d).distinct()
    shown = S.order_by_position(h).where("rank = 1").select("series_uid", "path", F.col("position").cast("long").alias("position"))
    described = C.table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("series_uid"), F.col("o_orderpriority").alias("description"))
    return U.members(h.select("series_uid", "path", "matrix").distinct(), shown, described.distinct())


def _strokes(s, d):
    """A prompt an order on a raster of 40 x 40: strokes of two points and a radius, and lassos of four corners.

    The orders' file may be one group of rows, so orders are dealt out first. Lassos are counted by their runs.
    """
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    o = C.table(s, d, "orders").select("o_orderkey", "o_custkey").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "o_orderkey", "o_custkey")
    strokes = o.where(n % 2 == 0).select(n.alias("id"), (c % 31 + 2.0).alias("x0"), (n % 29 + 3.0).alias("y0"), (c % 23 + 8.0).alias("x1"), (n % 19 + 12.0).alias("y1"), (n % 3 + 1.5).alias("r"))
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((c % 13 + 0.5, n % 11 + 1.25), (c % 17 + 15.5, n % 7 + 0.25), (c % 11 + 20.5, n % 17 + 18.25), (c % 19 + 2.5, n % 13 + 22.25))])
    lassos = o.where(n % 2 == 1).select(n.alias("id"), corners.alias("corners"))
    drawn = U.rasterised_strokes(strokes, 40, 40).select("id", F.lit(1).alias("pixels"), (F.col("x") + 40 * F.col("y")).alias("places"))
    around = U.lasso_runs(lassos, 40, 40).select("id", F.expr("x1 - x0 + 1").alias("pixels"), F.expr("(x0 + x1) * (x1 - x0 + 1) DIV 2 + 40 * y * (x1 - x0 + 1)").cast("int").alias("places"))
    return drawn.unionByName(around).groupBy("id").agg(F.sum("pixels").alias("pixels"), F.sum("places").alias("places"))


def _auto(s, d):
    """Adopts bands of the value as proposed segments of an engine: the lowest free labels, voxels that were free and those of others that stay, and failed checks.

    All the checks that an automatic engine's segments can fail: no region is sent to it and nothing is there before, so that no region cuts them and no revision is unlike.
    """
    found = C.voxels(s, d).withColumn("found", F.when(F.col("value") > 820, 2).when(F.col("value") > 110, 1)).where("found IS NOT NULL")
    n = found.groupBy("series_id", "found").agg(F.count("*").alias("voxels"), F.count(F.when(F.col("label") > 0, 1)).alias("overlap"))
    free = C.mask(s, d).select("series_id", "label").distinct().groupBy("series_id").agg(F.collect_set("label").alias("used"))  # 255 at most
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("found"))
    label = F.get(F.array_except(F.sequence(F.lit(1), F.lit(255)), "used"), F.col("rank") - 1)
    new = tabled(n.withColumn("rank", rank).join(free, "series_id").select("series_id", "found", label.alias("label"), (F.col("voxels") - F.col("overlap")).alias("voxels"), "overlap"), "adopted")
    taken = tabled(found.where("label = 0").drop("label").join(new.select("series_id", "found", "label"), ["series_id", "found"]).select(*M.KEY, *M.VOX), "taken")
    told = P.topology(taken, (C.NX, C.NY, C.NZ), 2.0).select(*M.KEY, F.col("largest_component_share").alias("share"), F.col("border_sides").alias("sides"))
    centre = M.centroid(taken).select(*M.KEY, F.when(F.round(F.col("ci"), 6) > (C.NX - 1) / 2, "left").otherwise("right").alias("observed"))
    side = F.when(F.col("found") == 1, "left").otherwise("right")  # what the engine's names say
    all_ = new.join(told, M.KEY, "left").join(centre, M.KEY, "left")
    ml = F.col("voxels") * 0.002
    failed = F.when(F.col("voxels") == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(
        F.when(F.col("share") < 0.9, "components"), F.when(F.col("sides") > 0, "border"), F.when((ml < 0.2) | (ml > 5.0), "size"), F.when(F.col("overlap") > 0.01 * F.col("voxels"), "overlap"), F.when(F.col("observed") != side, "laterality"),
    )))
    return _long(all_.select("series_id", "found", F.col("label").alias("new_label"), "voxels", "overlap", F.array_join(failed, ",").alias("failed"), F.lit("proposed").alias("status"), F.lit("engine").alias("author")))


def _flat(s, d):
    """Masks with a hole that only single slices enclose."""
    return C.voxels(s, d).where("label > 0 AND NOT (label = 2 AND i BETWEEN 11 AND 12 AND j BETWEEN 11 AND 12)").select("series_id", "label", "i", "j", "k")


def _rejects(s, d):
    """Versions of sources as they come in two batches, every third unreadable: what is read, and one row for the first of unreadable ones on end, with the last good value."""
    rows = C.table(s, d, "events").select((F.col("event_id") % 40).cast("long").alias("source"), F.col("event_id").cast("long").alias("version"), F.when(F.floor(F.col("event_id") / 40) % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    parsed = U.parsed(rows, "props", "k long").select("source", "version", F.col("k").alias("value"))
    return feeds.replay(feeds.ranges(parsed, "version", 2), feeds.readable_states, "states").withColumn("value", F.coalesce("value", F.lit(-1)))


def _bundle(s, d):
    """The export of each workspace: its items with whether they are confirmed, counts, a disclaimer where some aren't, and the file by name and by the hash of what is in it."""
    a = C.annotations(s, d).select("workspace", F.lit("annotation").alias("kind"), F.col("id").cast("string").alias("item"), (F.col("status") == "confirmed").alias("confirmed"))
    g = C.mask(s, d).select("series_id", "label").distinct().select((F.col("series_id") % 50).alias("workspace"), F.lit("segment").alias("kind"), F.concat_ws("/", "series_id", "label").alias("item"), (F.col("label") == 1).alias("confirmed"))
    items = a.unionByName(g)
    folder = scratch_path(s, "bundle")
    names = written(V.write_documents(items, folder, "workspace", ["kind", "item", "confirmed"]), "names")
    hashed = V.hashes(V.listed(s, folder)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")
    counted = items.groupBy("workspace", "kind").agg(F.count("*").alias("items"), F.count(F.when(~F.col("confirmed"), 1)).alias("unconfirmed"))
    files = names.join(hashed, "file")
    return counted.join(files, "workspace", "left").select("workspace", "kind", "items", "unconfirmed", F.when(F.col("unconfirmed") > 0, F.concat_ws(" ", "unconfirmed", F.lit("of these were not reviewed by a person"))).otherwise("").alias("disclaimer"), "file", "sha256")


def _segment_changes(s, d):
    """Renames, colours, visibility, opacity (kept within 0 to 1) and deletions of segments; only what an agent made and nobody confirmed may be renamed or deleted."""
    g = C.mask(s, d).groupBy("series_id", "label").agg(F.count("*").alias("voxels")).withColumn("author", F.when(F.col("series_id") % 3 == 0, "human").otherwise("agent")).withColumn("status", F.when(F.col("series_id") % 5 == 0, "confirmed").otherwise("proposed"))
    n = F.col("series_id")
    asked = F.when(F.col("label") == 1, F.element_at(F.array(*map(F.lit, ["rename", "colour", "hide", "opacity"])), (n % 4 + 1).cast("int"))).otherwise("delete")
    reason = F.when(asked.isin("rename", "delete"), A.refusal())
    told = g.withColumn("asked", asked).withColumn("reason", reason)
    done = lambda what: (F.col("asked") == what) & F.col("reason").isNull()
    return _long(told.where(~done("delete")).select(
        "series_id", "label", "voxels", F.when(done("rename"), "renamed").otherwise(F.concat_ws(" ", F.lit("Segment"), "label")).alias("name"), F.when(done("colour"), "#00ff00").otherwise("#ff0000").alias("colour"),
        (~done("hide")).alias("visible"), F.when(done("opacity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n * 0.3))).otherwise(0.5).alias("opacity"), "reason"))


def _revisions(s, d):
    """What a reviewer saw of an item, as one hash: of an annotation its fields, value and points to thousandths; of a segment its name, box and content."""
    source = lambda c: F.sha2(F.concat(F.lit("series "), c), 256)
    three = lambda x: F.format_string("%.3f", x)
    a = C.annotations(s, d)
    number = A.value(F.col("kind"), F.col("points"))
    value = F.when(number.isNotNull(), three(number)).otherwise("")
    points = F.array_join(F.transform(A.voxel_points(), lambda p: F.array_join(F.transform(p, three), ",")), ";")
    told = [F.lit("review-revision/1"), source(F.col("workspace")), F.lit(""), F.lit("annotation"), F.col("id"), F.col("kind"), F.col("plane"), F.col("name"), F.col("text"), F.coalesce(A.unit(F.col("kind")), F.lit("")), F.col("slice_index"), value, F.size("points"), points]
    marks = a.select(F.lit("annotation").alias("what"), F.col("id").cast("string").alias("item"), U.revision(told).alias("revision"))
    ends = [F.col(f"{x}{e}") for e in (0, 1) for x in "ijk"]
    g = C.series(s, d).select("series_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("label")).join(N.content_hash(C.mask(s, d)), M.KEY, "left")
    held = F.when(F.col("hash").isNull(), "empty").otherwise(F.concat_ws(",", *ends, "hash"))
    told = [F.lit("review-revision/1"), source(F.col("series_id")), F.lit(""), F.lit("segment"), F.col("label"), F.concat_ws(" ", F.lit("Segment"), "label"), held]
    return marks.unionByName(g.select(F.lit("segment").alias("what"), F.concat_ws("/", "series_id", "label").alias("item"), U.revision(told).alias("revision")))


QUERIES = {
    "src07_frames": lambda s, d: U.positioned_frames(_frames(s, d)),
    "src08_sidecars": _sidecars,
    "src11_prompts": _prompts,
    "src13_catalogue": _catalogue,
    "join15_volume_members": _members,
    "geo07_strokes": _strokes,
    "pip09_adopted_labels": _auto,
    "pip13_segment_changes": _segment_changes,
    "win09_sobel": lambda s, d: _long(_rounded(X.sobel(C.voxels(s, d)), 4)),
    "gra10_fill_by_slices": lambda s, d: _long(U.fill_by_slices(_flat(s, d))),
    "str06_rejects": _rejects,
    "snk05_bundle": _bundle,
    "agg37_revisions": lambda s, d: _revisions(s, d),
}

from lumivox.catalog.workspaces import _O, _UNIT, _VALUE, _VOXEL_POINTS  # noqa: E402

W = f"WITH {C.VOXELS_SQL}"
L = "series_id, CAST(label AS BIGINT) AS label"
IJK = "CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k"


def _pass_sql(n: int, axis: str) -> str:
    """One pass of filling along an axis: what no way within the slice leads out of, from table f<n-1> to f<n>."""
    a, b = [x for x in "ijk" if x != axis]
    return f"""b{n} AS (SELECT series_id, label, {axis} AS s, min({a}) AS a0, max({a}) AS a1, min({b}) AS b0, max({b}) AS b1 FROM f{n-1} GROUP BY ALL),
    c{n} AS (SELECT x.series_id, x.label, x.s, v.{a} AS a, v.{b} AS b, v.{a} IN (a0, a1) OR v.{b} IN (b0, b1) AS edge FROM b{n} x JOIN voxels v ON v.series_id = x.series_id AND v.{axis} = x.s AND v.{a} BETWEEN a0 AND a1 AND v.{b} BETWEEN b0 AND b1 ANTI JOIN f{n-1} m ON m.series_id = x.series_id AND m.label = x.label AND m.{axis} = x.s AND m.{a} = v.{a} AND m.{b} = v.{b}),
    w{n} AS (SELECT series_id, label, s, a, b FROM c{n} WHERE edge UNION SELECT c.series_id, c.label, c.s, c.a, c.b FROM w{n} w JOIN c{n} c ON c.series_id = w.series_id AND c.label = w.label AND c.s = w.s AND abs(c.a-w.a)+abs(c.b-w.b) = 1),
    f{n} AS (SELECT series_id, label, i, j, k FROM f{n-1} UNION ALL SELECT c.series_id, c.label, {', '.join({axis: 'c.s', a: 'c.a', b: 'c.b'}[x] + f' AS {x}' for x in 'ijk')} FROM c{n} c ANTI JOIN w{n} w ON w.series_id = c.series_id AND w.label = c.label AND w.s = c.s AND w.a = c.a AND w.b = c.b)"""


ORACLE_SQL = {
    "src07_frames": "WITH f AS (SELECT l_orderkey AS file, l_linenumber AS number, CASE WHEN l_partkey % 3 > 0 THEN l_linenumber * CAST(2.5 AS DOUBLE) END AS z, max(CASE WHEN l_partkey % 5 = 0 THEN CAST(1.5 AS DOUBLE) END) OVER (PARTITION BY l_orderkey) AS t, bool_and(l_partkey % 3 > 0) OVER (PARTITION BY l_orderkey) AS whole FROM lineitem) SELECT file, CAST(number AS BIGINT) AS number, z, coalesce(t, 1.0) AS thickness FROM f WHERE whole",
    "src08_sidecars": """WITH o AS (SELECT o_custkey AS file, o_orderkey % 3 * 500 AS b, o_orderkey % 50 + 0.5 AS t, row_number() OVER w - 1 AS volume, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey % 7 <> 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT file, volume, CASE WHEN count(*) OVER (PARTITION BY file, b) > 1 THEN 'b' || b || ' ' || row_number() OVER (PARTITION BY file, b ORDER BY volume) || '/' || count(*) OVER (PARTITION BY file, b) ELSE 'b' || b END AS name, CAST(-1 AS DOUBLE) AS start FROM o WHERE file % 2 = 0
        UNION ALL SELECT file, volume, 'frame ' || (volume + 1) || '/' || n, CAST(t AS DOUBLE) FROM o WHERE file % 2 = 1""",
    "src11_prompts": "SELECT o_custkey, o_orderkey AS seq, unnest(range(o_orderkey % 50, o_orderkey % 50 + o_orderkey % 7 + 1)) AS pixel FROM orders WHERE o_orderkey % 2 = 0",
    "src13_catalogue": "SELECT 'headers' AS format, CAST(l_orderkey AS VARCHAR) AS series, count(*) AS images FROM lineitem GROUP BY l_orderkey UNION ALL SELECT 'volumes', 'v' || s_suppkey, CAST(12 AS BIGINT) FROM supplier",
    "join15_volume_members": f"{_O} SELECT o.series_uid, path, matrix, position, o_orderpriority AS description FROM o JOIN (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders) r ON r.o_orderkey = o.series_uid WHERE rank = 1",
    "geo07_strokes": """WITH o AS (SELECT o_orderkey AS id, o_custkey % 31 + 2.0 AS x0, o_orderkey % 29 + 3.0 AS y0, o_custkey % 23 + 8.0 AS x1, o_orderkey % 19 + 12.0 AS y1, o_orderkey % 3 + 1.5 AS r FROM orders WHERE o_orderkey % 2 = 0),
        p AS (SELECT o.*, px.v AS x, py.v AS y, CASE WHEN (x1-x0)**2+(y1-y0)**2 > 0 THEN least(greatest(((px.v-x0)*(x1-x0)+(py.v-y0)*(y1-y0))/((x1-x0)**2+(y1-y0)**2), 0), 1) ELSE 0 END AS t FROM o, range(40) AS px(v), range(40) AS py(v)),
        c AS (SELECT o_orderkey AS id, [o_custkey % 13 + 0.5, o_custkey % 17 + 15.5, o_custkey % 11 + 20.5, o_custkey % 19 + 2.5] AS xs, [o_orderkey % 11 + 1.25, o_orderkey % 7 + 0.25, o_orderkey % 17 + 18.25, o_orderkey % 13 + 22.25] AS ys FROM orders WHERE o_orderkey % 2 = 1),
        e AS (SELECT id, CAST(xs[n + 1] AS DOUBLE) AS ax, CAST(ys[n + 1] AS DOUBLE) AS ay, CAST(xs[(n + 1) % 4 + 1] AS DOUBLE) AS bx, CAST(ys[(n + 1) % 4 + 1] AS DOUBLE) AS bz FROM c, range(4) AS t(n)),
        l AS (SELECT id, px.v AS x, py.v AS y FROM e, range(40) AS px(v), range(40) AS py(v) WHERE (ay > py.v) <> (bz > py.v) AND px.v < (bx - ax) * (py.v - ay) / (bz - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1),
        u AS (SELECT id, x, y FROM p WHERE (x-(x0+t*(x1-x0)))**2 + (y-(y0+t*(y1-y0)))**2 <= r*r UNION ALL SELECT id, x, y FROM l)
        SELECT id, count(*) AS pixels, CAST(sum(x + 40*y) AS BIGINT) AS places FROM u GROUP BY id""",
    "pip09_adopted_labels": f"""WITH RECURSIVE {C.VOXELS_SQL}, b AS (SELECT series_id, CASE WHEN value > 820 THEN 2 ELSE 1 END AS found, label, i, j, k FROM voxels WHERE value > 110), f0 AS (SELECT series_id, found, count(*) AS n, count(*) FILTER (WHERE label > 0) AS overlap FROM b GROUP BY ALL), f AS (SELECT *, 2 + row_number() OVER (PARTITION BY series_id ORDER BY found) AS new_label FROM f0),
        t AS (SELECT series_id, found, i, j, k, i + 16*(j + 16*k) AS vox FROM b WHERE label = 0), lk AS (SELECT x.series_id, x.found, x.vox AS a, y.vox AS b FROM t x JOIN t y ON y.series_id = x.series_id AND y.found = x.found AND abs(x.i-y.i) <= 1 AND abs(x.j-y.j) <= 1 AND abs(x.k-y.k) <= 1),
        rc AS (SELECT * FROM lk UNION SELECT r.series_id, r.found, r.a, l.b FROM rc r JOIN lk l ON l.series_id = r.series_id AND l.found = r.found AND l.a = r.b), pc AS (SELECT series_id, found, a, min(b) AS root FROM rc GROUP BY ALL), ps AS (SELECT series_id, found, max(m) / sum(m) AS share FROM (SELECT series_id, found, root, count(*) AS m FROM pc GROUP BY ALL) GROUP BY ALL),
        s AS (SELECT series_id, found, bool_or(i IN (0, 15) OR j IN (0, 15) OR k IN (0, 11)) AS touches, CASE WHEN round(avg(i), 6) > 7.5 THEN 1 ELSE 2 END AS seen FROM t GROUP BY ALL)
        SELECT f.series_id, CAST(f.found AS BIGINT) AS found, new_label, n - overlap AS voxels, overlap, CASE WHEN n = overlap THEN 'empty' ELSE concat_ws(',', CASE WHEN share < 0.9 THEN 'components' END, CASE WHEN touches THEN 'border' END, CASE WHEN (n - overlap) * 0.002 < 0.2 OR (n - overlap) * 0.002 > 5 THEN 'size' END,
            CASE WHEN overlap > 0.01 * (n - overlap) THEN 'overlap' END, CASE WHEN seen <> f.found THEN 'laterality' END) END AS failed, 'proposed' AS status, 'engine' AS author FROM f LEFT JOIN ps ON ps.series_id = f.series_id AND ps.found = f.found LEFT JOIN s ON s.series_id = f.series_id AND s.found = f.found""",
    "pip13_segment_changes": f"""{W}, g AS (SELECT series_id, label, count(*) AS voxels, CASE WHEN label = 1 THEN ['rename', 'colour', 'hide', 'opacity'][series_id % 4 + 1] ELSE 'delete' END AS asked, CASE WHEN series_id % 3 = 0 THEN 'made by a person' WHEN series_id % 5 = 0 THEN 'confirmed' END AS r FROM mask GROUP BY ALL), t AS (SELECT *, CASE WHEN asked IN ('rename', 'delete') THEN r END AS reason FROM g)
        SELECT {L}, voxels, CASE WHEN asked = 'rename' AND reason IS NULL THEN 'renamed' ELSE 'Segment ' || label END AS name, CASE WHEN asked = 'colour' THEN '#00ff00' ELSE '#ff0000' END AS colour, asked <> 'hide' AS visible, CASE WHEN asked = 'opacity' THEN least(1.0::DOUBLE, series_id * 0.3::DOUBLE) ELSE 0.5::DOUBLE END AS opacity, reason FROM t WHERE NOT (asked = 'delete' AND reason IS NULL)""",
    "win09_sobel": f"""{W}, o AS (SELECT a.series_id, a.i, a.j, a.k, x.o AS x, y.o AS y, z.o AS z, b.value FROM voxels a, range(-1, 2) AS x(o), range(-1, 2) AS y(o), range(-1, 2) AS z(o) JOIN voxels b ON b.series_id = a.series_id AND b.i = least(greatest(a.i + x.o, 0), 15) AND b.j = least(greatest(a.j + y.o, 0), 15) AND b.k = least(greatest(a.k + z.o, 0), 11)),
        g AS (SELECT series_id, i, j, k, sqrt(sum(value * x * (2 - abs(y)) * (2 - abs(z)))**2 + sum(value * y * (2 - abs(x)) * (2 - abs(z)))**2 + sum(value * z * (2 - abs(x)) * (2 - abs(y)))**2) AS g FROM o GROUP BY ALL)
        SELECT series_id, {IJK}, round(g / max(g) OVER (PARTITION BY series_id), 4) AS edge FROM g""",
    "gra10_fill_by_slices": f"WITH RECURSIVE {C.VOXELS_SQL}, f0 AS (SELECT series_id, label, i, j, k FROM mask WHERE NOT (label = 2 AND i BETWEEN 11 AND 12 AND j BETWEEN 11 AND 12)), {_pass_sql(1, 'i')}, {_pass_sql(2, 'j')}, {_pass_sql(3, 'k')} SELECT {L}, {IJK} FROM f3",
    "str06_rejects": """WITH e AS (SELECT CAST(event_id % 40 AS BIGINT) AS source, CAST(event_id AS BIGINT) AS version, CASE WHEN (event_id // 40) % 3 > 0 THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS value FROM events),
        l AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n, last_value(value IGNORE NULLS) OVER (PARTITION BY source ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM e WINDOW w AS (PARTITION BY source ORDER BY version))
        SELECT source, version, coalesce(value, good, -1) AS value, CASE WHEN value IS NULL THEN 'rejected' ELSE 'read' END AS state FROM l WHERE value IS NOT NULL OR n = 1 OR before IS NOT NULL""",
    "snk05_bundle": f"""WITH {C.VOXELS_SQL}, {C.ANNOTATIONS_SQL}, u AS (SELECT workspace, 'annotation' AS kind, CAST(id AS VARCHAR) AS item, status = 'confirmed' AS c FROM annotations UNION ALL SELECT DISTINCT series_id % 50, 'segment', series_id || '/' || label, label = 1 FROM mask),
        f AS (SELECT workspace, 'bundle-' || workspace || '.jsonl' AS file, sha256(string_agg('{{"kind":"' || kind || '","item":"' || item || '","confirmed":' || c || '}}' || chr(10), '' ORDER BY kind, item)) AS sha256 FROM u GROUP BY 1), n AS (SELECT workspace, kind, count(*) AS items, count(*) FILTER (WHERE NOT c) AS unconfirmed FROM u GROUP BY ALL)
        SELECT n.workspace, kind, items, unconfirmed, CASE WHEN unconfirmed > 0 THEN unconfirmed || ' of these were not reviewed by a person' ELSE '' END AS disclaimer, file, sha256 FROM n LEFT JOIN f ON f.workspace = n.workspace""",
    "agg37_revisions": f"""WITH {C.VOXELS_SQL}, {C.ANNOTATIONS_SQL}, {C.HASHED_SQL}, p AS (SELECT *, {_VALUE} AS v, {_UNIT} AS u, {_VOXEL_POINTS} AS p FROM annotations),
        f AS (SELECT 'annotation' AS what, CAST(id AS VARCHAR) AS item, ['review-revision/1', sha256('series ' || workspace), '', 'annotation', CAST(id AS VARCHAR), kind, plane, name, text, coalesce(u, ''), CAST(slice_index AS VARCHAR), coalesce(printf('%.3f', CAST(v AS DOUBLE)), ''), '4',
            array_to_string(list_transform(p, lambda q: printf('%.3f,%.3f,%.3f', q[1], q[2], q[3])), ';')] AS f FROM p
        UNION ALL SELECT 'segment', s.series_id || '/' || l, ['review-revision/1', sha256('series ' || s.series_id), '', 'segment', CAST(l AS VARCHAR), 'Segment ' || l, coalesce(concat_ws(',', i0, j0, k0, i1, j1, k1) || ',' || hash, 'empty')] FROM series s CROSS JOIN (VALUES (1), (2), (3)) AS t(l) LEFT JOIN hashed h ON h.series_id = s.series_id AND h.label = l)
        SELECT what, item, sha256(array_to_string(list_transform(f, lambda x: strlen(x) || ':' || x), '')) AS revision FROM f""",
}
