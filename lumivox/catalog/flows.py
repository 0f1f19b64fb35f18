"""Files, streams and the user-level pipelines: SRC, SNK, STR, PIP, and the operators they share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumivox.catalog.intensity import _rounded
from lumivox.catalog.segments import GRID, S, _laterality, _long, _shifted, _stored
from lumivox.functions import text as T
from lumivox.operators import annotations as A
from lumivox.operators import filters as X
from lumivox.operators import hull as H
from lumivox.operators import intensity as I
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.operators import profiles as P
from lumivox.operators import reviews as R
from lumivox.plans.joins import merge_join
from lumivox.plans.scratch import scratch_path, tabled, written
from lumivox.sources import cohort as C
from lumivox.sources import volumes as V
from lumivox.streaming import feeds

def _id():
    return F.regexp_extract("path", r"(\d+)\.nii(?:\.gz)?$", 1).cast("long").alias("series_id")


def _files(s, d, value: str, packed: bool = False):
    folder = scratch_path(s, "nifti")
    written(V.write_volumes(C.voxels(s, d), folder, value, C.SPACING, packed=packed), "names")
    return V.listed(s, folder), folder


def _headers(s, d):
    h = V.read_headers(_files(s, d, "value")[0])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _rounded(h.select(_id(), "nx", "ny", "nz", "volumes", "sx", "sy", "sz", "datatype", "slope", "intercept", "ox", "oy", "oz", text("direction"), text("target"), text("flip")))


def _bricks(s, d):
    """Ingested volumes as dense bricks of stored numbers; what is in them by count, sum and ends."""
    values = V.read_volume(_files(s, d, "value")[0]).select(_id(), "i", "j", "k", "value")
    bricks = V.to_bricks(values, -1000.0, 1000.0)
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x)
    return _long(bricks.select("series_id", "bi", "bj", "bk", F.size("data").alias("n"), total.alias("total"), F.array_min("data").alias("low"), F.get("data", 0).alias("first")))


def _entries(s, d):
    """The audit entries; a sixth of the edits are deletions."""
    delete = (F.col("event_id") % 6 == 0) & F.col("command").isin("segment edit", "annotate add")
    return C.audit(s, d).withColumn("command", F.when(delete, "item delete").otherwise(F.col("command"))).withColumn("second", F.unix_seconds("time"))


def _feed(s, d):
    return feeds.replay(feeds.ranges(_entries(s, d), "second", 3), feeds.change_feed, "feed")


def _snapshots(s, d, times: int = 4):
    """The items of each workspace at even times: there if the last edit or deletion was an edit, their content by how many edits, their status by the last decision that went through."""
    e = _entries(s, d)
    low, high = e.agg(F.min("second"), F.max("second")).first()
    wide = (high - low) // times + 1
    edit = F.col("command").isin("segment edit", "annotate add")
    told = e.withColumn("snapshot", F.explode(F.sequence(F.floor((F.col("second") - low) / wide), F.lit(times - 1).cast("long"))))
    last = F.max_by(edit, F.when(edit | (F.col("command") == "item delete"), F.struct("time", "event_id")))
    review = F.max_by("command", F.when(F.col("ok") & F.col("command").startswith("review "), F.struct("time", "event_id")))
    states = told.groupBy("workspace", "snapshot", "item").agg(last.alias("there"), F.count(F.when(edit, 1)).alias("edits"), review.alias("review")).where("there")
    content = F.sha2(F.concat_ws("/", "workspace", "item", "edits"), 256)
    status = F.when(F.col("review").isNull(), "proposed").when(F.col("review") == "review confirm", "confirmed").otherwise("rejected")
    items = states.select("workspace", "snapshot", "item", content.alias("content"), status.alias("status"))
    none = F.lit(None).cast("string")
    marks = e.select("workspace").distinct().select("workspace", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias("snapshot"), F.lit(None).cast("long").alias("item"), none.alias("content"), none.alias("status"))
    return items.unionByName(marks)


def _snapshot_feed(s, d):
    told = written(_snapshots(s, d), "snapshots")
    return feeds.replay([told.where(F.col("snapshot") == n) for n in range(4)], feeds.snapshot_feed, "snapshot_feed")


def _decision_stream(s, d):
    """Edits bring an item's revision; every fourth reviewer has seen the one before."""
    e = C.audit(s, d)
    by = Window.partitionBy("workspace", "item").orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    edits = F.count(F.when(F.col("command").isin("segment edit", "annotate add"), 1)).over(by)
    seen = F.when(F.col("command").startswith("review ") & (F.col("event_id") % 4 == 0), F.greatest(F.lit(0), edits - 1)).otherwise(edits)
    entries = e.withColumn("revision", F.sha2(F.concat_ws("/", "workspace", "item", seen), 256)).withColumn("second", F.unix_seconds("time"))
    return feeds.replay(feeds.ranges(entries, "second", 3), feeds.decisions, "decisions")


def _streamed_counts(s, d):
    """Counts of the windows that the watermark has closed. A last batch that is a year on closes all; late entries come with it and are left out."""
    entries = C.audit(s, d).withColumn("second", F.unix_seconds("time"))
    end = s.sql("SELECT 0L AS event_id, TIMESTAMP '2030-01-01' AS time, 0L AS workspace, 0L AS item, 'end' AS command, true AS ok, 0L AS second")
    late = entries.limit(50).withColumn("command", F.lit("late"))
    return feeds.replay([entries, end, late], feeds.command_counts, "counts")


def _deferred(s, d):
    """A workspace an order's customer, a poll an order: metadata follow their label map at the same poll, at the next, or never."""
    o = C.table(s, d, "orders")
    n = F.col("o_orderkey")
    polls = o.select((F.col("o_custkey") % 100).alias("workspace"), n.alias("poll"), F.floor((n + 1) / 3).cast("long").alias("labels"), F.floor(n / 9).cast("long").alias("metadata"))
    return feeds.replay(feeds.ranges(polls, "poll", 2), feeds.deferred_changes, "deferred")


def _arrivals(s, d):
    """A slice a line item. Every eleventh part comes a month after the others, when the series that have others are closed."""
    lines = C.table(s, d, "lineitem").selectExpr("CAST(l_orderkey AS BIGINT) AS series_uid", "CAST(l_linenumber AS BIGINT) AS position", "l_partkey % 11 = 0 AS later", "CAST(l_linenumber AS INT) AS second")
    at = lambda later, day: lines.where(F.col("later") == later).select("series_uid", "position", (F.lit(day).cast("timestamp") + F.make_dt_interval(secs=F.col("second"))).alias("arrived"))
    end = lambda day: s.sql(f"SELECT -1L AS series_uid, 0L AS position, TIMESTAMP '{day}' AS arrived")
    batches = [at(False, "2024-01-01"), end("2024-02-01"), at(True, "2024-02-01 00:30:00"), end("2024-03-15")]
    return feeds.completeness(feeds.replay(batches, feeds.arrivals, "arrivals").where("series_uid >= 0"))


def _audit_log(s, d):
    """Appends the entries as JSON lines by date, those without a time at the given one, and reads them back with a fixed schema."""
    folder = scratch_path(s, "audit")
    entries = C.audit(s, d).withColumn("time", F.when(F.col("event_id") % 10 > 0, F.col("time")))
    R.append_audit(entries, folder, F.lit("2025-06-01 12:00:00").cast("timestamp"))
    back = s.read.schema("event_id long, time timestamp, workspace long, item long, command string, ok boolean").json(folder)
    return back.select("event_id", F.date_trunc("second", "time").alias("time"), "workspace", "item", "command", "ok")


def _annotation_documents(s, d):
    """A document a workspace, written as JSON and read back: those of the first format count as confirmed; wrong kinds are left out, and documents of another grid refused."""
    a = C.annotations(s, d)
    item = F.struct("id", "kind", "points", F.when(F.col("workspace") % 3 > 0, F.col("status")).alias("status"))
    folder = scratch_path(s, "documents")
    size = F.when(F.col("workspace") % 7 == 0, F.array(F.lit(16), F.lit(16), F.lit(11))).otherwise(F.array(*map(F.lit, GRID)))
    a.groupBy("workspace").agg(F.collect_list(item).alias("annotations")).select("workspace", F.when(F.col("workspace") % 3 > 0, 2).otherwise(1).alias("version"), size.alias("dims"), "annotations").write.json(folder)
    shape = "workspace long, version int, dims array<int>, annotations array<struct<id: long, kind: string, points: array<struct<x: double, y: double>>, status: string>>"
    documents = s.read.schema(shape).json(folder)
    same = F.col("dims") == F.array(*map(F.lit, GRID))
    items = documents.where(same).select("workspace", "version", F.inline("annotations")).where(F.col("kind") != "Text")
    read = items.select("workspace", "id", "kind", F.when(F.col("version") == 1, "confirmed").otherwise(F.col("status")).alias("status"), F.size("points").cast("long").alias("points"))
    refused = documents.where(~same).select("workspace", F.lit(-1).cast("long").alias("id"), F.lit("document").alias("kind"), F.lit("refused: another grid").alias("status"), F.size("annotations").cast("long").alias("points"))
    return read.unionByName(refused)


def _segments(s, d):
    return C.series(s, d).select("series_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("label")).withColumn("name", F.concat_ws(" ", F.lit("lesion"), "label")).withColumn("status", F.when(F.col("series_id") % 2 == 0, "confirmed").otherwise("proposed"))


def _segment_list(s, d):
    sizes = M.size(C.mask(s, d), 2.0)
    both = sizes.join(_segments(s, d), M.KEY, "full_outer")
    return _rounded(both.select(*M.KEY, F.coalesce("name", F.concat_ws(" ", F.lit("Segment"), "label")).alias("name"), F.coalesce("status", F.lit("proposed")).alias("status"), F.coalesce("voxels", F.lit(0)).alias("voxels"), F.coalesce("ml", F.lit(0.0)).alias("ml")))


def _shape_card(s, d):
    """Each segment's extent, slices, axes, border, pieces and side, and the same axes of its part at or above a value."""
    m = tabled(C.mask(s, d), "mask")
    found = P.topology(m, GRID, 2.0).select(*M.KEY, F.col("components").alias("pieces"), F.col("border_sides").alias("sides"), (F.col("border_sides") > 0).alias("touches"))
    ranges = M.bounds(m).select(*M.KEY, *[e for a, sp in zip(M.VOX, S) for e in (((F.col(f"{a}1") - F.col(f"{a}0")) * sp).alias(f"{a}_mm"), (F.col(f"{a}0") + 1).alias(f"{a}_from"), F.col(f"{a}1").alias(f"{a}_to"))])
    axes = H.axial_axes(m, S).select(*M.KEY, "long_mm", "short_mm", (F.col("k") + 1).alias("largest_axial"))
    solid = m.where("value >= 110")
    part = merge_join(M.size(solid, 2.0).select(*M.KEY, F.col("voxels").alias("solid_voxels")), H.axial_axes(solid, S).select(*M.KEY, F.col("long_mm").alias("solid_long_mm"), F.col("short_mm").alias("solid_short_mm")), on=M.KEY)
    side = _laterality(s, d).select(*M.KEY, "observed", "consistent")
    card = merge_join(merge_join(M.size(m, 2.0), ranges, found, axes, on=M.KEY), part, side, on=M.KEY, how="left")
    return _long(_rounded(card.withColumn("solid_voxels", F.coalesce("solid_voxels", F.lit(0))), 4))


def _metrics(s, d, profile="quick"):
    return _rounded(P.metrics(C.mask(s, d), C.series(s, d), GRID, S, profile), 3)


def _compare(s, d):
    """Two readings of the same segments, where both list the same files: volumes, overlap, distances of surfaces and centroids; null distances where one is empty."""
    same = tabled(_same_files(_scans(s, d)).where("same").select(F.col("series").alias("series_id")), "same")
    a, b = C.mask(s, d).select(*M.KEY, *M.VOX), _shifted(s, d).where("NOT (label = 1 AND series_id % 4 = 0)").select(*M.KEY, *M.VOX)
    a, b = tabled(a.join(same, "series_id", "left_semi"), "a"), tabled(b.join(same, "series_id", "left_semi"), "b")
    sa, sb = tabled(M.surface(a), "surface"), tabled(M.surface(b), "surface")
    far = M.hausdorff(M.distances(sa, sb, S, M.KEY), M.distances(sb, sa, S, M.KEY))
    apart = M.centroid(a).join(M.centroid(b).select(*M.KEY, *[F.col(f"c{x}").alias(f"d{x}") for x in M.VOX]), M.KEY)
    centre = F.sqrt(sum((F.pow((F.col(f"c{x}") - F.col(f"d{x}")) * m, F.lit(2)) for x, m in zip(M.VOX, S)), F.lit(0.0)))
    n = M.agreement(a, b).select(*M.KEY, (F.col("n_a") * 0.002).alias("ml_a"), (F.col("n_b") * 0.002).alias("ml_b"), ((F.col("n_b") - F.col("n_a")) * 0.002).alias("difference_ml"), (F.col("overlap") * 0.002).alias("overlap_ml"), "dice", "jaccard")
    return _long(_rounded(n.join(far, M.KEY, "left").join(apart.select(*M.KEY, centre.alias("centroid_mm")), M.KEY, "left"), 4))


def _edit(s, d):
    """Four clean-ups by series, of segments that an agent made and nobody confirmed: voxels before and after, and why others are refused."""
    m = tabled(C.mask(s, d).select(*M.KEY, *M.VOX), "mask")
    op = F.element_at(F.array(*map(F.lit, ["keep_largest", "fill_holes", "restrict_to_box", "remove_small"])), (F.col("series_id") % 4 + 1).cast("int"))
    asked = M.size(m, 2.0).select(*M.KEY, F.col("voxels").alias("before")).withColumn("op", op).withColumn("author", F.when(F.col("series_id") % 5 == 0, "human").otherwise("agent")).withColumn("status", F.when((F.col("series_id") + F.col("label")) % 7 == 0, "confirmed").otherwise("proposed"))
    asked = tabled(asked.withColumn("reason", A.refusal()), "asked")
    of = lambda name: merge_join(m, asked.where((F.col("op") == name) & F.col("reason").isNull()), on=M.KEY, how="left_semi")
    taken = m.select("series_id", *M.VOX)  # holes are filled where no segment is
    filled = of("fill_holes")
    holes = N.enclosed(filled).select(*M.KEY, *M.VOX).join(taken, ["series_id", *M.VOX], "left_anti")
    edited = N.keep_pieces(of("keep_largest"), largest=True).unionByName(filled.unionByName(holes)).unionByName(M.within_box(of("restrict_to_box"), (4, 4, 3), (12, 12, 7))).unionByName(N.keep_pieces(of("remove_small"), least=3))
    after = M.size(edited, 2.0).select(*M.KEY, F.col("voxels").alias("after"))
    return _long(merge_join(asked, after, on=M.KEY, how="left").select(*M.KEY, "op", "before", F.when(F.col("reason").isNull(), F.coalesce("after", F.lit(0))).otherwise(F.col("before")).alias("after"), "reason"))


def _checks(s, d):
    """The failed quality checks of every segment that was asked for, also of those without a voxel."""
    m = tabled(C.mask(s, d), "mask")
    asked = C.series(s, d).select("series_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("label"))
    found = P.topology(m, GRID, 2.0).select(*M.KEY, F.col("largest_component_share").alias("share"), (F.col("border_sides") > 0).alias("touches"))
    cut = F.lit(False)  # the region that was sent is voxels 2 to 13 of the first two axes
    for a, n in zip("ij", GRID):
        cut = cut | (F.col(f"{a}0") <= 2) | (F.col(f"{a}1") >= n - 2)
    roi = M.bounds(m).select(*M.KEY, cut.alias("cut"))
    owned = C.voxels(s, d).where("value > 700 AND label > 0").groupBy("series_id").agg(F.count("*").alias("owned"))
    side = _laterality(s, d).select(*M.KEY, "consistent")
    before = m.where("k < 7").groupBy(*M.KEY).agg(F.count("*").alias("kept"))  # the revision before has no slices above
    all_ = merge_join(merge_join(asked, M.size(m, 2.0), found, roi, side, before, on=M.KEY, how="left"), owned, on="series_id", how="left")
    dice = 2 * F.coalesce("kept", F.lit(0)) / (F.col("voxels") + F.coalesce("kept", F.lit(0)))
    failed = F.when(F.col("voxels").isNull(), F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(
        F.when(F.col("share") < 0.9, "components"), F.when(F.col("cut"), "roi"), F.when(F.col("touches"), "border"), F.when((F.col("ml") < 0.2) | (F.col("ml") > 5.0), "size"),
        F.when((F.col("label") == 1) & (F.coalesce("owned", F.lit(0)) > 0.01 * F.col("voxels")), "overlap"), F.when(~F.col("consistent"), "laterality"), F.when(dice < 0.95, "stability"),
    )))
    return _long(all_.select(*M.KEY, F.array_join(failed, ",").alias("failed")))


def _stability(s, d):
    """Dice of each revision of a segment with the one before; revisions are bands that widen."""
    rev = M.within_box(C.voxels(s, d), (0, 0, 2), (15, 15, 8)).where("label > 0").select(*M.KEY, *M.VOX, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("revision")).where(F.col("k") <= 4 + F.col("revision"))
    size = rev.groupBy(*M.KEY, "revision").agg(F.count("*").alias("n"))
    back = rev.withColumn("revision", F.col("revision") + 1)
    both = rev.join(back, [*M.KEY, *M.VOX, "revision"]).groupBy(*M.KEY, "revision").agg(F.count("*").alias("both"))
    old = size.select(*M.KEY, (F.col("revision") + 1).alias("revision"), F.col("n").alias("m"))
    dice = 2 * F.col("both") / (F.col("n") + F.col("m"))
    return _long(_rounded(size.join(old, [*M.KEY, "revision"]).join(both, [*M.KEY, "revision"], "left").select(*M.KEY, "revision", dice.alias("dice"), (dice >= 0.95).alias("stable"))))


def _same_files(files):
    """Whether two workspaces of a series list the same files with the same hashes, from ``series, workspace, path, sha256``."""
    of = [F.sum((F.col("workspace") == w).cast("long")).alias(f"n{w}") for w in (0, 1)]
    listed = files.groupBy("series", "path", "sha256").agg(*of)  # no list is gathered
    both = listed.groupBy("series").agg(F.bool_and(F.col("n0") == F.col("n1")).alias("same"), F.sum("n0").alias("files"), F.sum("n1").alias("others"))
    return both.where("files > 0 AND others > 0").select("series", "same", "files")


def _catalogues(s, d):
    return _same_files(C.table(s, d, "lineitem").selectExpr("CAST(l_orderkey AS BIGINT) AS series", "l_linenumber % 2 AS workspace", "CAST(l_partkey AS STRING) AS path", "sha2(CAST(l_suppkey AS STRING), 256) AS sha256").distinct())


def _scans(s, d):
    """The files of each series in two workspaces; in every third series one has other content."""
    files = C.table(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("series"), F.col("l_partkey").cast("string").alias("path")).distinct()
    other = F.when((F.col("series") % 3 == 0) & (F.col("workspace") == 1), "x").otherwise("")
    return files.withColumn("workspace", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("sha256", F.sha2(F.concat("path", other), 256))


def _integrity(s, d):
    recorded = C.table(s, d, "part").selectExpr("p_partkey", "sha2(p_name, 256) AS sha256")
    now = C.table(s, d, "part").where("p_partkey % 10 <> 0").selectExpr("p_partkey", "sha2(IF(p_partkey % 7 = 0, p_brand, p_name), 256) AS now")
    return recorded.join(now, "p_partkey", "left").select("p_partkey", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").otherwise("ok").alias("status"))


def _slice_match(s, d):
    """The source image nearest to each exported slice along the normal, of those whose own normal is parallel, within half a slice spacing."""
    h = C.headers(s, d).where("z IS NOT NULL").select("series_uid", "path", "z", F.when(F.col("path") % 13 == 0, -0.9995).when(F.col("path") % 11 == 0, 0.95).otherwise(F.cos("tilt")).alias("along")).distinct()
    spacing = 1.5 + F.col("series_uid") % 3
    out = h.groupBy("series_uid").agg(F.min("z").alias("a"), F.max("z").alias("b")).withColumn("spacing", spacing)
    out = out.select("series_uid", "spacing", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / F.col("spacing")))).alias("slice"))
    near = out.join(h.where(F.abs("along") > 0.999), "series_uid").withColumn("off", F.round(F.abs(F.col("z") - (F.col("a") + F.col("slice") * F.col("spacing"))), 6)).where(F.col("off") <= F.col("spacing") / 2)
    return near.groupBy("series_uid", "slice").agg(F.min(F.struct("off", "path")).alias("m")).select("series_uid", "slice", F.col("m.path").alias("path"), F.col("m.off").alias("off"))


def _peaks(s, d):
    """Peaks of the smoothed histogram of stored values, a series at a time."""
    h = X.smoothed_histogram(I.storage_histogram(_stored(s, d), ["series_id"]), 1.5, ["series_id"], 64)
    return X.peaks(h, ["series_id"]).select("series_id", "bin", F.round("height", 4).alias("height"), F.col("rank").cast("long").alias("rank"))


def _seed_slices(s, d):
    """The voxels of each segment's largest slice along each axis."""
    top = M.largest_slice(C.mask(s, d)).select(*M.KEY, "axis", (F.col("slice") - 1).alias("at"))
    own = F.when(F.col("axis") == "axial", F.col("k")).when(F.col("axis") == "coronal", F.col("j")).otherwise(F.col("i"))
    return _long(C.mask(s, d).join(top, M.KEY).where(own == F.col("at")).select(*M.KEY, "axis", *M.VOX))


def _reorient(s, d):
    """Masks of grids that are stored in every order and direction, a little oblique, on the canonical grid. The orientation has one row a series."""
    n = F.col("series_id")
    order = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in _ORDERS]), (n % 6 + 1).cast("int"))
    turned = [F.lit(1.0) - 2 * (F.floor(n / 6 / (1 << a)) % 2) for a in range(3)]
    axes = F.array(*[F.when(F.get(order, a) == r, turned[a] * 0.95).otherwise(0.05 * (a + 1)) for r in range(3) for a in range(3)])  # by rows

    @F.pandas_udf("target array<int>, flip array<boolean>")
    def orient(axes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([V.assigned(np.array(x).reshape(3, 3)) for x in axes], columns=["target", "flip"])

    found = C.series(s, d).select("series_id", orient(axes).alias("o")).select("series_id", "o.target", "o.flip")
    return _long(M.reoriented(C.mask(s, d).drop("value"), found, GRID))


_ORDERS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


def _planes(s, d):
    m = C.mask(s, d)
    planes = F.array(F.struct(F.lit("axial").alias("plane"), F.col("i").alias("px"), F.col("j").alias("py"), F.col("k").alias("slice")), F.struct(F.lit("coronal").alias("plane"), F.col("i").alias("px"), (C.NZ - 1 - F.col("k")).alias("py"), F.col("j").alias("slice")), F.struct(F.lit("sagittal").alias("plane"), F.col("j").alias("px"), (C.NZ - 1 - F.col("k")).alias("py"), F.col("i").alias("slice")))
    return _long(m.select(*M.KEY, F.inline(planes)))


def _json_numbers(s, d):
    """The numbers of nested JSON around the events' own; digits in keys and strings are none."""
    nested = F.concat(F.lit('{"k9": ["v12", {"at": [-3.5, '), F.col("event_id").cast("string"), F.lit(']}], "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    return C.table(s, d, "events").select("event_id", F.explode(T.json_numbers(nested)).alias("number"))


def _uids(s, d):
    """UIDs below 2.25 from 16 bytes of a digest: a number of up to 39 digits, past what a decimal holds."""

    @F.pandas_udf("string")
    def uid(digest):
        return digest.map(lambda h: f"2.25.{int(h[:32], 16)}")

    return C.table(s, d, "customer").select("c_custkey", uid(F.sha2(F.concat(F.encode("c_name", "UTF-8"), F.lit(b"\x00")), 256)).alias("uid"))


QUERIES = {
    "src01_src02_inventory": lambda s, d: V.inventory(s, _files(s, d, "value")[1]).select(_id(), "length", "format"),
    "src03_headers": lambda s, d: _headers(s, d),
    "src04_volume_ingest": lambda s, d: _long(V.read_volume(_files(s, d, "value", packed=True)[0]).select(_id(), "i", "j", "k", "value")),
    "src04_bricks": _bricks,
    "src05_label_ingest": lambda s, d: _long(V.read_labels(_files(s, d, "label")[0], GRID).select(_id(), "label", "i", "j", "k")),
    "src12_snk01_audit_log": _audit_log,
    "src09_annotation_documents": _annotation_documents,
    "src10_snk03_pip03_segment_list": _segment_list,
    "snk04_file_hashes": lambda s, d: V.hashes(_files(s, d, "value")[0]).select(_id(), "sha256"),
    "str01_change_feed": _feed,
    "str01_snapshot_feed": _snapshot_feed,
    "str02_deferred_changes": _deferred,
    "str03_decision_stream": _decision_stream,
    "str04_streamed_counts": _streamed_counts,
    "str05_arrivals": _arrivals,
    "pip04_shape_card": _shape_card,
    "pip05_metrics": _metrics,
    "pip05_warnings": lambda s, d: _long(P.warnings(P.topology(C.mask(s, d), GRID, 2.0))),
    "pip05_curves": lambda s, d: _long(_rounded(P.curves(C.mask(s, d), C.series(s, d))[0])),
    "pip05_ranges": lambda s, d: _long(_rounded(P.curves(C.mask(s, d), C.series(s, d))[1])),
    "pip05_clinical": lambda s, d: _metrics(s, d, "clinical"),
    "pip06_compare": _compare,
    "pip07_edit": _edit,
    "pip08_checks": _checks,
    "win15_stability": _stability,
    "win08_gaussian": lambda s, d: _long(_rounded(X.gaussian_smooth(C.voxels(s, d), 1.0), 5)),
    "win11_peaks": _peaks,
    "join12_same_catalogues": _catalogues,
    "join13_source_integrity": _integrity,
    "join14_slice_match": _slice_match,
    "top09_seed_slices": _seed_slices,
    "prj11_plane_mapping": _planes,
    "prj12_reorientation": _reorient,
    "prj14_uids": _uids,
    "prj21_json_numbers": _json_numbers,
    "agg36_mask_hash": lambda s, d: N.content_hash(C.mask(s, d)).select("series_id", F.col("label").cast("long").alias("label"), "hash"),
}

from lumivox.catalog import lattice as _lattice  # noqa: E402
from lumivox.catalog.intensity import _STORED  # noqa: E402
from lumivox.catalog.segments import _SURFACE  # noqa: E402
from lumivox.catalog.workspaces import _A, _H  # noqa: E402

W = f"WITH {C.VOXELS_SQL}"
_R = f"WITH RECURSIVE {C.VOXELS_SQL}, {_lattice._PIECES}"
L = "series_id, CAST(label AS BIGINT) AS label"
IJK = "CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k"
_HOLES = _lattice._HOLES
_SAME_SQL = "SELECT DISTINCT l_suppkey AS series FROM lineitem WHERE l_suppkey % 3 <> 0"


def _axes_sql(name: str, source: str) -> str:
    """``k, long_mm, short_mm`` of each segment of a mask: all pairs of pixels of the largest slice, then bands along the first farthest one."""
    n = f"{name}_"
    return f"""{n}c AS (SELECT series_id, label, k, count(*) AS n FROM {source} GROUP BY series_id, label, k QUALIFY row_number() OVER (PARTITION BY series_id, label ORDER BY n DESC, k) = 1), {n}m AS (SELECT x.* FROM {source} x JOIN {n}c c ON x.series_id = c.series_id AND x.label = c.label AND x.k = c.k),
    {n}p AS (SELECT a.series_id, a.label, a.k, a.i AS i0, a.j AS j0, b.i - a.i AS dx, b.j - a.j AS dy, sqrt((a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)) AS long_mm FROM {n}m a JOIN {n}m b ON a.series_id = b.series_id AND a.label = b.label QUALIFY row_number() OVER (PARTITION BY a.series_id, a.label ORDER BY long_mm DESC, a.j, a.i, b.j, b.i) = 1),
    {n}w AS (SELECT p.series_id, p.label, p.k, long_mm, max(((m.j-j0)*dx - (m.i-i0)*dy) / CASE WHEN long_mm > 0 THEN long_mm ELSE 1 END) - min(((m.j-j0)*dx - (m.i-i0)*dy) / CASE WHEN long_mm > 0 THEN long_mm ELSE 1 END) AS wide FROM {n}p p JOIN {n}m m ON m.series_id = p.series_id AND m.label = p.label GROUP BY p.series_id, p.label, p.k, long_mm, round(((m.i-i0)*dx + (m.j-j0)*dy) / CASE WHEN long_mm > 0 THEN long_mm ELSE 1 END)),
    {name} AS (SELECT series_id, label, k, long_mm, max(wide) AS short_mm FROM {n}w GROUP BY ALL)"""


_HEADER_HEX = "CASE series_id % 4 " + " ".join(f"WHEN {n} THEN '{V.header_bytes(list(GRID), S, layout).hex()}'" for n, layout in enumerate(V.LAYOUTS)) + " END"
_BORDER = "bool_or(i=0 OR i=15 OR j=0 OR j=15 OR k=0 OR k=11)"
_PCT = lambda q: f"max(CASE WHEN place = round((total - 1) * {q}) THEN value END)"

ORACLE_SQL = {
    "src01_src02_inventory": f"{W} SELECT series_id, CAST(352 + 2 * count(*) AS BIGINT) AS length, 'nifti' AS format FROM voxels GROUP BY 1",
    "src03_headers": f"""WITH {C.SERIES_SQL} SELECT series_id, CAST(CASE series_id % 4 WHEN 1 THEN 12 ELSE 16 END AS BIGINT) AS nx, CAST(16 AS BIGINT) AS ny, CAST(CASE series_id % 4 WHEN 1 THEN 16 ELSE 12 END AS BIGINT) AS nz, CAST(1 AS BIGINT) AS volumes,
        CASE series_id % 4 WHEN 1 THEN sz ELSE sx END AS sx, sy, CASE series_id % 4 WHEN 1 THEN sx ELSE sz END AS sz, CAST(4 AS BIGINT) AS datatype, CAST(1 AS DOUBLE) AS slope, CAST(0 AS DOUBLE) AS intercept, CAST(0 AS DOUBLE) AS ox, CAST(0 AS DOUBLE) AS oy, CAST(0 AS DOUBLE) AS oz,
        '1.0,0.0,0.0,0.0,1.0,0.0,0.0,0.0,1.0' AS direction, CASE series_id % 4 WHEN 1 THEN '2,1,0' ELSE '0,1,2' END AS target, CASE series_id % 4 WHEN 1 THEN 'false,true,false' WHEN 2 THEN 'true,true,false' ELSE 'false,false,false' END AS flip FROM series""",
    "src04_volume_ingest": f"{W} SELECT series_id, {IJK}, value FROM voxels",
    "src04_bricks": f"{W}, s AS (SELECT *, CAST(least(greatest(round((value + 1000) / (2000.0 / 65535)), 0), 65535) AS BIGINT) AS v FROM voxels) SELECT series_id, CAST(i // 8 AS BIGINT) AS bi, CAST(j // 8 AS BIGINT) AS bj, CAST(k // 8 AS BIGINT) AS bk, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, arg_min(v, i + 16*(j + 16*k)) AS first FROM s GROUP BY ALL",
    "src05_label_ingest": f"{W} SELECT {L}, {IJK} FROM mask",
    "src12_snk01_audit_log": f"{_A} SELECT event_id, CASE WHEN event_id % 10 > 0 THEN date_trunc('second', time) ELSE TIMESTAMP '2025-06-01 12:00:00' END AS time, workspace, item, command, ok FROM audit",
    "src09_annotation_documents": f"WITH {C.ANNOTATIONS_SQL} SELECT workspace, id, kind, CASE WHEN workspace % 3 > 0 THEN status ELSE 'confirmed' END AS status, CAST(4 AS BIGINT) AS points FROM annotations WHERE kind <> 'Text' AND workspace % 7 > 0 UNION ALL SELECT workspace, -1, 'document', 'refused: another grid', count(*) FROM annotations WHERE workspace % 7 = 0 GROUP BY 1",
    "src10_snk03_pip03_segment_list": f"{W}, n AS (SELECT series_id, label, count(*) AS voxels FROM mask GROUP BY ALL), g AS (SELECT series_id, l AS label FROM series, (VALUES (1), (3)) AS t(l)) SELECT coalesce(n.series_id, g.series_id) AS series_id, CAST(coalesce(n.label, g.label) AS BIGINT) AS label, CASE WHEN g.label IS NULL THEN 'Segment ' ELSE 'lesion ' END || coalesce(n.label, g.label) AS name, CASE WHEN g.label IS NOT NULL AND g.series_id % 2 = 0 THEN 'confirmed' ELSE 'proposed' END AS status, coalesce(voxels, 0) AS voxels, round(coalesce(voxels, 0) * 2.0 / 1000, 6) AS ml FROM n FULL JOIN g ON n.series_id = g.series_id AND n.label = g.label",
    "snk04_file_hashes": f"""{W}, o AS (SELECT series_id, CASE series_id % 4 WHEN 1 THEN k + 12*(15 - j + 16*i) WHEN 2 THEN (15 - i) + 16*((15 - j) + 16*k) ELSE i + 16*(j + 16*k) END AS pos, CAST(value AS INTEGER) & 65535 AS v FROM voxels)
        SELECT series_id, sha256(unhex({_HEADER_HEX} || string_agg(CASE WHEN series_id % 4 = 2 THEN printf('%04x', v) ELSE printf('%02x%02x', v & 255, v >> 8) END, '' ORDER BY pos))) AS sha256 FROM o GROUP BY series_id""",
    "str01_change_feed": f"""{_A}, e AS (SELECT event_id, time, workspace, item, ok, CASE WHEN event_id % 6 = 0 AND command IN ('segment edit', 'annotate add') THEN 'delete' WHEN command IN ('segment edit', 'annotate add') THEN 'edit' ELSE command END AS c FROM audit),
        l AS (SELECT *, coalesce(sum(CAST(c = 'delete' AS INT)) OVER w, 0) AS life, c = 'edit' AS edit, ok AND starts_with(c, 'review ') AS review FROM e WINDOW w AS (PARTITION BY workspace, item ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        n AS (SELECT *, coalesce(sum(CAST(edit AS INT)) OVER w, 0) AS edits, last_value(CASE WHEN review THEN c END IGNORE NULLS) OVER w AS before FROM l WINDOW w AS (PARTITION BY workspace, item, life ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        x AS (SELECT *, last_value(CASE WHEN review THEN c WHEN c = 'delete' AND edits > 0 THEN '' END IGNORE NULLS) OVER (PARTITION BY workspace, item ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM n)
        SELECT event_id, workspace, item, CASE WHEN edit THEN CASE WHEN edits = 0 THEN 'added' ELSE 'revised' END WHEN c = 'delete' THEN 'removed' ELSE 'reviewed' END AS change FROM x WHERE edit OR (c = 'delete' AND edits > 0) OR (review AND coalesce(held, '') <> c)""",
    "str01_snapshot_feed": f"""{_A}, e AS (SELECT *, epoch(time)::BIGINT AS second, command IN ('segment edit', 'annotate add') AND event_id % 6 > 0 AS edit, command IN ('segment edit', 'annotate add') AND event_id % 6 = 0 AS gone FROM audit),
        r AS (SELECT min(second) AS low, (max(second) - min(second)) // 4 + 1 AS wide FROM e), n AS (SELECT workspace, item, s.n AS snapshot, arg_max(edit, [epoch_us(time), event_id]) FILTER (WHERE edit OR gone) AS there, count(*) FILTER (WHERE edit) AS edits,
            coalesce(arg_max(CASE command WHEN 'review confirm' THEN 'confirmed' ELSE 'rejected' END, [epoch_us(time), event_id]) FILTER (WHERE ok AND starts_with(command, 'review ')), 'proposed') AS status FROM e, r, range(4) AS s(n) WHERE (second - low) // wide <= s.n GROUP BY ALL),
        h AS (SELECT * FROM n WHERE there), u AS (SELECT coalesce(a.workspace, b.workspace) AS workspace, coalesce(b.snapshot, a.snapshot + 1) AS snapshot, coalesce(a.item, b.item) AS item, a.edits AS ea, b.edits AS eb, a.status AS sa, b.status AS sb
            FROM h a FULL JOIN h b ON a.workspace = b.workspace AND a.item = b.item AND b.snapshot = a.snapshot + 1)
        SELECT workspace, snapshot, item, 'added' AS change, sb AS status FROM u WHERE ea IS NULL AND snapshot > 0 UNION ALL SELECT workspace, snapshot, item, 'removed', sa FROM u WHERE eb IS NULL AND snapshot < 4
        UNION ALL SELECT workspace, snapshot, item, 'revised', sb FROM u WHERE ea <> eb UNION ALL SELECT workspace, snapshot, item, 'reviewed', sb FROM u WHERE sa <> sb""",
    "str03_decision_stream": f"""{_A}, n AS (SELECT *, count(*) FILTER (WHERE command IN ('segment edit', 'annotate add')) OVER (PARTITION BY workspace, item ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM audit),
        d AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN greatest(0, now - 1) ELSE now END AS seen FROM n WHERE starts_with(command, 'review ')), v AS (SELECT *, coalesce(max(CAST(ok AND seen = now AND now > 0 AS INT)) OVER (PARTITION BY workspace, item ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS decided FROM d)
        SELECT event_id, workspace, item, CASE WHEN now = 0 THEN 'unknown' WHEN seen <> now THEN 'stale' WHEN decided THEN 'decided' WHEN ok THEN 'accepted' ELSE 'failed' END AS verdict, sha256(workspace || '/' || item || '/' || seen) AS seen_revision,
        CASE WHEN now > 0 THEN sha256(workspace || '/' || item || '/' || now) END AS now_revision FROM v""",
    "str04_streamed_counts": f"{_A} SELECT time_bucket(INTERVAL 1 DAY, time) AS start, command, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failed FROM audit GROUP BY ALL",
    "str05_arrivals": """WITH l AS (SELECT CAST(l_orderkey AS BIGINT) AS series_uid, l_linenumber AS position, l_partkey % 11 = 0 AS later FROM lineitem), o AS (SELECT *, bool_and(later) OVER (PARTITION BY series_uid) AS alone FROM l),
        p AS (SELECT series_uid, position, count(*) AS n FROM o WHERE alone OR NOT later GROUP BY ALL)
        SELECT series_uid, CAST(sum(n) AS BIGINT) AS images, count(*) AS positions, max(n) AS most, max(n) = min(n) AS complete, (SELECT count(*) FROM o WHERE o.series_uid = p.series_uid AND later AND NOT alone) AS late FROM p GROUP BY series_uid""",
    "pip04_shape_card": f"""{_R}, p AS (SELECT series_id, label, count(*) AS pieces FROM comp GROUP BY ALL), {_axes_sql('x', 'mask')}, sm AS (SELECT * FROM mask WHERE value >= 110), {_axes_sql('y', 'sm')}, sn AS (SELECT series_id, label, count(*) AS n FROM sm GROUP BY ALL),
        m AS (SELECT series_id, label, count(*) AS voxels, round(CAST(count(*) * 2.0 / 1000 AS DOUBLE), 4) AS ml, {', '.join(f'CAST({w} * (max({a})-min({a})+1) AS DOUBLE) AS {a}_mm, CAST(min({a})+1 AS BIGINT) AS {a}_from, CAST(max({a})+1 AS BIGINT) AS {a}_to' for a, w in zip('ijk', (1, 1, 2)))}, CAST(max(CAST(i=0 AS INT)) + max(CAST(i=15 AS INT)) + max(CAST(j=0 AS INT)) + max(CAST(j=15 AS INT)) + max(CAST(k=0 AS INT)) + max(CAST(k=11 AS INT)) AS BIGINT) AS sides, {_BORDER} AS touches, avg(i) - 8 AS x FROM mask GROUP BY ALL),
        l AS (SELECT m.series_id, CASE WHEN round(m.x, 5) > round(CASE WHEN m.series_id % 3 = 0 THEN o.x ELSE -0.5 END, 5) THEN 'left' ELSE 'right' END AS observed FROM m LEFT JOIN m o ON o.series_id = m.series_id AND o.label = 2 WHERE m.label = 1)
        SELECT m.series_id, CAST(m.label AS BIGINT) AS label, voxels, ml, i_mm, i_from, i_to, j_mm, j_from, j_to, k_mm, k_from, k_to, pieces, sides, touches, round(x.long_mm, 4) AS long_mm, round(x.short_mm, 4) AS short_mm, CAST(x.k + 1 AS BIGINT) AS largest_axial,
            coalesce(sn.n, 0) AS solid_voxels, round(y.long_mm, 4) AS solid_long_mm, round(y.short_mm, 4) AS solid_short_mm, CASE WHEN m.label = 1 THEN observed END AS observed, CASE WHEN m.label = 1 THEN observed = CASE WHEN m.series_id % 2 = 0 THEN 'left' ELSE 'right' END END AS consistent
        FROM m JOIN p ON p.series_id = m.series_id AND p.label = m.label JOIN x ON x.series_id = m.series_id AND x.label = m.label LEFT JOIN y ON y.series_id = m.series_id AND y.label = m.label LEFT JOIN sn ON sn.series_id = m.series_id AND sn.label = m.label LEFT JOIN l ON l.series_id = m.series_id""",
    "pip05_metrics": f"""{W}, {_axes_sql('x', 'mask')}, r AS (SELECT series_id, label, value, row_number() OVER (PARTITION BY series_id, label ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY series_id, label) AS total FROM mask),
        s AS (SELECT series_id, label, 'axial' AS axis, k AS n, count(*) AS c FROM mask GROUP BY ALL UNION ALL SELECT series_id, label, 'coronal', j, count(*) FROM mask GROUP BY ALL UNION ALL SELECT series_id, label, 'sagittal', i, count(*) FROM mask GROUP BY ALL),
        t AS (SELECT series_id, label, axis, n + 1 AS n FROM s QUALIFY row_number() OVER (PARTITION BY series_id, label, axis ORDER BY c DESC, n) = 1), b AS (SELECT series_id, label, max(n) FILTER (WHERE axis = 'axial') AS a, max(n) FILTER (WHERE axis = 'coronal') AS c, max(n) FILTER (WHERE axis = 'sagittal') AS s FROM t GROUP BY ALL),
        g AS (SELECT m.series_id, m.label, any_value(modality) AS modality, count(*) AS n, {', '.join(f'max({a})-min({a})+1 AS e{a}, avg({a}) AS c{a}' for a in 'ijk')}, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi FROM mask m JOIN series s ON s.series_id = m.series_id GROUP BY m.series_id, m.label),
        q AS (SELECT series_id, label, {', '.join(f'{_PCT(v / 100)} AS p{v}' for v in (5, 25, 50, 75, 95))} FROM r GROUP BY ALL),
        f AS (SELECT g.series_id, g.label, modality, CAST(n AS DOUBLE) AS "size.voxels", n * 2.0::DOUBLE AS "size.volume_mm3", n * 0.002::DOUBLE AS "size.volume_ml", ei::DOUBLE AS "size.extent_i_mm", ej::DOUBLE AS "size.extent_j_mm", 2.0::DOUBLE * ek AS "size.extent_k_mm",
            ox + ci AS "size.centroid_x_mm", oy + cj AS "size.centroid_y_mm", oz + 2 * ck AS "size.centroid_z_mm", x.long_mm AS "size.long_axis_mm", x.short_mm AS "size.short_axis_mm", b.a::DOUBLE AS "size.largest_slice_axial", b.c::DOUBLE AS "size.largest_slice_coronal", b.s::DOUBLE AS "size.largest_slice_sagittal",
            mean AS "intensity.mean", std AS "intensity.std", lo AS "intensity.min", hi AS "intensity.max", hi - lo AS "intensity.range", {', '.join(f'p{v} AS "intensity.p{v}"' for v in (5, 25, 50, 75, 95))}, p75 - p25 AS "intensity.iqr"
            FROM g JOIN q ON q.series_id = g.series_id AND q.label = g.label JOIN b ON b.series_id = g.series_id AND b.label = g.label JOIN x ON x.series_id = g.series_id AND x.label = g.label),
        u AS (UNPIVOT f ON COLUMNS(* EXCLUDE (series_id, label, modality)) INTO NAME feature VALUE value)
        SELECT series_id, CAST(label AS BIGINT) AS label, feature, CASE WHEN modality = 'CT' OR starts_with(feature, 'size.') THEN round(value, 3) END AS value, CASE WHEN modality <> 'CT' AND starts_with(feature, 'intensity.') THEN 'the unit of the values is unknown' END AS reason FROM u""",
    "pip05_warnings": f"""{_R}, {_lattice._HOLES}, p AS (SELECT series_id, label, count(*) AS pieces, CAST(max(voxels) / sum(voxels) AS DOUBLE) AS share FROM comp GROUP BY ALL), h AS (SELECT series_id, label, i, j, k, i + 16*(j + 16*k) AS vox FROM hole),
        hl AS (SELECT a.series_id, a.label, a.vox AS a, b.vox AS b FROM h a JOIN h b ON b.series_id = a.series_id AND b.label = a.label AND abs(a.i-b.i)+abs(a.j-b.j)+abs(a.k-b.k) <= 1), hr AS (SELECT * FROM hl UNION SELECT r.series_id, r.label, r.a, l.b FROM hr r JOIN hl l ON l.series_id = r.series_id AND l.label = r.label AND l.a = r.b),
        hc AS (SELECT series_id, label, count(DISTINCT root) AS holes, count(*) AS voxels FROM (SELECT series_id, label, a, min(b) AS root FROM hr GROUP BY ALL) GROUP BY ALL),
        s AS (SELECT series_id, label, max(CAST(i=0 AS INT)) + max(CAST(i=15 AS INT)) + max(CAST(j=0 AS INT)) + max(CAST(j=15 AS INT)) + max(CAST(k=0 AS INT)) + max(CAST(k=11 AS INT)) AS sides FROM mask GROUP BY ALL)
        SELECT series_id, CAST(label AS BIGINT) AS label, 'fragmented' AS warning, printf('fragmented: %d pieces, the largest holds %.1f %% of the voxels (warns below 95 %%)', pieces, 100 * share) AS message FROM p WHERE share < 0.95
        UNION ALL SELECT series_id, CAST(label AS BIGINT), 'has_holes', 'has_holes: ' || holes || ' cavities of ' || voxels || ' voxels enclosed by the segment' FROM hc
        UNION ALL SELECT series_id, CAST(label AS BIGINT), 'touches_border', 'touches_border: the segment reaches ' || sides || ' side(s) of the image and may be cut off' FROM s WHERE sides > 0""",
    "pip05_curves": f"""{W}, v AS (SELECT m.series_id, m.label, value FROM mask m JOIN series s ON s.series_id = m.series_id AND modality = 'CT'), e AS (SELECT series_id, label, min(value) AS lo, max(value) AS hi, count(*) AS total FROM v GROUP BY ALL)
        SELECT e.series_id, CAST(e.label AS BIGINT) AS label, CAST(p.point AS BIGINT) AS point, round(count(*) FILTER (WHERE CASE WHEN hi > lo THEN floor((value - lo) * 100 / (hi - lo)) ELSE 100 END >= p.point) / any_value(total), 6) AS fraction FROM e JOIN v ON v.series_id = e.series_id AND v.label = e.label CROSS JOIN range(101) AS p(point) GROUP BY e.series_id, e.label, p.point""",
    "pip05_ranges": f"""{W}, v AS (SELECT m.series_id, m.label, value FROM mask m JOIN series s ON s.series_id = m.series_id AND modality = 'CT'), t AS (SELECT series_id, label, count(*) AS total FROM v GROUP BY ALL), r(low, high) AS (VALUES (-1000, -500), (-500, -100), (-100, 0), (0, 100), (100, 300), (300, 1000), (NULL, NULL))
        SELECT t.series_id, CAST(t.label AS BIGINT) AS label, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(v.value) AS voxels, round(count(v.value) / any_value(total), 6) AS share FROM t CROSS JOIN r
        LEFT JOIN v ON v.series_id = t.series_id AND v.label = t.label AND CASE WHEN low IS NULL THEN v.value < -1000 OR v.value >= 1000 ELSE v.value >= low AND v.value < high END GROUP BY ALL""",
    "pip06_compare": f"""WITH sm AS ({{same}}), {C.VOXELS_SQL}, a AS (SELECT m.series_id, label, i, j, k FROM mask m JOIN sm ON sm.series = m.series_id), b AS (SELECT series_id, label, i + 1 AS i, j, k FROM a WHERE NOT (label = 1 AND series_id % 4 = 0)), {_SURFACE('sa', 'a')}, {_SURFACE('sb', 'b')},
        d AS (SELECT a.series_id, a.label, a.i AS ai, a.j AS aj, a.k AS ak, b.i AS bi, b.j AS bj, b.k AS bk, sqrt((a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j) + 4*(a.k-b.k)*(a.k-b.k)) AS mm FROM sa a JOIN sb b ON a.series_id = b.series_id AND a.label = b.label),
        u AS (SELECT series_id, label, 1 AS way, min(mm) AS mm FROM d GROUP BY series_id, label, ai, aj, ak UNION ALL SELECT series_id, label, 2, min(mm) FROM d GROUP BY series_id, label, bi, bj, bk),
        r AS (SELECT *, row_number() OVER (PARTITION BY series_id, label, way ORDER BY mm) - 1 AS place, count(*) OVER (PARTITION BY series_id, label, way) AS n FROM u), h AS (SELECT series_id, label, max(mm) AS hausdorff, max(CASE WHEN place = round((n-1)*0.95) THEN mm END) AS hd95 FROM r GROUP BY ALL),
        na AS (SELECT series_id, label, count(*) AS n, avg(i) AS x, avg(j) AS y, avg(k) AS z FROM a GROUP BY ALL), nb AS (SELECT series_id, label, count(*) AS n, avg(i) AS x, avg(j) AS y, avg(k) AS z FROM b GROUP BY ALL), o AS (SELECT a.series_id, a.label, count(*) AS n FROM a JOIN b ON a.series_id = b.series_id AND a.label = b.label AND a.i = b.i AND a.j = b.j AND a.k = b.k GROUP BY ALL)
        SELECT na.series_id, CAST(na.label AS BIGINT) AS label, round(na.n * 0.002::DOUBLE, 4) AS ml_a, round(coalesce(nb.n, 0) * 0.002::DOUBLE, 4) AS ml_b, round((coalesce(nb.n, 0) - na.n) * 0.002::DOUBLE, 4) AS difference_ml, round(coalesce(o.n, 0) * 0.002::DOUBLE, 4) AS overlap_ml,
            round(2.0::DOUBLE * coalesce(o.n, 0) / (na.n + coalesce(nb.n, 0)), 4) AS dice, round(1.0::DOUBLE * coalesce(o.n, 0) / (na.n + coalesce(nb.n, 0) - coalesce(o.n, 0)), 4) AS jaccard, round(hausdorff, 4) AS hausdorff, round(hd95, 4) AS hd95, round(sqrt((na.x-nb.x)**2 + (na.y-nb.y)**2 + 4*(na.z-nb.z)**2), 4) AS centroid_mm
        FROM na LEFT JOIN nb ON nb.series_id = na.series_id AND nb.label = na.label LEFT JOIN o ON o.series_id = na.series_id AND o.label = na.label LEFT JOIN h ON h.series_id = na.series_id AND h.label = na.label""".replace("{same}", _SAME_SQL),
    "pip07_edit": f"""{_R}, {_HOLES}, n AS (SELECT series_id, label, count(*) AS before, count(*) FILTER (WHERE i BETWEEN 4 AND 12 AND j BETWEEN 4 AND 12 AND k BETWEEN 3 AND 7) AS boxed FROM mask GROUP BY ALL), c AS (SELECT series_id, label, max(voxels) AS largest, coalesce(sum(voxels) FILTER (WHERE voxels >= 3), 0) AS big FROM comp GROUP BY ALL),
        f AS (SELECT h.series_id, h.label, count(*) AS filled FROM hole h ANTI JOIN mask m ON m.series_id = h.series_id AND m.i = h.i AND m.j = h.j AND m.k = h.k GROUP BY ALL),
        r AS (SELECT n.*, largest, big, coalesce(filled, 0) AS filled, ['keep_largest', 'fill_holes', 'restrict_to_box', 'remove_small'][n.series_id % 4 + 1] AS op, CASE WHEN n.series_id % 5 = 0 THEN 'made by a person' WHEN (n.series_id + n.label) % 7 = 0 THEN 'confirmed' END AS reason FROM n JOIN c ON c.series_id = n.series_id AND c.label = n.label LEFT JOIN f ON f.series_id = n.series_id AND f.label = n.label)
        SELECT series_id, CAST(label AS BIGINT) AS label, op, before, CAST(CASE WHEN reason IS NOT NULL THEN before WHEN op = 'keep_largest' THEN largest WHEN op = 'fill_holes' THEN before + filled WHEN op = 'restrict_to_box' THEN boxed ELSE big END AS BIGINT) AS after, reason FROM r""",
    "pip08_checks": f"""{_R}, p AS (SELECT series_id, label, max(voxels) / sum(voxels) AS share FROM comp GROUP BY ALL), m AS (SELECT series_id, label, count(*) AS n, {_BORDER} AS touches, min(i) <= 2 OR max(i) >= 13 OR min(j) <= 2 OR max(j) >= 13 AS cut, count(*) FILTER (WHERE k < 7) AS kept, avg(i) - 8 AS x FROM mask GROUP BY ALL),
        w AS (SELECT series_id, count(*) AS owned FROM mask WHERE value > 700 GROUP BY 1), q AS (SELECT series_id, CAST(l AS BIGINT) AS label FROM series, (VALUES (1), (2), (3)) AS t(l)),
        l AS (SELECT m.series_id, (round(m.x, 5) > round(CASE WHEN m.series_id % 3 = 0 THEN o.x ELSE -0.5 END, 5)) = (m.series_id % 2 = 0) AS consistent FROM m LEFT JOIN m o ON o.series_id = m.series_id AND o.label = 2 WHERE m.label = 1)
        SELECT q.series_id, q.label, CASE WHEN n IS NULL THEN 'empty' ELSE concat_ws(',', CASE WHEN share < 0.9 THEN 'components' END, CASE WHEN cut THEN 'roi' END, CASE WHEN touches THEN 'border' END, CASE WHEN n * 0.002 < 0.2 OR n * 0.002 > 5 THEN 'size' END, CASE WHEN q.label = 1 AND coalesce(owned, 0) > 0.01 * n THEN 'overlap' END,
            CASE WHEN q.label = 1 AND NOT consistent THEN 'laterality' END, CASE WHEN 2.0 * kept / (n + kept) < 0.95 THEN 'stability' END) END AS failed
        FROM q LEFT JOIN m ON m.series_id = q.series_id AND m.label = q.label LEFT JOIN p ON p.series_id = q.series_id AND p.label = q.label LEFT JOIN w ON w.series_id = q.series_id LEFT JOIN l ON l.series_id = q.series_id""",
    "win15_stability": f"{W}, v AS (SELECT series_id, label, i, j, k, r.revision FROM mask, range(1, 4) AS r(revision) WHERE k BETWEEN 2 AND 8 AND k <= 4 + r.revision), n AS (SELECT series_id, label, revision, count(*) AS n FROM v GROUP BY ALL) SELECT a.series_id, CAST(a.label AS BIGINT) AS label, a.revision, round(2.0 * b.n / (a.n + b.n), 6) AS dice, 2.0 * b.n / (a.n + b.n) >= 0.95 AS stable FROM n a JOIN n b ON b.series_id = a.series_id AND b.label = a.label AND b.revision = a.revision - 1",
    "win08_gaussian": f"""{W}, w AS (SELECT o, exp(-o*o/2.0) / (1 + 2*exp(-0.5) + 2*exp(-2.0) + 2*exp(-4.5)) AS w FROM range(-3, 4) AS t(o)),
        x AS (SELECT p.series_id, p.i, p.j, p.k, sum(w.w * b.value) AS v FROM voxels p, w JOIN voxels b ON b.series_id = p.series_id AND b.j = p.j AND b.k = p.k AND b.i = least(greatest(p.i + w.o, 0), 15) GROUP BY ALL),
        y AS (SELECT p.series_id, p.i, p.j, p.k, sum(w.w * b.v) AS v FROM x p, w JOIN x b ON b.series_id = p.series_id AND b.i = p.i AND b.k = p.k AND b.j = least(greatest(p.j + w.o, 0), 15) GROUP BY ALL)
        SELECT p.series_id, CAST(p.i AS BIGINT) AS i, CAST(p.j AS BIGINT) AS j, CAST(p.k AS BIGINT) AS k, round(sum(w.w * b.v), 5) AS smooth FROM y p, w JOIN y b ON b.series_id = p.series_id AND b.i = p.i AND b.j = p.j AND b.k = least(greatest(p.k + w.o, 0), 11) GROUP BY ALL""",
    "win11_peaks": f"""{_STORED}, w AS (SELECT o, exp(-o*o/4.5) AS w FROM range(-5, 6) AS t(o)), s AS (SELECT a.series_id, a.bin, round(sum(w.w * b.n) / sum(w.w), 9) AS h FROM h a, w JOIN h b ON b.series_id = a.series_id AND b.bin = a.bin + w.o GROUP BY ALL),
        p AS (SELECT *, lag(h) OVER v AS f, lead(h) OVER v AS t FROM s WINDOW v AS (PARTITION BY series_id ORDER BY bin))
        SELECT series_id, CAST(bin AS BIGINT) AS bin, round(h, 4) AS height, row_number() OVER (PARTITION BY series_id ORDER BY h DESC, bin) AS rank FROM p WHERE bin >= 2 AND h > f AND h >= t AND h > 0""",
    "join12_same_catalogues": "WITH f AS (SELECT DISTINCT l_orderkey AS series, l_linenumber % 2 AS w, CAST(l_partkey AS VARCHAR) AS path, sha256(CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem), l AS (SELECT series, w, list_sort(list(path || h)) AS files FROM f GROUP BY ALL) SELECT a.series, a.files = b.files AS same, len(a.files) AS files FROM l a JOIN l b ON a.series = b.series AND a.w = 0 AND b.w = 1",
    "join13_source_integrity": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 AND p_brand <> p_name THEN 'changed' ELSE 'ok' END AS status FROM part",
    "join14_slice_match": f"""{_H}, n AS (SELECT DISTINCT series_uid, path, z, CASE WHEN path % 13 = 0 THEN -0.9995 WHEN path % 11 = 0 THEN 0.95 ELSE cos(tilt) END AS along FROM h WHERE z IS NOT NULL), e AS (SELECT series_uid, 1.5::DOUBLE + series_uid % 3 AS spacing, min(z) AS a, max(z) AS b FROM n GROUP BY 1),
        o AS (SELECT *, unnest(range(0, CAST(floor((b - a) / spacing) AS BIGINT) + 1)) AS slice FROM e), m AS (SELECT o.series_uid, o.slice, path, spacing, round(abs(z - (a + slice * spacing)), 6) AS off FROM o JOIN n ON n.series_uid = o.series_uid AND abs(along) > 0.999)
        SELECT series_uid, slice, path, off FROM m WHERE off <= spacing / 2 QUALIFY row_number() OVER (PARTITION BY series_uid, slice ORDER BY off, path) = 1""",
    "top09_seed_slices": f"{W}, c AS (SELECT series_id, label, 'sagittal' AS axis, i AS at, count(*) AS n FROM mask GROUP BY ALL UNION ALL SELECT series_id, label, 'coronal', j, count(*) FROM mask GROUP BY ALL UNION ALL SELECT series_id, label, 'axial', k, count(*) FROM mask GROUP BY ALL), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY series_id, label, axis ORDER BY n DESC, at) = 1) SELECT m.series_id, CAST(m.label AS BIGINT) AS label, axis, {IJK} FROM mask m JOIN t ON t.series_id = m.series_id AND t.label = m.label AND CASE axis WHEN 'axial' THEN k WHEN 'coronal' THEN j ELSE i END = t.at".replace("AS at,", "AS pos,").replace("slice, at)", "slice, pos)").replace("n DESC, at)", "n DESC, pos)").replace("t.at", "t.pos"),
    "prj11_plane_mapping": f"{W} SELECT {L}, 'axial' AS plane, CAST(i AS BIGINT) AS px, CAST(j AS BIGINT) AS py, CAST(k AS BIGINT) AS slice FROM mask UNION ALL SELECT {L}, 'coronal', CAST(i AS BIGINT), CAST(11 - k AS BIGINT), CAST(j AS BIGINT) FROM mask UNION ALL SELECT {L}, 'sagittal', CAST(j AS BIGINT), CAST(11 - k AS BIGINT), CAST(i AS BIGINT) FROM mask",
    "prj12_reorientation": f"""{W}, o AS (SELECT *, [[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]][series_id % 6 + 1] AS t, CASE WHEN (series_id // 6) % 2 = 1 THEN 15 - i ELSE i END AS a, CASE WHEN (series_id // 12) % 2 = 1 THEN 15 - j ELSE j END AS b, CASE WHEN (series_id // 24) % 2 = 1 THEN 11 - k ELSE k END AS c FROM mask)
        SELECT {L}, {', '.join(f'CAST(CASE {n} WHEN t[1] THEN a WHEN t[2] THEN b ELSE c END AS BIGINT) AS {x}' for n, x in enumerate('ijk'))} FROM o""",
    "prj14_uids": """WITH h AS (SELECT c_custkey, substr(sha256(c_name || chr(0)), 1, 32) AS h FROM customer), n AS (SELECT c_custkey, list_reduce(list_transform(range(1, 33), lambda x: CAST(strpos('0123456789abcdef', h[x]) - 1 AS UHUGEINT)), lambda a, x: a * 16 + x) AS n FROM h)
        SELECT c_custkey, '2.25.' || CAST(n AS VARCHAR) AS uid FROM n""",
    "prj21_json_numbers": "WITH e AS (SELECT event_id, unnest(regexp_extract_all(regexp_replace(coalesce(props, 'null'), '\"[^\"]*\"', '', 'g'), '-?[0-9]+(?:\\.[0-9]+)?')) AS n FROM events) SELECT event_id, CAST(n AS DOUBLE) AS number FROM e UNION ALL SELECT event_id, -3.5 FROM events UNION ALL SELECT event_id, CAST(event_id AS DOUBLE) FROM events",
    "agg36_mask_hash": f"{W}, {C.HASHED_SQL} SELECT {L}, hash FROM hashed",
}
