"""Operators against phantoms whose answers are known, and against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumivox.functions import text as T
from lumivox.operators import filters as X
from lumivox.operators import hull as H
from lumivox.operators import intensity as I
from lumivox.operators import lattice as N
from lumivox.operators import masks as M
from lumivox.plans.components import connected_components
from lumivox.operators import profiles as P
from lumivox.operators import series as S
from lumivox.sources import volumes as V
from lumivox.sources.volumes import parse_header
from lumivox.streaming import feeds

MASK = "series_id long, label int, i int, j int, k int"


def mask(spark, cells, series=1, label=1):
    return spark.createDataFrame([(series, label, *c) for c in cells], MASK)


def box(n, start=0):
    return [(i + start, j, k) for i in range(n) for j in range(n) for k in range(n)]


def one(df):
    return df.collect()[0]


def test_cube(spark):
    m = mask(spark, box(6))
    assert one(M.size(m, 2.0))["voxels"] == 216
    assert one(M.euler_number(m))["euler"] == 1
    assert one(M.covariance(m, (1, 1, 1)))["cii"] == pytest.approx(35 / 12)
    assert one(M.axis_lengths(M.covariance(m, (1, 1, 1))))["major"] == pytest.approx(4 * np.sqrt(35 / 12))
    assert M.surface(m).count() == 216 - 64
    assert one(H.max_diameter(m, (1, 1, 2)))["diameter_mm"] == pytest.approx(np.sqrt(25 + 25 + 100))
    assert M.runs(m, (6, 6, 6)).count() == 1


def test_cavity_and_ring(spark):
    hollow = [c for c in box(5) if c != (2, 2, 2)]
    ring = [(i, j, 0) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    assert one(M.euler_number(mask(spark, hollow)))["euler"] == 2
    assert one(M.euler_number(mask(spark, ring)))["euler"] == 0
    assert one(N.cavities(mask(spark, hollow)))["voxels"] == 1
    assert N.fill_holes(mask(spark, hollow)).count() == 125
    assert N.cavities(mask(spark, ring)).count() == 0


def test_pieces_touching_at_a_corner(spark):
    cells = [(0, 0, 0), (1, 1, 1), (4, 0, 0)]
    assert N.components(mask(spark, cells)).count() == 2
    assert N.components(mask(spark, cells), diagonal=False).count() == 3
    assert N.keep_pieces(mask(spark, cells), largest=True).count() == 2


def test_empty_mask(spark):
    empty = mask(spark, [])
    for result in (M.size(empty, 1.0), M.euler_number(empty), N.components(empty), N.fill_holes(empty), M.surface(empty), M.runs(empty, (4, 4, 4))):
        assert result.count() == 0


def test_long_path_has_one_component(spark):
    path = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = connected_components(path.unionByName(spark.createDataFrame([(900, 900), (None, 3)], "src long, dst long")))
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(0, 401), (900, 1)}


def test_distances_are_exact(spark):
    rng = np.random.default_rng(1)
    inside = rng.random((7, 5, 4)) < 0.1
    inside[0, 0, 0] = True
    rows = [(1, 1, i, j, k, bool(inside[i, j, k])) for i in range(7) for j in range(5) for k in range(4)]
    got = N.squared_distances(spark.createDataFrame(rows, MASK + ", inside boolean"), (1.0, 0.5, 2.0)).collect()
    at = np.argwhere(inside) * (1.0, 0.5, 2.0)
    for r in got:
        assert r["d2"] == pytest.approx((((np.array([r["i"], r["j"], r["k"]]) * (1.0, 0.5, 2.0)) - at) ** 2).sum(axis=1).min())


def test_nearest_voxels_far_and_near(spark):
    a, b = mask(spark, [(0, 0, 0), (1, 0, 0)]), mask(spark, [(2, 0, 0), (90, 5, 5)], label=2)
    assert sorted(r["mm"] for r in M.distances(a, b, (1, 1, 1)).collect()) == [1.0, 2.0]
    assert one(M.distances(a.where("i = 0"), b.where("i = 90"), (1, 1, 1)))["mm"] == pytest.approx(np.sqrt(8150))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-500, 500), min_size=1, max_size=60))
def test_percentiles_are_nearest_rank(spark, values):
    counts = I.value_counts(spark.createDataFrame([(1, float(v)) for v in values], "label int, value double"), ["label"])
    got = one(I.percentiles(counts, ["label"], [0.05, 0.5, 0.95]))
    ranked = sorted(values)
    for q, name in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95")):
        assert got[name] == ranked[int(np.floor((len(values) - 1) * q + 0.5))]


def test_constant_values_have_no_skewness(spark):
    counts = I.value_counts(spark.createDataFrame([(1, 5.0)] * 9 + [(1, None)], "label int, value double"), ["label"])
    got = one(I.shape_of_distribution(counts, ["label"]))
    assert got["skewness"] is None and got["kurtosis"] is None and got["mad"] == 0


def test_overlapping_ranges_are_refused(spark):
    with pytest.raises(ValueError):
        I.range_shares(None, ["label"], [(0.0, 10.0, "a"), (5.0, 20.0, "b")])


def test_texts(spark):
    df = spark.createDataFrame([("size 1,000 is 3.5 or -2",)], "t string")
    assert one(df.select(T.numbers(F.col("t")).alias("n")))["n"] == [1.0, 0.0, 3.5, -2.0]
    assert one(spark.range(1).select(T.checked_person(F.lit("a​b")).alias("p")))["p"] is None


def test_bad_header():
    for content in (b"", b"x" * 400):
        with pytest.raises(ValueError):
            parse_header(content)


def test_mesh(spark):
    from lumivox.operators.surface import mesh, polygons

    dot = one(mesh(mask(spark, [(4, 5, 6)]), (1.0, 1.0, 1.0)))  # an octahedron
    assert dot["area_mm2"] == pytest.approx(np.sqrt(3)) and dot["volume_mm3"] == pytest.approx(1 / 6)
    ball = [(i, j, k) for i in range(-9, 10) for j in range(-9, 10) for k in range(-9, 10) if i * i + j * j + k * k <= 81]
    got = one(mesh(mask(spark, ball), (1.0, 1.0, 1.0)))
    assert got["volume_mm3"] == pytest.approx(4 / 3 * np.pi * 729, rel=0.03) and 0.85 < got["sphericity"] <= 1
    for pattern in range(256):  # every cut edge is in one loop, once
        edges = [e for loop in polygons(pattern) for e in loop]
        cut = [(a, b) for a in range(8) for b in range(a + 1, 8) if bin(a ^ b).count("1") == 1 and (pattern >> a & 1) != (pattern >> b & 1)]
        assert sorted(edges) == sorted(cut)


def test_hull(spark):
    cube = one(H.convex_hull(mask(spark, box(6)), (1.0, 1.0, 1.0)))  # a cube of voxels with its edges and corners cut off
    assert cube["hull_volume_mm3"] == pytest.approx(6**3 - 12 * (5 / 8) - 8 * (1 / 8 - 1 / 48), rel=1e-4) and cube["corners"] == 24
    cells = [(i, j, k) for i in range(-8, 9) for j in range(-8, 9) for k in range(-8, 9) if i * i + j * j + k * k <= 64]
    ball = mask(spark, cells)
    hull = one(H.convex_hull(ball, (1.0, 1.0, 1.0)))
    from lumivox.operators.surface import mesh

    assert 0.9 < one(mesh(ball, (1.0, 1.0, 1.0)))["volume_mm3"] / hull["hull_volume_mm3"] <= 1
    points = np.array(cells, float)
    far = ((points[:, None] - points[None]) ** 2).sum(axis=2).max()
    assert one(H.max_diameter(ball, (1, 1, 1)))["diameter_mm"] == pytest.approx(np.sqrt(far))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 6)), min_size=5, max_size=60))
def test_no_point_is_outside_its_hull(cells):
    points = np.array(sorted({(2 * i + a, 2 * j + b, 2 * k + c) for i, j, k in cells for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))}), float)
    faces = H._facets(points)
    a, b, c = (points[faces[:, n]] for n in range(3))
    normal = np.cross(b - a, c - a)
    assert ((points @ normal.T - (a * normal).sum(axis=1)) <= 1e-3).all()
    edges = {(f[n], f[(n + 1) % 3]) for f in faces.tolist() for n in range(3)}
    assert len(edges) == 3 * len(faces) and all((v, u) in edges for u, v in edges)  # closed


def test_distances_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 200, (60, 3)), np.concatenate([rng.integers(0, 30, (40, 3)), rng.integers(150, 200, (40, 3))])
    got = M.distances(mask(spark, a.tolist()), mask(spark, b.tolist(), label=2), (1.0, 0.5, 2.0)).collect()
    assert len(got) == len({tuple(x) for x in a.tolist()})
    for r in got:
        d = np.sqrt((((b - [r["i"], r["j"], r["k"]]) * (1.0, 0.5, 2.0)) ** 2).sum(axis=1))
        assert r["mm"] == pytest.approx(d.min()) and any((b[n] == [r["ti"], r["tj"], r["tk"]]).all() for n in np.flatnonzero(d == d.min()))


def test_small_steps_are_no_one_position(spark):
    rows = [(1, n, 0.00006 * n) for n in range(6)] + [(2, n, 1.0) for n in range(3)]
    names = ["temporal_position", "echo_number", "echo_time", "b_value", "acquisition_number", "trigger_time", "frame_reference_time", "isotropic", "instance_number"]
    df = spark.createDataFrame(rows, "series_uid long, path long, z double").select("*", *[F.lit(None).cast("boolean" if n == "isotropic" else "double").alias(n) for n in names])
    got = {(r["series_uid"], r["path"]): r["position"] for r in S.order_by_position(df).collect()}
    assert [got[1, n] for n in range(6)] == [0, 0, 1, 1, 2, 2] and {got[2, n] for n in range(3)} == {0}


@settings(max_examples=30, deadline=None)
@given(st.permutations([0, 1, 2]), st.tuples(st.booleans(), st.booleans(), st.booleans()), st.floats(-0.2, 0.2))
def test_oblique_axes_go_to_the_nearest(order, turned, off):
    axes = np.full((3, 3), off)
    for stored, axis in enumerate(order):
        axes[axis, stored] = -1.0 if turned[stored] else 1.0
    assert V.assigned(axes) == (list(order), list(turned))


def test_files_of_every_layout_read_alike(spark):
    from lumivox.plans.scratch import scratch_path

    rng = np.random.default_rng(2)
    cells = [(s, i, j, k, int(rng.integers(-900, 900))) for s in range(4) for i in range(3) for j in range(4) for k in range(5)]
    df = spark.createDataFrame(cells, "series_id long, i int, j int, k int, value int")
    for packed in (False, True):
        folder = scratch_path(spark, "files")
        V.write_volumes(df, folder, "value", (1.0, 2.0, 3.0), packed=packed).collect()
        whole = spark.read.format("binaryFile").load(folder)
        files = V.listed(spark, folder)
        assert sorted(V.read_headers(whole).collect(), key=str) == sorted(V.read_headers(files).collect(), key=str) and V.read_volume(whole).count() == df.count()
        got = V.read_volume(files).selectExpr("CAST(regexp_extract(path, '([0-9]+).nii', 1) AS BIGINT) AS series_id", "i", "j", "k", "CAST(value AS INT) AS value")
        assert sorted(map(tuple, got.collect())) == sorted(cells)
        assert V.rejected(files).count() == 0
    bad = spark.createDataFrame([("a.nii", b"short")], "path string, content binary")
    assert V.read_headers(bad).count() == 0 and V.rejected(bad).first()["reason"] == "shorter than a header"
    with pytest.raises(Exception, match="no volume 2"):
        V.read_volume(files, 1).collect()


def test_inventory_has_bounds(spark, tmp_path):
    for name in ("a.nii", ".hidden.nii", "sub/b.dcm", "sub/.secret/c.nii", "sub/plain"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 200)
    got = {r["path"].rsplit("/", 1)[-1]: r["format"] for r in V.inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.nii": "nifti", "b.dcm": "dicom", "plain": "unknown"}
    for limit in ({"most": 2}, {"depth": 0}):
        with pytest.raises(ValueError):
            V.inventory(spark, str(tmp_path), **limit)


def test_metrics_give_reasons(spark):
    m = mask(spark, box(3)).withColumn("value", F.lit(5.0))
    series = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "CT")], "series_id long, ox double, oy double, oz double, modality string")
    got = {r["feature"]: (r["value"], r["reason"]) for r in P.metrics(m, series, (8, 8, 8), (1.0, 1.0, 1.0), "clinical").collect()}
    assert len(got) == sum(map(len, P.CLINICAL.values()))
    assert got["intensity.skewness"] == (None, "all values are equal") and got["shape.major_axis_dir_x"] == (None, "another axis is as long")
    assert got["topology.euler_number"][0] == 1 and got["size.max_diameter_mm"][0] == pytest.approx(np.sqrt(12)) and got["topology.border_sides"][0] == 3
    unknown = {r["feature"]: r["reason"] for r in P.metrics(m, series.withColumn("modality", F.lit("MR")), (8, 8, 8), (1.0, 1.0, 1.0)).collect()}
    assert unknown["intensity.mean"] == "the unit of the values is unknown" and unknown["size.voxels"] is None
    with pytest.raises(ValueError, match="unknown profile"):
        P.metrics(m, series, (8, 8, 8), (1.0, 1.0, 1.0), "nope")


def test_large_files_are_read_in_part(spark, tmp_path, monkeypatch):
    """A sparse file of 3 GB: its header, a plan with many slabs, and the slices of one of them; it is more than an array of bytes can hold."""
    import struct

    size = [1024, 1024, 1536]
    header = bytearray(V.header_bytes(size, (1.0, 1.0, 1.0), V.LAYOUTS[3]))
    path = tmp_path / "large.nii"
    with open(path, "wb") as f:
        f.write(header)
        f.truncate(352 + 2 * size[0] * size[1] * size[2])
        f.seek(352 + 2 * (size[0] * size[1] * 1500 + 7))
        f.write(struct.pack("<h", 55))
    files = V.listed(spark, str(tmp_path))
    assert [(r["nx"], r["nz"], r["volumes"]) for r in V.read_headers(files).collect()] == [(1024, 1536, 1)]
    reads = []
    monkeypatch.setattr(V, "file_system", lambda uri, held=V.file_system: (reads.append(uri), held(uri))[1])
    assert len(V._first_bytes(str(path))[0]) == 352 and len(reads) == 1
    slices = list(V._slices(str(path), None, 352 + 2 * size[0] * size[1] * 1500, 2 * size[0] * size[1], 2))
    assert [len(x) for x in slices] == [2 << 20] * 2 and np.frombuffer(slices[0], "<i2")[7] == 55 and not any(slices[1])


def test_gzipped_files_are_unpacked_as_streams(tmp_path):
    import gzip

    data = bytes(range(256)) * 5000
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(data[:700_000]) + gzip.compress(data[700_000:]))  # of two members
    assert b"".join(V._slices(str(path), None, 1000, 4096, 200)) == data[1000 : 1000 + 4096 * 200]
    assert V._first_bytes(str(path)) == (data[:352], True)
    assert [len(x) for x in V._slices(str(path), None, len(data) - 5000, 4096, 3)] == [4096, 904]  # cut off


def streamed(spark, batches, schema, step):
    """What a stream tells of batches that come one after another."""
    return sorted(map(tuple, feeds.replay([spark.createDataFrame(rows, schema) for rows in batches], step, "told").collect()), key=str)


def test_late_entries_are_left_out(spark):
    schema = "event_id long, time timestamp, command string, ok boolean"
    at = lambda day, hour=0: __import__("datetime").datetime(2024, 1, day, hour)
    batches = [[(1, at(1), "a", True), (2, at(1, 5), "a", False)], [(3, at(9), "b", True)], [(4, at(9, 5), "b", True)], [(5, at(1, 6), "a", True)], [(6, at(20), "c", True)]]
    got = streamed(spark, batches, schema, feeds.command_counts)
    assert [r[1:] for r in got] == [("a", 2, 1), ("b", 2, 0)]  # the last window is open still


def test_change_feed_over_batches(spark):
    schema = "event_id long, time long, workspace long, item long, command string, ok boolean"
    row = lambda n, command, ok=True: (n, n, 1, 7, command, ok)
    batches = [[row(1, "segment edit"), row(2, "review confirm")], [row(3, "segment edit"), row(4, "review confirm")], [row(5, "item delete"), row(6, "item delete")], [row(7, "segment edit"), row(8, "review confirm", False)]]
    got = streamed(spark, batches, schema, feeds.change_feed)
    assert [(r[0], r[3]) for r in got] == [(1, "added"), (2, "reviewed"), (3, "revised"), (5, "removed"), (7, "added")]


def test_decisions_over_batches(spark):
    schema = "event_id long, time long, workspace long, item long, command string, ok boolean, revision string"
    row = lambda n, command, revision, ok=True: (n, n, 1, 7, command, ok, revision)
    batches = [[row(0, "review confirm", "a"), row(1, "segment edit", "a")], [row(2, "segment edit", "b"), row(3, "review confirm", "a"), row(4, "review reject", "b", False)], [row(5, "review confirm", "b")], [row(6, "review reject", "b"), row(7, "review reject", "a")]]
    got = streamed(spark, batches, schema, feeds.decisions)
    assert [r[3:] for r in got] == [("unknown", "a", None), ("stale", "a", "b"), ("failed", "b", "b"), ("accepted", "b", "b"), ("decided", "b", "b"), ("stale", "a", "b")]


def test_snapshots_tell_what_they_lack(spark):
    schema = "workspace long, snapshot long, item long, content string, status string"
    mark = lambda n, w=1: (w, n, None, None, None)
    batches = [
        [mark(0), (1, 0, 5, "a", "proposed"), (1, 0, 6, "b", "proposed"), mark(0, 2), (2, 0, 5, "z", None)],
        [mark(1), (1, 1, 5, "a", "confirmed"), (1, 1, 7, "c", "proposed"), mark(1, 2), (2, 1, 5, "z", None)],
        [mark(2), (1, 2, 5, "d", "rejected"), (1, 2, 6, "b", "proposed"), (1, 2, 7, "c", "proposed"), mark(3), mark(2, 2)],  # two snapshots of a workspace in one batch
    ]
    got = streamed(spark, batches, schema, feeds.snapshot_feed)
    assert got == sorted([
        (1, 1, 5, "reviewed", "confirmed"), (1, 1, 6, "removed", "proposed"), (1, 1, 7, "added", "proposed"),
        (1, 2, 5, "revised", "rejected"), (1, 2, 5, "reviewed", "rejected"), (1, 2, 6, "added", "proposed"),
        (1, 3, 5, "removed", "rejected"), (1, 3, 6, "removed", "proposed"), (1, 3, 7, "removed", "proposed"), (2, 2, 5, "removed", None),
    ], key=str)


def test_series_close_and_leave_no_state(spark):
    schema = "series_uid long, position long, arrived timestamp"
    at = lambda month, day: __import__("datetime").datetime(2024, month, day)
    batches = [[(1, 0, at(1, 1)), (1, 1, at(1, 1)), (2, 0, at(1, 1)), (2, 0, at(1, 1)), (2, 1, at(1, 1))], [(1, 0, at(1, 1)), (1, 1, at(1, 1))], [(9, 0, at(1, 20))], [(2, 1, at(1, 20)), (3, 0, at(1, 20))], [(9, 0, at(12, 1))]]
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    from lumivox.plans.scratch import scratch_path

    source, folder = scratch_path(spark, "source"), scratch_path(spark, "told")
    sizes = []
    for frame in frames:
        frame.write.mode("append").parquet(source)
        stream = feeds.arrivals(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/batch={n}")).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    # of series 2 a slice came when it was closed; the last session of series 9 is open still
    told = spark.read.schema(stream.schema).parquet(folder).select(*stream.columns)
    assert told.count() == 5
    assert sorted(map(tuple, feeds.completeness(told).collect())) == [(1, 4, 2, 2, True, 0), (2, 3, 2, 2, False, 1), (3, 1, 1, 1, True, 0), (9, 1, 1, 1, True, 0)]
    assert sizes[-1] < max(sizes)  # series that were closed long ago are gone


def test_a_label_map_waits_one_poll_for_its_metadata(spark):
    polls = [(1, n, labels, metadata) for n, (labels, metadata) in enumerate([(1, 1), (2, 1), (2, 2), (3, 2), (3, 2), (3, 2), (4, 3), (4, 4)])]
    got = streamed(spark, [polls[:2], polls[2:4], polls[4:]], "workspace long, poll long, labels long, metadata long", feeds.deferred_changes)
    assert [r[1:] for r in got] == [(2, "labels and metadata"), (4, "labels alone"), (6, "labels and metadata"), (7, "metadata")]


def test_the_last_good_state_is_kept(spark):
    rows = [(1, 1, 5), (1, 2, None), (1, 3, None), (1, 4, 6), (1, 5, None)]
    got = streamed(spark, [rows[:2], rows[2:3], rows[3:]], "source long, version long, value long", feeds.readable_states)
    assert got == [(1, 1, 5, "read"), (1, 2, 5, "rejected"), (1, 4, 6, "read"), (1, 5, 6, "rejected")]


def test_filters(spark):
    line = spark.createDataFrame([(1, i, 0, 0, float(i == 4)) for i in range(9)], "series_id long, i int, j int, k int, value double")
    smooth = {r["i"]: r["smooth"] for r in X.gaussian_smooth(line, 1.0).collect()}
    assert sum(smooth.values()) == pytest.approx(1, abs=1e-2) and smooth[4] == max(smooth.values()) and smooth[3] == pytest.approx(smooth[5])
    ramp = spark.createDataFrame([(1, i, j, k, float(i)) for i in range(5) for j in range(4) for k in range(4)], "series_id long, i int, j int, k int, value double")
    edge = {r["i"]: r["edge"] for r in X.sobel(ramp).collect()}
    assert edge[2] == 1.0 and edge[0] == pytest.approx(0.5)


def test_box_union_of_empty_boxes(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 5, 0, 5), (1, 2, 4, 1, 3, 0, 9), (2, 3, 3, 0, 1, 0, 1)], "key long, i0 int, i1 int, j0 int, j1 int, k0 int, k1 int")
    assert sorted(map(tuple, M.box_union(boxes, ["key"]).collect())) == [(1, 2, 4, 1, 3, 0, 9), (2, 0, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize("diagonal", [True, False])
def test_pieces_over_several_bricks(spark, diagonal):
    rng = np.random.default_rng(6)
    cells = {(int(i), int(j), int(k)) for i, j, k in zip(rng.integers(-2, 9, 5200), rng.integers(50, 145, 5200), rng.integers(60, 70, 5200))} | {(20, j, 5) for j in range(400)}
    near = M.AROUND if diagonal else M.FACES
    left, pieces = set(cells), []
    while left:
        stack, piece = [left.pop()], set()
        while stack:
            c = stack.pop()
            piece.add(c)
            for o in near:
                n = tuple(x + y for x, y in zip(c, o))
                if n in left:
                    left.remove(n)
                    stack.append(n)
        pieces.append(piece)
    got = {}
    for r in N.label_components(mask(spark, sorted(cells)), diagonal).collect():
        got.setdefault(r["piece"], set()).add((r["i"], r["j"], r["k"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, pieces))


def test_opening_at_a_seed(spark):
    boxes = [(i, j, k) for i in (*range(5), *range(9, 14)) for j in range(5) for k in range(5)] + [(i, 2, 2) for i in range(5, 9)]
    seeds = spark.createDataFrame([(1, 1, 13, 2, 2)], MASK)
    assert {r["i"] for r in N.opening(mask(spark, boxes), (1.0, 1.0, 1.0), 2.0, seeds).collect()} >= set(range(9, 14))
    assert min(r["i"] for r in N.opening(mask(spark, boxes), (1.0, 1.0, 1.0), 2.0, seeds).collect()) >= 8
