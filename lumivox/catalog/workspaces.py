"""Series, reviews, annotations and texts: SRC6, SET5, SET6, WIN1 to WIN6, WIN13, WIN14, STR3, STR4, GEO1, GEO3, GEO5, PRJ13 to PRJ23, PIP."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox.catalog.intensity import _rounded
from lumivox.catalog.segments import _long
from lumivox.functions import text as T
from lumivox.operators import annotations as A
from lumivox.operators import reviews as R
from lumivox.operators import series as S
from lumivox.plans.scratch import scratch_path
from lumivox.sources import cohort as C


def _ordered(s, d):
    return S.order_by_position(C.headers(s, d).distinct())


def _edits(s, d):
    return C.table(s, d, "lineitem").selectExpr("CAST(l_suppkey AS BIGINT) AS series_id", "CAST(l_partkey % 300 AS BIGINT) AS vox", "CAST(l_orderkey AS BIGINT) AS version", "CAST(l_linenumber % 4 AS BIGINT) AS label")


def _catalogue(s, d):
    v = S.volumes(_ordered(s, d))
    g = S.gaps(_ordered(s, d))
    return v.groupBy("series_uid").agg(F.count("*").alias("volumes"), F.count(F.when(F.col("complete"), 1)).alias("complete")).join(g.select("series_uid", "positions", "irregular"), "series_uid").withColumn("series", T.pseudonym("salt", F.col("series_uid").cast("string"))).drop("series_uid")


def _people(s, d):
    c = C.table(s, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).when(F.col("c_custkey") % 11 == 0, F.concat("c_name", F.lit("\t"), F.lit("x"))).when(F.col("c_custkey") % 13 == 0, F.lit("")).otherwise(F.col("c_name"))
    k = F.col("c_custkey")
    digest = F.upper(F.sha2("c_name", 256))
    digest = F.when(k % 5 == 0, F.concat(F.lit("x"), F.substring(digest, 2, 63))).when(k % 5 == 1, F.substring(digest, 1, 63)).when(k % 5 == 2, F.concat(digest, F.lit("\n"))).otherwise(digest)
    return c.select("c_custkey", T.checked_person(name).alias("person"), T.checked_hash(digest).alias("shown_sha256"))


_KEY_PARTS = ["", "-e2", "-Smith", "-a3", "-te80.5", "-tr40", "-iso1", "-ex", "-n2", "-", "-abcd1", "-t1.2.3", "-b1234567890123", "-te.5", "-x", "-isox", "-t5x", "-a1" * 20, "-a1" * 21, "-1", "-e 1", "-B1"]


def _keys(s, d):
    more = F.element_at(F.array(*map(F.lit, _KEY_PARTS)), (F.col("l_suppkey") % len(_KEY_PARTS) + 1).cast("int"))
    key = F.when(F.col("l_partkey") % 41 > 0, F.concat(F.lit("b"), F.col("l_partkey") % 3 * 500, more))
    return C.table(s, d, "lineitem").select(T.checked_volume_key(key).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _numbers(s, d):
    t = F.concat(F.lit("size "), F.col("l_quantity").cast("long"), F.lit(".5 mm, 1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(" of -"), F.col("l_linenumber"), F.lit(", "), F.col("l_suppkey") % 20, F.lit("-"), F.col("l_partkey") % 20, F.lit(" --7. -.5 - 1.2.3"))
    return C.table(s, d, "lineitem").select(t.alias("text")).distinct().select("text", F.posexplode(T.numbers(F.col("text"))).alias("place", "number")).select("text", F.col("place").cast("long").alias("place"), "number")


def _transcripts(s, d):
    """An answer an assistant's turn with a number and mostly its unit, and the calls it was made with; half of the results hold other numbers."""
    c = C.table(s, d, "conversations").where("role = 'assistant'")
    n, got = F.col("conv_id"), F.col("conv_id") * 0.5
    answer = F.concat("text", F.lit(" The length is "), got.cast("decimal(20,1)"), F.when(n % 3 == 0, F.lit(" mm")).otherwise(F.lit("")), F.when(F.col("turn") % 5 == 1, F.lit(" a malignant lesion")).otherwise(F.lit("")), F.when(n % 4 == 1, F.lit(", please confirm")).otherwise(F.lit("")))
    result = F.concat(F.lit('{"note7": "12 of 99", "points": [[1, {"mm": '), (got + F.when(n % 2 == 0, 0.0).otherwise(3.0)).cast("decimal(20,1)"), F.lit("}]]}"))
    calls = F.array(F.struct(F.when(n % 6 < 4, "measure distance").otherwise("probe").alias("command"), result.alias("result")))
    return c.select("conv_id", "turn", answer.alias("answer"), calls.alias("calls"), F.array(got).alias("expected"), F.lit(0.05).alias("tolerance"), F.when(n % 5 > 0, "mm").alias("unit"), (n % 2 == 1).alias("proposes"), F.array(F.lit("measure distance")).alias("requires"))


def _grade(s, d):
    return T.grade(_transcripts(s, d)).select("conv_id", "turn", "right", "unit_said", "traced", "clean", "review", "tools", "passed")


_CODES = ["CT", " ct ", "mr", "", "   ", "C T", "ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQ", "Pt1", "C\u00e9", "CT-1"]


def _units(s, d):
    """The code that each order declares, the unit of its values, and why features that need a unit are refused."""
    told = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("o_orderkey") % len(_CODES) + 1).cast("int"))
    code = F.upper(T.checked_code(told))
    reason = F.when(F.col("modality").isNull(), "not a modality code").when(F.col("modality") != "CT", "needs a known unit")
    return C.table(s, d, "orders").select("o_orderkey", code.alias("modality")).select("o_orderkey", "modality", F.when(F.col("modality") == "CT", "HU").when(F.col("modality").isNotNull(), "unknown").alias("unit"), reason.alias("reason"))


def _redacted(s, d):
    """What a study's identification may say outside: identifiers as pseudonyms where they are asked to be (empty ones stay empty), dates and accession numbers only where they are allowed."""
    k = F.col("o_orderkey")
    uid = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("1.2.840."), k))
    shared = F.when((uid != "") & (k % 7 > 0), T.pseudonym("pepper", uid)).otherwise(uid)
    return C.table(s, d, "orders").select("o_orderkey", shared.alias("study_uid"), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("date"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("accession"))


def _stale(s, d):
    return C.audit(s, d).withColumn("stale", F.when(F.col("event_id") % 4 == 0, 1).otherwise(0))


def _state_at(s, d):
    """Each series with its newest three edits undone, or at its middle edit where more are asked for than it has."""
    e = _edits(s, d)
    middle = e.groupBy("series_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY version)").cast("long").alias("version"))
    undone = R.undo(e, 3)
    versions = middle.where("series_id % 2 = 0").unionByName(undone.where("series_id % 2 = 1"))
    return R.state_at(e, versions)


def _pending(s, d):
    """What waits for review in each workspace: annotations and segments, by who made them."""
    a = C.annotations(s, d).select("workspace", F.lit("annotation").alias("kind"), "status", "author")
    g = C.mask(s, d).select("series_id", "label").distinct().select((F.col("series_id") % 50).alias("workspace"), F.lit("segment").alias("kind"), F.when((F.col("series_id") + F.col("label")) % 3 == 0, "confirmed").otherwise("proposed").alias("status"), F.when(F.col("label") == 1, "agent").otherwise("human").alias("author"))
    pending = F.col("status") == "proposed"
    return a.unionByName(g).groupBy("workspace", "kind").agg(F.count(F.when(pending, 1)).alias("pending"), F.count(F.when(pending & (F.col("author") == "agent"), 1)).alias("by_agents"), F.count("*").alias("items"))


def _asked(s, d):
    """A request an order: new annotations with two to four points, names for old ones, and deletions."""
    a = C.annotations(s, d).withColumn("name", F.concat_ws(" ", "kind", "id"))
    n = F.col("id")
    known = F.element_at(F.array(*map(F.lit, ["Distance", "Angle", "Area", "Rectangle", "Text", "Circle"])), (n % 6 + 1).cast("int"))
    requests = a.select((n + F.when(n % 3 == 0, 10_000_000).otherwise(0)).alias("id"), F.when(n % 3 < 2, "add").when(n % 2 == 0, "rename").otherwise("delete").alias("asked"), known.alias("kind"),
        F.slice("points", 1, (n % 4 + 1).cast("int")).alias("points"), F.when(n % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("slices"), F.concat(F.lit("new "), n).alias("new_name"))
    return A.asked_change(a, requests)


def _in_space(s, d):
    """Measures of one to four points in the space of a series, turned grids among them."""
    n = F.col("id")
    turned = F.array(*[F.array(*[F.lit(float(x)) for x in axis]) for axis in ((0, 1, 0), (0, 0, 1), (1, 0, 0))])
    straight = F.array(*[F.array(*[F.lit(float(x)) for x in axis]) for axis in ((1, 0, 0), (0, 0.6, 0.8), (0, -0.8, 0.6))])
    lifted = F.transform(A.voxel_points(), lambda p, i: F.array(F.get(p, 0), F.get(p, 1), F.get(p, 2) + i % 2 * 1.5))
    points = F.when(n % 13 == 0, F.array_repeat(F.get(lifted, 0), 3)).otherwise(F.slice(lifted, 1, F.when(n % 11 == 0, 1 + n % 4).when(F.col("kind") == "Distance", 2).when(F.col("kind") == "Angle", 3).otherwise(4).cast("int")))
    a = C.annotations(s, d).where("kind IN ('Distance', 'Angle', 'Area')")
    measures = a.select("id", "kind", points.alias("voxels"), F.array(F.lit(-20.0), F.lit(5.5), n % 100 * 1.0).alias("origin"), F.when(n % 2 == 0, turned).otherwise(straight).alias("axes"), F.array(F.lit(0.75), F.lit(1.0), 1.5 + n % 4).alias("spacing"))
    return _rounded(A.in_space(measures), 4)


def _report(s, d):
    """The report's rows, written as JSON and read back, with points as text."""
    n = F.col("workspace")
    spacing = F.array(0.7 + n / 300, F.lit(1.0), 2 + n / 700)
    rows = A.report(C.annotations(s, d).withColumn("spacing", spacing))
    back = F.from_json("row", "id long, name string, kind string, plane string, slice_index long, slice_number long, value double, unit string, points_mm array<array<double>>, points_voxel array<array<double>>, spacing_mm array<double>, confirmed boolean")
    flat = lambda c: F.array_join(F.transform(F.flatten(c), lambda x: F.format_string("%.3f", x)), " ")
    told = rows.select("workspace", back.alias("r")).select("workspace", "r.*")
    return told.withColumn("points_mm", flat("points_mm")).withColumn("points_voxel", flat("points_voxel")).withColumn("spacing_mm", F.array_join(F.transform("spacing_mm", lambda x: F.format_string("%.6f", x)), " "))


def _privacy(s, d):
    secrets = C.table(s, d, "benchmark").select(F.col("item_id").cast("long").alias("secret_id"), F.col("text").alias("secret")).where("length(secret) >= 12")
    return T.find_secrets(C.table(s, d, "documents").select("doc_id", "text"), secrets).select("doc_id", "secret_id")


def _scanned_outputs(s, d):
    """Tables, an export as JSON lines and a log that is read as text, each with rows that some name or benchmark text has got into."""
    names = C.table(s, d, "customer").orderBy("c_custkey").limit(20)  # the names to look for are a given list
    snippets = C.table(s, d, "benchmark").where("length(text) >= 12").select((F.col("item_id") + 1_000_000).cast("long").alias("secret_id"), F.col("text").alias("secret"))
    secrets = names.select(F.col("c_custkey").cast("long").alias("secret_id"), F.col("c_name").alias("secret")).unionByName(snippets)
    c = C.table(s, d, "customer").select("c_custkey", "c_name", T.pseudonym("pepper", F.col("c_name")).alias("pseudonym"))
    k = F.col("c_custkey")
    export, log = scratch_path(s, "export"), scratch_path(s, "log")
    c.select("c_custkey", F.struct(F.when(k % 5 == 0, F.col("c_name")).otherwise(F.col("pseudonym")).alias("by"), F.array(F.lit('a "quoted" one'), F.when(k % 7 == 0, F.concat(F.lit("seen by "), "c_name"))).alias("notes")).alias("provenance")).write.json(export)
    c.select(F.concat(F.lit("entry "), k, F.lit(" of "), F.when(k % 3 == 0, F.col("c_name")).otherwise(F.col("pseudonym")))).write.text(log)
    shape = "c_custkey long, provenance struct<by: string, notes: array<string>>"
    outputs = {"pseudonyms": c.select("c_custkey", "pseudonym"), "export": s.read.schema(shape).json(export), "log": s.read.text(log), "documents": C.table(s, d, "documents").select("doc_id", "text", "source"), "pages": C.table(s, d, "pages").select("url", "html")}
    return T.scan(outputs, secrets)


QUERIES = {
    "src06_header_fallbacks": lambda s, d: S.with_fallbacks(C.headers(s, d)),
    "set06_distinct_series": lambda s, d: S.series_keys(C.headers(s, d)),
    "win01_win02_slice_order": lambda s, d: _long(_ordered(s, d).select("series_uid", "path", "position", "rank")),
    "win03_gaps": lambda s, d: _rounded(S.gaps(_ordered(s, d))),
    "win04_fallback_order": lambda s, d: _long(S.order_without_positions(C.headers(s, d).distinct())),
    "win05_win06_volumes": lambda s, d: S.volumes(_ordered(s, d)),
    "pip01_catalogue": _catalogue,
    "win13_latest_reviews": lambda s, d: R.latest_reviews(C.audit(s, d)),
    "win14_state_at_version": _state_at,
    "str03_pip11_decisions": lambda s, d: R.first_valid_decisions(_stale(s, d)),
    "str04_command_counts": lambda s, d: R.command_counts(C.audit(s, d)),
    "set05_changes": lambda s, d: R.changes(R.snapshot(C.audit(s, d), "2024-01-15"), R.snapshot(C.audit(s, d), "2025-01-01")),
    "top08_last_entries": lambda s, d: R.last_entries(C.audit(s, d), 5, 100),
    "geo01_geo03_measurements": lambda s, d: _rounded(A.values(C.annotations(s, d)), 4),
    "geo01_patient_measures": _in_space,
    "geo05_nearest_annotation": lambda s, d: _rounded(A.nearest(C.annotations(s, d), 30.0, 30.0, 12.0), 4),
    "agg33_pip10_pending": _pending,
    "prj16_changeable": lambda s, d: C.annotations(s, d).select("id", A.changeable().alias("changeable"), A.refusal().alias("reason")),
    "pip12_default_names": lambda s, d: A.default_names(C.annotations(s, d)),
    "pip12_asked_changes": _asked,
    "snk02_report_rows": _report,
    "prj13_pseudonym": lambda s, d: C.table(s, d, "customer").select("c_custkey", T.pseudonym("pepper", F.col("c_name")).alias("pseudonym")),
    "prj15_redaction": _redacted,
    "prj17_value_unit": _units,
    "prj18_named_side": lambda s, d: C.table(s, d, "part").select(F.concat_ws(" ", "p_name", F.element_at(F.array(F.lit("left"), F.lit("Right kidney"), F.lit("leftover"), F.lit("left and right")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("name")).distinct().select("name", T.named_side(F.col("name")).alias("side")),
    "prj19_timestamps": lambda s, d: C.audit(s, d).select("event_id", T.to_rfc3339(F.col("time")).alias("text"), T.from_rfc3339(T.to_rfc3339(F.col("time"))).alias("parsed")),
    "prj20_numbers_in_text": _numbers,
    "prj22_volume_keys": _keys,
    "prj23_people": _people,
    "pip14_privacy_scan": _privacy,
    "pip14_outputs": _scanned_outputs,
    "pip15_transcript_grades": _grade,
}

_H = f"WITH {C.HEADERS_SQL}, h AS (SELECT DISTINCT * FROM headers)"
_STACK = "temporal_position NULLS LAST, echo_number NULLS LAST, echo_time NULLS LAST, b_value NULLS LAST, acquisition_number NULLS LAST, trigger_time NULLS LAST, frame_reference_time NULLS LAST, isotropic NULLS FIRST, instance_number NULLS LAST, path"
_O = f"""{_H}, zs AS (SELECT series_uid, list_reduce(list_transform(list_sort(list(DISTINCT z)), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] < 1e-4 THEN a ELSE list_concat(a, x) END) AS firsts FROM h WHERE z IS NOT NULL GROUP BY 1),
    q AS (SELECT h.*, CAST(len(list_filter(firsts, lambda x: x <= h.z)) - 1 AS BIGINT) AS position FROM h JOIN zs ON zs.series_uid = h.series_uid WHERE z IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY series_uid, position ORDER BY {_STACK}) AS rank FROM q)"""
_GAPS = """a AS (SELECT series_uid, position, min(z) AS z, count(*) AS images FROM o GROUP BY ALL), g AS (SELECT *, z - lag(z) OVER (PARTITION BY series_uid ORDER BY position) AS gap FROM a),
    m AS (SELECT series_uid, count(*) AS positions, min(images) AS fewest, max(images) AS most, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps FROM g GROUP BY 1),
    n AS (SELECT *, gaps[len(gaps) // 2 + 1] AS median FROM m),
    r AS (SELECT series_uid, positions, fewest, most, round(median, 6) AS median, coalesce(len(list_filter(gaps, lambda x: abs(x - median) > greatest(0.01, median * 0.02))) > 0, false) AS irregular FROM n)"""
_KINDS = {
    "c": "CASE WHEN component IS NULL THEN NULL WHEN upper(component) = 'MAGNITUDE' THEN 0 WHEN upper(component) = 'PHASE' THEN 1 ELSE 5 END", "t": "temporal_position", "e": "echo_number", "te": "echo_time", "b": "b_value",
    "tr": "trigger_time", "f": "frame_reference_time", "a": "acquisition_number", "iso": "CAST(isotropic AS INTEGER)",
}
_VOL = f"""w AS (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS v_{k}' for k, e in _KINDS.items())} FROM o),
    d0 AS (SELECT series_uid, position, count(*) AS n, {', '.join(f"count(DISTINCT coalesce(CAST(v_{k} AS VARCHAR), 'none')) > 1 AS d_{k}" for k in _KINDS)} FROM w GROUP BY ALL),
    d AS (SELECT series_uid, count(*) AS positions, max(n) AS most, {', '.join(f'bool_or(d_{k}) AS d_{k}' for k in _KINDS)} FROM d0 GROUP BY 1),
    k AS (SELECT w.*, positions, most, concat_ws('-', {', '.join(f"CASE WHEN d_{k} THEN '{k}' || coalesce(CASE WHEN v_{k} = floor(v_{k}) THEN CAST(CAST(v_{k} AS BIGINT) AS VARCHAR) ELSE CAST(v_{k} AS VARCHAR) END, 'x') END" for k in _KINDS)}) AS key FROM w JOIN d ON w.series_uid = d.series_uid),
    n0 AS (SELECT *, row_number() OVER (PARTITION BY series_uid, key, position ORDER BY {_STACK}) AS nth FROM k),
    s0 AS (SELECT series_uid, key, nth, count(*) AS images, any_value(positions) AS positions, any_value(most) AS most FROM n0 GROUP BY series_uid, key, nth),
    vol AS (SELECT series_uid, CASE WHEN most = 1 THEN 'all' WHEN key = '' THEN 'n' || nth WHEN max(nth) OVER (PARTITION BY series_uid, key) > 1 THEN key || '-n' || nth ELSE key END AS volume, images, images = positions AS complete FROM s0)"""
_A = f"WITH {C.AUDIT_SQL}"
_N = f"WITH {C.ANNOTATIONS_SQL}"
_SNAP = lambda name, until: f"{name} AS (SELECT workspace, item, count(*) FILTER (WHERE command IN ('segment edit', 'annotate add')) AS edits, max(CASE WHEN ok AND starts_with(command, 'review') THEN command END) AS review FROM audit WHERE time < TIMESTAMP '{until}' GROUP BY ALL HAVING edits > 0)"
_VALUE = """CASE kind WHEN 'Distance' THEN sqrt((x2-x1)**2+(y2-y1)**2)
    WHEN 'Angle' THEN CASE WHEN ((x1-x2)**2+(y1-y2)**2)*((x3-x2)**2+(y3-y2)**2) > 0 THEN degrees(acos(least(greatest(((x1-x2)*(x3-x2)+(y1-y2)*(y3-y2))/sqrt(((x1-x2)**2+(y1-y2)**2)*((x3-x2)**2+(y3-y2)**2)), -1), 1))) END
    WHEN 'Area' THEN abs(x1*y2-x2*y1+x2*y3-x3*y2+x3*y4-x4*y3+x4*y1-x1*y4)/2 WHEN 'Rectangle' THEN abs((x2-x1)*(y2-y1)) END"""
_VOXEL_POINTS = "list_transform([[x1, y1], [x2, y2], [x3, y3], [x4, y4]], lambda q: CASE plane WHEN 'axial' THEN [q[1], q[2], slice_index] WHEN 'coronal' THEN [q[1], slice_index, 11 - q[2]] ELSE [slice_index, q[1], 11 - q[2]] END)"
_UNIT = "CASE kind WHEN 'Distance' THEN 'mm' WHEN 'Angle' THEN 'deg' WHEN 'Text' THEN NULL ELSE 'mm2' END"
_SEG = lambda a, b: f"sqrt((30 - (x{a} + t{a}{b}*(x{b}-x{a})))**2 + (30 - (y{a} + t{a}{b}*(y{b}-y{a})))**2)"
_T = lambda a, b: f"CASE WHEN (x{b}-x{a})**2+(y{b}-y{a})**2 > 0 THEN least(greatest(((30-x{a})*(x{b}-x{a})+(30-y{a})*(y{b}-y{a}))/((x{b}-x{a})**2+(y{b}-y{a})**2), 0), 1) ELSE 0 END AS t{a}{b}"

def _numbers_sql(text: str) -> str:
    """The numbers of a text, read character by character: what is read so far, with a blank behind each number that has ended."""
    step = "CASE WHEN x[1] BETWEEN '0' AND '9' OR (x[1] = '.' AND regexp_matches(a, '[^ ]$') AND NOT regexp_matches(a, '[.][^ ]*$')) OR (x[1] = '-' AND NOT regexp_matches(a, '[^ ]$')) THEN a || x ELSE a || ' ' END"
    read = f"list_reduce(list_prepend('', string_split({text}, '')), lambda a, x: {step})"
    return f"list_filter(list_transform(string_split({read}, ' '), lambda x: TRY_CAST(rtrim(x, '.') AS DOUBLE)), lambda x: x IS NOT NULL)"


ORACLE_SQL = {
    "src06_header_fallbacks": f"WITH {C.HEADERS_SQL} SELECT series_uid, path, coalesce(pixel_spacing, imager_spacing, group_spacing, 1.0) AS spacing, CASE WHEN window_center IS NOT NULL AND window_width > 0 THEN window_center END AS center, CASE WHEN window_center IS NOT NULL AND window_width > 0 THEN window_width END AS width, CASE WHEN photometric = 'MONOCHROME1' THEN 'inverted' WHEN photometric = 'MONOCHROME2' OR photometric IS NULL THEN 'grey' ELSE 'colour' END AS reading FROM headers",
    "set06_distinct_series": f"WITH {C.HEADERS_SQL} SELECT series_uid, matrix, CAST(round(tilt * 1000) AS BIGINT) AS tilt_key, count(*) AS images FROM headers GROUP BY ALL",
    "win01_win02_slice_order": f"{_O} SELECT series_uid, path, position, rank FROM o",
    "win03_gaps": f"{_O}, {_GAPS} SELECT * FROM r",
    "win04_fallback_order": f"""{_H}, l AS (SELECT *, bool_or(z IS NULL) OVER w AS lost, max(z) OVER w - min(z) OVER w < 1e-4 AND count(*) OVER w > 1 AS one, bool_and(instance_number IS NOT NULL) OVER w AS numbered, bool_and(slice_location IS NOT NULL) OVER w AS located FROM h WINDOW w AS (PARTITION BY series_uid)),
        m AS (SELECT *, CASE WHEN numbered THEN 'Instance Number' WHEN located THEN 'Slice Location' ELSE 'file order' END AS method, CASE WHEN numbered THEN CAST(instance_number AS DOUBLE) WHEN located THEN slice_location ELSE 0 END AS key FROM l WHERE lost OR one),
        p AS (SELECT *, row_number() OVER (PARTITION BY series_uid ORDER BY key, path) AS place, key - lag(key) OVER (PARTITION BY series_uid ORDER BY key, path) AS gap FROM m),
        g AS (SELECT series_uid, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL AND method = 'Slice Location')) AS gaps, arg_min(coalesce(spacing_between_slices, slice_thickness), path) FILTER (WHERE coalesce(spacing_between_slices, slice_thickness) IS NOT NULL) AS field FROM p GROUP BY 1)
        SELECT p.series_uid, path, place, method, CASE WHEN gaps[len(gaps) // 2 + 1] > 1e-4 THEN gaps[len(gaps) // 2 + 1] ELSE coalesce(field, 1.0) END AS spacing, one AND NOT lost AS stacked FROM p JOIN g ON g.series_uid = p.series_uid""",
    "win05_win06_volumes": f"{_O}, {_VOL} SELECT * FROM vol",
    "pip01_catalogue": f"{_O}, {_GAPS}, {_VOL} SELECT count(*) AS volumes, count(*) FILTER (WHERE complete) AS complete, any_value(positions) AS positions, any_value(irregular) AS irregular, 'anon-' || substr(sha256('salt' || chr(0) || CAST(vol.series_uid AS VARCHAR)), 1, 16) AS series FROM vol JOIN r ON r.series_uid = vol.series_uid GROUP BY vol.series_uid",
    "win13_latest_reviews": f"{_A} SELECT workspace, item, CASE WHEN NOT ok THEN 'proposed' WHEN command = 'review confirm' THEN 'confirmed' ELSE 'rejected' END AS status, CASE WHEN ok THEN time END AS reviewed FROM audit WHERE starts_with(command, 'review ') QUALIFY row_number() OVER (PARTITION BY workspace, item ORDER BY time DESC, event_id DESC) = 1",
    "win14_state_at_version": """WITH e AS (SELECT CAST(l_suppkey AS BIGINT) AS series_id, CAST(l_partkey % 300 AS BIGINT) AS vox, CAST(l_orderkey AS BIGINT) AS version, CAST(l_linenumber % 4 AS BIGINT) AS label FROM lineitem),
        u AS (SELECT series_id, quantile_disc(version, 0.5) AS until FROM e WHERE series_id % 2 = 0 GROUP BY 1 UNION ALL SELECT series_id, list_sort(list(DISTINCT version), 'DESC')[4] FROM e WHERE series_id % 2 = 1 GROUP BY 1),
        r AS (SELECT e.* FROM e JOIN u ON u.series_id = e.series_id AND version <= until QUALIFY row_number() OVER (PARTITION BY e.series_id, vox ORDER BY version DESC, label DESC) = 1) SELECT series_id, vox, label FROM r WHERE label > 0""",
    "str03_pip11_decisions": f"""{_A}, n AS (SELECT *, coalesce(count(*) FILTER (WHERE command IN ('segment edit', 'annotate add')) OVER (PARTITION BY workspace, item ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS now FROM audit),
        d AS (SELECT *, greatest(0, now - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS seen FROM n WHERE starts_with(command, 'review ')),
        v AS (SELECT *, coalesce(max(CAST(ok AND seen = now AS INT)) OVER (PARTITION BY workspace, item ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS decided FROM d)
        SELECT event_id, workspace, item, command, CASE WHEN seen <> now THEN 'stale' WHEN decided THEN 'decided' WHEN ok THEN 'accepted' ELSE 'failed' END AS verdict, sha256(workspace || '/' || item || '/' || seen) AS seen_revision, sha256(workspace || '/' || item || '/' || now) AS now_revision FROM v""",
    "str04_command_counts": f"{_A} SELECT time_bucket(INTERVAL 1 DAY, time) AS start, command, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failed FROM audit GROUP BY ALL",
    "set05_changes": f"{_A}, {_SNAP('a', '2024-01-15')}, {_SNAP('b', '2025-01-01')}, u AS (SELECT coalesce(a.workspace, b.workspace) AS workspace, coalesce(a.item, b.item) AS item, a.edits AS ea, b.edits AS eb, a.review AS ra, b.review AS rb FROM a FULL JOIN b ON a.workspace = b.workspace AND a.item = b.item) SELECT workspace, item, 'added' AS change FROM u WHERE ea IS NULL UNION ALL SELECT workspace, item, 'removed' FROM u WHERE eb IS NULL UNION ALL SELECT workspace, item, 'revised' FROM u WHERE ea <> eb UNION ALL SELECT workspace, item, 'reviewed' FROM u WHERE ea IS NOT NULL AND eb IS NOT NULL AND ra IS DISTINCT FROM rb",
    "top08_last_entries": f"{_A} SELECT workspace, event_id, command, greatest(0, count(*) OVER (PARTITION BY workspace) - 5) AS dropped FROM audit WHERE event_id > 100 QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY event_id DESC) <= 5",
    "geo01_geo03_measurements": f"{_N} SELECT id, kind, round({_VALUE}, 4) AS value, {_UNIT} AS unit FROM annotations",
    "geo01_patient_measures": f"""{_N}, p0 AS (SELECT id, kind, {_VOXEL_POINTS} AS p FROM annotations WHERE kind IN ('Distance', 'Angle', 'Area')), p1 AS (SELECT id, kind, [[p[n + 1][1], p[n + 1][2], p[n + 1][3] + n % 2 * 1.5::DOUBLE] for n in range(4)] AS p FROM p0),
        p2 AS (SELECT id, kind, CASE WHEN id % 13 = 0 THEN [p[1], p[1], p[1]] WHEN id % 11 = 0 THEN p[1 : 1 + id % 4] WHEN kind = 'Distance' THEN p[1:2] WHEN kind = 'Angle' THEN p[1:3] ELSE p END AS p, [0.75::DOUBLE, 1::DOUBLE, 1.5::DOUBLE + id % 4] AS s FROM p1),
        g AS (SELECT id, kind, s, list_transform(p, lambda q: [q[1] * s[1], q[2] * s[2], q[3] * s[3]]) AS p FROM p2), m AS (SELECT id, kind, s, list_transform(p, lambda q: CASE WHEN id % 2 = 0 THEN [q[3] - 20, q[1] + 5.5::DOUBLE, q[2] + id % 100] ELSE [q[1] - 20, 5.5::DOUBLE + 0.6::DOUBLE * q[2] - 0.8::DOUBLE * q[3], id % 100 + 0.8::DOUBLE * q[2] + 0.6::DOUBLE * q[3]] END) AS p FROM g),
        c AS (SELECT *, len(p) AS n, list_distance(p[1], p[2]) AS d, list_distance(p[1], p[2]) * list_distance(p[3], p[2]) AS arms, CASE WHEN len(p) > 2 THEN list_dot_product([p[1][x] - p[2][x] for x in [1, 2, 3]], [coalesce(p[3][x], 0) - p[2][x] for x in [1, 2, 3]]) END AS dot,
            [list_sum([p[a + 1][x % 3 + 1] * p[(a + 1) % len(p) + 1][(x + 1) % 3 + 1] - p[a + 1][(x + 1) % 3 + 1] * p[(a + 1) % len(p) + 1][x % 3 + 1] for a in range(len(p))]) for x in [1, 2, 3]] AS crs FROM m),
        r AS (SELECT *, CASE WHEN kind = 'Distance' AND n <> 2 THEN 'a distance needs 2 points, got ' || n WHEN kind = 'Angle' AND n <> 3 THEN 'an angle needs 3 points, got ' || n WHEN kind = 'Area' AND n < 3 THEN 'an area needs at least 3 points, got ' || n WHEN kind = 'Angle' AND arms = 0 THEN 'the arms of the angle must have length' END AS reason FROM c)
        SELECT id, round(CASE WHEN reason IS NOT NULL THEN NULL WHEN kind = 'Distance' THEN d WHEN kind = 'Angle' THEN degrees(acos(least(greatest(dot / CASE WHEN arms > 0 THEN arms END, -1), 1))) ELSE sqrt(list_dot_product(crs, crs)) / 2 END, 4) AS value,
        CASE WHEN reason IS NULL THEN {_UNIT} END AS unit, CASE WHEN reason IS NULL AND kind = 'Distance' THEN round(list_max(s), 3) END AS uncertainty_mm, reason FROM r""",
    "geo05_nearest_annotation": f"{_N}, t AS (SELECT *, {_T(1, 2)}, {_T(2, 3)}, {_T(3, 4)} FROM annotations), m AS (SELECT workspace, slice_index, id, least({_SEG(1, 2)}, {_SEG(2, 3)}, {_SEG(3, 4)}) AS mm FROM t) SELECT workspace, slice_index, id, round(mm, 4) AS mm FROM m WHERE mm <= 12 QUALIFY row_number() OVER (PARTITION BY workspace, slice_index ORDER BY mm, id) = 1",
    "agg33_pip10_pending": f"""WITH {C.VOXELS_SQL}, {C.ANNOTATIONS_SQL}, u AS (SELECT workspace, 'annotation' AS kind, status, author FROM annotations UNION ALL SELECT series_id % 50, 'segment', CASE WHEN (series_id + label) % 3 = 0 THEN 'confirmed' ELSE 'proposed' END, CASE WHEN label = 1 THEN 'agent' ELSE 'human' END FROM (SELECT DISTINCT series_id, label FROM mask))
        SELECT workspace, kind, count(*) FILTER (WHERE status = 'proposed') AS pending, count(*) FILTER (WHERE status = 'proposed' AND author = 'agent') AS by_agents, count(*) AS items FROM u GROUP BY ALL""",
    "prj16_changeable": f"{_N} SELECT id, author = 'agent' AND status <> 'confirmed' AS changeable, CASE WHEN author <> 'agent' THEN 'made by a person' WHEN status = 'confirmed' THEN 'confirmed' END AS reason FROM annotations",
    "pip12_default_names": f"{_N} SELECT id, kind || ' ' || row_number() OVER (PARTITION BY workspace, kind ORDER BY id) AS name FROM annotations",
    "prj13_pseudonym": "SELECT c_custkey, 'anon-' || substr(sha256('pepper' || chr(0) || c_name), 1, 16) AS pseudonym FROM customer",
    "prj15_redaction": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 > 0 THEN 'anon-' || substr(sha256('pepper' || chr(0) || '1.2.840.' || o_orderkey), 1, 16) ELSE '1.2.840.' || o_orderkey END AS study_uid, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS accession FROM orders",
    "prj17_value_unit": f"""WITH t AS (SELECT o_orderkey, upper(trim({_CODES!r}[o_orderkey % {len(_CODES)} + 1])) AS m FROM orders), c AS (SELECT o_orderkey, CASE WHEN m <> '' AND strlen(m) <= 16 AND NOT regexp_matches(m, '[^0-9A-Z]') THEN m END AS modality FROM t)
        SELECT *, CASE WHEN modality = 'CT' THEN 'HU' WHEN modality IS NOT NULL THEN 'unknown' END AS unit, CASE WHEN modality IS NULL THEN 'not a modality code' WHEN modality <> 'CT' THEN 'needs a known unit' END AS reason FROM c""",
    "prj18_named_side": "WITH n AS (SELECT DISTINCT p_name || ' ' || ['left', 'Right kidney', 'leftover', 'left and right'][p_partkey % 4 + 1] AS name FROM part), w AS (SELECT name, regexp_split_to_array(lower(name), '[^a-z0-9]+') AS w FROM n) SELECT name, CASE WHEN list_contains(w, 'left') AND NOT list_contains(w, 'right') THEN 'left' WHEN list_contains(w, 'right') AND NOT list_contains(w, 'left') THEN 'right' END AS side FROM w",
    "prj19_timestamps": f"{_A} SELECT event_id, strftime(date_trunc('second', time), '%Y-%m-%dT%H:%M:%SZ') AS text, date_trunc('second', time) AS parsed FROM audit",
    "prj20_numbers_in_text": f"WITH t AS (SELECT DISTINCT 'size ' || CAST(l_quantity AS BIGINT) || '.5 mm, 1,' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ' of -' || l_linenumber || ', ' || l_suppkey % 20 || '-' || l_partkey % 20 || ' --7. -.5 - 1.2.3' AS text FROM lineitem), n AS (SELECT text, {_numbers_sql('text')} AS n FROM t) SELECT text, CAST(i AS BIGINT) AS place, n[i + 1] AS number FROM n, range(20) AS r(i) WHERE i < len(n)",
    "prj22_volume_keys": f"""WITH k AS (SELECT CASE WHEN l_partkey % 41 > 0 THEN 'b' || (l_partkey % 3 * 500) || {_KEY_PARTS!r}[l_suppkey % {len(_KEY_PARTS)} + 1] END AS k FROM lineitem), p AS (SELECT k, string_split(k, '-') AS p FROM (SELECT DISTINCT k FROM k)),
        d AS (SELECT k, len(k) BETWEEN 1 AND 64 AND len(list_filter(p, lambda x: NOT (regexp_full_match(x, '[a-z][a-z]?[a-z]?x') OR (len(regexp_extract(x, '^[a-z]*')) BETWEEN 1 AND 3 AND CASE WHEN contains(x, '.') THEN len(string_split(x, '.')) = 2 AND regexp_full_match(string_split(x, '.')[1], '[a-z]*[0-9]{{1,12}}') AND regexp_full_match(string_split(x, '.')[2], '[0-9]{{1,6}}') ELSE regexp_full_match(x, '[a-z]*[0-9]{{1,12}}') END)))) = 0 AS ok FROM p)
        SELECT CASE WHEN k.k IS NULL THEN NULL WHEN ok THEN k.k ELSE 'other' END AS key, count(*) AS n FROM k LEFT JOIN d ON d.k = k.k GROUP BY 1""",
    "prj23_people": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE c_name END AS person, CASE WHEN c_custkey % 5 > 2 THEN sha256(c_name) END AS shown_sha256 FROM customer",
    "pip14_outputs": """WITH z AS (SELECT CAST(c_custkey AS BIGINT) AS secret_id, c_name AS secret FROM customer ORDER BY c_custkey LIMIT 20), z2 AS (SELECT * FROM z UNION ALL SELECT CAST(item_id + 1000000 AS BIGINT), text FROM benchmark WHERE length(text) >= 12),
        o AS (SELECT 'export' AS source, 'provenance' AS "column", concat_ws(' ', CASE WHEN c_custkey % 5 = 0 THEN c_name END, CASE WHEN c_custkey % 7 = 0 THEN c_name END) AS text FROM customer UNION ALL SELECT 'log', 'value', CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END FROM customer
            UNION ALL SELECT 'documents', 'text', text FROM documents UNION ALL SELECT 'pages', 'html', html FROM pages)
        SELECT source, "column", secret_id, count(*) AS rows FROM o JOIN z2 ON contains(o.text, z2.secret) GROUP BY ALL""",
    "pip14_privacy_scan": "SELECT doc_id, CAST(item_id AS BIGINT) AS secret_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND length(b.text) >= 12",
    "pip12_asked_changes": f"""{_N}, q AS (SELECT id + CASE WHEN id % 3 = 0 THEN 10000000 ELSE 0 END AS id, CASE WHEN id % 3 < 2 THEN 'add' WHEN id % 2 = 0 THEN 'rename' ELSE 'delete' END AS asked, ['Distance', 'Angle', 'Area', 'Rectangle', 'Text', 'Circle'][id % 6 + 1] AS kind, id % 4 + 1 AS points, id % 7 = 0 AS apart, 'new ' || id AS new_name FROM annotations),
        j AS (SELECT q.*, a.id IS NOT NULL AS there, a.kind AS old_kind, a.kind || ' ' || a.id AS old_name, author, status FROM q LEFT JOIN annotations a ON a.id = q.id),
        r AS (SELECT *, CASE WHEN asked = 'add' THEN CASE WHEN there THEN 'there already' WHEN kind = 'Circle' THEN 'unknown kind' WHEN NOT CASE kind WHEN 'Angle' THEN points = 3 WHEN 'Area' THEN points >= 3 WHEN 'Text' THEN points = 1 ELSE points = 2 END THEN 'wrong number of points' WHEN apart THEN 'points on several slices' END
            ELSE CASE WHEN NOT there THEN 'not found' WHEN author <> 'agent' THEN 'made by a person' WHEN status = 'confirmed' THEN 'confirmed' END END AS reason FROM j)
        SELECT id, asked, reason, CASE WHEN asked = 'add' THEN kind ELSE old_kind END AS kind, CASE WHEN reason IS NULL AND asked = 'delete' THEN NULL WHEN reason IS NOT NULL THEN old_name ELSE new_name END AS name,
        CASE WHEN reason IS NULL THEN asked <> 'delete' WHEN there THEN true END AS kept FROM r""",
    "snk02_report_rows": f"""{_N} SELECT workspace, id, kind || ' ' || id AS name, kind, plane, slice_index, slice_index + 1 AS slice_number, round({_VALUE}, 3) AS value, {_UNIT} AS unit, status = 'confirmed' AS confirmed,
        printf('%.3f %.3f %.3f %.3f %.3f %.3f %.3f %.3f', x1, y1, x2, y2, x3, y3, x4, y4) AS points_mm, array_to_string(list_transform({_VOXEL_POINTS}, lambda p: printf('%.3f %.3f %.3f', p[1], p[2], p[3])), ' ') AS points_voxel,
        printf('%.6f %.6f %.6f', 0.7::DOUBLE + workspace / 300::DOUBLE, 1.0::DOUBLE, 2 + workspace / 700::DOUBLE) AS spacing_mm FROM annotations""",
    "pip15_transcript_grades": f"""WITH a AS (SELECT *, conv_id * CAST(0.5 AS DOUBLE) AS want, text || ' The length is ' || CAST(CAST(conv_id * 0.5 AS DECIMAL(20,1)) AS VARCHAR) || CASE WHEN conv_id % 3 = 0 THEN ' mm' ELSE '' END || CASE WHEN turn % 5 = 1 THEN ' a malignant lesion' ELSE '' END || CASE WHEN conv_id % 4 = 1 THEN ', please confirm' ELSE '' END AS answer FROM conversations WHERE role = 'assistant'),
        n AS (SELECT *, list_filter({_numbers_sql('answer')}, lambda x: abs(x - want) <= 0.05)[1] AS g, [1.0, want + CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 3 END] AS results FROM a),
        c AS (SELECT conv_id, turn, g IS NOT NULL AS r, conv_id % 5 = 0 OR contains(lower(answer), 'mm') AS u, coalesce(len(list_filter(results, lambda t: abs(t - g) <= greatest(0.05, 0.01 * abs(g)))) > 0, false) AS t,
            NOT regexp_matches(lower(answer), 'malignan|benign|cancer|carcinoma|metasta|tumour is') AS s, conv_id % 2 = 0 OR contains(lower(answer), 'review') OR contains(lower(answer), 'confirm') AS v, conv_id % 6 < 4 AS m FROM n)
        SELECT conv_id, turn, r AS "right", u AS unit_said, t AS traced, s AS clean, v AS review, m AS tools, r AND u AND t AND s AND v AND m AS passed FROM c""",
}
