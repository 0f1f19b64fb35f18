"""Connected pieces of masks on the voxel lattice, and what is cut, filled and grown by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumivox.operators.masks import KEY, VOX
from lumivox.plans.components import connected_components
from lumivox.plans.groups import over_groups
from lumivox.plans.joins import merge_join
from lumivox.plans.scratch import tabled


#: Lines of the grid to a side of the bricks that are labelled by themselves.
BRICK = 64


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each of ``n`` nodes' piece, by pointers that are jumped until nothing moves."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not (root[root] == root).all():
            root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def mask_runs(mask: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``key, j, k, i0, i1``: the runs of voxels on each line along i; repeated voxels count once."""
    line = Window.partitionBy(*key, "j", "k").orderBy("i")
    stepped = mask.select(*key, *VOX, (F.col("i") - F.dense_rank().over(line)).alias("run"))
    return stepped.groupBy(*key, "j", "k", "run").agg(F.min("i").cast("int").alias("i0"), F.max("i").cast("int").alias("i1")).select(*key, F.col("j").cast("int").alias("j"), F.col("k").cast("int").alias("k"), "i0", "i1")


def run_voxels(runs: DataFrame, *kept: str, key: list[str] = KEY) -> DataFrame:
    return runs.select(*key, F.explode(F.sequence("i0", "i1")).alias("i"), "j", "k", *kept)


def _met(begin: np.ndarray, end: np.ndarray, off: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of runs, sorted by place, of which one lies within ``reach`` of the other moved by ``off``."""
    x, y = np.searchsorted(end, begin + off - reach), np.searchsorted(begin, end + off + reach, "right")
    many = np.maximum(y - x, 0)
    mine = np.repeat(np.arange(len(begin)), many)
    return mine, np.repeat(x, many) + np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many)


def _steps(diagonal: bool) -> list[tuple[int, int]]:
    """The lines beside a line that come after it, as steps along j and k."""
    return [(dj, dk) for dk in (0, 1) for dj in (-1, 0, 1) if (dk, dj) > (0, 0)] if diagonal else [(1, 0), (0, 1)]


def label_runs(runs: DataFrame, diagonal: bool = True, key: list[str] = KEY) -> DataFrame:
    """Adds ``piece`` to runs (``key, j, k, i0, i1``, parted and each once): the first run, in grid order, of the 26- or 6-connected piece that it is in.

    Bricks of ``BRICK`` x ``BRICK`` lines are labelled by themselves, many bricks at a time; only runs on their sides are joined with those
    of the bricks beside them, and only the pieces that meet there are nodes of the graph whose components are sought. So the
    iterated joins follow the bricks' surfaces, not the voxels.
    """
    reach = 1 if diagonal else 0

    def label(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        j, k, i0, i1 = (table.column(c).to_numpy().astype(np.int64) for c in ("j", "k", "i0", "i1"))
        brick = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(j))))
        low, front = (np.minimum.reduceat(x, first)[brick] for x in (i0, k))
        wide, tall, deep = int((i1 - low).max()) + 4, BRICK + 2, BRICK + 1
        place = ((brick * deep + k - front) * tall + np.mod(j, BRICK) + 1) * wide - low + 1  # bricks lie apart on one long line
        begin, end = place + i0, place + i1
        order = np.argsort(begin, kind="stable")
        pairs = [_met(begin[order], end[order], (dk * tall + dj) * wide, reach) for dj, dk in _steps(diagonal)]
        root = np.empty(len(order), np.int64)
        root[order] = order[_roots(len(order), *(np.concatenate(x) for x in zip(*pairs)))]
        named = [pa.array(x[root].astype(np.int32)) for x in (k, j, i0)]
        yield pa.record_batch([*[table.column(c).combine_chunks() for c in (*key, "j", "k", "i0", "i1")], *named], names=[*key, "j", "k", "i0", "i1", "rk", "rj", "ri"])

    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in key)
    bricks = runs.select(*key, "j", "k", "i0", "i1", *[F.floor(F.col(a) / BRICK).cast("int").alias(f"b{a}") for a in ("j", "k")])
    found = over_groups(bricks, [*key, "bj", "bk"], [], label, f"{kinds}, j int, k int, i0 int, i1 int, rk int, rj int, ri int")
    held = tabled(found.withColumn("node", F.struct(*key, F.col("rk").alias("k"), F.col("rj").alias("j"), F.col("ri").alias("i0"))).drop("rk", "rj", "ri"), "runs")
    near = F.array(*[F.struct((F.col("j") + dj).alias("j"), (F.col("k") + dk).alias("k")) for dj, dk in _steps(diagonal)])
    side = F.pmod(F.col("j"), F.lit(BRICK)).isin(0, BRICK - 1) | F.pmod(F.col("k"), F.lit(BRICK)).isin(0, BRICK - 1)
    border = held.where(side)
    looks = border.select(*key, F.col("node").alias("src"), F.col("i0").alias("a0"), F.col("i1").alias("a1"), *[F.floor(F.col(a) / BRICK).alias(f"s{a}") for a in ("j", "k")], F.inline(near))
    looks = looks.where((F.col("sj") != F.floor(F.col("j") / BRICK)) | (F.col("sk") != F.floor(F.col("k") / BRICK)))
    edges = looks.join(border.select(*key, "j", "k", F.col("node").alias("dst"), F.col("i0").alias("b0"), F.col("i1").alias("b1")), [*key, "j", "k"])
    edges = edges.where((F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach)).select("src", "dst")
    met = connected_components(edges).withColumnRenamed("node", "met")
    return held.join(met, F.col("node") == F.col("met"), "left").select(*key, "j", "k", "i0", "i1", F.coalesce("component", "node").alias("piece"))


def over_bricks(rows: DataFrame, key: list[str], pad: tuple[int, int], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``over_groups`` of rows with ``j, k`` by bricks ``bj, bk`` of ``BRICK`` x ``BRICK`` lines, each with the rows of ``pad`` lines around it."""
    for a, p in zip(("j", "k"), pad):
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - p) / BRICK).cast("int"), F.floor((F.col(a) + p) / BRICK).cast("int"))))
    return over_groups(rows, [*key, "bj", "bk"], [], work, schema)


def placed_cells(places: np.ndarray, brick: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int, int], np.ndarray, tuple[slice, slice]] | None:
    """Of the rows ``(k, j, i)`` of a brick ``(bk, bj)`` the corner and the shape of their box, each row's place in it, and which lines are the brick's own; None if none is."""
    corner, far = places.min(axis=1), places.max(axis=1)
    own = [(max(b * BRICK, lo), min(b * BRICK + BRICK - 1, hi)) for b, lo, hi in zip(brick, corner, far)]
    if any(lo > hi for lo, hi in own):
        return None
    shape = tuple((far - corner + 1).tolist())
    return corner, shape, np.ravel_multi_index(tuple(places - corner[:, None]), shape), tuple(slice(int(lo - c), int(hi - c) + 1) for (lo, hi), c in zip(own, corner))


def cell_runs(cells: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """``(j, k, i0, i1)`` of the runs along i of a box of cells, indexed ``k, j, i``."""
    turns = np.diff(cells.astype(np.int8), axis=2, prepend=0, append=0)
    (z, y, x), (_, _, e) = np.nonzero(turns == 1), np.nonzero(turns == -1)
    return np.stack([y + corner[1], z + corner[0], x + corner[2], e + corner[2] - 1])


def content_hash(mask: DataFrame) -> DataFrame:
    """``i0 .. k1`` (inclusive) and ``hash`` of each segment: of its bricks' hashes in grid order, each of the brick's runs in order.

    A brick of ``BRICK`` x ``BRICK`` lines is the largest group, so that a changed voxel makes another hash of its brick and of the segment, and bricks are hashed apart.
    """
    runs = mask_runs(mask).withColumn("bj", F.floor(F.col("j") / BRICK)).withColumn("bk", F.floor(F.col("k") / BRICK))
    ends = [e for a, lo, hi in (("i", "i0", "i1"), ("j", "j", "j"), ("k", "k", "k")) for e in (F.min(lo).alias(f"{a}0"), F.max(hi).alias(f"{a}1"))]
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "j", "i0", "i1"))), lambda r: F.concat_ws(",", r["k"], r["j"], r["i0"], r["i1"])), ";")
    bricks = runs.groupBy(*KEY, "bk", "bj").agg(*ends, F.sha2(told, 256).alias("h"))
    box = [e for a in VOX for e in (F.min(f"{a}0").alias(f"{a}0"), F.max(f"{a}1").alias(f"{a}1"))]
    return bricks.groupBy(*KEY).agg(*box, F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bk", "bj", "h"))), lambda b: F.concat_ws(":", b["bk"], b["bj"], b["h"])), ","), 256).alias("hash"))


def label_components(mask: DataFrame, diagonal: bool = True, key: list[str] = KEY) -> DataFrame:
    """Adds ``piece`` to the voxels, as ``label_runs`` does to their runs."""
    return run_voxels(label_runs(mask_runs(mask, key), diagonal, key), "piece", key=key)


def components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """``rank, voxels, i0 .. k1, ci, cj, ck`` of each piece, the largest first, ties by the first voxel in grid order."""
    pieces = label_components(mask, diagonal).groupBy(*KEY, "piece").agg(
        F.count("*").alias("voxels"), F.min(F.struct("k", "j", "i")).alias("first"),
        *[e for a in VOX for e in (F.min(a).alias(f"{a}0"), F.max(a).alias(f"{a}1"), F.avg(a).alias(f"c{a}"))],
    )
    return pieces.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("voxels"), "first"))).drop("piece", "first")


def keep_pieces(mask: DataFrame, least: int = 0, largest: bool = False) -> DataFrame:
    """The voxels of the largest piece, or of those with ``least`` voxels or more."""
    labelled = label_components(mask)
    sizes = labelled.groupBy(*KEY, "piece").agg(F.count("*").alias("voxels"), F.min(F.struct("k", "j", "i")).alias("first"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("voxels"), "first")))
    kept = ranked.where((F.col("rank") == 1) if largest else (F.col("voxels") >= least)).select(*KEY, "piece")
    return merge_join(labelled, kept, on=[*KEY, "piece"], how="left_semi").select(*KEY, *VOX)


def split_segments(mask: DataFrame, least: int, most: int = 255) -> DataFrame:
    """``series_id, label, rank, new_label``: each further piece of ``least`` voxels gets the lowest free label, in order of label and rank."""
    further = components(mask).where((F.col("rank") > 1) & (F.col("voxels") >= least)).select(*KEY, "rank")
    asked = further.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy("label", "rank")))
    taken = mask.select("series_id", F.col("label").alias("new_label")).distinct()
    free = mask.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("new_label")).join(taken, ["series_id", "new_label"], "left_anti")
    numbered = free.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy("new_label")))
    return asked.join(numbered, ["series_id", "n"], "left").select(*KEY, "rank", "new_label")


def gap_runs(runs: DataFrame, box: DataFrame) -> DataFrame:
    """The runs of each key's ``box`` (inclusive ``i0 .. k1``) that ``runs`` leave: a row a line and gap, none for a voxel."""
    ends = [f"{a}{e}" for a in VOX for e in (0, 1)]
    lines = box.select(*KEY, *[F.col(c).alias(f"b{c}") for c in ends]).withColumn("j", F.explode(F.sequence("bj0", "bj1"))).withColumn("k", F.explode(F.sequence("bk0", "bk1")))
    held = runs.groupBy(*KEY, "j", "k").agg(F.array_sort(F.collect_list(F.struct("i0", "i1"))).alias("held"))
    met = lines.join(held, [*KEY, "j", "k"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<i0: int, i1: int>>")))
    starts = F.concat(F.array(F.col("bi0").cast("int")), F.transform("held", lambda r: r["i1"] + 1))
    stops = F.concat(F.transform("held", lambda r: r["i0"] - 1), F.array(F.col("bi1").cast("int")))
    gaps = met.select(*KEY, "j", "k", F.explode(F.arrays_zip(starts.alias("i0"), stops.alias("i1"))).alias("g")).where("g.i0 <= g.i1")
    return gaps.select(*KEY, "j", "k", "g.i0", "g.i1")


def enclosed_runs(mask: DataFrame) -> DataFrame:
    """Runs, with their ``piece``, of the voxels that a segment encloses: those of its box which no 6-connected way outside the segment leads out of."""
    runs = tabled(mask_runs(mask), "runs")
    box = tabled(runs.groupBy(*KEY).agg(*[e for c, lo, hi in (("i", "i0", "i1"), ("j", "j", "j"), ("k", "k", "k")) for e in (F.min(lo).alias(f"{c}0"), F.max(hi).alias(f"{c}1"))]), "boxes")
    pieces = tabled(label_runs(gap_runs(runs, box), diagonal=False), "gaps")
    ends = box.select(*KEY, *[F.col(f"{a}{e}").alias(f"b{a}{e}") for a in VOX for e in (0, 1)])
    open_end = F.col("i0").eqNullSafe(F.col("bi0")) | (F.col("i1") == F.col("bi1"))
    for a in ("j", "k"):
        open_end = open_end | (F.col(a) == F.col(f"b{a}0")) | (F.col(a) == F.col(f"b{a}1"))
    out = merge_join(pieces, ends, on=KEY).where(open_end).select(*KEY, "piece").distinct()
    return merge_join(pieces, out, on=[*KEY, "piece"], how="left_anti")


def enclosed(mask: DataFrame) -> DataFrame:
    """The voxels of ``enclosed_runs``."""
    return run_voxels(enclosed_runs(mask), "piece")


#: Cells of the slices that are filled at a time, about; one slice at least.
CELLS = 1 << 21


def _enclosed_cells(line: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that slices enclose, in their boxes: the slice's number, and where. The cells ``(line, place)`` of a slice begin at ``first``."""
    many = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(line))))
    low, left = np.minimum.reduceat(line, first), np.minimum.reduceat(place, first)
    tall, wide = np.maximum.reduceat(line, first) - low + 1, np.maximum.reduceat(place, first) - left + 1
    across = int(wide.max()) + 1  # slices lie below one another, with what is taken between them
    top = np.cumsum(tall + 1) - tall
    free = np.zeros((int(top[-1] + tall[-1]) + 1, across), bool)
    free[np.repeat(top, tall) + np.arange(tall.sum()) - np.repeat(np.cumsum(tall) - tall, tall)] = np.arange(across) < np.repeat(wide, tall)[:, None]
    free[top[many] + line - low[many], place - left[many]] = False
    turns = np.diff(free.ravel().astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - 1
    root = _roots(len(begin), *_met(begin, end, across, 0))
    row, mine = begin // across, np.searchsorted(top, begin // across, "right") - 1
    way = (begin % across == 0) | (end % across == wide[mine] - 1) | (row == top[mine]) | (row == top[mine] + tall[mine] - 1)
    leads = np.zeros(len(begin), bool)
    leads[root[way]] = True
    inner = np.flatnonzero(~leads[root])
    size = end[inner] - begin[inner] + 1
    run = np.repeat(inner, size)
    step = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    return mine[run], row[run] - top[mine[run]] + low[mine[run]], begin[run] % across + step + left[mine[run]]


#: Slices across i that runs are dealt to together.
SLAB = 16


def filled_slices(runs: DataFrame, axis: str) -> DataFrame:
    """The voxels that slices across ``axis`` enclose: those of the box of a segment's part of a slice which no way through four neighbours leads out of.

    Segments are given by runs along i (``KEY, j, k, i0, i1``, also of one voxel, also side by side). A slice of a segment is worked on whole, many slices
    at a time; across i, ``SLAB`` slices are the largest group, otherwise one is.
    """
    a, b = [x for x in VOX if x != axis]
    group = "slab" if axis == "i" else axis

    def slices(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = {c: table.column(c).to_numpy().astype(np.int64) for c in ("j", "k", "i0", "i1", group)}
        low, high = column["i0"], column["i1"]
        if axis == "i":
            low, high = np.maximum(low, column["slab"] * SLAB), np.minimum(high, column["slab"] * SLAB + SLAB - 1)
        row = np.repeat(np.arange(len(low)), high - low + 1)
        cell = {x: column[x][row] for x in ("j", "k")} | {"i": low[row] + np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)}
        many = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(low))))[row]
        order = np.lexsort((cell[a], cell[b], cell[axis], many))
        line, place, of, many, row = cell[b][order], cell[a][order], cell[axis][order], many[order], row[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (many[1:] != many[:-1]) | (of[1:] != of[:-1])
        begin = np.flatnonzero(fresh)
        ends = np.append(begin[1:], len(line))
        spans = [np.maximum.reduceat(x, begin) - np.minimum.reduceat(x, begin) + 2 for x in (line, place)]
        at = 0
        while at < len(begin):
            cells = np.maximum.accumulate(spans[1][at : at + CELLS]) * np.cumsum(spans[0][at : at + CELLS])
            upto = at + max(1, int(np.searchsorted(cells, CELLS, "right")))
            rows = slice(int(begin[at]), int(ends[upto - 1]))
            mine, y, x = _enclosed_cells(line[rows], place[rows], begin[at:upto] - begin[at])
            if len(mine):
                named = table.select(KEY).take(pa.array(row[begin[at:upto][mine]]))
                found = {axis: of[begin[at:upto][mine]], a: x, b: y}
                yield pa.record_batch([*[named.column(c).combine_chunks() for c in KEY], *[pa.array(found[v].astype(np.int32)) for v in VOX]], names=[*KEY, *VOX])
            at = upto

    def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        long = table.column("i1").to_numpy().astype(np.int64) - table.column("i0").to_numpy() + 1
        upto = np.cumsum(np.add.reduceat(np.minimum(long, SLAB) if axis == "i" else long, first))
        ends = np.append(first[1:], table.num_rows)
        at = 0
        while at < len(first):  # whole groups of about so many cells
            more = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS // 4, "right")))
            yield from slices(table.slice(int(first[at]), int(ends[more - 1] - first[at])), first[at:more] - first[at])
            at = more

    rows = runs.select(*KEY, *[F.col(x).cast("int").alias(x) for x in ("j", "k", "i0", "i1")])
    if axis == "i":
        rows = rows.withColumn("slab", F.explode(F.sequence(F.floor(F.col("i0") / SLAB).cast("int"), F.floor(F.col("i1") / SLAB).cast("int"))))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in KEY)
    return over_groups(rows, [*KEY, group], [], work, f"{kinds}, i int, j int, k int")


def fill_holes(mask: DataFrame) -> DataFrame:
    return mask.select(*KEY, *VOX).unionByName(enclosed(mask).select(*KEY, *VOX))


def cavities(mask: DataFrame) -> DataFrame:
    """Number and voxels of the enclosed holes; segments without any are left out."""
    return enclosed_runs(mask).groupBy(*KEY).agg(F.count_distinct("piece").alias("cavities"), F.sum(F.col("i1") - F.col("i0") + 1).alias("voxels"))


def grow(voxels: DataFrame, seeds: DataFrame, low: float, high: float, most: int) -> DataFrame:
    """The unlabelled voxels with values in ``[low, high]`` that are 6-connected with a seed (``series_id, i, j, k``), all seeds in one job.

    A seed whose region has more than ``most`` voxels is refused: ``refused`` is set and no voxel is given.
    All but the last step is on runs, a row a line and run; a region's voxels are made when it is chosen.
    """
    key = ["series_id"]
    band = voxels.where((F.col("label") == 0) & F.col("value").between(low, high)).select("series_id", *VOX)
    pieces = tabled(label_runs(mask_runs(band, key), False, key), "band")
    start = seeds.select("series_id", *[F.col(a).alias(f"s{a}") for a in VOX])
    held = (F.col("j") == F.col("sj")) & (F.col("k") == F.col("sk")) & F.col("si").between(F.col("i0"), F.col("i1"))
    chosen = pieces.join(start, key).where(held).select("series_id", "piece").distinct()
    region = tabled(pieces.join(chosen, ["series_id", "piece"], "left_semi").drop("piece"), "region")
    sized = region.groupBy("series_id").agg(F.sum(F.col("i1") - F.col("i0") + 1).alias("voxels"))
    none = [F.lit(None).cast("int").alias(a) for a in VOX]
    grown = run_voxels(region.join(sized.where(F.col("voxels") <= most), key, "left_semi"), key=key).select("series_id", *VOX, F.lit(False).alias("refused"))
    return grown.unionByName(sized.where(F.col("voxels") > most).select("series_id", *none, F.lit(True).alias("refused")))


def _envelope(f: np.ndarray, step: float) -> np.ndarray:
    """Along the rows of ``f`` the least of f plus the squared distance to where it is: the lower envelope of parabolas, all rows together.

    A place's parabola takes away those before it that it is below of from where they began to be lowest, so each enters and
    leaves once: time in proportion to the length of the lines.
    """
    lines, n = f.shape
    w = step * step
    held = np.zeros((lines, n), np.int32)  # the parabolas of the envelope so far, and from where each is lowest
    since = np.full((lines, n + 1), np.inf)
    last = np.full(lines, -1)
    for q in range(n):
        live = np.flatnonzero(np.isfinite(f[:, q]))
        from_here = np.full(len(live), -np.inf)
        own = f[live, q] + w * q * q
        waiting = np.flatnonzero(last[live] >= 0)
        while len(waiting):
            at = live[waiting]
            top = last[at]
            r = held[at, top]
            cross = (own[waiting] - (f[at, r] + w * r * r)) / (2 * w * (q - r))
            above = cross <= since[at, top]
            from_here[waiting[~above]] = cross[~above]
            last[at[above]] -= 1
            waiting = waiting[above]
            waiting = waiting[last[live[waiting]] >= 0]
        last[live] += 1
        held[live, last[live]] = q
        since[live, last[live]] = from_here
        since[live, last[live] + 1] = np.inf
    out = np.full(f.shape, np.inf)
    some = np.flatnonzero(last >= 0)
    turn = np.zeros(len(some), np.int64)
    for p in range(n):
        while True:
            on = since[some, turn + 1] < p
            if not on.any():
                break
            turn[on] += 1
        r = held[some, turn]
        out[some, p] = f[some, r] + w * (p - r) ** 2
    return out


def _along(grids: np.ndarray, axis: int, step: float) -> np.ndarray:
    """``_envelope`` along an axis of a stack of grids."""
    moved = np.moveaxis(grids, axis, -1)
    return np.moveaxis(_envelope(np.ascontiguousarray(moved).reshape(-1, moved.shape[-1]), step).reshape(moved.shape), -1, axis)


def _least_within(d2: np.ndarray, axis: int, reach: int, step: float) -> np.ndarray:
    """Along an axis the least of ``d2`` plus the squared distance to where it is, of places up to ``reach`` away: a pass over the whole box for each step."""
    out, size = d2.copy(), d2.shape[axis]
    for off in range(1, min(reach, size - 1) + 1):
        far = d2 + step * step * off * off
        for a, b in ((slice(off, None), slice(None, -off)), (slice(None, -off), slice(off, None))):
            to, at = (tuple(x if d == axis else slice(None) for d in range(d2.ndim)) for x in (a, b))
            np.minimum(out[to], far[at], out=out[to])
    return out


def _alike(shapes: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """The numbers of grids by their shape."""
    by: dict[tuple[int, int], list[int]] = {}
    for n, shape in enumerate(shapes):
        by.setdefault(shape, []).append(n)
    yield from by.items()


def squared_distances(cells: DataFrame, spacing: tuple[float, float, float], key: list[str] = KEY) -> DataFrame:
    """``d2``: each cell's squared distance in mm to the nearest cell with ``inside``, exact.

    ``cells`` are whole boxes (``key, i, j, k, inside``). A row is an axial slice as one array while two axes are worked on, and then
    a coronal one for the third, in time in proportion to the cells; slices of a shape are worked on together, many a batch. A
    slice is the largest row, and lines are what is exchanged between the passes. Infinity where a box has no inside cell.
    """
    kinds = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in key)

    def work(other: str, rows: str, steps: tuple[float | None, float]):
        """Squared distances within slices whose lines lie along i, one after another along ``rows``."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column("d2")
                tall, wide = batch.column("tall").to_pylist(), batch.column("wide").to_pylist()
                out: list[np.ndarray] = [np.empty(0)] * batch.num_rows
                for shape, some in _alike(list(zip(tall, wide))):
                    grids = np.stack([values[n].values.to_numpy().reshape(shape) for n in some])
                    if steps[0] is not None:
                        grids = _along(grids, 2, steps[0])
                    grids = _along(grids, 1, steps[1])
                    for n, grid in zip(some, grids):
                        out[n] = grid.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out)))
                yield pa.record_batch([*[lists if c == "d2" else batch.column(c) for c in batch.schema.names]], names=batch.schema.names)

        return lambda slices: slices.mapInArrow(scan, f"{kinds}{other} int, first int, low int, tall int, wide int, d2 array<double>")

    flat = cells.select(*key, *[F.col(a).cast("int").alias(a) for a in VOX], F.when(F.col("inside"), 0.0).otherwise(float("inf")).alias("d2"))
    axial = flat.groupBy(*key, "k").agg(F.min("j").alias("first"), F.min("i").alias("low"), F.max("j").alias("j1"), F.max("i").alias("i1"), F.array_sort(F.collect_list(F.struct("j", "i", "d2"))).alias("cells"))
    axial = axial.select(*key, "k", "first", "low", (F.col("j1") - F.col("first") + 1).alias("tall"), (F.col("i1") - F.col("low") + 1).alias("wide"), F.transform("cells", lambda c: c["d2"]).alias("d2"))
    axial = work("k", "j", (spacing[0], spacing[1]))(axial)
    line = F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda j: F.struct((F.col("first") + j).alias("j"), F.slice("d2", j * F.col("wide") + 1, F.col("wide")).alias("line")))
    lines = axial.select(*key, "k", "low", "wide", F.inline(line))
    coronal = lines.groupBy(*key, "j").agg(F.min("k").alias("first"), F.min("low").alias("low"), F.count("*").cast("int").alias("tall"), F.min("wide").alias("wide"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    coronal = coronal.select(*key, "j", "first", "low", "tall", "wide", F.flatten(F.transform("lines", lambda x: x["line"])).alias("d2"))
    done = work("j", "k", (None, spacing[2]))(coronal).select(*key, "j", "first", "low", "wide", F.posexplode("d2").alias("at", "d2"))
    return done.select(*key, (F.col("low") + F.col("at") % F.col("wide")).alias("i"), "j", (F.col("first") + F.floor(F.col("at") / F.col("wide"))).cast("int").alias("k"), "d2")


def _ball(runs: DataFrame, target: DataFrame | None, spacing: tuple[float, float, float], radius: float) -> DataFrame:
    """The runs of the voxels of ``runs`` that are farther than ``radius``, or as far, from all that isn't in them; with a ``target``, of those within ``radius`` of it.

    Both tables of runs are dealt into bricks of ``BRICK`` x ``BRICK`` lines, each with the lines around it that the radius reaches, so a brick
    is worked on by itself and no row is made for a voxel outside.
    """
    pad = [int(radius // s) + 1 for s in spacing]

    def dealt(some: DataFrame, what: int) -> DataFrame:
        bricks = lambda a, p: F.array_distinct(F.transform(F.array(F.lit(-p), F.lit(0), F.lit(p)), lambda d: F.floor((F.col(a) + d) / BRICK).cast("int")))
        return some.select(*KEY, "j", "k", "i0", "i1", F.lit(what).alias("what")).withColumn("bj", F.explode(bricks("j", pad[1]))).withColumn("bk", F.explode(bricks("k", pad[2])))

    if max(pad[1:]) > BRICK:
        raise ValueError("the radius reaches over a whole brick")
    rows, to_target = dealt(runs, 0), target is not None
    if target is not None:
        rows = rows.unionByName(dealt(target, 1))

    def work(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        j, k, i0, i1, what, bj, bk = (table.column(c).to_numpy().astype(np.int64) for c in ("j", "k", "i0", "i1", "what", "bj", "bk"))
        rows, out = [], []
        own = np.logical_or.reduceat((what == 0) & (j // BRICK == bj) & (k // BRICK == bk), first)
        for a, b in zip(first[own], np.append(first[1:], len(j))[own]):  # the others have only lines around theirs
            at = slice(a, b)
            corner = (bk[a] * BRICK - pad[2], bj[a] * BRICK - pad[1], i0[at].min() - pad[0])
            far = (min(k[at].max(), bk[a] * BRICK + BRICK - 1) + pad[2], min(j[at].max(), bj[a] * BRICK + BRICK - 1) + pad[1], i1[at].max() + pad[0])
            edge = np.zeros((2, far[0] - corner[0] + 1, far[1] - corner[1] + 1, far[2] - corner[2] + 2), np.int8)
            seen = (k[at] <= far[0]) & (j[at] <= far[1])
            z, y = k[at][seen] - corner[0], j[at][seen] - corner[1]
            np.add.at(edge, (what[at][seen], z, y, i0[at][seen] - corner[2]), 1)
            np.add.at(edge, (what[at][seen], z, y, i1[at][seen] - corner[2] + 1), -1)
            own, other = np.cumsum(edge, axis=3, dtype=np.int8)[..., :-1] > 0
            d2 = np.where(other if to_target else ~own, 0.0, np.inf)
            for axis, p, step in ((2, pad[0], spacing[0]), (1, pad[1], spacing[1]), (0, pad[2], spacing[2])):
                d2 = _least_within(d2, axis, p, step)
            kept = own & ((d2 <= radius * radius) if to_target else (d2 >= radius * radius))
            kept = kept[pad[2] : pad[2] + BRICK, pad[1] : pad[1] + BRICK]
            turns = np.diff(kept.astype(np.int8), axis=2, prepend=0, append=0)
            (z, y, x), (_, _, e) = np.nonzero(turns == 1), np.nonzero(turns == -1)
            rows += [int(a)] * len(x)
            out.append(np.stack([y + corner[1] + pad[1], z + corner[0] + pad[2], x + corner[2], e + corner[2] - 1]))
        if rows:
            columns = [pa.array(c.astype(np.int32)) for c in np.concatenate(out, axis=1)]
            yield pa.record_batch([*[table.column(c).combine_chunks().take(pa.array(rows)) for c in KEY], *columns], names=[*KEY, "j", "k", "i0", "i1"])

    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in KEY)
    return over_groups(rows, [*KEY, "bj", "bk"], [], work, f"{kinds}, j int, k int, i0 int, i1 int", least=20_000)


def opening(mask: DataFrame, spacing: tuple[float, float, float], radius: float, seeds: DataFrame | None = None) -> DataFrame:
    """The voxels of ``opening_runs``."""
    return run_voxels(opening_runs(tabled(mask_runs(mask), "runs"), spacing, radius, seeds))


def opening_runs(runs: DataFrame, spacing: tuple[float, float, float], radius: float, seeds: DataFrame | None = None) -> DataFrame:
    """A segment, given by its runs (a written table), without what is narrower than twice ``radius``: its voxels within the radius of the core, which is as far from the outside.

    With ``seeds`` (``KEY, i, j, k``, one a segment) only the core's piece that is nearest to the seed counts, of equals the larger,
    and of equally large ones the first in grid order. A segment without a core stays as it is. All is done on runs, brick by brick.
    """
    core = tabled(_ball(runs, None, spacing, radius), "core")
    if seeds is not None:
        pieces = tabled(label_runs(core), "pieces")
        spots = seeds.select(*KEY, *[F.col(a).alias(f"s{a}") for a in VOX])
        x = F.greatest(F.lit(0), F.col("i0") - F.col("si"), F.col("si") - F.col("i1"))  # a run's nearest voxel on its line
        d2 = F.pow(x * spacing[0], F.lit(2)) + F.pow((F.col("j") - F.col("sj")) * spacing[1], F.lit(2)) + F.pow((F.col("k") - F.col("sk")) * spacing[2], F.lit(2))
        sized = pieces.join(spots, KEY).groupBy(*KEY, "piece").agg(F.min(d2).alias("d2"), (-F.sum(F.col("i1") - F.col("i0") + 1)).alias("less"))
        chosen = sized.groupBy(*KEY).agg(F.min(F.struct("d2", "less", "piece")).alias("best")).select(*KEY, "best.piece")
        core = tabled(pieces.join(chosen, [*KEY, "piece"], "left_semi").drop("piece"), "core")
    kept = _ball(runs, core, spacing, radius)
    whole = runs.join(core.select(*KEY).distinct(), KEY, "left_anti").select(*kept.columns)
    return kept.unionByName(whole)
