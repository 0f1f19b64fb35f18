"""Volume files: inventory, headers, voxels and labels of NIfTI-1, read by one task a file split."""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.functions.grid import to_storage
from lumivox.plans.groups import over_groups
from lumivox.plans.scratch import file_system

#: NIfTI-1 datatype codes and their numpy kinds.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = (
    "path string, nx int, ny int, nz int, volumes long, sx double, sy double, sz double, datatype int, slope double, intercept double, "
    "ox double, oy double, oz double, direction array<double>, target array<int>, flip array<boolean>"
)


#: The same with what reading the voxels takes, or why a header doesn't read.
INNER = HEADER + ", order string, offset long, packed boolean, reason string"


def inventory(spark: SparkSession, folder: str, most: int = 100_000, depth: int = 8) -> DataFrame:
    """``path, length, format`` of the files below a folder; no content is read but the first bytes of files whose name says no format.

    What is hidden, or in a hidden folder, is left out. More than ``most`` files, or files more than ``depth`` folders down, are refused,
    never cut. Names tell NIfTI (``.nii``, ``.nii.gz``, ``.hdr``) and DICOM (``.dcm``); of others the first bytes do: ``DICM`` behind 128, or a NIfTI-1 magic.
    """
    files = listed(spark, folder)
    below = F.regexp_replace("path", rf"^.*?{re.escape(folder.rstrip('/').rsplit('/', 1)[-1])}/", "")
    parts = F.split(below, "/")
    seen = files.where(~F.exists(parts, lambda p: p.startswith(".")))
    limits = seen.select(F.size(parts).alias("parts")).limit(most + 1).agg(F.count("*"), F.max("parts")).first()
    if limits[0] > most:
        raise ValueError(f"{folder} has more than {most} files")
    if (limits[1] or 0) - 1 > depth:
        raise ValueError(f"{folder} has files more than {depth} folders down")
    name = F.lower("path")
    told = F.when(name.rlike(r"\.(nii(\.gz)?|hdr)$"), "nifti").when(name.endswith(".dcm"), "dicom")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            formats = []
            for path in batch["path"]:
                store, at = file_system(path)
                with store.open_input_stream(at, compression=None, buffer_size=0) as f:
                    head = f.read(352)
                formats.append("dicom" if head[128:132] == b"DICM" else "nifti" if head[344:347] in (b"n+1", b"ni1") else "unknown")
            yield batch.assign(format=formats)

    unnamed = seen.where(told.isNull()).select("path", "length").mapInPandas(look, "path string, length long, format string")
    return seen.where(told.isNotNull()).select("path", "length", told.alias("format")).unionByName(unnamed)


def hashes(files: DataFrame) -> DataFrame:
    """``path, length, sha256`` of whole files, read piece by piece, so that their size doesn't matter."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                store, at = file_system(path)
                digest = hashlib.sha256()
                with store.open_input_stream(at, compression=None) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield batch.assign(sha256=found)

    return files.select("path", "length").mapInPandas(work, "path string, length long, sha256 string")


def _unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _axes(content: bytes, order: str, step: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The voxel axes (columns, in mm) and the origin of a header in the file's own frame, right and front and up; None without an orientation."""
    number = lambda at, n=1: np.array(struct.unpack_from(f"{order}{n}f", content, at), float)
    qform, sform = struct.unpack_from(order + "2h", content, 252)
    if sform > 0:
        rows = number(280, 12).reshape(3, 4)
        axes, origin = rows[:, :3], rows[:, 3]
    elif qform > 0:
        b, c, d = number(256, 3)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        axes, origin = turn * step * [1, 1, -1 if number(76)[0] < 0 else 1], number(268, 3)
    else:
        return None, np.zeros(3)
    usable = np.isfinite(axes).all() and (np.linalg.norm(axes, axis=0) > 1e-6).all()
    return (axes if usable else None), np.where(np.isfinite(origin).all(), origin, 0.0)


def assigned(axes: np.ndarray, frame: np.ndarray = np.eye(3)) -> tuple[list[int], list[bool]]:
    """For each stored axis (a column) the axis of ``frame`` that it becomes, and whether it runs against it.

    The axis with the largest single part chooses first, so an oblique grid goes to the nearest permutation and no axis is taken twice.
    """
    parts = frame.T @ axes
    left, target, flip = {0, 1, 2}, [0, 0, 0], [False] * 3
    for a in sorted(range(3), key=lambda a: -np.abs(parts[:, a]).max()):
        t = max(left, key=lambda t: (abs(parts[t, a]), t))
        left.remove(t)
        target[a], flip[a] = t, bool(parts[t, a] < 0)
    return target, flip


def parse_header(content: bytes) -> dict:
    """The fields of a NIfTI-1 header of either byte order; an error says what is wrong with it.

    ``target`` and ``flip`` say how its axes go to left, back and up; ``direction`` (by columns) and origin are those of the grid after that.
    """
    if len(content) < 348:
        raise ValueError("shorter than a header")
    order = "<" if struct.unpack("<i", content[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", content[:4])[0] != 348:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack(order + "8h", content[40:56])
    datatype = struct.unpack(order + "h", content[70:72])[0]
    pixdim = np.abs(struct.unpack(order + "8f", content[76:108]))
    step = np.where(np.isfinite(pixdim[1:4]) & (pixdim[1:4] > 0), pixdim[1:4], 1.0)
    offset, slope, intercept = struct.unpack(order + "3f", content[108:120])
    if datatype not in KINDS or not 1 <= dim[0] <= 7:
        raise ValueError("dimensions or datatype that aren't read")
    size = [max(1, dim[a]) if a <= dim[0] else 1 for a in range(1, 8)]
    axes, origin = _axes(content, order, step)
    target, flip, direction = [0, 1, 2], [False] * 3, np.eye(3)
    if axes is not None:
        turned = axes * [[-1.0], [-1.0], [1.0]]  # from right and front to left and back
        target, flip = assigned(turned)
        origin = origin * [-1.0, -1.0, 1.0]
        for a in range(3):
            direction[:, target[a]] = turned[:, a] / np.linalg.norm(turned[:, a]) * (-1 if flip[a] else 1)
            if flip[a]:
                origin = origin + turned[:, a] * (size[a] - 1)
    good = np.isfinite(slope) and slope != 0
    return {
        "nx": size[0], "ny": size[1], "nz": size[2], "volumes": int(np.prod(size[3:])), "sx": float(step[0]), "sy": float(step[1]), "sz": float(step[2]), "datatype": datatype,
        "slope": slope if good else 1.0, "intercept": intercept if np.isfinite(intercept) else 0.0, "ox": float(origin[0]) + 0.0, "oy": float(origin[1]) + 0.0, "oz": float(origin[2]) + 0.0,
        "direction": (direction.T.ravel() + 0.0).tolist(), "target": target, "flip": flip, "order": order, "offset": max(348, int(offset)),
    }


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of all files in a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def _unzipped(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The content of a gzip stream piece by piece, of all its members."""
    one = zlib.decompressobj(31)
    rest = b""
    while data := rest or stream.read(size):
        yield one.decompress(data)
        rest = one.unused_data
        if one.eof:
            one = zlib.decompressobj(31)


def _first_bytes(path: str, most: int = 352) -> tuple[bytes, bool]:
    """The first bytes of a file's content, and whether it is gzipped: no more of it is fetched than they need."""
    store, at = file_system(path)
    with store.open_input_stream(at, compression=None, buffer_size=0) as f:
        head = f.read(most)
        if head[:2] != b"\x1f\x8b":
            return head, False
    with store.open_input_stream(at, compression=None, buffer_size=0) as f:
        out = b""
        for piece in _unzipped(f, 512):
            out += piece
            if len(out) >= most:
                break
        return out[:most], True


def _parsed_headers(files: DataFrame, strict: bool) -> DataFrame:
    """The headers of ``files`` with what reading their voxels takes; those that don't read fail the job if ``strict``, else ``reason`` says why."""
    held = "content" in files.columns

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in INNER.split(", ")]
        for batch in batches:
            rows = []
            for n, path in enumerate(batch["path"]):
                try:
                    head, packed = (_unpacked(batch["content"][n])[:352], False) if held else _first_bytes(path)
                    rows.append({"path": path, **parse_header(head), "packed": packed, "reason": None})
                except (ValueError, OSError, EOFError, zlib.error) as error:
                    if strict:
                        raise ValueError(f"{error}: {path}") from error
                    rows.append({**dict.fromkeys(names), "path": path, "reason": str(error)})
            yield pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("nx", "ny", "nz", "volumes", "datatype", "offset")} | {"packed": "boolean"})

    return files.select("path", *["content"] * held).mapInPandas(parse, INNER)


def read_headers(files: DataFrame) -> DataFrame:
    """The header rows of ``files`` (gzipped or not); those that can't be read are left to ``rejected``.

    Of files that are listed (``path`` alone) the header's bytes are fetched and nothing else, whatever their size, and of gzipped ones as
    much as these unpack from; files with their ``content`` are read from that.
    """
    return _parsed_headers(files, False).where("reason IS NULL").select(*[c.split()[0] for c in HEADER.split(", ")])


def rejected(files: DataFrame) -> DataFrame:
    """``path, reason`` of the files that ``read_headers`` leaves out."""
    return _parsed_headers(files, False).where("reason IS NOT NULL").select("path", "reason")


def _slices(path: str, content: bytes | None, begin: int, size: int, count: int) -> Iterator[bytes]:
    """``count`` slices of ``size`` bytes each from byte ``begin`` of a file on, by ranged reads, or of a gzipped one as it unpacks."""
    if content is not None:
        yield from (content[begin + n * size : begin + (n + 1) * size] for n in range(count))
        return
    store, at = file_system(path)
    with store.open_input_file(at) as f:
        if f.read(2) != b"\x1f\x8b":
            f.seek(begin)
            for _ in range(count):
                yield f.read(size)
            return
        f.seek(0)
        held, gone = bytearray(), 0
        for piece in _unzipped(f):
            held += piece
            if gone < begin:  # nothing before the voxels is kept
                cut = min(len(held), begin - gone)
                del held[:cut]
                gone += cut
            while gone >= begin and len(held) >= size and count:
                yield bytes(held[:size])
                del held[:size]
                count -= 1
            if not count:
                return
        if count:
            yield bytes(held)


def read_volume(files: DataFrame, volume: int = 0, canonical: bool = True, slab: int = 16 << 20) -> DataFrame:
    """``path, i, j, k, value`` of one volume of each file, scaled as its header says, on the grid that runs left, back and up.

    Files that are listed (``path`` alone) are read in slabs of about ``slab`` bytes of whole slices, a row of the plan each, so that many tasks read one large
    file, each by its own range of bytes; a gzipped file is one task, which unpacks it as a stream. A slice goes out at a time, so no task holds more. Files with
    their ``content`` are read from that. A volume that the file hasn't, or whose voxels are cut off, fails the job; with ``canonical`` unset voxels stay as stored.
    """
    held = "content" in files.columns
    heads = _parsed_headers(files, True)
    width = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, np.dtype(v).itemsize)])[F.col("datatype")]
    step = F.when(F.col("packed") | F.lit(held), F.col("nz")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(slab) / (F.col("nx").cast("long") * F.col("ny") * width)).cast("int")))
    parts = heads.withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0), F.col("nz") - 1, F.col("step")))).withColumn("last", F.least(F.col("first") + F.col("step"), F.col("nz")))
    parts = parts.join(files.select("path", "content"), "path") if held else parts.repartition("path", "first")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                path, size = row["path"], [row["nx"], row["ny"], row["nz"]]
                plane, kind = size[0] * size[1], np.dtype(row["order"] + KINDS[row["datatype"]])
                if volume >= row["volumes"]:
                    raise ValueError(f"no volume {volume + 1} in a file of {row['volumes']}: {path}")
                begin = row["offset"] + (volume * size[2] + row["first"]) * plane * kind.itemsize
                at = np.arange(plane)
                k = row["first"]
                for raw in _slices(path, _unpacked(row["content"]) if held else None, begin, plane * kind.itemsize, row["last"] - row["first"]):
                    if len(raw) < plane * kind.itemsize:
                        raise ValueError(f"voxels are cut off: {path}")
                    stored = [at % size[0], at // size[0], np.full(plane, k)]
                    out = {}
                    for a in range(3):
                        turned = canonical and row["flip"][a]
                        out["ijk"[row["target"][a] if canonical else a]] = (size[a] - 1 - stored[a] if turned else stored[a]).astype("int32")
                    yield pd.DataFrame({"path": path, **{a: out[a] for a in "ijk"}, "value": np.frombuffer(raw, kind) * row["slope"] + row["intercept"]})
                    k += 1
                if k < row["last"]:
                    raise ValueError(f"voxels are cut off: {path}")

    return parts.mapInPandas(decode, "path string, i int, j int, k int, value double")


def read_labels(files: DataFrame, grid: tuple[int, int, int] | None = None) -> DataFrame:
    """``path, label, i, j, k`` of label maps on the canonical grid; values other than 0 to 255, or a grid of another size than ``grid``, fail the job."""
    v = read_volume(files)
    bad = (F.col("value") != F.floor("value")) | ~F.col("value").between(0, 255)
    label = F.when(bad, F.raise_error(F.concat(F.lit("no label map: "), "path")).cast("double"))
    if grid:
        size = F.greatest(*[F.col(a) - (n - 1) for a, n in zip("ijk", grid)])
        label = label.when(size > 0, F.raise_error(F.concat(F.lit("another grid than the volume's: "), "path")).cast("double"))
    return v.select("path", label.otherwise(F.col("value")).cast("int").alias("label"), "i", "j", "k").where("label > 0")


def to_bricks(voxels: DataFrame, low: float, high: float, edge: int = 8) -> DataFrame:
    """``series_id, bi, bj, bk, data``: stored numbers of dense cubes of ``edge`` voxels, i fastest; a group is one brick."""
    brick = [F.floor(F.col(a) / edge).cast("int").alias(f"b{a}") for a in "ijk"]
    cells = voxels.select("series_id", *brick, "k", "j", "i", to_storage(F.col("value"), F.lit(low), F.lit(high)).alias("stored"))
    packed = cells.groupBy("series_id", "bi", "bj", "bk").agg(F.array_sort(F.collect_list(F.struct("k", "j", "i", "stored"))).alias("cells"))
    return packed.select("series_id", "bi", "bj", "bk", F.transform("cells", lambda c: c["stored"]).alias("data"))


#: How example files are stored, by series: (axes of the canonical grid that the stored axes are, which of them are turned round, form, byte order).
LAYOUTS = [((0, 1, 2), (False, False, False), "sform", "<"), ((2, 1, 0), (False, True, False), "sform", "<"), ((0, 1, 2), (True, True, False), "qform", ">"), ((0, 1, 2), (False, False, False), "none", "<")]


def header_bytes(size: list[int], spacing: tuple[float, float, float], layout: tuple, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> bytes:
    """A header of 352 bytes for 16-bit voxels of a canonical grid that is stored by a layout; ``origin`` is the canonical grid's."""
    axes, turned, form, order = layout
    header = bytearray(352)
    struct.pack_into(order + "i", header, 0, 348)
    struct.pack_into(order + "8h", header, 40, 3, *[size[a] for a in axes], 1, 1, 1, 1)
    struct.pack_into(order + "2h", header, 70, 4, 16)
    struct.pack_into(order + "8f", header, 76, 1, *[spacing[a] for a in axes], 1, 1, 1, 1)
    struct.pack_into(order + "3f", header, 108, 352, 1, 0)
    matrix, first = np.zeros((3, 3)), np.array(origin, float)
    for column, (a, t) in enumerate(zip(axes, turned)):
        matrix[a, column] = -spacing[a] if t else spacing[a]
        first[a] += (size[a] - 1) * spacing[a] if t else 0
    back = np.array([-1.0, -1.0, 1.0])  # to right and front
    if form == "sform":
        struct.pack_into(order + "2h", header, 252, 0, 1)
        struct.pack_into(order + "12f", header, 280, *np.column_stack([matrix * back[:, None], first * back]).ravel())
    elif form == "qform":  # no turn: the stored axes run right, front and up
        struct.pack_into(order + "2h", header, 252, 1, 0)
        struct.pack_into(order + "6f", header, 256, 0, 0, 0, *(first * back))
    header[344:348] = b"n+1\0"
    return bytes(header)


def write_volumes(voxels: DataFrame, folder: str, value: str, spacing: tuple[float, float, float], layouts: list = LAYOUTS, packed: bool = False) -> DataFrame:  # noqa: B006
    """A NIfTI-1 file a series of ``series_id, i, j, k, value`` in ``folder``, stored by a layout in turn; gives ``series_id, name``. A volume is one group."""

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        size = [int(frame[a].max()) + 1 for a in "ijk"]
        layout = layouts[key[0] % len(layouts)]
        axes, turned, _, order = layout
        data = np.zeros(size, order + "i2")
        data[frame["i"], frame["j"], frame["k"]] = np.round(frame[value])
        data = np.flip(data.transpose(axes), [n for n, t in enumerate(turned) if t])
        content = header_bytes(size, spacing, layout) + data.tobytes(order="F")
        store, top = file_system(folder)
        store.create_dir(top)
        name = f"{key[0]:08d}.nii" + ".gz" * packed
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            out.write(gzip.compress(content, 1, mtime=0) if packed else content)
        return pd.DataFrame({"series_id": [key[0]], "name": [name]})

    return voxels.select("series_id", "i", "j", "k", value).groupBy("series_id").applyInPandas(write, "series_id long, name string")


def write_documents(rows: DataFrame, folder: str, group: str, fields: list[str]) -> DataFrame:
    """A file of JSON lines for each ``group`` in ``folder``, its rows in order of ``fields``; gives ``group, file``. A group is one file, written line by line."""
    kind = rows.schema[group].dataType.simpleString()
    lines = rows.select(group, F.to_json(F.struct(*fields)).alias("line"), *fields)

    def write(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        store.create_dir(top)
        ids, texts, names = table.column(group).to_pylist(), table.column("line").to_pylist(), []
        for a, b in zip(begins, np.append(begins[1:], table.num_rows)):
            names.append(f"bundle-{ids[a]}.jsonl")
            with store.open_output_stream(f"{top}/{names[-1]}", compression=None) as out:
                for line in texts[a:b]:
                    out.write(line.encode() + b"\n")
        yield pa.record_batch([table.column(group).combine_chunks().take(pa.array(begins)), pa.array(names)], names=[group, "file"])

    return over_groups(lines, [group], fields, write, f"`{group}` {kind}, file string")
