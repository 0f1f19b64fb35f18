"""Operator 3: SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.llm.storage import slices
from lumivox.plans.components import connected_components
from lumivox.plans.joins import split_join
from lumivox.plans.scratch import written


#: So many distinct fingerprints make lists of three segments' values longer than the balls of two are large.
DENSE = 1 << 25


def fingerprint(text: str | None, size: int = 4) -> int:
    """The 64-bit SimHash of a whole text over its word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[begin : begin + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(rows: DataFrame, text_col: str = "text", size: int = 4) -> DataFrame:
    """Every row without its text, with ``fp long``: ASCII capitals lowered, words parted by ASCII white space, XXH64 with seed 42."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            found = np.array([fingerprint(t, size) for t in batch.column(text_col).to_pylist()], np.uint64).view(np.int64)
            others = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text_col]
            yield pa.record_batch([*[c for _, c in others], pa.array(found)], names=[*[n for n, _ in others], "fp"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != text_col)
    return rows.mapInArrow(scan, f"{fields}fp long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``(id_col, fp long)`` for every row."""
    return with_fingerprints(docs.select(id_col, text_col), text_col, size)


def _segments(bits: int, number: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment: two fingerprints that differ in ``bits`` or fewer are within the radius in one of them."""
    number = min(number, bits + 1)
    least, rest = divmod(bits, number)
    widths = [64 // number + (i < 64 % number) for i in range(number)]
    return [(sum(widths[:i]), w, least if i <= rest else least - 1) for i, w in enumerate(widths)]


def _ball(low: int, width: int, radius: int) -> list[int]:
    """The masks of up to ``radius`` set bits within a segment, as signed 64-bit numbers."""
    masks = [sum(1 << (low + b) for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column, bits: int, number: int, ball: bool) -> Column:
    """Array of a fingerprint's table keys, the segment's number in the uppermost bits; with ``ball``, of all keys near them."""
    keys = []
    for place, (low, width, radius) in enumerate(_segments(bits, number)):
        for mask in _ball(low, width, radius) if ball else [0]:
            keys.append(F.lit(place << 60).bitwiseOR(_segment(fp.bitwiseXOR(F.lit(mask)), low, width)))
    return F.array(*keys)


def links(fps: DataFrame, bits: int = 4, crowd: int = 4096, number: int = 3) -> DataFrame:
    """Pairs ``(src, dst)`` that connect the distinct fingerprints ``fp`` as the links at ``bits`` or fewer differing bits do.

    Multi-index hashing: each fingerprint is in one table a segment, under its segment's value, and looks up
    the values of a small Hamming ball about it; whole distances are verified within the join, so no row
    is made for a pair that isn't a link. Fewer segments are longer: their balls are larger, their values' lists
    shorter. A value with over ``crowd`` distinct fingerprints would pair up too
    many: fingerprints that look it up are linked by the points half way instead (each emits the ball of
    half the distance and joins the least one there), which grows with their number and loses no connection.
    """
    table = fps.select(F.explode(_keys(F.col("fp"), bits, number, ball=False)).alias("key"), F.col("fp").alias("dst"))
    looks = fps.select(F.explode(_keys(F.col("fp"), bits, number, ball=True)).alias("key"), F.col("fp").alias("src"))
    crowded = written(table.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits
    if crowded.isEmpty():
        return looks.join(table, "key").where((F.col("src") < F.col("dst")) & near).select("src", "dst")
    found = looks.join(crowded, "key", "left_anti").join(table, "key").where((F.col("src") < F.col("dst")) & near).select("src", "dst")
    if bits % 2:
        raise ValueError("an odd number of bits has no half way")
    masks = F.array(*[F.lit(m) for m in _ball(0, 64, bits // 2)])
    packed = looks.join(crowded, "key", "left_semi").select("src").distinct()
    points = packed.select("src", F.explode(F.transform(masks, lambda m: F.col("src").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("src").alias("dst"), F.max("src").alias("other")).where("dst < other").select("point", "dst")
    return found.unionByName(points.join(least, "point").where("src <> dst").select("src", "dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, size: int = 4) -> DataFrame:
    """``(id_col, fingerprint, component_id, root)`` a row: 16 hex digits, the smallest id reachable over links, and the smallest fingerprint.

    Texts with equal fingerprints are one node, so copies are never paired; nothing is ordered, so there are no ties. A null or empty text has fingerprint
    zero and is linked like any other; very long texts are hashed whole, in pieces of bounded memory; repeated rows are all returned; an id with several texts
    has a row for each, in as many groups as they have (``root`` tells them apart); rows with a null id are grouped too but
    never name a group (a group of such rows only has a null one); an empty table gives an empty one; extra
    columns are left out.
    """
    rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    number = 3 if nodes.count() < DENSE else 2
    groups = connected_components(links(nodes.select("fp"), bits, number=number))
    rooted = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(split_join(rooted, names, "root").select("fp", "component_id", "root"), "named")
    shown = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias("fingerprint" if c == "fp" else c)
    return rows.join(named, "fp").select(id_col, shown("fp"), "component_id", shown("root"))
