"""Operator 10: vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.storage import slices
from lumivox.llm.tokens import encoder
from lumivox.plans.scratch import written

PIECE = "piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold: tokens, documents, and attention cost (the sum of its pieces' squared lengths).

    ``choose`` is "dot" for the largest weighted dot product of a piece with a bin's residuals, each as a share of its
    capacity, or "norm" for the least weighted norm of the residuals that are left. The default capacities of documents and
    attention don't bind before the tokens do, as fewer sequences are wanted first, but they have as much say in the choice.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    choose: str = "dot"
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each piece; pieces are taken in the order given, each into the best bin that holds it."""
    full = np.array([limits.tokens, limits.documents, limits.attention], float)
    scale = np.array(limits.weights) / full
    if len(lengths) and (lengths.max() > limits.tokens or lengths.max() ** 2 > limits.attention):
        raise ValueError("a piece is larger than a sequence")
    least = lengths.min() if len(lengths) else 0
    rest = np.empty((256, 3))  # residuals of open bins
    name = np.empty(256, np.int64)
    n = bins = 0
    of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, float(length) ** 2])
        k = -1
        if n:
            fits = np.flatnonzero((rest[:n] >= need).all(axis=1))
            if len(fits):
                if limits.choose == "dot":
                    k = fits[np.argmax((rest[fits] / full) @ (scale * need))]
                else:
                    k = fits[np.argmin((((rest[fits] - need) * scale) ** 2).sum(axis=1))]
        if k < 0:
            if n == len(name):
                rest, name = np.concatenate([rest, np.empty_like(rest)]), np.concatenate([name, np.empty_like(name)])
            rest[n], name[n] = full, bins
            k, n, bins = n, n + 1, bins + 1
        of[i], offset[i] = name[k], limits.tokens - rest[k, 0]
        rest[k] -= need
        if rest[k, 0] < least or rest[k, 1] < 1 or rest[k, 2] < least**2:  # holds no piece any more
            n -= 1
            rest[k], name[k] = rest[n], name[n]
    return of, offset


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, cut only where longer than ``most``.

    A null or empty text is one piece of the end id alone; repeated rows and null ids give pieces like any row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "text"):
            index, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode.encode(text), encode.dtype.type(end_id)).astype("<u4")
                for start in range(0, len(ids), most):
                    part = ids[start : start + most]
                    index.append(i)
                    out.append((start // most, start, len(part), zlib.crc32(part.tobytes())))
            piece, start, length, crc = zip(*out)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(index)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def pack(found: DataFrame, limits: Limits = Limits(), per_task: int = 16_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``.

    Rows are dealt by hash into groups of about ``per_task`` (their count is taken first, so the groups grow in
    number, not in size; rows that are alike are parted by where they are read, so no id fills a group), and each group
    is packed longest first. A group leaves about one sequence unfilled,
    a ten-thousandth of them. ``sequence_id`` is the group's number in the upper half and the bin's in the lower.
    An empty table gives an empty one; every piece, of repeated rows too, is placed once; ties go by doc_id, then piece; columns
    that are called sequence_id or offset are replaced, others pass through.
    """
    found = written(found.drop("sequence_id", "offset"), "pieces")
    groups = max(1, -(-found.count() // per_task))
    salted = found.withColumn("_part", F.floor(F.monotonically_increasing_id() / per_task))
    dealt = salted.repartition(groups, F.xxhash64("doc_id", "piece", "_part")).drop("_part").sortWithinPartitions(F.desc("length"), "doc_id", "piece")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            of, offset = best_fit(table.column("length").to_numpy(), limits)
            table = table.append_column("sequence_id", pa.array(of + (TaskContext.get().partitionId() << 32))).append_column("offset", pa.array(offset))
            yield from table.to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return dealt.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(pieces(docs, tokenizer, end_id, limits.tokens, id_col, text_col), limits)
