"""Operator 1: token ids of a corpus as flat unsigned integer files with 64-bit document offsets.

A folder holds, for each part in ascending order of the id column:
``<part>.bin``  the ids of its documents one after another, little-endian unsigned, 16 or 32 bits wide;
``<part>.off``  one more 64-bit offset than documents: where each begins in the whole corpus, and the end;
``<part>.docs`` the documents' ids, an Arrow file (any type, null too);
and ``manifest.json`` with the width and each part's name, documents, first token and tokens.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.storage import attempt_name, resolve, slices
from lumivox.llm.tokens import encoder
from lumivox.plans.scratch import written

PART = "part int, name string, docs long, tokens long"


class _PartWriter:
    """The three files of one part; the offsets follow when the part's base is known."""

    def __init__(self, folder: str, part: int, id_type: pa.DataType):
        self.store, top = resolve(folder)
        self.store.create_dir(top)
        self.part, self.name, self.docs, self.tokens = part, attempt_name(part), 0, 0
        self.bin = self.store.open_output_stream(f"{top}/{self.name}.bin")
        self.schema = pa.schema([("id", id_type), ("tokens", pa.int64())])
        self.side = self.store.open_output_stream(f"{top}/{self.name}.docs")
        self.ipc = pa.ipc.new_file(self.side, self.schema)

    def add(self, ids: pa.Array, tokens: list[np.ndarray]) -> None:
        self.bin.write(np.concatenate(tokens).tobytes())
        lengths = [len(x) for x in tokens]
        self.ipc.write_batch(pa.record_batch([ids, pa.array(lengths, pa.int64())], schema=self.schema))
        self.docs += len(lengths)
        self.tokens += sum(lengths)

    def close(self) -> pa.RecordBatch:
        self.bin.close()
        self.ipc.close()
        self.side.close()
        return pa.record_batch({"part": pa.array([self.part], pa.int32()), "name": [self.name], "docs": pa.array([self.docs], pa.int64()), "tokens": pa.array([self.tokens], pa.int64())})


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes every whole text, appends ``end_id`` to each document, writes ``folder`` and returns its manifest.

    Rows are range-partitioned by id and sorted, ties by text, so any partition count gives the same corpus.
    A null text counts as empty (its document is the end id alone); a null id sorts first; repeated rows are
    all written, and rows that repeat an id are in one part, as its order of texts is; an empty table gives no part. Other columns are left out before the shuffle.
    A task writes under a name of its own and commits a manifest row, so lost or repeated attempts leave at
    most a stray file. Only one row a part reaches the driver, which sums them into the parts' bases.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(tokenizer), None
        for batch in slices(batches, "text"):
            writer = writer or _PartWriter(folder, TaskContext.get().partitionId(), batch.column("id").type)
            writer.add(batch.column("id"), [np.append(encode.encode(t), encode.dtype.type(end_id)) for t in batch.column("text").to_pylist()])
        if writer:
            yield writer.close()

    parts = [r.asDict() for r in written(rows.mapInArrow(write, PART), "parts").orderBy("part").collect()]
    base = 0
    for p in parts:
        p["base"], base = base, base + p["tokens"]
    manifest = {"width": encoder(tokenizer).dtype.itemsize, "id_type": rows.schema["id"].dataType.simpleString(), "tokens": base, "parts": parts}

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = resolve(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                lengths = _sidecar(store, f"{top}/{parts[i]['name']}.docs").column("tokens").to_numpy()
                ends = np.concatenate([[0], np.cumsum(lengths, dtype="<u8")]).astype("<u8") + np.uint64(parts[i]["base"])
                with store.open_output_stream(f"{top}/{parts[i]['name']}.off") as out:
                    out.write(ends.tobytes())
            yield batch

    if parts:
        docs.sparkSession.range(len(parts), numPartitions=len(parts)).mapInArrow(offsets, "id long").count()
    store, top = resolve(folder)
    store.create_dir(top)
    with store.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _sidecar(store, path: str) -> pa.Table:
    with store.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def _mapped(store, path: str, dtype: str) -> np.ndarray:
    """The numbers of a file, memory-mapped where storage is a mounted file system."""
    if store.type_name == "local":
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """One row a document, from the files alone: its id, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``.

    ``start`` is the tokens of all documents before it; the checksum is of its ids as 32-bit little-endian
    numbers. Each part is one task that maps the part's files and reads its documents in turn.
    """
    store, top = resolve(folder)
    with store.open_input_stream(f"{top}/manifest.json") as f:
        manifest = json.loads(f.read())
    parts, width = manifest["parts"], manifest["width"]
    schema = f"doc_id {manifest['id_type']}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = resolve(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                stem = f"{top}/{parts[i]['name']}"
                names = _sidecar(store, f"{stem}.docs").column("id").combine_chunks()
                tokens, offsets = _mapped(store, f"{stem}.bin", f"<u{width}"), _mapped(store, f"{stem}.off", "<u8").astype(np.int64)
                for begin in range(0, len(names), 1000):
                    at = offsets[begin : begin + 1001]
                    rows = [tokens[a:b].astype("<u4") for a, b in zip(at[:-1] - offsets[0], at[1:] - offsets[0])]
                    columns = [names.slice(begin, 1000), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64())]
                    if ids:
                        columns.append(pa.array([r.astype(np.int64) for r in rows], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    if not parts:
        return spark.createDataFrame([], schema)
    return spark.range(len(parts), numPartitions=len(parts)).mapInArrow(read, schema)
