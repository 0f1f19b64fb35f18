"""Binary files of tasks, on whatever storage the shared folder's URI names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import compute

from lumivox.plans.scratch import file_system as resolve

__all__ = ["attempt_name", "resolve", "slices"]


def attempt_name(part: int) -> str:
    """A file stem that no other attempt of this task uses; the manifest keeps the attempt that was committed."""
    return f"part-{part:05d}-{uuid.uuid4().hex[:12]}"


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the strings of ``column`` fill about ``most_bytes``, one row at least."""
    for batch in batches:
        sizes = compute.binary_length(batch.column(column)).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            total += size or 0
            if total >= most_bytes:
                yield batch.slice(begin, i + 1 - begin)
                begin, total = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)
