"""Tables as chunks: rows of about a megabyte of text in one compressed Arrow record batch.

Operators that send back to documents what was learned elsewhere address chunks,
not rows: a key that a third of all documents hold is sent to each chunk once, so
no group grows with the copies of a key, and messages are arrays, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .scratch import Scratch

CHUNK_BYTES = 1 << 20


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as got:
        return got.read_next_batch()


def chunked(scratch: Scratch, docs: DataFrame, text: str, name: str, most: int = CHUNK_BYTES) -> DataFrame:
    """A written table (chunk long, rows int, bytes long, blob binary) of all rows of docs."""
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in hashing.slices(batch, at, most):
                size = len(hashing.utf8(part.column(at))[0])
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int64()), "n": pa.array([part.num_rows], pa.int32()), "bytes": pa.array([size], pa.int64()), "blob": pa.array([pack(part)], pa.binary())})
                k += 1

    return scratch.table(docs.mapInArrow(cut, "chunk long, n int, bytes long, blob binary"), name)


def slots_for(chunks: DataFrame, bytes_a_slot: int) -> int:
    """How many slots hold what comes of these chunks, so that each stays bounded at any size."""
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    return max(16, -(-total // bytes_a_slot))
