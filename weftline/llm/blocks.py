"""Blocks of documents: neighbouring rows that one task reads together, whole texts, about
BLOCK_BYTES of text each. A block is made where its rows are read, so texts are not
shuffled and no key, source or group of copies can make one large; a text larger than a
block is a block's only load. A block's id is a hash of what it holds, so that rows which a lost
executor's task reads anew in another order can't be taken for the block they are not."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext

#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20


def in_blocks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[int, pa.Table]]:
    """(block, rows): a task's rows in order, cut where a block would have more than `most` bytes of text."""
    first = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = made = 0
    for batch in batches:
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, ends[at] + most - size, "right")) - 1
            if end <= at and not held:
                end = at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(ends[end] - ends[at])
                at = end
            if at < batch.num_rows:
                yield first + made, pa.Table.from_batches(held)
                held, size, made = [], 0, made + 1
    if held:
        yield first + made, pa.Table.from_batches(held)


def released() -> None:
    """Gives the memory that a block took back to the machine: a worker lives on, idle or at other stages' work, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
    if trim is not None:
        trim(0)


def block_id(place: int, *data: bytes) -> int:
    """A 64-bit id for a block's data, told apart from equal data by the block's place."""
    h = xxhash.xxh3_64(place.to_bytes(8, "little"))
    for x in data:
        h.update(x)
    return h.intdigest() - 2**63


def ipc(table: pa.Table | pa.RecordBatch) -> bytes:
    """The table as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: pa.Scalar | bytes) -> pa.Table:
    return pa.ipc.open_stream(data if isinstance(data, bytes) else data.as_buffer()).read_all()


def squeezed(numbers: np.ndarray) -> bytes:
    """Sorted unsigned numbers: differences, byte by byte of all of them, compressed."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    raw = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2**32, byte by byte of all of them, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def from_planes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)
