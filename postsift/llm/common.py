"""Helpers shared by the operators: text buffers, blocks of documents, keys that blocks share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in one block of documents, the unit that a Python task holds in memory.
BLOCK_BYTES = 8_000_000
#: Bytes of text handled by one run of array operations.
SLICE_BYTES = 1_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def seeded(name: str, n: int) -> np.ndarray:
    """`n` fixed 64-bit numbers that follow from a name."""
    seed = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row is alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def int64_column(column) -> np.ndarray:
    """A bigint column without nulls as numpy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64)


def packed(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays as the rows of a binary column."""
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def unpacked(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column in one array, and the n + 1 offsets in values."""
    data, offsets = text_buffer(column)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), offsets // size


def give_back(cycles: bool = True) -> None:
    """Memory that a Python worker has freed goes back to the system: Spark keeps workers from stage to
    stage, and the allocators of Arrow and of C keep what earlier stages used."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0


def n_blocks(total: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, math.ceil(total / block_bytes))


def blocks(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(block, row_key, row_text): documents spread over `n` blocks by a hash of key and text.

    Only the key, the text and the columns in `more` are kept, so other columns of any name cannot
    clash. Grouping by `block` needs no further shuffle.
    """
    extra = [value.alias(name) for name, value in more.items()]
    rows = docs.select(docs[key].cast("long").alias("row_key"), docs[text].alias("row_text"), *extra)
    block = F.pmod(F.xxhash64("row_key", "row_text"), F.lit(n)).cast("int")
    return rows.select(block.alias("block"), "row_key", "row_text", *more).repartition(n, "block")


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted unsigned keys, cut by value, and the n + 1 offsets of each bucket."""
    cuts = np.array([(i << 64) // n for i in range(1, n)], dtype=_U)
    return np.arange(n), np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))


def block_keys(table: pa.Table, keys_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block and whether two of its documents have the key.

    keys_of(data, offsets, ids) yields (keys, document ids) per slice of the rows.
    """
    found, docs = [np.empty(0, _U)], [np.empty(0, np.int64)]
    for keys, ids in keys_of(table):
        found.append(keys)
        docs.append(ids)
    keys, docs = np.concatenate(found), np.concatenate(docs)
    order = np.argsort(keys)  # the order of equal keys does not matter
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    several = np.zeros(len(first), bool)
    if len(first):
        several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
    return keys[first], several


def shared_keys(parts: DataFrame, keys_of: Callable, n: int) -> DataFrame:
    """(block, bucket, shared): for each block, which of its distinct keys another document has too.

    Keys of 64 bits are dealt to `n` buckets by value. A block sends each of its keys once, so a key
    that a third of all rows have costs one entry per block; a bucket answers with one bit per key,
    in the order of the block's sorted keys. Of a key, 40 bits of its place in the bucket are sent:
    two keys that agree in them are both called shared, about one of a million.
    """

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        keys, several = block_keys(table, keys_of)
        buckets, at = by_bucket(keys, n)
        with np.errstate(over="ignore"):
            place = (keys * _U(n)) >> _U(24)
        full = np.flatnonzero(at[1:] > at[:-1])
        return pa.table({
            "bucket": pa.array(buckets[full], pa.int32()),
            "block": pa.array(np.full(len(full), block), pa.int32()),
            "low": packed([place[at[b] : at[b + 1]].astype(np.uint32) for b in full]),
            "high": packed([(place[at[b] : at[b + 1]] >> _U(32)).astype(np.uint8) for b in full]),
            "several": packed([np.packbits(several[at[b] : at[b + 1]]) for b in full]),
        })

    def answer(table: pa.Table) -> pa.Table:
        low, at = unpacked(table.column("low"), np.uint32)
        keys = low.astype(_U) | (unpacked(table.column("high"), np.uint8)[0].astype(_U) << _U(32))
        flags = [np.unpackbits(np.frombuffer(s, np.uint8), count=int(at[i + 1] - at[i]))
                 for i, s in enumerate(table.column("several").to_pylist())]
        several = np.concatenate([np.empty(0, np.uint8), *flags]).astype(bool)
        order = np.argsort(keys)  # the order of equal keys does not matter
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sizes = np.diff(np.append(first, len(ordered)))
        shared = (sizes > 1) | np.logical_or.reduceat(several[order], first)
        back = np.empty(len(keys), bool)
        back[order] = np.repeat(shared, sizes)
        return pa.table({
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "shared": packed([np.packbits(back[at[i] : at[i + 1]]) for i in range(len(at) - 1)]),
        })

    sent = parts.groupBy("block").applyInArrow(send, "bucket int, block int, low binary, high binary, several binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block int, bucket int, shared binary")


def shared_of_block(table: pa.Table, keys_of: Callable, answers: pa.Table, n: int) -> np.ndarray:
    """The sorted keys of a block that its answers mark as shared."""
    keys, _ = block_keys(table, keys_of)
    _, at = by_bucket(keys, n)
    marks = np.zeros(len(keys), bool)
    for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist()):
        size = int(at[bucket + 1] - at[bucket])
        marks[at[bucket] : at[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=size)
    return keys[marks]


def contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of `keys` are among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys
