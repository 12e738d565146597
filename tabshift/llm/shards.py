"""Packed exchanges: numpy records travel as one binary row for each (batch, shard), so the JVM moves bytes, not rows.

A map step returns ``(shard, payload)`` rows; ``exchange`` deals them out so that a shard is one partition; the reduce step
gets all payloads of its shard as one array. Shards are many (see ``common.shard_count``), so a shard's array stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "shard int, payload binary"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deal(shard: np.ndarray, records: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Records by shard, in their given order within each."""
    order = np.argsort(shard, kind="stable")
    shard, records = shard[order], records[order]
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(shard)]
    return [int(shard[s]) for s in starts], [records[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]


def packed_batch(shard: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    ids, blobs = deal(shard, records)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "payload"])


def exchange(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartitionById(n, packed["shard"])


def runs_of(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("payload"))
        for blob in column:
            yield np.frombuffer(blob.as_buffer(), dtype)


def whole_shard(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    runs = list(runs_of(batches, dtype))
    return np.concatenate(runs) if runs else np.empty(0, dtype)


def reduce_shards(packed: DataFrame, n: int, dtype: np.dtype, step: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = whole_shard(batches, dtype)
        if len(records):
            yield from step(records)

    return exchange(packed, n).mapInArrow(run, schema)
