"""Tables of a fixed size that tasks fill and a driver or all tasks can hold: sums of counters, and bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "block long, values binary"


def partial_blocks(counters: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """The non-zero blocks of a task's counters, packed."""
    for a in range(0, len(counters), 64 * block):
        rows = [(i // block, counters[i : i + block]) for i in range(a, min(a + 64 * block, len(counters)), block)]
        rows = [(i, v) for i, v in rows if v.any()]
        arrays = [pa.array([i for i, _ in rows], pa.int64()), pa.array([_packed(v) for _, v in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["block", "values"])


def _packed(values: np.ndarray) -> bytes:
    """A byte per value; those that do not fit in one are 0 there, and follow with their places behind."""
    low = values.astype(np.uint8)
    at = np.flatnonzero(values != low)
    low[at] = 0
    return np.int64(len(values)).tobytes() + low.tobytes() + at.astype(np.int32).tobytes() + values[at].astype(np.int64).tobytes()


def _add_packed(total: np.ndarray | None, values: bytes) -> np.ndarray:
    n = int(np.frombuffer(values, np.int64, 1)[0])
    if total is None:
        total = np.zeros(n, np.int64)
    total += np.frombuffer(values, np.uint8, n, 8)
    more = (len(values) - 8 - n) // 12
    total[np.frombuffer(values, np.int32, more, 8 + n)] += np.frombuffer(values, np.int64, more, 8 + n + 4 * more)
    return total


def sum_blocks(partial: DataFrame) -> DataFrame:
    """The sum of the partial blocks as 64-bit counts. A task holds the totals of its own blocks only."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[block] = _add_packed(sums.get(block), values)
        if sums:
            arrays = [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "values"])

    return partial.repartition("block").mapInArrow(total, BLOCKS)


def bitmap(values: DataFrame, bits: int) -> Broadcast:
    """A bitmap of ``2 ** bits`` slots with those of all ``values`` (one column of longs, slot: the low bits) set."""
    name = values.columns[0]
    slot = F.col(name).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark's positions count from 1
    parts = values.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    found = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        found[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return values.sparkSession.sparkContext.broadcast(found)


def in_bitmap(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values have their slot set: all that were put in, and few others."""
    slot = values & np.uint64(8 * len(found) - 1)
    return (found[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
