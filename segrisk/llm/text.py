"""Texts of an Arrow batch as one byte array, their words, and 64-bit hashes of words.

All functions work on a whole batch with array operations. A batch is first cut into slices of a few megabytes of
text, so that the memory of a task does not depend on the number or the length of the rows in a batch (a single text
that is longer than a slice is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 2_000_000
BATCH_ROWS = 1000  # texts are long: Spark's default of 10,000 rows makes batches of many megabytes
HASH_WORDS = 131_072  # words hashed at a time

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words: everything but white space, and letters, digits and all characters beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``limit`` bytes of text in ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes.astype(np.int64) + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def small_batches(spark: SparkSession) -> None:
    """Let Spark send Arrow batches of few rows to the tasks of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def with_text(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Batches of one struct column ``row``, with its field ``text`` as a second column; nothing is copied."""
    row = rows.column("row")
    text = pc.struct_field(row, "text").cast(pa.string())
    return pa.RecordBatch.from_arrays([row, text], names=["row", "text"])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the offset of each text; NULL is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes, and the number of the first word of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 21)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order. The same bytes give the same hash everywhere."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), HASH_WORDS):
        s, e = starts[a : a + HASH_WORDS], ends[a : a + HASH_WORDS]
        low, high = int(s[0]), int(e[-1])
        powers, inverses = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[low:high]] * powers[: high - low], out=sums[1:])
        out[a : a + HASH_WORDS] = (sums[e - low] - sums[s - low]) * inverses[s - low]
    return mix(out + (ends - starts).astype(np.uint64))


def chain(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive values, also of those across texts."""
    n = max(0, len(values) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[i : i + n])
    return out
