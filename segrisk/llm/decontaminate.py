"""Benchmark decontamination by multi-pattern search over words (Wu-Manber).

Patterns are the windows of ``WINDOW`` consecutive words of the benchmark items (an item of fewer words is one
pattern). Patterns of one length form a searcher with three tables:

* shift table: for the hash of every block of ``BLOCK`` words, how far the search window can move on because no
  pattern has that block nearer to its end;
* suffix buckets: the patterns whose last block has a given hash, in order of that hash;
* the words of every pattern, compared one by one with the text wherever the shift is 0.

All texts of a slice are searched at the same time, one position each and per step, so every step is an array
operation; a long text is searched as many overlapping stretches.

The tables are broadcast in blocks of at most ``pattern_block`` patterns, so that their size has a bound; a benchmark
with more patterns is searched block by block and the hits of a document are united.

Cases: NULL and empty texts have no words; an item without words is never found; repeated item rows count once and
rows without item id mark words but are not listed; repeated document rows are kept, one result each; other columns
of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from segrisk.llm.text import ALPHANUMERIC, LOWER, mix, slices, span_hashes, utf8, with_text, words

WINDOW = 10
BLOCK = 2
SHIFT_BITS = 20
STRETCH = 512  # words per stretch of a long text
PATTERN_BLOCK = 1 << 18

HITS = "row_id long, doc_id long, n_words long, spans array<long>, items array<long>"


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, lower-cased, and the number of the first word of each text."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, ALPHANUMERIC)
    return span_hashes(data, starts, ends), bounds


def _blocks(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Slot of the shift table for the block of ``size`` words that ends before each of ``ends``."""
    h = np.zeros(len(ends), np.uint64)
    for i in range(size, 0, -1):
        h = mix(h * np.uint64(31) + ids[ends - i])
    return (h >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


class Searcher:
    """Patterns of one length (in words)."""

    def __init__(self, patterns: np.ndarray) -> None:
        self.patterns = patterns
        self.length = patterns.shape[1]
        self.block = min(BLOCK, self.length)
        self.shift = np.full(1 << SHIFT_BITS, self.length - self.block + 1, np.int16)
        flat = patterns.reshape(-1)
        first = np.arange(len(patterns)) * self.length
        for end in range(self.block, self.length + 1):  # later blocks have smaller shifts
            slots = _blocks(flat, first + end, self.block)
            np.minimum.at(self.shift, slots, np.int16(self.length - end))
        suffix = _blocks(flat, first + self.length, self.block)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def find(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of every occurrence inside one text."""
        # Stretches of possible ends: a text of n words has ends length .. n.
        low, high = bounds[:-1] + self.length, bounds[1:] + 1
        count = np.maximum(0, -(-(high - low) // STRETCH))
        text = np.repeat(np.arange(len(low)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        position = low[text] + nth * STRETCH
        stop = np.minimum(position + STRETCH, high[text])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(position):
            slot = _blocks(ids, position, self.block)
            step = self.shift[slot].astype(np.int64)
            at = step == 0
            if at.any():
                found.append(self._compare(ids, position[at], slot[at]))
            position = position + np.maximum(step, 1)
            keep = position < stop
            position, stop = position[keep], stop[keep]
        return np.concatenate([e for e, _ in found]), np.concatenate([p for _, p in found])

    def _compare(self, ids: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.searchsorted(self.suffix, slots)
        size = np.searchsorted(self.suffix, slots, side="right") - left
        who = np.repeat(np.arange(len(ends)), size)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
        pattern = self.order[left[who] + nth]
        for i in range(self.length):
            if not len(who):
                break
            same = self.patterns[pattern, i] == ids[ends[who] - self.length + i]
            who, pattern = who[same], pattern[same]
        return ends[who], pattern


def windows_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words of one window) of the benchmark items."""
    for batch in batches:
        for part in slices(batch, "text"):
            ids, bounds = word_ids(part.column("text"))
            item, window = [], []
            for i, name in enumerate(part.column("item_id").to_pylist()):
                own = ids[bounds[i] : bounds[i + 1]].view(np.int64)
                size = min(WINDOW, len(own))
                for j in range(len(own) - size + 1 if size else 0):
                    item.append(name)
                    window.append(own[j : j + size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(window, pa.list_(pa.int64()))], names=["item_id", "window"]
            )


def pattern_blocks(benchmark: DataFrame, pattern_block: int) -> Iterator[list[Row]]:
    """The distinct windows with the items they belong to, in lists of at most ``pattern_block``."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    windows = items.mapInArrow(windows_of_items, "item_id long, window array<long>")
    patterns = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    block: list[Row] = []
    for row in patterns.toLocalIterator():
        block.append(row)
        if len(block) == pattern_block:
            yield block
            block = []
    yield block


def _searchers(block: list[Row]) -> list[tuple[Searcher, list[list[int]]]]:
    by_length: dict[int, list[Row]] = {}
    for row in block:
        by_length.setdefault(len(row.window), []).append(row)
    return [
        (Searcher(np.array([r.window for r in rows], np.int64).view(np.uint64)), [r["items"] for r in rows])
        for _, rows in sorted(by_length.items())
    ]


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Unite spans; the result is start, end, start, end, ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _search(part: pa.RecordBatch, searchers: list[tuple[Searcher, list[list[int]]]]) -> pa.RecordBatch:
    ids, bounds = word_ids(part.column("text"))
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for searcher, names in searchers:
        ends, patterns = searcher.find(ids, bounds)
        texts = np.searchsorted(bounds, ends, side="left") - 1
        for text, end, pattern in zip(texts.tolist(), ends.tolist(), patterns.tolist(), strict=True):
            end -= int(bounds[text])
            spans.setdefault(text, []).append((end - searcher.length, end))
            items.setdefault(text, set()).update(names[pattern])
    n = part.num_rows
    columns = [
        part.column("row_id"),
        part.column("doc_id"),
        pa.array(np.diff(bounds), pa.int64()),
        pa.array([_merged(spans.get(i, [])) for i in range(n)], pa.list_(pa.int64())),
        pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "n_words", "spans", "items"])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, pattern_block: int = PATTERN_BLOCK) -> DataFrame:
    """Per document row: the words inside benchmark windows and the items they come from.

    Columns: ``doc_id``, ``n_words``, ``spans`` (hit words as start, end, start, end, ... in words) and ``items``.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    parts = []
    for block in pattern_blocks(benchmark, pattern_block):
        shared = spark.sparkContext.broadcast([r.asDict() for r in block])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searchers = _searchers([Row(**r) for r in shared.value])
            for batch in batches:
                for part in slices(batch, "text"):
                    yield _search(part, searchers)

        parts.append(texts.mapInArrow(search, HITS))
    if len(parts) == 1:
        return parts[0].drop("row_id")
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    merged = united.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    unite = F.udf(lambda s: _merged(list(zip(s[::2], s[1::2], strict=True))), "array<long>")
    return merged.select("doc_id", "n_words", unite("spans").alias("spans"), "items")


def with_digests(hits: DataFrame) -> DataFrame:
    """The hit count, the digest of the item ids (as strings, sorted, comma-joined) and the verdict per document."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, pattern_block: int = PATTERN_BLOCK) -> DataFrame:
    """The documents without a benchmark window, all columns kept."""
    spark = docs.sparkSession
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    for block in pattern_blocks(benchmark, pattern_block):
        shared = spark.sparkContext.broadcast([r.asDict() for r in block])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searchers = _searchers([Row(**r) for r in shared.value])
            for batch in batches:
                for part in slices(with_text(batch), "text"):
                    ids, bounds = word_ids(part.column("text"))
                    dirty = np.zeros(part.num_rows, bool)
                    for searcher, _ in searchers:
                        ends, _ = searcher.find(ids, bounds)
                        dirty[np.searchsorted(bounds, ends, side="left") - 1] = True
                    yield part.select(["row"]).filter(pa.array(~dirty))

        rows = rows.mapInArrow(search, rows.schema)
    return rows.select("row.*")
