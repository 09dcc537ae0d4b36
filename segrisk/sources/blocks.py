"""Documents that no line structure splits, read by many tasks: JSON collections, and CSV with quoted line breaks.

A file is read in blocks, the splits of Spark's text reader, whose records end at a byte that is frequent and never
part of a longer character. Whether a block starts inside a string, and how deep, follows from the blocks before it:
every block is first reduced to one row, how it changes the state, and running sums over these rows per file give the
state at the start of each block. Then every block is cut on its own. What crosses a border comes out as fragments,
which are put together by a join of neighbours; only these rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segrisk.session import materialise

QUOTE, BACKSLASH, OPEN, CLOSE, NEWLINE = b'"\\{}\n'

# What a task cuts out of a block: whole items, and at its borders the end of one, the start of one, or neither.
WHOLE, TAIL, MIDDLE, HEAD = range(4)
CUT = "file long, block long, kind int, text string"


def _records(spark: SparkSession, path: str, end: str) -> DataFrame:
    """The text between ends, in order within a task, with the file and the block that it is from."""
    rows = spark.read.text(path, lineSep=end)
    return rows.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _by_block(batches: Iterator[pa.RecordBatch], end: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(file, block, bytes of several records) in order; the last record of a file gets an end, too."""
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        values = batch.column("value").cast(pa.binary())
        borders = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(file)], strict=True):
            if b > a:
                yield int(file[a]), int(block[a]), end.join(values[a:b].to_pylist()) + end


def json_structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of braces outside strings, +1 or -1 for each, and whether the end is inside a string.

    ``data`` neither starts nor ends within an escape, because a brace never follows a backslash that escapes it.
    """
    escape = np.flatnonzero(data == BACKSLASH)
    if len(escape):
        # In a run of backslashes every second one is escaped itself; an odd run escapes what follows.
        first = np.concatenate(([True], np.diff(escape) != 1))
        start = np.maximum.accumulate(np.where(first, escape, 0))
        active = escape[(escape - start) % 2 == 0]
        data = data.copy()
        data[np.minimum(active + 1, len(data) - 1)] = ord("x")
    in_string = (np.cumsum(data == QUOTE) + inside) % 2 == 1
    at = np.flatnonzero(((data == OPEN) | (data == CLOSE)) & ~in_string)
    return at, np.where(data[at] == OPEN, 1, -1), bool(in_string[-1]) if len(data) else inside


def _json_changes(records: DataFrame) -> DataFrame:
    """Per block and for either state at its start: whether strings flip, and by how much the depth changes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for file, block, text in _by_block(batches, b"}"):
            state = found.setdefault((file, block), [[False, 0], [True, 0]])
            for one in state:
                _, step, one[0] = json_structure(np.frombuffer(text, np.uint8), one[0])
                one[1] += int(step.sum())
        rows = [(*key, int(out[0]), out[1], inside[1]) for key, (out, inside) in found.items()]
        names = ["file", "block", "flips", "outside", "inside"]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)

    schema = pa.schema([(n, pa.int64()) for n in ("file", "block", "flips", "outside", "inside")])
    return records.mapInArrow(work, "file long, block long, flips long, outside long, inside long")


def _with_states(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records with the state at the start of their block. ``states`` has one row per block, as the reader has splits."""
    return records.join(F.broadcast(states), ["file", "block"])


def _before(column: str) -> Column:
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(order), F.lit(0))


def _put_together(cut: DataFrame) -> DataFrame:
    """The text of every item: whole ones as they are, others from their fragments in neighbouring blocks."""
    fragments = materialise(cut.where(F.col("kind") != WHOLE), "fragments")
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == TAIL, 1).otherwise(0))
    number = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order)
    parts = fragments.withColumn("item", number).groupBy("file", "item")
    ordered = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = parts.agg(F.concat_ws("", F.transform(ordered, lambda p: p["text"])).alias("text"))
    return cut.where(F.col("kind") == WHOLE).select("text").unionByName(joined.select("text"))


def _cut(records: DataFrame, end: bytes, cutter: Callable) -> DataFrame:
    """Items and fragments of each block; ``cutter(row state)`` makes an object with ``feed`` and ``rest``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tool = None, None

        def out(key: tuple[int, int], items: list[tuple[int, bytes]]) -> pa.RecordBatch:
            columns = [[key[0]] * len(items), [key[1]] * len(items), [k for k, _ in items], [t.decode() for _, t in items]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "kind", "text"])

        for batch in batches:
            at = 0
            for file, block, text in _by_block([batch], end):
                if (file, block) != current:
                    if tool:
                        yield out(current, tool.rest())
                    at = int(np.flatnonzero((batch["file"].to_numpy() == file) & (batch["block"].to_numpy() == block))[0])
                    current, tool = (file, block), cutter({n: batch[n][at].as_py() for n in batch.schema.names[3:]})
                yield out(current, tool.feed(text))
        if tool:
            yield out(current, tool.rest())

    return records.mapInArrow(work, CUT)


class _Items:
    """Cuts a stream of bytes at given borders, and tells the fragments at both ends of the block."""

    def __init__(self, within: bool) -> None:
        self.within = within  # an item is open
        self.began_here = False
        self.pending: list[bytes] = []

    def take(self, text: bytes, borders: list[tuple[int, bool]]) -> list[tuple[int, bytes]]:
        """``borders``: offsets at which an item begins (true) or has ended (false), in order."""
        found, at = [], 0
        for offset, begins in borders:
            if begins:
                self.within, self.began_here, self.pending, at = True, True, [], offset
            elif self.within:
                found.append((WHOLE if self.began_here else HEAD, b"".join([*self.pending, text[at:offset]])))
                self.within, self.pending, at = False, [], offset
        if self.within:
            self.pending.append(text[at:])
        return found

    def rest(self) -> list[tuple[int, bytes]]:
        if not self.within:
            return []
        return [(TAIL if self.began_here else MIDDLE, b"".join(self.pending))]


class _Features(_Items):
    """Objects one level below the document."""

    def __init__(self, state: dict) -> None:
        super().__init__(state["depth"] >= 2)
        self.inside, self.depth = state["parity"] == 1, state["depth"]

    def feed(self, text: bytes) -> list[tuple[int, bytes]]:
        at, step, self.inside = json_structure(np.frombuffer(text, np.uint8), self.inside)
        depth = self.depth + np.cumsum(step)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        begins, ends = at[(step == 1) & (depth == 2)], at[(step == -1) & (depth == 1)] + 1
        borders = [(o, True) for o in begins.tolist()] + [(o, False) for o in ends.tolist()]
        return self.take(text, sorted(borders))


def scan_objects(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of every object that lies directly in a member of a JSON document (of one document per file)."""
    records = _records(spark, path, "}")
    changes = materialise(_json_changes(records), "block_changes")
    parity = changes.withColumn("parity", _before("flips") % 2)
    change = F.when(F.col("parity") == 1, F.col("inside")).otherwise(F.col("outside"))
    states = parity.withColumn("change", change).withColumn("depth", _before("change")).select("file", "block", "parity", "depth")
    rows = _with_states(records, states).select("value", "file", "block", "parity", "depth")
    return _put_together(_cut(rows, b"}", _Features))


class _Lines(_Items):
    """Lines of which line breaks within quotes are a part."""

    def __init__(self, state: dict) -> None:
        super().__init__(state["parity"] == 1)
        self.inside = self.within
        self.fresh = not self.within

    def feed(self, text: bytes) -> list[tuple[int, bytes]]:
        data = np.frombuffer(text, np.uint8)
        quoted = (np.cumsum(data == QUOTE) + self.inside) % 2 == 1
        self.inside = bool(quoted[-1])
        ends = (np.flatnonzero((data == NEWLINE) & ~quoted) + 1).tolist()
        begins = ([0] if self.fresh else []) + [e for e in ends if e < len(data)]
        self.fresh = bool(ends) and ends[-1] == len(data)
        borders = [(o, 1) for o in begins] + [(o, 0) for o in ends]  # a line ends before the next one begins
        return self.take(text, [(o, bool(kind)) for o, kind in sorted(borders)])


def scan_quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of every record of a CSV file whose quoted values may contain line breaks (with its own line break)."""
    records = _records(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    changes = materialise(records.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")), "block_changes")
    states = changes.select("file", "block", (_before("quotes") % 2).alias("parity"))
    return _put_together(_cut(_with_states(records, states).select("value", "file", "block", "parity"), b"\n", _Lines))
