"""Hard negatives of positive pairs, by slots between the positives' upper limits.

A negative of a pair (anchor, positive) must score between 30 % and 90 % of the positive's score. The windows of an
anchor's positives overlap, so they are not searched one by one: their upper limits cut the scores into disjoint slots,
and every row of another label falls into at most one slot of an anchor. Tasks keep the best rows per anchor and slot,
which are combined after the shuffle in the same way. The best rows below a limit are then those of its slot and of all
slots below it, merged downwards, and the lower limit ends the list.

Anchors are taken in blocks of ``ANCHOR_BLOCK``; the vectors of one block are all that is ever broadcast. Each block
reads the rows twice, once for the positives and once for the negatives.

Cases: a row takes part if it has a vec_id, a label, and a vector without NULL, NaN or infinite components; vectors of
different lengths are not compared. Repeated rows take part as often as they occur, and are returned as often. An id
is one anchor, also when its rows are repeated (if they differ, the one with the smallest label, then vector), and no
row of that id is its positive or negative. An anchor without positives, or a pair without negatives, has no rows.
Scores beyond 64 bits are set to the largest or smallest 64-bit number. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrisk.session import materialise, new_path

ANCHOR_BLOCK = 32_768
TILE_ROWS, TILE_ANCHORS = 2048, 512  # rows and anchors scored together
LONG = np.iinfo(np.int64)
KEPT = "anchor long, slot int, vec_id long, score long"
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


@dataclass(frozen=True)
class Rule:
    """Which rows are anchors, how many positives and negatives there are, and the window in hundredths."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def usable_rows(embeddings: DataFrame, relabel_every: int | None = None, labels: int = 10) -> DataFrame:
    """The rows that take part: vec_id, label, vector of doubles.

    With ``relabel_every`` the label of each row whose id it divides becomes the next of the ``labels`` labels.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    if relabel_every:
        label = F.when(vec_id % relabel_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(vec_id.alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256 * vectors)


class Block:
    """The anchors of one block by vector length: ids, labels, vectors, limits between their slots, lowest score.

    ``windows`` has the lower and upper ends of the windows of each anchor; an anchor without any is left out.
    """

    def __init__(self, anchors: list, windows: dict[int, list[tuple[int, int]]]) -> None:
        self.groups: dict[int, tuple[np.ndarray, ...]] = {}
        by_length: dict[int, list] = {}
        for row in anchors:
            if row["anchor"] in windows:
                by_length.setdefault(len(row["vector"]), []).append(row)
        for length, own in by_length.items():
            uppers = [sorted({high for _, high in windows[row["anchor"]]}, reverse=True) for row in own]
            most = max(map(len, uppers))
            self.groups[length] = (
                np.array([row["anchor"] for row in own], np.int64),
                np.array([row["label"] for row in own], np.int64),
                quantised(np.array([row["vector"] for row in own], np.float64).reshape(len(own), length)),
                np.array([u + [LONG.min] * (most - len(u)) for u in uppers], np.int64),
                np.array([min(low for low, _ in windows[row["anchor"]]) for row in own], np.int64),
            )


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers, exactly; one row of the result per anchor."""
    size = [float(np.abs(x).max(initial=0)) for x in (rows, anchors)]
    if size[0] * size[1] * rows.shape[1] < 2**53:  # sums of doubles are exact
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (anchors, rows)]
    return np.clip(whole[0] @ whole[1].T, LONG.min, LONG.max).astype(np.int64)


class Best:
    """The best rows of one task per anchor and slot: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, slots: int, keep: int) -> None:
        self.ids, self.keep, self.slots = ids, keep, slots
        self.worst = np.full((len(ids), slots), LONG.min)  # scores below this are not needed any more
        self.rows = [np.zeros(0, np.int64) for _ in range(3)]  # place (anchor and slot), score, vec_id

    def add(self, place: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        place, score, vec_id = (np.concatenate(x) for x in zip(self.rows, (place, score, vec_id), strict=True))
        order = np.lexsort((vec_id, ~score, place))
        place = place[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        kept = nth < self.keep
        last = order[nth == self.keep - 1]
        self.worst.reshape(-1)[place[nth == self.keep - 1]] = score[last]
        self.rows = [place[kept], score[order][kept], vec_id[order][kept]]

    def batch(self) -> pa.RecordBatch:
        place, score, vec_id = self.rows
        arrays = [
            pa.array(self.ids[place // self.slots]), pa.array((place % self.slots).astype(np.int32)),
            pa.array(vec_id), pa.array(score),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["anchor", "slot", "vec_id", "score"])


def few_of_equal_rows(vec_id: np.ndarray, label: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """The rows but for those that have ``keep`` other ids with the same vector and label before them."""
    data = np.ascontiguousarray(np.column_stack((label.astype(np.float64), vectors)))
    _, group = np.unique(data.view(np.dtype((np.void, data.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((vec_id, group))
    group, ids = group[order], vec_id[order]
    number = np.cumsum(np.diff(ids, prepend=-1) != 0) + group  # grows with every new id; never mixes groups
    nth = number - number[np.searchsorted(group, group)]
    return np.sort(order[nth < keep])


def _best_rows(rows: DataFrame, block: Broadcast, keep: int, same_label: bool) -> DataFrame:
    """Per task, anchor and slot the best rows of the same label, or of other labels: columns of ``KEPT``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            lists = batch.column("vector")
            lengths = np.diff(lists.offsets.to_numpy())
            for length in np.unique(lengths).tolist():
                if length not in block.value.groups:
                    continue
                ids, labels, anchors, bounds, floor = block.value.groups[length]
                own = batch.filter(pa.array(lengths == length))
                vec_id, label = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
                vectors = quantised(own.column("vector").flatten().to_numpy().reshape(len(vec_id), length))
                few = few_of_equal_rows(vec_id, label, vectors, keep + 1)  # an anchor leaves out its own id
                vec_id, label, vectors = vec_id[few], label[few], vectors[few]
                found = best.setdefault(length, Best(ids, bounds.shape[1], keep))
                for a in range(0, len(ids), TILE_ANCHORS):
                    some = slice(a, a + TILE_ANCHORS)
                    for b in range(0, len(vec_id), TILE_ROWS):
                        part = slice(b, b + TILE_ROWS)
                        score = scores(vectors[part], anchors[some])
                        wanted = (labels[some, None] == label[part]) == same_label
                        wanted &= ids[some, None] != vec_id[part]
                        wanted &= (score >= floor[some, None]) & (score <= bounds[some, :1])
                        i, j = np.nonzero(wanted)
                        value = score[i, j]
                        slot = (value[:, None] <= bounds[some][i, 1:]).sum(1)
                        needed = value >= found.worst[i + a, slot]
                        i, j, value, slot = i[needed], j[needed], value[needed], slot[needed]
                        if len(i):
                            found.add((i + a) * found.slots + slot, value, vec_id[part][j])
        for one in best.values():
            yield one.batch()

    return rows.mapInArrow(work, KEPT)


def _first(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each key by score and id, with their number ``name``."""
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def hard_negatives(rows: DataFrame, rule: Rule | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``usable_rows``."""
    rule = rule or Rule()
    spark = rows.sparkSession
    anchors = rows.where(F.col("vec_id") % rule.every == 0).groupBy(F.col("vec_id").alias("anchor"))
    anchors = materialise(anchors.agg(F.min(F.struct("label", "vector")).alias("a")).select("anchor", "a.*"), "anchors")
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    path = new_path(spark, "negatives")
    for i in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == i).collect()
        _block(rows, own, rule).write.parquet(f"{path}/block_{i}")
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(path)


def _block(rows: DataFrame, anchors: list, rule: Rule) -> DataFrame:
    """The result for the anchors of one block."""
    context = rows.sparkSession.sparkContext
    anything = {row["anchor"]: [(LONG.min, LONG.max)] for row in anchors}
    found = _best_rows(rows, context.broadcast(Block(anchors, anything)), rule.positives, same_label=True)
    exact = F.col("score").cast("decimal(20,0)")
    own_slot = Window.partitionBy("anchor").orderBy(F.desc("high"))
    windows = _first(found, ["anchor"], rule.positives, "nth").select(
        "anchor",
        "nth",
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.ceil(exact * rule.low / 100).cast("long").alias("low"),
        F.floor(exact * rule.high / 100).cast("long").alias("high"),
    )
    windows = windows.where("low <= high").withColumn("own_slot", F.dense_rank().over(own_slot) - 1)
    windows = materialise(windows, "windows")
    limits: dict[int, list[tuple[int, int]]] = {}
    for row in windows.select("anchor", "low", "high").toLocalIterator():
        limits.setdefault(row["anchor"], []).append((row["low"], row["high"]))
    best = _best_rows(rows, context.broadcast(Block(anchors, limits)), rule.negatives, same_label=False)
    best = _first(best, ["anchor", "slot"], rule.negatives, "_place")
    # From the slot of its own limit downwards to its lower limit is all that a window needs.
    merged = windows.join(best, "anchor").where("slot >= own_slot AND score >= low")
    return _first(merged, ["anchor", "nth"], rule.negatives, "rank").select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
