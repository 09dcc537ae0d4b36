"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the shortest string that has not been a phrase before (LZ78). Texts that compress
well together share many phrases, so the Jaccard similarity of their phrase sets is a distance like that of
compressors, and minimum hashes estimate it: the phrase hashes are dealt into ``BINS`` bins by their high bits, the
smallest of each bin is kept, and empty bins borrow from the next full one. Likeness is the share of equal bins.

A fingerprint is ``BINS`` groups of four hexadecimal digits, and empty for a text without characters; two empty
fingerprints have likeness 1, an empty and another 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.llm.text import mix, slices, span_hashes

BINS = 128
RESTART_BYTES = 1 << 20  # longer texts are parsed in parts with a new dictionary each, which bounds its memory


def phrase_hashes(data: bytes) -> np.ndarray:
    """A hash of every phrase of the LZ78 parse; the last, unfinished phrase counts too."""
    cuts: list[int] = []
    for low in range(0, len(data), RESTART_BYTES):
        root: dict = {}
        node = root
        for i, c in enumerate(data[low : low + RESTART_BYTES], low + 1):
            following = node.get(c)
            if following is None:
                node[c] = {}
                cuts.append(i)
                node = root
            else:
                node = following
        if node is not root:
            cuts.append(min(low + RESTART_BYTES, len(data)))
    ends = np.array(cuts, np.int64)
    return span_hashes(np.frombuffer(data, np.uint8), np.concatenate(([0], ends[:-1])), ends)


def signature(text: str | None) -> np.ndarray:
    """16 bits per bin, or nothing for a text without characters."""
    if not text:
        return np.zeros(0, np.uint16)
    hashes = np.sort(phrase_hashes(text.encode()))
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (hashes >> shift).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    # The bin of each position, or the next full one around the ring; how far is part of the value.
    at = np.searchsorted(full, np.arange(BINS)) % len(full)
    far = (full[at] - np.arange(BINS)) % BINS
    return (mix(hashes[first[at]] + far.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def as_text(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets, 0 to 1."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    return float(np.mean(x == y))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per document row; NULL is the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [as_text(signature(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "fingerprint"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(work, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many characters of the following one, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _ranges(docs: DataFrame) -> tuple[Broadcast, Broadcast]:
    """Bounds that cut the ids into ranges, and the head of each range (its largest id) with the range before it."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)
    bounds = np.array(sorted({min(int(c), 2**63 - 1) for c in cuts}), np.int64)
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_range(ids.to_numpy(), shared.value), dtype="int32")

    heads = docs.select("id").groupBy(range_of("id").alias("range")).agg(F.max("id").alias("id"))
    first = sorted((r["range"], r["id"]) for r in heads.toLocalIterator())
    return shared, spark.sparkContext.broadcast({top: first[i - 1][0] for i, (_, top) in enumerate(first)})


def _range(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """0 for the largest ids, and so on."""
    return len(bounds) - np.searchsorted(bounds, ids, side="left")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next row is
    the one after it by descending doc_id, then by text; after the last comes the first. Rows without doc_id come
    last; NULL is the empty text; other columns are ignored.

    Rows are dealt into ranges of doc_id, whose number is that of the shuffle partitions. The head of each range is
    also sent to the range before, and that of the first range to the last, so texts are moved once and no task sees
    more than its own range and one row.
    """
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    shared, before = _ranges(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_numpy()
                again = np.flatnonzero([i in before.value for i in ids.tolist()])
                to = [before.value[i] for i in ids[again].tolist()]
                where = np.concatenate((_range(ids, shared.value), to)).astype(np.int32)
                rows = part.take(pa.array(np.concatenate((np.arange(len(ids)), again)).astype(np.int64)))
                arrays = [pa.array(where), pa.array(np.arange(len(where)) >= len(ids)), *rows.columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["range", "lead", *rows.schema.names])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one has not come yet
        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch, "text"):
                for row in part.select(["range", "lead", "doc_id", "text"]).to_pylist():
                    own = signature(row["text"])
                    if held and held["range"] == row["range"]:
                        out.append(_compared(held, row["text"], own))
                    held = None if row["lead"] else row | {"own": own}
            columns = list(zip(*out, strict=True)) or [()] * len(RESULT.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)

    dealt = docs.mapInArrow(deal, "range int, lead boolean, id long, doc_id long, text string")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", "lead", F.desc("id"), "text")
    return ordered.mapInArrow(
        pair,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [(c, pa.float64()) for c in ("near_edited", "near_next")]
)


def _compared(row: dict, following: str, following_signature: np.ndarray) -> tuple:
    text = edited(row["text"], following)
    changed = signature(text)
    digest = hashlib.sha256(text.encode()).hexdigest()
    near = likeness(row["own"], changed), likeness(row["own"], following_signature)
    return (row["doc_id"], len(row["text"]), digest, as_text(row["own"]), as_text(changed), *near)
