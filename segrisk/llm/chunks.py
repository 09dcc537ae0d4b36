"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text; a chunk ends where some of its bits are zero, so that the same passage
falls into the same chunks wherever it stands and whatever was inserted before it. Single chunks repeat by chance, so
what is compared are windows: the consecutive chunks from each border up to the first border at least ``min_bytes``
behind it, and those from the last border at least ``min_bytes`` before each border up to it. A window that another
document has too, with all its bytes, belongs to the document with the smallest doc_id, and is a repeat in all others.
Repeated windows that overlap or touch form a passage: each of its bytes lies in a stretch of at least ``min_bytes``
that stands whole in a document with a smaller doc_id, and every such stretch between two borders is part of a passage.

Chunks are short against the passages looked for (about 20 bytes), because the bytes before the first and behind the
last chunk border of a passage do not count. A passage of 50 words is found, with its ends short of up to two chunks.

Windows are searched by 64-bit hashes, which are aggregated with partial results, so a passage that a third of all
documents share costs one row per task. A bitmap of fixed size of the hashes that occur more than once removes most of
the other windows inside the tasks (it lets some through, and never drops a repeat). Those that are left are compared
by 128-bit digests of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrisk.llm.sketch import bitmap, in_bitmap
from segrisk.llm.text import slices, span_hashes, utf8
from segrisk.session import materialise

MASK = np.uint32(0b1111 << 12)  # one position in 16 ends a chunk; these bits see the last 16 bytes
MIN_GAP = 4  # a border needs this many bytes without another one before it
MIN_BYTES = 160
BITMAP_BITS = 26

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
DIGEST_BYTES = 16
HASHES = "doc_id long, hash long"
WINDOWS = "doc_id long, variant long, start long, size long, first_chunk long, n_chunks long, digest binary"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at every byte: ``h = (h << 1) + gear[byte]``, unrolled into doubling steps."""
    h = _GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[reach:] = h[:-reach] << np.uint32(reach)
        h = h + older
    return h


def chunk_borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all chunks; every text begins and ends one, empty texts have none."""
    cut = np.flatnonzero((gear_hashes(data) & MASK) == 0) + 1
    # The hash near the start of a text sees the text before it; borders there would depend on the neighbour.
    inside = cut - offsets[np.searchsorted(offsets, cut, side="left") - 1] >= 16
    whole = cut < len(data)
    whole[whole] = data[cut[whole]] & 0xC0 != 0x80  # not inside a character
    cut = cut[inside & whole]
    cut = cut[np.concatenate((np.ones(min(1, len(cut)), bool), np.diff(cut) > MIN_GAP))]
    ends = np.union1d(cut, offsets[1:][np.diff(offsets) > 0])
    starts = np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))
    return starts, ends


def chunk_windows(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of every window of at least ``min_bytes``, in order. Windows stay inside their text."""
    text = np.searchsorted(offsets, starts, side="right") - 1
    chunk = np.arange(len(starts))
    last = np.searchsorted(ends, starts + min_bytes)
    ahead = last < len(ends)
    ahead[ahead] = text[last[ahead]] == text[ahead]
    first = np.searchsorted(starts, ends - min_bytes, side="right") - 1
    back = first >= 0
    back[back] = text[first[back]] == text[back]
    first, last = np.concatenate((chunk[ahead], first[back])), np.concatenate((last[ahead], chunk[back]))
    return np.divmod(np.unique(first * len(starts) + last), max(1, len(starts)))


def windows(docs: DataFrame, min_bytes: int, known: Broadcast | None = None) -> DataFrame:
    """The hashes of the windows of all documents; with a bitmap the windows whose slot is set, with their digests."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                starts, ends = chunk_borders(data, offsets)
                first, last = chunk_windows(starts, ends, offsets, min_bytes)
                hashes = span_hashes(data, starts[first], ends[last])
                if known is not None:
                    keep = in_bitmap(known.value, hashes)
                    first, last = first[keep], last[keep]
                low, high = starts[first], ends[last]
                text = np.searchsorted(offsets, low, side="right") - 1
                doc_id, variant = (part.column(c).take(pa.array(text)) for c in ("doc_id", "variant"))
                if known is None:
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(hashes.view(np.int64))], names=["doc_id", "hash"])
                    continue
                digests = [
                    hashlib.blake2b(data[a:b], digest_size=DIGEST_BYTES).digest()
                    for a, b in zip(low.tolist(), high.tolist(), strict=True)
                ]
                # Chunks are counted from the first one of the text, wherever a slice begins.
                place = first - np.searchsorted(starts, offsets[text])
                arrays = [low - offsets[text], high - low, place, last - first + 1]
                arrays = [doc_id, variant, *map(pa.array, arrays), pa.array(digests, pa.binary())]
                names = ["doc_id", "variant", "start", "size", "first_chunk", "n_chunks", "digest"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(work, HASHES if known is None else WINDOWS)


def _with_variants(docs: DataFrame) -> DataFrame:
    """The rows with ``variant``: 0, and for a doc_id with several different texts a number of the row's text."""
    number = F.xxhash64("text").bitwiseOR(F.lit(1))  # never 0
    several = docs.groupBy("doc_id").agg(F.min(number).alias("low"), F.max(number).alias("high"))
    several = materialise(several.where("low <> high").select(F.col("doc_id").alias("_several")), "several_texts")
    marked = docs.join(several, F.col("doc_id") == F.col("_several"), "left")
    variant = F.when(F.col("_several").isNull(), F.lit(0).cast("long")).otherwise(number)
    return marked.select("doc_id", "text", variant.alias("variant"))


def repeated_passages(docs: DataFrame, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, variant, start, size, n_chunks) of the repeated passages, in bytes of the UTF-8 text.

    NULL and empty texts have no passages. Rows without doc_id take no part. Rows of one doc_id with the same text
    count as one row. Different texts of one doc_id have passages of their own, told apart by ``variant``, which is 0
    for all other rows. What repeats inside one document, or between rows of one doc_id only, is left alone.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    docs = _with_variants(docs)
    low, high = F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    hashes = windows(docs, min_bytes).groupBy("hash").agg(low, high).where("first <> last")
    own = windows(docs, min_bytes, bitmap(hashes.select("hash"), BITMAP_BITS))
    known = materialise(own.groupBy("digest").agg(low, high).where("first <> last").select("digest", "first"), "repeated_windows")
    repeats = own.join(known, "digest").where(F.col("doc_id") != F.col("first"))
    repeats = repeats.select("doc_id", "variant", "start", F.expr("start + size").alias("end"), "first_chunk", "n_chunks").distinct()
    order = Window.partitionBy("doc_id", "variant").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    repeats = repeats.withColumn("begins", F.when(before >= F.col("start"), 0).otherwise(1))
    runs = repeats.withColumn("run", F.sum("begins").over(order)).groupBy("doc_id", "variant", "run").agg(
        F.min("start").alias("start"),
        (F.max("end") - F.min("start")).alias("size"),
        (F.max(F.col("first_chunk") + F.col("n_chunks")) - F.min("first_chunk")).alias("n_chunks"),
    )
    return runs.select("doc_id", "variant", "start", "size", "n_chunks")


def dedup_substrings(docs: DataFrame, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents with their repeated passages cut out of ``text``, all columns kept.

    A text that consists of repeats becomes the empty text; NULL stays NULL.
    """
    columns = docs.columns
    found = repeated_passages(docs, min_bytes=min_bytes)
    spans = found.groupBy(F.col("doc_id").alias("_id"), "variant").agg(
        F.array_sort(F.collect_list(F.struct("start", "size"))).alias("_spans")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    own_text = F.xxhash64(F.col("row.text").cast("string")).bitwiseOR(F.lit(1))
    same = (F.col("_doc") == F.col("_id")) & ((F.col("variant") == 0) | (F.col("variant") == own_text))
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_doc")).join(spans, same, "left")
    data = F.encode(F.col("row.text").cast("string"), "UTF-8")
    begin = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["start"] + s["size"]))
    end = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.octet_length(data).cast("long")))
    kept = F.zip_with(
        begin, end, lambda a, b: F.decode(F.substr(data, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    )
    text = F.when(F.col("_spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, ""))
    return rows.select("row", text.alias("_text")).select(
        *[F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]
    )
