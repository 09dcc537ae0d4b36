"""Licence scan by lookup of canonical digests.

A text is brought to canonical forms: without copyright lines or paragraphs, in lower case, as words without punctuation, with
equivalent spellings made one. Its digest is then joined with the digests of the known licence texts, brought to the
same form. Only entire texts match: the whole document, each of its blocks (cut at empty lines), each run of consecutive
blocks that has as many words as some known text, and each of its lines. Lines that are just a licence's title are
left out like copyright lines. The form without copyright paragraphs does not depend on where lines end.

Known texts are a table (license_id, text); ``known_licenses`` has common licences and the usual notices.

Cases: NULL and empty texts have no units, nor do units without words match; several licences with the same digest
are all reported; repeated rows get a result each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrisk.llm.license_texts import EQUIVALENT, TEXTS, TITLES
from segrisk.llm.text import slices

_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"(?:copyright|\(c\)|©|all rights reserved)(?:\s|\W|\d|$)")
STATEMENT_WORDS = 30  # a longer paragraph is not a copyright statement, even if it begins as one
FULL = Path(__file__).parent / "full_licenses"  # entire texts of the longer licences
DOCUMENT, BLOCK, LINE = "document", "block", "line"


def canonical(lines: list[str]) -> str:
    """The canonical form of a text given by its lines in lower case."""
    words = []
    for line in lines:
        if not _COPYRIGHT.match(line.lstrip(" \t*#/-")):
            own = [EQUIVALENT.get(w, w) for w in _WORD.findall(line)]
            words += [] if " ".join(own) in TITLES else own
    return " ".join(words)


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:16]


def paragraphs(lines: list[str]) -> list[tuple[int, str]]:
    """(first line, canonical form) of the runs of lines with words, whatever their line ends.

    A short paragraph that begins as a copyright statement is one, and so is a title; neither has a form.
    """
    found, own = [], []
    for i, line in enumerate([*lines, ""]):
        if _WORD.search(line):
            own.append(line.strip(" \t*#/-"))
        elif own:
            words = [EQUIVALENT.get(w, w) for w in _WORD.findall(" ".join(own))]
            form = " ".join(words)
            statement = _COPYRIGHT.match(own[0]) and len(words) <= STATEMENT_WORDS
            if not statement and form not in TITLES:
                found.append((i - len(own), form))
            own = []
    return found


def blocks(lines: list[str], forms: list[str]) -> list[tuple[int, str]]:
    """(first line, canonical form) of the runs of lines between empty ones, put together from those of their lines."""
    found, first = [], 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            own = " ".join(f for f in forms[first:i] if f)
            if own:
                found.append((first, own))
            first = i + 1
    return found


def units(text: str | None, lengths: tuple[int, ...] = ()) -> Iterator[tuple[str, int, bytes]]:
    """(kind, first line, digest) of the document, of its blocks and of its lines, as far as they have words.

    Documents and blocks are taken in two forms: one leaves out copyright lines, the other whole copyright paragraphs,
    so that line ends do not matter. Runs of blocks are given for every number of words in ``lengths``.
    """
    lines = (text or "").lower().splitlines()
    forms = [canonical([line]) for line in lines]
    found: dict[tuple[str, int, str], None] = {}
    for parts in (blocks(lines, forms), paragraphs(lines)):
        if parts:
            found[DOCUMENT, 0, " ".join(form for _, form in parts)] = None
        upto = [0]
        for line, form in parts:
            found[BLOCK, line, form] = None
            upto.append(upto[-1] + form.count(" ") + 1)
        place = {n: i for i, n in enumerate(upto)}
        for i, (line, _) in enumerate(parts):
            for n in lengths:
                end = place.get(upto[i] + n, 0)
                if end > i + 1:
                    found[BLOCK, line, " ".join(form for _, form in parts[i:end])] = None
    single = set(forms)
    for kind, line, form in found:
        if kind == DOCUMENT or form not in single:  # a block of one line is that line
            yield kind, line, digest(form)
    for i, form in enumerate(forms):
        if form:
            yield LINE, i, digest(form)


def n_words(text: str | None) -> list[int]:
    """The numbers of words of both forms of a text."""
    lines = (text or "").lower().splitlines()
    both = blocks(lines, [canonical([line]) for line in lines]), paragraphs(lines)
    return sorted({sum(form.count(" ") + 1 for _, form in parts) for parts in both} - {0})


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences that come with the library."""
    full = [(path.stem, path.read_text("utf-8")) for path in sorted(FULL.glob("*.txt"))]
    return spark.createDataFrame([*TEXTS, *full], "license_id string, text string")


def _digests(rows: DataFrame, keys: str, kinds: tuple[str, ...], lengths: tuple[int, ...] = ()) -> DataFrame:
    """(key, kind, line, digest) of the units of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [
                    (i, *unit)
                    for i, text in enumerate(part.column("text").to_pylist())
                    for unit in units(text, lengths)
                    if unit[0] in kinds
                ]
                row, kind, line, value = list(zip(*found, strict=True)) or [(), (), (), ()]
                key = part.column(0).take(pa.array(row, pa.int64()))
                arrays = [key, pa.array(kind, pa.string()), pa.array(line, pa.int32()), pa.array(value, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "kind", "line", "digest"])

    return rows.mapInArrow(work, f"key {keys}, kind string, line int, digest binary")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licences per document row.

    Columns: doc_id, licenses (sorted, distinct), whole_license (of the entire document, the smallest name if there
    are several, else NULL), and matches (kind, line, license_id), sorted.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    known = known.select("license_id", "text")
    numbers = known.select(F.explode(F.udf(n_words, "array<int>")("text")).alias("n")).distinct()
    lengths = tuple(sorted(r.n for r in numbers.collect()))
    known = _digests(known.select("license_id", "text"), "string", (DOCUMENT,)).select("digest", F.col("key").alias("license_id"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = _digests(rows.select("row", "text"), "long", (DOCUMENT, BLOCK, LINE), lengths)
    match = F.struct("kind", "line", "license_id")
    found = own.join(known.distinct(), "digest").groupBy(F.col("key").alias("row")).agg(
        F.array_sort(F.collect_set("license_id")).alias("licenses"),
        F.min(F.when(F.col("kind") == DOCUMENT, F.col("license_id"))).alias("whole_license"),
        F.array_sort(F.collect_set(match)).alias("matches"),
    )
    none = F.array().cast("array<string>")
    return rows.select("row", "doc_id").join(found, "row", "left").select(
        "doc_id",
        F.coalesce("licenses", none).alias("licenses"),
        "whole_license",
        F.coalesce("matches", F.array().cast("array<struct<kind:string,line:int,license_id:string>>")).alias("matches"),
    )
