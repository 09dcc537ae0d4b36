"""Quality classifier by compression against two dictionaries.

Zstandard dictionaries are trained on labelled good texts and on labelled bad texts. A text is compressed with each,
in pieces, so that the dictionary counts as much at the end of a long text as at the start of a short one. The
difference of the two compressed sizes, divided by their sum, says which dictionary knows the text better.

Compressed sizes of a short text say little, so the inverse of their sum is a third input: it shifts short texts
towards the share of good ones among short texts.

That is done for two views of a text: the text itself, and the shapes of its words (length, case, punctuation,
repetition of the word before), one byte each, which are alike in all languages. A logistic curve over these
inputs gives a probability.

Dictionaries come from one half of a bounded sample of the labelled rows, the curve from the other half, so that the
curve sees texts that are not in a dictionary. Only texts and labels take part in the fit, and only texts in scores.

Cases: NULL and empty texts compress to the same size and get the score of a difference of 0. Without enough labelled
rows of both kinds for dictionaries all texts get the share of good rows among those there are (0.5 without any).
A document with both labels counts for both; labels other than 0 and 1 are ignored. Repeated document rows
get a result each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.llm.text import slices, with_text

SAMPLE_ROWS = 4000  # labelled rows of each class that are used at most
SAMPLE_CHARS = 6000  # of each of them
DICTIONARY_BYTES = 1 << 15
SAMPLE_PIECE = 512
PIECES = (2048, 512)  # bytes compressed at a time, of the text and of the shapes
LEVEL = 3
SHORT = 100  # compressed bytes
PENALTY = 0.1
THRESHOLD = 0.7
NOT_WORD = ".,;:!?|#$%&*-_()\"'"


def shapes(text: str) -> bytes:
    """One byte per word: length class, case class, punctuation behind it, and whether it repeats the word before."""
    out = bytearray()
    before = None
    for word in text.split():
        core = word.strip(NOT_WORD)
        low = core.lower()
        tail = word[len(word.rstrip(NOT_WORD)) :]
        length = 0 if not core else 1 if len(core) <= 3 else 2 if len(core) <= 7 else 3
        case = 0 if core == low else 1 if core[1:] == low[1:] else 2
        mark = 0 if not tail else 1 if tail in (".", "?", "!") else 2 if tail == "," else 3
        out.append(32 + length + 4 * case + 12 * mark + 48 * (low == before and low != ""))
        before = low
    return bytes(out)


VIEWS = (str.encode, shapes)


@dataclass(frozen=True)
class Model:
    dictionaries: list[tuple[bytes, bytes]]  # of good and bad texts, per view
    slopes: np.ndarray
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = inputs(texts, self.dictionaries) @ self.slopes if self.dictionaries else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(x + self.offset, -30, 30)))


def inputs(texts: list[str | None], dictionaries: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Per view (size under bad - size under good) / (sum): above 0 if the good dictionary knows the text better.

    The last column is ``SHORT / (SHORT + sum)`` of the text's own view.
    """
    out = np.zeros((len(texts), len(VIEWS) + 1))
    for v, (view, piece, pair) in enumerate(zip(VIEWS, PIECES, dictionaries, strict=True)):
        tools = []
        for content in pair:
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, **options))
        for i, text in enumerate(texts):
            data = view(text or "")
            good = bad = 0
            for at in range(0, len(data), piece):
                own = data[at : at + piece]
                good += len(tools[0].compress(own))
                bad += len(tools[1].compress(own))
            out[i, v] = (bad - good) / max(1, bad + good)
            if v == 0:
                out[i, -1] = SHORT / (SHORT + bad + good)
    return out


def _dictionaries(good: list[str], bad: list[str]) -> list[tuple[bytes, bytes]]:
    """None if there is too little text for the trainer."""
    pairs = []
    for view in VIEWS:
        pair = []
        for texts in (good, bad):
            data = [view(t) for t in texts]
            samples = [d[a : a + SAMPLE_PIECE] for d in data for a in range(0, len(d), SAMPLE_PIECE)]
            try:
                pair.append(zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes())
            except zstandard.ZstdError:
                return []
        pairs.append((pair[0], pair[1]))
    return pairs


def fit(docs: DataFrame, labels: DataFrame, usable: str) -> Model:
    """``usable`` is the SQL condition on doc_id of the rows that may be learned from."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    known = known.where(usable).where("doc_id IS NOT NULL").distinct()
    order = [F.xxhash64("doc_id", F.lit(1)), "doc_id"]
    chosen = [known.where(F.col("quality") == q).orderBy(*order).limit(SAMPLE_ROWS) for q in (0, 1)]
    # Two rows per document at most, so the sample is small whatever the tables hold.
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long"), F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text"))
    rows = texts.where("text <> ''").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted(rows.collect(), key=lambda r: zlib.crc32(str(r["doc_id"]).encode() + b"-"))
    bad, good = ([r["text"] for r in rows if r["quality"] == q] for q in (0, 1))
    dictionaries = _dictionaries(good[::2], bad[::2])
    if not dictionaries:
        share = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return Model([], np.zeros(len(VIEWS) + 1), float(np.log(share / (1 - share))))
    held = [good[1::2] or good, bad[1::2] or bad]
    y = np.repeat([1.0, 0.0], [len(h) for h in held])
    return Model(dictionaries, *_logistic(inputs(held[0] + held[1], dictionaries), y))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the logistic curve through (x, y), with a weak penalty on the slopes.

    Newton's method on standardised inputs; a step that does not lower the loss is halved.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.array([PENALTY] * x.shape[1] + [1e-6])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + penalty @ (w * w) / 2)

    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, a.T @ (y - p) - penalty * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
    slopes = w[:-1] / scale
    return slopes, float(w[-1] - slopes @ mean)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``, the probability that the text is good."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(with_text(batch), "text"):
                p = shared.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(p)], names=["row", "score"])

    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(work, schema).select("row.*", F.col("score").alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, usable: str = "true") -> DataFrame:
    """The documents with a score of at least ``THRESHOLD``, columns unchanged."""
    scored = score(docs, fit(docs, labels, usable), "_quality_score")
    return scored.where(F.col("_quality_score") >= THRESHOLD).drop("_quality_score")
