"""Alignment of the tokens of two tokenizers: a byte-level BPE (A) and a sentencepiece model (B).

Both libraries tell for every token which characters it covers. Where a token of A and a token of B end at the same
character and no character is shared between tokens, both sequences are cut at once; these spans are the coarse cuts.
A character that several tokens share (parts of a multibyte character in A, byte-fallback tokens in B) has no spans
of its own inside, so there the decoded bytes of the tokens say where each of them ends. All ends are byte offsets in
the end, and every place where both sides end is the border of a group. Between two neighbouring ends of either side
lies exactly one pair of overlapping tokens, a link.

Chunks (see ``cuts``) are aligned once per task each; a text is the sum of its chunks. How many documents hold a
linked pair of ids is counted over the whole corpus. The counts of the most frequent pairs, at most ``FREQUENT``, are
broadcast, which also spares the shuffle the pairs that many documents have; all others are joined by the pair.

Cases: a text that is NULL, empty, or that the tokens do not give back byte for byte has no tokens: all its numbers
are 0 and its groups empty. Repeated rows, also of one doc_id, are documents of their own; rows without doc_id too.
Special tokens inside texts are plain text. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segrisk.llm.bpe import ByteBpe
from segrisk.llm.cuts import OTHER_SPACE, Remembered, chunks, gather
from segrisk.llm.text import slices
from segrisk.session import materialise

BLANK = "▁"
FIRST = " a"  # a chunk put in front stands for the beginning of a text, where B adds a blank
WHITE_SPACE = frozenset(f" \n{OTHER_SPACE}")
JOINED_CHARS = 8_000  # characters of chunks that are encoded as one text
FREQUENT = 1 << 20  # linked pairs whose counts are broadcast
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<int>"
)

NOT_GIVEN_BACK = (np.zeros(0, np.int64), np.zeros(1, np.int64), [""], np.array([[0, 0, 0, 1]]))


class Pieces:
    """The sentencepiece model with the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.IdToPiece(i) for i in range(self.model.GetPieceSize())]
        data = [
            bytes([int(p[3:5], 16)]) if self.model.IsByte(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.token_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.token_size = np.array([len(d) for d in data], np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        # Cuts before blanks and line ends are right only if no piece reaches across one.
        plain = [p for i, p in enumerate(pieces) if not self.model.IsByte(i)]
        self.cuts = not any(
            b in f"{BLANK}\n" and a not in f"{BLANK}\n" for p in plain for a, b in itertools.pairwise(p)
        )

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.token_size[ids]
        return self.token_bytes[gather(self.token_first[ids], size)], size


def byte_ends(spans: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte offset at which each token ends, from spans in characters and numbers of decoded bytes.

    ``at`` is the byte offset of every character and of the end.
    """
    start, end = spans[:, 0], spans[:, 1]
    # A coarse cut is behind a token that covers characters none of which the next one has, too.
    coarse = end > start
    coarse[:-1] &= end[:-1] <= start[1:]
    ends = at[end]
    alone = coarse.copy()
    alone[1:] &= coarse[:-1]
    if alone.all():
        return ends
    # Inside a run of tokens that share characters: the end of the run before it plus the decoded bytes so far.
    total = np.cumsum(size)
    run = np.concatenate(([0], np.cumsum(coarse)[:-1]))
    last = np.flatnonzero(coarse)
    base_bytes = np.concatenate(([0], at[end[last]]))
    base_total = np.concatenate(([0], total[last]))
    return np.where(alone, ends, base_bytes[run] + total - base_total[run])


def _spans(offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)


class Aligner:
    """Tokens, groups and links of chunks; chunks seen before are remembered."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        # Names of ids with what follows them: in A a comma or a bar, in B a comma or a semicolon.
        names = [[f"{i}{end}" for i in range(n)] for n in (self.a.n_ids, len(self.b.token_size)) for end in ",|;"]
        self.names = [np.array(n, object) for n in names]
        self.forget()

    def forget(self) -> None:
        self.pairs = Remembered(self._learn, np.int64)
        self.groups: list[str] = []  # per chunk
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, and 1 for chunks not given back

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A and of B for ``text``, which starts with a blank; None if it is not given back."""
        (encoded,) = self.library.encode_batch([text], add_special_tokens=False)
        a_ids = np.array(encoded.ids, np.int64)
        a_spans = _spans(encoded.offsets)
        mapped = self.b.model.encode(text[1:], return_type="offset_mapping", num_threads=1)
        b_ids = np.array(mapped["ids"], np.int64)
        b_spans = _spans(mapped["offsets"]) + 1  # behind the blank that B adds itself
        if not len(b_ids):
            return None
        b_spans[0, 0] = 0
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        a_bytes, a_size = self.a.bytes_of(a_ids)
        b_bytes, b_size = self.b.bytes_of(b_ids)
        if not np.array_equal(a_bytes, data) or not np.array_equal(b_bytes, data):
            return None
        return a_ids, byte_ends(a_spans, a_size, at), b_ids, byte_ends(b_spans, b_size, at)

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of new chunks (id of A times 2**32 plus id of B), and all the rest on the side."""
        length = np.fromiter(map(len, keys), np.int64, len(keys))
        first = np.diff(np.cumsum(length) // JOINED_CHARS, prepend=-1) > 0
        # White space at the end of a text would be encoded together with that of the chunk behind it.
        first[1:] |= np.fromiter((k[-1] in WHITE_SPACE for k in keys[:-1]), bool, len(keys) - 1)
        cut = np.flatnonzero(first)
        found = []
        for own in (keys[i:j] for i, j in itertools.pairwise([*cut.tolist(), len(keys)])):
            together = self._aligned(own)
            # If one of them is not given back, each is taken on its own.
            found += [together] if together else [self._aligned([key]) or NOT_GIVEN_BACK for key in own]
        for _, _, groups, numbers in found:
            self.groups += groups
        self.numbers = np.concatenate((self.numbers, *(numbers for *_, numbers in found)))
        return np.concatenate([size for _, size, *_ in found]), np.concatenate([pairs for pairs, *_ in found])

    def _aligned(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray] | None:
        """Links of chunks, the number of links of each, their groups and their numbers."""
        own = [FIRST, *own]
        text = "".join(own)
        tokens = self._tokens(text)
        if tokens is None:
            return None
        a_ids, a_ends, b_ids, b_ends = tokens
        border = np.cumsum([len(c.encode()) for c in own])
        in_a, in_b = (np.bincount(ends, minlength=border[-1] + 1).astype(bool) for ends in (a_ends, b_ends))
        shared, either = in_a & in_b, in_a | in_b
        a_upto, b_upto, shared_upto, upto = (np.cumsum(x) for x in (in_a, in_b, shared, either))
        ends = np.flatnonzero(either)  # one link each, of the tokens that have as many ends before it
        pairs = a_ids[a_upto[ends - 1]] << 32 | b_ids[b_upto[ends - 1]]
        numbers = [np.diff(x[border]) for x in (a_upto, b_upto, shared_upto)]
        numbers = np.column_stack([*numbers, np.zeros(len(own) - 1, np.int64)])
        groups = self._names(tokens, (shared_upto[a_ends - 1], shared_upto[b_ends - 1]), shared_upto[border])
        return pairs[upto[border[0]] :], np.diff(upto[border]), groups, numbers

    def _names(self, tokens: tuple, groups: tuple[np.ndarray, np.ndarray], upto: np.ndarray) -> list[str]:
        """The groups of each chunk but the first: ids of A, a bar, ids of B; groups apart by semicolons."""
        names, order = [], []
        for side, (ids, group) in enumerate(zip((tokens[0], tokens[2]), groups, strict=True)):
            last = np.append(group[1:] != group[:-1], True)
            out = self.names[3 * side][ids]
            out[last] = self.names[4 * side + 1][ids[last]]
            names.append(out)
            order.append(2 * group + side)
        order = np.concatenate(order)
        sequence = np.argsort(order, kind="stable")
        names = np.concatenate(names)[sequence].tolist()
        cuts = np.searchsorted(order[sequence], 2 * upto).tolist()
        return ["".join(names[i:j])[:-1] for i, j in itertools.pairwise(cuts)]

    def align(self, texts: list[str | None]) -> pa.RecordBatch:
        """The columns of ``ALIGNED`` but for doc_id."""
        if self.pairs.full():
            self.forget()
        own = [(chunks(f" {t}") if self.b.cuts else [f" {t}"]) if t else [] for t in texts]
        code = self.pairs.codes(list(itertools.chain.from_iterable(own)))
        upto = np.concatenate(([0], np.cumsum([len(c) for c in own]))).astype(np.int64)
        total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.numbers[code], 0)))
        numbers = np.diff(total[upto], axis=0)
        numbers[numbers[:, 3] > 0] = [0, 0, 0, 1]
        links = np.concatenate(([0], np.cumsum(self.pairs.size[code])))
        n_links = np.where(numbers[:, 3] > 0, 0, np.diff(links[upto]))
        groups, pairs, counts = [], [], []
        for a, b, bad in zip(upto[:-1].tolist(), upto[1:].tolist(), numbers[:, 3].tolist(), strict=True):
            b = a if bad else b
            groups.append(";".join(map(self.groups.__getitem__, code[a:b].tolist())))
            chunk, times = np.unique(code[a:b], return_counts=True)
            size = self.pairs.size[chunk]
            pair, which = np.unique(self.pairs.values[gather(self.pairs.first[chunk], size)], return_inverse=True)
            pairs.append(pair)
            counts.append(np.bincount(which, np.repeat(times, size), minlength=len(pair)).astype(np.int32))
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))), pa.int32())
        columns = [
            *(pa.array(numbers[:, i]) for i in range(3)), pa.array(n_links), pa.array(groups, pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs, dtype=np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts, dtype=np.int32))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, tokens of A and B, groups and links, the groups themselves, distinct linked pairs and how often
    each is linked (``pairs``: id of A times 2**32 plus id of B; ``links``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Aligner(a_path, b_path)  # made anew for each task, so that a worker does not keep its memory
        for batch in batches:
            for part in slices(batch, "text"):
                found = tool.align(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *found.columns], names=["doc_id", *found.schema.names]
                )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(work, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked pair of ids: in how many rows it is linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "pair_counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # one row per id of the vocabulary
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its pairs.

    ``n_best`` counts links whose pair is as frequent as any of its A id, ``count_sum`` adds up the counts of all links.
    """
    numbered = materialise(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(numbered), "best_pairs")
    limit = _frequent_from(counts)
    frequent, rare = counts.where(F.col("n") >= limit), counts.where(F.col("n") < limit)
    exploded = numbered.select("_row", F.arrays_zip("pairs", "links").alias("p")).select("_row", F.inline("p"))
    exploded = exploded.toDF("_row", "pair", "times")
    sums = (
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    looked_up = exploded.join(F.broadcast(frequent), "pair", "left")
    found = looked_up.where(F.col("n").isNotNull()).groupBy("_row").agg(*sums)
    if not rare.isEmpty():
        others = looked_up.where(F.col("n").isNull()).select("_row", "pair", "times").join(rare, "pair")
        both = found.unionByName(others.groupBy("_row").agg(*sums))
        found = both.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return numbered.join(found, "_row", "left").select(
        *(c for c in aligned.columns if c not in ("pairs", "links")),
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
    )


def _frequent_from(counts: DataFrame) -> int:
    """The smallest power of 2 that at most ``FREQUENT`` pairs reach."""
    power = F.floor(F.log2("n")).cast("int")
    at_least = 0
    limit = 1 << 62
    for row in counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # at most 63 rows
        at_least += row["count"]
        if at_least > FREQUENT:
            break
        limit = 1 << row["power"]
    return limit
