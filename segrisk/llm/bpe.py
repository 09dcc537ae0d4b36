"""Byte-level BPE encoding with a contiguous rank array per word, and its decoding.

A text is cut into words by the tokenizer's pattern. Each different word is encoded once per task. A word is an array
of its parts, at first single bytes, and beside it lies the array of the ranks of adjacent parts. The smallest rank is
found by a scan, leftmost first; the boundary behind its part is deleted, both arrays close up, and the ranks on
either side are refreshed, until no pair has a rank. Words are short, so a scan of contiguous memory is faster than a
queue; many words of similar length are scanned at once as the rows of a matrix. Words of more than ``SHORT`` bytes
use a queue instead, which gives the same parts in n log n time.

Cases: NULL is the empty text, which has no tokens; repeated rows are encoded as often as they occur, and rows without
doc_id too; other columns are ignored. Special tokens that stand in a text become their ids, as in the tokenizers
library; truncation and padding are not applied. Decoding skips ids that the vocabulary does not have, keeps special
tokens, and puts U+FFFD for bytes that are no UTF-8.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from segrisk.llm.cuts import Remembered, chunks, gather
from segrisk.llm.text import slices

SHORT = 64  # bytes of a word up to which its rank array is scanned
BLOCK = 8192  # words scanned together
NO_RANK = np.int32(2**31 - 1)

# Fixed value: the published split pattern of this kind of tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(SPLIT)
# Characters whose class no Unicode version has changed for long; texts with others are split by the library itself.
_SETTLED = re.compile("[\x00-՗]*")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others shifted."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = itertools.count(0x100)
    return {chr(b) if b in printable else chr(next(shifted)): b for b in range(256)}


class ByteBpe:
    """Vocabulary and ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        if not plain or spec["normalizer"] or model.get("ignore_merges") or any(
            t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        letters = byte_letters()
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None
        self.n_ids = max([*vocab.values(), *self.specials.values()]) + 1
        data = [b""] * self.n_ids
        for token, i in vocab.items():
            data[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            data[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.token_size = np.array([len(d) for d in data], np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.n_ids + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of adjacent parts."""
        keys = left * self.n_ids + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def _scan(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of short words: one row of a matrix each, with its ranks in a second matrix."""
        width = int(size.max())
        parts = np.zeros((len(words), width), np.int64)
        inside = np.arange(width) < size[:, None]
        parts[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NO_RANK)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self.ranks(parts[:, :-1][pair], parts[:, 1:][pair])
        count, row = size.copy(), np.arange(len(words))
        ended, counts = np.zeros_like(parts), size.copy()
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            live = best != NO_RANK
            done = row[~live]
            ended[done, : parts.shape[1]] = parts[~live]
            counts[done] = count[~live]
            parts, rank, at, best, row, count = parts[live], rank[live], at[live], best[live], row[live], count[live] - 1
            rows, column = np.arange(len(row)), np.arange(parts.shape[1] - 1)
            parts[rows, at] = self.made[best]
            # The boundary behind the part goes, and with it one rank; everything behind moves up.
            parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
            before, behind = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < count)
            for side, first in ((before, at[before] - 1), (behind, at[behind])):
                rank[side, first] = self.ranks(parts[side, first], parts[side, first + 1])
        return counts, ended[np.arange(width) < counts[:, None]]

    def _queue(self, word: bytes) -> np.ndarray:
        """The parts of a long word: the pair of lowest rank, leftmost first, from a queue."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)]
        first = self.ranks(parts[:-1], parts[1:])
        queue = [(int(first[i]), i) for i in np.flatnonzero(first != NO_RANK).tolist()]
        heapq.heapify(queue)
        part, n = parts.tolist(), len(parts)
        rank = [*first.tolist(), NO_RANK]
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._table
        while queue:
            best, i = heapq.heappop(queue)
            if rank[i] != best:  # merged or refreshed since
                continue
            j = following[i]
            part[i], part[j], rank[j] = int(self.made[best]), -1, NO_RANK
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
            for a, b in ((previous[i], i), (i, k)):
                if a >= 0:
                    rank[a] = table.get(part[a] * self.n_ids + part[b], NO_RANK) if b < n else NO_RANK
                    if rank[a] != NO_RANK:
                        heapq.heappush(queue, (rank[a], a))
        return np.array([p for p in part if p >= 0], np.int64)

    @property
    def _table(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))
        return self._pairs

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many parts each word (none is empty) has, and the ids of all parts one after the other."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        n_short = int(np.searchsorted(size[order], SHORT, side="right"))
        found = []
        for a in range(0, n_short, BLOCK):
            own = order[a : min(a + BLOCK, n_short)]
            found.append(self._scan([words[i] for i in own.tolist()], size[own]))
        for i in order[n_short:].tolist():
            parts = self._queue(words[i])
            found.append((np.array([len(parts)]), parts))
        counts = np.zeros(len(words), np.int64)
        if not found:
            return counts, np.zeros(0, np.int64)
        sorted_counts, parts = (np.concatenate(x) for x in zip(*found, strict=True))
        counts[order] = sorted_counts
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(sorted_counts) - sorted_counts
        return counts, parts[gather(first, counts)]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens one after the other, and how many each token has."""
        known = (ids >= 0) & (ids < self.n_ids)
        size = np.where(known, self.token_size[np.where(known, ids, 0)], 0)
        return self.token_bytes[gather(self.token_first[np.where(known, ids, 0)], size)], size


class Encoder:
    """Ids of texts; words and chunks seen before are remembered."""

    def __init__(self, path: str) -> None:
        self.bpe = ByteBpe(path)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.words = Remembered(self._learn_words)
        self.chunks = Remembered(self._learn)

    def _split(self, chunk: str) -> list[str]:
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isascii() and body[:-1].isalpha():  # a word, or a word and one sign behind it
            last = body[-1]
            if last.isalpha():
                return [chunk]
            if not last.isdigit() and not last.isspace():
                return [chunk[:-1], last]
        if _SETTLED.fullmatch(chunk):
            return _SPLIT.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenize_str(chunk)]

    def _learn_words(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words; a special token is its own id as a number."""
        text = np.array([isinstance(w, str) for w in words], bool)
        size, ids = self.bpe.merge([w.encode() for w in words if isinstance(w, str)])
        counts = np.ones(len(words), np.int64)
        counts[text] = size
        out = np.zeros(int(counts.sum()), np.int64)
        first = np.cumsum(counts) - counts
        out[gather(first[text], size)] = ids
        out[first[~text]] = [w for w in words if not isinstance(w, str)]
        return counts, out

    def _learn(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new chunks."""
        split = [self._split(key) if isinstance(key, str) else [key] for key in keys]
        code = self.words.codes(list(itertools.chain.from_iterable(split)))
        size = self.words.size[code]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        ids = self.words.values[gather(self.words.first[code], size)]
        return np.add.reduceat(size, np.cumsum(n_words) - n_words), ids

    def _keys(self, text: str) -> list:
        if self.bpe.special is None or not self.bpe.special.search(text):
            return chunks(text)
        keys: list = []
        for i, piece in enumerate(self.bpe.special.split(text)):
            keys += [self.bpe.specials[piece]] if i % 2 else chunks(piece)
        return keys

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offset of each text."""
        if self.chunks.full() or self.words.full():
            self.chunks.forget()
            self.words.forget()
        keys = [self._keys(t) if t else [] for t in texts]
        code = self.chunks.codes(list(itertools.chain.from_iterable(keys)))
        size = self.chunks.size[code]
        ids = self.chunks.values[gather(self.chunks.first[code], size)]
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids, upto[np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int64)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of the whole text of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(path)  # made anew for each task, so that a worker does not keep its memory
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = tool.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(work, "doc_id long, ids array<int>")


def decoder(path: str) -> Callable:
    """A column function from arrays of ids to texts; NULL stays NULL."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ByteBpe(path)
        for lists in batches:
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            data, size = bpe.bytes_of(ids.astype(np.int64))
            ends = np.concatenate(([0], np.cumsum(size)))[offsets - offsets[0]].tolist()
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(ends)]
            nulls = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.array(texts, pa.string(), mask=nulls)

    return decode
