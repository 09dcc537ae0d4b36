"""Packing of token sequences by length patterns and non-negative least squares.

Documents are tokenized and cut only where they are longer than a sequence. Then only the histogram of piece lengths
matters, at most ``capacity`` counts:

1. Patterns are all ways to fill a sequence with up to ``PATTERN_PIECES`` pieces, in units of ``UNIT`` tokens.
2. Non-negative least squares finds how often to use each pattern so that together they use up the histogram.
3. The numbers are rounded down and the patterns filled with pieces of exact lengths.
4. The residual goes, longest first, into the fullest sequences that still have room, or into new ones.

The plan is made for lengths, not for pieces: which numbers of a length go into which sequences, and where. Its size
depends on ``capacity`` alone. Pieces are numbered per length in parallel (within each task, shifted by the tasks
before) and look their place up.

Cases: NULL and empty texts are the end token alone; repeated rows are packed as often as they occur, and rows
without doc_id too; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from segrisk.llm.text import slices
from segrisk.session import materialise

CAPACITY = 4096
END_TOKEN = 1
UNIT = 32
PATTERN_PIECES = 3
NNLS_ROUNDS = 400
CACHE_PARTS = 500_000  # parts of texts whose ids a task remembers

# Characters up to U+017F whose class and lower case are beyond doubt; words of others are left to the tokenizer, and
# words with the character that special tokens begin with.
_PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c not in (0x3C, 0x130)]
_SPACE = " \t\n\r\x0b\x0c"  # no normalization reaches across these


def _class(*kinds: str) -> str:
    return re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] in kinds))


_NOT_PLAIN = re.compile(f"[^{_SPACE}{re.escape(''.join(_PLAIN))}]")
_OTHER_WORD = re.compile(f"(?<![^{_SPACE}])([{re.escape(''.join(_PLAIN))}]*+[^{_SPACE}]+)")
# The tokenizer's own split: letters, single digits, contractions, and runs of anything else.
_PART = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_class('L', 'N')}]+")
JOINED = 500  # parts encoded as one text
WORD_END = "</w>"


class Numbers(dict):
    """Numbers of parts in the order in which they were first asked for."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


@functools.cache
def _tokenizers(path: str) -> tuple[Tokenizer, Tokenizer, np.ndarray]:
    """The tokenizer, its model for parts that are normalized and split already, and which ids end a part."""
    tokenizer = Tokenizer.from_file(path)
    plain = Tokenizer(tokenizer.model)
    by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_bytes])
    ids = tokenizer.get_vocab()
    ends = np.zeros(max(ids.values()) + 1, bool)
    ends[[i for token, i in ids.items() if token.endswith(WORD_END)]] = True
    return tokenizer, plain, ends


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, lower-cases, and encodes the parts of words one by one.

    The ids of a text are then those of its parts one after the other. Parts seen before are remembered, and new ones
    are encoded many at a time, which is several times faster and gives the same ids.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.plain, self.ends = _tokenizers(path)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.first = np.zeros(0, np.int64)  # of the ids of each part
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, parts: list[str]) -> None:
        """Ids of new parts, in the order of their numbers."""
        other = np.fromiter((_NOT_PLAIN.search(p) is not None for p in parts), bool, len(parts))
        plain = [p for p, o in zip(parts, other.tolist(), strict=True) if not o]
        found, sizes = [self.ids], [np.zeros(0, np.int64)]
        for a in range(0, len(plain), JOINED):
            own = plain[a : a + JOINED]
            (encoded,) = self.plain.encode_batch_fast([" ".join(own)], add_special_tokens=False)
            found.append(np.array(encoded.ids, np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.ends[found[-1]]), prepend=-1))
            if len(sizes[-1]) != len(own):
                raise ValueError("the tokenizer does not mark the ends of words")
        for i in np.flatnonzero(other):  # only the tokenizer knows their parts
            found.append(np.array(self.tokenizer.encode(parts[i], add_special_tokens=False).ids, np.uint32))
            sizes.append(np.array([len(found[-1])]))
        size = np.concatenate(sizes)
        first, order = len(self.ids) + np.cumsum(size) - size, np.argsort(np.argsort(other, kind="stable"))
        self.first, self.size = np.concatenate((self.first, first[order])), np.concatenate((self.size, size[order]))
        self.ids = np.concatenate(found)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by the end token, and the offset of each text."""
        if len(self.known) > CACHE_PARTS:
            self._forget()
        split = [parts_of(t or "") for t in texts]
        n_parts = np.cumsum([len(parts) for parts in split], dtype=np.int64)
        numbers = map(self.known.__getitem__, itertools.chain.from_iterable(split))
        part = np.fromiter(numbers, np.int64, int(n_parts[-1]) if split else 0)
        self._learn(list(itertools.islice(self.known, len(self.first), None)))
        size = self.size[part]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[part] - ends + size, size)
        upto = np.concatenate(([0], ends))[n_parts]
        ids = np.insert(self.ids[at], upto, END_TOKEN)
        return ids, np.concatenate(([0], upto + np.arange(1, len(texts) + 1)))


def parts_of(text: str) -> list[str]:
    """The parts of plain words, lower-cased, and all other words whole."""
    if not _NOT_PLAIN.search(text):
        return _PART.findall(text.lower())
    parts = []
    for i, own in enumerate(_OTHER_WORD.split(text)):  # every second one is such a word
        if i % 2:
            parts.append(own)
        else:
            parts += _PART.findall(own.lower())
    return parts


PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents; ``nth`` numbers the pieces of a length within the task ``part``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made anew for each task, so that a worker does not keep its memory.
        tool, part_id, seen = WordTokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = tool.encode(part.column("text").to_pylist())
                n_pieces = -(-np.diff(offsets) // capacity)
                doc = np.repeat(np.arange(part.num_rows), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                low = offsets[doc] + piece * capacity
                high = np.minimum(low + capacity, offsets[doc + 1])
                length = high - low
                order = np.argsort(length, kind="stable")
                same = length[order]
                first = np.searchsorted(same, same)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - first + seen[same]
                seen += np.bincount(length, minlength=capacity + 1)
                data = ids.astype("<u4")
                crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets_of(length), pa.int32()), pa.array(ids.view(np.int32)))
                arrays = [
                    part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity),
                    pa.array(length), lists, pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part_id, np.int32)),
                    pa.array(nth),
                ]
                names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(work, PIECES)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def patterns(units: int, pieces: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``pieces`` sizes 1 .. units that add up to ``units``, largest size first."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], room: int) -> None:
        if not room:
            found.append(chosen)
        elif len(chosen) < pieces:
            most = min(room, chosen[-1] if chosen else units)
            least = -(-room // (pieces - len(chosen)))
            for size in range(most, least - 1, -1):
                extend((*chosen, size), room - size)

    extend((), units)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """x >= 0 that makes ``|a x - b|`` small, by accelerated projected gradients."""
    step = 1 / (np.linalg.norm(a, 2) ** 2)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


class Plan:
    """Kinds of sequences: the lengths in them, in order, and how many sequences there are of the kind."""

    def __init__(self, histogram: np.ndarray, capacity: int) -> None:
        self.left = histogram.astype(np.int64).copy()
        self.capacity = capacity
        self.kinds: list[tuple[tuple[int, ...], int]] = []
        if self.left[capacity]:
            self.kinds.append(((capacity,), int(self.left[capacity])))
            self.left[capacity] = 0
        self._use_patterns()
        self._pack_residual()

    def _use_patterns(self) -> None:
        unit = max(1, min(UNIT, self.capacity // 8))
        units = self.capacity // unit
        ways = patterns(units, PATTERN_PIECES)
        size = -(-np.arange(self.capacity + 1) // unit)  # of a length, in units, rounded up
        demand = np.bincount(size, self.left, minlength=units + 1)[: units + 1]
        a = np.zeros((units + 1, len(ways)))
        for j, way in enumerate(ways):
            for s, n in Counter(way).items():
                a[s, j] = n
        times = np.floor(nnls(a, demand) + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            n = int(times[j])
            while n > 0:
                # The longest length of each size that is left; as many sequences as all of them allow.
                lengths, taken = [], Counter()
                for i, s in enumerate(ways[j]):
                    room = self.capacity - sum(lengths)  # the last piece may use what rounding up has left
                    most = room if i == len(ways[j]) - 1 else s * unit
                    own = next((x for x in range(most, (s - 1) * unit, -1) if self.left[x] > taken[x]), None)
                    if own is None:
                        break
                    lengths.append(own)
                    taken[own] += 1
                if len(lengths) < len(ways[j]):
                    break
                k = min(n, *(int(self.left[x]) // c for x, c in taken.items()))
                for x, c in taken.items():
                    self.left[x] -= k * c
                self.kinds.append((tuple(lengths), k))
                n -= k

    def _pack_residual(self) -> None:
        rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for lengths, n in self.kinds:
            rooms.setdefault(self.capacity - sum(lengths), []).append((lengths, n))
        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            room = length
            while n:
                while room <= self.capacity and not rooms.get(room):
                    room += 1
                if room > self.capacity:  # new sequences of this length only
                    each = min(n, self.capacity // length)
                    rooms.setdefault(self.capacity - each * length, []).append(((length,) * each, n // each))
                    n -= each * (n // each)
                    room = length
                    continue
                lengths, count = rooms[room].pop()
                used = min(n, count)
                if used < count:
                    rooms[room].append((lengths, count - used))
                rooms.setdefault(room - length, []).append(((*lengths, length), used))
                n -= used
                room = max(length, room - length)
        self.left[:] = 0
        self.kinds = [kind for kinds in rooms.values() for kind in kinds]

    def table(self) -> dict[int, np.ndarray]:
        """Per length, rows (first number, first sequence, offset): numbers from there on go into sequences from there on."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        used: Counter[int] = Counter()
        sequence = 0
        for lengths, n in self.kinds:
            offset = 0
            for length in lengths:
                rows.setdefault(length, []).append((used[length], sequence, offset))
                used[length] += n
                offset += length
            sequence += n
        return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id and offset in the sequence."""
    pieces = materialise(token_pieces(docs, path, capacity), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(Plan(histogram, capacity).table())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.join(shifts, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("shift"))
    found = numbered.withColumn("place", _places(plan)("length", "nth"))
    return found.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "place.sequence_id", "place.offset")


def _places(plan: Broadcast) -> Callable:
    """Sequence and offset of the pieces of a length, by their number."""

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        number, out = nth.to_numpy(), np.empty((len(nth), 2), np.int64)
        for value, at in length.groupby(length).indices.items():
            table = plan.value[int(value)]
            row = table[np.searchsorted(table[:, 0], number[at], side="right") - 1]
            out[at, 0] = row[:, 1] + number[at] - row[:, 0]
            out[at, 1] = row[:, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return find


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents and start offsets of their pieces."""
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(members.alias("members"))
    return rows.select(
        "sequence_id",
        F.flatten(F.transform("members", lambda m: m["ids"])).alias("ids"),
        F.transform("members", lambda m: m["doc_id"]).alias("doc_ids"),
        F.transform("members", lambda m: m["offset"]).alias("offsets"),
    )
