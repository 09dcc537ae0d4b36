"""Language-model scoring by online logistic mixing of hashed context predictions.

A text is lower-cased (A-Z) and taken as its words, each followed by a space, and one end mark; the model gives the
probability of that sequence of bytes. Every byte is a path of binary decisions in a Huffman tree over bytes. Each
decision is predicted under several contexts: the last 2 bytes and the script, the last 4 bytes, the word so far, and
the word so far and the script. The script is the last character beyond ASCII that the text had before the word. A
context and a node of the tree are hashed to a slot that holds how often either branch was taken in training.

* Mixing: the log odds of all contexts are added up with weights and squashed. A gate chooses between sets of weights,
  by how often the word so far was seen in training.
* Online: weights start the same in every document and move along the gradient of the coding cost as the document is
  read, after 16 decisions at first and then after twice as many each time, up to ``STEP``.
* Refinement: a table from mixed log odds to observed frequencies, kept per document and updated at the same pace,
  is averaged with the mixed probability.

All counts come from all training documents. A task counts into tables of a fixed size (the model's capacity, see
``SLOT_BITS``), the tables are summed block by block, and their log odds (25 MB) are broadcast. A document's score
depends on these tables and its own text only, so it is the same however the documents are partitioned.

Cases: NULL and empty texts are the end mark alone. Documents without doc_id are training documents. Repeated rows
count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.llm.sketch import BLOCKS, partial_blocks, sum_blocks
from segrisk.llm.text import LOWER, NOT_SPACE, slices, span_hashes, utf8, words
from segrisk.session import materialise

SLOT_BITS = (20, 20, 22, 22)  # table sizes of the contexts, in the order above
GATE = 2  # the context whose count chooses the weights, and the counts at which it does
GATE_COUNTS = (1, 4, 32)
COUNT_BLOCK = 1 << 13
WORDS_BROADCAST = 1 << 22  # word counts are broadcast up to this many words, joined by a shuffle beyond it
WORDS_HELD = 1 << 19  # words that a task counts before it passes them on, in batches of WORD_ROWS
WORD_ROWS = 1 << 16
WINDOW = 1_000_000  # a longer text is read in windows of this size
GROUP = 1 << 16  # bytes of shorter texts whose contexts are hashed at a time
BLOCK = 1 << 14  # bytes whose decisions are looked up at a time
LANES = 32  # texts mixed at a time
SCORED = 2_000_000  # bytes of texts that are sorted by length before they are mixed
COUNTED = 1 << 21  # bytes whose contexts are sorted at a time in training
FIRST_STEP, STEP = 16, 512  # decisions between updates, doubled from one to the next
SCALE = 2048  # log odds are kept as 16-bit multiples of 1 / SCALE
RATE = 0.005
# Weights of the contexts at the start of a document, per gate.
START_WEIGHTS = ((0.55, 0.6, 0.0, 0.0), (0.55, 0.6, 0.3, 0.2), (0.5, 0.45, 0.3, 0.35), (0.2, 0.25, 0.07, 0.6))
BUCKETS = 57
REFINE_RATE = 1 / 256

END = 10
PAD = b"\n\n\n\n"
LOW = 0 if sys.byteorder == "little" else 1  # the lower half of a 64-bit key among its two
_SIZES = [1 << b for b in SLOT_BITS]
_STARTS = np.concatenate(([0], np.cumsum(_SIZES)))
_NODE_HASH = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each with padding before it, the offset of each text, and its number of tokens."""
    parts, tokens = [], []
    for text in texts:
        found = (text or "").encode().lower().split()
        tokens.append(len(found) + 1)
        parts.append(PAD + b" ".join(found) + (b" \n" if found else b"\n"))
    data = np.frombuffer(b"".join(parts), np.uint8)
    return data, np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.array(tokens)


class Code:
    """Huffman code of the 256 bytes: node and branch of every decision of a byte."""

    def __init__(self, counts: np.ndarray) -> None:
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], parent[right] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node, node))
        paths = []
        for byte in range(256):
            path, at = [], byte
            while at in parent:
                at, branch = parent[at]
                path.append((at - 256, branch))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths])
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.node = _NODE_HASH[[n for p in paths for n, _ in p]]
        self.branch = np.array([b for p in paths for _, b in p], np.uint8)


def contexts(data: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of every context at every byte."""
    n = len(data)
    wide = data.astype(np.uint32)
    one = np.concatenate(([np.uint32(END)], wide[:-1]))
    two = (one << np.uint32(8)) | np.concatenate((np.full(2, END, np.uint32), wide[:-2]))[:n]
    four = (two << np.uint32(16)) | np.concatenate((np.full(2, two[0], np.uint32), two[:-2]))[:n]
    # The word so far: a polynomial over its bytes, from sums of powers that start anew at each word.
    powers, inverses = _power_tables(n)
    sums = np.empty(n, np.uint32)
    sums[0] = 0
    np.cumsum((wide[:-1] * np.uint32(0x9E3779B1) + np.uint32(77)) * powers[: n - 1], dtype=np.uint32, out=sums[1:])
    border = np.flatnonzero((data == 32) | (data == END)) + 1
    begin = np.concatenate(([0], border[border < n]))
    size = np.diff(np.concatenate((begin, [n])))
    per_word = np.zeros((len(begin), 4), np.uint32)
    per_word[:, 0], per_word[:, 1] = sums[begin], inverses[begin]
    per_word[:, 2] = _last_wide(data, begin) * np.uint32(0x297A2D39)
    per_word = np.repeat(per_word, size, axis=0)
    word = sums - per_word[:, 0]
    word *= per_word[:, 1]
    script = per_word[:, 2]
    out = []
    for salt, values in enumerate((two + script, four, word, word + script)):
        h = values + np.uint32(salt)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(13)
        out.append(h)
    return out


def _last_wide(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first two bytes of the last character beyond ASCII before each place in its text, 0 if there is none.

    It tells languages and scripts apart. ``END`` bytes separate the texts.
    """
    marks = np.flatnonzero((data >= 0xC0) | (data == END))
    at = np.concatenate(([0], marks + 1))[np.searchsorted(marks, places)]
    lead = data[at - 1].astype(np.uint32)
    following = data[np.minimum(at, len(data) - 1)]
    return np.where((at > 0) & (lead >= 0xC0), (lead << np.uint32(8)) | following, np.uint32(0))


_tables: list[np.ndarray] = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for i, base in enumerate((0x2545F491, pow(0x2545F491, -1, 1 << 32))):
            table = np.full(max(n, 1 << 21), base, np.uint32)
            table[0] = 1
            _tables[i] = np.cumprod(table, dtype=np.uint32)
    return _tables


def decisions(data: np.ndarray, code: Code, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Number of decisions per byte (0 where not ``scored``), branch taken, and slot under one context after another."""
    return _decisions(contexts(data), SLOT_BITS, data, code, scored)


def in_blocks(data: np.ndarray, code: Code, scored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]]:
    """The decisions of ``BLOCK`` bytes after the other, whose arrays stay in the processor's cache."""
    hashes = contexts(data)
    for a in range(0, len(data), BLOCK):
        own = slice(a, a + BLOCK)
        yield _decisions([h[own] for h in hashes], SLOT_BITS, data[own], code, scored[own])


def _decisions(
    hashes: list[np.ndarray], table_bits: Sequence[int], data: np.ndarray, code: Code, scored: np.ndarray | bool
) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    size = code.length.take(data)
    size *= scored
    byte = np.repeat(np.arange(len(data)), size)  # that the decision belongs to
    at = (code.first.take(data) - np.cumsum(size) + size).take(byte)
    at += np.arange(len(at))

    node = code.node.take(at)

    def slots() -> Iterator[np.ndarray]:
        for h, bits in zip(hashes, table_bits, strict=True):
            mixed = h.take(byte)
            mixed ^= node
            mixed *= np.uint32(0x9E3779B1)
            mixed >>= np.uint32(32 - bits)
            yield mixed.view(np.int32)

    return size, code.branch.take(at), slots()


def _scored(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    scored = np.ones(len(data), bool)
    for i in range(len(PAD)):
        scored[offsets[:-1] + i] = False
    return scored


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): a hash of every word, and of the end mark, with its number of tokens."""

    def rows(word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(word), WORD_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(v[a : a + WORD_ROWS]) for v in (word, n)], names=["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, new = 0, []  # words of the first entry of ``new``, which are distinct
        for batch in batches:
            for part in slices(batch, "text"):
                ids, _, _ = token_ids(part.column("text"))
                at, word = pd.factorize(ids.view(np.int64))
                new.append((word, np.bincount(at)))
            if sum(len(word) for word, _ in new) - known > WORDS_HELD:
                new = [added_up(new)]
                known = len(new[0][0])
                if known > WORDS_HELD:
                    yield from rows(*new[0])
                    known, new = 0, []
        if new:
            yield from rows(*added_up(new))

    return docs.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def added_up(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, and the sum of its numbers."""
    at, word = pd.factorize(np.concatenate([w for w, _ in found]))
    return word, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def token_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the number of the first token of each text, and of tokens per text."""
    data, offsets = utf8(texts)
    data = LOWER.take(data)
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    ids = span_hashes(data, starts, ends)
    # One end mark per text, behind its words.
    ids = np.insert(ids, bounds[1:], np.uint64(0))
    return ids, bounds + np.arange(len(bounds)), np.diff(bounds) + 1


def stream_bytes(texts: pa.Array) -> np.ndarray:
    """How often each byte occurs in the streams of the texts, which need not be made for it."""
    data, offsets = utf8(texts)
    counts = np.zeros(256, np.int64)
    for a in range(0, len(data), GROUP):
        counts += np.bincount(data[a : a + GROUP], minlength=256)
    counts[97:123] += counts[65:91]
    counts[65:91] = 0
    counts[~NOT_SPACE] = 0
    first = np.ones(len(data) + 1, bool)  # bytes behind white space, or the first of a text
    inside = NOT_SPACE.take(data)
    np.logical_not(inside, out=first[1:])
    first[offsets] = True
    counts[32] += np.count_nonzero(first[:-1] & inside)
    counts[END] += len(texts)
    return counts


def byte_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte occurs in the streams of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                counts += stream_bytes(part.column("text"))
        yield from partial_blocks(counts, 256)

    counts = np.zeros(256, np.int64)
    for row in sum_blocks(docs.select("text").mapInArrow(work, BLOCKS)).toLocalIterator():
        counts += np.frombuffer(row["values"], np.int64)
    return counts


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, scored) of pieces of the streams: texts together up to ``GROUP`` bytes, a longer text alone.

    A text of more than ``WINDOW`` bytes comes in windows.

    A window ends behind a word, and begins with the last bytes of the one before, not scored, for the contexts.
    """
    scored = _scored(data, offsets)
    at = 0
    while at < len(offsets) - 1:
        low = int(offsets[at])
        upto = max(at + 1, int(np.searchsorted(offsets, low + min(GROUP, WINDOW), side="right")) - 1)
        high = int(offsets[upto])
        if high - low <= WINDOW:
            yield low, high, scored[low:high]
        else:
            begin = low
            while begin < high:
                end = high
                if begin + WINDOW < high:
                    border = np.flatnonzero(data[begin + WINDOW : high] <= 32)
                    end = begin + WINDOW + int(border[0]) + 1
                lead = len(PAD) if begin > low else 0
                mask = scored[begin - lead : end].copy()
                mask[:lead] = False
                yield begin - lead, end, mask
                begin = end
        at = upto


def train(docs: DataFrame) -> Broadcast:
    """The tables, from all rows of ``docs``."""
    code = Code(byte_counts(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * _STARTS[-1], np.int32)
        tables = [counts[2 * a : 2 * b] for a, b in zip(_STARTS[:-1], _STARTS[1:], strict=True)]
        keys, held = np.empty((len(tables), COUNTED), np.uint64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets, _ = streams(part.column("text").to_pylist())
                for low, high, scored in pieces_of(data, offsets):
                    if high - low > COUNTED:  # a word without end
                        count_into(tables, data[low:high], code, scored)
                        continue
                    if held + high - low > COUNTED:
                        count_keys(tables, keys[:, :held], code)
                        held = 0
                    held = add_keys(keys, held, data[low:high], scored)
        count_keys(tables, keys[:, :held], code)
        yield from partial_blocks(counts, COUNT_BLOCK)

    odds = np.zeros(_STARTS[-1], np.int16)
    gates = np.zeros(_STARTS[-1], np.uint8)
    for row in sum_blocks(docs.select("text").mapInArrow(work, BLOCKS)).toLocalIterator():
        own = np.frombuffer(row["values"], np.int64).reshape(-1, 2)
        low = row["block"] * COUNT_BLOCK // 2
        odds[low : low + len(own)], gates[low : low + len(own)] = log_odds(own)
    model = Tables(code, odds, gates[_STARTS[GATE] : _STARTS[GATE + 1]].copy())
    return docs.sparkSession.sparkContext.broadcast(model)


def add_keys(keys: np.ndarray, held: int, data: np.ndarray, scored: np.ndarray) -> int:
    """Put context and byte of every scored byte behind the ``held`` keys there are, a row per context."""
    at = np.flatnonzero(scored)
    byte = data.take(at)
    upto = held + len(byte)
    for row, h in zip(keys, contexts(data), strict=True):
        halves = row[held:upto].view(np.uint32).reshape(-1, 2)
        halves[:, LOW], halves[:, 1 - LOW] = h.take(at), byte
    return upto


def count_keys(tables: list[np.ndarray], keys: np.ndarray, code: Code) -> None:
    """Count the branches taken; a byte that comes often under a context is looked up once.

    Only the slots met are touched, however large the tables are. The keys are sorted in place.
    """
    for table, bits, row in zip(tables, SLOT_BITS, keys, strict=True):
        row.sort()
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), row[1:] != row[:-1])))
        times = np.diff(first, append=len(row)).astype(np.int32)
        for a in range(0, len(first), BLOCK):
            own = row[first[a : a + BLOCK]]
            halves = own.view(np.uint32).reshape(-1, 2)
            size, branch, slots = _decisions([halves[:, LOW]], [bits], halves[:, 1 - LOW], code, True)
            for slot in slots:
                slot *= 2
                slot += branch
                np.add.at(table, slot, np.repeat(times[a : a + BLOCK], size))


def count_into(tables: list[np.ndarray], data: np.ndarray, code: Code, scored: np.ndarray) -> None:
    """Count the branches taken in some data."""
    keys = np.empty((len(tables), len(data)), np.uint64)
    count_keys(tables, keys[:, : add_keys(keys, 0, data, scored)], code)


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of slots from how often either branch was taken, as 16-bit numbers, and their gates."""
    n = counts + 0.4
    odds = np.rint(np.clip(np.log(n[:, 1] / n[:, 0]), -15, 15) * SCALE).astype(np.int16)
    return odds, np.searchsorted(GATE_COUNTS, counts.sum(1), side="right").astype(np.uint8)


@dataclass(frozen=True)
class Tables:
    code: Code
    odds: np.ndarray  # of all slots of all contexts
    gates: np.ndarray  # of the slots of the gate's context

    @cached_property
    def by_context(self) -> list[np.ndarray]:
        """The log odds per context; the gate's context has rows of log odds and gate, which are read at once."""
        odds = self.odds.copy()  # memory of numpy's own, in large pages
        out = [odds[a:b] for a, b in zip(_STARTS[:-1], _STARTS[1:], strict=True)]
        out[GATE] = np.stack((out[GATE], self.gates.astype(np.int16)), 1).view(np.int32)[:, 0]
        return out


def steps(count: int) -> Iterator[tuple[int, int]]:
    """Start and size of the steps of ``count`` decisions: short ones first, so that short texts are adapted to."""
    at, size = 0, FIRST_STEP
    while at < count:
        yield at, size
        at, size = at + size, min(2 * size, STEP)


class Mixer:
    """Weights and refinement tables of some texts, all read at the same time."""

    def __init__(self, lanes: int) -> None:
        self.weights = np.tile(np.array(START_WEIGHTS, np.float32), (lanes, 1, 1))  # text, gate, context
        grid = (np.arange(BUCKETS, dtype=np.float32) - BUCKETS // 2) / 2
        self.refined = np.tile(1 / (1 + np.exp(-grid)), (lanes, 1)).astype(np.float32)

    def read(
        self, x: Sequence[np.ndarray], gate: np.ndarray, branch: np.ndarray, ends: np.ndarray, unit: float = 1.0
    ) -> np.ndarray:
        """Natural log probability of the decisions ``ends[i] .. ends[i + 1]`` of every text i; ``x`` counts in units."""
        order = np.argsort(ends[:-1] - ends[1:], kind="stable")  # longest first
        first, count = ends[:-1], np.diff(ends)
        columns, lack = [*x, gate, branch], int(ends[-1]) + STEP - len(branch)
        if lack > 0:  # the last step of a text reads on behind its end
            columns = [np.concatenate((v, np.zeros(lack, v.dtype))) for v in columns]
        runs = {  # views of all runs of a step's size
            size: [np.lib.stride_tricks.sliding_window_view(v, size) for v in columns]
            for size in {size for _, size in steps(int(count.max(initial=0)))}
        }
        out = np.empty(len(order))
        for a in range(0, len(order), LANES):  # few at a time: the arrays of a step stay in the processor's cache
            own = order[a : a + LANES]
            out[own] = self._read(own, first[own], count[own], runs, unit)
        return out

    def _read(
        self, lanes: np.ndarray, first: np.ndarray, count: np.ndarray, runs: dict[int, list[np.ndarray]], unit: float
    ) -> np.ndarray:
        """The same for some texts, longest first, whose decisions begin at ``first``."""
        weights, refined = self.weights[lanes], self.refined[lanes]
        total = np.zeros(len(lanes))
        for t, size in steps(int(count[0])):
            live = int(np.searchsorted(-count, -t))  # texts with more than t decisions
            whole = int(np.searchsorted(-count, -(t + size), side="right"))  # texts with all decisions of the step
            own = np.empty((live, len(START_WEIGHTS[0]), size), np.float32)
            g, bit = np.empty((live, size), np.uint8), np.empty((live, size), np.float32)
            begin = first[:live] + t
            for out, found in zip((*own.swapaxes(0, 1), g, bit), runs[size], strict=True):
                out[:] = found[begin]
            chosen = np.empty((live, len(_GATES), size), np.float32)
            for k in _GATES:
                np.equal(g, k, out=chosen[:, k], casting="unsafe")
            # The unit is a power of 2: it may as well scale the weights, no digit changes.
            by_gate = np.matmul(weights[:live] * np.float32(unit), own)
            by_gate *= chosen
            mixed = by_gate[:, 0] + by_gate[:, 1]
            for k in _GATES[2:]:
                mixed += by_gate[:, k]
            np.maximum(mixed, np.float32(-14), out=mixed)
            np.minimum(mixed, np.float32(14), out=mixed)
            p = np.negative(mixed)
            np.exp(p, out=p)
            p += np.float32(1)
            np.reciprocal(p, out=p)
            mixed *= np.float32(2)
            mixed += np.float32(BUCKETS // 2 + 0.5)
            cell = mixed.astype(np.int32)
            cell += np.arange(0, live * BUCKETS, BUCKETS, dtype=np.int32)[:, None]
            table = refined[:live].reshape(-1)
            chance = table.take(cell)
            chance += p
            chance *= np.float32(0.5)
            chance += bit - np.float32(1)
            np.abs(chance, out=chance)  # of the branch that was taken; both add up to 1
            np.maximum(chance, np.float32(1e-7), out=chance)
            error = np.subtract(bit, p, out=p)
            cell *= 2
            cell += bit.astype(np.int32)
            if whole < live:  # decisions of other texts count for nothing
                outside = np.arange(size) >= (count[whole:live] - t)[:, None]
                chance[whole:][outside] = 1
                error[whole:][outside] = 0
                cell[whole:][outside] = 2 * len(table)
            total[:live] += np.log(chance, out=chance).sum(1)
            chosen *= error[:, None]
            weights[:live] += RATE * unit * np.matmul(chosen, own.transpose(0, 2, 1))
            # Per cell, how often either branch was taken.
            met = np.bincount(cell.reshape(-1), minlength=2 * len(table))[: 2 * len(table)].reshape(-1, 2)
            n = met[:, 0] + met[:, 1]
            moves = met[:, 1] * (1 - table).astype(np.float64) - met[:, 0] * table.astype(np.float64)
            # Never past the mean of the step's branches, so it stays a probability.
            refined[:live] += (moves / (n + 1 / REFINE_RATE)).reshape(live, BUCKETS)
        self.weights[lanes], self.refined[lanes] = weights, refined
        return total


_GATES = np.arange(len(GATE_COUNTS) + 1, dtype=np.uint8)


def look_up(
    data: np.ndarray, scored: np.ndarray, model: Tables, x: np.ndarray, gate: np.ndarray, branch: np.ndarray
) -> int:
    """Log odds of every context, gate and branch of all decisions, put into the given arrays; their number."""
    at = 0
    for _, taken, slots in in_blocks(data, model.code, scored):
        own = slice(at, at + len(taken))
        branch[own] = taken
        for k, (table, slot) in enumerate(zip(model.by_context, slots, strict=True)):
            found = table.take(slot)
            if k == GATE:
                found = found.view(np.int16)
                gate[own] = found[1::2]
                found = found[::2]
            x[k, own] = found
        at = own.stop
    return at


_memory: dict[str, np.ndarray] = {}


def _columns(use: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds per context, gate and branch of ``n`` decisions and a step behind them, in memory used before."""
    n += STEP
    kinds = len(SLOT_BITS)
    if use not in _memory or len(_memory[use]) < n:
        _memory[use] = np.empty((n, 2 * kinds + 2), np.uint8)
    flat = _memory[use].reshape(-1)
    x, gate, branch = flat[: 2 * kinds * n].view(np.int16).reshape(kinds, n), *flat[2 * kinds * n : (2 * kinds + 2) * n].reshape(2, n)
    x[:, -STEP:], gate[-STEP:], branch[-STEP:] = 0, 0, 0
    return x, gate, branch


def score_texts(texts: list[str | None], model: Tables) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every text, and the number of bytes it predicts."""
    data, offsets, _ = streams(texts)
    scores = np.zeros(len(texts))
    size = np.diff(offsets)
    whole = size <= WINDOW
    n = model.code.length.take(data)
    for i in range(len(PAD)):
        n[offsets[:-1] + i] = 0
    n = np.add.reduceat(n, offsets[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)

    x, gate, branch = _columns("texts", int(n[whole].sum()))
    at, mixer, current = 0, None, -1
    for low, high, scored in pieces_of(data, offsets):
        i = int(np.searchsorted(offsets, low + len(PAD), side="right")) - 1
        if whole[i]:
            at += look_up(data[low:high], scored, model, x[:, at:], gate[at:], branch[at:])
            continue
        if i != current:
            mixer, current = Mixer(1), i  # a window of the same long text goes on with its state
        own = _columns("window", int(model.code.length.take(data[low:high][scored]).sum()))
        m = look_up(data[low:high], scored, model, *own)
        scores[i] += mixer.read(*own, np.array([0, m]), 1 / SCALE)[0]
    ends = np.concatenate(([0], np.cumsum(n[whole])))
    scores[whole] = Mixer(len(ends) - 1).read(x, gate, branch, ends, 1 / SCALE)
    return scores / np.log(10), size - len(PAD)


def unigram(texts: pa.Array, table: tuple[np.ndarray, np.ndarray], floor: float) -> list[np.ndarray]:
    """n_tokens, n_known and base_score of every text, from the sorted words and their counts."""
    word, n = table
    ids, bounds, tokens = token_ids(texts)
    # Each word once and in order: the table is read from front to back.
    back, own = pd.factorize(ids.view(np.int64))
    order = np.argsort(own)
    at = np.empty(len(own), np.int64)
    at[order] = np.minimum(np.searchsorted(word, own[order]), max(0, len(word) - 1))
    c = np.where(word[at] == own, n[at], 0) if len(word) else np.zeros(len(own), np.int64)
    terms = np.log10((c + 0.5) / floor)
    return [tokens, *(np.add.reduceat(v.take(back), bounds[:-1]) for v in ((c > 0).astype(np.int64), terms))]


def joined_unigram(docs: DataFrame, counts: DataFrame, floor: float) -> DataFrame:
    """(row_id, n_tokens, n_known, base_score) per row, for more words than are broadcast."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds, _ = token_ids(part.column("text"))
                rows = part.column("row_id").to_numpy()
                for i in range(len(rows)):
                    word, n = np.unique(ids[bounds[i] : bounds[i + 1]].view(np.int64), return_counts=True)
                    arrays = [pa.array(np.full(len(word), rows[i])), pa.array(word), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row_id", "word", "times"])

    own = docs.mapInArrow(bags, "row_id long, word long, times long").join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    return own.groupBy("row_id").agg(
        F.sum("times").alias("n_tokens"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(floor))).alias("base_score"),
    )


def score_documents(docs: DataFrame, held_out: str, *, limit: int = WORDS_BROADCAST) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    ``held_out`` is the SQL condition of the rows that are not learned from. ``score`` is the log10 probability of the
    text under the mixed model, ``base_score`` under the unigram model; ``n_bytes`` counts the bytes both predict, so
    ``-score / n_bytes / log10(2)`` is the cost in bits per byte.
    """
    docs = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")
    )
    training = docs.where(~F.col("held_out")).select("text")
    counts = materialise(word_counts(training), "word_counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("word").alias("v")).first()
    model = train(training)
    floor = sums["n"] + 0.5 * (sums["v"] + 1)
    table = None
    if sums["v"] <= limit:
        word, n = (counts.toArrow().column(c).to_numpy() for c in ("word", "n"))
        order = np.argsort(word)
        table = docs.sparkSession.sparkContext.broadcast((word[order], n[order]))
    scored = docs.withColumn("row_id", F.monotonically_increasing_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SCORED):
                text, found = part.column("text"), [part.column(c) for c in ("row_id", "doc_id", "held_out")]
                found += map(pa.array, score_texts(text.to_pylist(), model.value))
                if table:
                    found += map(pa.array, unigram(text, table.value, floor))
                yield pa.RecordBatch.from_arrays(found, names=names)

    schema = "row_id long, doc_id long, held_out boolean, score double, n_bytes long"
    if table:
        schema += ", n_tokens long, n_known long, base_score double"
    names = [column.split()[0] for column in schema.split(", ")]
    found = scored.mapInArrow(work, schema)
    if not table:
        found = found.join(joined_unigram(scored.select("row_id", "text"), counts, floor), "row_id")
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(sums["n"]).cast("long").alias("train_tokens"),
        "base_score", "score", "n_bytes",
    )
