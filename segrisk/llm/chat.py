"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
A conversation with turns behind its last assistant turn (or without any) gets one more example without a target, so
that the output holds every turn.

Template: ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. Control strings cannot occur
inside texts: each run of ``|`` behind ``<`` is made one longer, and one shorter again when read back. Roles have
their backslashes and line breaks escaped too.

The examples of a conversation are prefixes of one text, so a row holds the context as a prefix length of the
conversation's formatted text, which is stored once; ``examples`` writes each example out. Output therefore grows with
the square of a conversation's turns only where examples are written out.

Cases: NULL texts and roles are empty. Turns are ordered by ``turn`` (NULL first), then role, then text; repeated rows
are turns of their own. Rows without conv_id form one conversation. Other columns are ignored. A conversation is one
training example, so it has to fit in one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"

_RUN = re.compile(r"<(\|+)")
_LONGER = re.compile(r"<\|(\|+)")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + r"\n", re.DOTALL)
_ROLE = {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    return _RUN.sub(r"<|\1", text)


def unescape(text: str) -> str:
    return _LONGER.sub(r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE[m[0]], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the span of the text of each assistant turn in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == TARGET:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP + "\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(parts), spans


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)]


FORMATTED = "conv_id long, formatted string, ends array<long>, target_starts array<long>, target_ends array<long>"


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: its formatted text, and end, target start and target end of each of its examples in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conversation in batch.to_pylist():
                text, spans = format_turns([(t["role"], t["text"]) for t in conversation["turns"]])
                ends = [end + len(STOP) + 1 for _, end in spans]
                starts, stops = [a for a, _ in spans], [b for _, b in spans]
                if not ends or ends[-1] < len(text):
                    ends.append(len(text))
                    starts.append(len(text))
                    stops.append(len(text))
                values = (conversation["conv_id"], text, ends, starts, stops)
                arrays = [pa.array([v], f.type) for v, f in zip(values, _FORMATTED, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_FORMATTED)

    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    conversations = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    return conversations.mapInArrow(work, FORMATTED)


_LONGS = pa.list_(pa.int64())
_FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("ends", _LONGS), ("target_starts", _LONGS), ("target_ends", _LONGS)]
)


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one row per example, the loss span in characters of its text.

    Nothing of the last example is trainable where the conversation does not end with an assistant turn.
    """
    spans = F.arrays_zip("ends", "target_starts", "target_ends")
    rows = formatted.select("conv_id", "formatted", F.posexplode(spans).alias("example", "span"))
    return rows.select(
        "conv_id",
        "example",
        F.substr("formatted", F.lit(1), F.col("span.ends").cast("int")).alias("text"),
        F.col("span.target_starts").alias("loss_start"),
        F.col("span.target_ends").alias("loss_end"),
    )


def read_back(expanded: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: turns, trainable text and size.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (characters of all examples),
    n_examples. Every example is read; the turns are those of the longest.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                turns = parse_turns(row["text"])
                digest = hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role}\n{text}\n".encode())
                loss = unescape(row["text"][row["loss_start"] : row["loss_end"]])
                values = (row["conv_id"], row["example"], len(turns), digest.hexdigest(), loss, len(row["text"]))
                arrays = [pa.array([v], f.type) for v, f in zip(values, _READ, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_READ)

    found = expanded.mapInArrow(read, "conv_id long, example int, n_turns long, turns string, loss string, chars long")
    return (
        found.groupBy("conv_id")
        .agg(
            F.max(F.struct("example", "n_turns", "turns")).alias("last"),
            F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
            F.sum("chars").alias("formatted_chars"),
            F.count(F.lit(1)).alias("n_examples"),
        )
        .select(
            "conv_id",
            F.col("last.n_turns").alias("n_turns"),
            F.col("last.turns").alias("turns_sha256"),
            F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
            "formatted_chars",
            "n_examples",
        )
        .select(
            "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
        )
    )


_READ = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("chars", pa.int64())]
)


def prefix_target_examples(rows: DataFrame) -> DataFrame:
    """The training examples of a table of turns (conv_id, turn, role, text)."""
    return examples(format_conversations(rows))
