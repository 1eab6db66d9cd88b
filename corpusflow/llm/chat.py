"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, one turn after the other::

    <s>[INST] role
    text[/INST]</s>

Control strings inside roles and texts are escaped by a backslash behind their first
character (one more if there are backslashes already), so that the rendering holds
no control string but the template's and reads back exactly. The rendering is encoded
once with character offsets; the sorted spans of the assistant's texts are met with
the sorted token spans by binary search, which gives the token mask and, as the
tokens cover every character, the character spans under the loss.

Conversations come to a task sorted by conversation and turn and are handled one at
a time, so a task holds one conversation. Turns of one conversation are ordered by
turn (null first), then role and text; repeated rows are turns of their own; null role
and null text are empty; rows with a null conv_id form one conversation; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

OPEN, CLOSE = "<s>[INST] ", "[/INST]</s>\n"
#: The template's control strings; they start with "<" or "[" and hold neither after it.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
LEARNED = "assistant"


def escape(text: str) -> str:
    return re.sub(CONTROL, r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The rendering, and the (start, end) of each assistant text in it."""
    parts, at, learned = [], 0, []
    for role, text in turns:
        # A role is one line: its own line breaks are written as a backslash and n.
        head = OPEN + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
        body = escape(text)
        at += len(head)
        if role == LEARNED and body:
            learned.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), np.array(learned, np.int64).reshape(-1, 2)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    turns = []
    for part in rendered.split(CLOSE)[:-1]:
        role, body = part[len(OPEN) :].split("\n", 1)
        role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role)
        turns.append((unescape(role), unescape(body)))
    return turns


def align(offsets: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token mask, character spans under it). ``offsets``: sorted token spans; ``learned``: sorted turn spans."""
    mask = np.zeros(len(offsets), bool)
    found = []
    for start, end in learned:
        first = int(np.searchsorted(offsets[:, 1], start, "right"))
        last = int(np.searchsorted(offsets[:, 0], end, "left"))
        if first < last:
            mask[first:last] = True
            found.append((max(start, offsets[first:last, 0].min()), min(end, offsets[first:last, 1].max())))
    return mask, np.array(found, np.int64).reshape(-1, 2)


def _tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep their white space
    return t


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """(conv_id, turns) of sorted rows, one conversation at a time."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, [(role, text) for _, role, text in group]


def format_chats(chats: DataFrame, path: str) -> DataFrame:
    """Per conversation: conv_id, formatted, token_ids, loss_mask (per token), loss_spans (characters)."""
    small_batches(chats.sparkSession, 2000)
    kind = chats.schema["conv_id"].dataType.simpleString()
    rows = chats.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for conv, turns in conversations(batches):
            text, learned = render(turns)
            encoding = tokenizer.encode(text, add_special_tokens=False)
            mask, found = align(np.array(encoding.offsets, np.int64).reshape(-1, 2), learned)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "formatted": text, "token_ids": encoding.ids, "loss_mask": mask.tolist(), "loss_spans": found.tolist()}],
                schema=out,
            )

    out = pa.schema(
        [("conv_id", _arrow(kind)), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("loss_spans", pa.list_(pa.list_(pa.int64())))]
    )
    return rows.mapInArrow(
        run, f"conv_id {kind}, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<array<long>>"
    )


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of :func:`format_chats` rows finds in them: turns and the text under the loss."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in found)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv, len(turns), _sha(said), len(loss), _sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
