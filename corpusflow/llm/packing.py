"""Bounded-space online packing of documents into sequences of at most ``size`` tokens.

A document is its tokenizer ids and the id that ends it. Each task keeps at most
``open_windows`` windows. A document of ``size`` tokens or more fills whole sequences
first; the rest goes to the window where it leaves the least room, and if none has
room the fullest window is emitted and a new one opened. Windows still open at the
end of a task are leftovers: a second level cuts them freely so that every sequence
but the last of a merging task is full, and splits that last one into powers of two,
which need no padding.

The result has one row per piece: doc_id, start (ids of its document before it),
length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Null
text is empty (one piece, the end id alone); repeated ids and rows are packed each on
its own; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import keyed, materialize, small_batches

#: Tasks whose leftovers one merging task reads, and rows of an output batch.
FAN_IN, BATCH = 64, 2000
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]


class _Out:
    """Collects pieces and hands them out in batches."""

    def __init__(self, kind: pa.DataType, first_id: int, size: int):
        self.types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        self.rows, self.next_id, self.size = [], first_id, size

    def add(self, pieces: list[tuple], is_open: bool = False) -> None:
        """``pieces``: (doc_id, start, ids, doc_tokens) that make up one sequence."""
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self.next_id, at, is_open))
            at += n
        self.next_id += 1

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = list(zip(*self.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], NAMES)
            self.rows = []


def _first(path: str, end_id: int, size: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pretoken.encoder(path)
        tail = end_id.to_bytes(4, "little")
        out, windows = None, []  # a window: [tokens, pieces]
        for batch in batches:
            if out is None:
                out = _Out(batch.column("doc_id").type, TaskContext.get().partitionId() << 32, size)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode.ids(text.as_py()) + tail
                total, at = len(ids) // 4, 0
                while total - at >= size:
                    out.add([(doc, at, ids[4 * at : 4 * (at + size)], total)])
                    at += size
                rest = total - at
                if rest:
                    fits = [w for w in windows if w[0] + rest <= size]
                    best = max(fits, key=lambda w: w[0], default=None)
                    if best is None:
                        if len(windows) >= open_windows:
                            fullest = max(windows, key=lambda w: w[0])
                            windows.remove(fullest)
                            out.add(fullest[1])
                        windows.append(best := [0, []])
                    best[0] += rest
                    best[1].append((doc, at, ids[4 * at :], total))
                    if best[0] == size:
                        windows.remove(best)
                        out.add(best[1])
                yield from out.flush(BATCH)
        if out is not None:
            for _, pieces in windows:
                out.add(pieces, is_open=True)
            yield from out.flush()

    return run


def _leftovers(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pieces, room = None, [], size

        def powers_of_two() -> None:
            """Cut what is left into sequences of 2**i tokens, the largest first."""
            left = sum(len(p[2]) // 4 for p in pieces)
            rest = pieces[::-1]
            while left:
                want = 1 << (left.bit_length() - 1)
                left -= want
                sequence = []
                while want:
                    doc, start, ids, total = rest.pop()
                    take = min(want, len(ids) // 4)
                    sequence.append((doc, start, ids[: 4 * take], total))
                    if 4 * take < len(ids):
                        rest.append((doc, start + take, ids[4 * take :], total))
                    want -= take
                out.add(sequence)

        for batch in batches:
            if out is None:
                out = _Out(batch.column("doc_id").type, (1 << 60) | TaskContext.get().partitionId() << 32, size)
            for row in batch.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                doc, start, ids, total = row.values()
                while ids:
                    take = min(room, len(ids) // 4)
                    pieces.append((doc, start, ids[: 4 * take], total))
                    start, ids, room = start + take, ids[4 * take :], room - take
                    if not room:
                        out.add(pieces)
                        pieces, room = [], size
            yield from out.flush(BATCH)
        if out is not None:
            powers_of_two()
            yield from out.flush()

    return run


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 1,
    size: int = 2048,
    open_windows: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, laid out in sequences of at most ``size`` tokens."""
    path = path or pretoken.default_path()
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
    # Both levels read the first one's pieces, so these are written once.
    first = materialize(rows.mapInArrow(_first(path, end_id, size, open_windows), schema), "packed")
    left = first.where("open")
    tasks = left.select(F.shiftright("sequence_id", 32).alias("task")).agg(F.countDistinct("task")).first()[0]
    merged = (
        left.repartition(max(1, -(-tasks // FAN_IN)), "sequence_id")
        .sortWithinPartitions("sequence_id", "offset")
        .mapInArrow(_leftovers(size), schema)
    )
    return first.where("not open").unionByName(merged).drop("open")
