"""Shared helpers: byte-level word tables of Arrow text columns, and lineage cuts.

A *word* is a maximal run of bytes outside space, tab, LF, VT, FF and CR. Words
are found and hashed with numpy over the Arrow buffer itself: no Python string is
made. A hash is a 64-bit polynomial of the bytes, mixed; equal words always hash
alike. A polynomial modulo 2**64 takes some different strings of 1,024 bytes or more as
equal (Thue-Morse strings), so a word of more than LONG bytes has a digest instead. Null
text is empty text everywhere. Helper columns take names that the rows don't have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

__all__ = ["CHUNK_BYTES", "Words", "bitmap", "free_name", "may_match", "without", "in_bitmap", "chunks", "materialize", "mix", "keyed", "small_batches", "spans", "windows", "with_key"]

#: Bytes of text that are handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Multiplier of the polynomial hash (odd, so it has an inverse modulo 2**64).
MULT = 0x9E3779B97F4A7C15 | 1
#: Bytes above which a slice is hashed by a digest: half the length of the first strings that collide.
LONG = 512
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII bytes that are neither letters nor digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_pow: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small (rows are long)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, text[, more]): only the columns an operator reads, null text as empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *more)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(docs: DataFrame, id_col: str = "doc_id", ordered: bool = False) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells all its rows apart: the id column if its
    values are distinct and none is null, else a row number that is written with the rows.
    ``ordered``: the key is an integer in the order of the ids (null first)."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(id_col).alias("ids")).first()
    if n["rows"] == n["ids"] and (not ordered or docs.schema[id_col].dataType.simpleString() in ("bigint", "int")):
        return docs, id_col
    if ordered:
        docs = docs.orderBy(F.col(id_col).asc_nulls_first())
    row = free_name(docs.columns, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", force=True), row


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit integers (splitmix finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i modulo 2**64 for i < n."""
    if len(_pow.get("up", ())) < n:
        n = max(n, 2 * CHUNK_BYTES)
        for key, m in (("up", MULT), ("down", pow(MULT, -1, 1 << 64))):
            a = np.full(n, m, np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["up"][:n], _pow["down"][:n]


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column, and the n+1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of texts of about ``size`` bytes."""
    if not len(column):
        return
    data, offsets = spans(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Prefix:
    """Polynomial prefix sums of bytes: the hash of any slice in O(1)."""

    def __init__(self, data: np.ndarray, values: np.ndarray | None = None):
        """``values``: what stands for each byte (default: the byte and 1), for a hash independent of another."""
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        items = data.astype(np.uint64) + np.uint64(1) if values is None else values[data]
        np.cumsum(items * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: Prefix | None = None) -> np.ndarray:
    """Hashes of slices of the bytes; ``prefix``: the polynomial sums of the same bytes, if at hand."""
    out = (prefix or Prefix(data)).of(start, end)
    for i in np.flatnonzero(end - start > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals U+00C0 to U+00DE as small letters."""
    out = LOWER[data]
    if len(data) > 1:
        second = data[1:]
        out[1:][(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


class Words:
    """Words of a run of texts: ``start``, ``end`` (bytes), ``doc`` (row in the run), ``per_doc`` counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False):
        """``lower``: A-Z as a-z. ``plain``: words are runs of ASCII letters and digits and of other
        code points, with Latin capitals as small letters: case and punctuation don't tell words apart."""
        self.data, self.offsets, n = (fold(data) if plain else LOWER[data] if lower else data), offsets, len(data)
        self.n_docs = len(offsets) - 1
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.per_doc = np.zeros(self.n_docs, np.int64)
            return
        white = (MARKS if plain else WHITE)[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = white[:-1], white[1:]
        first, last = offsets[:-1], offsets[1:]
        full = last > first
        before[first[full]] = True
        after[last[full] - 1] = True
        self.start = np.flatnonzero(~white & before)
        self.end = np.flatnonzero(~white & after) + 1
        self.per_doc = np.searchsorted(self.start, last) - np.searchsorted(self.start, first)
        self.doc = np.repeat(np.arange(self.n_docs), self.per_doc)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return slice_hashes(self.data, self.start, self.end)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words that stays in one text, and the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(MULT) + hashes[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(total[at]), at


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits as bytes, one set for each ``hash`` (64-bit): of one size whatever the rows."""
    slot = F.shiftrightunsigned("hash", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))
    found = hashes.select(F.shiftright(slot, 3).cast("int").alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for batch in found.toArrow().to_batches():  # 2**(bits - 3) rows of two integers at most
        out[batch.column("at").to_numpy()] = batch.column("bits").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def may_match(rows: DataFrame, key: str, found: DataFrame, column: str, bits: int = 23, name: str = "__may") -> DataFrame:
    """``rows`` with a boolean ``name``: false only if no value of ``column`` in ``found`` equals the key.

    A bitmap of the found values' hashes (2**bits bits, whatever their number) is broadcast as rows
    of 64 bits and tells it without a shuffle of the rows, and without a Python worker beside that of
    a function over the rows; it may be true for others, so a join has to follow."""
    kind = rows.schema[key].dataType
    at, word = free_name(rows.columns, "__at"), free_name(rows.columns, "__word")

    def slot(value: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)

    def bit(value: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (slot(value) % 64).cast("int"))

    value = F.col(column).cast(kind)
    map_ = found.select(F.shiftright(slot(value), 6).alias(at), bit(value).alias(word)).groupBy(at).agg(F.bit_or(word).alias(word))
    flagged = rows.withColumn(free_name([*rows.columns, at, word], "__slot"), F.shiftright(slot(F.col(key)), 6))
    own = flagged.columns[-1]
    flagged = flagged.join(F.broadcast(map_), F.col(own) == F.col(at), "left")
    return flagged.withColumn(name, F.coalesce(F.col(word).bitwiseAND(bit(F.col(key))) != 0, F.lit(False))).drop(own, at, word)


def without(rows: DataFrame, key: str, found: DataFrame, column: str) -> DataFrame:
    """``rows`` whose key is in no row of ``found``: only those that may be are shuffled."""
    name, may = free_name(rows.columns, "__found"), free_name(rows.columns, "__may")
    found = materialize(found.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct(), "found", force=True)
    flagged = may_match(rows, key, found, name, name=may)
    doubtful = flagged.where(F.col(may)).join(found, F.col(key) == F.col(name), "left_anti")
    return flagged.where(~F.col(may)).unionByName(doubtful).drop(may)
