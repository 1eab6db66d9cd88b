"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without case and punctuation. A seed is a run of ``SEED`` words of a
test item whose probability under the corpus's word frequencies is at most ``RARE``
(an item with fewer than ``LEAST`` such seeds takes its rarest ones). The rarity comes
from single words, so a passage that a third of the corpus has copied keeps its seeds.

Texts are read once for the counts of the items' words and once for the seeds: a bitmap
of fixed size (``2**BITS`` bits) passes the seeds' hashes, and what passes is cut out with
the longest item's words on either side, as a passage. Passages meet items in a join on
the seed, each pair once, and are aligned: a word's match gains 1, a mismatch or a gap
costs 1. A pair is reported if its score reaches ``share`` of the item's words, or
``enough``.

Null text or an item without ``SEED`` words has no seeds and is never reported; items
that repeat are items of their own; repeated rows of documents are reported row by row;
empty tables give no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bitmap, chunks, in_bitmap, keyed, materialize, small_batches, windows

SEED, RARE, LEAST = 3, 1e-8, 6
BITS = 22
#: Words of an item, and of a step through a text, that are aligned at once (packed cells hold 3 times as many).
PART = 1 << 18


def _item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words): 64-bit word hashes as bytes, of items with SEED words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, plain=True)
                split = np.split(words.hashes(), np.cumsum(words.per_doc)[:-1])
                part = batch.slice(first, last - first)
                n = pa.array(words.per_doc.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item"), part.column("doc_id"), n, pa.array([w.tobytes() for w in split], pa.binary())], ["item", "item_id", "n_words", "words"]
                )

    kind = items.schema["doc_id"].dataType.simpleString()
    return items.mapInArrow(run, f"item long, item_id {kind}, n_words long, words binary").where(F.col("n_words") >= SEED)


def _word_counts(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(word, n, total) of the wanted words' hashes that pass a bitmap, counted over all texts."""
    bits = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, counts = 0, [], []
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                found = Words(data, offsets, plain=True).hashes()
                total += len(found)
                w, n = np.unique(found[in_bitmap(bits.value, found)], return_counts=True)
                words.append(w)
                counts.append(n)
                if len(words) > 64:
                    words, counts = [[x] for x in _summed(words, counts)]
        w, n = _summed(words, counts)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])

    return rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(words: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w, at = np.unique(np.concatenate(words), return_inverse=True)
    return w, np.bincount(at, np.concatenate(counts), minlength=len(w)).astype(np.int64)


def _seeds(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(seed, item) of the rare seeds of each item. ``counts``: with all texts' total at word null."""
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                w = np.frombuffer(words, np.uint64)
                seeds, _ = windows(w, np.zeros(len(w), np.int64), SEED)
                n = len(seeds)
                at = np.repeat(np.arange(n), SEED)
                word = np.concatenate([w[i : i + SEED] for i in range(n)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * SEED, item)), pa.array(at), pa.array(seeds.view(np.int64)[at]), pa.array(word)], ["item", "at", "seed", "word"]
                )

    each = items.mapInArrow(split, "item long, at long, seed long, word long").join(counts.where("word IS NOT NULL"), "word", "left")
    chance = F.sum(F.log((F.coalesce("n", F.lit(0)) + 0.5) / total)).alias("chance")
    seeds = each.groupBy("item", "at", "seed").agg(chance).groupBy("item", "seed").agg(F.min("chance").alias("chance"))
    ranked = seeds.selectExpr("*", "row_number() OVER (PARTITION BY item ORDER BY chance, seed) AS place")  # an item's seeds
    return ranked.where((F.col("chance") <= math.log(RARE)) | (F.col("place") <= LEAST)).select("seed", "item")


def _passages(rows: DataFrame, bits: np.ndarray, reach: int) -> DataFrame:
    """(passage, doc_id, first, words, seeds): the parts of texts around the seeds that pass the bitmap."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, plain=True)
                hashes = words.hashes()
                seeds, at = windows(hashes, words.doc, SEED)
                hit = in_bitmap(shared.value, seeds)
                seeds, at = seeds[hit], at[hit]
                if not len(at):
                    continue
                doc = words.doc[at]
                start = np.concatenate([[0], np.cumsum(words.per_doc)])
                cut = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)) + 1
                out = []
                for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]), strict=True):
                    d = doc[a]
                    low, high = max(start[d], at[a] - reach), min(start[d + 1], at[b - 1] + SEED + reach)
                    out.append((first + d, low - start[d], hashes[low:high].tobytes(), np.unique(seeds[a:b]).view(np.int64).tolist()))
                rows_, low, text, found = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows_)), pa.array(low, pa.int64()), pa.array(text, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                    ["doc_id", "first", "words", "seeds"],
                )

    found = rows.mapInArrow(run, f"doc_id {kind}, first long, words binary, seeds array<long>")
    return materialize(found.withColumn("passage", F.monotonically_increasing_id()), "passages")


def align(text: np.ndarray, item: np.ndarray, part: int = PART) -> tuple[int, int, int, int]:
    """Best local alignment: (score, first word, word after the last, matched words) in ``text``.

    An alignment of n item words that scores at all spans under 2n words of the text, so a longer
    text is aligned in windows that overlap by so many; the best of them (the first on ties) is
    the text's. Items of more than ``part`` words are aligned ``part`` words at a time."""
    best = (0, 0, 0, 0)
    for i in range(0, max(1, len(item)), part):
        words = item[i : i + part]
        lap = 2 * len(words)
        for at in range(0, max(1, len(text) - lap), part):
            score, start, end, matched = _align(text[at : at + part + lap], words)
            if (score, matched) > (best[0], best[3]):
                best = (score, at + start, at + end, matched)
    return best


def _align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """:func:`align` of texts and items whose numbers of words fit the packed cells.

    Row by row over the item; gaps within a row follow from a running maximum. Each cell
    carries the start of its alignment and its matches, packed behind its score.
    """
    n = len(text)
    columns = np.arange(n + 1, dtype=np.int64)
    # packed: score, matches, then the start (a later start wins ties)
    shift_m, shift_s = 22, 42
    one = (1 << shift_s) + (1 << shift_m)
    gap = 1 << shift_s
    fresh = columns.copy()
    row, best = fresh.copy(), (0, 0)
    for word in item:
        step = np.empty(n + 1, np.int64)
        step[0] = fresh[0]
        step[1:] = np.where(text == word, row[:-1] + one, row[:-1] - gap)
        np.maximum(step, row - gap, out=step)
        np.maximum(step, fresh, out=step)
        row = np.maximum.accumulate(step + columns * gap) - columns * gap
        np.maximum(row, fresh, out=row)
        at = int(np.argmax(row >> shift_m))
        if row[at] >> shift_m > best[0] >> shift_m:
            best = (int(row[at]), at)
    value, end = best
    return value >> shift_s, value & ((1 << shift_m) - 1), end, (value >> shift_m) & ((1 << (shift_s - shift_m)) - 1)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    share: float = 0.5,
    enough: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per passage and item that it copies: doc_id, item_id, score, item_words, matched, start_word, end_word."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    tests = keyed(items, item_col, item_text_col).withColumn("item", F.monotonically_increasing_id())
    tests = materialize(_item_words(tests), "test-items", force=True)
    longest = tests.agg(F.max("n_words")).first()[0]
    if longest is None:
        longest = 0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column("words").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(words, np.int64)))], ["hash"])

    counts = materialize(_word_counts(rows, bitmap(tests.select("words").mapInArrow(each, "hash long"), BITS)), "test-words")
    seeds = materialize(_seeds(tests, counts), "seeds")
    passages = _passages(rows, bitmap(seeds.select(F.col("seed").alias("hash")), BITS), int(longest))
    pairs = passages.select("passage", F.explode("seeds").alias("seed")).join(seeds, "seed").select("passage", "item").distinct()
    met = pairs.join(passages.drop("seeds"), "passage").join(tests.withColumnRenamed("words", "item_words_"), "item")

    kinds = (passages.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, item, first in zip(*(batch.column(c).to_pylist() for c in ("words", "item_words_", "first")), strict=True):
                score, start, end, matched = align(np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64))
                out.append((score, matched, first + start, first + end))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(columns[0], pa.int64()), batch.column("n_words"), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "item_id", "score", "item_words", "matched", "start_word", "end_word"],
            )

    found = met.select("doc_id", "item_id", "n_words", "first", "words", "item_words_").mapInArrow(
        run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score long, item_words long, matched long, start_word long, end_word long"
    )
    return found.where(F.col("score") >= F.least(F.ceil(F.lit(share) * F.col("item_words")), F.lit(enough)))
