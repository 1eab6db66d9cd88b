"""Quality rules judged by an isolation forest.

Every whole text gets its rule statistics in one pass (numpy over Arrow buffers).
A forest of random splits is grown on a bounded, hash-chosen sample of rows
(``TREES`` trees of ``SAMPLE`` rows each): rows whose paths are short are anomalous.
The threshold comes from all labelled rows: a fixed-size histogram of their scores
gives the score that best separates the qualities while at least ``keep_share`` of
the rows of quality 1 stay. A document is rejected if it fails the
base rules or scores above the threshold.

Null text has no words (and fails the base rules); repeated rows and ids give a row
each; a label of several rows of one id counts once a row; without labels of both
qualities nothing is rejected beyond the base rules; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Prefix, Words, chunks, keyed, materialize, mix, slice_hashes, small_batches, windows

TREES, SAMPLE = 100, 256
#: Rows that the trees' samples are drawn from: the bound of what is fitted on the driver.
POOL = 16_384
BINS = 2000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, EXCLAIM = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
EXCLAIM[list(b"!?")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaimed", "n_doubled", "n_lines"]


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices sorted by (text, key), and whether each has the key of the one before it."""
    key = mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    return order, same


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The rule statistics of a run of texts, by name."""
    words = Words(data, offsets)
    n = words.n_docs
    white = WHITE[data]
    out = {
        "n_words": words.per_doc,
        "word_chars": _per_doc(~white & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_doc(SYMBOLS[data], offsets),
        "n_upper": _per_doc(UPPER[data], offsets),
        "n_exclaimed": _per_doc(EXCLAIM[data], offsets),
    }
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, "right") - 1
    starts, ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([offsets[1:], breaks])
    doc = np.concatenate([np.arange(n), of])
    first, last = np.lexsort((starts, doc)), np.lexsort((ends, doc))
    starts, ends, doc = starts[first], ends[last], doc[first]
    spoken = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~white, out=spoken[1:])
    full = spoken[ends] > spoken[starts]
    prefix = Prefix(data)
    order, same = _again(slice_hashes(data, starts[full], ends[full], prefix), doc[full])
    out["n_lines"] = np.bincount(doc[full], minlength=n)
    out["n_dup_lines"] = np.bincount(doc[full][order[same]], minlength=n)
    repeated = doubled = np.zeros(n, np.int64)
    if len(words.start):
        each = slice_hashes(data, words.start, words.end, prefix)
        doubled = np.bincount(words.doc[1:][(each[1:] == each[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n)
        hashes, at = windows(each, words.doc, 5)
        order, same = _again(hashes, words.doc[at])
        twice = same.copy()
        twice[:-1] |= same[1:]
        cover = np.zeros(len(words.start) + 6, np.int64)
        np.add.at(cover, at[order[twice]], 1)
        np.add.at(cover, at[order[twice]] + 5, -1)
        repeated = np.bincount(words.doc[np.cumsum(cover)[: len(words.start)] > 0], minlength=n)
    out["n_repeat_words"], out["n_doubled"] = repeated, doubled
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and :data:`COUNTS` (long)."""
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                found = rule_counts(data, offsets)
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return rows.mapInArrow(run, _id(rows) + ", ".join(f"{c} long" for c in COUNTS))


def _id(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text: log shares of symbols, capitals, exclamations and doubled words.

    Shares do not grow with a text's length; a small constant below the line keeps
    those of a few words moderate, and the logarithm spreads the small ones.
    """
    words, chars = c["n_words"] + 20.0, c["word_chars"] + 100.0
    shares = ((c["n_symbols"] / chars, 0.01), (c["n_upper"] / chars, 0.3), (c["n_exclaimed"] / chars, 0.01), (c["n_doubled"] / words, 0.2))
    return np.column_stack([np.log1p(share / unit) for share, unit in shares])


@dataclass
class Forest:
    """Trees as arrays [tree, node]: feature (-1: a leaf), split value, left child (right is the next), depth of a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 ** -(mean path length / the expected one)."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.split[t][node]
                node = np.where(inner, self.left[t][node] + right, node)
            total += self.depth[t][node]
        return 2.0 ** -(total / max(1, len(self.feature)) / expected_path(self.sample))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n keys."""
    if n <= 1:
        return 0.0 if n < 1 else 1e-9
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 17) -> Forest:
    """A forest of ``trees`` trees, each grown on ``sample`` rows of ``x`` by random splits."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    limit = max(1, math.ceil(math.log2(max(sample, 2))))
    size = 2 ** (limit + 1) + 1
    f, s = np.full((trees, size), -1), np.zeros((trees, size))
    left, depth = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees if sample else 0):
        free, todo = 1, [(0, rng.choice(len(x), sample, replace=False), 0)]
        while todo:
            node, rows, d = todo.pop()
            part = x[rows]
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if d >= limit or len(rows) <= 1 or not len(wide):
                depth[t, node] = d + (expected_path(len(rows)) if len(rows) > 1 else 0)
                continue
            k = int(rng.choice(wide))
            cut = rng.uniform(low[k], high[k])
            right = part[:, k] >= cut
            f[t, node], s[t, node], left[t, node] = k, cut, free
            todo += [(free, rows[~right], d + 1), (free + 1, rows[right], d + 1)]
            free += 2
    return Forest(f, s, left, depth, sample)


def pool(stats: DataFrame, size: int = POOL) -> dict[str, np.ndarray]:
    """At most ``size`` rows of the statistics, chosen by a hash of all their columns: the trees' bounded sample."""
    n = stats.count()
    spread = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1 << 30))
    chosen = stats if n <= size else stats.where(spread < int((1 << 30) * 0.9 * size / n))
    rows = chosen.select(*COUNTS, spread.alias("spread")).orderBy("spread", *COUNTS).limit(size).toPandas()
    return {c: rows[c].to_numpy() for c in COUNTS}


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with a column ``anomaly``."""
    trees = stats.sparkSession.sparkContext.broadcast(forest)  # TREES x 2 * SAMPLE nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.value.scores(x))], [*batch.schema.names, "anomaly"])

    return stats.select("doc_id", *COUNTS).mapInArrow(run, _id(stats) + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def threshold(rows: DataFrame, labels: DataFrame, keep_share: float) -> float:
    """The histogram edge with the best share of bad rows rejected less twice that of good ones,
    among the edges that keep ``keep_share`` of the good; 1 if a quality has no labelled row."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    bins = (
        rows.where(~base_failed())
        .select("doc_id", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin"))
        .join(labels, "doc_id")
        .groupBy("bin", (F.col("quality") > 0).alias("good"))
        .count()
        .collect()  # at most 2 * BINS rows
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in bins:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return 1.0
    lost, caught = (x[::-1].cumsum()[::-1] / x.sum() for x in (good, bad))  # shares at or above an edge
    gain = np.where(lost <= 1 - keep_share, caught - 2 * lost, -np.inf)
    return float(BINS - np.argmax(gain[::-1])) / BINS


@dataclass
class Judge:
    """A fitted forest and the score from which a document is rejected."""

    forest: Forest
    limit: float

    def kept(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        return ~failed & (self.forest.scores(features(counts)) < self.limit)


def fit(docs: DataFrame, labels: DataFrame, keep_share: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> tuple[Judge, DataFrame]:
    """(the judge, the scored rows of ``docs``)."""
    stats = materialize(statistics(docs, id_col, text_col), "rule-statistics")
    forest = grow(features(pool(stats)))
    rows = scored(stats, forest)
    return Judge(forest, threshold(rows, labels, keep_share)), rows


def judge(docs: DataFrame, labels: DataFrame, keep_share: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, :data:`COUNTS`, anomaly, base_failed, kept."""
    fitted, rows = fit(docs, labels, keep_share, id_col, text_col)
    failed = base_failed()
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < fitted.limit))


def keep(docs: DataFrame, fitted: Judge, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the judge keeps: decided where they are read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for first, last, data, offsets in chunks(batch.column(text_col)):
                kept[first:last] = shared.value.kept(rule_counts(data, offsets))
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
