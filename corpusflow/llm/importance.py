"""Importance resampling with hashed n-gram models and Gumbel top-k.

Words and pairs of neighbouring words (A-Z lowered) are hashed into ``BUCKETS``
buckets. The raw model counts the buckets of all texts; the target model those of at
most ``TARGETS`` labelled good rows, chosen by a hash of their ids (the documented
bound of what is fitted). A text's weight is the sum over its buckets of the log ratio
of the two smoothed models. Gumbel noise, drawn from a hash of id and text (and of a row
number where ids repeat, so that equal rows are drawn one by one), turns the top k of
weight plus noise into a sample without replacement with those weights.

k is ``share`` of all rows (default: the share of good rows among the labelled). Rows
that tie with the k-th key are all selected. Null text has weight 0; a null id is no
target; repeated rows and ids give a row each; without good rows all weights are 0; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, keyed, materialize, small_batches, windows, with_key

BUCKETS = 1 << 16
TARGETS = 20_000
BINS = 4096


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row of the text) of every word and every pair of neighbouring words."""
    words = Words(data, offsets, lower=True)
    one = words.hashes()
    two, at = windows(one, words.doc, 2)
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([words.doc, words.doc[at]])


def bucket_counts(rows: DataFrame, targets: set) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket in all texts, and in those of the target ids."""
    chosen = rows.sparkSession.sparkContext.broadcast(targets)  # TARGETS ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.array([i in chosen.value for i in batch.column("doc_id").to_pylist()], bool)
            for first, last, data, offsets in chunks(batch.column("text")):
                bucket, doc = hashed(data, offsets)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[first:last][doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    found = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the target model over the raw model, the raw one also being the target's prior."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    prior = (raw + smooth) / (raw + smooth).sum()
    weight = 0.01 * target.sum() + 1
    return np.log((target + weight * prior) / (target.sum() + weight)) - np.log(prior)


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column of finite doubles, by histograms that narrow down on it."""
    bounds = rows.agg(F.min(column), F.max(column)).first()
    low, high = bounds
    if low is None or k <= 0:
        return float("inf")
    while low < high:
        width = (high - low) / BINS
        part = rows.where(F.col(column).between(low, high))
        if low + width <= low:
            break
        bins = part.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        above = rows.where(F.col(column) > high).count()
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):  # BINS rows at most
            above += r["n"]
            if above >= k:
                low, high = r["low"], r["high"]
                break
        else:
            return low
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, log_weight, gumbel_key, selected."""
    small_batches(docs.sparkSession)
    docs, key = with_key(docs, id_col)
    drawn_from = [docs[id_col], docs[text_col], F.lit(seed)] + ([] if key == id_col else [docs[key]])
    rows = keyed(docs, id_col, text_col, F.xxhash64(*drawn_from).alias("noise"))
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    n = labels.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") > 0).cast("long")).alias("good")).first()
    good = labels.where("quality > 0 AND coalesce(toxic, 0) = 0").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("spread"))
    if n["n"] > TARGETS:
        good = good.where(F.col("spread") < int((1 << 30) * 0.9 * TARGETS / n["n"]))
    targets = {r["doc_id"] for r in good.orderBy("spread", "doc_id").limit(TARGETS).collect()}
    weights = log_ratio(*bucket_counts(rows, targets))
    table = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                bucket, doc = hashed(data, offsets)
                size = last - first
                weight = np.bincount(doc, table.value[bucket], minlength=size).astype(float)
                part = batch.slice(first, size)
                u = (part.column("noise").to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float)
                gumbel = -np.log(-np.log((u + 0.5) / 2.0**53))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.bincount(doc, minlength=size)), pa.array(weight), pa.array(weight + gumbel)],
                    ["doc_id", "n_features", "log_weight", "gumbel_key"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(run, f"doc_id {kind}, n_features long, log_weight double, gumbel_key double"), "importance")
    if share is None:
        share = (n["good"] or 0) / n["n"] if n["n"] else 1.0
    return scored.withColumn("selected", F.col("gumbel_key") >= kth_largest(scored, "gumbel_key", round(share * scored.count())))
