"""K2: refresh as a stream of arriving corpus snapshots.

A source delivers snapshot rows (corpus_id, path, content[, mtime_ms]), in one of two ways:

* with ``snapshot_id`` (a number that grows per corpus), ``n_files`` and ``files_hash``: a
  snapshot's rows may come in any order, in several batches and more than once. A manifest row
  (``path`` null; see :func:`announce`) says how many files there are and what they hash to.
  Rows wait in a table beside the state until their snapshot is complete; the newest complete
  one of a corpus is refreshed, older ones are dropped. A snapshot of which a file never comes,
  or comes with another text, never counts: nothing of its corpus is deleted or replaced.
* without them every micro-batch holds complete snapshots of the corpora it names (a corpus of
  which a batch holds a part is read as if its other files were deleted, so a producer
  publishes a corpus in one file or one atomic folder).

Each batch runs the batch refresh (J8) through ``foreachBatch``. A batch is idempotent: the
state version that it writes is committed with a mark of the stream (its checkpoint
folder) and the batch id; a replayed batch finds the mark in the manifest and is
skipped, and another stream's batch of the same id is not. Marks stay when replaced
folders are deleted.
The snapshot time of a batch is one more than the newest in the state, so a
batch is always newer than what it replaces.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.functions import text as T
from corpusflow.plans.refresh import refresh
from corpusflow.session import materialize
from corpusflow.sources import state as ST
from corpusflow.sources.files import snapshot

MANIFEST = ("snapshot_id", "n_files", "files_hash")
APPLIED_SCHEMA = "corpus_id string, snapshot_id long"


def _fingerprint(files: DataFrame) -> DataFrame:
    """(corpus_id, snapshot_id, n_files, files_hash) of (corpus_id, snapshot_id, path, hash) rows, in any order."""
    return files.groupBy("corpus_id", "snapshot_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.bit_xor(F.xxhash64("path", "hash")).alias("files_hash"))


def announce(files: DataFrame) -> DataFrame:
    """The manifest rows that complete the snapshots of ``files`` (corpus_id, snapshot_id, path, content);
    a corpus that has lost all its files is announced with ``n_files`` 0."""
    return _fingerprint(files.select("corpus_id", "snapshot_id", "path",
                                     T.content_hash(T.normalize_text(F.col("content"))).alias("hash")))


def _newest_state(spark: SparkSession, state_root: str) -> int:
    return max(ST.read_state(spark, state_root, t).agg(F.max("snapshot_ts")).first()[0] or 0 for t in ST.TABLES)


def _series(stream: str) -> str:
    return hashlib.sha256(stream.encode()).hexdigest()[:16]


def refresh_batch(state_root: str, budget: int, threshold: float, stream: str = "", keep_old: bool = True):
    """The ``foreachBatch`` body: skip replayed batches, else refresh. ``stream`` tells streams apart;
    without ``keep_old``, folders that a batch replaced are deleted after it (no one may be reading them)."""
    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        mark = f"{_series(stream)}-{batch_id}"
        if df.isEmpty() or ST.has_mark(spark, state_root, mark):
            return
        files = df if "hash" in df.columns else snapshot(df)
        newest = _newest_state(spark, state_root)
        refresh(files, state_root, budget=budget, threshold=threshold, snapshot_ts=newest + 1, mark=mark)
        if not keep_old:
            ST.drop_superseded(spark, state_root)
    return run


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers n of the finished tables ``<folder>/b=<n>`` (one a batch that still waits)."""
    fs, path, jvm = ST._fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("b=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def _drop(spark: SparkSession, folder: str, numbers: list[int]) -> None:
    fs, _, jvm = ST._fs(spark, folder)
    for n in numbers:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/b={n}"), True)


def complete_batch(state_root: str, budget: int, threshold: float, stream: str = "", keep_old: bool = True):
    """The ``foreachBatch`` body for arrivals with manifests: :func:`refresh_batch` of what is complete.

    Beside the state, ``_arrivals/<stream>/rows/b=<batch>`` holds the rows that wait and
    ``.../applied/b=<batch>`` the newest snapshot refreshed of each corpus. A replayed batch writes
    its rows again and finds its mark, or what it has applied; batches whose rows are all used up
    are deleted."""
    base = f"{state_root.rstrip('/')}/_arrivals/{_series(stream)}"
    key = ["corpus_id", "snapshot_id"]

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if df.isEmpty():
            return
        files = snapshot(df.where("path IS NOT NULL").drop("n_files", "files_hash"))
        manifests = df.where("path IS NULL").select("corpus_id", *MANIFEST)
        files.unionByName(manifests, allowMissingColumns=True).write.mode("overwrite").parquet(f"{base}/rows/b={batch_id}")
        applied = _applied(spark, base, [n for n in _numbers(spark, f"{base}/applied") if n < batch_id])
        rows = spark.read.option("basePath", f"{base}/rows").parquet(
            *[f"{base}/rows/b={n}" for n in _numbers(spark, f"{base}/rows") if n <= batch_id])
        waiting = _newer(rows, applied)
        if batch_id not in _numbers(spark, f"{base}/applied"):
            arrived = waiting.where("path IS NOT NULL")
            have = _fingerprint(arrived.select(*key, "path", "hash").distinct())
            told = waiting.where("path IS NULL").select("corpus_id", *MANIFEST).distinct()
            full = told.alias("t").join(have.alias("h"), key, "left").where(
                (F.col("t.n_files") == F.coalesce("h.n_files", F.lit(0)))
                & ((F.col("t.n_files") == 0) | (F.col("t.files_hash") == F.col("h.files_hash"))))
            newest = materialize(full.groupBy("corpus_id").agg(F.max("snapshot_id").alias("snapshot_id")), "complete", force=True)
            if newest.isEmpty():
                return
            mark = f"{_series(stream)}-{batch_id}"
            if not ST.has_mark(spark, state_root, mark):
                # the same file may have been delivered more than once
                files = arrived.join(newest, key, "left_semi").dropDuplicates([*key, "path"]).drop("b", *MANIFEST)
                refresh(files, state_root, budget=budget, threshold=threshold, snapshot_ts=_newest_state(spark, state_root) + 1,
                        mark=mark, corpora=newest.select("corpus_id"))
                if not keep_old:
                    ST.drop_superseded(spark, state_root)
            both = (newest if applied is None else applied.unionByName(newest)).groupBy("corpus_id").agg(F.max("snapshot_id").alias("snapshot_id"))
            both.coalesce(1).write.mode("overwrite").parquet(f"{base}/applied/b={batch_id}")  # a row a corpus
        finished = _numbers(spark, f"{base}/applied")
        left = {r.b for r in _newer(rows, _applied(spark, base, finished)).select("b").distinct().collect()}  # batches
        _drop(spark, f"{base}/rows", [n for n in _numbers(spark, f"{base}/rows") if n not in left])
        _drop(spark, f"{base}/applied", finished[:-2])
    return run


def _applied(spark: SparkSession, base: str, numbers: list[int]) -> DataFrame | None:
    """(corpus_id, snapshot_id) refreshed last, a row a corpus; None before the first."""
    if not numbers:
        return None
    return spark.read.schema(APPLIED_SCHEMA).parquet(f"{base}/applied/b={numbers[-1]}")


def _newer(rows: DataFrame, applied: DataFrame | None) -> DataFrame:
    """Rows of snapshots newer than the applied one of their corpus. Those rows hold texts, so they are not
    dealt by corpus: without ``applied`` there is no join, else it has the size of a file."""
    if applied is None:
        return rows
    done = applied.withColumnRenamed("snapshot_id", "_done")
    return rows.join(done, "corpus_id", "left").where("_done IS NULL OR snapshot_id > _done").drop("_done")


def refresh_stream(arrivals: DataFrame, state_root: str, checkpoint: str,
                   budget: int = O.DEFAULT_MAX_CONTEXT_TOKENS,
                   threshold: float = O.DEFAULT_CHANGE_THRESHOLD, available_now: bool = False, keep_old: bool = True):
    """Start the stream; returns the StreamingQuery. Arrivals with manifests wait until complete."""
    body = complete_batch if set(MANIFEST) <= set(arrivals.columns) else refresh_batch
    w = arrivals.writeStream.foreachBatch(body(state_root, budget, threshold, checkpoint, keep_old)) \
                            .option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
