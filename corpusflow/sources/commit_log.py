"""Commit times from an exported commit log.

Input lines (corpus_id, line_no, line) of text shaped as ``<epoch> <hex>``
header lines, each followed by the paths that commit touched (newest commit
first). A path's commit time is that of its first occurrence. Path lines before
the first header are dropped.

The forward fill of the header time is done in fixed-size chunks of lines so a
single very long log never becomes one window partition: each chunk fills
locally, and a window over the (few) chunk rows carries the last header into
chunks that start without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER_RE = r"^(\d+) [0-9a-f]+$"
CHUNK_LINES = 1 << 16


def parse_commit_log(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Returns commit_times: corpus_id, path, commit_time BIGINT."""
    hdr = F.when(F.col("line").rlike(HEADER_RE),
                 F.regexp_extract("line", HEADER_RE, 1).cast("bigint"))
    df = lines.select("corpus_id", "line_no", "line", hdr.alias("_h"),
                      F.floor(F.col("line_no") / F.lit(chunk_lines)).alias("_chunk"))
    w_local = (Window.partitionBy("corpus_id", "_chunk").orderBy("line_no")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("_local", F.last("_h", ignorenulls=True).over(w_local))
    chunk_last = (df.where(F.col("_h").isNotNull()).groupBy("corpus_id", "_chunk")
                  .agg(F.max_by("_h", "line_no").alias("_last")))
    w_chunks = (Window.partitionBy("corpus_id").orderBy("_chunk")
                .rowsBetween(Window.unboundedPreceding, -1))
    # chunks without any header still need the carry: derive it for every chunk
    chunks = df.select("corpus_id", "_chunk").distinct()
    allc = chunks.join(chunk_last, ["corpus_id", "_chunk"], "left")
    carry = allc.select("corpus_id", "_chunk", F.last("_last", ignorenulls=True).over(w_chunks).alias("_carry"))
    df = df.join(carry, ["corpus_id", "_chunk"], "left")
    cur = F.coalesce("_local", "_carry")
    paths = df.where(F.col("_h").isNull() & (F.trim("line") != "") & (F.coalesce(cur, F.lit(0)) > 0)) \
              .select("corpus_id", F.trim("line").alias("path"), "line_no", cur.alias("t"))
    return paths.groupBy("corpus_id", "path").agg(F.min_by("t", "line_no").cast("bigint").alias("commit_time"))


def attach_commit_time(files: DataFrame, commit_times: DataFrame) -> DataFrame:
    """Commit time, else floor(mtime seconds), else 0."""
    f = files.join(commit_times, ["corpus_id", "path"], "left")
    mt = F.floor(F.col("mtime_ms") / 1000).cast("bigint") if "mtime_ms" in files.columns else F.lit(None)
    return f.withColumn("commit_time", F.coalesce(F.col("commit_time"), mt, F.lit(0).cast("bigint")).cast("bigint"))
