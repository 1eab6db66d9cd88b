"""Change detection against a saved base.

All joins are equi-joins on (corpus_id, shard_id, path) or (corpus_id, path)
and carry only (path, hash, tokens): file contents never enter these shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T

MODIFIED, ADDED, DELETED, UNCHANGED = "modified", "added", "deleted", "unchanged"


def status_rank(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return (F.when(s == MODIFIED, 0).when(s == ADDED, 1).when(s == DELETED, 2).otherwise(3))


def detect_changes(current: DataFrame, base_files: DataFrame,
                   keys: Sequence[str] = ("corpus_id", "shard_id")) -> DataFrame:
    """Full outer join of the current files and the base's (path, hash) rows.

    ``current``: keys + path, hash, tokens; ``base_files``: keys + path, hash.
    Returns keys + path, status, tokens (current tokens, NULL when deleted)."""
    k = list(keys) + ["path"]
    cur = current.select(*k, F.col("hash").alias("_h"), F.col("tokens").cast("bigint").alias("tokens"))
    base = base_files.select(*k, F.col("hash").alias("_bh"))
    j = cur.join(base, k, "full_outer")
    status = (F.when(F.col("_h").isNull(), F.lit(DELETED))
              .when(F.col("_bh").isNull(), F.lit(ADDED))
              .when(F.col("_h") != F.col("_bh"), F.lit(MODIFIED))
              .otherwise(F.lit(UNCHANGED)))
    return j.select(*k, status.alias("status"), "tokens")


def change_sets(current: DataFrame, base_files: DataFrame, keys: Sequence[str] = ("corpus_id",)) -> DataFrame:
    """added and deleted path sets as anti joins (no hash comparison)."""
    k = list(keys) + ["path"]
    c, b = current.select(*k), base_files.select(*k)
    added = c.join(b, k, "left_anti").withColumn("change_set", F.lit(ADDED))
    deleted = b.join(c, k, "left_anti").withColumn("change_set", F.lit(DELETED))
    return added.unionByName(deleted)


def sum_tokens(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Token and file totals per group."""
    return files.groupBy(*by).agg(F.sum("tokens").cast("bigint").alias("tokens"),
                                  F.count(F.lit(1)).cast("bigint").alias("n_files"))


def change_summary(changes: DataFrame, base_shards: DataFrame, threshold: float,
                   keys: Sequence[str] = ("corpus_id", "shard_id")) -> DataFrame:
    """Per shard with a base: changed tokens (modified + added, current
    counts) over the base token count; base <= 0 gives 1; deletions count 0.
    ``needs_rebuild`` when the ratio is strictly above ``threshold``."""
    k = list(keys)
    agg = changes.groupBy(*k).agg(
        F.sum(F.when(F.col("status").isin(MODIFIED, ADDED), F.col("tokens")).otherwise(0)).cast("bigint")
        .alias("change_tokens"),
        F.count_if(F.col("status") == MODIFIED).cast("bigint").alias("n_modified"),
        F.count_if(F.col("status") == ADDED).cast("bigint").alias("n_added"),
        F.count_if(F.col("status") == DELETED).cast("bigint").alias("n_deleted"))
    b = base_shards.select(*k, F.col("base_token_count").cast("bigint").alias("base_tokens"))
    j = b.join(agg, k, "left").na.fill(0, ["change_tokens", "n_modified", "n_added", "n_deleted"])
    ratio = F.when(F.col("base_tokens") > 0, F.col("change_tokens") / F.col("base_tokens")).otherwise(F.lit(1.0))
    return j.withColumn("change_ratio", ratio.cast("double")) \
            .withColumn("needs_rebuild", F.col("change_ratio") > F.lit(float(threshold)))


def reuse_metadata(raw: DataFrame, cache: DataFrame, counter: Column | None = None) -> DataFrame:
    """Skip hashing and counting when (mtime, size) are unchanged.

    ``raw``: corpus_id, path, mtime_ms, size, content. ``cache``: the previous
    result's metadata (corpus_id, path, mtime_ms, size, hash, tokens, n_lines;
    no content). One left join on (corpus_id, path, mtime_ms, size) with only
    the raw side carrying text; ``coalesce`` evaluates the hash and the count
    only where the cache has no row (codegen'd lazily). The output is both the
    snapshot and the next cache, so rows of vanished paths disappear. Adds
    ``reused``. A Python-UDF counter is evaluated on all rows by Spark; pass
    such a counter for misses only by calling this twice if that matters."""
    k = ["corpus_id", "path", "mtime_ms", "size"]
    meta = cache.select(*k, F.col("hash").alias("_ch"), F.col("tokens").alias("_ct"),
                        F.col("n_lines").alias("_cn"), F.lit(True).alias("_hit"))
    j = raw.join(meta, k, "left").withColumn("content", T.normalize_text(F.col("content")))
    tok = T.proxy_tokens("content") if counter is None else counter
    return j.select(*k, "content",
                    F.coalesce("_ch", T.content_hash("content")).alias("hash"),
                    F.coalesce("_ct", tok.cast("bigint")).alias("tokens"),
                    F.coalesce("_cn", T.line_count("content")).alias("n_lines"),
                    F.coalesce("_hit", F.lit(False)).alias("reused"))
