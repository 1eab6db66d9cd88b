"""Join helpers for keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a key that holds a large share of the files.
SALTS = 32


#: Rows of a key in the big side from which it is spread over buckets.
HOT_ROWS = 1 << 16


def salted_join(big: DataFrame, small: DataFrame, keys, how: str = "inner", salts: int = SALTS,
                spread: str = "path") -> DataFrame:
    """Join ``big`` (many rows per key) to ``small`` (few rows per key) when a key may be hot.

    The rows of each key of ``big`` are counted. Those of a key with more than ``HOT_ROWS`` are
    spread over ``salts`` buckets by a hash of the ``spread`` column and its rows of the small side
    are copied to every bucket, so no single key's rows meet in one task. Other keys are not
    copied: a small side with a row per shard stays as large as it is. Of hot keys there are at
    most as many as the big side has rows, divided by ``HOT_ROWS``, so they are broadcast."""
    k = list(keys)
    sizes = big.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(sizes.where(F.col("_n") > HOT_ROWS).select(*k, F.lit(salts).alias("_salts")))
    no_key = F.lit(False)
    for c in k:
        no_key = no_key | F.col(c).isNull()
    salt = F.when(F.col("_salts").isNotNull() | no_key, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0)
    b = big.join(hot, k, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    sm = small.join(hot, k, "left").withColumn("_salt", copies).drop("_salts")
    return b.join(sm, [*k, "_salt"], how).drop("_salt")


#: Rows of one key that may meet the other side's in one task, and the most keys that are split.
BLOCK_ROWS = 1024
HOT_KEYS = 4096


def block_join(left: DataFrame, right: DataFrame, keys, left_tie: str, right_tie: str) -> DataFrame:
    """Inner equi-join of two sides that both may have many rows a key, so that a hot
    key's pairs are made by many tasks.

    The rows of each key are counted. A key with more than ``BLOCK_ROWS`` rows of a side
    (and more than a ``HOT_KEYS``-th part of that side, which bounds the number of such
    keys and hence their broadcast) is cut into blocks of that many: its rows of either
    side are dealt over their side's blocks by a hash of the side's tie column and copied
    to each block of the other side."""
    k = list(keys)
    sizes = [side.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")) for side in (left, right)]
    most = [max(BLOCK_ROWS, (s.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS) for s in sizes]
    cuts = [s.where(F.col("_n") > m).select(*k, F.ceil(F.col("_n") / m).cast("int").alias(c))
            for s, m, c in zip(sizes, most, ("_lefts", "_rights"))]
    hot = F.broadcast(cuts[0].join(cuts[1], k, "full"))

    def dealt(side: DataFrame, own: str, other: str, tie: str, i: str, j: str) -> DataFrame:
        block = F.pmod(F.xxhash64(tie), F.coalesce(own, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return side.join(hot, k, "left").withColumn(i, block).withColumn(j, copies).drop(own, other)

    a = dealt(left, "_lefts", "_rights", left_tie, "_i", "_j")
    b = dealt(right, "_rights", "_lefts", right_tie, "_j", "_i")
    return a.join(b, [*k, "_i", "_j"]).drop("_i", "_j")
