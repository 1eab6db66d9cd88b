"""Ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialize


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's number (from 1) in its group of ``keys`` by ``order``, which has no ties there.

    Rows are dealt by ranges of (keys, order) and written once, so a group of any size lies in as many
    pieces as it needs and a lost task reads the same pieces again. Rows are numbered inside a piece; a
    piece adds the sizes of its group's earlier pieces, of which there are at most as many as shuffle
    partitions. Keys are not null."""
    piece = [*keys, "_piece"]
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_piece", F.spark_partition_id())
    dealt = materialize(dealt, name, force=True)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*piece).agg(F.count(F.lit(1)).alias("_size"))
    starts = starts.select(*piece, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*piece).orderBy(*order))
    numbered = dealt.withColumn("_inside", inside).join(starts, piece)
    return numbered.withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint")).drop("_piece", "_inside", "_start")
