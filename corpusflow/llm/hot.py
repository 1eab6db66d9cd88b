"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / SHARES of all rows is hot; so there are fewer than SHARES hot keys, whatever the data.
SHARES = 4096


def spread_join(big: DataFrame, small: DataFrame, key: str, size: str, tie: str | Column, how: str = "inner") -> DataFrame:
    """Equi-join of ``big`` with ``small``, which has one row a key and in ``size`` the rows of ``big`` with it.

    Rows of a hot key are dealt over as many salts as it has shares of all rows, by a hash of
    ``tie``, and its row of ``small`` is copied to each. The hot keys (fewer than ``SHARES``
    rows) are broadcast; the copies are fewer than twice ``SHARES`` in all."""
    share = max(1, -(-(small.agg(F.sum(size)).first()[0] or 0) // SHARES))
    salts = F.ceil(F.col(size) / F.lit(share)).cast("int")
    hot = small.where(F.col(size) > share).select(F.col(key).alias("hot_key"), salts.alias("hot_salts"))
    dealt = big.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    dealt = dealt.withColumn("hot_salt", F.pmod(F.xxhash64(tie), F.coalesce("hot_salts", F.lit(1))).cast("int")).drop("hot_key", "hot_salts")
    copies = small.withColumn("hot_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(copies, [key, "hot_salt"], how).drop("hot_salt")
