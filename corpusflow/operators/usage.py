"""Token usage accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.functions import text as T

COUNTERS = ("prompt_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens",
            "completion_tokens", "reasoning_tokens")

USAGE_SCHEMA = ("struct<prompt_tokens:bigint, prompt_cache_hit_tokens:bigint, "
                "prompt_cache_miss_tokens:bigint, completion_tokens:bigint, total_tokens:bigint, "
                "completion_tokens_details:struct<reasoning_tokens:bigint>>")


def parse_usage(df: DataFrame, col: str = "usage_text") -> DataFrame:
    """I4: usage JSON with a fixed schema; absent counters are 0, the reasoning
    count is nested."""
    u = F.from_json(F.col(col), USAGE_SCHEMA)
    out = df.withColumn("_u", u)
    for c in COUNTERS[:4]:
        out = out.withColumn(c, F.coalesce(F.col(f"_u.{c}"), F.lit(0)).cast("bigint"))
    out = out.withColumn("reasoning_tokens",
                         F.coalesce(F.col("_u.completion_tokens_details.reasoning_tokens"), F.lit(0)).cast("bigint"))
    return out.drop("_u")


def usage_summary(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    """D12 + B15: counter totals and cache-hit share per group."""
    aggs = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in COUNTERS]
    out = usage.groupBy(*by).agg(*aggs, F.count(F.lit(1)).cast("bigint").alias("n_requests"))
    return out.withColumn("hit_ratio", T.hit_ratio("prompt_cache_hit_tokens", "prompt_tokens"))


def cumulative_hit_rate(usage: DataFrame, by: Sequence[str] = ("session",),
                        order: Sequence[str] = ("ts", "request_id"),
                        rows_per_chunk: int = 1 << 20) -> DataFrame:
    """Running prompt and hit totals per session and the running share.

    A chunked prefix sum, so one very busy session is not one window partition:
    each session's time span is cut into buckets holding about
    ``rows_per_chunk`` rows (from the session's row count and time range);
    running sums are taken inside (session, bucket), and each bucket adds the
    total of the buckets before it (a window over the few bucket rows). Rows
    without a time come first (a bucket of their own); a NULL session is a
    session like any other."""
    keys = list(by)
    ts = F.unix_micros(F.col(order[0]).cast("timestamp"))

    def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
        """Inner join on ``names`` in which NULL equals NULL."""
        renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns])
        on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return left.join(renamed, cond).drop(*[f"_r_{c}" for c in names])

    stats = usage.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"),
                                     F.count(F.lit(1)).alias("_n"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1)
                                        / F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows_per_chunk)))))
    chunk = F.coalesce(F.floor((ts - F.col("_lo")) / width), F.lit(-1))
    u = same(usage, stats, keys).withColumn("_chunk", chunk).drop("_lo", "_hi", "_n")
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("_p", F.sum(F.coalesce("prompt_tokens", F.lit(0))).over(w)) \
         .withColumn("_h", F.sum(F.coalesce("prompt_cache_hit_tokens", F.lit(0))).over(w))
    tot = same(usage, stats, keys).withColumn("_chunk", chunk) \
               .groupBy(*keys, "_chunk").agg(F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("_tp"),
                                              F.sum(F.coalesce("prompt_cache_hit_tokens", F.lit(0))).alias("_th"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_chunk", F.coalesce(F.sum("_tp").over(wc), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_th").over(wc), F.lit(0)).alias("_oh"))
    out = same(u, off, keys + ["_chunk"]) \
           .withColumn("cum_prompt", (F.col("_p") + F.col("_op")).cast("bigint")) \
           .withColumn("cum_hit", (F.col("_h") + F.col("_oh")).cast("bigint")) \
           .drop("_p", "_h", "_op", "_oh", "_chunk")
    return out.withColumn("cum_hit_ratio", T.hit_ratio("cum_hit", "cum_prompt"))


def price_table(spark: SparkSession) -> DataFrame:
    """The documented prices (CNY per 1M tokens)."""
    return spark.createDataFrame(list(O.PRICES), "model string, hit_per_m double, miss_per_m double, out_per_m double")


def token_cost(usage: DataFrame, prices: DataFrame, model_col: str = "model") -> DataFrame:
    """Cost from hit, miss and output tokens; usage of a model without a
    price keeps its row with a NULL cost. ``prices``: one row per model."""
    j = usage.join(prices.withColumnRenamed("model", model_col), model_col, "left")
    cost = (F.col("prompt_cache_hit_tokens") * F.col("hit_per_m")
            + F.col("prompt_cache_miss_tokens") * F.col("miss_per_m")
            + F.col("completion_tokens") * F.col("out_per_m")) / F.lit(1_000_000.0)
    return j.withColumn("cost", cost).drop("hit_per_m", "miss_per_m", "out_per_m")
