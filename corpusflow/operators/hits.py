"""From model answers to snippets.

Every step is keyed by the request (``query_id``) and a file (``corpus_id,
path``); there is no global ordering. Range merging is gaps-and-islands with
windows partitioned by (query, file), which equals the sequential fold over
ranges sorted by start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.functions import text as T
from corpusflow.session import materialize

_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"

REASON_UNKNOWN = "file not in snapshot"
REASON_TYPE = "invalid line numbers"
REASON_PAST_END = "beyond file length"


# -- I1-I3: tool-argument JSON ----------------------------------------------

def parse_arguments(responses: DataFrame, col: str = "arguments") -> DataFrame:
    """JSON object text to a VARIANT; ``parse_error`` when text is present
    but unparsable (truncated JSON gives NULL). A ``results`` member that is not
    an array counts as an empty list."""
    v = F.try_parse_json(F.col(col))
    return responses.withColumn("_args", v).withColumn(
        "parse_error", F.col(col).isNotNull() & F.col("_args").isNull())


def explode_hits(parsed: DataFrame, keep=("query_id", "corpus_id", "shard_id", "shard_ord")) -> DataFrame:
    """One row per result with its position (``hit_ord``); file and line
    numbers typed; line numbers that are not JSON numbers give NULL and a
    ``type_ok`` false (text '5' is not accepted)."""
    arr = F.try_variant_get(F.col("_args"), "$.results", "array<variant>")
    e = parsed.select(*keep, F.posexplode(arr).alias("hit_ord", "_r"))
    s = F.try_variant_get("_r", "$.start_line", "variant")
    en = F.try_variant_get("_r", "$.end_line", "variant")
    f = F.try_variant_get("_r", "$.file", "variant")
    num = lambda x: F.coalesce(F.schema_of_variant(x).rlike(_NUMERIC), F.lit(False))
    file_ok = F.coalesce(F.schema_of_variant(f) == "STRING", F.lit(False))
    return e.select(*keep, F.col("hit_ord").cast("bigint").alias("hit_ord"),
                    F.when(file_ok, F.variant_get(f, "$", "string")).alias("path"),
                    F.when(num(s), F.variant_get(s, "$", "double")).alias("start_line"),
                    F.when(num(en), F.variant_get(en, "$", "double")).alias("end_line"),
                    (num(s) & num(en)).alias("type_ok"))


# -- C8, E3: shard-level filters ---------------------------------------------

def hits_in_shard(hits: DataFrame, shard_files: DataFrame) -> DataFrame:
    """Keep a hit only when its file belongs to the answering shard."""
    return hits.join(shard_files.select("corpus_id", "shard_id", "path"),
                     ["corpus_id", "shard_id", "path"], "left_semi")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """First of each (query, file, start, end) in shard order, then answer order."""
    w = Window.partitionBy("query_id", "corpus_id", "path", "start_line", "end_line") \
              .orderBy("shard_ord", "hit_ord")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# -- C7, I3, B10 = J6 ---------------------------------------------------------

def classify_hits(hits: DataFrame, files: DataFrame) -> DataFrame:
    """C7 + I3 + B10 with the reason kept: adds n_lines, clean start/end (BIGINT)
    and ``reason`` (NULL for a valid hit)."""
    # hits name few files: narrow the snapshot map-side first (checked-size broadcast)
    f = files.select("corpus_id", "path", F.col("n_lines").alias("_n"))
    j = hits.join(f, ["corpus_id", "path"], "left")
    type_ok = F.col("type_ok") if "type_ok" in hits.columns else (
        F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
    s, e, inside = T.clean_range("start_line", "end_line", "_n")
    reason = (F.when(F.col("_n").isNull(), F.lit(REASON_UNKNOWN))
              .when(~type_ok, F.lit(REASON_TYPE))
              .when(~inside, F.lit(REASON_PAST_END)))
    return j.withColumn("reason", reason) \
            .withColumn("clean_start", F.when(F.col("reason").isNull(), s)) \
            .withColumn("clean_end", F.when(F.col("reason").isNull(), e)) \
            .withColumnRenamed("_n", "n_lines")


def normalize_hits(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Valid hits only, with clean BIGINT line numbers."""
    c = classify_hits(hits, files).where(F.col("reason").isNull())
    return c.drop("start_line", "end_line", "reason", "type_ok") \
            .withColumnRenamed("clean_start", "start_line").withColumnRenamed("clean_end", "end_line")


# -- E5, E1 -------------------------------------------------------------------

def coalesce_ranges(valid: DataFrame, gap: int = O.RANGE_GAP) -> DataFrame:
    """Merge ranges of one file when next.start <= end + gap.

    ``valid``: query_id, corpus_id, path, shard_ord, hit_ord, start_line, end_line.
    Returns query_id, corpus_id, path, file_rank, range_no, start_line, end_line, n_hits.
    ``file_rank`` is the file's first appearance among the request's hits."""
    k = ["query_id", "corpus_id", "path"]
    first = valid.groupBy(*k).agg(F.min(F.struct("shard_ord", "hit_ord")).alias("_first"))
    w_rank = Window.partitionBy("query_id").orderBy("_first")
    ranks = first.select(*k, F.row_number().over(w_rank).cast("bigint").alias("file_rank"))
    w = Window.partitionBy(*k).orderBy("start_line", "end_line", "shard_ord", "hit_ord")
    prev_end = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isl = valid.withColumn("_new", F.when(prev_end.isNull() | (F.col("start_line") > prev_end + gap), 1).otherwise(0))
    isl = isl.withColumn("range_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    merged = isl.groupBy(*k, "range_no").agg(F.min("start_line").alias("start_line"),
                                            F.max("end_line").alias("end_line"),
                                            F.count(F.lit(1)).cast("bigint").alias("n_hits"))
    return merged.join(ranks, k)


# -- C11, J5, D14 ---------------------------------------------------------------

#: Ranges of one file that a row cuts, about: a file with more has several rows, each with the content once.
RANGES_PER_ROW = 64


def cut_snippets(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """C11: lines of each range, numbered, under a ``--- path:start-end ---`` header.

    The ranges of a file meet its content once and are cut from one split of it. A file that many
    requests hit has a row for every :data:`RANGES_PER_ROW` of its ranges or so."""
    key = ["corpus_id", "path"]
    rest = [c for c in ranges.columns if c not in key]
    ranges = materialize(ranges, "ranges")  # counted first, then grouped
    crowded = ranges.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RANGES_PER_ROW)
    part = F.pmod(F.xxhash64(*rest), F.coalesce(F.ceil(F.col("_n") / RANGES_PER_ROW), F.lit(1)))
    groups = ranges.join(crowded, key, "left").groupBy(*key, part.alias("_part")) \
                   .agg(F.collect_list(F.struct(*rest)).alias("_ranges"))

    def cut(lines):
        def one(r):
            start, end = r["start_line"], r["end_line"]
            numbered = F.transform(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")),
                                   lambda x, i: F.concat((i + start).cast("string"), F.lit("\t"), x))
            head = F.format_string(O.FMT_SNIPPET_HEADER, F.col("path"), start.cast("string"), end.cast("string"))
            return F.struct(*[r[c].alias(c) for c in rest],
                            F.concat(head, F.lit("\n"), F.array_join(numbered, "\n")).alias("snippet"))
        return F.transform("_ranges", one)

    # a lambda's argument is evaluated once a row, so the content is split once
    snippets = F.get(F.transform(F.array(F.split("content", "\n")), cut), F.lit(0))
    return groups.join(files.select(*key, "content"), key).select(*key, F.explode(snippets).alias("_s")).select(*key, "_s.*")


def _ordered_join(text, sep, *order):
    s = F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order)], text.alias("_t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["_t"]), sep)


def outcome_summary(responses: DataFrame) -> DataFrame:
    """Per request: shards answered and failed, the ordered error list and
    the overall error flag (set only when every shard failed).

    ``responses``: query_id, shard_id, shard_ord, prefix, error (NULL when ok)."""
    line = F.format_string(O.FMT_SHARD_ERROR, F.col("shard_id"),
                           F.when(F.coalesce(F.col("prefix"), F.lit("")) == "", F.col("shard_id"))
                           .otherwise(F.col("prefix")), F.col("error"))
    r = responses.withColumn("_line", F.when(F.col("error").isNotNull(), line))
    agg = r.groupBy("query_id").agg(
        F.count_if(F.col("error").isNull()).cast("bigint").alias("n_ok"),
        F.count_if(F.col("error").isNotNull()).cast("bigint").alias("n_failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("error").isNotNull(), F.struct(F.col("shard_ord").alias("o"), F.col("_line").alias("t"))))),
            lambda x: x["t"]), "\n").alias("errors"),
        F.max(F.when(F.col("shard_id") == O.ALL_SHARD, F.col("error"))).alias("single_error"))
    return agg.withColumn("is_error", (F.col("n_ok") == 0) & (F.col("n_failed") > 0))


def render_outcome(outcome: DataFrame, n_merged: DataFrame, snippets: DataFrame) -> DataFrame:
    """Per request text: snippets in file then start order, or a notice
    (none returned / none known); then the failed-shard list. The notice is
    left out when nothing matched and some shard failed.

    ``outcome`` from :func:`outcome_summary`; ``n_merged``: query_id, n_results
    (hits after the shard filter and de-duplication); ``snippets`` from
    :func:`cut_snippets`. A failed one-shard (``__all__``) request renders as
    ``Error: <message>``."""
    text = snippets.groupBy("query_id").agg(
        _ordered_join(F.col("snippet"), "\n\n", F.col("file_rank"), F.col("start_line")).alias("_snip"))
    j = outcome.join(n_merged, "query_id", "left").join(text, "query_id", "left")
    n = F.coalesce(F.col("n_results"), F.lit(0))
    extract = (F.when(n == 0, F.lit(O.NOTICE_NO_RESULTS))
               .when(F.col("_snip").isNull(), F.lit(O.NOTICE_NONE_KNOWN))
               .otherwise(F.col("_snip")))
    show = (n > 0) | (F.col("n_failed") == 0)
    out = F.concat(F.when(show, extract).otherwise(F.lit("")),
                   F.when(F.col("n_failed") > 0, F.concat(F.lit(O.SHARD_ERRORS_HEADER), F.col("errors")))
                   .otherwise(F.lit("")))
    # a one-shard (__all__) corpus answers a failure with the bare error
    out = F.when(F.col("single_error").isNotNull(),
                 F.concat(F.lit(O.ERROR_PREFIX), F.col("single_error"))).otherwise(out)
    return j.select("query_id", out.alias("text"), "is_error", "n_ok", "n_failed", n.alias("n_results"))
