"""Derived views over the driver's tables (FIXTURES.md section 2), Spark side.

Each view reads the given parquet tables and derives its rows with DataFrame
expressions, so every check grows with the input. The DuckDB twins are in
:mod:`corpusflow.fixtures.duck`; the two must stay definition-for-definition equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ext(doc_id):
    m = doc_id % 6
    return (F.when(m == 0, ".py").when(m == 1, ".ts").when(m == 2, ".md")
            .when(m == 3, ".SQL").when(m == 4, ".c").otherwise(""))


def doc_path(doc_id, source):
    """Path of a document: top level, one directory, or two directories deep."""
    name = F.concat(doc_id.cast("string"), _ext(doc_id))
    m = doc_id % 11
    return (F.when(m == 0, name)
            .when(m == 1, F.concat(source, F.lit("/"), name))
            .otherwise(F.concat(source, F.lit("/p"), (doc_id % 5).cast("string"), F.lit("/"), name)))


def files(spark: SparkSession, sf_dir: str, version: str | None = None) -> DataFrame:
    """Snapshot of corpora: corpus_id (= lang), path, doc_id, content, hash,
    tokens, n_lines, mtime_ms, size.

    ``version='v1'`` drops ``doc_id % 10 = 9`` (base); ``'v2'`` drops
    ``doc_id % 10 = 8`` and appends a line to ``doc_id % 10 = 7``."""
    d = table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    content = T.normalize_text(F.col("text"))
    mtime = F.lit(1_700_000_000_000) + (did % 13) * F.lit(60_000) + F.lit(123)
    if version == "v1":
        d = d.where(did % 10 != 9)
    elif version == "v2":
        d = d.where(did % 10 != 8)
        content = F.when(did % 10 == 7, F.concat(content, F.lit("\nedited"))).otherwise(content)
        mtime = F.when(did % 10 == 7, mtime + F.lit(86_400_000)).otherwise(mtime)
    out = d.select(F.col("lang").alias("corpus_id"), doc_path(did, F.col("source")).alias("path"),
                   did.alias("doc_id"), content.alias("content"), mtime.cast("bigint").alias("mtime_ms"))
    # a lazy projection: a query reads, and hashes, only what it asks for
    return out.select("corpus_id", "path", "doc_id", "content",
                      T.content_hash("content").alias("hash"),
                      T.proxy_tokens("content").alias("tokens"),
                      T.line_count("content").alias("n_lines"),
                      "mtime_ms",
                      F.octet_length("content").cast("bigint").alias("size"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files with deep natural paths: corpus = host, path = url path
    (query and fragment removed) + '/<page_id>.html'."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    upath = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    rel = F.regexp_replace(upath, r"^/+|/+$", "")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    path = F.when(rel == "", name).otherwise(F.concat(rel, F.lit("/"), name))
    content = T.normalize_text(F.col("html"))
    return p.select(host.alias("corpus_id"), path.alias("path"), F.col("page_id"),
                    content.alias("content")).select(
        "corpus_id", "path", "page_id", "content", T.content_hash("content").alias("hash"),
        T.proxy_tokens("content").alias("tokens"), T.line_count("content").alias("n_lines"))


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported commit-log text as lines: corpus_id, line_no, line."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    m = eid % 5
    line = (F.when(m == 0, F.concat((F.lit(1_700_000_000) - eid).cast("string"), F.lit(" "),
                                    eid.cast("string")))
            .when(m == 1, F.lit(""))
            .otherwise(F.concat(F.lit("src"), (eid % 7).cast("string"), F.lit("/"),
                                (eid % 50).cast("string"), F.lit(".py"))))
    return e.select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("corpus_id"),
                    eid.alias("line_no"), line.alias("line"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the commit-log corpora: every path named in the log, plus one
    untracked file per document (so all three commit-time sources occur)."""
    cl = commit_lines(spark, sf_dir).where(F.col("line").rlike(r"^src\d+/\d+\.py$"))
    tracked = cl.select("corpus_id", F.col("line").alias("path")).distinct().select(
        "corpus_id", "path", F.lit(1_690_000_000_500).cast("bigint").alias("mtime_ms"))
    d = table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    untracked = d.select(F.concat(F.lit("c"), (did % 4).cast("string")).alias("corpus_id"),
                         F.concat(F.lit("src9/"), did.cast("string"), F.lit(".py")).alias("path"),
                         F.when(did % 5 == 0, F.lit(None)).otherwise(
                             F.lit(1_600_000_000_000) + did * F.lit(1_001)).cast("bigint").alias("mtime_ms"))
    return tracked.unionByName(untracked)


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as rows: query_id, shard_ord, hit_ord, corpus_id, path,
    start_line, end_line (raw DOUBLE values, some reversed, zero or past the end).
    A hundred hits a request, in 23 files; the requests' files move over all
    documents. doc -1 names a file that exists nowhere."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    query = F.floor(eid / 100)
    n = table(spark, sf_dir, "documents").count()
    doc = F.when(eid % 41 == 0, F.lit(-1)).otherwise((query * 7 + eid % 23) % F.lit(max(n, 1)))
    start = F.col("value") - F.lit(30) * F.floor(F.col("value") / 30)
    h = e.select(query.alias("query_id"), (eid % 3).cast("int").alias("shard_ord"),
                 eid.alias("hit_ord"), doc.alias("doc"), start.alias("start_line"),
                 (start + (eid % 17) - 3).alias("end_line"))
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc"), F.col("lang").alias("corpus_id"),
        doc_path(F.col("doc_id"), F.col("source")).alias("path"))
    return h.join(d, "doc", "left").select(
        "query_id", "shard_ord", "hit_ord", F.coalesce("corpus_id", F.lit("en")).alias("corpus_id"),
        F.coalesce("path", F.lit("missing/unknown.py")).alias("path"),
        F.col("start_line").cast("double").alias("start_line"),
        F.col("end_line").cast("double").alias("end_line"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-request token usage: session, label, ts, request_id, prompt/hit/miss/
    completion/reasoning counters."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    prompt = F.lit(128) * (eid % 50)
    hit = F.lit(128) * F.least(eid % 50, eid % 37)
    comp = eid % 400
    return e.select(F.col("user_id").alias("session"), F.col("event_type").alias("label"),
                    F.col("ts"), eid.alias("request_id"),
                    prompt.cast("bigint").alias("prompt_tokens"),
                    hit.cast("bigint").alias("prompt_cache_hit_tokens"),
                    (prompt - hit).cast("bigint").alias("prompt_cache_miss_tokens"),
                    comp.cast("bigint").alias("completion_tokens"),
                    F.floor(comp / 2).cast("bigint").alias("reasoning_tokens"))


def usage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage objects as JSON text, some fields missing (request_id, usage_text)."""
    u = usage(spark, sf_dir)
    rid = F.col("request_id")
    details = F.when(rid % 4 == 0, F.lit("")).otherwise(F.concat(
        F.lit(', "completion_tokens_details": {"reasoning_tokens": '),
        F.col("reasoning_tokens").cast("string"), F.lit("}")))
    hit = F.when(rid % 6 == 0, F.lit("")).otherwise(F.concat(
        F.lit(', "prompt_cache_hit_tokens": '), F.col("prompt_cache_hit_tokens").cast("string")))
    txt = F.concat(F.lit('{"prompt_tokens": '), F.col("prompt_tokens").cast("string"), hit,
                   F.lit(', "prompt_cache_miss_tokens": '), F.col("prompt_cache_miss_tokens").cast("string"),
                   F.lit(', "completion_tokens": '), F.col("completion_tokens").cast("string"),
                   F.lit(', "total_tokens": '), (F.col("prompt_tokens") + F.col("completion_tokens")).cast("string"),
                   details, F.lit("}"))
    return u.select("request_id", "session", txt.alias("usage_text"))


_CODE = {"view": 200, "click": 429, "signup": 503, "purchase": 400}


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log: request_id, attempt (1..3), status_code (NULL = no code),
    ok (a 200 is a success)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    code = F.lit(None).cast("int")
    for k, v in reversed(list(_CODE.items())):
        code = F.when(F.col("event_type") == k, F.lit(v)).otherwise(code)
    return e.select(F.floor(eid / 3).cast("bigint").alias("request_id"),
                    (eid % 3 + 1).cast("int").alias("attempt"), code.alias("status_code"),
                    F.concat(F.lit("status "), F.coalesce(code.cast("string"), F.lit("none")),
                             F.lit(" on "), F.col("event_type")).alias("message"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed response deltas: request_id, chunk_no, tool_delta, content_delta,
    usage (on the last chunk only; absent for ``conv_id % 7 = 0``)."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    c = c.join(last, "conv_id")
    is_last = (F.col("turn") == F.col("_last")) & (F.col("conv_id") % 7 != 0)
    n = F.length("text").cast("bigint")
    usage_col = F.when(is_last, F.struct(
        (n * 3).alias("prompt_tokens"), (n * 2).alias("prompt_cache_hit_tokens"),
        n.alias("prompt_cache_miss_tokens"), F.col("turn").cast("bigint").alias("completion_tokens"),
        F.lit(0).cast("bigint").alias("reasoning_tokens")))
    tool = F.when(F.col("role") == "assistant", F.col("text"))
    content = F.when(F.col("role") != "assistant", F.col("text"))
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("chunk_no"),
                    tool.alias("tool_delta"), content.alias("content_delta"), usage_col.alias("usage"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests: query_id, corpus_id, query, scope, file_types."""
    b = table(spark, sf_dir, "benchmark")
    iid = F.col("item_id")
    scope = F.when(iid % 3 == 0, F.lit(None).cast("string")).when(iid % 3 == 1, F.lit("src1")) \
             .otherwise(F.lit("src1/p2"))
    ft = F.when(iid % 2 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit(".py")))
    corpus = (F.when(iid % 4 == 0, "en").when(iid % 4 == 1, "fr").when(iid % 4 == 2, "de").otherwise("es"))
    return b.select(iid.alias("query_id"), corpus.alias("corpus_id"), F.col("text").alias("query"),
                    scope.alias("scope"), ft.alias("file_types"))


#: The corpora of ``files`` (its ``lang`` values), fixed by the data generator.
CORPORA = ("en", "fr", "de", "es")


def requests_all_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage asked of every corpus (scope and types as in
    :func:`requests`); query_id = item_id * 10 + corpus index."""
    r = requests(spark, sf_dir).drop("corpus_id")
    e = r.select("*", F.posexplode(F.array(*[F.lit(c) for c in CORPORA])).alias("_i", "corpus_id"))
    return e.withColumn("query_id", F.col("query_id") * 10 + F.col("_i")).drop("_i")


def stored_plan(spark: SparkSession, sf_dir: str, budget: int = 4000) -> DataFrame:
    """Plan of ``files_v1`` at ``budget``, in stored form (corpus_id, shard_id, prefix, shard_ord)."""
    from corpusflow.operators import shards as S
    from corpusflow.session import materialize
    sf = S.plan_shards(files(spark, sf_dir, "v1"), budget)
    # a stored plan is state read back from storage: materialize it as such
    return materialize(sf.select("corpus_id", "shard_id", "prefix", "shard_ord").distinct(), "stored_plan")
