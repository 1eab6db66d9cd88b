"""Requests as table jobs.

The model call is batch inference over a table of (request, shard) rows. A
shard's blocks are streamed in order in front of its requests, once per group: a
shard with very many requests is split into several groups (hash buckets of about
``requests_per_group`` requests). Failures are a column, never a task failure.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusflow import options as O
from corpusflow.functions import text as T
from corpusflow.operators.joins import block_join, salted_join
from corpusflow.operators.context import BASE, CHANGE, SHARDED_INSTRUCTIONS, SINGLE_INSTRUCTIONS, TREE

TREE_MARK = "\u0000TREE\u0000"
#: What follows a shard's blocks and tree (context.BASE, CHANGE, TREE) in its task.
REQUEST = 4


# -- C10 -----------------------------------------------------------------------

def _folders(text: Column) -> Column:
    """Every part of a path up to and including one of its slashes, shortest first."""
    parts = F.split(text, "/")
    n = F.size(parts) - 1
    upto = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(n > 0, upto).otherwise(F.array().cast("array<string>"))


def _meets(how: str, paths: Column) -> Column:
    return F.transform(paths, lambda p: F.struct(F.lit(how).alias("how"), p.alias("at")))


def prune_by_scope(requests: DataFrame, plan: DataFrame) -> DataFrame:
    """Request x shard fan-out restricted to shards meeting the scope. ``n_shards``
    is the size of the whole plan, as shown to the model; NULL for a corpus planned as one
    ``__all__`` shard (the single-shard path).

    ``requests``: query_id, corpus_id, scope and any others; ``plan`` prefixes are empty or end with
    a slash, as all plans' do. Each test of B12 is an equality of exploded folders: a scope lies under
    a shard whose prefix is one of its folders (or empty), a shard under a scope that is one of its
    prefix's folders; a request without a scope meets every shard. A pair meets in one way only, and
    only pairs of the result are made; pairs of a hot corpus or folder by many tasks."""
    n = plan.groupBy("corpus_id").agg(F.count(F.lit(1)).cast("bigint").alias("_n"),
                                      F.max(F.col("shard_id") == O.ALL_SHARD).alias("_single"))
    p = salted_join(plan.select("corpus_id", "shard_id", "prefix", "shard_ord"), n, ["corpus_id"], spread="shard_id")
    scope, prefix = F.col("scope"), F.col("prefix")
    under = F.when(F.endswith(scope, F.lit("/")), scope).otherwise(F.concat(scope, F.lit("/")))
    asked = F.when(scope.isNull() | (scope == ""), _meets("any", F.array(F.lit("")))).otherwise(F.concat(
        _meets("inside", F.concat(F.array(F.lit("")), _folders(under))), _meets("around", F.array(under))))
    held = F.concat(_meets("any", F.array(F.lit(""))), _meets("inside", F.array(prefix)),
                    _meets("around", F.filter(_folders(prefix), lambda f: f != prefix)))
    key = ["corpus_id", "_how", "_at"]
    r = requests.select("corpus_id", F.col("query_id").alias("_q"), F.struct("*").alias("_r"), F.explode(asked).alias("_m"))
    s = p.select("corpus_id", "shard_id", F.struct("*").alias("_s"),
                 F.explode(F.coalesce(held, _meets("any", F.array(F.lit(""))))).alias("_m"))
    r, s = (d.withColumn("_how", F.col("_m.how")).withColumn("_at", F.col("_m.at")).drop("_m") for d in (r, s))
    j = block_join(r, s, key, "_q", "shard_id")
    return j.select("_r.*", "_s.shard_id", "_s.prefix", "_s.shard_ord", F.when(~F.col("_s._single"), F.col("_s._n")).alias("n_shards"))


# -- J3, J4, B13 ---------------------------------------------------------------

def resolve_attempts(attempts: DataFrame, max_attempts: int = O.MAX_ATTEMPTS) -> DataFrame:
    """Outcome per request from an attempt log (request_id, attempt, status_code, message; 200 =
    success, NULL = no code). Stops at the first success or first non-retryable error; otherwise the
    last attempt's error, with the number of attempts made, at most ``max_attempts``.

    With a column ``attempt_kind`` (J4, :func:`validate_response`; NULL where the call itself failed) an
    answered attempt succeeds only if it is ``ok``: any other kind is tried again, and a last attempt
    without a tool call has its own error."""
    kind = F.col("attempt_kind") if "attempt_kind" in attempts.columns else F.lit(None).cast("string")
    answered = F.coalesce(F.col("status_code") == 200, F.lit(False))
    a = attempts.where(F.col("attempt") <= max_attempts) \
        .withColumn("_kind", F.when(answered, F.coalesce(kind, F.lit("ok"))))
    terminal = (F.col("_kind") == "ok") | (~answered & ~T.is_retryable("status_code"))
    agg = a.groupBy("request_id").agg(
        F.min(F.when(terminal, F.col("attempt"))).alias("_t"),
        F.max("attempt").alias("_last"))
    j = a.join(agg, "request_id").where(F.col("attempt") == F.coalesce("_t", "_last"))
    ok = F.coalesce(F.col("_kind") == "ok", F.lit(False))
    made = F.col("attempt").cast("string")
    reason = F.when(F.col("_kind") == "missing_usage", F.lit(O.MSG_NO_USAGE)).otherwise(F.col("message"))
    err = (F.when(ok, F.lit(None).cast("string"))
           .when(F.col("_t").isNotNull(), F.format_string(O.FMT_API_ERROR, F.col("status_code").cast("string"),
                                                          F.col("message")))
           .when(F.col("_kind") == "no_tool_call", F.format_string(O.FMT_NO_TOOL_CALL, made))
           .otherwise(F.format_string(O.FMT_RETRIES_EXHAUSTED, made, reason)))
    return j.select("request_id", F.col("attempt").alias("final_attempt"), "status_code",
                    F.when(ok, "ok").otherwise("failed").alias("outcome"), err.alias("error"),
                    F.when(F.col("_t").isNull() & ~ok, True).otherwise(False).alias("exhausted"))


def validate_response(df: DataFrame) -> DataFrame:
    """Classify one streamed attempt (tool_text, usage): absent usage is an
    error (retryable), absent tool text means no tool call (retried), unparsable
    tool text is an error (retryable)."""
    kind = (F.when(F.col("usage").isNull(), F.lit("missing_usage"))
            .when(F.coalesce(F.col("tool_text"), F.lit("")) == "", F.lit("no_tool_call"))
            .when(F.try_parse_json("tool_text").isNull(), F.lit("parse_error"))
            .otherwise(F.lit("ok")))
    return df.withColumn("attempt_kind", kind).withColumn("retryable", F.col("attempt_kind") != "ok")


# -- D11 -----------------------------------------------------------------------

def reassemble_chunks(chunks: DataFrame) -> DataFrame:
    """Ordered concatenation of tool and content deltas per request, the
    last non-null usage, the chunk count, and the missing-usage error."""
    def cat(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col(c).isNotNull(), F.struct(F.col("chunk_no").alias("k"), F.col(c).alias("t"))))),
            lambda x: x["t"]), "")
    out = chunks.groupBy("request_id").agg(
        cat("tool_delta").alias("tool_text"), cat("content_delta").alias("content_text"),
        F.max_by(F.col("usage"), F.when(F.col("usage").isNotNull(), F.col("chunk_no"))).alias("usage"),
        F.count(F.lit(1)).cast("bigint").alias("n_chunks"))
    return out.withColumn("error", F.when(F.col("usage").isNull(), F.lit(O.MSG_NO_USAGE)))


# -- L2: responders ------------------------------------------------------------

class ResponderError(Exception):
    """An API error with an optional HTTP status code."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


Responder = Callable[[list[dict]], dict]


def _one_value_a_key(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("duplicate key")
    return out


def _no_constant(name: str):
    raise ValueError(name)


def _parses(text: str) -> bool:
    """Whether ``text`` is JSON in the strict sense that the answer parser (I1) shares:
    no duplicate keys, no NaN or Infinity."""
    try:
        json.loads(text, object_pairs_hook=_one_value_a_key, parse_constant=_no_constant)
    except ValueError:
        return False
    return True


def reply_kind(reply: dict) -> str:
    """J4 for one reply; every kind but ``ok`` is tried again."""
    if not reply.get("usage"):
        return "missing_usage"
    if not reply.get("arguments"):
        return "no_tool_call"
    return "ok" if _parses(reply["arguments"]) else "parse_error"


def attempt_once(responder: Responder, messages: list[dict]) -> tuple[str, dict | None, Exception | None]:
    """(kind, reply, exception) of one call: a kind of :func:`reply_kind`, ``fatal`` for a
    status that must not be tried again, ``failed`` for any other exception."""
    try:
        reply = responder(messages)
        return reply_kind(reply), reply, None
    except Exception as e:  # a failure is a row of the result, never a failed task
        status = getattr(e, "status", None)
        return "failed" if status is None or status in O.RETRYABLE_STATUS else "fatal", None, e


def call_with_retries(responder: Responder, messages: list[dict], max_attempts: int = O.MAX_ATTEMPTS,
                      sleep: bool = False, rng: random.Random | None = None) -> dict:
    """One request. A responder returns ``{"arguments": str | None, "content":
    str | None, "usage": dict | None}`` or raises; an exception's ``status`` says
    whether it is tried again (none: it is). Returns arguments, usage, attempts, error."""
    rng = rng or random.Random()
    failed = {"arguments": None, "usage": None}
    for attempt in range(1, max_attempts + 1):
        kind, reply, error = attempt_once(responder, messages)
        if kind == "ok":
            return {"arguments": reply["arguments"], "usage": reply["usage"], "attempts": attempt, "error": None}
        if kind == "fatal":
            return {**failed, "attempts": attempt, "error": O.FMT_API_ERROR % (error.status, error)}
        if sleep and attempt < max_attempts:
            base = min(O.BACKOFF_BASE_MS * 2 ** (attempt - 1), O.BACKOFF_CAP_MS)
            time.sleep(round(base + rng.random() * base * O.BACKOFF_JITTER) / 1000.0)
    reason = {"missing_usage": O.MSG_NO_USAGE, "failed": error,
              "parse_error": reply and O.FMT_PARSE_FAILURE % str(reply.get("arguments"))[:200]}.get(kind)
    text = O.FMT_NO_TOOL_CALL % max_attempts if kind == "no_tool_call" else O.FMT_RETRIES_EXHAUSTED % (max_attempts, reason)
    return {**failed, "attempts": max_attempts, "error": text}


def _counter(usage: dict, name: str) -> int:
    value = usage.get(name)
    return int(value) if isinstance(value, (int, float)) and value == value else 0


RESPONSE_SCHEMA = ("query_id long, corpus_id string, shard_id string, shard_ord int, attempts int, "
                   "arguments string, error string, prompt_tokens long, prompt_cache_hit_tokens long, "
                   "prompt_cache_miss_tokens long, completion_tokens long, reasoning_tokens long")


USAGE_NAMES = ("prompt_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens", "completion_tokens")


class Collected:
    """A session for a plain responder: it collects the blocks and sends them whole with each turn."""

    def __init__(self, responder: Responder, instructions: str):
        self.responder, self.instructions, self.blocks = responder, instructions, {BASE: [], CHANGE: []}

    def feed(self, part: int, block: str) -> None:
        self.blocks[part].append(block)

    def ask(self, turn: str) -> dict:
        texts = [self.instructions, "\n\n".join(self.blocks[BASE])]
        if self.blocks[CHANGE]:
            texts.append("\n\n".join(self.blocks[CHANGE]))
        return self.responder([{"role": "user", "content": t} for t in (*texts, turn)])


class _Shown:
    """A session that is being fed; what fails while it is opened or fed fails its requests, not the task."""

    def __init__(self, responder, instructions: str):
        self.error = self.session = None
        self._do(lambda: setattr(self, "session", responder.open(instructions) if hasattr(responder, "open") else Collected(responder, instructions)))

    def _do(self, step) -> None:
        try:
            step()
        except Exception as e:
            self.error = e

    def feed(self, part: int, block: str) -> None:
        if self.error is None:
            self._do(lambda: self.session.feed(part, block))

    def ask(self, turn: str) -> dict:
        if self.error is not None:
            raise self.error
        return self.session.ask(turn)


def _answer_shards(responder, max_attempts: int, sleep: bool):
    """Task body: sorted rows of shards (blocks, tree, then requests) to responses; one row is held at a time."""
    schema = to_arrow_schema(StructType.fromDDL(RESPONSE_SCHEMA))

    def run(batches):
        key = shown = None
        for batch in batches:
            out = []
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (r["corpus_id"], r["shard_id"], r["bucket"]) != key:
                    key, tree = (r["corpus_id"], r["shard_id"], r["bucket"]), []
                    shown = _Shown(responder, SINGLE_INSTRUCTIONS if r["shard_id"] == O.ALL_SHARD else SHARDED_INSTRUCTIONS)
                if r["part"] in (BASE, CHANGE):
                    shown.feed(r["part"], r["block"])
                elif r["part"] == TREE:
                    tree.append(r["block"])
                else:
                    tree = ["\n".join(tree)]
                    out.append(_response(r, shown, tree[0], max_attempts, sleep))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def _response(r: dict, shown: _Shown, tree: str, max_attempts: int, sleep: bool) -> dict:
    turn = r["block"].replace(TREE_MARK, tree)
    rng = random.Random(f"{r['query_id']}/{r['shard_id']}")
    out = call_with_retries(lambda _: shown.ask(turn), [], max_attempts, sleep, rng)
    u = out["usage"] if isinstance(out["usage"], dict) else {}
    det = u.get("completion_tokens_details")
    det = {**u, **det} if isinstance(det, dict) else u
    return {**{c: r[c] for c in ("query_id", "corpus_id", "shard_id", "shard_ord")}, "attempts": out["attempts"],
            "arguments": out["arguments"], "error": out["error"], **{n: _counter(u, n) for n in USAGE_NAMES},
            "reasoning_tokens": _counter(det, "reasoning_tokens")}


def run_requests(request_shards: DataFrame, blocks: DataFrame, trees: DataFrame,
                 responder, max_attempts: int = O.MAX_ATTEMPTS,
                 requests_per_group: int = 64, sleep: bool = True) -> DataFrame:
    """One model call per (request, shard), all shards in parallel.

    ``request_shards`` from :func:`prune_by_scope` (query_id, corpus_id,
    shard_id, shard_ord, n_shards, query, scope, file_types); ``blocks``: rows of
    :func:`context.base_blocks` and :func:`context.change_blocks`; ``trees``: rows of
    :func:`context.shard_tree_rows`. The query turn is rendered JVM-side with a tree marker
    that the Python side fills from the shard's tree, so it is not copied per request.

    A shard's blocks are sorted by Spark and streamed through its task in front of its
    requests. ``responder`` is a plain one (messages to reply), for which the blocks
    are collected, or has ``open(instructions)``: its session gets each block by
    ``feed(part, block)`` and each turn by ``ask(turn)``, and decides itself what to
    keep, so a shard of any size is answered with the memory of one block. The
    result is not repeatable (external calls): materialize it before reuse."""
    sharded = F.col("n_shards").isNotNull()
    rs = request_shards.select(
        "query_id", "corpus_id", "shard_id", F.col("shard_ord").cast("int").alias("shard_ord"),
        T.render_query_turn(F.lit(TREE_MARK), "query", "scope", "file_types",
                            F.when(sharded, F.col("shard_id")), "n_shards").alias("block"))
    counts = rs.groupBy("corpus_id", "shard_id").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select("corpus_id", "shard_id", F.ceil(F.col("_c") / F.lit(requests_per_group)).alias("_nb"))
    rs = salted_join(rs, counts, ["corpus_id", "shard_id"], spread="query_id") \
        .withColumn("bucket", F.pmod(F.xxhash64("query_id"), F.col("_nb")).cast("int")).drop("_nb")
    keys = ["corpus_id", "shard_id"]
    columns = [*keys, "part", "ord", "path", "block"]
    shown = blocks.select(*columns).unionByName(trees.select(*columns))
    # both sides usually descend from the same plan table: fresh column ids keep the join unambiguous
    shown = shown.select(*[F.col(c).alias(c) for c in shown.columns]).join(counts, keys)
    shown = shown.withColumn("bucket", F.explode(F.sequence(F.lit(0), (F.col("_nb") - 1).cast("int")))).drop("_nb") \
        .withColumn("query_id", F.lit(None).cast("bigint")).withColumn("shard_ord", F.lit(None).cast("int"))
    rows = shown.unionByName(rs.withColumn("part", F.lit(REQUEST)).withColumn("ord", F.lit(None).cast("bigint"))
                             .withColumn("path", F.lit(None).cast("string")))
    _small_batches(rows.sparkSession)
    rows = rows.repartition(*keys, "bucket").sortWithinPartitions(*keys, "bucket", "part", "ord", "path", "query_id")
    return rows.mapInArrow(_answer_shards(responder, max_attempts, sleep), RESPONSE_SCHEMA)


#: Bytes of blocks that a task receives at once.
BATCH_BYTES = 8 << 20


def _small_batches(spark) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))
