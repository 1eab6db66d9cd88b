"""K1: response deltas reassembled as a keyed stateful stream.

Chunks (request_id, chunk_no from 0, tool_delta, content_delta, usage[, sent_at]) arrive in
any grouping and order across micro-batches. Per request the state is a map from chunk number
to its parts and one small progress row, so a batch reads and writes only what it brings; a
chunk that is delivered again replaces itself. The response is emitted once usage and all
chunks up to the highest number seen are there, so the rows equal the batch form
:func:`corpusflow.operators.requests.reassemble_chunks`.

A request that goes quiet is emitted by a timer with what there is of it, with the
missing-usage error if usage is missing:

* by event time where chunks have ``sent_at``: when the newest chunk of the whole stream was
  sent ``quiet`` after the request's last one. Rows without a request id only carry time (a
  producer's heartbeat, so that the last requests end too). A chunk later than ``quiet`` is
  dropped. Such a query ends by itself under ``availableNow``.
* by processing time with ``timeout_ms``, for queries that keep running: Spark then keeps
  looking for timeouts, so an ``availableNow`` query does not end by itself.
* with neither, unfinished requests stay in the checkpoint for the next run.

With a timer, a finished request is remembered until it fires, so that late repeats of its
chunks are dropped. State of this kind needs Spark's RocksDB provider, which is set for the
session if the default one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusflow import options as O

OUTPUT_SCHEMA = ("request_id long, tool_text string, content_text string, n_chunks long, "
                 "prompt_tokens long, prompt_cache_hit_tokens long, prompt_cache_miss_tokens long, "
                 "completion_tokens long, reasoning_tokens long, error string")
USAGE_FIELDS = ("prompt_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens",
                "completion_tokens", "reasoning_tokens")
#: ``usage_no``: number of the chunk that the usage came with (the highest one's counts); ``due``: the timer.
PROGRESS = ("n", "highest", "usage_no", "due", "done", *USAGE_FIELDS)
PROGRESS_SCHEMA = ", ".join(f"{f} {'boolean' if f == 'done' else 'long'}" for f in PROGRESS)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STORES = "org.apache.spark.sql.execution.streaming.state."


def use_keyed_state(spark: SparkSession) -> None:
    """Set the state store that keeps maps and timers, unless the session already has its own."""
    if spark.conf.get(_PROVIDER, _STORES + "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _STORES + "RocksDBStateStoreProvider")


def _whole(value):
    return None if pd.isna(value) else int(value)


class Reassembly(StatefulProcessor):
    """``clock``: ``event``, ``processing`` or None; ``timeout_ms``: of the processing clock."""

    def __init__(self, clock: str | None, timeout_ms: int = 0):
        self.clock, self.timeout_ms = clock, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "chunk_no long", "tool string, content string")
        self.progress = handle.getValueState("progress", PROGRESS_SCHEMA)

    def close(self) -> None:
        pass

    def _now(self) -> dict:
        stored = self.progress.get()
        return dict(zip(PROGRESS, stored, strict=True)) if stored is not None else dict.fromkeys(PROGRESS) | {"n": 0, "highest": -1}

    def _row(self, request_id: int, parts: dict, p: dict) -> pd.DataFrame:
        ordered = [parts[k] for k in sorted(parts)]
        tool, content = ("".join(x[i] for x in ordered if x[i] is not None) for i in (0, 1))
        error = O.MSG_NO_USAGE if p["usage_no"] is None else None
        row = (request_id, tool, content, len(parts), *[p[f] for f in USAGE_FIELDS], error)
        return pd.DataFrame([row], columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")], dtype=object)

    def _stored_parts(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.parts.iterator()}

    def _set_timer(self, p: dict, due: int) -> None:
        if p["due"] is not None:
            if due <= p["due"]:
                return
            self.handle.deleteTimer(p["due"])
        self.handle.registerTimer(due)
        p["due"] = due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, p, last = {}, None, None
        for frame in rows:
            if key[1]:
                continue  # a heartbeat
            p = self._now() if p is None else p
            for r in frame.itertuples(index=False):
                if self.clock == "event" and not pd.isna(r.sent_ms):
                    last = max(last or 0, int(r.sent_ms))
                number = int(r.chunk_no)
                new[number] = tuple(x if isinstance(x, str) else None for x in (r.tool_delta, r.content_delta))
                if r.has_usage and (p["usage_no"] is None or number >= p["usage_no"]):
                    p.update({f: _whole(getattr(r, f)) for f in USAGE_FIELDS}, usage_no=number)
        if p is None or p["done"]:
            return
        had = p["n"] > 0
        p["n"] += sum(not (had and self.parts.containsKey((k,))) for k in new)
        p["highest"] = max(p["highest"], *new)
        if self.clock == "processing":
            last = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        if last is not None:
            self._set_timer(p, last)
        if p["usage_no"] is not None and p["n"] == p["highest"] + 1:
            yield self._row(int(key[0]), {**(self._stored_parts() if had else {}), **new}, p)
            if had:
                self.parts.clear()
            if p["due"] is None:
                self.progress.clear()
                return
            p["done"] = True
        else:
            for number, part in new.items():
                self.parts.updateValue((number,), part)
        self.progress.update(tuple(p[f] for f in PROGRESS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = self._now()
        if p["n"] and not p["done"]:
            yield self._row(int(key[0]), self._stored_parts(), p)
        self.parts.clear()
        self.progress.clear()


def reassemble_stream(chunks: DataFrame, timeout_ms: int | None = None, quiet: str = "1 minute") -> DataFrame:
    """Streaming DataFrame of chunks to one row per finished response (see above for the clocks)."""
    use_keyed_state(chunks.sparkSession)
    clock = "processing" if timeout_ms is not None else "event" if "sent_at" in chunks.columns else None
    # a null among the keys of a batch would turn the others into doubles, which the state store reads as null
    columns = [F.coalesce("request_id", F.lit(0)).alias("request_id"), F.col("request_id").isNull().alias("beat"),
               "chunk_no", "tool_delta", "content_delta", F.col("usage").isNotNull().alias("has_usage"),
               *[F.col(f"usage.{f}").alias(f) for f in USAGE_FIELDS]]
    if clock == "event":
        chunks = chunks.withWatermark("sent_at", quiet)
        columns += ["sent_at", F.unix_millis("sent_at").alias("sent_ms")]
    return chunks.select(*columns).groupBy("request_id", "beat").transformWithStateInPandas(
        Reassembly(clock, max(1, timeout_ms or 1)), OUTPUT_SCHEMA, "append",
        {"event": "EventTime", "processing": "ProcessingTime", None: "None"}[clock])
