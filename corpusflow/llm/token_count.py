"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

Tier one is a broadcast table of the most frequent pre-tokens and their numbers of
ids: at most ``TABLE`` entries of at most ``LONGEST`` characters, whatever the input.
It is filled from a pass over all texts: each task keeps a bounded summary of its
counts (lossy counting: a run found once in ``HELD`` bytes of runs adds nothing to it),
and summaries (not pre-tokens) are merged by a tree of map tasks. Tier two
is the worker's cache, filled by the library on a miss; a run between white space meets it
once a block of texts, which Arrow splits. The table only saves work: counts are exact
whatever is in it.

Null text counts as empty (0 bytes, 0 tokens); repeated rows and ids give a row
each; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import chunks, keyed, small_batches

TABLE = 1 << 16
LONGEST = 40
#: Entries of one task's summary, pre-tokens that it holds at once, and bytes of runs that are counted at once.
SUMMARY, DISTINCT, HELD = 1 << 14, 800_000, 1 << 24
#: Summaries that one merging task reads.
FAN_IN = 32


def _trim(counts: Counter, size: int) -> Counter:
    return Counter(dict(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:size]))


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"pieces": pa.array([list(counts)], pa.list_(pa.string())), "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))}
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, size = Counter(), [], 0

    def fold() -> None:
        found = pc.value_counts(pa.chunked_array(held))
        found, counts = found.filter(pc.greater(found.field("counts"), 1)).flatten()
        for run, n in zip(found.to_numpy(zero_copy_only=False), counts.to_numpy().tolist(), strict=True):
            for p in (run.lower(),) if run.isascii() and run.isalpha() else pretoken.pretokens(run) or ():
                if len(p) <= LONGEST:
                    total[p] += n
        held.clear()

    for batch in batches:
        texts = batch.column("text")
        for i, j, *_ in chunks(texts, pretoken.BLOCK):
            held.append(pretoken.white_space_runs(texts[i:j]).flatten())
            size += held[-1].nbytes
            if size > HELD:
                fold()
                size = 0
                if len(total) > DISTINCT:
                    total = _trim(total, DISTINCT // 4)
    if held:
        fold()
    yield _rows(_trim(total, SUMMARY))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter()
    for batch in batches:
        for row in batch.to_pylist():
            total.update(dict(zip(row["pieces"], row["counts"], strict=True)))
        total = _trim(total, TABLE)
    yield _rows(total)


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """{pre-token: number of ids} of at most ``TABLE`` frequent pre-tokens of all texts."""
    schema = "pieces array<string>, counts array<long>"
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = texts.mapInArrow(_summaries, schema)
    tasks = found.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = found.repartition(tasks).mapInArrow(_merged, schema)
    total = Counter()
    for row in found.collect():  # the last level is one summary of at most TABLE entries
        total.update(dict(zip(row["pieces"], row["counts"], strict=True)))
    encode = pretoken.Encoder(path)
    return {p: encode._piece_count(p) for p in _trim(total, TABLE)}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""
    path = path or pretoken.default_path()
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col))
    tag = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pretoken.encoder(path, tag, table.value)
        for batch in batches:
            n = pa.array(encode.counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
