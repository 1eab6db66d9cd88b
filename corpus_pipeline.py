"""The training-data pipeline over ``documents``: STAGES in order, and run().

Rows with null or repeated ids go through as rows of their own; empty tables stay empty;
all stages but the last return the columns of ``documents``, without changing those that
they don't name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontam, isolation, order_minhash, packing, pretoken, secrets
from corpusflow.llm.common import materialize, with_key, without


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    fitted, _ = isolation.fit(docs, _table(spark, sf_dir, "labels"))
    return isolation.keep(docs, fitted)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class."""
    rows, key = with_key(docs)
    copies = order_minhash.classes(rows, id_col=key).where("not kept")
    return without(rows, key, copies, "doc_id").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that copies a benchmark item."""
    rows, key = with_key(docs)
    leaks = decontam.leaks(rows, _table(spark, sf_dir, "benchmark"), id_col=key)
    return without(rows, key, leaks, "doc_id").select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the text."""
    clean = secrets.redact(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, without the ids themselves."""
    pieces = packing.pack(docs, pretoken.default_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", reject_low_quality),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret scans", hide_secrets),
    ("packing", pack),
]
#: A forest and an alignment are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), force=True)
    return STAGES[-1][1](spark, docs, sf_dir)
