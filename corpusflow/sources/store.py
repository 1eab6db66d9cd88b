"""A1 with C2: incremental snapshots over a store of bodies.

A snapshot takes two phases. The listing (corpus_id, path, mtime_ms, size; no bodies) is joined
with the previous snapshot's rows; files whose time and size are the same keep their hash, token
and line counts. Only the other files' bodies are read, in tasks, and stored once with what was
counted of them. A snapshot's rows say in which ``body`` folder a file's text lies, so texts are
looked up later for just those files that need them (rebuilt shards, snippets) and never pass
through the join.

Store layout: ``bodies/body=<name>/`` (rows with text, one folder a snapshot), ``rows/<name>/`` (a
snapshot's rows without text), and the manifest that names each corpus's folder of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources import files as SF
from corpusflow.sources import manifest as M

ROWS_SCHEMA = "corpus_id string, path string, mtime_ms bigint, size bigint, hash string, tokens bigint, n_lines bigint, body string"
BODY_SCHEMA = "corpus_id string, path string, mtime_ms bigint, size bigint, content string, hash string, tokens bigint, n_lines bigint"
_KEY = ["corpus_id", "path", "mtime_ms", "size"]


def stored_rows(spark: SparkSession, root: str, seen: M.Manifest | None = None) -> DataFrame:
    """Rows of the newest snapshot of each corpus (:data:`ROWS_SCHEMA`)."""
    entries = (seen or M.read(spark, root)).entries
    if not entries:
        return spark.createDataFrame([], ROWS_SCHEMA)
    folders = sorted(set(entries.values()))
    found = spark.read.schema(ROWS_SCHEMA + ", folder string").parquet(*[f"{root.rstrip('/')}/rows/{f}" for f in folders])
    current = spark.createDataFrame(sorted(entries.items()), "corpus_id string, folder string")
    return found.join(current, ["corpus_id", "folder"], "left_semi").drop("folder")


def with_content(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` (with corpus_id, path, body) and their texts as ``content``; folders that no row names are not read."""
    bodies = rows.sparkSession.read.schema(BODY_SCHEMA + ", body string").parquet(f"{root.rstrip('/')}/bodies")
    return rows.join(bodies.select("corpus_id", "path", "body", "content"), ["corpus_id", "path", "body"])


def snapshot(listing: DataFrame, read_bodies: Callable[[DataFrame], DataFrame], root: str, counter: Column | None = None) -> DataFrame:
    """Take the next snapshot of the listing's corpora and make it the store's current one.

    ``listing``: corpus_id, path, mtime_ms, size, all files of each corpus that it names (other
    corpora keep their rows). ``read_bodies`` adds ``content`` (text or bytes) to rows of it; it gets
    only files that the store doesn't hold with this time and size; a file that it leaves out has
    vanished and is left out too. A null time or size is never taken as unchanged, a path listed
    twice counts once. Returns the rows (:data:`ROWS_SCHEMA`) and ``reused``; raises
    :class:`manifest.Conflict` if another writer took a snapshot of one of the corpora meanwhile."""
    spark = listing.sparkSession
    root = root.rstrip("/")
    seen = M.read(spark, root)
    listed = listing.select(*_KEY).dropDuplicates(["corpus_id", "path"])
    before = stored_rows(spark, root, seen)
    name = uuid.uuid4().hex
    missing = listed.join(before.select(*_KEY), _KEY, "left_anti")
    read = SF.snapshot(read_bodies(missing).select(*_KEY, "content"), counter)
    read.select(*[c.split()[0] for c in BODY_SCHEMA.split(", ")]).write.mode("error").parquet(f"{root}/bodies/body={name}")
    new = spark.read.schema(BODY_SCHEMA).parquet(f"{root}/bodies/body={name}").drop("content").withColumn("body", F.lit(name))
    columns = [c.split()[0] for c in ROWS_SCHEMA.split(", ")]
    kept = before.join(listed, _KEY, "left_semi")
    rows = kept.select(*columns, F.lit(True).alias("reused")).unionByName(new.select(*columns, F.lit(False).alias("reused")))
    rows.withColumn("folder", F.lit(name)).write.mode("error").parquet(f"{root}/rows/{name}")
    corpora = [r.corpus_id for r in listing.select("corpus_id").distinct().collect()]  # names of corpora, not of files
    M.commit(spark, root, {c: name for c in corpora}, seen)
    return spark.read.schema(ROWS_SCHEMA + ", reused boolean").parquet(f"{root}/rows/{name}")


def scan(spark: SparkSession, tree: str, root: str, corpus_id: str, exclude_state: bool = True) -> DataFrame:
    """:func:`snapshot` of a directory tree (A1): folders are listed, and only changed files are opened."""
    listing = SF.scan_files(spark, tree, corpus_id, with_content=False)
    if exclude_state:
        listing = SF.exclude_reserved(listing, anywhere=True)
    return snapshot(listing, lambda missing: SF.read_files(missing, tree), root)


def compact(spark: SparkSession, root: str) -> int:
    """Copy the texts still in use into one folder and drop the others; returns how many folders went.
    Run it when no reader of an older snapshot is at work."""
    root = root.rstrip("/")
    seen = M.read(spark, root)
    name = uuid.uuid4().hex
    rows = stored_rows(spark, root, seen)
    with_content(rows, root).select(*[c.split()[0] for c in BODY_SCHEMA.split(", ")]).write.mode("error").parquet(f"{root}/bodies/body={name}")
    rows.withColumn("body", F.lit(name)).withColumn("folder", F.lit(name)).write.mode("error").parquet(f"{root}/rows/{name}")
    M.commit(spark, root, {c: name for c in seen.entries}, seen)
    jvm = spark.sparkContext._jvm
    gone = 0
    for part, keep in (("bodies", f"body={name}"), ("rows", name)):
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{part}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(folder):
            if s.getPath().getName() != keep:
                fs.delete(s.getPath(), True)
                gone += part == "bodies"
    return gone
