"""Saved state as versioned parquet tables.

State lives under one root on shared storage. A write makes one folder
``<root>/v=<n>.<tag>/`` with the tables below for the corpora that it replaces, and no
others, so a refresh of one corpus writes only that corpus. Then the store's manifest
(:mod:`corpusflow.sources.manifest`) names the folder for these corpora: from there on it is
their state. A writer that crashes before leaves the previous state in force. Writers of
different corpora all get through; of two writers of one corpus that read the same state,
one succeeds and the other gets a ``Conflict`` and starts again from the new state. Reading
costs one manifest, and the folders that it names. Marks live in the manifest, so they
outlast the folders; replaced folders go with :func:`drop_superseded`.

Tables:
* ``base_shards``: corpus_id, shard_id, base_token_count, base_text, snapshot_ts
* ``base_files``: corpus_id, shard_id, path, hash, snapshot_ts
* ``shard_plan``: corpus_id, shard_id, prefix, shard_ord, plan_hash, snapshot_ts
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.sources import manifest as M

BASE_SHARDS_SCHEMA = ("corpus_id string, shard_id string, base_token_count bigint, base_text string, "
                      "snapshot_ts bigint")
BASE_FILES_SCHEMA = "corpus_id string, shard_id string, path string, hash string, snapshot_ts bigint"
PLAN_SCHEMA = ("corpus_id string, shard_id string, prefix string, shard_ord int, plan_hash string, "
               "snapshot_ts bigint")
TABLES = {"base_shards": BASE_SHARDS_SCHEMA, "base_files": BASE_FILES_SCHEMA, "shard_plan": PLAN_SCHEMA}


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions whose folders exist, old ones included."""
    now = M.read(spark, root)
    return sorted({_number(f) for f in (*now.entries.values(), *now.old)})


def _number(folder: str) -> int:
    return int(folder[2:].partition(".")[0])


def read_state(spark: SparkSession, root: str, table: str, seen: M.Manifest | None = None) -> DataFrame:
    """A state table, each corpus from the folder that the manifest (``seen``, by default
    the current one) names; an empty DataFrame of the fixed schema when there is none."""
    entries = (seen or M.read(spark, root)).entries
    if not entries:
        return spark.createDataFrame([], TABLES[table])
    root = root.rstrip("/")
    paths = [f"{root}/{folder}/{table}" for folder in sorted(set(entries.values()))]
    rows = spark.read.schema(TABLES[table] + ", v string").option("basePath", root).parquet(*paths)
    current = spark.createDataFrame([(c, f[2:]) for c, f in sorted(entries.items())], "corpus_id string, v string")
    # the manifest's rows: a local table has no known size, and a corpus's state must not meet in one task
    return rows.join(F.broadcast(current), ["corpus_id", "v"], "left_semi").drop("v")


def has_mark(spark: SparkSession, root: str, mark: str) -> bool:
    """Whether a version was committed with ``mark``."""
    return M.read(spark, root).has(mark)


def write_state(root: str, base_shards: DataFrame, base_files: DataFrame, plan: DataFrame, mark: str | None = None,
                corpora: DataFrame | None = None, seen: M.Manifest | None = None) -> int:
    """Write a version that replaces the state of ``corpora`` (corpus_id; by default those that the
    tables name) by the given rows, and commit it with ``mark`` (a name). ``seen``: the manifest that
    the rows were computed from (by default: now); raises ``manifest.Conflict`` if one of the corpora
    was replaced since."""
    spark = base_shards.sparkSession
    seen = seen or M.read(spark, root)
    folder = f"v={seen.number + 1}.{uuid.uuid4().hex[:8]}"
    d = f"{root.rstrip('/')}/{folder}"
    for name, df in {"base_files": base_files, "shard_plan": plan, "base_shards": base_shards}.items():
        df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("error").parquet(f"{d}/{name}")
    if corpora is None:
        corpora = spark.read.parquet(f"{d}/shard_plan").select("corpus_id")
        for name in ("base_files", "base_shards"):
            corpora = corpora.union(spark.read.parquet(f"{d}/{name}").select("corpus_id"))
    names = [r.corpus_id for r in corpora.select("corpus_id").distinct().collect()]  # of corpora, not of files
    return M.commit(spark, root, {c: folder for c in names}, seen, mark).number


def drop_superseded(spark: SparkSession, root: str) -> int:
    """Delete the folders that were replaced for all their corpora (run it when no reader of
    an older version is at work). Folders of writers at work are not touched. Returns how many went."""
    old = M.read(spark, root).old
    fs, _, jvm = _fs(spark, root)
    for name in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}"), True)
    M.forget(spark, root, old)
    return len(old)


def upsert_base(existing: DataFrame, new: DataFrame, existing_files: DataFrame | None = None,
                new_files: DataFrame | None = None):
    """Keep the record with the newer ``snapshot_ts``; on a tie the existing
    one stays. Returns the winning base_shards (and base_files if given)."""
    e = existing.withColumn("_is_new", F.lit(0))
    n = new.withColumn("_is_new", F.lit(1))
    w = Window.partitionBy("corpus_id", "shard_id").orderBy(F.col("snapshot_ts").desc(), F.col("_is_new"))
    won = e.unionByName(n).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    if existing_files is None or new_files is None:
        return won.drop("_is_new")
    files = existing_files.withColumn("_is_new", F.lit(0)).unionByName(new_files.withColumn("_is_new", F.lit(1)))
    files = files.join(won.select("corpus_id", "shard_id", "_is_new"), ["corpus_id", "shard_id", "_is_new"],
                       "left_semi").drop("_is_new")
    return won.drop("_is_new"), files


def prune_base(state: DataFrame, plan: DataFrame) -> DataFrame:
    """Drop state of shards that are not in the active plan."""
    return state.join(plan.select("corpus_id", "shard_id").distinct(), ["corpus_id", "shard_id"], "left_semi")


def base_record(shard_files: DataFrame, contexts: DataFrame, decisions: DataFrame,
                successes: DataFrame, snapshot_ts: int):
    """New bases for shards that were rebuilt and answered successfully.

    ``shard_files``: corpus_id, shard_id, path, hash, tokens; ``contexts``:
    corpus_id, shard_id, base_text; ``decisions``: corpus_id, shard_id,
    needs_rebuild; ``successes``: corpus_id, shard_id (at least one answer).
    Returns (base_shards, base_files)."""
    keep = decisions.where(F.col("needs_rebuild")).select("corpus_id", "shard_id") \
                    .join(successes.select("corpus_id", "shard_id").distinct(), ["corpus_id", "shard_id"])
    sf = shard_files.join(keep, ["corpus_id", "shard_id"], "left_semi")
    tokens = sf.groupBy("corpus_id", "shard_id").agg(F.sum("tokens").cast("bigint").alias("base_token_count"))
    shards = tokens.join(contexts.select("corpus_id", "shard_id", "base_text"), ["corpus_id", "shard_id"]) \
                   .withColumn("snapshot_ts", F.lit(snapshot_ts).cast("bigint"))
    files = sf.select("corpus_id", "shard_id", "path", "hash", F.lit(snapshot_ts).cast("bigint").alias("snapshot_ts"))
    return shards, files


def import_plan(spark: SparkSession, path: str, corpus_id: str | None = None) -> DataFrame:
    """Plan documents (``shard_meta.json``: an array ``shards`` of objects with id and
    prefix, in stored order) as corpus_id, shard_id, prefix, shard_ord. Malformed
    documents are dropped."""
    schema = "shards array<struct<id:string,prefix:string>>, _corrupt_record string"
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
          .withColumn("corpus_id", _corpus_of_file(corpus_id)))
    df = df.where(F.col("_corrupt_record").isNull() & F.col("shards").isNotNull())
    df = df.select("corpus_id", F.posexplode("shards").alias("i", "s"))
    return df.select("corpus_id", F.col("s.id").alias("shard_id"), F.coalesce("s.prefix", F.lit("")).alias("prefix"),
                     (F.col("i") + 1).cast("int").alias("shard_ord"))


def _corpus_of_file(corpus_id: str | None):
    return F.lit(corpus_id) if corpus_id else F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+\.json$", 1)


def import_state(spark: SparkSession, path: str, corpus_id: str | None = None, plan: DataFrame | None = None):
    """JSON documents (one per shard: base_token_count, base_request_text,
    file_hashes map, timestamp) into the state tables. Malformed documents are
    dropped (PERMISSIVE mode).

    A file ``shard_<key>.json`` holds the shard whose id has that state key (A12;
    several characters of an id may become one of the key, so the key alone does
    not tell the id): ids come from ``plan`` (corpus_id, shard_id; see
    :func:`import_plan`), and files of shards outside it are dropped. Without a
    plan, a shard's id is the longest folder that its files share: the folder
    itself, or its ``__root__`` where the key says so. ``base.json`` is ``__all__``."""
    schema = ("base_token_count double, base_request_text string, file_hashes map<string,string>, "
              "timestamp double, _corrupt_record string")
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
          .withColumn("_key", F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1), "^shard_", ""))
          .withColumn("corpus_id", _corpus_of_file(corpus_id)))
    df = df.where(F.col("_corrupt_record").isNull() & F.col("timestamp").isNotNull() & F.col("file_hashes").isNotNull())
    if plan is not None:
        ids = plan.select("corpus_id", "shard_id").distinct().withColumn(
            "_key", F.when(F.col("shard_id") == "__all__", "base").otherwise(T.state_key("shard_id")))
        df = df.join(ids, ["corpus_id", "_key"])
    else:
        # the folder whose key this is, among those of the shard's own paths
        paths = F.map_keys("file_hashes")
        folders = F.array_distinct(F.flatten(F.transform(paths, lambda p: F.transform(
            F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda n: F.array_join(F.slice(F.split(p, "/"), F.lit(1), n), "/")))))
        ids = F.flatten(F.transform(folders, lambda d: F.array(d, F.concat(d, F.lit("/__root__")))))
        named = F.filter(ids, lambda d: F.replace(d, F.lit("/"), F.lit("__")) == F.col("_key"))
        df = df.withColumn("shard_id", F.when(F.col("_key") == "base", "__all__").when(F.col("_key") == "__root__", "__root__")
                           .otherwise(F.coalesce(F.get(named, F.lit(0)), F.replace("_key", F.lit("__"), F.lit("/")))))
    df = df.select("corpus_id", "shard_id", F.col("base_token_count").cast("bigint").alias("base_token_count"),
                   F.col("base_request_text").alias("base_text"),
                   F.col("timestamp").cast("bigint").alias("snapshot_ts"), "file_hashes")
    files = df.select("corpus_id", "shard_id", F.explode("file_hashes").alias("path", "hash"), "snapshot_ts")
    return df.drop("file_hashes"), files
