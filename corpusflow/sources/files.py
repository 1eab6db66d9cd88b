"""File sources (A1-A3, A5, A6, B1-B3 applied): from a directory tree, an
exported path listing, or a document table to the ``files`` snapshot table.

``files``: corpus_id, path, content, hash, tokens, n_lines (+ mtime_ms, size when
known). Snapshot order is ``path ASC``; nothing depends on physical row order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.functions import text as T
from corpusflow.session import materialize


LISTED = "path string, is_dir boolean, mtime_ms long, size long"


def _filesystem(root: str):
    """(pyarrow file system, path on it) of a folder: any URI that pyarrow knows, or a plain path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _list_folders(root: str):
    """Task body: (path) rows of folders relative to ``root`` to :data:`LISTED` rows of their entries."""
    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs
        system, top = _filesystem(root)
        top = top.rstrip("/")
        for batch in batches:
            rows = []
            for folder in batch.column("path").to_pylist():
                for info in system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"))):
                    if info.type not in (fs.FileType.File, fs.FileType.Directory):
                        continue
                    if isinstance(system, fs.LocalFileSystem) and os.path.islink(info.path):
                        continue  # regular files only; a link may also lead in a circle
                    rows.append({"path": info.path[len(top) + 1:], "is_dir": info.type == fs.FileType.Directory,
                                 "mtime_ms": info.mtime_ns // 1_000_000 if info.mtime_ns else None,
                                 "size": info.size if info.type == fs.FileType.File else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("is_dir", pa.bool_()),
                                                                     ("mtime_ms", pa.int64()), ("size", pa.int64())]))
    return run


def _read_bodies(root: str):
    def run(batches):
        import pyarrow as pa
        system, top = _filesystem(root)
        top = top.rstrip("/")
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):  # one body at a time
                try:
                    with system.open_input_stream(f"{top}/{path}") as f:
                        body = pa.array([f.read()], pa.binary())
                except FileNotFoundError:
                    continue  # deleted since the folder was listed
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, body], [*batch.schema.names, "content"])
    return run


def scan_files(spark: SparkSession, root: str, corpus_id: str | None = None,
               with_content: bool = True) -> DataFrame:
    """A1: recursive walk of a tree, all regular files, names starting with '.' or
    '_' included (Spark's own file sources skip these). Folders are listed level by
    level, each level's folders spread over tasks; bodies are read in tasks, and
    only with ``with_content``. ``root``: a plain path or a URI that pyarrow knows,
    reachable from the executors. Paths are relative to ``root`` with '/' separators.

    Returns corpus_id, path, mtime_ms, size[, content BINARY]."""
    level = spark.createDataFrame([("",)], "path string")
    found = spark.createDataFrame([], LISTED)
    while True:
        entries = materialize(level.repartition(spark.sparkContext.defaultParallelism, "path")
                              .mapInArrow(_list_folders(root), LISTED), "listing", force=True)
        found = found.unionByName(entries.where(~F.col("is_dir")))
        level = entries.where("is_dir").select("path")
        if level.isEmpty():
            break
    files = found.select("path", "mtime_ms", "size")
    if with_content:
        files = files.mapInArrow(_read_bodies(root), "path string, mtime_ms long, size long, content binary")
    return files.select(F.lit(corpus_id or root.rstrip("/")).alias("corpus_id"), T.normalize_path(F.col("path")).alias("path"),
                        *files.columns[1:])


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """``listing`` (path, ..) of files under ``root`` with their bytes as ``content``; a file that has
    vanished since it was listed is left out. Bodies are read in tasks, one at a time."""
    columns = listing.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema) + ", content binary"
    spread = listing.repartition("path")  # the walk's own tasks may hold very different numbers of changed files
    return spread.select(*columns).mapInArrow(_read_bodies(root), schema)


def snapshot(raw: DataFrame, counter: Column | None = None) -> DataFrame:
    """Normalized content, SHA-256, token count and line count.

    ``counter`` maps the ``content`` column to a BIGINT token count; the default
    is the byte proxy (see :func:`corpusflow.functions.text.proxy_tokens`); a real
    tokenizer plugs in as a pandas UDF (:mod:`corpusflow.functions.tokens`)."""
    df = raw.withColumn("content", T.normalize_text(F.col("content")))
    tok = T.proxy_tokens("content") if counter is None else counter
    return (df.withColumn("hash", T.content_hash("content"))
              .withColumn("tokens", tok.cast("bigint"))
              .withColumn("n_lines", T.line_count("content")))


def scan_listing(listing: DataFrame, raw_files: DataFrame,
                 reserved: Iterable[str] = O.RESERVED_PREFIXES) -> DataFrame:
    """A2: an exported listing (corpus_id, line) of tracked plus untracked paths.
    Lines are trimmed, blanks and the state directory dropped, duplicates
    removed; listed paths missing on disk are skipped by the inner join."""
    paths = listing.select("corpus_id", F.trim(F.col("line")).alias("path")).where(F.col("path") != "")
    paths = exclude_reserved(paths, reserved, anywhere=False).dropDuplicates(["corpus_id", "path"])
    return raw_files.join(paths, ["corpus_id", "path"], "left_semi")


def allow_table(spark: SparkSession, entries: Iterable[str] = O.DEFAULT_ALLOW_LIST) -> DataFrame:
    """A fixed allow-list as a one-column table (ext), lower-cased and distinct."""
    rows = sorted({e.lower() for e in entries})
    return spark.createDataFrame([(e,) for e in rows], "ext string")


def filter_extensions(files: DataFrame, allow: DataFrame) -> DataFrame:
    """A3: keep a path whose lower-cased last extension is allowed.

    ``allow`` is either (ext) - one global list - or (corpus_id, ext) per corpus;
    the planner broadcasts it when its measured size is under the threshold. Entries
    are lower-cased too, so mixed-case entries match (a deliberate fix)."""
    f = files.withColumn("_ext", T.extension("path"))
    if "corpus_id" in allow.columns:
        a = allow.select("corpus_id", F.lower("ext").alias("_ext")).distinct()
        return f.join(a, ["corpus_id", "_ext"], "left_semi").drop("_ext")
    a = allow.select(F.lower("ext").alias("_ext")).distinct()
    return f.join(a, "_ext", "left_semi").drop("_ext")


def exclude_reserved(files: DataFrame, prefixes: Iterable[str] = O.RESERVED_PREFIXES,
                     anywhere: bool = False) -> DataFrame:
    """A5: drop the engine's own state directory. Listing mode tests the top
    level only; walk mode (``anywhere=True``) any depth."""
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.startswith(F.col("path"), F.lit(p))
        if anywhere:
            cond = cond | F.contains(F.col("path"), F.lit("/" + p))
    return files.where(~cond)


def resolve_allow_list(corpus_conf: DataFrame, defaults: Iterable[str] = O.DEFAULT_ALLOW_LIST,
                       env_list: str | None = None) -> DataFrame:
    """Effective allow-list per corpus.

    ``corpus_conf``: corpus_id, config_json (project configuration text, may be
    NULL or malformed). The global list is ``env_list`` (comma separated) when
    given, else ``defaults``. A project list keeps only string entries with a
    leading dot; if none remain it is ignored. ``ext_whitelist_override`` true
    replaces the global list, otherwise the distinct union keeps first-occurrence
    order. Returns corpus_id, allow (array<string>), override, n_exts."""
    glob = [s.strip() for s in env_list.split(",") if s.strip()] if env_list else list(defaults)
    g = F.array(*[F.lit(x) for x in glob])
    v = F.try_parse_json(F.col("config_json"))
    wl = F.try_variant_get(v, "$.ext_whitelist", "array<variant>")
    strs = F.transform(F.filter(wl, lambda x: F.schema_of_variant(x) == "STRING"),
                       lambda x: F.variant_get(x, "$", "string"))
    valid = F.filter(strs, lambda x: F.startswith(x, F.lit(".")))
    ov = F.when(F.try_variant_get(v, "$.ext_whitelist_override", "variant").isNotNull()
                & (F.schema_of_variant(F.try_variant_get(v, "$.ext_whitelist_override", "variant")) == "BOOLEAN"),
                F.try_variant_get(v, "$.ext_whitelist_override", "boolean")).otherwise(F.lit(False))
    has = F.coalesce(F.size(valid), F.lit(0)) > 0
    allow = (F.when(has & ov, valid).when(has, F.array_distinct(F.concat(g, valid))).otherwise(g))
    out = corpus_conf.select("corpus_id", allow.alias("allow"), (has & ov).alias("override"))
    return out.withColumn("n_exts", F.size("allow").cast("bigint"))


def explode_allow_list(allow_lists: DataFrame) -> DataFrame:
    """(corpus_id, allow) to (corpus_id, ext, ord) rows for :func:`filter_extensions`."""
    return allow_lists.select("corpus_id", F.posexplode("allow").alias("ord", "ext"))
