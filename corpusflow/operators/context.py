"""Context assembly (D7-D10, B7-B9, J1): the texts a request is built from.

What a shard is shown is a table of ordered rows, a block per file (:func:`base_blocks`,
:func:`change_blocks`); requests stream them, so no task holds a shard's text. Where the
text itself is the result (a stored base), :func:`base_context` builds it by an ordered
string aggregation per shard; a shard that cannot be split further (a single directory
of direct files over budget) is flagged ``oversize`` instead of being truncated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.functions import text as T
from corpusflow.operators.changes import ADDED, DELETED, MODIFIED, status_rank
from corpusflow.operators.joins import block_join, salted_join
from corpusflow.operators.order import ranked

# Our own instruction wording for the first message of every request.
SINGLE_INSTRUCTIONS = (
    "You are a code retrieval assistant. The next messages hold every source file of a "
    "code base (numbered lines), possibly followed by updates, then a question. Read the "
    "files, find the code most relevant to the question, and answer only by calling "
    "report_search_results with {\"results\": [{\"file\", \"start_line\", \"end_line\"}]}, most "
    "relevant first, 1-based inclusive line numbers, whole definitions. If nothing is "
    "relevant, call it with an empty results array."
)
SHARDED_INSTRUCTIONS = (
    "You are a code retrieval assistant. The next messages hold one shard (a directory "
    "subset) of a code base (numbered lines), possibly followed by updates, then a "
    "question. Most shards hold nothing relevant to a given question; an empty answer is "
    "normal. Answer only by calling report_search_results with {\"results\": [{\"file\", "
    "\"start_line\", \"end_line\"}]}, most relevant first, 1-based inclusive line numbers, "
    "only for files present in this shard. If nothing is relevant, call it with an empty "
    "results array."
)


def _ordered_join(text: Column, sep: str, *order: Column) -> Column:
    """Aggregate expression: ``text`` values joined by ``sep`` in ``order``."""
    s = F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order)], text.alias("_t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["_t"]), sep)


def file_blocks(files: DataFrame, tag: Column | None = None) -> DataFrame:
    """B7 as a column: adds ``block`` (header + numbered lines)."""
    return files.withColumn("block", T.render_file("path", "content", "n_lines", tag))


#: Parts of what a request's shard is shown, in order.
BASE, CHANGE, TREE = 1, 2, 3


def without_excluded(files: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """``files`` but those that ``excluded`` (corpus_id, path) names: read as updates, so not shown twice."""
    if excluded is None:
        return files
    return files.join(excluded.select("corpus_id", "path").distinct(), ["corpus_id", "path"], "left_anti")


def base_blocks(shard_files: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """D7 as rows: (corpus_id, shard_id, part, ord, path, block), a row per file, oldest commit first by
    (ord, path). Whoever needs them in order sorts within partitions; no text of a shard is built."""
    f = file_blocks(without_excluded(shard_files, excluded))
    return f.select("corpus_id", "shard_id", F.lit(BASE).alias("part"), F.col("commit_time").cast("bigint").alias("ord"), "path", "block")


def change_blocks(changes: DataFrame, files: DataFrame) -> DataFrame:
    """D8 as rows like :func:`base_blocks`: updated files (modified, then added), then markers of deleted ones."""
    ch = changes.where(F.col("status").isin(MODIFIED, ADDED, DELETED)).select("corpus_id", "shard_id", "path", "status")
    live = files.select("corpus_id", "path", "content", "n_lines")
    shown = ch.where(F.col("status") != DELETED).join(live, ["corpus_id", "path"])
    shown = shown.withColumn("block", T.render_file("path", "content", "n_lines", F.lit(O.TAG_UPDATED)))
    gone = ch.where(F.col("status") == DELETED).withColumn("block", T.deleted_marker("path"))
    out = shown.drop("content", "n_lines").unionByName(gone)
    return out.select("corpus_id", "shard_id", F.lit(CHANGE).alias("part"), status_rank("status").cast("bigint").alias("ord"), "path", "block")


def stored_blocks(base_shards: DataFrame) -> DataFrame:
    """A stored base text (corpus_id, shard_id, base_text) as the one base block of its shard."""
    return base_shards.select("corpus_id", "shard_id", F.lit(BASE).alias("part"), F.lit(0).cast("bigint").alias("ord"),
                              F.lit("").alias("path"), F.coalesce("base_text", F.lit("")).alias("block"))


def base_context(shard_files: DataFrame, keys: Sequence[str] = ("corpus_id", "shard_id"),
                 budget: int | None = None, shard_tokens: DataFrame | None = None,
                 excluded: DataFrame | None = None) -> DataFrame:
    """All file blocks of a shard, oldest commit first (ties by path),
    separated by a blank line.

    ``shard_files``: keys + path, content, n_lines, tokens, commit_time.
    Returns keys + base_text, base_token_count, n_files, oversize.

    Shards are bounded by the budget except those that cannot be split (one
    directory of direct files); ``oversize`` flags them, and their text is
    assembled like any other: it is one message of one model call, so some task
    has to hold it, and only the model's own answer says that it is too long.
    ``shard_tokens`` (keys + tokens, n_files), when the plan already has them,
    saves a second pass over the content-bearing rows. Files of ``excluded`` are left out."""
    k = list(keys)
    shard_files = without_excluded(shard_files, excluded)
    if shard_tokens is not None:
        sizes = shard_tokens.select(*k, F.col("tokens").cast("bigint").alias("base_token_count"),
                                    F.col("n_files").cast("bigint").alias("n_files"))
    else:
        sizes = shard_files.groupBy(*k).agg(F.sum("tokens").cast("bigint").alias("base_token_count"),
                                            F.count(F.lit(1)).cast("bigint").alias("n_files"))
    text = file_blocks(shard_files).groupBy(*k).agg(
        _ordered_join(F.col("block"), "\n\n", F.col("commit_time"), F.col("path")).alias("base_text"))
    agg = sizes.join(text, k, "left").select(*k, "base_text", "base_token_count", "n_files")
    over = F.lit(False) if budget is None else F.col("base_token_count") > F.lit(budget)
    return agg.withColumn("oversize", over)


def change_context(changes: DataFrame, files: DataFrame,
                   keys: Sequence[str] = ("corpus_id", "shard_id")) -> DataFrame:
    """UPDATED blocks (modified, then added, each by path), then DELETED
    markers. Shards without changes get no row (the delta message is omitted).

    ``changes``: keys + path, status; ``files``: current files (corpus_id, path,
    content, n_lines). Returns keys + change_text, n_changes."""
    ch = changes.where(F.col("status").isin(MODIFIED, ADDED, DELETED))
    live = files.select("corpus_id", "path", "content", "n_lines")
    j = ch.join(live, ["corpus_id", "path"], "left")
    block = F.when(F.col("status") == DELETED, T.deleted_marker("path")) \
             .otherwise(T.render_file("path", "content", "n_lines", F.lit(O.TAG_UPDATED)))
    j = j.where((F.col("status") == DELETED) | F.col("content").isNotNull())
    return j.groupBy(*keys).agg(
        _ordered_join(block, "\n\n", status_rank("status"), F.col("path")).alias("change_text"),
        F.count(F.lit(1)).cast("bigint").alias("n_changes"))


def _dir_and_name(df: DataFrame) -> DataFrame:
    return df.withColumn("dir", T.dir_of("path")).withColumn("name", T.base_name("path"))


#: Directories of a corpus whose lines travel as one row into the trees of its shards.
PAGE = 256
#: A tree row's ``ord`` is its directory's rank in the corpus times ``_STEP`` plus the row's kind.
_STEP = 4
_HEAD, _NAME, _MORE = 0, 1, 2


def _ord(rank, kind: int) -> Column:
    return (F.col(rank) if isinstance(rank, str) else rank).cast("bigint") * _STEP + kind


def _ranked_directories(entries: DataFrame) -> DataFrame:
    """The directories of each corpus with their files and their ``rank`` by name."""
    dirs = entries.groupBy("corpus_id", "dir").agg(F.count(F.lit(1)).alias("_total"))
    return ranked(dirs, ["corpus_id"], [F.col("dir")], "rank")


def _name_line(status: Column | None = None) -> Column:
    line = F.concat(F.lit("  "), F.col("name"))
    return line if status is None else F.concat(line, T.tree_status(status))


def _tree_entries(files: DataFrame, changes: DataFrame | None) -> DataFrame:
    """(corpus_id, path, status, dir, name) of the files of a tree, deleted ones included."""
    f = files.select("corpus_id", "path", F.lit(None).cast("string").alias("status"))
    if changes is not None:
        st = changes.select("corpus_id", "path", "status").where(F.col("status").isin(MODIFIED, ADDED, DELETED))
        live = f.drop("status").join(st.where(F.col("status") != DELETED), ["corpus_id", "path"], "left")
        f = live.unionByName(st.where(F.col("status") == DELETED))
    return _dir_and_name(f)


def tree_rows(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """D9, B9, F2 as rows (corpus_id, part, ord, path, block), a row per directory and file; in order of
    (ord, path) they are the corpus's tree: sorted directories, each with its sorted file names and change
    labels (deleted files in their directory). Neither a directory nor a corpus is held by a task."""
    entries = _tree_entries(files, changes)
    dirs = _ranked_directories(entries)
    heads = dirs.select("corpus_id", _ord("rank", _HEAD).alias("ord"), F.lit("").alias("path"),
                        F.concat("dir", F.lit("/")).alias("block"))
    names = salted_join(entries, dirs, ["corpus_id", "dir"]).select(
        "corpus_id", _ord("rank", _NAME).alias("ord"), "path", _name_line(F.col("status")).alias("block"))
    return heads.unionByName(names).select("corpus_id", F.lit(TREE).alias("part"), "ord", "path", "block")


def tree_text(rows: DataFrame, keys: Sequence[str] = ("corpus_id",)) -> DataFrame:
    """The rows of each tree as one text, for readers that want it whole. Returns keys + tree, n_dirs
    (directories with a row of their own)."""
    return rows.groupBy(*keys).agg(_ordered_join(F.col("block"), "\n", F.col("ord"), F.col("path")).alias("tree"),
                                   F.count_if(F.col("ord") % _STEP == _HEAD).cast("bigint").alias("n_dirs"))


def directory_tree(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """D9 as one text per corpus: :func:`tree_rows` joined. Returns corpus_id, tree, n_dirs."""
    return tree_text(tree_rows(files, changes))


def shard_tree_rows(files: DataFrame, shard_files: DataFrame) -> DataFrame:
    """D10 as rows (corpus_id, shard_id, part, ord, path, block): in order of (ord, path) a shard's tree
    lists every directory of the corpus; own files by name, other files only as counts (``N files, other
    shards`` for a directory without own files, ``(N more files, other shards)`` after own names).

    Two ordered streams are merged by the rank of their directories: the corpus's own, kept as pages of
    ``PAGE`` lines, and the shard's entries. Where a shard has nothing, a page (or what lies between two of
    its directories there) is one row, so no row per shard and directory of others is made."""
    sk = ["corpus_id", "shard_id"]
    dirs = _ranked_directories(_dir_and_name(files.select("corpus_id", "path")))
    page = F.floor((F.col("rank") - 1) / PAGE).cast("bigint")
    dirs = dirs.withColumn("page", page)
    other_line = F.format_string(O.FMT_OTHER_SHARDS_DIR, F.col("dir"), F.col("_total").cast("string"))
    pages = dirs.groupBy("corpus_id", "page").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", other_line.alias("line")))), lambda x: x["line"]).alias("lines"))

    own = _dir_and_name(shard_files.select(*sk, "path"))
    own_dirs = own.groupBy(*sk, "dir").agg(F.count(F.lit(1)).alias("_own")).join(dirs, ["corpus_id", "dir"])
    others = F.col("_total") - F.col("_own")
    heads = own_dirs.select(*sk, _ord("rank", _HEAD).alias("ord"), F.lit("").alias("path"),
                            F.concat("dir", F.lit("/")).alias("block"))
    more = own_dirs.where(others > 0).select(*sk, _ord("rank", _MORE).alias("ord"), F.lit("").alias("path"),
                                             F.format_string(O.FMT_OTHER_SHARDS_MORE, others.cast("string")).alias("block"))
    names = salted_join(own, own_dirs.select(*sk, "dir", "rank"), [*sk, "dir"]).select(
        *sk, _ord("rank", _NAME).alias("ord"), "path", _name_line().alias("block"))

    holes = own_dirs.groupBy(*sk, "page").agg(F.sort_array(F.collect_list("rank")).alias("holes"))
    shards = own.select(*sk).distinct()
    shown = block_join(shards, pages.select("corpus_id", "page"), ["corpus_id"], "shard_id", "page")
    shown = shown.join(holes, [*sk, "page"], "left").join(pages, ["corpus_id", "page"])
    first = F.col("page") * PAGE + 1
    ends = F.coalesce("holes", F.array().cast("array<bigint>"))
    runs = F.arrays_zip(F.concat(F.array(first), F.transform(ends, lambda r: r + 1)).alias("start"),
                        F.concat(ends, F.array(first + F.size("lines"))).alias("stop"))
    shown = shown.select(*sk, "page", "lines", F.explode(runs).alias("run")).where("run.start < run.stop")
    lines = F.slice("lines", (F.col("run.start") - first + 1).cast("int"), (F.col("run.stop") - F.col("run.start")).cast("int"))
    rest = shown.select(*sk, _ord(F.col("run.start"), _HEAD).alias("ord"), F.lit("").alias("path"),
                        F.array_join(lines, "\n").alias("block"))
    rows = heads.unionByName(names).unionByName(more).unionByName(rest)
    return rows.select(*sk, F.lit(TREE).alias("part"), "ord", "path", "block")


def shard_directory_tree(files: DataFrame, shard_files: DataFrame) -> DataFrame:
    """D10 as one text per shard: :func:`shard_tree_rows` joined. Returns corpus_id, shard_id, tree."""
    return tree_text(shard_tree_rows(files, shard_files), ["corpus_id", "shard_id"]).drop("n_dirs")


def query_turns(request_shards: DataFrame, trees: DataFrame) -> DataFrame:
    """The last message of each (request, shard).

    ``request_shards``: query_id, corpus_id, shard_id, n_shards (NULL for the
    single-shard path), query, scope, file_types; ``trees``: corpus_id, shard_id, tree."""
    j = request_shards.join(trees, ["corpus_id", "shard_id"], "left")
    sharded = F.when(F.col("n_shards").isNotNull(), F.col("shard_id"))
    return j.withColumn("query_turn", T.render_query_turn("tree", "query", "scope", "file_types",
                                                          sharded, "n_shards"))


def assemble_messages(request_shards: DataFrame, contexts: DataFrame, turns: DataFrame) -> DataFrame:
    """Message rows (query_id, corpus_id, shard_id, turn, role, content).

    Shard-level turns (instructions, base text, delta) are emitted once per
    shard with query_id NULL and referenced by shard key; only the query turn is
    per request. ``contexts``: corpus_id, shard_id, sharded, base_text, change_text."""
    instr = F.when(F.col("sharded"), F.lit(SHARDED_INSTRUCTIONS)).otherwise(F.lit(SINGLE_INSTRUCTIONS))
    delta = F.when(F.coalesce(F.col("change_text"), F.lit("")) != "", F.col("change_text"))
    # one pass over the contexts: the shard-level turns come out of one exploded array
    parts = F.array(F.struct(F.lit(0).alias("turn"), instr.alias("content")),
                    F.struct(F.lit(1).alias("turn"), F.coalesce("base_text", F.lit("")).alias("content")),
                    F.struct(F.lit(2).alias("turn"), delta.alias("content")))
    shard_rows = (contexts.select("corpus_id", "shard_id", F.explode(parts).alias("m"))
                  .select("corpus_id", "shard_id", "m.turn", "m.content")
                  .where((F.col("turn") != 2) | F.col("content").isNotNull())
                  .withColumn("query_id", F.lit(None).cast("bigint")))
    q = turns.select("query_id", "corpus_id", "shard_id", F.lit(3).alias("turn"),
                     F.col("query_turn").alias("content"))
    return shard_rows.unionByName(q).withColumn("role", F.lit("user"))
