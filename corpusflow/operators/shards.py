"""Directory-aligned sharding under a token budget.

The recursive split (group by next segment; keep a group that fits; keep a
direct-child group or a directory without subdirectories even when too large;
otherwise recurse) has a closed form, because the token sum of a directory
never grows with depth:

* a directory prefix ``p`` is *acceptable* when ``tokens(p) <= budget`` or no
  file lies deeper than its direct children;
* acceptability is monotone along a path (once acceptable, every deeper
  ancestor of the same file is acceptable too), so a file belongs to its
  **shallowest acceptable ancestor** below the group's parent prefix;
* a file without one belongs to the direct-child shard (``__root__``) of its
  deepest directory.

So planning is: explode ancestors (depth-bounded fan-out), one aggregation per
prefix, a left join of the per-prefix verdict, one aggregation per file. There
is no recursion, no driver loop, and every shuffle is keyed by corpus plus a
finer key (prefix or path); a hot corpus or top-level directory is absorbed by
partial aggregation and by AQE's skew-join split.

Inputs: a ``files`` DataFrame with at least ``corpus_id, path, tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.operators.joins import salted_join
from corpusflow.operators.order import ranked
from corpusflow.session import materialize

#: Rank of the orphan group: after every stored shard.
_ORPHAN_RANK = 1 << 40
_ORPHAN_GRP = "\u0000orphans"
_FRESH_GRP = "\u0000fresh"


def _segments(path, parent):
    rel = F.substring(path, F.length(parent) + 1, 1 << 30)
    return F.split(rel, "/")


def _prefix_at(parent, segs, level):
    return F.concat(parent, F.array_join(F.slice(segs, F.lit(1), level), "/"), F.lit("/"))


def explode_ancestors(files: DataFrame, parent=None, keep=("corpus_id", "path", "tokens"),
                      with_self: bool = False) -> DataFrame:
    """One row per (file, directory ancestor strictly below ``parent``):
    adds ``level`` (1 = first directory below parent), ``prefix`` ('a/b/') and
    ``n_dirs`` (directories between parent and the file). ``with_self`` adds a
    level-0 row whose prefix is the parent itself."""
    par = F.lit("") if parent is None else (F.col(parent) if isinstance(parent, str) else parent)
    segs = _segments(F.col("path"), par)
    nd = (F.size(segs) - 1).cast("int")
    base = files.select(*keep, par.alias("_parent"), segs.alias("_segs"), nd.alias("n_dirs"))
    exploded = base.select(*[c for c in base.columns],
                           F.explode(F.sequence(F.lit(0), F.col("n_dirs")) if with_self else
                                     F.when(F.col("n_dirs") > 0, F.sequence(F.lit(1), F.col("n_dirs"))))
                           .alias("level"))
    return exploded.withColumn("prefix", _prefix_at(F.col("_parent"), F.col("_segs"), F.col("level"))) \
                   .drop("_segs", "_parent")


def directory_rollup(files: DataFrame) -> DataFrame:
    """D3: token and file totals per (corpus, directory prefix), with the
    ``deeper`` flag (some file lies below a subdirectory of the prefix)."""
    anc = explode_ancestors(files)
    return (anc.groupBy("corpus_id", "prefix")
            .agg(F.sum("tokens").cast("bigint").alias("tokens"),
                 F.count(F.lit(1)).cast("bigint").alias("n_files"),
                 F.min("level").alias("depth"),
                 (F.max("n_dirs") > F.min("level")).alias("deeper")))


def split_groups(groups: DataFrame, budget: int) -> DataFrame:
    """Closed-form ``splitLevel`` applied to many groups at once.

    ``groups``: corpus_id, grp, grp_rank, parent, path, tokens. Each (corpus_id,
    grp) is split independently below its ``parent`` prefix.
    Returns corpus_id, grp_rank, path, tokens, shard_id, prefix.

    Every file also gets a level-0 row (its group's parent), never acceptable,
    so direct children of the parent flow through the same aggregation."""
    keep = ("corpus_id", "grp", "grp_rank", "parent", "path", "tokens")
    anc = explode_ancestors(groups, parent="parent", keep=keep, with_self=True)
    ok = (anc.where(F.col("level") > 0).groupBy("corpus_id", "grp", "prefix")
          .agg(F.sum("tokens").alias("_tok"), F.max("n_dirs").alias("_maxd"), F.min("level").alias("_lvl"))
          .where((F.col("_tok") <= F.lit(budget)) | (F.col("_maxd") <= F.col("_lvl")))
          .select("corpus_id", "grp", "prefix", F.col("_lvl").alias("ok_level")))
    # acceptability is monotone along a path, so a file's shard is its one ancestor that
    # is acceptable while its parent is not: keep only those roots (about one per shard)
    up = F.when(F.col("ok_level") > 1, F.regexp_replace("prefix", r"[^/]*/$", ""))
    with_up = ok.withColumn("_up", up)
    parents = ok.select("corpus_id", "grp", F.col("prefix").alias("_up"))
    roots = with_up.join(parents, ["corpus_id", "grp", "_up"], "left_anti").drop("_up")
    rows = (salted_join(anc, roots, ["corpus_id", "grp", "prefix"], how="left")
            .groupBy("corpus_id", "grp", "path")
            .agg(F.max("ok_level").alias("ok_level"), F.max("n_dirs").alias("n_dirs"),
                 F.first("tokens").alias("tokens"), F.first("parent").alias("parent"),
                 F.first("grp_rank").alias("grp_rank")))
    segs = _segments(F.col("path"), F.col("parent"))
    prefix = (F.when(F.col("ok_level").isNotNull(), _prefix_at(F.col("parent"), segs, F.col("ok_level")))
              .when(F.col("n_dirs") == 0, F.col("parent"))
              .otherwise(_prefix_at(F.col("parent"), segs, F.col("n_dirs"))))
    rows = rows.withColumn("prefix", prefix)
    shard_id = F.when(F.col("ok_level").isNotNull(), F.expr("substring(prefix, 1, length(prefix) - 1)")) \
                .otherwise(F.concat(F.col("prefix"), F.lit(O.ROOT_SHARD)))
    return rows.select("corpus_id", "grp_rank", "path", "tokens", shard_id.alias("shard_id"), "prefix")


def _check_reserved_dirs(files: DataFrame) -> DataFrame:
    """A directory really named ``__root__`` would clash with the direct-child
    marker; fail with a clear error instead of producing ambiguous shard ids."""
    segs = F.split("path", "/")
    dirs = F.slice(segs, F.lit(1), F.size(segs) - 1)
    bad = F.array_contains(dirs, O.ROOT_SHARD)
    return files.withColumn("path", F.when(bad, F.raise_error(F.concat(
        F.lit("a directory named __root__ is reserved: "), F.col("path")))).otherwise(F.col("path")))


def _finish(assigned: DataFrame) -> DataFrame:
    """Attach shard_ord: stored group rank, then least path inside the group.

    The assignment (narrow rows) is written once: ranking and attaching the
    rank both read it, and otherwise the whole split would run twice."""
    assigned = materialize(assigned, "assigned")
    key = (assigned.groupBy("corpus_id", "shard_id")
           .agg(F.min("grp_rank").alias("_r"), F.min("path").alias("_p")))
    ords = ranked(key, ["corpus_id"], [F.col("_r"), F.col("_p")], "shard_ord").select(
        "corpus_id", "shard_id", F.col("shard_ord").cast("int").alias("shard_ord"))
    return salted_join(assigned, ords, ["corpus_id", "shard_id"]).select(
        "corpus_id", "shard_id", "prefix", "shard_ord", "path", "tokens")


def plan_shards(files: DataFrame, budget: int) -> DataFrame:
    """Fresh plan. Returns shard_files (corpus_id, shard_id, prefix, shard_ord, path, tokens).

    A corpus whose total fits is one ``__all__`` shard; otherwise it is split from
    the empty prefix.

    The narrow (corpus_id, path, tokens) projection is written once: the plan
    reads it three times, and recomputing an unmaterialized snapshot would
    re-read and re-hash file contents each time."""
    f = materialize(_check_reserved_dirs(files.select("corpus_id", "path", F.col("tokens").cast("bigint")
                                                      .alias("tokens"))), "plan_input")
    totals = f.groupBy("corpus_id").agg(F.sum("tokens").alias("_total"))
    g = salted_join(f, totals, ["corpus_id"])
    fits = g.where(F.col("_total") <= F.lit(budget)).select(
        "corpus_id", F.lit(0).cast("long").alias("grp_rank"), "path", "tokens",
        F.lit(O.ALL_SHARD).alias("shard_id"), F.lit("").alias("prefix"))
    to_split = g.where(F.col("_total") > F.lit(budget)).select(
        "corpus_id", F.lit(_FRESH_GRP).alias("grp"), F.lit(0).cast("long").alias("grp_rank"),
        F.lit("").alias("parent"), "path", "tokens")
    return _finish(fits.unionByName(split_groups(to_split, budget)))


def stored_claim_order(stored_plan: DataFrame) -> DataFrame:
    """stored shards by prefix length (longest first), then stored order."""
    stored = stored_plan.select("corpus_id", "shard_id", "prefix", "shard_ord")
    order = [F.length("prefix").desc(), F.col("shard_ord"), F.col("shard_id")]
    return ranked(stored, ["corpus_id"], order, "claim_rank").drop("shard_ord")


def claim_files(files: DataFrame, stored_plan: DataFrame) -> DataFrame:
    """C4: each file goes to the stored shard with the longest matching prefix
    (ties by stored order). The empty prefix matches every file for ``__all__``
    and only top-level files for any other id. Equi-join on exploded ancestors,
    never a theta join. Returns corpus_id, path, tokens, shard_id, prefix, claim_rank."""
    order = stored_claim_order(stored_plan)
    f = files.select("corpus_id", "path", F.col("tokens").cast("bigint").alias("tokens"))
    anc = explode_ancestors(f).select("corpus_id", "path", "tokens", "n_dirs", "prefix")
    dirs = anc.join(order.where(F.col("prefix") != ""), ["corpus_id", "prefix"])
    # every file is a candidate of the empty prefix, a corpus-wide hot key: salt it
    top = f.select("corpus_id", "path", "tokens", (F.size(F.split("path", "/")) - 1).cast("int").alias("n_dirs"))
    roots = order.where(F.col("prefix") == "").select("corpus_id", "shard_id", "claim_rank")
    tops = salted_join(top, roots, ["corpus_id"]).withColumn("prefix", F.lit("")) \
        .where((F.col("shard_id") == O.ALL_SHARD) | (F.col("n_dirs") == 0))
    cand = dirs.unionByName(tops)
    best = cand.groupBy("corpus_id", "path").agg(
        F.min_by(F.struct("shard_id", "prefix", "claim_rank", "tokens"), F.col("claim_rank")).alias("c"))
    return best.select("corpus_id", "path", "c.tokens", "c.shard_id", "c.prefix", "c.claim_rank")


def orphan_files(files: DataFrame, stored_plan: DataFrame) -> DataFrame:
    """Files that no stored shard claims."""
    claimed = claim_files(files, stored_plan).select("corpus_id", "path")
    return files.join(claimed, ["corpus_id", "path"], "left_anti")


def resolve_plan(files: DataFrame, stored_plan: DataFrame, budget: int) -> DataFrame:
    """Incremental replanning.

    Claimed groups that fit keep their stored (id, prefix); those that do not are
    split below their prefix; orphans are split from the empty prefix; shards
    without files vanish. Corpora without a stored plan get a fresh plan.
    Returns shard_files like :func:`plan_shards`. Inputs are cut from their
    lineage first (narrow rows only), so generations of plans never compound."""
    f = materialize(_check_reserved_dirs(files.select("corpus_id", "path", F.col("tokens").cast("bigint")
                                                      .alias("tokens"))), "plan_input")
    stored_plan = materialize(stored_plan.select("corpus_id", "shard_id", "prefix", "shard_ord"), "stored_plan")
    if stored_plan.isEmpty():  # cold start: nothing to claim
        return plan_shards(f, budget)
    planned = stored_plan.select("corpus_id").distinct()
    fresh = plan_shards(f.join(planned, "corpus_id", "left_anti"), budget)
    mine = f.join(planned, "corpus_id", "left_semi")
    # four consumers below: compute the claim (an exploded join) once
    claimed = materialize(claim_files(mine, stored_plan), "claimed")
    gtok = claimed.groupBy("corpus_id", "shard_id").agg(F.sum("tokens").alias("_gt"))
    claimed = salted_join(claimed, gtok, ["corpus_id", "shard_id"])
    keep = claimed.where(F.col("_gt") <= F.lit(budget)).select(
        "corpus_id", F.col("claim_rank").alias("grp_rank"), "path", "tokens", "shard_id", "prefix")
    over = claimed.where(F.col("_gt") > F.lit(budget)).select(
        "corpus_id", F.col("shard_id").alias("grp"), F.col("claim_rank").alias("grp_rank"),
        F.col("prefix").alias("parent"), "path", "tokens")
    orphans = mine.join(claimed.select("corpus_id", "path"), ["corpus_id", "path"], "left_anti").select(
        "corpus_id", F.lit(_ORPHAN_GRP).alias("grp"), F.lit(_ORPHAN_RANK).cast("long").alias("grp_rank"),
        F.lit("").alias("parent"), "path", "tokens")
    resolved = _finish(keep.unionByName(split_groups(over.unionByName(orphans), budget)))
    return resolved.unionByName(fresh)


def plan_table(shard_files: DataFrame) -> DataFrame:
    """Per-shard rollup (D1 per shard): corpus_id, shard_id, prefix, shard_ord, n_files, tokens."""
    return (shard_files.groupBy("corpus_id", "shard_id", "prefix", "shard_ord")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_files"),
                 F.sum("tokens").cast("bigint").alias("tokens")))


def _hash_sorted_lines(batches):
    """Streams (corpus_id, line) rows sorted by corpus then line through one
    incremental SHA-256 per corpus (constant memory)."""
    import hashlib

    import pandas as pd
    cur, h, n, first = None, None, 0, True
    out = []
    for pdf in batches:
        for cid, line in zip(pdf["corpus_id"], pdf["line"]):
            if cid != cur:
                if cur is not None:
                    out.append((cur, h.hexdigest()[:16], n))
                cur, h, n, first = cid, hashlib.sha256(), 0, True
            h.update((line if first else "\n" + line).encode("utf-8"))
            first = False
            n += 1
        if len(out) > 1000:
            yield pd.DataFrame(out, columns=["corpus_id", "plan_hash", "n_shards"])
            out = []
    if cur is not None:
        out.append((cur, h.hexdigest()[:16], n))
    yield pd.DataFrame(out, columns=["corpus_id", "plan_hash", "n_shards"])


def plan_hash(plan: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted ``id:prefix`` lines of a
    corpus plan, joined by newlines.

    Exact and streaming: lines are hash-partitioned by corpus, sorted inside
    the partition (Spark's external sort), and fed to an incremental SHA-256,
    so no corpus's lines are ever held together in memory."""
    lines = plan.select("corpus_id", F.concat("shard_id", F.lit(":"), "prefix").alias("line")).distinct()
    spark = plan.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(n, "corpus_id").sortWithinPartitions("corpus_id", "line")
    out = ordered.mapInPandas(_hash_sorted_lines, "corpus_id string, plan_hash string, n_shards long")
    return out.withColumn("n_shards", F.col("n_shards").cast("bigint"))


def new_shards(plan: DataFrame, stored_plan: DataFrame) -> DataFrame:
    """Shards whose id has no stored counterpart (hence no base)."""
    return plan.join(stored_plan.select("corpus_id", "shard_id"), ["corpus_id", "shard_id"], "left_anti")


def restrict_to_shard(files: DataFrame, shard_files: DataFrame) -> DataFrame:
    """The files of each shard, with the shard key attached."""
    return files.join(shard_files.select("corpus_id", "path", "shard_id", "shard_ord"), ["corpus_id", "path"])
