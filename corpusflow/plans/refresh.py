"""Refresh - plan, change decision and new state, without any query.

One pass over the snapshot: the resolved plan (D5), per-shard changes against
the stored bases (C1), the change ratio (D2) and the rebuild decision; rebuilt
shards get a new base (D7, D13); the state is upserted (A9), pruned to the
active plan (A11) and written as a new version together with the plan (A10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.operators import changes as C
from corpusflow.operators import context as X
from corpusflow.operators import shards as S
from corpusflow.session import materialize
from corpusflow.sources import commit_log as CL
from corpusflow.sources import manifest as M
from corpusflow.sources import state as ST
from corpusflow.sources import store as STORE


def refresh_decisions(files: DataFrame, stored_plan: DataFrame, base_shards: DataFrame,
                      base_files: DataFrame, budget: int, threshold: float = O.DEFAULT_CHANGE_THRESHOLD,
                      shard_files: DataFrame | None = None) -> DataFrame:
    """Per shard of the resolved plan: tokens, n_files, is_new (no base),
    change_ratio (NULL when new) and needs_rebuild (new, or ratio > threshold)."""
    sf = shard_files if shard_files is not None else S.resolve_plan(files, stored_plan, budget)
    cur = S.restrict_to_shard(files.select("corpus_id", "path", "hash", "tokens"), sf.drop("tokens"))
    ch = C.detect_changes(cur, base_files.select("corpus_id", "shard_id", "path", "hash"))
    summ = C.change_summary(ch, base_shards, threshold)
    plan = S.plan_table(sf)
    d = plan.join(summ.select("corpus_id", "shard_id", "change_ratio", "needs_rebuild"),
                  ["corpus_id", "shard_id"], "left")
    is_new = F.col("change_ratio").isNull()
    return d.withColumn("is_new", is_new).withColumn("needs_rebuild", is_new | F.col("needs_rebuild"))


#: Times that a refresh starts again because another writer replaced one of its corpora.
TRIES = 5


def refresh(files: DataFrame, state_root: str, budget: int = O.DEFAULT_MAX_CONTEXT_TOKENS,
            threshold: float = O.DEFAULT_CHANGE_THRESHOLD, snapshot_ts: int = 0,
            commit_times: DataFrame | None = None, mark: str | None = None,
            texts: Callable[[DataFrame], DataFrame] | None = None,
            corpora: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run J8 against the state under ``state_root`` and write the next version.

    ``files``: full snapshots of the corpora to refresh (corpus_id, path, hash, tokens,
    n_lines[, content, mtime_ms, ..]). Plans and changes read no text; only files of rebuilt
    shards get theirs, from ``files`` or by ``texts``, which adds ``content`` to such rows
    (see :func:`refresh_store`). State of corpora absent from ``files`` is neither read nor
    written; ``corpora`` (corpus_id) names those to refresh if some may have no file left.
    ``mark``: a name that the version is committed with (see ``state.has_mark``). If
    another writer replaces one of the corpora meanwhile, the refresh starts again
    from the new state. Returns the decisions and the version."""
    corpora = files.select("corpus_id").distinct() if corpora is None else corpora
    # the snapshot feeds five consumers: cut its lineage once, without the texts
    snap = materialize(files.drop("content"), "snapshot")
    if texts is None:
        bodies = files.select("corpus_id", "path", "content")
        texts = lambda rows: rows.join(bodies, ["corpus_id", "path"])
    for left in reversed(range(TRIES)):
        try:
            return _refresh(snap, corpora, texts, state_root, budget, threshold, snapshot_ts, commit_times, mark)
        except M.Conflict:
            if not left or (mark is not None and ST.has_mark(files.sparkSession, state_root, mark)):
                raise


def _refresh(snap, corpora, texts, state_root, budget, threshold, snapshot_ts, commit_times, mark):
    spark = snap.sparkSession
    seen = M.read(spark, state_root)

    def touched(table):
        return ST.read_state(spark, state_root, table, seen).join(corpora, "corpus_id", "left_semi")

    stored, old_shards, old_files = map(touched, ("shard_plan", "base_shards", "base_files"))
    sf = materialize(S.resolve_plan(snap, stored.select("corpus_id", "shard_id", "prefix", "shard_ord"), budget),
                     "shard_files")
    dec = materialize(refresh_decisions(snap, stored, old_shards, old_files, budget, threshold, shard_files=sf),
                      "decisions")
    timed = CL.attach_commit_time(snap, commit_times) if commit_times is not None else \
        snap.withColumn("commit_time", F.floor(F.col("mtime_ms") / 1000).cast("bigint")
                        if "mtime_ms" in snap.columns else F.lit(0).cast("bigint"))
    rebuild = dec.where(F.col("needs_rebuild")).select("corpus_id", "shard_id")
    members = S.restrict_to_shard(timed, sf.drop("tokens")).join(rebuild, ["corpus_id", "shard_id"], "left_semi")
    ctx = X.base_context(texts(members), budget=budget,
                         shard_tokens=dec.where(F.col("needs_rebuild")).select("corpus_id", "shard_id", "tokens",
                                                                               "n_files"))
    new_shards, new_files = ST.base_record(members, ctx, dec, rebuild, snapshot_ts)  # no model answer to wait for
    won_shards, won_files = ST.upsert_base(old_shards, new_shards, old_files, new_files)
    won_shards, won_files = ST.prune_base(won_shards, dec), ST.prune_base(won_files, dec)
    hashes = S.plan_hash(dec)
    plan_rows = dec.select("corpus_id", "shard_id", "prefix", "shard_ord").join(hashes.select("corpus_id", "plan_hash"),
                                                                               "corpus_id") \
                   .withColumn("snapshot_ts", F.lit(snapshot_ts).cast("bigint"))
    version = ST.write_state(state_root, won_shards, won_files, plan_rows, mark, corpora, seen)
    return {"decisions": dec, "version": version, "plan": plan_rows}


def refresh_store(listing: DataFrame, read_bodies: Callable[[DataFrame], DataFrame], store_root: str, state_root: str,
                  **options) -> dict[str, DataFrame]:
    """J8 on an incremental snapshot (A1, C2): bodies of changed files are read once into the store, and
    texts are looked up there for rebuilt shards only. ``options`` as for :func:`refresh`."""
    rows = STORE.snapshot(listing, read_bodies, store_root)
    out = refresh(rows, state_root, texts=lambda members: STORE.with_content(members, store_root), **options)
    return {**out, "rows": rows}
