"""Search - the whole request pipeline for a table of requests.

Stages (each a Spark job boundary where marked):

1. plan: fresh (D4) or resolved against the stored plan (D5); materialized.
2. decision and blocks per shard: those of its files (D7), or the stored base
   text and the updates since (D8); trees (D10, or D9 for one-shard corpora).
3. fan-out with scope pruning (C10) and the model calls (J2); materialized
   once, because the calls are not repeatable.
4. answers: parse (I1-I3), own-file filter (C8), de-duplication (E3),
   normalization (J6), range merging (E1, E5), snippets (C11), outcome (D14)
   and text (J5); usage per request (D12).
5. new bases for shards that were rebuilt and answered (D13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.operators import changes as C
from corpusflow.operators import context as X
from corpusflow.operators import hits as H
from corpusflow.operators import requests as R
from corpusflow.operators import shards as S
from corpusflow.operators import usage as U
from corpusflow.operators.joins import salted_join
from corpusflow.session import materialize
from corpusflow.sources import manifest as M
from corpusflow.sources import state as ST


def search(requests: DataFrame, files: DataFrame, responder: R.Responder, budget: int = O.DEFAULT_MAX_CONTEXT_TOKENS,
           threshold: float = O.DEFAULT_CHANGE_THRESHOLD, stored_plan: DataFrame | None = None,
           base_shards: DataFrame | None = None, base_files: DataFrame | None = None,
           snapshot_ts: int = 0, max_attempts: int = O.MAX_ATTEMPTS,
           requests_per_group: int = 64, state_root: str | None = None, sleep: bool = True) -> dict[str, DataFrame]:
    """``requests``: query_id, corpus_id, query, scope, file_types.
    ``files``: corpus_id, path, content, hash, tokens, n_lines[, commit_time].
    Returns answers (query_id, text, is_error, n_ok, n_failed, n_results) and the
    intermediate tables (plan, responses, ranges, usage, new bases).

    With ``state_root`` the stored plan and bases are read from there (unless
    given) and the next state version is written after the answers: the new
    plan always, new bases only for rebuilt shards that answered (newest wins),
    bases of shards no longer planned dropped; corpora not in ``files`` keep
    their state, and if another writer replaced one meanwhile, that one's stays."""
    from corpusflow.plans.refresh import refresh_decisions
    spark = files.sparkSession
    seen = None
    if state_root is not None:
        seen = M.read(spark, state_root)
        corpora = files.select("corpus_id").distinct()
        if stored_plan is None:
            stored_plan = ST.read_state(spark, state_root, "shard_plan", seen) \
                .select("corpus_id", "shard_id", "prefix", "shard_ord").join(corpora, "corpus_id", "left_semi")
        if base_shards is None:
            base_shards = ST.read_state(spark, state_root, "base_shards", seen).join(corpora, "corpus_id", "left_semi")
        if base_files is None:
            base_files = ST.read_state(spark, state_root, "base_files", seen).join(corpora, "corpus_id", "left_semi")
    if "commit_time" not in files.columns:
        mtime = F.floor(F.col("mtime_ms") / 1000) if "mtime_ms" in files.columns else F.lit(0)
        files = files.withColumn("commit_time", mtime.cast("bigint"))
    # about seven consumers read the snapshot: compute it once (a plain table scan is kept as is)
    files = materialize(files, "snapshot")
    if stored_plan is None:
        stored_plan = spark.createDataFrame([], "corpus_id string, shard_id string, prefix string, shard_ord int")
    if base_shards is None:
        base_shards = spark.createDataFrame([], ST.BASE_SHARDS_SCHEMA)
    if base_files is None:
        base_files = spark.createDataFrame([], ST.BASE_FILES_SCHEMA)

    sf = materialize(S.resolve_plan(files, stored_plan, budget), "shard_files")
    dec = refresh_decisions(files, stored_plan, base_shards, base_files, budget, threshold, shard_files=sf)
    dec = materialize(dec, "decisions")
    members = S.restrict_to_shard(files, sf.drop("tokens"))

    rebuild = dec.where(F.col("needs_rebuild")).select("corpus_id", "shard_id")
    rebuilt = members.join(rebuild, ["corpus_id", "shard_id"], "left_semi")
    reuse = dec.where(~F.col("needs_rebuild")).select("corpus_id", "shard_id")
    cur = members.select("corpus_id", "shard_id", "path", "hash", "tokens")
    # narrow, read by the change blocks and the tree labels
    ch = materialize(C.detect_changes(cur, base_files.select("corpus_id", "shard_id", "path", "hash"))
                     .join(reuse, ["corpus_id", "shard_id"], "left_semi"), "changes")
    kept = base_shards.join(reuse, ["corpus_id", "shard_id"], "left_semi")
    blocks = X.base_blocks(rebuilt).unionByName(X.stored_blocks(kept)).unionByName(X.change_blocks(ch, files))

    single = dec.where(F.col("shard_id") == O.ALL_SHARD).select("corpus_id", "shard_id")
    single_files = files.join(single.select("corpus_id"), "corpus_id", "left_semi")
    labels = ch.join(single, ["corpus_id", "shard_id"], "left_semi")
    single_tree = salted_join(X.tree_rows(single_files, labels), single, ["corpus_id"])
    multi_sf = sf.where(F.col("shard_id") != O.ALL_SHARD)
    trees = X.shard_tree_rows(files.join(multi_sf.select("corpus_id").distinct(), "corpus_id", "left_semi"),
                              multi_sf).unionByName(single_tree)

    plan = dec.select("corpus_id", "shard_id", "prefix", "shard_ord")
    rs = R.prune_by_scope(requests, plan)
    responses = materialize(R.run_requests(rs, blocks, trees, responder, max_attempts, requests_per_group, sleep),
                            "responses", force=True)
    # an answer that I1 can't read is an error, not an empty result
    unread = F.col("arguments").isNotNull() & F.try_parse_json("arguments").isNull()
    responses = responses.withColumn("error", F.coalesce("error", F.when(
        unread, F.format_string(O.FMT_PARSE_FAILURE, F.substring("arguments", 1, 200)))))

    parsed = H.parse_arguments(responses.where(F.col("error").isNull()))
    hits = H.explode_hits(parsed)
    own = H.hits_in_shard(hits.where(F.col("shard_id") != O.ALL_SHARD), sf) \
        .unionByName(hits.where(F.col("shard_id") == O.ALL_SHARD))
    # narrow hit tables with several consumers each: computed once
    dd = materialize(H.dedupe_hits(own), "hits")
    n_merged = dd.groupBy("query_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_results"))
    ranges = materialize(H.coalesce_ranges(H.normalize_hits(dd, files)), "ranges")
    snips = H.cut_snippets(ranges, files)
    resp_rows = responses.join(plan.select("corpus_id", "shard_id", "prefix"), ["corpus_id", "shard_id"], "left")
    outcome = H.outcome_summary(resp_rows)
    answers = H.render_outcome(outcome, n_merged, snips)
    usage = U.usage_summary(responses, ["query_id"])
    ok = responses.where(F.col("error").isNull()).select("corpus_id", "shard_id").distinct()
    # texts are built only here, for bases that are kept
    rebuild_tokens = dec.where(F.col("needs_rebuild")).select("corpus_id", "shard_id", "tokens", "n_files")
    fresh = X.base_context(rebuilt.join(ok, ["corpus_id", "shard_id"], "left_semi"), budget=budget, shard_tokens=rebuild_tokens)
    new_shards, new_files = ST.base_record(members, fresh, dec, ok, snapshot_ts)
    if state_root is not None:
        _save_state(state_root, files, dec, base_shards, base_files, new_shards, new_files, snapshot_ts, seen)
    return {"answers": answers, "plan": dec, "responses": responses, "ranges": ranges, "usage": usage,
            "new_base_shards": new_shards, "new_base_files": new_files}


def _save_state(state_root, files, dec, old_shards, old_files, new_shards, new_files, snapshot_ts, seen):
    """A9 upsert, A11 prune, A10 plan write, as one new state version of these corpora."""
    corpora = files.select("corpus_id").distinct()
    won_shards, won_files = ST.upsert_base(old_shards, new_shards, old_files, new_files)
    won_shards, won_files = ST.prune_base(won_shards, dec), ST.prune_base(won_files, dec)
    hashes = S.plan_hash(dec)
    plan_rows = dec.select("corpus_id", "shard_id", "prefix", "shard_ord") \
        .join(hashes.select("corpus_id", "plan_hash"), "corpus_id") \
        .withColumn("snapshot_ts", F.lit(snapshot_ts).cast("bigint"))
    try:
        ST.write_state(state_root, won_shards, won_files, plan_rows, corpora=corpora, seen=seen)
    except M.Conflict:
        pass  # another search or refresh of the corpus was first; its state is as good a base for the next
