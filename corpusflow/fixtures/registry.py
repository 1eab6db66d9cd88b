"""Checked queries: each name pairs a Spark job (``spark_fn(spark, sf_dir)``)
with its DuckDB twin (SQL over the driver tables), or with ``None`` where only a
rows check plus our own pytest applies.

Every Spark job reads the driver tables through :mod:`corpusflow.fixtures.views`
and runs the library operators over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.fixtures import duck as D
from corpusflow.fixtures import views as V
from corpusflow.fixtures import responders as RS
from corpusflow.functions import text as T
from corpusflow.operators import changes as C
from corpusflow.operators import context as X
from corpusflow.operators import hits as H
from corpusflow.operators import requests as R
from corpusflow.operators import shards as S
from corpusflow.operators import usage as U
from corpusflow.sources import commit_log as CL
from corpusflow.sources import files as SF
from corpusflow.sources import ignore as IG
from corpusflow.session import run_dir
from corpusflow.sources import state as ST
from corpusflow.sources import store as STORE

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _hash_bytes(col: str, prefix: str):
    return [F.sha2(F.col(col), 256).alias(f"{prefix}_hash"), F.octet_length(col).cast("bigint").alias(f"{prefix}_bytes")]


def _hb_sql(expr: str, prefix: str) -> str:
    return f"sha256({expr}) AS {prefix}_hash, CAST(strlen({expr}) AS BIGINT) AS {prefix}_bytes"


# ============================================================================
# A / B: sources and scalar functions
# ============================================================================

@query("file_metrics", D.with_(D.files_cte("files")) +
       "SELECT corpus_id, path, hash, tokens, n_lines, size FROM files")
def file_metrics(spark, sf):
    """B1, B2, B3, B6 (counts)."""
    return V.files(spark, sf).select("corpus_id", "path", "hash", "tokens", "n_lines", "size")


@query("allowed_files", D.with_(D.files_cte("files")) +
       f"SELECT corpus_id, path, {D.extension()} AS ext FROM files "
       f"WHERE {D.extension()} IN (SELECT DISTINCT lower(unnest({D.allow_list_sql()})))")
def allowed_files(spark, sf):
    """A3 with the default allow-list."""
    kept = SF.filter_extensions(V.files(spark, sf), SF.allow_table(spark))
    return kept.select("corpus_id", "path", T.extension("path").alias("ext"))


@query("path_parts", D.with_(D.page_files_cte()) +
       f"""SELECT corpus_id, path, {D.dir_of()} AS dir, {D.base_name()} AS name, {D.extension()} AS ext,
       CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth,
       CASE WHEN strpos(path, '/') = 0 THEN '__root__' ELSE split_part(path, '/', 1) END AS top_segment,
       replace({D.dir_of()}, '/', '__') AS dir_key,
       path AS normalized
       FROM page_files""")
def path_parts(spark, sf):
    """B4, B5, B11, A12 over page paths (normalized from a './' + backslash form)."""
    p = V.page_files(spark, sf)
    messy = F.concat(F.lit("./"), F.replace(F.col("path"), F.lit("/"), F.lit("\\")))
    return p.select("corpus_id", "path", T.dir_of("path").alias("dir"), T.base_name("path").alias("name"),
                    T.extension("path").alias("ext"), T.dir_depth("path").alias("depth"),
                    T.next_segment("path", F.lit("")).alias("top_segment"),
                    T.state_key(T.dir_of("path")).alias("dir_key"),
                    T.normalize_path(messy).alias("normalized"))


_RES = ("CASE WHEN doc_id % 7 = 0 THEN '.corpusflow/' || path WHEN doc_id % 7 = 1 THEN 'x/.corpusflow/' || path "
        "ELSE path END")


@query("reserved_files", D.with_(D.files_cte("files")) +
       f"""SELECT corpus_id, p AS path, NOT (p LIKE '%/.corpusflow/%') AS kept_walk
       FROM (SELECT corpus_id, {_RES} AS p FROM files) WHERE NOT starts_with(p, '.corpusflow/')""")
def reserved_files(spark, sf):
    """A5: listing mode drops top-level state paths; walk mode any depth."""
    f = V.files(spark, sf)
    did = F.col("doc_id")
    p = (F.when(did % 7 == 0, F.concat(F.lit(".corpusflow/"), "path"))
         .when(did % 7 == 1, F.concat(F.lit("x/.corpusflow/"), "path")).otherwise(F.col("path")))
    f = f.select("corpus_id", p.alias("path"))
    listing = SF.exclude_reserved(f, anywhere=False)
    walk = SF.exclude_reserved(f, anywhere=True).select("corpus_id", "path", F.lit(True).alias("kept_walk"))
    return listing.join(walk, ["corpus_id", "path"], "left").select(
        "corpus_id", "path", F.coalesce("kept_walk", F.lit(False)).alias("kept_walk"))


_CONF = {
    "en": '{"ext_whitelist": [".md", "txt", 5, ".py"], "ext_whitelist_override": false}',
    "fr": '{"ext_whitelist": [".md", ".PY"], "ext_whitelist_override": true}',
    "de": '{"ext_whitelist": [',
    "es": '{"ext_whitelist": ["txt"], "ext_whitelist_override": true}',
}


def _conf_col():
    c = F.lit(None).cast("string")
    for k, v in reversed(list(_CONF.items())):
        c = F.when(F.col("corpus_id") == k, F.lit(v)).otherwise(c)
    return c


def _conf_sql():
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CONF.items())
    return f"CASE corpus_id {whens} ELSE NULL END"


def _allow_sql():
    g = D.allow_list_sql()
    j = "try(json(cfg))"
    arr = f"CASE WHEN json_type({j}, '$.ext_whitelist') = 'ARRAY' THEN json_extract({j}, '$.ext_whitelist[*]') END"
    valid = (f"list_transform(list_filter({arr}, lambda x: json_type(x) = 'VARCHAR' "
             f"AND starts_with(json_extract_string(x, '$'), '.')), lambda x: json_extract_string(x, '$'))")
    ov = f"coalesce(json_type({j}, '$.ext_whitelist_override') = 'BOOLEAN' AND CAST(json_extract({j}, '$.ext_whitelist_override') AS BOOLEAN), FALSE)"
    return f"""cc AS (SELECT DISTINCT lang AS corpus_id FROM documents),
conf AS (SELECT corpus_id, {_conf_sql()} AS cfg FROM cc),
parsed AS (SELECT corpus_id, {valid} AS v, {ov} AS ov FROM conf),
dec AS (SELECT corpus_id, v, ov, coalesce(len(v), 0) > 0 AS has, list_concat({g}, v) AS u FROM parsed),
res AS (SELECT corpus_id, has AND ov AS override,
               CASE WHEN has AND ov THEN v WHEN has THEN list_filter(u, lambda x, i: list_position(u, x) = i) ELSE {g} END AS allow
        FROM dec)"""


@query("allow_lists", "WITH " + _allow_sql() +
       "\nSELECT corpus_id, allow_text, override, CAST(len(allow) AS BIGINT) AS n_exts FROM (SELECT *, array_to_string(allow, ',') AS allow_text FROM res)")
def allow_lists(spark, sf):
    """Per-corpus allow-lists from project configuration text."""
    corpora = V.table(spark, sf, "documents").select(F.col("lang").alias("corpus_id")).distinct()
    conf = corpora.select("corpus_id", _conf_col().alias("config_json"))
    r = SF.resolve_allow_list(conf)
    return r.select("corpus_id", F.array_join("allow", ",").alias("allow_text"), "override", "n_exts")


@query("corpus_allowed_files", "WITH " + _allow_sql() + ",\n" + D.files_cte("files") +
       f"""\nSELECT f.corpus_id, f.path FROM files f
       WHERE EXISTS (SELECT 1 FROM res r, unnest(r.allow) AS t(e) WHERE r.corpus_id = f.corpus_id AND lower(t.e) = {D.extension('f.path')})""")
def corpus_allowed_files(spark, sf):
    """A3 with per-corpus lists (A6 output, exploded)."""
    corpora = V.table(spark, sf, "documents").select(F.col("lang").alias("corpus_id")).distinct()
    allow = SF.explode_allow_list(SF.resolve_allow_list(corpora.select("corpus_id", _conf_col().alias("config_json"))))
    return SF.filter_extensions(V.files(spark, sf), allow).select("corpus_id", "path")


_IGNORE = ["src1/", "*.md", "!5.md", "p2", "!src3/p2/", "/src4/p0", "src5/**/*.ts", "**/p4/*.c",
           "# a comment", "", "src6/?0*", "!src6/p1/", "src7/p3/", "!src7/p3/17.py"]


@query("ignored_files", D.with_(D.files_cte("files"), D.ignore_rules_sql(_IGNORE)) +
       """, cand AS (
  SELECT corpus_id, path, array_to_string(list_slice(segs, 1, k), '/') AS cand, k < len(segs) AS is_dir
  FROM (SELECT corpus_id, path, segs, unnest(generate_series(1, len(segs))) AS k
        FROM (SELECT corpus_id, path, string_split(path, '/') AS segs FROM files))),
m AS (SELECT c.corpus_id, c.path, c.cand, arg_max(r.negated, r.ord) AS neg
      FROM cand c JOIN rules r ON regexp_full_match(c.cand, r.regex) AND (NOT r.dir_only OR c.is_dir)
      GROUP BY c.corpus_id, c.path, c.cand),
hit AS (SELECT corpus_id, path, min(cand) AS ignored_by FROM m WHERE NOT neg GROUP BY corpus_id, path)
SELECT f.corpus_id, f.path, h.ignored_by, h.ignored_by IS NOT NULL AS ignored
FROM files f LEFT JOIN hit h ON f.corpus_id = h.corpus_id AND f.path = h.path""")
def ignored_files(spark, sf):
    """A4: ignore rules with negation, anchoring, '**' and directory rules."""
    f = V.files(spark, sf)
    corpora = f.select("corpus_id").distinct()
    rules = corpora.select("corpus_id", F.posexplode(F.array(*[F.lit(p) for p in _IGNORE])).alias("ord", "pattern"))
    v = IG.ignore_verdicts(f, rules)
    return v.select("corpus_id", "path", "ignored_by", "ignored")


@query("commit_times", D.with_(D.commit_lines_cte(), D.commit_times_cte()) +
       "SELECT corpus_id, path, commit_time FROM commit_times")
def commit_times(spark, sf):
    """A7, E4."""
    return CL.parse_commit_log(V.commit_lines(spark, sf), chunk_lines=1000)


@query("file_times", D.with_(D.commit_lines_cte(), D.commit_times_cte(), D.log_files_cte()) +
       """SELECT corpus_id, path, commit_time,
       CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY commit_time, path) AS BIGINT) AS time_rank
       FROM (SELECT f.corpus_id, f.path, CAST(coalesce(c.commit_time, floor(f.mtime_ms / 1000), 0) AS BIGINT) AS commit_time
             FROM log_files f LEFT JOIN commit_times c ON f.corpus_id = c.corpus_id AND f.path = c.path)""")
def file_times(spark, sf):
    """Commit time, else mtime seconds, else 0; then oldest-first order."""
    from pyspark.sql import Window
    ct = CL.parse_commit_log(V.commit_lines(spark, sf))
    f = CL.attach_commit_time(V.log_files(spark, sf), ct)
    w = Window.partitionBy("corpus_id").orderBy("commit_time", "path")
    return f.select("corpus_id", "path", "commit_time", F.row_number().over(w).cast("bigint").alias("time_rank"))


@query("reused_metadata", D.with_(D.files_cte("files_v1", "v1"), D.files_cte("files_v2", "v2")) +
       """SELECT n.corpus_id, n.path, coalesce(o.hash, n.hash) AS hash, coalesce(o.tokens, n.tokens) AS tokens,
       coalesce(o.n_lines, n.n_lines) AS n_lines, o.path IS NOT NULL AS reused
       FROM files_v2 n LEFT JOIN files_v1 o ON n.corpus_id = o.corpus_id AND n.path = o.path
            AND n.mtime_ms = o.mtime_ms AND n.size = o.size""")
def reused_metadata(spark, sf):
    """Metadata reuse by (mtime, size)."""
    raw = V.files(spark, sf, "v2").select("corpus_id", "path", "mtime_ms", "size", "content")
    cache = V.files(spark, sf, "v1")
    return C.reuse_metadata(raw, cache).select("corpus_id", "path", "hash", "tokens", "n_lines", "reused")


@query("incremental_snapshot", D.with_(D.files_cte("files_v1", "v1"), D.files_cte("files_v2", "v2")) +
       """SELECT n.corpus_id, n.path, n.mtime_ms, n.size, coalesce(o.hash, n.hash) AS hash, coalesce(o.tokens, n.tokens) AS tokens,
       coalesce(o.n_lines, n.n_lines) AS n_lines, o.path IS NOT NULL AS reused, sha256(coalesce(o.content, n.content)) AS text_hash
       FROM files_v2 n LEFT JOIN files_v1 o ON n.corpus_id = o.corpus_id AND n.path = o.path
            AND n.mtime_ms = o.mtime_ms AND n.size = o.size""")
def incremental_snapshot(spark, sf):
    """A snapshot of files_v2 over a store that holds files_v1; texts looked up by the rows' folders."""
    root = f"{run_dir(spark)}/store-{uuid.uuid4().hex}"
    for version in ("v1", "v2"):
        f = V.files(spark, sf, version)
        texts = f.select("corpus_id", "path", "content")
        rows = STORE.snapshot(f.select("corpus_id", "path", "mtime_ms", "size"), lambda m, t=texts: m.join(t, ["corpus_id", "path"]), root)
    return STORE.with_content(rows, root).select("corpus_id", "path", "mtime_ms", "size", "hash", "tokens", "n_lines", "reused",
                                                 F.sha2("content", 256).alias("text_hash"))


# ============================================================================
# C / D: changes
# ============================================================================

_CHANGES = """changes AS (
  SELECT coalesce(n.corpus_id, o.corpus_id) AS corpus_id, '__all__' AS shard_id, coalesce(n.path, o.path) AS path,
         CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added'
              WHEN n.hash <> o.hash THEN 'modified' ELSE 'unchanged' END AS status, n.tokens
  FROM files_v2 n FULL OUTER JOIN files_v1 o ON n.corpus_id = o.corpus_id AND n.path = o.path)"""
_V12 = [D.files_cte("files_v1", "v1"), D.files_cte("files_v2", "v2")]


def _corpus_changes(spark, sf):
    from corpusflow.session import materialize
    cur = V.files(spark, sf, "v2").withColumn("shard_id", F.lit(O.ALL_SHARD))
    base = V.files(spark, sf, "v1").withColumn("shard_id", F.lit(O.ALL_SHARD))
    return cur, base, materialize(C.detect_changes(cur, base), "changes")


@query("changes", D.with_(*_V12, _CHANGES) + "SELECT corpus_id, shard_id, path, status, tokens FROM changes")
def changes(spark, sf):
    """C1 at corpus level (single-shard path)."""
    return _corpus_changes(spark, sf)[2]


_THRESH = 0.15


@query("change_summary", D.with_(*_V12, _CHANGES) + f"""
SELECT b.corpus_id, '__all__' AS shard_id, b.base_tokens,
       CAST(coalesce(c.change_tokens, 0) AS BIGINT) AS change_tokens,
       CAST(coalesce(c.n_modified, 0) AS BIGINT) AS n_modified, CAST(coalesce(c.n_added, 0) AS BIGINT) AS n_added,
       CAST(coalesce(c.n_deleted, 0) AS BIGINT) AS n_deleted,
       CASE WHEN b.base_tokens > 0 THEN coalesce(c.change_tokens, 0) / b.base_tokens ELSE 1.0 END AS change_ratio,
       (CASE WHEN b.base_tokens > 0 THEN coalesce(c.change_tokens, 0) / b.base_tokens ELSE 1.0 END) > {_THRESH} AS needs_rebuild
FROM (SELECT corpus_id, CAST(sum(tokens) AS BIGINT) AS base_tokens FROM files_v1 GROUP BY corpus_id) b
LEFT JOIN (SELECT corpus_id, sum(CASE WHEN status IN ('modified', 'added') THEN tokens ELSE 0 END) AS change_tokens,
                  count(*) FILTER (WHERE status = 'modified') AS n_modified, count(*) FILTER (WHERE status = 'added') AS n_added,
                  count(*) FILTER (WHERE status = 'deleted') AS n_deleted
           FROM changes GROUP BY corpus_id) c ON b.corpus_id = c.corpus_id""")
def change_summary(spark, sf):
    """Change ratio per corpus against the base token total."""
    cur, base, ch = _corpus_changes(spark, sf)
    bs = C.sum_tokens(base, ["corpus_id", "shard_id"]).withColumnRenamed("tokens", "base_token_count")
    s = C.change_summary(ch, bs, _THRESH)
    return s.select("corpus_id", "shard_id", "base_tokens", "change_tokens", "n_modified", "n_added",
                    "n_deleted", "change_ratio", "needs_rebuild")


@query("change_sets", D.with_(*_V12) + """
SELECT corpus_id, path, 'added' AS change_set FROM (SELECT corpus_id, path FROM files_v2 EXCEPT SELECT corpus_id, path FROM files_v1)
UNION ALL
SELECT corpus_id, path, 'deleted' FROM (SELECT corpus_id, path FROM files_v1 EXCEPT SELECT corpus_id, path FROM files_v2)""")
def change_sets(spark, sf):
    """added and deleted path sets."""
    return C.change_sets(V.files(spark, sf, "v2"), V.files(spark, sf, "v1"))


@query("change_context", D.with_(*_V12, _CHANGES) + f"""
SELECT corpus_id, shard_id, sha256(t) AS text_hash, CAST(strlen(t) AS BIGINT) AS text_bytes, n_changes
FROM (SELECT c.corpus_id, c.shard_id,
             string_agg(CASE WHEN c.status = 'deleted' THEN '--- ' || c.path || ' [DELETED] ---'
                             ELSE {D.render_file('f.path', 'f.content', 'f.n_lines', 'UPDATED')} END, {D.NL2}
                        ORDER BY CASE c.status WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, c.path) AS t,
             CAST(count(*) AS BIGINT) AS n_changes
      FROM changes c LEFT JOIN files_v2 f ON c.corpus_id = f.corpus_id AND c.path = f.path
      WHERE c.status <> 'unchanged' GROUP BY c.corpus_id, c.shard_id)""")
def change_context(spark, sf):
    """UPDATED blocks then DELETED markers."""
    cur, base, ch = _corpus_changes(spark, sf)
    cc = X.change_context(ch, cur)
    return cc.select("corpus_id", "shard_id", *_hash_bytes("change_text", "text"), "n_changes")


# ============================================================================
# D / C: shard planning
# ============================================================================

_F = [D.files_cte("files")]


@query("dir_rollup", D.with_(*_F) + """
SELECT corpus_id, prefix, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS n_files,
       min(lvl) AS depth, max(nd) > min(lvl) AS deeper
FROM (SELECT corpus_id, tokens, nd, lvl, array_to_string(list_slice(segs, 1, lvl), '/') || '/' AS prefix
      FROM (SELECT corpus_id, tokens, segs, len(segs) - 1 AS nd, CAST(unnest(generate_series(1, len(segs) - 1)) AS INTEGER) AS lvl
            FROM (SELECT corpus_id, tokens, string_split(path, '/') AS segs FROM files)))
GROUP BY corpus_id, prefix""")
def dir_rollup(spark, sf):
    """D3."""
    return S.directory_rollup(V.files(spark, sf))


def _plan_query(name, budget, src="files", pages=False):
    cte = D.page_files_cte() if pages else D.files_cte("files")
    src = "page_files" if pages else "files"

    @query(name, D.with_(cte, D.plan_ctes("sp", src, budget)) + D.plan_table_sql("sp"))
    def fn(spark, sf):
        f = V.page_files(spark, sf) if pages else V.files(spark, sf)
        return S.plan_table(S.plan_shards(f, budget))
    fn.__doc__ = f"D4, D1: fresh plan at budget {budget}."
    return fn


_plan_query("shard_plan", 4000)
_plan_query("shard_plan_small", 1500)
_plan_query("shard_plan_large", 90000)
_plan_query("page_shard_plan", 3000, pages=True)


@query("shard_files", D.with_(*_F, D.plan_ctes("sp", "files", 1500)) +
       "SELECT corpus_id, shard_id, shard_ord, path, tokens FROM sp")
def shard_files(spark, sf):
    """File-to-shard assignment."""
    sfi = S.plan_shards(V.files(spark, sf), 1500)
    return S.restrict_to_shard(V.files(spark, sf), sfi).select("corpus_id", "shard_id", "shard_ord", "path", "tokens")


_STORED = D.stored_plan_ctes(4000)
_V2 = D.files_cte("files_v2", "v2")


@query("claimed", D.with_(*_STORED, _V2, D.claim_ctes("cl", "files_v2", "stored")) +
       "SELECT corpus_id, path, shard_id, prefix, claim_rank FROM cl")
def claimed(spark, sf):
    """Longest stored prefix claims each file."""
    c = S.claim_files(V.files(spark, sf, "v2"), V.stored_plan(spark, sf, 4000))
    return c.select("corpus_id", "path", "shard_id", "prefix", "claim_rank")


@query("orphans", D.with_(*_STORED, _V2, D.claim_ctes("cl", "files_v2", "stored")) +
       "SELECT corpus_id, path FROM files_v2 f ANTI JOIN cl USING (corpus_id, path)")
def orphans(spark, sf):
    """C5."""
    return S.orphan_files(V.files(spark, sf, "v2"), V.stored_plan(spark, sf, 4000)).select("corpus_id", "path")


def _resolved_query(name, budget):
    @query(name, D.with_(*_STORED, _V2, D.resolve_ctes("rp", "files_v2", "stored", budget)) + D.plan_table_sql("rp"))
    def fn(spark, sf):
        return S.plan_table(S.resolve_plan(V.files(spark, sf, "v2"), V.stored_plan(spark, sf, 4000), budget))
    fn.__doc__ = f"D5: resolve files_v2 against the stored plan at budget {budget}."
    return fn


_resolved_query("resolved_plan", 4000)
_resolved_query("resolved_plan_split", 2000)
_resolved_query("resolved_plan_grow", 90000)


@query("plan_hash", D.with_(*_F, D.plan_ctes("sp", "files", 4000)) + """
SELECT corpus_id, substr(sha256(array_to_string(list_sort(list(shard_id || ':' || prefix)), chr(10))), 1, 16) AS plan_hash,
       CAST(count(*) AS BIGINT) AS n_shards
FROM (SELECT DISTINCT corpus_id, shard_id, prefix FROM sp) GROUP BY corpus_id""")
def plan_hash(spark, sf):
    """D6."""
    return S.plan_hash(S.plan_table(S.plan_shards(V.files(spark, sf), 4000)))


@query("new_shards", D.with_(*_STORED, _V2, D.resolve_ctes("rp", "files_v2", "stored", 2000)) + """
SELECT DISTINCT corpus_id, shard_id, prefix FROM rp r
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.corpus_id = r.corpus_id AND s.shard_id = r.shard_id)""")
def new_shards(spark, sf):
    """C9."""
    plan = S.plan_table(S.resolve_plan(V.files(spark, sf, "v2"), V.stored_plan(spark, sf, 4000), 2000))
    return S.new_shards(plan, V.stored_plan(spark, sf, 4000)).select("corpus_id", "shard_id", "prefix")


@query("shard_changes", D.with_(*_STORED, _V2, D.resolve_ctes("rp", "files_v2", "stored", 4000)) + """
SELECT coalesce(n.corpus_id, o.corpus_id) AS corpus_id, coalesce(n.shard_id, o.shard_id) AS shard_id,
       coalesce(n.path, o.path) AS path,
       CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added'
            WHEN n.hash <> o.hash THEN 'modified' ELSE 'unchanged' END AS status
FROM (SELECT r.corpus_id, r.shard_id, r.path, f.hash FROM rp r JOIN files_v2 f USING (corpus_id, path)) n
FULL OUTER JOIN (SELECT p.corpus_id, p.shard_id, p.path, f.hash FROM plan_v1 p JOIN files_v1 f USING (corpus_id, path)) o
ON n.corpus_id = o.corpus_id AND n.shard_id = o.shard_id AND n.path = o.path""")
def shard_changes(spark, sf):
    """C1 per shard: resolved plan of files_v2 against the stored bases of files_v1."""
    v1, v2 = V.files(spark, sf, "v1"), V.files(spark, sf, "v2")
    stored = V.stored_plan(spark, sf, 4000)
    cur = S.restrict_to_shard(v2, S.resolve_plan(v2, stored, 4000))
    base = S.restrict_to_shard(v1, S.plan_shards(v1, 4000))
    return C.detect_changes(cur, base).select("corpus_id", "shard_id", "path", "status")


# ============================================================================
# Contexts and trees
# ============================================================================

@query("base_context_hash", D.with_(*_F, D.plan_ctes("sp", "files", 4000)) + f"""
SELECT corpus_id, shard_id, sha256(t) AS text_hash, CAST(strlen(t) AS BIGINT) AS text_bytes, base_token_count, n_files
FROM (SELECT s.corpus_id, s.shard_id,
             string_agg({D.render_file('f.path', 'f.content', 'f.n_lines')}, {D.NL2}
                        ORDER BY CAST(floor(f.mtime_ms / 1000) AS BIGINT), f.path) AS t,
             CAST(sum(f.tokens) AS BIGINT) AS base_token_count, CAST(count(*) AS BIGINT) AS n_files
      FROM sp s JOIN files f ON s.corpus_id = f.corpus_id AND s.path = f.path
      GROUP BY s.corpus_id, s.shard_id)""")
def base_context_hash(spark, sf):
    """Shard base texts (oldest first, ties by path), as hash and size."""
    from corpusflow.session import materialize
    f = V.files(spark, sf)
    ct = CL.parse_commit_log(V.commit_lines(spark, sf))  # different corpora: every file falls back to mtime
    f = materialize(CL.attach_commit_time(f, ct), "timed_files")
    sfi = S.restrict_to_shard(f, S.plan_shards(f, 4000))
    bc = X.base_context(sfi, budget=4000)
    return bc.select("corpus_id", "shard_id", *_hash_bytes("base_text", "text"), "base_token_count", "n_files")


@query("base_blocks", D.with_(*_F, D.plan_ctes("sp", "files", 4000)) + f"""
SELECT s.corpus_id, s.shard_id, CAST(1 AS INTEGER) AS part, CAST(floor(f.mtime_ms / 1000) AS BIGINT) AS ord, s.path,
       sha256({D.render_file('f.path', 'f.content', 'f.n_lines')}) AS block_hash
FROM sp s JOIN files f ON s.corpus_id = f.corpus_id AND s.path = f.path WHERE f.doc_id % 7 <> 0""")
def base_blocks(spark, sf):
    """D7 as ordered rows, without the files that are read as updates."""
    f = V.files(spark, sf).withColumn("commit_time", F.floor(F.col("mtime_ms") / 1000))
    members = S.restrict_to_shard(f, S.plan_shards(f, 4000))
    b = X.base_blocks(members, excluded=f.where("doc_id % 7 = 0").select("corpus_id", "path"))
    return b.select("corpus_id", "shard_id", "part", "ord", "path", F.sha2("block", 256).alias("block_hash"))


@query("change_blocks", D.with_(*_V12, _CHANGES) + f"""
SELECT c.corpus_id, c.shard_id, CAST(2 AS INTEGER) AS part, CAST(CASE c.status WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END AS BIGINT) AS ord,
       c.path, sha256(CASE WHEN c.status = 'deleted' THEN '--- ' || c.path || ' [DELETED] ---'
                           ELSE {D.render_file('f.path', 'f.content', 'f.n_lines', 'UPDATED')} END) AS block_hash
FROM changes c LEFT JOIN files_v2 f ON c.corpus_id = f.corpus_id AND c.path = f.path WHERE c.status <> 'unchanged'""")
def change_blocks(spark, sf):
    """D8 as ordered rows."""
    cur, base, ch = _corpus_changes(spark, sf)
    return X.change_blocks(ch, cur).select("corpus_id", "shard_id", "part", "ord", "path", F.sha2("block", 256).alias("block_hash"))


@query("dir_tree", D.with_(*_V12, _CHANGES) + f"""
, ent AS (SELECT corpus_id, path, CASE WHEN status IN ('modified', 'added') THEN ' [CHANGED]'
                                      WHEN status = 'deleted' THEN ' [DELETED]' ELSE '' END AS label FROM changes),
d AS (SELECT corpus_id, {D.dir_of()} AS dir,
             string_agg('  ' || {D.base_name()} || label, chr(10) ORDER BY path) AS lines
      FROM ent GROUP BY corpus_id, {D.dir_of()}),
t AS (SELECT corpus_id, string_agg(dir || '/' || chr(10) || lines, chr(10) ORDER BY dir) AS tree,
             CAST(count(*) AS BIGINT) AS n_dirs FROM d GROUP BY corpus_id)
SELECT corpus_id, sha256(tree) AS tree_hash, CAST(strlen(tree) AS BIGINT) AS tree_bytes, n_dirs FROM t""")
def dir_tree(spark, sf):
    """Corpus trees with change labels (files_v2 against files_v1)."""
    cur, base, ch = _corpus_changes(spark, sf)
    t = X.directory_tree(cur, ch)
    return t.select("corpus_id", *_hash_bytes("tree", "tree"), "n_dirs")


def _shard_tree_sql(plan_cte: str, src: str) -> str:
    return f"""
, tot AS (SELECT corpus_id, {D.dir_of()} AS dir, count(*) AS total FROM {src} GROUP BY ALL),
own AS (SELECT corpus_id, shard_id, {D.dir_of()} AS dir, string_agg('  ' || {D.base_name()}, chr(10) ORDER BY path) AS names,
               count(*) AS n_own FROM {plan_cte} GROUP BY ALL),
sh AS (SELECT DISTINCT corpus_id, shard_id FROM {plan_cte}),
grid AS (SELECT s.corpus_id, s.shard_id, t.dir, t.total, o.names, o.n_own
         FROM sh s JOIN tot t ON s.corpus_id = t.corpus_id
         LEFT JOIN own o ON o.corpus_id = s.corpus_id AND o.shard_id = s.shard_id AND o.dir = t.dir),
trees AS (SELECT corpus_id, shard_id, string_agg(
            CASE WHEN n_own IS NULL THEN dir || '/ (' || CAST(total AS VARCHAR) || ' files, other shards)'
                 ELSE dir || '/' || chr(10) || names ||
                      CASE WHEN total - n_own > 0 THEN chr(10) || '  (' || CAST(total - n_own AS VARCHAR) || ' more files, other shards)' ELSE '' END
            END, chr(10) ORDER BY dir) AS tree
          FROM grid GROUP BY corpus_id, shard_id)"""


@query("shard_tree", D.with_(*_F, D.plan_ctes("sp", "files", 4000)) + _shard_tree_sql("sp", "files") +
       "\nSELECT corpus_id, shard_id, sha256(tree) AS tree_hash, CAST(strlen(tree) AS BIGINT) AS tree_bytes FROM trees")
def shard_tree(spark, sf):
    """Per-shard trees, own files by name, others as counts."""
    f = V.files(spark, sf)
    t = X.shard_directory_tree(f, S.plan_shards(f, 4000))
    return t.select("corpus_id", "shard_id", *_hash_bytes("tree", "tree"))


@query("tree_rows", D.with_(*_V12, _CHANGES) + f"""
, ent AS (SELECT corpus_id, path, {D.dir_of()} AS dir, {D.base_name()} ||
                 CASE WHEN status IN ('modified', 'added') THEN ' [CHANGED]' WHEN status = 'deleted' THEN ' [DELETED]' ELSE '' END AS line
          FROM changes),
ranks AS (SELECT corpus_id, dir, row_number() OVER (PARTITION BY corpus_id ORDER BY dir) AS r FROM (SELECT DISTINCT corpus_id, dir FROM ent))
SELECT corpus_id, CAST(3 AS INTEGER) AS part, CAST(r * 4 AS BIGINT) AS ord, '' AS path, dir || '/' AS block FROM ranks
UNION ALL
SELECT e.corpus_id, CAST(3 AS INTEGER), CAST(r * 4 + 1 AS BIGINT), e.path, '  ' || e.line FROM ent e JOIN ranks k ON e.corpus_id = k.corpus_id AND e.dir = k.dir""")
def tree_rows(spark, sf):
    """D9 as ordered rows, with change labels (files_v2 against files_v1)."""
    cur, base, ch = _corpus_changes(spark, sf)
    return X.tree_rows(cur, ch)


@query("shard_tree_lines", D.with_(*_F, D.plan_ctes("sp", "files", 4000)) + f"""
, tot AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY dir) AS r FROM (
            SELECT corpus_id, {D.dir_of()} AS dir, count(*) AS total FROM files GROUP BY ALL)),
mine AS (SELECT corpus_id, shard_id, path, {D.dir_of()} AS dir, {D.base_name()} AS name FROM sp),
cnt AS (SELECT corpus_id, shard_id, dir, count(*) AS n_own FROM mine GROUP BY ALL),
grid AS (SELECT s.corpus_id, s.shard_id, t.dir, t.r, t.total, c.n_own FROM (SELECT DISTINCT corpus_id, shard_id FROM sp) s
         JOIN tot t ON s.corpus_id = t.corpus_id
         LEFT JOIN cnt c ON c.corpus_id = s.corpus_id AND c.shard_id = s.shard_id AND c.dir = t.dir)
SELECT corpus_id, shard_id, CAST(r * 4 AS BIGINT) AS ord, '' AS path,
       CASE WHEN n_own IS NULL THEN dir || '/ (' || CAST(total AS VARCHAR) || ' files, other shards)' ELSE dir || '/' END AS line FROM grid
UNION ALL
SELECT corpus_id, shard_id, CAST(r * 4 + 2 AS BIGINT), '', '  (' || CAST(total - n_own AS VARCHAR) || ' more files, other shards)'
FROM grid WHERE total > n_own
UNION ALL
SELECT m.corpus_id, m.shard_id, CAST(t.r * 4 + 1 AS BIGINT), m.path, '  ' || m.name FROM mine m JOIN tot t ON m.corpus_id = t.corpus_id AND m.dir = t.dir""")
def shard_tree_lines(spark, sf):
    """D10 as ordered rows; rows of several lines are taken apart, each line at its own directory's rank."""
    f = V.files(spark, sf)
    rows = X.shard_tree_rows(f, S.plan_shards(f, 4000))
    lines = rows.select("corpus_id", "shard_id", "ord", "path", F.posexplode(F.split("block", "\n")).alias("i", "line"))
    return lines.select("corpus_id", "shard_id", (F.col("ord") + F.col("i") * 4).cast("bigint").alias("ord"), "path", "line")


# ============================================================================
# requests
# ============================================================================

_PRUNE_SQL = """
, pl AS (SELECT DISTINCT corpus_id, shard_id, prefix, shard_ord FROM sp),
pn AS (SELECT corpus_id, CAST(count(*) AS BIGINT) AS n, bool_or(shard_id = '__all__') AS single FROM pl GROUP BY corpus_id),
rs AS (SELECT r.query_id, r.corpus_id, r.query, r.scope, r.file_types, p.shard_id, p.prefix, p.shard_ord,
              CASE WHEN NOT n.single THEN n.n END AS n_shards
       FROM requests r JOIN pl p ON r.corpus_id = p.corpus_id JOIN pn n ON n.corpus_id = p.corpus_id
       WHERE r.scope IS NULL OR r.scope = '' OR p.prefix = ''
          OR starts_with(CASE WHEN ends_with(r.scope, '/') THEN r.scope ELSE r.scope || '/' END, p.prefix)
          OR starts_with(p.prefix, CASE WHEN ends_with(r.scope, '/') THEN r.scope ELSE r.scope || '/' END))"""


@query("scope_pruned", D.with_(*_F, D.requests_cte(), D.plan_ctes("sp", "files", 4000)) + _PRUNE_SQL +
       "\nSELECT query_id, corpus_id, shard_id, shard_ord, n_shards FROM rs")
def scope_pruned(spark, sf):
    """Request x shard fan-out after scope pruning."""
    plan = S.plan_table(S.plan_shards(V.files(spark, sf), 4000))
    return R.prune_by_scope(V.requests(spark, sf), plan).select("query_id", "corpus_id", "shard_id", "shard_ord", "n_shards")


def _turn_sql():
    return """CASE WHEN n_shards IS NOT NULL THEN '[shard: ' || shard_id || ', ' || CAST(n_shards AS VARCHAR) || ' shards in all]' || chr(10) || chr(10) ELSE '' END
  || 'Directory tree:' || chr(10) || coalesce(tree, '') || chr(10) || chr(10)
  || CASE WHEN scope IS NOT NULL AND scope <> '' THEN 'Search scope: ' || scope || chr(10) ELSE '' END
  || CASE WHEN coalesce(len(file_types), 0) > 0 THEN 'File types: ' || array_to_string(file_types, ', ') || chr(10) ELSE '' END
  || chr(10) || 'Query: ' || query"""


@query("query_turns", D.with_(*_F, D.requests_cte(), D.plan_ctes("sp", "files", 4000)) + _PRUNE_SQL +
       _shard_tree_sql("sp", "files") + f"""
SELECT query_id, corpus_id, shard_id, sha256(turn) AS turn_hash, CAST(strlen(turn) AS BIGINT) AS turn_bytes
FROM (SELECT rs.*, t.tree, {_turn_sql()} AS turn FROM rs LEFT JOIN trees t USING (corpus_id, shard_id))""")
def query_turns(spark, sf):
    """Last message of each (request, shard)."""
    f = V.files(spark, sf)
    sfi = S.plan_shards(f, 4000)
    rs = R.prune_by_scope(V.requests(spark, sf), S.plan_table(sfi))
    qt = X.query_turns(rs, X.shard_directory_tree(f, sfi))
    return qt.select("query_id", "corpus_id", "shard_id", *_hash_bytes("query_turn", "turn"))


@query("messages", D.with_(*_F, D.requests_cte(), D.plan_ctes("sp", "files", 4000)) + _PRUNE_SQL + f"""
, bt AS (SELECT s.corpus_id, s.shard_id, string_agg({D.render_file('f.path', 'f.content', 'f.n_lines')}, {D.NL2}
                ORDER BY CAST(floor(f.mtime_ms / 1000) AS BIGINT), f.path) AS base_text
         FROM sp s JOIN files f USING (corpus_id, path) GROUP BY s.corpus_id, s.shard_id)
SELECT rs.query_id, rs.corpus_id, rs.shard_id, CAST(3 AS BIGINT) AS n_messages,
       sha256(bt.base_text) AS base_hash
FROM rs JOIN bt USING (corpus_id, shard_id)""")
def messages(spark, sf):
    """Message rows; shard turns once per shard, joined per request here for the check."""
    from corpusflow.session import materialize
    f = materialize(CL.attach_commit_time(V.files(spark, sf), CL.parse_commit_log(V.commit_lines(spark, sf))),
                    "timed_files")
    sfi = S.plan_shards(f, 4000)
    plan = S.plan_table(sfi)
    rs = R.prune_by_scope(V.requests(spark, sf), plan)
    ctx = X.base_context(S.restrict_to_shard(f, sfi)).join(plan.select("corpus_id", "shard_id"), ["corpus_id", "shard_id"]) \
        .withColumn("sharded", F.col("shard_id") != O.ALL_SHARD).withColumn("change_text", F.lit(None).cast("string"))
    turns = X.query_turns(rs, X.shard_directory_tree(f, sfi))
    m = X.assemble_messages(rs, ctx, turns)
    per_shard = m.where(F.col("query_id").isNull())
    per_q = m.where(F.col("query_id").isNotNull()).select("query_id", "corpus_id", "shard_id")
    shard_n = per_shard.groupBy("corpus_id", "shard_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("turn") == 1, F.sha2("content", 256))).alias("base_hash"))
    return per_q.join(shard_n, ["corpus_id", "shard_id"]).select(
        "query_id", "corpus_id", "shard_id", (F.col("_n") + 1).cast("bigint").alias("n_messages"), "base_hash")


# ============================================================================
# J3, J4, B13, B14, D11
# ============================================================================

@query("attempt_outcome", D.with_(D.attempts_cte()) + """
, a AS (SELECT * FROM attempts WHERE attempt <= 3),
g AS (SELECT request_id, min(CASE WHEN status_code = 200 OR (status_code IS NOT NULL AND status_code NOT IN (429, 500, 503))
                                  THEN attempt END) AS t, max(attempt) AS last FROM a GROUP BY request_id)
SELECT a.request_id, a.attempt AS final_attempt, a.status_code,
       CASE WHEN a.status_code = 200 THEN 'ok' ELSE 'failed' END AS outcome,
       CASE WHEN a.status_code = 200 THEN NULL
            WHEN g.t IS NOT NULL THEN 'API error ' || CAST(a.status_code AS VARCHAR) || ': ' || a.message
            ELSE 'Failed after ' || CAST(a.attempt AS VARCHAR) || ' retries: ' || a.message END AS error,
       g.t IS NULL AND coalesce(a.status_code <> 200, TRUE) AS exhausted
FROM a JOIN g ON a.request_id = g.request_id AND a.attempt = coalesce(g.t, g.last)""")
def attempt_outcome(spark, sf):
    """Outcome per request from the attempt log."""
    return R.resolve_attempts(V.attempts(spark, sf))


@query("attempt_kinds", D.with_(D.attempts_cte()) + """
, a AS (SELECT *, CASE WHEN status_code = 200 THEN CASE (request_id + attempt) % 4 WHEN 0 THEN 'no_tool_call' WHEN 1 THEN 'missing_usage'
                                                    WHEN 2 THEN 'parse_error' ELSE 'ok' END END AS kind
        FROM attempts WHERE attempt <= 3),
ranked AS (SELECT *, kind = 'ok' OR (status_code IS NOT NULL AND status_code NOT IN (200, 429, 500, 503)) AS stops FROM a),
final AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN stops THEN 0 ELSE 1 END,
                                                          CASE WHEN stops THEN attempt ELSE -attempt END) = 1)
SELECT request_id, attempt AS final_attempt, status_code, CASE WHEN kind = 'ok' THEN 'ok' ELSE 'failed' END AS outcome,
       CASE WHEN kind = 'ok' THEN NULL
            WHEN kind = 'no_tool_call' THEN 'no tool call after ' || CAST(attempt AS VARCHAR) || ' attempts'
            WHEN kind = 'missing_usage' THEN 'Failed after ' || CAST(attempt AS VARCHAR) || ' retries: """ + O.MSG_NO_USAGE.replace("'", "''") + """'
            WHEN stops THEN 'API error ' || CAST(status_code AS VARCHAR) || ': ' || message
            ELSE 'Failed after ' || CAST(attempt AS VARCHAR) || ' retries: ' || message END AS error,
       NOT coalesce(stops, FALSE) AS exhausted
FROM final""")
def attempt_kinds(spark, sf):
    """J3 over J4's kinds: an answered attempt without a readable tool call or usage is tried again."""
    at = (F.col("request_id") + F.col("attempt")) % 4
    kind = F.when(at == 0, "no_tool_call").when(at == 1, "missing_usage").when(at == 2, "parse_error").otherwise("ok")
    return R.resolve_attempts(V.attempts(spark, sf).withColumn("attempt_kind", F.when(F.col("status_code") == 200, kind)))


@query("backoff", D.with_(D.attempts_cte()) + """
SELECT request_id, attempt, status_code IS NULL OR status_code IN (429, 500, 503) AS retryable,
       CAST(floor(least(1000 * pow(2, attempt - 1), 8000) * (1 + ((request_id % 100) / 100.0) * 0.5) + 0.5) AS BIGINT) AS backoff_ms
FROM attempts""")
def backoff(spark, sf):
    """Retry class and backoff schedule (jitter passed in as data)."""
    a = V.attempts(spark, sf)
    jit = (F.col("request_id") % 100) / F.lit(100.0)
    return a.select("request_id", "attempt", T.is_retryable("status_code").alias("retryable"),
                    T.backoff_ms("attempt", jit).alias("backoff_ms"))


def _chunks_sql():
    return """chunks AS (
  SELECT c.conv_id AS request_id, c.turn AS chunk_no, CASE WHEN c.role = 'assistant' THEN c.text END AS tool_delta,
         CASE WHEN c.role <> 'assistant' THEN c.text END AS content_delta,
         CASE WHEN c.turn = l.last AND c.conv_id % 7 <> 0 THEN CAST(length(c.text) * 3 AS BIGINT) END AS prompt_tokens
  FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) l ON c.conv_id = l.conv_id)"""


@query("chunk_text", "WITH " + _chunks_sql() + """
SELECT request_id, sha256(coalesce(string_agg(tool_delta, '' ORDER BY chunk_no), '')) AS tool_hash,
       sha256(coalesce(string_agg(content_delta, '' ORDER BY chunk_no), '')) AS content_hash,
       CAST(count(*) AS BIGINT) AS n_chunks, arg_max(prompt_tokens, chunk_no) FILTER (WHERE prompt_tokens IS NOT NULL) AS prompt_tokens,
       CASE WHEN count(prompt_tokens) = 0 THEN 'No usage data in stream response' END AS error
FROM chunks GROUP BY request_id""")
def chunk_text(spark, sf):
    """Reassembled deltas, last usage, missing-usage error."""
    r = R.reassemble_chunks(V.chunks(spark, sf))
    return r.select("request_id", F.sha2("tool_text", 256).alias("tool_hash"),
                    F.sha2("content_text", 256).alias("content_hash"), "n_chunks",
                    F.col("usage.prompt_tokens").alias("prompt_tokens"), "error")


@query("chunk_stream", SQL["chunk_text"])
def chunk_stream(spark, sf):
    """K1: the chunks as a stream of two batches (second chunks come last), with send times and a heartbeat."""
    from corpusflow.streaming.chunks import OUTPUT_SCHEMA, reassemble_stream
    root = f"{run_dir(spark)}/chunk-stream-{uuid.uuid4().hex}"
    sent = V.chunks(spark, sf).withColumn("sent_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("chunk_no") % 50))
    beat = spark.range(1).select(F.lit(None).cast("bigint").alias("request_id"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("sent_at"))
    sent.where("chunk_no <> 1").repartition(8).write.parquet(f"{root}/in/a")
    sent.where("chunk_no = 1").unionByName(beat, allowMissingColumns=True).repartition(8).write.parquet(f"{root}/in/b")
    arrivals = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 8) \
                    .option("recursiveFileLookup", "true").parquet(f"{root}/in")
    q = reassemble_stream(arrivals).writeStream.format("parquet").option("path", f"{root}/out") \
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.schema(OUTPUT_SCHEMA).parquet(f"{root}/out")
    return r.select("request_id", F.sha2("tool_text", 256).alias("tool_hash"), F.sha2("content_text", 256).alias("content_hash"),
                    "n_chunks", "prompt_tokens", "error")


# ============================================================================
# Hits: I, C7, C8, B10, E1, E3, E5, C11, J5, J6, D14
# ============================================================================

_RH = [D.files_cte("files"), D.raw_hits_cte()]
_CLASSIFY = """
, cls AS (
  SELECT h.*, f.n_lines,
         greatest(1, floor(h.start_line + 0.5)) AS s1, greatest(1, floor(h.end_line + 0.5)) AS e1
  FROM {src} h LEFT JOIN files f ON h.corpus_id = f.corpus_id AND h.path = f.path),
cls2 AS (
  SELECT *, CAST(least(s1, e1) AS BIGINT) AS lo, CAST(least(greatest(s1, e1), n_lines) AS BIGINT) AS hi,
         CASE WHEN n_lines IS NULL THEN 'file not in snapshot'
              WHEN start_line IS NULL OR end_line IS NULL THEN 'invalid line numbers'
              WHEN least(s1, e1) > n_lines THEN 'beyond file length' END AS reason
  FROM cls)"""


@query("clean_hits", D.with_(*_RH) + _CLASSIFY.format(src="raw_hits") + """
SELECT query_id, hit_ord, corpus_id, path, CASE WHEN reason IS NULL THEN lo END AS start_line,
       CASE WHEN reason IS NULL THEN hi END AS end_line, reason FROM cls2""")
def clean_hits(spark, sf):
    """B10, C7, I3, J6 with the drop reason kept."""
    c = H.classify_hits(V.raw_hits(spark, sf), V.files(spark, sf))
    return c.select("query_id", "hit_ord", "corpus_id", "path", F.col("clean_start").alias("start_line"),
                    F.col("clean_end").alias("end_line"), "reason")


@query("shard_hits", D.with_(*_RH, D.plan_ctes("sp", "files", 4000)) + """
, pl AS (SELECT DISTINCT corpus_id, shard_id, shard_ord FROM sp),
h AS (SELECT r.*, p.shard_id FROM raw_hits r JOIN pl p ON r.corpus_id = p.corpus_id AND p.shard_ord = r.shard_ord + 1)
SELECT query_id, hit_ord, shard_id, path FROM h
WHERE EXISTS (SELECT 1 FROM sp s WHERE s.corpus_id = h.corpus_id AND s.shard_id = h.shard_id AND s.path = h.path)""")
def shard_hits(spark, sf):
    """Hits outside the answering shard's own files are dropped."""
    f = V.files(spark, sf)
    sfi = S.plan_shards(f, 4000)
    pl = S.plan_table(sfi).select("corpus_id", "shard_id", F.col("shard_ord").alias("_o"))
    h = V.raw_hits(spark, sf)
    h = h.join(pl, (h["corpus_id"] == pl["corpus_id"]) & (pl["_o"] == h["shard_ord"] + 1)).drop(pl["corpus_id"]).drop("_o")
    return H.hits_in_shard(h, sfi).select("query_id", "hit_ord", "shard_id", "path")


_DEDUP = """
, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_id, path, start_line, end_line
                                                  ORDER BY shard_ord, hit_ord) AS rn FROM raw_hits) WHERE rn = 1)"""


@query("deduped_hits", D.with_(*_RH) + _DEDUP +
       "\nSELECT query_id, hit_ord, shard_ord, path, start_line, end_line FROM dd")
def deduped_hits(spark, sf):
    """First of each (file, start, end) per request in shard then answer order."""
    return H.dedupe_hits(V.raw_hits(spark, sf)).select("query_id", "hit_ord", "shard_ord", "path", "start_line", "end_line")


_MERGE = _DEDUP + _CLASSIFY.format(src="dd") + """
, v AS (SELECT query_id, corpus_id, path, shard_ord, hit_ord, lo AS s, hi AS e FROM cls2 WHERE reason IS NULL),
fr AS (SELECT query_id, corpus_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(shard_ord * 1000000000000 + hit_ord)) AS BIGINT) AS file_rank
       FROM v GROUP BY query_id, corpus_id, path),
w AS (SELECT *, max(e) OVER (PARTITION BY query_id, corpus_id, path ORDER BY s, e, shard_ord, hit_ord
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v),
isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, corpus_id, path
                  ORDER BY s, e, shard_ord, hit_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS range_no FROM w),
mr AS (SELECT i.query_id, i.corpus_id, i.path, fr.file_rank, CAST(i.range_no AS BIGINT) AS range_no, min(i.s) AS start_line,
              max(i.e) AS end_line, CAST(count(*) AS BIGINT) AS n_hits
       FROM isl i JOIN fr USING (query_id, corpus_id, path) GROUP BY i.query_id, i.corpus_id, i.path, fr.file_rank, i.range_no)"""


@query("merged_ranges", D.with_(*_RH) + _MERGE +
       "\nSELECT query_id, corpus_id, path, file_rank, range_no, start_line, end_line, n_hits FROM mr")
def merged_ranges(spark, sf):
    """E1, E5 after E3 and J6: coalesced ranges with file order by first appearance."""
    v = H.normalize_hits(H.dedupe_hits(V.raw_hits(spark, sf)), V.files(spark, sf))
    m = H.coalesce_ranges(v)
    return m.select("query_id", "corpus_id", "path", "file_rank", "range_no", "start_line", "end_line", "n_hits")


@query("snippets", D.with_(*_RH) + _MERGE + """
, sn AS (SELECT mr.query_id, mr.path, mr.start_line, mr.end_line,
                '--- ' || mr.path || ':' || CAST(mr.start_line AS VARCHAR) || '-' || CAST(mr.end_line AS VARCHAR) || ' ---' || chr(10)
                || array_to_string(list_transform(list_slice(string_split(f.content, chr(10)), mr.start_line, mr.end_line),
                                                  lambda x, i: CAST(i + mr.start_line - 1 AS VARCHAR) || chr(9) || x), chr(10)) AS snippet
         FROM mr JOIN files f ON mr.corpus_id = f.corpus_id AND mr.path = f.path)
SELECT query_id, path, start_line, end_line, sha256(snippet) AS snippet_hash, CAST(strlen(snippet) AS BIGINT) AS snippet_bytes FROM sn""")
def snippets(spark, sf):
    """C11: numbered lines of each merged range."""
    f = V.files(spark, sf)
    m = H.coalesce_ranges(H.normalize_hits(H.dedupe_hits(V.raw_hits(spark, sf)), f))
    s = H.cut_snippets(m, f)
    return s.select("query_id", "path", "start_line", "end_line", *_hash_bytes("snippet", "snippet"))


def _responses_spark(spark, sf):
    """Shard responses derived from raw hits: a shard fails when (query + shard) % 4 = 0,
    every shard of query_id % 10 = 9 fails."""
    h = V.raw_hits(spark, sf)
    resp = h.select("query_id", "shard_ord").distinct()
    fail = ((F.col("query_id") + F.col("shard_ord")) % 4 == 0) | (F.col("query_id") % 10 == 9)
    resp = resp.select("query_id", "shard_ord",
                       F.concat(F.lit("s"), F.col("shard_ord").cast("string")).alias("shard_id"),
                       F.when(F.col("shard_ord") == 0, F.lit("")).otherwise(
                           F.concat(F.lit("dir"), F.col("shard_ord").cast("string"), F.lit("/"))).alias("prefix"),
                       F.when(fail, F.concat(F.lit("API error 400: bad request "), F.col("query_id").cast("string"))).alias("error"))
    ok_hits = h.join(resp.where(F.col("error").isNull()).select("query_id", "shard_ord"), ["query_id", "shard_ord"], "left_semi")
    return resp, ok_hits


_RESP_SQL = """
, resp AS (SELECT query_id, shard_ord, 's' || CAST(shard_ord AS VARCHAR) AS shard_id,
                  CASE WHEN shard_ord = 0 THEN '' ELSE 'dir' || CAST(shard_ord AS VARCHAR) || '/' END AS prefix,
                  CASE WHEN (query_id + shard_ord) % 4 = 0 OR query_id % 10 = 9 THEN 'API error 400: bad request ' || CAST(query_id AS VARCHAR) END AS error
           FROM (SELECT DISTINCT query_id, shard_ord FROM raw_hits_all)),
raw_hits AS (SELECT h.* FROM raw_hits_all h SEMI JOIN resp r ON h.query_id = r.query_id AND h.shard_ord = r.shard_ord AND r.error IS NULL),
oc AS (SELECT query_id, CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS n_ok,
              CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS n_failed,
              coalesce(string_agg(CASE WHEN error IS NOT NULL THEN '[shard "' || shard_id || '" (' ||
                       CASE WHEN prefix = '' THEN shard_id ELSE prefix END || ')]: ' || error END, chr(10) ORDER BY shard_ord), '') AS errors
       FROM resp GROUP BY query_id)"""


@query("outcome", D.with_(D.files_cte("files"), D.raw_hits_cte("raw_hits_all")) + _RESP_SQL + """
SELECT query_id, n_ok, n_failed, errors, n_ok = 0 AND n_failed > 0 AS is_error FROM oc""")
def outcome(spark, sf):
    """Per request shard success and failure counts and the error list."""
    resp, _ = _responses_spark(spark, sf)
    return H.outcome_summary(resp).select("query_id", "n_ok", "n_failed", "errors", "is_error")


@query("render", D.with_(D.files_cte("files"), D.raw_hits_cte("raw_hits_all")) + _RESP_SQL + _MERGE + """
, sn AS (SELECT mr.query_id, mr.file_rank, mr.start_line,
                '--- ' || mr.path || ':' || CAST(mr.start_line AS VARCHAR) || '-' || CAST(mr.end_line AS VARCHAR) || ' ---' || chr(10)
                || array_to_string(list_transform(list_slice(string_split(f.content, chr(10)), mr.start_line, mr.end_line),
                                                  lambda x, i: CAST(i + mr.start_line - 1 AS VARCHAR) || chr(9) || x), chr(10)) AS snippet
         FROM mr JOIN files f ON mr.corpus_id = f.corpus_id AND mr.path = f.path),
st AS (SELECT query_id, string_agg(snippet, chr(10) || chr(10) ORDER BY file_rank, start_line) AS snip FROM sn GROUP BY query_id),
nm AS (SELECT query_id, CAST(count(*) AS BIGINT) AS n_results FROM dd GROUP BY query_id),
out AS (SELECT oc.query_id, oc.n_ok, oc.n_failed, coalesce(nm.n_results, 0) AS n,
               CASE WHEN coalesce(nm.n_results, 0) > 0 OR oc.n_failed = 0 THEN
                    CASE WHEN coalesce(nm.n_results, 0) = 0 THEN 'No matching code found.'
                         WHEN st.snip IS NULL THEN 'No matching files found in snapshot.' ELSE st.snip END
                    ELSE '' END
               || CASE WHEN oc.n_failed > 0 THEN chr(10) || chr(10) || '--- Shard Errors ---' || chr(10) || oc.errors ELSE '' END AS text,
               oc.n_ok = 0 AND oc.n_failed > 0 AS is_error
        FROM oc LEFT JOIN nm ON oc.query_id = nm.query_id LEFT JOIN st ON oc.query_id = st.query_id)
SELECT query_id, sha256(text) AS text_hash, CAST(strlen(text) AS BIGINT) AS text_bytes, is_error, n_ok, n_failed, n AS n_results FROM out""")
def render(spark, sf):
    """J5 (with F4, E3, J6, E1, C11, D14): the text answer per request."""
    f = V.files(spark, sf)
    resp, ok_hits = _responses_spark(spark, sf)
    dd = H.dedupe_hits(ok_hits)
    n_merged = dd.groupBy("query_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_results"))
    snip = H.cut_snippets(H.coalesce_ranges(H.normalize_hits(dd, f)), f)
    r = H.render_outcome(H.outcome_summary(resp), n_merged, snip)
    return r.select("query_id", *_hash_bytes("text", "text"), "is_error", "n_ok", "n_failed", "n_results")


def _arguments_spark(spark, sf):
    """Tool-argument text per raw hit (some truncated, some with text line
    numbers, some with a non-array ``results``)."""
    h = V.raw_hits(spark, sf)
    o = F.col("hit_ord")
    item = F.concat(F.lit('{"file": "'), F.col("path"), F.lit('", "start_line": '),
                    F.when(o % 19 == 0, F.concat(F.lit('"'), F.col("start_line").cast("string"), F.lit('"')))
                    .otherwise(F.col("start_line").cast("string")),
                    F.lit(', "end_line": '), F.col("end_line").cast("string"), F.lit("}"))
    txt = (F.when(o % 13 == 0, F.concat(F.lit('{"results": ['), item))
           .when(o % 17 == 0, F.lit('{"results": {"file": "x"}}'))
           .otherwise(F.concat(F.lit('{"results": ['), item, F.lit("]}"))))
    return h.select("query_id", "corpus_id", F.concat(F.lit("s"), F.col("shard_ord").cast("string")).alias("shard_id"),
                    "shard_ord", o.alias("request_ord"), txt.alias("arguments"))


@query("parsed_hits")
def parsed_hits(spark, sf):
    """I1, I2, I3 (rows check): parse argument text, explode results, type line numbers."""
    a = H.parse_arguments(_arguments_spark(spark, sf))
    e = H.explode_hits(a, keep=("query_id", "corpus_id", "shard_id", "shard_ord", "request_ord", "parse_error"))
    return e.select("query_id", "request_ord", "hit_ord", "path", "start_line", "end_line", "type_ok")


# ============================================================================
# Usage: I4, B15, D12, D15, E2
# ============================================================================

_U = [D.usage_cte()]


@query("usage_totals", D.with_(*_U) + """
SELECT session, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(prompt_cache_hit_tokens) AS BIGINT) AS prompt_cache_hit_tokens,
       CAST(sum(prompt_cache_miss_tokens) AS BIGINT) AS prompt_cache_miss_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(count(*) AS BIGINT) AS n_requests,
       CASE WHEN sum(prompt_tokens) > 0 THEN CAST(sum(prompt_cache_hit_tokens) AS DOUBLE) / sum(prompt_tokens) ELSE 0.0 END AS hit_ratio
FROM usage GROUP BY session""")
def usage_totals(spark, sf):
    """Totals and hit share per session."""
    return U.usage_summary(V.usage(spark, sf), ["session"])


@query("cumulative_hits", D.with_(*_U) + """
SELECT session, request_id, cum_prompt, cum_hit, CASE WHEN cum_prompt > 0 THEN CAST(cum_hit AS DOUBLE) / cum_prompt ELSE 0.0 END AS cum_hit_ratio
FROM (SELECT session, request_id,
             CAST(sum(prompt_tokens) OVER w AS BIGINT) AS cum_prompt, CAST(sum(prompt_cache_hit_tokens) OVER w AS BIGINT) AS cum_hit
      FROM usage WINDOW w AS (PARTITION BY session ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def cumulative_hits(spark, sf):
    """Running hit share per session."""
    return U.cumulative_hit_rate(V.usage(spark, sf)).select("session", "request_id", "cum_prompt", "cum_hit", "cum_hit_ratio")


@query("usage_parsed", D.with_(*_U) + """
SELECT request_id, prompt_tokens,
       CAST(CASE WHEN request_id % 6 = 0 THEN 0 ELSE prompt_cache_hit_tokens END AS BIGINT) AS prompt_cache_hit_tokens,
       prompt_cache_miss_tokens, completion_tokens,
       CAST(CASE WHEN request_id % 4 = 0 THEN 0 ELSE reasoning_tokens END AS BIGINT) AS reasoning_tokens
FROM usage""")
def usage_parsed(spark, sf):
    """I4: usage JSON with absent counters read as 0."""
    u = U.parse_usage(V.usage_json(spark, sf))
    return u.select("request_id", *U.COUNTERS)


@query("cost", D.with_(*_U) + """
SELECT request_id, model, round((prompt_cache_hit_tokens * h + prompt_cache_miss_tokens * m + completion_tokens * o) / 1000000.0, 9) AS cost
FROM (SELECT *, CASE WHEN label IN ('view', 'click') THEN 'deepseek-v4-flash' ELSE 'deepseek-v4-pro' END AS model FROM usage) u
JOIN (VALUES ('deepseek-v4-flash', 0.02, 1.0, 2.0), ('deepseek-v4-pro', 0.025, 3.0, 6.0)) p(pm, h, m, o) ON u.model = p.pm""")
def cost(spark, sf):
    """Cost per request from the price table."""
    u = V.usage(spark, sf).withColumn(
        "model", F.when(F.col("label").isin("view", "click"), "deepseek-v4-flash").otherwise("deepseek-v4-pro"))
    c = U.token_cost(u, U.price_table(spark))
    return c.select("request_id", "model", F.round("cost", 9).alias("cost"))


# ============================================================================
# State: A9, A11, D13, J8
# ============================================================================

def _bases(spark, sf, version, budget, ts_expr=None):
    f = V.files(spark, sf, version)
    sfi = S.restrict_to_shard(f, S.plan_shards(f, budget))
    tok = sfi.groupBy("corpus_id", "shard_id", "shard_ord").agg(F.sum("tokens").cast("bigint").alias("base_token_count"))
    ts = F.lit(1000).cast("bigint") if ts_expr is None else ts_expr
    return tok.withColumn("snapshot_ts", ts).withColumn("base_text", F.lit(None).cast("string"))


@query("base_upsert", D.with_(*_STORED, D.files_cte("files_v2", "v2"), D.plan_ctes("p2", "files_v2", 4000)) + """
, e AS (SELECT corpus_id, shard_id, CAST(sum(tokens) AS BIGINT) AS base_token_count, CAST(1000 AS BIGINT) AS snapshot_ts, 0 AS is_new
        FROM plan_v1 GROUP BY corpus_id, shard_id),
n AS (SELECT corpus_id, shard_id, CAST(sum(tokens) AS BIGINT) AS base_token_count,
             CAST(CASE any_value(shard_ord) % 3 WHEN 0 THEN 1000 WHEN 1 THEN 2000 ELSE 500 END AS BIGINT) AS snapshot_ts, 1 AS is_new
      FROM p2 GROUP BY corpus_id, shard_id),
u AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, shard_id ORDER BY snapshot_ts DESC, is_new) AS rn
      FROM (SELECT * FROM e UNION ALL SELECT * FROM n))
SELECT corpus_id, shard_id, base_token_count, snapshot_ts, CASE WHEN is_new = 1 THEN 'new' ELSE 'existing' END AS origin
FROM u WHERE rn = 1""")
def base_upsert(spark, sf):
    """Newest snapshot wins; on a tie the existing base stays."""
    old = _bases(spark, sf, "v1", 4000).withColumn("origin", F.lit("existing"))
    so = F.col("shard_ord") % 3
    new = _bases(spark, sf, "v2", 4000, F.when(so == 0, 1000).when(so == 1, 2000).otherwise(500).cast("bigint")) \
        .withColumn("origin", F.lit("new"))
    won = ST.upsert_base(old.drop("shard_ord"), new.drop("shard_ord"))
    return won.select("corpus_id", "shard_id", "base_token_count", "snapshot_ts", "origin")


@query("base_prune", D.with_(*_STORED, _V2, D.resolve_ctes("rp", "files_v2", "stored", 2000)) + """
SELECT DISTINCT corpus_id, shard_id FROM plan_v1 p
WHERE EXISTS (SELECT 1 FROM rp r WHERE r.corpus_id = p.corpus_id AND r.shard_id = p.shard_id)""")
def base_prune(spark, sf):
    """Bases of shards no longer in the active plan are dropped."""
    old = _bases(spark, sf, "v1", 4000)
    plan = S.plan_table(S.resolve_plan(V.files(spark, sf, "v2"), V.stored_plan(spark, sf, 4000), 2000))
    return ST.prune_base(old, plan).select("corpus_id", "shard_id")


_REFRESH_CTES = """
, cur AS (SELECT r.corpus_id, r.shard_id, r.path, f.hash, f.tokens FROM rp r JOIN files_v2 f USING (corpus_id, path)),
bf AS (SELECT p.corpus_id, p.shard_id, p.path, f.hash FROM plan_v1 p JOIN files_v1 f USING (corpus_id, path)),
bs AS (SELECT corpus_id, shard_id, CAST(sum(tokens) AS BIGINT) AS base_tokens FROM plan_v1 GROUP BY ALL),
ch AS (SELECT coalesce(n.corpus_id, o.corpus_id) AS corpus_id, coalesce(n.shard_id, o.shard_id) AS shard_id,
              CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added'
                   WHEN n.hash <> o.hash THEN 'modified' ELSE 'unchanged' END AS status, n.tokens
       FROM cur n FULL OUTER JOIN bf o ON n.corpus_id = o.corpus_id AND n.shard_id = o.shard_id AND n.path = o.path),
cs AS (SELECT corpus_id, shard_id, sum(CASE WHEN status IN ('modified', 'added') THEN tokens ELSE 0 END) AS ct FROM ch GROUP BY ALL),
sh AS (SELECT corpus_id, shard_id, any_value(prefix) AS prefix, any_value(shard_ord) AS shard_ord,
              CAST(sum(tokens) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS n_files FROM rp GROUP BY ALL),
dec AS (SELECT s.*, b.base_tokens IS NULL AS is_new,
               CASE WHEN b.base_tokens IS NULL THEN NULL WHEN b.base_tokens > 0 THEN coalesce(c.ct, 0) / b.base_tokens ELSE 1.0 END AS change_ratio
        FROM sh s LEFT JOIN bs b USING (corpus_id, shard_id) LEFT JOIN cs c USING (corpus_id, shard_id)),
dec2 AS (SELECT *, is_new OR change_ratio > 0.1 AS needs_rebuild FROM dec)"""
_REFRESH_SQL = _REFRESH_CTES + """
SELECT corpus_id, shard_id, prefix, shard_ord, tokens, n_files, is_new, change_ratio, needs_rebuild FROM dec2"""


@query("refresh", D.with_(*_STORED, _V2, D.resolve_ctes("rp", "files_v2", "stored", 4000)) + _REFRESH_SQL)
def refresh(spark, sf):
    """J8 (C1, D1, D2, D5, C9 composed): rebuild decision per shard of the new plan."""
    from corpusflow.plans.refresh import refresh_decisions
    v1, v2 = V.files(spark, sf, "v1"), V.files(spark, sf, "v2")
    stored = V.stored_plan(spark, sf, 4000)
    base_files = S.restrict_to_shard(v1, S.plan_shards(v1, 4000)).select("corpus_id", "shard_id", "path", "hash", "tokens")
    base_shards = base_files.groupBy("corpus_id", "shard_id").agg(F.sum("tokens").cast("bigint").alias("base_token_count"))
    d = refresh_decisions(v2, stored, base_shards, base_files.drop("tokens"), budget=4000, threshold=0.1)
    return d.select("corpus_id", "shard_id", "prefix", "shard_ord", "tokens", "n_files", "is_new",
                    "change_ratio", "needs_rebuild")


@query("stream_refresh", D.with_(D.files_cte("files", "v1"), D.plan_ctes("sp", "files", 4000)) + """
SELECT sp.corpus_id, sp.shard_id, sp.path, f.hash FROM sp JOIN files f ON f.corpus_id = sp.corpus_id AND f.path = sp.path""")
def stream_refresh(spark, sf):
    """K2: the state after files_v1 came in two batches with its manifests in the second, and half
    of files_v2 with all of its manifests."""
    from corpusflow.streaming.refresh import announce, refresh_stream
    root = f"{run_dir(spark)}/stream-refresh-{uuid.uuid4().hex}"
    first = F.pmod(F.xxhash64("path"), F.lit(2)) == 0

    def sent(version, number):
        return V.files(spark, sf, version).select("corpus_id", F.lit(number).cast("bigint").alias("snapshot_id"), "path", "content", "mtime_ms")

    v1, v2 = sent("v1", 1), sent("v2", 2)
    told = announce(v1).unionByName(announce(v2))
    one = v1.where(first).unionByName(told.limit(0), allowMissingColumns=True)
    two = v1.where(~first).unionByName(v2.where(first)).unionByName(told, allowMissingColumns=True)
    for name, rows in (("a", one), ("b", two)):
        rows.write.parquet(f"{root}/in/{name}")
        arrivals = spark.readStream.schema(one.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        refresh_stream(arrivals, f"{root}/state", f"{root}/checkpoint", budget=4000, available_now=True).awaitTermination()
    return ST.read_state(spark, f"{root}/state", "base_files").select("corpus_id", "shard_id", "path", "hash")


@query("search_passages")
def search_passages(spark, sf):
    """J2, J7, L2 (rows check): benchmark passages searched in their corpus with
    the passage-locating responder; the rows are the rendered answers."""
    from corpusflow.plans.search import search
    files = V.files(spark, sf)
    out = search(V.requests(spark, sf), files, RS.PassageLocator(), budget=4000)
    return out["answers"].select("query_id", *_hash_bytes("text", "text"), "is_error", "n_ok", "n_failed", "n_results")


@query("response_checks", D.with_(D.files_cte("files"), D.raw_hits_cte()) + """
, t AS (SELECT hit_ord,
               '{"file": "' || path || '", "start_line": ' ||
               CASE WHEN hit_ord % 19 = 0 THEN '"' || CAST(start_line AS VARCHAR) || '"' ELSE CAST(start_line AS VARCHAR) END ||
               ', "end_line": ' || CAST(end_line AS VARCHAR) || '}' AS item
        FROM raw_hits),
a AS (SELECT hit_ord,
             CASE WHEN hit_ord % 29 = 0 THEN ''
                  WHEN hit_ord % 13 = 0 THEN '{"results": [' || item
                  WHEN hit_ord % 17 = 0 THEN '{"results": {"file": "x"}}'
                  ELSE '{"results": [' || item || ']}' END AS tool_text,
             hit_ord % 11 <> 0 AS has_usage
      FROM t)
SELECT hit_ord AS request_ord,
       CASE WHEN NOT has_usage THEN 'missing_usage' WHEN coalesce(tool_text, '') = '' THEN 'no_tool_call'
            WHEN NOT json_valid(tool_text) THEN 'parse_error' ELSE 'ok' END AS attempt_kind,
       (CASE WHEN NOT has_usage THEN 'missing_usage' WHEN coalesce(tool_text, '') = '' THEN 'no_tool_call'
             WHEN NOT json_valid(tool_text) THEN 'parse_error' ELSE 'ok' END) <> 'ok' AS retryable
FROM a""")
def response_checks(spark, sf):
    """Classify streamed attempts (missing usage, no tool call, unparsable, ok)."""
    a = _arguments_spark(spark, sf)
    o = F.col("request_ord")
    tool = F.when(o % 29 == 0, F.lit("")).otherwise(F.col("arguments"))
    usage = F.when(o % 11 != 0, F.struct(F.lit(1).alias("prompt_tokens")))
    v = R.validate_response(a.select("request_ord", tool.alias("tool_text"), usage.alias("usage")))
    return v.select("request_ord", "attempt_kind", "retryable")


@query("base_record", D.with_(*_STORED, _V2, D.resolve_ctes("rp", "files_v2", "stored", 4000)) + _REFRESH_CTES + f"""
SELECT d.corpus_id, d.shard_id, CAST(sum(f.tokens) AS BIGINT) AS base_token_count, CAST(count(*) AS BIGINT) AS n_files,
       sha256(string_agg({D.render_file('f.path', 'f.content', 'f.n_lines')}, {D.NL2}
                         ORDER BY CAST(floor(f.mtime_ms / 1000) AS BIGINT), f.path)) AS text_hash,
       CAST(2 AS BIGINT) AS snapshot_ts
FROM dec2 d JOIN rp r ON d.corpus_id = r.corpus_id AND d.shard_id = r.shard_id
JOIN files_v2 f ON f.corpus_id = r.corpus_id AND f.path = r.path
WHERE d.needs_rebuild GROUP BY d.corpus_id, d.shard_id""")
def base_record(spark, sf):
    """D13 (with D7): new bases of the shards a refresh of files_v2 rebuilds."""
    from corpusflow.plans.refresh import refresh_decisions
    v1, v2 = V.files(spark, sf, "v1"), V.files(spark, sf, "v2")
    stored = V.stored_plan(spark, sf, 4000)
    base_files = S.restrict_to_shard(v1, S.plan_shards(v1, 4000)).select("corpus_id", "shard_id", "path", "hash", "tokens")
    base_shards = base_files.groupBy("corpus_id", "shard_id").agg(F.sum("tokens").cast("bigint").alias("base_token_count"))
    from corpusflow.session import materialize
    sfi = materialize(S.resolve_plan(v2, stored, 4000), "shard_files")
    dec = materialize(refresh_decisions(v2, stored, base_shards, base_files.drop("tokens"), 4000, 0.1,
                                        shard_files=sfi), "decisions")
    timed = v2.withColumn("commit_time", F.floor(F.col("mtime_ms") / 1000).cast("bigint"))
    rebuild = dec.where("needs_rebuild").select("corpus_id", "shard_id")
    members = S.restrict_to_shard(timed, sfi.drop("tokens")).join(rebuild, ["corpus_id", "shard_id"], "left_semi")
    ctx = X.base_context(members, budget=4000,
                         shard_tokens=dec.where("needs_rebuild").select("corpus_id", "shard_id", "tokens", "n_files"))
    shards, files = ST.base_record(members, ctx, dec, rebuild, snapshot_ts=2)
    n = files.groupBy("corpus_id", "shard_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))
    return shards.join(n, ["corpus_id", "shard_id"]).select(
        "corpus_id", "shard_id", "base_token_count", "n_files", F.sha2("base_text", 256).alias("text_hash"), "snapshot_ts")


@query("search_ranges", D.with_(*_F, D.requests_all_cte(), D.plan_ctes("sp", "files", 4000)) + _PRUNE_SQL + """
, hit AS (SELECT rs.query_id, f.path, strpos(f.content, rs.query) AS pos, f.content, rs.query
          FROM rs JOIN sp ON sp.corpus_id = rs.corpus_id AND sp.shard_id = rs.shard_id
          JOIN files f ON f.corpus_id = sp.corpus_id AND f.path = sp.path
          WHERE strpos(f.content, rs.query) > 0)
SELECT query_id, path,
       CAST(1 + length(substr(content, 1, pos - 1)) - length(replace(substr(content, 1, pos - 1), chr(10), '')) AS BIGINT) AS start_line,
       CAST(1 + length(substr(content, 1, pos - 1)) - length(replace(substr(content, 1, pos - 1), chr(10), ''))
            + length(query) - length(replace(query, chr(10), '')) AS BIGINT) AS end_line
FROM hit""")
def search_ranges(spark, sf):
    """J7, J2, L2 (with C10, D7, D10, I1-I3, C8, E3, J6, E1): merged ranges of the
    end-to-end search with the passage-locating responder; the SQL twin scans
    every scope-matching file for the passage directly."""
    from corpusflow.plans.search import search
    out = search(V.requests_all_corpora(spark, sf), V.files(spark, sf), RS.PassageLocator(), budget=4000)
    return out["ranges"].select("query_id", "path", "start_line", "end_line")
