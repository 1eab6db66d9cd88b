"""DuckDB twins of the derived views and of the checked queries.

The driver runs each string against its DuckDB connection where the driver
tables are registered as views. Views and plans are inlined as CTEs, written
independently in SQL from the rules in the operator docstrings.
"""

from __future__ import annotations

from corpusflow import options as O
from corpusflow.sources.ignore import glob_to_regex

NL = "chr(10)"
NL2 = "(chr(10) || chr(10))"


def _ext(d: str = "doc_id") -> str:
    return (f"(CASE {d} % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' "
            f"WHEN 3 THEN '.SQL' WHEN 4 THEN '.c' ELSE '' END)")


def doc_path(d: str = "doc_id", s: str = "source") -> str:
    name = f"(CAST({d} AS VARCHAR) || {_ext(d)})"
    return (f"(CASE {d} % 11 WHEN 0 THEN {name} WHEN 1 THEN {s} || '/' || {name} "
            f"ELSE {s} || '/p' || CAST({d} % 5 AS VARCHAR) || '/' || {name} END)")


def numbered(content: str, first: str = "1") -> str:
    return (f"array_to_string(list_transform(string_split({content}, {NL}), "
            f"lambda x, i: CAST(i + {first} - 1 AS VARCHAR) || chr(9) || x), {NL})")


def render_file(path: str, content: str, n_lines: str, tag: str | None = None) -> str:
    label = f"' [{tag}]'" if tag else "''"
    return (f"('--- ' || {path} || {label} || ' (lines 1-' || CAST({n_lines} AS VARCHAR) || ') ---' || {NL} "
            f"|| {numbered(content)})")


def dir_of(p: str = "path") -> str:
    return f"(CASE WHEN strpos({p}, '/') > 0 THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) ELSE '.' END)"


def base_name(p: str = "path") -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def extension(p: str = "path") -> str:
    return f"lower(regexp_extract({base_name(p)}, '^.+(\\.[^.]*)$', 1))"


def files_cte(name: str, version: str | None = None) -> str:
    content = "replace(text, chr(13) || chr(10), chr(10))"
    mtime = "1700000000000 + (doc_id % 13) * 60000 + 123"
    where = ""
    if version == "v1":
        where = "WHERE doc_id % 10 <> 9"
    elif version == "v2":
        where = "WHERE doc_id % 10 <> 8"
        content = f"(CASE WHEN doc_id % 10 = 7 THEN {content} || {NL} || 'edited' ELSE {content} END)"
        mtime = f"(CASE WHEN doc_id % 10 = 7 THEN {mtime} + 86400000 ELSE {mtime} END)"
    return f"""{name}_raw AS (
  SELECT lang AS corpus_id, {doc_path()} AS path, doc_id, {content} AS content,
         CAST({mtime} AS BIGINT) AS mtime_ms
  FROM documents {where}),
{name} AS (
  SELECT corpus_id, path, doc_id, content, sha256(content) AS hash,
         CAST(ceil(strlen(content) / 4) AS BIGINT) AS tokens,
         CAST(len(string_split(content, {NL})) AS BIGINT) AS n_lines,
         mtime_ms, CAST(strlen(content) AS BIGINT) AS size
  FROM {name}_raw)"""


def page_files_cte(name: str = "page_files") -> str:
    upath = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
    rel = f"regexp_replace({upath}, '^/+|/+$', '', 'g')"
    pname = "(CAST(page_id AS VARCHAR) || '.html')"
    return f"""{name}_raw AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS corpus_id,
         CASE WHEN {rel} = '' THEN {pname} ELSE {rel} || '/' || {pname} END AS path,
         page_id, replace(html, chr(13) || chr(10), chr(10)) AS content
  FROM pages),
{name} AS (
  SELECT corpus_id, path, page_id, content, sha256(content) AS hash,
         CAST(ceil(strlen(content) / 4) AS BIGINT) AS tokens,
         CAST(len(string_split(content, {NL})) AS BIGINT) AS n_lines
  FROM {name}_raw)"""


def commit_lines_cte(name: str = "commit_lines") -> str:
    return f"""{name} AS (
  SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS corpus_id, event_id AS line_no,
         CASE event_id % 5 WHEN 0 THEN CAST(1700000000 - event_id AS VARCHAR) || ' ' || CAST(event_id AS VARCHAR)
                           WHEN 1 THEN ''
                           ELSE 'src' || CAST(event_id % 7 AS VARCHAR) || '/' || CAST(event_id % 50 AS VARCHAR) || '.py' END AS line
  FROM events)"""


def commit_times_cte(name: str = "commit_times", lines: str = "commit_lines") -> str:
    return f"""{name}_h AS (
  SELECT corpus_id, line_no, line,
         CASE WHEN regexp_full_match(line, '(\\d+) [0-9a-f]+') THEN CAST(regexp_extract(line, '^(\\d+) ', 1) AS BIGINT) END AS h
  FROM {lines}),
{name}_f AS (
  SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY corpus_id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur
  FROM {name}_h),
{name} AS (
  SELECT corpus_id, trim(line) AS path, CAST(arg_min(cur, line_no) AS BIGINT) AS commit_time
  FROM {name}_f WHERE h IS NULL AND trim(line) <> '' AND coalesce(cur, 0) > 0
  GROUP BY corpus_id, trim(line))"""


def log_files_cte(name: str = "log_files", lines: str = "commit_lines") -> str:
    return f"""{name} AS (
  SELECT DISTINCT corpus_id, line AS path, CAST(1690000000500 AS BIGINT) AS mtime_ms
  FROM {lines} WHERE regexp_full_match(line, 'src\\d+/\\d+\\.py')
  UNION ALL
  SELECT 'c' || CAST(doc_id % 4 AS VARCHAR), 'src9/' || CAST(doc_id AS VARCHAR) || '.py',
         CAST(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1600000000000 + doc_id * 1001 END AS BIGINT)
  FROM documents)"""


def raw_hits_cte(name: str = "raw_hits") -> str:
    return f"""{name}_e AS (
  SELECT event_id // 100 AS query_id, CAST(event_id % 3 AS INTEGER) AS shard_ord, event_id AS hit_ord,
         CASE WHEN event_id % 41 = 0 THEN -1
              ELSE (event_id // 100 * 7 + event_id % 23) % (SELECT count(*) FROM documents) END AS doc,
         value - 30 * floor(value / 30) AS s, event_id
  FROM events),
{name} AS (
  SELECT e.query_id, e.shard_ord, e.hit_ord, coalesce(d.lang, 'en') AS corpus_id,
         coalesce({doc_path('d.doc_id', 'd.source')}, 'missing/unknown.py') AS path,
         CAST(e.s AS DOUBLE) AS start_line, CAST(e.s + (e.event_id % 17) - 3 AS DOUBLE) AS end_line
  FROM {name}_e e LEFT JOIN documents d ON d.doc_id = e.doc)"""


def usage_cte(name: str = "usage") -> str:
    return f"""{name} AS (
  SELECT user_id AS session, event_type AS label, ts, event_id AS request_id,
         CAST(128 * (event_id % 50) AS BIGINT) AS prompt_tokens,
         CAST(128 * least(event_id % 50, event_id % 37) AS BIGINT) AS prompt_cache_hit_tokens,
         CAST(128 * (event_id % 50) - 128 * least(event_id % 50, event_id % 37) AS BIGINT) AS prompt_cache_miss_tokens,
         CAST(event_id % 400 AS BIGINT) AS completion_tokens,
         CAST((event_id % 400) // 2 AS BIGINT) AS reasoning_tokens
  FROM events)"""


def attempts_cte(name: str = "attempts") -> str:
    code = ("CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'signup' THEN 503 "
            "WHEN 'purchase' THEN 400 ELSE NULL END")
    return f"""{name} AS (
  SELECT CAST(event_id // 3 AS BIGINT) AS request_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt,
         CAST({code} AS INTEGER) AS status_code,
         'status ' || coalesce(CAST({code} AS VARCHAR), 'none') || ' on ' || event_type AS message
  FROM events)"""


def requests_cte(name: str = "requests") -> str:
    return f"""{name} AS (
  SELECT item_id AS query_id,
         CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS corpus_id,
         text AS query,
         CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'src1' ELSE 'src1/p2' END AS scope,
         CASE WHEN item_id % 2 = 0 THEN NULL ELSE ['.py'] END AS file_types
  FROM benchmark)"""


def requests_all_cte(name: str = "requests") -> str:
    return f"""{name}_one AS (
  SELECT item_id, text AS query,
         CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'src1' ELSE 'src1/p2' END AS scope,
         CASE WHEN item_id % 2 = 0 THEN NULL ELSE ['.py'] END AS file_types
  FROM benchmark),
{name} AS (
  SELECT item_id * 10 + c.i AS query_id, c.corpus_id, query, scope, file_types
  FROM {name}_one, (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es')) c(i, corpus_id))"""


# -- shard planning ---------------------------------------------------------------

def split_ctes(p: str, src: str, budget: int) -> str:
    """src: corpus_id, grp, grp_rank, parent, path, tokens -> p: corpus_id, grp_rank, path, tokens, shard_id, prefix."""
    rel = "string_split(substr(path, length(parent) + 1), '/')"
    return f"""{p}_b AS (SELECT *, {rel} AS segs FROM {src}),
{p}_a0 AS (SELECT corpus_id, grp, grp_rank, parent, path, tokens, segs, len(segs) - 1 AS nd,
                  unnest(generate_series(1, len(segs) - 1)) AS lvl FROM {p}_b),
{p}_a AS (SELECT corpus_id, grp, grp_rank, parent, path, tokens, nd, lvl,
                 parent || array_to_string(list_slice(segs, 1, lvl), '/') || '/' AS prefix FROM {p}_a0),
{p}_v AS (SELECT corpus_id, grp, prefix, min(lvl) AS ok_level FROM {p}_a GROUP BY corpus_id, grp, prefix
          HAVING sum(tokens) <= {budget} OR max(nd) <= min(lvl)),
{p}_f AS (SELECT a.corpus_id, a.grp, a.path, min(v.ok_level) AS ok_level, max(a.nd) AS nd,
                 any_value(a.tokens) AS tokens, any_value(a.parent) AS parent, any_value(a.grp_rank) AS grp_rank
          FROM {p}_a a LEFT JOIN {p}_v v ON a.corpus_id = v.corpus_id AND a.grp = v.grp AND a.prefix = v.prefix
          GROUP BY a.corpus_id, a.grp, a.path
          UNION ALL
          SELECT corpus_id, grp, path, NULL, 0, tokens, parent, grp_rank FROM {p}_b WHERE len(segs) = 1),
{p}_p AS (SELECT *, CASE WHEN ok_level IS NOT NULL THEN parent || array_to_string(list_slice({rel}, 1, ok_level), '/') || '/'
                         WHEN nd = 0 THEN parent
                         ELSE parent || array_to_string(list_slice({rel}, 1, nd), '/') || '/' END AS prefix
          FROM {p}_f),
{p} AS (SELECT corpus_id, grp_rank, path, tokens,
               CASE WHEN ok_level IS NOT NULL THEN substr(prefix, 1, length(prefix) - 1) ELSE prefix || '__root__' END AS shard_id,
               prefix FROM {p}_p)"""


def _finish(p: str, asg: str) -> str:
    return f"""{p}_o AS (SELECT corpus_id, shard_id,
                   CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY min(grp_rank), min(path)) AS INTEGER) AS shard_ord
            FROM {asg} GROUP BY corpus_id, shard_id),
{p} AS (SELECT a.corpus_id, a.shard_id, a.prefix, o.shard_ord, a.path, a.tokens
        FROM {asg} a JOIN {p}_o o ON a.corpus_id = o.corpus_id AND a.shard_id = o.shard_id)"""


def plan_ctes(p: str, src: str, budget: int) -> str:
    """Fresh plan of src (corpus_id, path, tokens) -> p: shard_files."""
    return f"""{p}_t AS (SELECT corpus_id, sum(tokens) AS total FROM {src} GROUP BY corpus_id),
{p}_fit AS (SELECT f.corpus_id, CAST(0 AS BIGINT) AS grp_rank, f.path, f.tokens, '__all__' AS shard_id, '' AS prefix
            FROM {src} f JOIN {p}_t t ON f.corpus_id = t.corpus_id WHERE t.total <= {budget}),
{p}_in AS (SELECT f.corpus_id, 'fresh' AS grp, CAST(0 AS BIGINT) AS grp_rank, '' AS parent, f.path, f.tokens
           FROM {src} f JOIN {p}_t t ON f.corpus_id = t.corpus_id WHERE t.total > {budget}),
{split_ctes(p + '_s', p + '_in', budget)},
{p}_asg AS (SELECT corpus_id, grp_rank, path, tokens, shard_id, prefix FROM {p}_fit
            UNION ALL SELECT corpus_id, grp_rank, path, tokens, shard_id, prefix FROM {p}_s),
{_finish(p, p + '_asg')}"""


def stored_cte(name: str, plan: str) -> str:
    return f"{name} AS (SELECT DISTINCT corpus_id, shard_id, prefix, shard_ord FROM {plan})"


def claim_ctes(p: str, src: str, stored: str) -> str:
    """C4 -> p: corpus_id, path, tokens, shard_id, prefix, claim_rank."""
    return f"""{p}_ord AS (SELECT corpus_id, shard_id, prefix,
                     row_number() OVER (PARTITION BY corpus_id ORDER BY length(prefix) DESC, shard_ord) AS claim_rank
              FROM {stored}),
{p}_c0 AS (SELECT corpus_id, path, tokens, string_split(path, '/') AS segs FROM {src}),
{p}_c1 AS (SELECT corpus_id, path, tokens, segs, len(segs) - 1 AS nd,
                  unnest(generate_series(1, len(segs) - 1)) AS lvl FROM {p}_c0),
{p}_cand AS (SELECT corpus_id, path, tokens, nd, array_to_string(list_slice(segs, 1, lvl), '/') || '/' AS prefix FROM {p}_c1
             UNION ALL SELECT corpus_id, path, tokens, len(segs) - 1, '' FROM {p}_c0),
{p} AS (SELECT c.corpus_id, c.path, any_value(c.tokens) AS tokens, arg_min(o.shard_id, o.claim_rank) AS shard_id,
               arg_min(o.prefix, o.claim_rank) AS prefix, CAST(min(o.claim_rank) AS BIGINT) AS claim_rank
        FROM {p}_cand c JOIN {p}_ord o ON c.corpus_id = o.corpus_id AND c.prefix = o.prefix
        WHERE c.prefix <> '' OR o.shard_id = '__all__' OR c.nd = 0
        GROUP BY c.corpus_id, c.path)"""


def resolve_ctes(p: str, src: str, stored: str, budget: int) -> str:
    """D5 -> p: shard_files of the resolved plan."""
    return f"""{p}_pl AS (SELECT DISTINCT corpus_id FROM {stored}),
{p}_mine AS (SELECT corpus_id, path, tokens FROM {src} WHERE corpus_id IN (SELECT corpus_id FROM {p}_pl)),
{p}_frsrc AS (SELECT corpus_id, path, tokens FROM {src} WHERE corpus_id NOT IN (SELECT corpus_id FROM {p}_pl)),
{plan_ctes(p + '_fr', p + '_frsrc', budget)},
{claim_ctes(p + '_cl', p + '_mine', stored)},
{p}_gt AS (SELECT corpus_id, shard_id, sum(tokens) AS gt FROM {p}_cl GROUP BY corpus_id, shard_id),
{p}_keep AS (SELECT c.corpus_id, c.claim_rank AS grp_rank, c.path, c.tokens, c.shard_id, c.prefix
             FROM {p}_cl c JOIN {p}_gt g ON c.corpus_id = g.corpus_id AND c.shard_id = g.shard_id WHERE g.gt <= {budget}),
{p}_in AS (SELECT c.corpus_id, c.shard_id AS grp, c.claim_rank AS grp_rank, c.prefix AS parent, c.path, c.tokens
           FROM {p}_cl c JOIN {p}_gt g ON c.corpus_id = g.corpus_id AND c.shard_id = g.shard_id WHERE g.gt > {budget}
           UNION ALL
           SELECT m.corpus_id, chr(0) || 'orphans', CAST(1099511627776 AS BIGINT), '', m.path, m.tokens
           FROM {p}_mine m ANTI JOIN {p}_cl c ON m.corpus_id = c.corpus_id AND m.path = c.path),
{split_ctes(p + '_s', p + '_in', budget)},
{p}_asg AS (SELECT corpus_id, grp_rank, path, tokens, shard_id, prefix FROM {p}_keep
            UNION ALL SELECT corpus_id, grp_rank, path, tokens, shard_id, prefix FROM {p}_s),
{_finish(p + '_rs', p + '_asg')},
{p} AS (SELECT * FROM {p}_rs UNION ALL SELECT * FROM {p}_fr)"""


def plan_table_sql(sf: str) -> str:
    return (f"SELECT corpus_id, shard_id, prefix, shard_ord, CAST(count(*) AS BIGINT) AS n_files, "
            f"CAST(sum(tokens) AS BIGINT) AS tokens FROM {sf} GROUP BY corpus_id, shard_id, prefix, shard_ord")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def stored_plan_ctes(budget: int = 4000) -> list[str]:
    """files_v1 planned at ``budget`` as the stored plan ``stored``."""
    return [files_cte("files_v1", "v1"), plan_ctes("plan_v1", "files_v1", budget), stored_cte("stored", "plan_v1")]


def ignore_rules_sql(patterns: list[str]) -> str:
    """Compiled rule rows for every corpus of ``files`` (regexes computed by the same compiler)."""
    rows = []
    for i, p in enumerate(patterns):
        rx, neg, d = glob_to_regex(p)
        if rx is not None:
            rows.append(f"({i}, '{rx}', {str(neg).upper()}, {str(d).upper()})")
    vals = ", ".join(rows)
    return f"rules AS (SELECT * FROM (VALUES {vals}) t(ord, regex, negated, dir_only))"


def allow_list_sql() -> str:
    return "[" + ", ".join(f"'{e}'" for e in O.DEFAULT_ALLOW_LIST) + "]"
