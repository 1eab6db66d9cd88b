"""Scalar column functions (rows B1-B15 of the survey).

Every function returns a ``Column`` built from built-in Spark SQL functions,
so the expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import options as O


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- B1..B3, B6: file text -------------------------------------------------

def normalize_text(content) -> Column:
    """UTF-8 decode with replacement of bad bytes, then CRLF -> LF (lone CR kept)."""
    c = _c(content)
    return F.replace(F.make_valid_utf8(c.cast("string")), F.lit("\r\n"), F.lit("\n"))


def content_hash(content) -> Column:
    """SHA-256 hex digest of the normalized text."""
    return F.sha2(_c(content), 256)


def proxy_tokens(content) -> Column:
    """Default token counter: ceil(UTF-8 bytes / 4) as BIGINT."""
    return F.ceil(F.octet_length(_c(content)) / F.lit(4)).cast("bigint")


def line_count(content) -> Column:
    """Number of lines as ``split('\\n').length``: '' has 1, 'x\\n' has 2."""
    return F.size(F.split(_c(content), "\n")).cast("bigint")


def number_lines(content, first_line=None) -> Column:
    """``<n>\\t<line>`` joined by newlines; numbering starts at ``first_line`` (default 1)."""
    start = F.lit(1) if first_line is None else _c(first_line)
    lines = F.split(_c(content), "\n")
    return F.array_join(
        F.transform(lines, lambda x, i: F.concat((i + start).cast("string"), F.lit("\t"), x)), "\n"
    )


# -- B4, B5, B11, A12: paths -----------------------------------------------

def dir_of(path) -> Column:
    """Parent directory, '.' for a top-level file."""
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def base_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def normalize_path(path) -> Column:
    """Backslashes to slashes, leading './' and '/' removed."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(p, r"^(\./|/)+", "")


def extension(path) -> Column:
    """Lower-cased last extension of the base name ('' for dotfiles, no dot)."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def next_segment(path, prefix) -> Column:
    """Next directory segment below ``prefix``, or the direct-child marker."""
    rel = F.substring(_c(path), F.length(_c(prefix)) + 1, 1 << 30)
    return F.when(F.instr(rel, "/") == 0, F.lit(O.ROOT_SHARD)).otherwise(F.substring_index(rel, "/", 1))


def state_key(shard_id) -> Column:
    """Storage key of a shard id ('/' -> '__'); for export only, it can collide."""
    return F.replace(_c(shard_id), F.lit("/"), F.lit("__"))


def dir_depth(path) -> Column:
    """Number of directories above a file."""
    return (F.size(F.split(_c(path), "/")) - 1).cast("int")


# -- B7..B9: rendering -----------------------------------------------------

def render_file(path, content, n_lines, tag=None) -> Column:
    """File block: header with path, optional tag and line span, then numbered lines."""
    label = F.lit("") if tag is None else F.when(_c(tag).isNull(), F.lit("")).otherwise(
        F.concat(F.lit(" ["), _c(tag), F.lit("]")))
    head = F.format_string(O.FMT_FILE_HEADER, _c(path), label, _c(n_lines).cast("string"))
    return F.concat(head, F.lit("\n"), number_lines(content))


def deleted_marker(path) -> Column:
    return F.format_string(O.FMT_DELETED_MARKER, _c(path))


def tree_status(status) -> Column:
    s = _c(status)
    return (F.when(s.isin("modified", "added"), F.lit(O.LABEL_CHANGED))
            .when(s == "deleted", F.lit(O.LABEL_DELETED))
            .otherwise(F.lit("")))


def render_query_turn(tree, query, scope=None, file_types=None, shard_id=None, n_shards=None) -> Column:
    """Last message of a request: shard line, tree, scope and type hints, query.

    Absent parts are omitted (our own wording)."""
    parts = []
    if shard_id is not None:
        parts.append(F.when(_c(shard_id).isNotNull(), F.concat(
            F.lit("[shard: "), _c(shard_id), F.lit(", "), _c(n_shards).cast("string"),
            F.lit(" shards in all]\n\n"))).otherwise(F.lit("")))
    parts.append(F.concat(F.lit("Directory tree:\n"), F.coalesce(_c(tree), F.lit("")), F.lit("\n\n")))
    if scope is not None:
        sc = _c(scope)
        parts.append(F.when(sc.isNotNull() & (sc != ""), F.concat(F.lit("Search scope: "), sc, F.lit("\n")))
                     .otherwise(F.lit("")))
    if file_types is not None:
        ft = _c(file_types)
        parts.append(F.when(F.coalesce(F.size(ft), F.lit(0)) > 0,
                            F.concat(F.lit("File types: "), F.array_join(ft, ", "), F.lit("\n")))
                     .otherwise(F.lit("")))
    parts.append(F.concat(F.lit("\nQuery: "), _c(query)))
    return F.concat(*parts)


# -- B10, B12..B15: numeric helpers ----------------------------------------

def js_round(x) -> Column:
    """Half-up rounding as ``Math.round``."""
    return F.floor(_c(x) + F.lit(0.5))


def clean_range(start, end, n_lines) -> tuple[Column, Column, Column]:
    """Returns (start, end, valid): rounded, floored at 1, swapped, end clamped,
    ``valid`` false when start lies past the last line."""
    s = F.greatest(F.lit(1), js_round(start))
    e = F.greatest(F.lit(1), js_round(end))
    lo, hi = F.least(s, e), F.greatest(s, e)
    n = _c(n_lines)
    return lo.cast("bigint"), F.least(hi, n).cast("bigint"), lo <= n


def scope_matches(prefix, scope) -> Column:
    """Empty prefix matches all; otherwise one of prefix and 'scope/' starts with the other.
    NULL or empty scope means no pruning."""
    p, s = _c(prefix), _c(scope)
    ns = F.when(F.endswith(s, F.lit("/")), s).otherwise(F.concat(s, F.lit("/")))
    return (s.isNull() | (s == "") | (p == "")
            | F.startswith(ns, p) | F.startswith(p, ns))


def is_retryable(status_code) -> Column:
    """Retryable: no code, or one of the retryable codes."""
    c = _c(status_code)
    return c.isNull() | c.isin(*O.RETRYABLE_STATUS)


def backoff_ms(attempt, jitter) -> Column:
    """``min(base * 2^(n-1), cap)`` plus ``jitter * base * 0.5`` (jitter in [0, 1)), half-up rounded."""
    base = F.least(F.lit(float(O.BACKOFF_BASE_MS)) * F.pow(F.lit(2.0), _c(attempt) - 1),
                   F.lit(float(O.BACKOFF_CAP_MS)))
    return js_round(base + _c(jitter) * base * F.lit(O.BACKOFF_JITTER)).cast("bigint")


def hit_ratio(hit, prompt) -> Column:
    """Cache-hit share; 0 when the prompt count is 0 or absent."""
    h, p = _c(hit), _c(prompt)
    return F.when(F.coalesce(p, F.lit(0)) > 0, h.cast("double") / p).otherwise(F.lit(0.0))
