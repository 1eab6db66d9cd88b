"""Options and fixed values.

Operators take plain arguments (a budget, a threshold); this module holds the
defaults and the range checks that a service front end applies before calling
them, so that small test tables can still be sharded with tiny budgets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced, so they are
# stated plainly here, together, in their natural order.
# ---------------------------------------------------------------------------

#: Default extension allow-list (95 entries), in its documented order.
DEFAULT_ALLOW_LIST: tuple[str, ...] = (
    ".py", ".pyi", ".pyx",
    ".c", ".h", ".cpp", ".cxx", ".cc", ".hpp", ".hxx",
    ".java",
    ".cs",
    ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts",
    ".vb", ".vbs",
    ".sql",
    ".r", ".R",
    ".pas", ".dpr",
    ".pl", ".pm",
    ".f", ".f90", ".f95", ".f03",
    ".php",
    ".go",
    ".rs",
    ".m",
    ".inl",
    ".asm", ".s", ".S",
    ".swift",
    ".adb", ".ads",
    ".kt", ".kts",
    ".scala",
    ".rb",
    ".lua",
    ".sh", ".bash", ".zsh",
    ".dart",
    ".ex", ".exs", ".erl",
    ".hs",
    ".zig",
    ".nim",
    ".ml", ".mli",
    ".clj", ".cljs", ".cljc",
    ".glsl", ".vert", ".frag", ".comp", ".geom", ".tesc", ".tese",
    ".rgen", ".rchit", ".rahit", ".rmiss", ".rint", ".rcall",
    ".mesh", ".task",
    ".hlsl", ".hlsli", ".fx",
    ".wgsl",
    ".metal",
    ".vue", ".svelte",
    ".html", ".htm", ".css", ".scss", ".less",
    ".yaml", ".yml", ".toml",
    ".ispc",
)

#: Directory holding the engine's own state inside a workspace (never indexed).
RESERVED_PREFIXES: tuple[str, ...] = (".corpusflow/",)
#: Directories always ignored by the directory walk.
ALWAYS_IGNORED: tuple[str, ...] = (".git", ".corpusflow")

DEFAULT_CHANGE_THRESHOLD = 0.1
DEFAULT_MAX_CONTEXT_TOKENS = 900_000
MIN_MAX_CONTEXT_TOKENS = 100_000
MAX_MAX_CONTEXT_TOKENS = 1_000_000
#: Two ranges of one file merge when next.start <= current.end + RANGE_GAP.
RANGE_GAP = 3
MAX_ATTEMPTS = 3
RETRYABLE_STATUS = (429, 500, 503)
BACKOFF_BASE_MS = 1000
BACKOFF_CAP_MS = 8000
BACKOFF_JITTER = 0.5

#: Model context size (tokens): a prompt beyond it cannot be answered, so a base
#: text is only assembled for shards up to this size.

#: Shard id markers.
ALL_SHARD = "__all__"
ROOT_SHARD = "__root__"

#: Price table, CNY per 1M tokens: (model, input cache hit, input cache miss, output).
PRICES: tuple[tuple[str, float, float, float], ...] = (
    ("deepseek-v4-flash", 0.02, 1.0, 2.0),
    ("deepseek-v4-pro", 0.025, 3.0, 6.0),
)

#: Output texts. They must read the same as the reference's, so they are fixed
#: values; patterns are printf-style (Spark's ``format_string`` and Python ``%``).
NOTICE_NO_RESULTS = "No matching code found."
NOTICE_NONE_KNOWN = "No matching files found in snapshot."
SHARD_ERRORS_HEADER = "\n\n--- Shard Errors ---\n"
FMT_FILE_HEADER = "--- %s%s (lines 1-%s) ---"
FMT_DELETED_MARKER = "--- %s [DELETED] ---"
TAG_UPDATED = "UPDATED"
LABEL_CHANGED = " [CHANGED]"
LABEL_DELETED = " [DELETED]"
FMT_OTHER_SHARDS_DIR = "%s/ (%s files, other shards)"
FMT_OTHER_SHARDS_MORE = "  (%s more files, other shards)"
FMT_SNIPPET_HEADER = "--- %s:%s-%s ---"
FMT_SHARD_ERROR = '[shard "%s" (%s)]: %s'
FMT_API_ERROR = "API error %s: %s"
FMT_RETRIES_EXHAUSTED = "Failed after %s retries: %s"
FMT_NO_TOOL_CALL = "no tool call after %s attempts"
FMT_PARSE_FAILURE = "Failed to parse tool call arguments: %s"
MSG_NO_USAGE = "No usage data in stream response"
ERROR_PREFIX = "Error: "


@dataclass(frozen=True)
class Options:
    """Service-level options with the accepted ranges applied silently."""

    change_threshold: float = DEFAULT_CHANGE_THRESHOLD
    max_context_tokens: int = DEFAULT_MAX_CONTEXT_TOKENS
    allow_list: tuple[str, ...] = field(default=DEFAULT_ALLOW_LIST)
    model: str = "deepseek-v4-flash"
    #: Requests of one shard handled by one Python group; larger fan-outs
    #: are split into several groups that each receive the shard text once.
    requests_per_group: int = 64

    @staticmethod
    def from_values(change_threshold=None, max_context_tokens=None, **kw) -> "Options":
        """Settings given as text read their leading number (``"0.2x"`` is 0.2,
        ``"500000.7"`` is 500000); anything out of range keeps the default."""
        ct = DEFAULT_CHANGE_THRESHOLD
        m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", str(change_threshold))
        if change_threshold is not None and m and 0 < float(m.group(0)) < 1:
            ct = float(m.group(0))
        mct = DEFAULT_MAX_CONTEXT_TOKENS
        m = re.match(r"\s*[+-]?\d+", str(max_context_tokens))
        if max_context_tokens is not None and m and MIN_MAX_CONTEXT_TOKENS <= int(m.group(0)) <= MAX_MAX_CONTEXT_TOKENS:
            mct = int(m.group(0))
        return Options(change_threshold=ct, max_context_tokens=mct, **kw)
