"""Index a workspace directory and answer search requests over it.

Usage: python examples/workspace_search.py <workspace_dir> <state_dir> "query" [scope]

The responder here is the offline passage locator (finds the query text
verbatim); plug a real model client in with the same call signature
(``messages -> {"arguments", "content", "usage"}``).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from corpusflow import options as O  # noqa: E402
from corpusflow.fixtures.responders import PassageLocator  # noqa: E402
from corpusflow.plans.search import search  # noqa: E402
from corpusflow.session import build_session  # noqa: E402
from corpusflow.sources import files as SF  # noqa: E402
from corpusflow.sources import ignore as IG  # noqa: E402


def index(spark, root: str, corpus_id: str = "workspace"):
    raw = SF.exclude_reserved(SF.scan_files(spark, root, corpus_id), anywhere=True)
    ignore_file = os.path.join(root, ".gitignore")
    if os.path.exists(ignore_file):  # hidden files are read by explicit path
        rules = spark.read.text(ignore_file).select(
            F.lit(corpus_id).alias("corpus_id"), F.monotonically_increasing_id().alias("ord"),
            F.col("value").alias("pattern"))
        raw = IG.filter_ignored(raw, rules)
    raw = SF.filter_extensions(raw, SF.allow_table(spark))
    return SF.snapshot(raw)


def main():
    root, state, query = sys.argv[1], sys.argv[2], sys.argv[3]
    scope = sys.argv[4] if len(sys.argv) > 4 else None
    spark = build_session("local[4]", 8)
    files = index(spark, root)
    req = spark.createDataFrame([(1, "workspace", query, scope, None)],
                                "query_id long, corpus_id string, query string, scope string, file_types array<string>")
    out = search(req, files, PassageLocator(), budget=O.DEFAULT_MAX_CONTEXT_TOKENS, state_root=state,
                 snapshot_ts=int(__import__("time").time() * 1000))
    for row in out["answers"].collect():
        print(row.text)


if __name__ == "__main__":
    main()
