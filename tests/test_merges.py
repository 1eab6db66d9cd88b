"""Ranks, block joins, trees as ordered rows and scope pruning: equal to their plain forms, also where
one corpus, folder or key holds most rows."""

import random

from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import context as X
from corpusflow.operators import joins as J
from corpusflow.operators import requests as R
from corpusflow.operators import shards as S
from corpusflow.operators.order import ranked


def test_ranked_equals_sorting(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", v) for v in rng.sample(range(100_000), 3000)]
    got = ranked(spark.createDataFrame(rows, "k string, v long").repartition(7), ["k"], [F.col("v").desc()], "at").collect()
    want = {(k, v): i + 1 for key in {k for k, _ in rows}
            for i, (k, v) in enumerate(sorted(((k, v) for k, v in rows if k == key), key=lambda r: -r[1]))}
    assert {(r.k, r.v): r["at"] for r in got} == want and len(got) == len(rows)


def test_block_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 16)
    left = spark.createDataFrame([("a" if i % 4 else f"x{i}", i) for i in range(600)], "k string, l long")
    right = spark.createDataFrame([("a" if i % 3 else f"x{i}", i) for i in range(200)], "k string, r long")
    plain = sorted(tuple(r) for r in left.join(right, "k").collect())
    assert plain and sorted(tuple(r) for r in J.block_join(left, right, ["k"], "l", "r").select("k", "l", "r").collect()) == plain
    assert J.block_join(left, right.limit(0), ["k"], "l", "r").count() == 0


def test_scope_pruning_equals_the_plain_test(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    names = ["", "a/", "a/b/", "a/b/c/", "a//b/", "ab/", "b/", "b/a/", "ü/a/", "a/b/__root__x/"]
    plan = [("big" if rng.random() < 0.8 else "small", f"s{i}", rng.choice(names), i) for i in range(60)] + [("one", "__all__", "", 0)]
    scopes = [None, "", "a", "a/", "a/b", "a/b/c/d", "ab", "b", "/", "a//b", "ü", "none", "a/b/"]
    asked = [(i, rng.choice(["big", "big", "small", "one", "absent", None]), rng.choice(scopes), f"q{i}") for i in range(200)]
    p = spark.createDataFrame(plan, "corpus_id string, shard_id string, prefix string, shard_ord int")
    r = spark.createDataFrame(asked, "query_id long, corpus_id string, scope string, query string")
    r = r.unionByName(r.limit(3))
    plain = r.join(p, "corpus_id").where(T.scope_matches("prefix", "scope")).select("query_id", "shard_id", "scope", "prefix")
    got = R.prune_by_scope(r, p)
    assert got.columns == [*r.columns, "shard_id", "prefix", "shard_ord", "n_shards"]
    key = lambda df: sorted(map(str, df.select("query_id", "shard_id", "scope", "prefix").collect()))
    assert key(got) == key(plain) and len(key(got)) > 1000
    sizes = {c: sum(row[0] == c for row in plan) for c in ("big", "small")}
    assert {(x.corpus_id, x.n_shards) for x in got.collect()} == {*sizes.items(), ("one", None)}


def _tree_by_hand(files, own):
    lines = []
    dir_of = lambda p: p.rpartition("/")[0] or "."
    for d in sorted({dir_of(p) for p in files}):
        here = sorted(p for p in files if dir_of(p) == d)
        mine = [p for p in here if p in own]
        if not mine:
            lines.append(f"{d}/ ({len(here)} files, other shards)")
            continue
        lines += [f"{d}/"] + ["  " + p.rpartition("/")[2] for p in mine]
        if len(here) > len(mine):
            lines.append(f"  ({len(here) - len(mine)} more files, other shards)")
    return "\n".join(lines)


def test_shard_trees_equal_the_merge_by_hand(spark, monkeypatch):
    monkeypatch.setattr(X, "PAGE", 3)
    rng = random.Random(7)
    rows = []
    for c, n in (("k", 120), ("m", 9), ("one", 1)):
        paths = {"/".join(rng.choice("abcd") for _ in range(rng.randrange(0, 4))) for _ in range(n)}
        rows += [(c, f"{p}/f{rng.randrange(3)}".lstrip("/"), f"s{rng.randrange(4)}") for p in paths]
    rows = list({(c, p): (c, p, s) for c, p, s in rows}.values())
    df = spark.createDataFrame(rows, "corpus_id string, path string, shard_id string")
    got = {(r.corpus_id, r.shard_id): r.tree for r in X.shard_directory_tree(df.select("corpus_id", "path"), df).collect()}
    want = {(c, s): _tree_by_hand({p for k, p, _ in rows if k == c}, {p for k, p, t in rows if (k, t) == (c, s)})
            for c, _, s in rows}
    assert got == want
    empty = df.limit(0)
    assert X.shard_directory_tree(empty.select("corpus_id", "path"), empty).count() == 0 and X.directory_tree(empty).count() == 0


def test_shard_trees_make_no_row_per_directory_of_others(spark):
    """5,000 directories, 10 shards: rows follow pages and own entries, not shards x directories."""
    files = spark.range(5000).select(F.lit("k").alias("corpus_id"), F.format_string("d%05d/f", "id").alias("path"),
                                     F.concat(F.lit("s"), F.floor(F.col("id") / 500).cast("string")).alias("shard_id"))
    rows = X.shard_tree_rows(files.select("corpus_id", "path"), files)
    n = rows.count()
    assert n < 2 * 5000 + 10 * (5000 // X.PAGE + 3)
    assert X.tree_text(rows, ["corpus_id", "shard_id"]).select(F.size(F.split("tree", "\n")).alias("n")).distinct().collect() == [(5000 + 500,)]


def test_attempts_follow_their_kinds(spark):
    rows = [(1, 1, 200, "no_tool_call", "m"), (1, 2, 200, "ok", "m"), (2, 1, 200, "no_tool_call", "m"), (2, 2, 200, "no_tool_call", "m"),
            (2, 3, 200, "no_tool_call", "m"), (3, 1, 200, "missing_usage", "m"), (4, 1, 503, None, "busy"), (4, 2, 400, None, "bad"),
            (5, 1, 200, "parse_error", "unreadable"), (5, 2, None, None, "lost")]
    a = spark.createDataFrame(rows, "request_id long, attempt int, status_code int, attempt_kind string, message string")
    got = {r.request_id: (r.final_attempt, r.outcome, r.error, r.exhausted) for r in R.resolve_attempts(a).collect()}
    assert got[1] == (2, "ok", None, False)
    assert got[2] == (3, "failed", "no tool call after 3 attempts", True)
    assert got[3][2].startswith("Failed after 1 retries: ") and got[3][3]
    assert got[4] == (2, "failed", "API error 400: bad", False)
    assert got[5] == (2, "failed", "Failed after 2 retries: lost", True)
    plain = R.resolve_attempts(a.drop("attempt_kind").where("request_id = 4 or status_code = 503")).first()
    assert plain.final_attempt == 2


def test_stored_claims_are_ordered_by_length_then_rank(spark):
    p = spark.createDataFrame([("k", f"s{i}", "a/" * (i % 3), i) for i in range(7)], "corpus_id string, shard_id string, prefix string, shard_ord int")
    order = [r.shard_id for r in S.stored_claim_order(p).orderBy("claim_rank").collect()]
    assert order == ["s2", "s5", "s1", "s4", "s0", "s3", "s6"]
