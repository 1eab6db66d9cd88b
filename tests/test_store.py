"""Incremental snapshots over a store of bodies (A1, C2), the manifest (A8-A10) and streamed requests."""

import os

import pytest
from pyspark.sql import functions as F

from corpusflow import options as O
from corpusflow.fixtures import responders as RS
from corpusflow.operators import context as X
from corpusflow.operators import requests as R
from corpusflow.plans.refresh import refresh, refresh_store
from corpusflow.sources import files as SF
from corpusflow.sources import manifest as M
from corpusflow.sources import state as ST
from corpusflow.sources import store


def write(root, rel, text, mtime=1_700_000_000):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    os.utime(p, (mtime, mtime))


def bodies(spark, root):
    """Rows of each body folder, by their number."""
    return sorted(r["count"] for r in spark.read.parquet(f"{root}/bodies").groupBy("body").count().collect())


def test_only_changed_files_are_read(spark, tmpdir_path):
    tree, root = os.path.join(tmpdir_path, "tree"), os.path.join(tmpdir_path, "store")
    for i in range(6):
        write(tree, f"d{i % 2}/f{i}.py", f"x = {i}\n")
    first = store.scan(spark, tree, root, "k")
    assert first.where("reused").count() == 0 and first.count() == 6 and bodies(spark, root) == [6]
    write(tree, "d0/f0.py", "y = 9\n")  # same size and time: its body is not looked at
    write(tree, "d1/f1.py", "longer text\r\nhere\n")
    write(tree, "d1/f3.py", "x = 3\n", mtime=1_700_000_100)  # touched: read again, same hash
    write(tree, "d1/new.py", "")
    os.remove(os.path.join(tree, "d0/f2.py"))
    second = store.scan(spark, tree, root, "k")
    rows = {r.path: r for r in second.collect()}
    assert sorted(rows) == ["d0/f0.py", "d0/f4.py", "d1/f1.py", "d1/f3.py", "d1/f5.py", "d1/new.py"]
    assert sorted(p for p, r in rows.items() if not r.reused) == ["d1/f1.py", "d1/f3.py", "d1/new.py"]
    assert bodies(spark, root) == [3, 6]
    old = {r.path: r for r in first.collect()}
    assert rows["d0/f0.py"].hash == old["d0/f0.py"].hash and rows["d1/f3.py"].hash == old["d1/f3.py"].hash
    texts = {r.path: r.content for r in store.with_content(second, root).collect()}
    assert texts["d0/f0.py"] == "x = 0\n" and texts["d1/f1.py"] == "longer text\nhere\n" and texts["d1/new.py"] == "" and len(texts) == 6
    assert rows["d1/f1.py"].n_lines == 3 and rows["d1/f1.py"].hash == second.sparkSession.createDataFrame([("longer text\nhere\n",)], "t string").select(F.sha2("t", 256)).first()[0]
    # a third snapshot reads nothing, and equals a plain scan of the files' present sizes and times
    assert store.scan(spark, tree, root, "k").where("not reused").count() == 0
    assert store.compact(spark, root) == 3 and bodies(spark, root) == [6]
    assert {r.path: r.content for r in store.with_content(store.stored_rows(spark, root), root).collect()} == texts


def test_vanished_null_and_repeated_files(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "store")
    text = spark.createDataFrame([("a", "f", "one"), ("a", "g", "two"), ("b", "f", "three")], "corpus_id string, path string, content string")
    listing = spark.createDataFrame([("a", "f", 1, 3), ("a", "f", 1, 3), ("a", "g", None, 3), ("a", "gone", 1, 1), ("b", "f", 1, 5)], "corpus_id string, path string, mtime_ms long, size long")
    read = lambda rows: rows.join(text, ["corpus_id", "path"])
    assert sorted((r.corpus_id, r.path) for r in store.snapshot(listing, read, root).collect()) == [("a", "f"), ("a", "g"), ("b", "f")]
    again = store.snapshot(listing.where("corpus_id = 'a'"), read, root)
    assert {r.path: r.reused for r in again.collect()} == {"f": True, "g": False}  # no time: never taken as unchanged
    assert store.stored_rows(spark, root).where("corpus_id = 'b'").count() == 1  # another corpus keeps its rows
    none = store.snapshot(listing.limit(0), read, root)
    assert none.count() == 0 and store.stored_rows(spark, root).count() == 3


def test_refresh_on_the_store_equals_refresh_on_texts(spark, tmpdir_path):
    rows = [("k", f"d{i % 4}/f{i}.py", f"x = {i}\n" * (20 + i), 1000 * i) for i in range(40)]
    full = SF.snapshot(spark.createDataFrame(rows, "corpus_id string, path string, content string, mtime_ms long"))
    full = full.withColumn("size", F.octet_length("content").cast("bigint"))
    edited = full.withColumn("content", F.when(F.col("path") == "d1/f5.py", F.lit("changed" * 60)).otherwise(F.col("content")))
    edited = SF.snapshot(edited.select("corpus_id", "path", "content", "mtime_ms")).withColumn("size", F.octet_length("content").cast("bigint"))
    seen = []

    def reader(files):
        def read(missing):
            seen.append(missing.count())
            return missing.join(files.select("corpus_id", "path", "content"), ["corpus_id", "path"])
        return read

    a, b, s = (os.path.join(tmpdir_path, x) for x in ("plain", "store-state", "store"))
    for ts, files in enumerate((full, edited), 1):
        want = refresh(files, a, budget=600, snapshot_ts=ts)["decisions"]
        got = refresh_store(files.select("corpus_id", "path", "mtime_ms", "size"), reader(files), s, b, budget=600, snapshot_ts=ts)["decisions"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert seen == [40, 1]
    for table in ST.TABLES:
        assert sorted(map(tuple, ST.read_state(spark, a, table).collect())) == sorted(map(tuple, ST.read_state(spark, b, table).collect()))


def state_rows(spark, corpus, n):
    return (spark.createDataFrame([(corpus, "s", n, "txt", n)], ST.BASE_SHARDS_SCHEMA), spark.createDataFrame([(corpus, "s", "a.py", "h", n)], ST.BASE_FILES_SCHEMA),
            spark.createDataFrame([(corpus, "s", "s/", 1, "abc", n)], ST.PLAN_SCHEMA))


def test_two_writers_and_neither_is_lost(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "state")
    ST.write_state(root, *state_rows(spark, "k", 1))
    seen = M.read(spark, root)
    ST.write_state(root, *state_rows(spark, "k", 2), seen=seen, mark="s-1")
    # a second writer that read the same state does not overwrite the first, one of another corpus gets through
    with pytest.raises(M.Conflict) as lost:
        ST.write_state(root, *state_rows(spark, "k", 3), seen=seen)
    assert lost.value.corpora == ["k"]
    ST.write_state(root, *state_rows(spark, "other", 4), seen=seen)
    with pytest.raises(M.Conflict):
        ST.write_state(root, *state_rows(spark, "third", 5), mark="s-1")
    tokens = {r.corpus_id: r.base_token_count for r in ST.read_state(spark, root, "base_shards").collect()}
    assert tokens == {"k": 2, "other": 4}
    # marks outlast the folders, and one number a series is kept
    ST.write_state(root, *state_rows(spark, "k", 6), mark="s-2")
    assert ST.drop_superseded(spark, root) == 2
    assert [ST.has_mark(spark, root, m) for m in ("s-1", "s-2", "s-3", "t-1")] == [True, True, False, False]
    assert M.read(spark, root).marks == {"s": 2}
    assert ST.read_state(spark, root, "base_shards", M.read(spark, root)).count() == 2


def test_a_number_is_committed_once(spark, tmpdir_path):
    new = M.Manifest(1, {"k": "a"})
    assert M._try_commit(spark, tmpdir_path, new) and not M._try_commit(spark, tmpdir_path, M.Manifest(1, {"k": "b"}))
    assert M.read(spark, tmpdir_path).entries == {"k": "a"}
    assert [f for f in os.listdir(f"{tmpdir_path}/_manifests") if not f.startswith(".")] == ["1"]


def test_refresh_starts_again_after_another_writer(spark, tmpdir_path, monkeypatch):
    files = SF.snapshot(spark.createDataFrame([("k", "a.py", "x = 1\n")], "corpus_id string, path string, content string"))
    real, rivals = ST.write_state, [1]

    def write(root, *tables, **kw):
        if rivals:
            rivals.pop()
            real(root, *state_rows(spark, "k", 7))
        return real(root, *tables, **kw)

    monkeypatch.setattr(ST, "write_state", write)
    assert refresh(files, tmpdir_path, snapshot_ts=9)["version"] == 2
    assert ST.read_state(spark, tmpdir_path, "shard_plan").first().snapshot_ts == 9


def asked(spark, responder, blocks, n=5):
    requests = spark.createDataFrame([(i, "k", "s", 1, 2, f"q{i}", None, None) for i in range(n)],
                                     "query_id long, corpus_id string, shard_id string, shard_ord int, n_shards long, query string, scope string, file_types array<string>")
    trees = spark.createDataFrame([("k", "s", X.TREE, 4, "", "./")], "corpus_id string, shard_id string, part int, ord long, path string, block string")
    return R.run_requests(requests, blocks, trees, responder, requests_per_group=2, sleep=False).collect()


def test_an_oversize_shard_is_streamed_block_by_block(spark):
    files = spark.range(3000).select(F.lit("k").alias("corpus_id"), F.lit("s").alias("shard_id"), F.format_string("f%05d", "id").alias("path"),
                                     F.repeat(F.lit("x = 1\n"), 1000).alias("content"), F.lit(1001).alias("n_lines"), F.lit(0).alias("commit_time"))
    rows = asked(spark, RS.CountingResponder(), X.base_blocks(files))
    # 30 MB of text; each request's session saw all 3,000 blocks, each only some KB
    assert [(r.query_id, r.prompt_tokens, r.error) for r in sorted(rows, key=lambda r: r.query_id)] == [(i, 3000, None) for i in range(5)]
    assert all(r.completion_tokens < 15_000 for r in rows)
    some = X.base_blocks(files, excluded=files.where("path < 'f01000'").select("corpus_id", "path"))
    assert {r.prompt_tokens for r in asked(spark, RS.CountingResponder(), some)} == {2000}


def test_a_session_that_breaks_fails_its_requests_only(spark):
    files = spark.createDataFrame([("k", "s", "a", "fine", 1, 0), ("k", "s", "b", "broken", 1, 0)],
                                  "corpus_id string, shard_id string, path string, content string, n_lines long, commit_time long")
    rows = asked(spark, RS.CountingResponder(fail_on="broken"), X.base_blocks(files))
    assert len(rows) == 5 and all(r.error == "Failed after 3 retries: lost" and r.attempts == 3 for r in rows)


def test_blocks_joined_in_order_are_the_stored_texts(spark):
    files = spark.createDataFrame([("k", "s", p, f"text of {p}\n", 2, 3, t) for p, t in (("b", 1), ("a", 2), ("c", 1))],
                                  "corpus_id string, shard_id string, path string, content string, n_lines long, tokens long, commit_time long")
    whole = X.base_context(files).first().base_text
    assert "\n\n".join(r.block for r in X.base_blocks(files).orderBy("ord", "path").collect()) == whole
    assert O.ALL_SHARD not in whole
