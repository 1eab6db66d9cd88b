"""K1 stream = D11 batch; K2 replay of a batch id is a no-op."""

import os

from pyspark.sql import functions as F

from paths import SF_SMALL
from corpusflow.fixtures import views as V
from corpusflow.operators import requests as R
from corpusflow.sources import state as ST
from corpusflow.streaming.chunks import reassemble_stream
from corpusflow.streaming.refresh import _applied, _newer, announce, complete_batch, refresh_batch, refresh_stream


def test_stream_equals_batch(spark, tmpdir_path):
    chunks = V.chunks(spark, SF_SMALL)
    src = os.path.join(tmpdir_path, "chunks")
    # the middle chunks arrive last, after those with usage
    chunks.where(F.col("chunk_no") != 1).coalesce(1).write.parquet(os.path.join(src, "a"))
    chunks.where(F.col("chunk_no") == 1).coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1) \
                  .option("recursiveFileLookup", "true").parquet(src)
    out = reassemble_stream(stream, timeout_ms=None)
    sink = os.path.join(tmpdir_path, "out")
    q = out.writeStream.format("parquet").option("path", sink) \
           .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = {r.request_id: r for r in spark.read.parquet(sink).collect()}
    want = {r.request_id: r for r in R.reassemble_chunks(chunks).collect()}
    with_usage = {k: v for k, v in want.items() if v.usage is not None}
    assert with_usage, "fixture has completed responses"
    for k, w in with_usage.items():
        g = got[k]
        assert (g.tool_text, g.content_text, g.n_chunks, g.prompt_tokens) == \
            (w.tool_text, w.content_text, w.n_chunks, w.usage.prompt_tokens)
        assert g.error is None
    assert set(got) == set(with_usage)  # without usage and without a timeout nothing is emitted


def test_refresh_stream_replay_is_noop(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "state")
    v1 = V.files(spark, SF_SMALL, "v1").select("corpus_id", "path", "content", "mtime_ms")
    arrivals = os.path.join(tmpdir_path, "arrivals")
    v1.coalesce(1).write.parquet(arrivals)
    stream = spark.readStream.schema(v1.schema).parquet(arrivals)
    q = refresh_stream(stream, root, os.path.join(tmpdir_path, "ck"), budget=1500, available_now=True)
    q.awaitTermination(600)
    assert ST.versions(spark, root) == [1]
    # replaying batch 0 (e.g. after a crash before the commit of the stream) changes nothing
    refresh_batch(root, 1500, 0.1, os.path.join(tmpdir_path, "ck"))(v1, 0)
    assert ST.versions(spark, root) == [1]
    # a new stream starts at batch 0 again, and its texts are newer than the stored ones
    changed = v1.withColumn("content", F.concat("content", F.lit("\nmore\nof\nit" * 40)))
    refresh_batch(root, 1500, 0.1, "another")(changed, 0)
    assert ST.versions(spark, root) == [1, 2]
    texts = ST.read_state(spark, root, "base_shards")
    assert texts.where("base_text IS NULL").count() == 0 and texts.where("base_text LIKE '%more%'").count() == texts.count()
    assert ST.read_state(spark, root, "shard_plan").count() > 0


def test_stream_timeout_reports_missing_usage(spark, tmpdir_path):
    chunks = V.chunks(spark, SF_SMALL)
    src = os.path.join(tmpdir_path, "chunks")
    chunks.where(F.col("chunk_no") < 2).coalesce(1).write.parquet(os.path.join(src, "a"))
    chunks.where(F.col("chunk_no") >= 2).coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1) \
                  .option("recursiveFileLookup", "true").parquet(src)
    out = reassemble_stream(stream, timeout_ms=1)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    sink = os.path.join(tmpdir_path, "out")
    q = out.writeStream.format("parquet").option("path", sink) \
           .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    got = {r.request_id: r for r in spark.read.parquet(sink).collect()}
    last = {r.request_id: r.m for r in chunks.groupBy("request_id").agg(F.max("chunk_no").alias("m")).collect()}
    want = {r.request_id: r for r in R.reassemble_chunks(chunks).collect()}
    # finished in the first batch: emitted with usage; stopped in the first batch without
    # usage: timed out in the second batch with the error; still sending at the end: pending
    for k, w in want.items():
        if last[k] < 2 and w.usage is not None:
            assert got[k].error is None and got[k].tool_text == w.tool_text
        elif last[k] < 2:
            assert got[k].error == "No usage data in stream response" and got[k].n_chunks == w.n_chunks
    assert any(w.usage is None and last[k] < 2 for k, w in want.items())


def test_event_time_ends_quiet_requests_and_drops_repeats(spark, tmpdir_path):
    schema = ("request_id long, chunk_no long, tool_delta string, content_delta string, usage struct<prompt_tokens:long,"
              "prompt_cache_hit_tokens:long,prompt_cache_miss_tokens:long,completion_tokens:long,reasoning_tokens:long>, sent_at timestamp")
    used = (7, 1, 2, 3, 4)
    batches = [
        [(1, 0, "a", None, None, 0), (2, 0, "x", None, None, 0), (3, 1, "d", "D", used, 1), (4, 0, "p", None, None, 2)],
        [(1, 1, "b", "B", used, 5), (1, 0, "a", None, None, 0), (2, 0, "x", None, None, 0), (4, 2, "r", None, None, 6), (None, None, None, None, None, 6)],
        [(1, 1, "b", "B", used, 5), (3, 0, "c", None, None, 8)],  # request 1 was finished; 3 is now
        [(None, None, None, None, None, 500)],
    ]
    import datetime
    src = os.path.join(tmpdir_path, "in")
    for i, rows in enumerate(batches):
        rows = [(*r[:5], datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=r[5])) for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    out = os.path.join(tmpdir_path, "out")
    q = reassemble_stream(stream).writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = sorted((r.request_id, r.tool_text, r.content_text, r.n_chunks, r.prompt_tokens, r.error) for r in spark.read.parquet(out).collect())
    quiet = "No usage data in stream response"
    assert got == [(1, "ab", "B", 2, 7, None), (2, "x", "", 1, None, quiet), (3, "cd", "D", 2, 7, None), (4, "pr", "", 2, None, quiet)]


def test_a_snapshot_waits_until_it_is_complete(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "state")
    run = complete_batch(root, 1000, 0.1, "s", keep_old=False)
    files = "corpus_id string, snapshot_id long, path string, content string, mtime_ms long"

    def sent(rows, told=None, lost=()):
        df = spark.createDataFrame([(*r, 0) for r in rows], files)
        full = spark.createDataFrame([(*r, 0) for r in told or []], files)
        marks = announce(full).unionByName(spark.createDataFrame([(c, s, 0, None) for c, s in lost], "corpus_id string, snapshot_id long, n_files long, files_hash long"))
        return df.unionByName(marks, allowMissingColumns=True)

    def state():
        return {(r.corpus_id, r.path) for r in ST.read_state(spark, root, "base_files").collect()}

    a1 = [("a", 1, "x.py", "one"), ("a", 1, "y.py", "two")]
    b1 = [("b", 1, "z.py", "three")]
    a2 = [("a", 2, "x.py", "one"), ("a", 2, "w.py", "four")]
    run(sent(a1[:1] + b1, told=a1), 0)  # half of a, b without its manifest
    assert state() == set()
    run(sent(a1 + a1[1:], told=b1), 1)  # the rest, some of it again
    assert state() == {("a", "x.py"), ("a", "y.py"), ("b", "z.py")}
    before = ST.versions(spark, root)
    run(sent(a1 + a1[1:], told=b1), 1)  # a replay
    assert ST.versions(spark, root) == before
    run(sent(a2[:1], told=a2), 2)  # half of the next one deletes nothing
    run(sent([("a", 2, "w.py", "another text")]), 3)
    assert state() == {("a", "x.py"), ("a", "y.py"), ("b", "z.py")} and ST.versions(spark, root) == before
    run(sent([("a", 3, "v.py", "five")], told=[("a", 3, "v.py", "five")], lost=[("b", 2)]), 4)
    assert state() == {("a", "v.py")}  # b has lost its last file
    run(sent(a2, told=a2), 5)  # older than what is there
    assert state() == {("a", "v.py")}
    assert os.listdir(os.path.join(root, "_arrivals"))
    waiting = [d for _, ds, _ in os.walk(os.path.join(root, "_arrivals")) for d in ds if d.startswith("b=")]
    assert len(waiting) <= 3  # what was refreshed or is out of date waits no more


def test_texts_are_not_dealt_by_corpus(spark, tmpdir_path):
    rows = spark.createDataFrame([("a", 1, "x.py", "one"), ("b", 1, "y.py", "two")], "corpus_id string, snapshot_id long, path string, content string")
    newer = _newer(rows, _applied(spark, tmpdir_path, []))  # nothing applied yet
    root = os.path.join(tmpdir_path, "state")
    shards = rows.selectExpr("corpus_id", "'s' AS shard_id", "1L AS base_token_count", "content AS base_text", "1L AS snapshot_ts")
    ST.write_state(root, shards, rows.selectExpr("corpus_id", "'s' AS shard_id", "path", "'h' AS hash", "1L AS snapshot_ts"),
                   rows.selectExpr("corpus_id", "'s' AS shard_id", "'' AS prefix", "1 AS shard_ord", "'p' AS plan_hash", "1L AS snapshot_ts"))
    saved = ST.read_state(spark, root, "base_shards")
    assert sorted(r.content for r in newer.collect()) == sorted(r.base_text for r in saved.collect()) == ["one", "two"]
    for df in (newer, saved):
        assert "hashpartitioning(corpus_id" not in df._jdf.queryExecution().executedPlan().toString()
