"""J7 end to end with the passage-locating responder, failure isolation and retries."""

import os

from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL
from corpusflow.fixtures import views as V
from corpusflow.fixtures import responders as RS
from corpusflow.operators import requests as R
from corpusflow.operators import shards as S
from corpusflow.plans.search import search
from corpusflow.sources import files as SF
from corpusflow.sources import state as ST


def brute_force(spark, sf, budget):
    files = V.files(spark, sf)
    fp = files.select("corpus_id", "path", "content").toPandas()
    plan = S.plan_shards(files, budget).select("corpus_id", "path", "prefix").toPandas()
    fp = fp.merge(plan, on=["corpus_id", "path"])
    exp = []
    for r in V.requests(spark, sf).toPandas().itertuples():
        for f in fp[fp.corpus_id == r.corpus_id].itertuples():
            if r.scope:
                ns = r.scope if r.scope.endswith("/") else r.scope + "/"
                if not (f.prefix == "" or ns.startswith(f.prefix) or f.prefix.startswith(ns)):
                    continue
            i = f.content.find(r.query)
            if i >= 0:
                s = f.content.count("\n", 0, i) + 1
                exp.append((r.query_id, f.path, s, s + r.query.count("\n")))
    return sorted(exp)


def test_search_equals_brute_force(spark):
    out = search(V.requests(spark, SF_MID), V.files(spark, SF_MID), RS.PassageLocator(), budget=4000,
                 requests_per_group=3)
    got = sorted(tuple(r) for r in out["ranges"].select("query_id", "path", "start_line", "end_line").collect())
    assert got == brute_force(spark, SF_MID, 4000) and got
    ans = out["answers"]
    assert ans.count() == V.requests(spark, SF_MID).count()
    assert ans.where("is_error").count() == 0
    # rebuilt shards that answered get a new base; usage is accounted per request
    assert out["new_base_shards"].count() == out["plan"].count()
    assert out["usage"].where(F.col("prompt_tokens") > 0).count() == ans.count()


def test_all_shards_failing(spark):
    out = search(V.requests(spark, SF_SMALL), V.files(spark, SF_SMALL), RS.FailingResponder(400), budget=1500)
    rows = out["answers"].collect()
    assert rows and all(r.is_error for r in rows)
    assert all(r.text.startswith("\n\n--- Shard Errors ---\n") and "API error 400" in r.text for r in rows)
    assert out["new_base_shards"].count() == 0


def test_retries_recover(spark):
    calls = RS.FlakyResponder(RS.PassageLocator(), failures=2)
    msgs = [{"role": "user", "content": "x"}, {"role": "user", "content": "--- a.py (lines 1-1) ---\n1\tneedle"},
            {"role": "user", "content": "tree\n\nQuery: needle"}]
    out = R.call_with_retries(calls, msgs)
    assert out["error"] is None and out["attempts"] == 3
    out = R.call_with_retries(RS.FlakyResponder(RS.PassageLocator(), failures=3), msgs)
    assert out["error"].startswith("Failed after 3 retries") and out["attempts"] == 3
    assert R.call_with_retries(RS.FailingResponder(401, "no key"), msgs) == \
        {"arguments": None, "usage": None, "attempts": 1, "error": "API error 401: no key"}
    no_tool = lambda m: {"arguments": None, "content": "text", "usage": {"prompt_tokens": 1}}
    assert R.call_with_retries(no_tool, msgs)["error"] == "no tool call after 3 attempts"


def test_incremental_search_reuses_bases(spark):
    """Second search on edited files: shards under the threshold reuse the stored
    base text plus a change context; answers still equal a scan of current files."""
    v1, v2 = V.files(spark, SF_MID, "v1"), V.files(spark, SF_MID, "v2")
    req = V.requests(spark, SF_MID)
    first = search(req, v1, RS.PassageLocator(), budget=4000, snapshot_ts=1)
    stored = first["plan"].select("corpus_id", "shard_id", "prefix", "shard_ord")
    bs = first["new_base_shards"]
    bf = first["new_base_files"]
    second = search(req, v2, RS.PassageLocator(), budget=4000, threshold=0.5, stored_plan=stored,
                    base_shards=bs, base_files=bf, snapshot_ts=2)
    dec = second["plan"]
    assert dec.where(~F.col("needs_rebuild")).count() > 0
    got = sorted(tuple(r) for r in second["ranges"].select("query_id", "path", "start_line", "end_line").collect())
    # brute force over v2 with the resolved plan's prefixes
    fp = v2.select("corpus_id", "path", "content").toPandas()
    pl = S.resolve_plan(v2, stored, 4000).select("corpus_id", "path", "prefix").toPandas()
    fp = fp.merge(pl, on=["corpus_id", "path"])
    exp = []
    for r in req.toPandas().itertuples():
        for f in fp[fp.corpus_id == r.corpus_id].itertuples():
            if r.scope:
                ns = r.scope if r.scope.endswith("/") else r.scope + "/"
                if not (f.prefix == "" or ns.startswith(f.prefix) or f.prefix.startswith(ns)):
                    continue
            i = f.content.find(r.query)
            if i >= 0:
                s = f.content.count("\n", 0, i) + 1
                exp.append((r.query_id, f.path, s, s + r.query.count("\n")))
    assert got == sorted(exp)
    # only rebuilt shards get new bases
    assert second["new_base_shards"].count() == dec.where("needs_rebuild").count()


def test_search_persists_state(spark, tmpdir_path):
    import os
    from corpusflow.sources import state as ST
    root = os.path.join(tmpdir_path, "state")
    files = V.files(spark, SF_SMALL)
    req = V.requests(spark, SF_SMALL)
    first = search(req, files, RS.PassageLocator(), budget=1500, state_root=root, snapshot_ts=1)
    first["answers"].count()
    assert ST.versions(spark, root) == [1]
    plan = ST.read_state(spark, root, "shard_plan")
    bases = ST.read_state(spark, root, "base_shards")
    # bases only for shards that were asked and answered (scope pruning skips some)
    asked = first["responses"].where("error IS NULL").select("corpus_id", "shard_id").distinct()
    assert bases.count() == asked.count() <= plan.count()
    second = search(req, files, RS.PassageLocator(), budget=1500, state_root=root, snapshot_ts=2)
    dec = second["plan"]
    reused = dec.where(~F.col("needs_rebuild")).select("corpus_id", "shard_id")
    # every shard that has a base and kept its id is reused, not rebuilt
    kept = bases.join(dec.select("corpus_id", "shard_id"), ["corpus_id", "shard_id"], "left_semi")
    assert reused.count() == kept.count() > 0
    assert sorted(tuple(r) for r in second["ranges"].collect()) == sorted(tuple(r) for r in first["ranges"].collect())
    assert ST.versions(spark, root) == [1, 2]


ONE_HIT = '{"results": [{"file": "big/f0.py", "start_line": 1, "end_line": 1}]}'


def test_any_failure_is_an_error_row(spark):
    files, req = V.files(spark, SF_SMALL), V.requests(spark, SF_SMALL)
    for error in (ConnectionError("down"), TimeoutError("slow")):
        rows = search(req, files, RS.RaisingResponder(error), budget=10**9, sleep=False)["responses"].collect()
        assert rows and all(r.error == f"Failed after 3 retries: {error}" and r.attempts == 3 for r in rows)
    rows = search(req, files, RS.FixedResponder('{"results": [], "results": []}'), budget=10**9, sleep=False)["responses"].collect()
    assert rows and all("Failed to parse" in r.error for r in rows)


def test_a_shard_over_a_million_tokens_is_asked_and_saved(spark, tmpdir_path):
    rows = [("k", f"big/f{i}.py", "x = 1\n" * 90_000) for i in range(9)]
    files = SF.snapshot(spark.createDataFrame(rows, "corpus_id string, path string, content string"))
    assert files.agg(F.sum("tokens")).first()[0] > 1_000_000
    req = spark.createDataFrame([(1, "k", "x", None, None)], "query_id long, corpus_id string, query string, scope string, file_types array<string>")
    root = os.path.join(tmpdir_path, "big")
    out = search(req, files, RS.FixedResponder(ONE_HIT), budget=1000, state_root=root)
    answer = out["responses"].collect()
    assert [r.error for r in answer] == [None] and answer[0].prompt_tokens > 4_000_000
    assert out["answers"].first().n_results == 1
    assert ST.read_state(spark, root, "base_shards").where("base_text IS NULL").count() == 0


def test_search_orders_bases_by_file_time_like_refresh(spark):
    rows = [("k", "a.py", "a", 9000), ("k", "b.py", "b", 1000)]
    files = SF.snapshot(spark.createDataFrame(rows, "corpus_id string, path string, content string, mtime_ms long"))
    req = spark.createDataFrame([(1, "k", "x", None, None)], "query_id long, corpus_id string, query string, scope string, file_types array<string>")
    text = search(req, files, RS.FixedResponder(ONE_HIT), budget=1000)["new_base_shards"].first().base_text
    assert text.index("b.py") < text.index("a.py")


def test_passages_are_located_in_the_memory_of_a_block(spark):
    import tracemalloc
    import pyarrow as pa

    n, text = 400, "\n".join("x" * 99 for _ in range(400))
    needle = "\n".join(["one passage", "of two lines"])
    block = lambda path, body, tag="": f"--- {path}{tag} (lines 1-{body.count(chr(10)) + 1}) ---\n" + "\n".join(
        f"{i}\t{x}" for i, x in enumerate(body.split("\n"), 1))

    def rows():
        def row(part, ord_, path, text, query_id=None):
            return {"corpus_id": "c", "shard_id": "s", "bucket": 0, "part": part, "ord": ord_, "path": path, "block": text,
                    "query_id": query_id, "shard_ord": 1}
        for i in range(n):
            yield row(1, i, f"f{i:03}", block(f"f{i:03}", f"{text}\n{needle}" if i in (3, 7, 9) else text))
        yield row(2, 0, "f007", block("f007", text, " [UPDATED]"))
        yield row(2, 1, "g", block("g", needle, " [UPDATED]"))
        yield row(2, 2, "f009", "--- f009 [DELETED] ---")
        yield row(4, None, None, f"tree\nQuery: {needle}", 5)
        yield row(4, None, None, "tree\nQuery: nowhere", 6)

    kinds = pa.schema([(c, pa.int64() if c in ("bucket", "part", "ord", "query_id", "shard_ord") else pa.string())
                       for c in ("corpus_id", "shard_id", "bucket", "part", "ord", "path", "block", "query_id", "shard_ord")])
    tracemalloc.start()
    out = [r for b in R._answer_shards(RS.PassageLocator(), 1, False)(pa.RecordBatch.from_pylist([r], schema=kinds) for r in rows())
           for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["arguments"] for r in out] == [
        '{"results": [{"file": "f003", "start_line": 401, "end_line": 402}, {"file": "g", "start_line": 1, "end_line": 2}]}',
        '{"results": []}']
    assert peak < 4 << 20  # the shard's blocks have 17 MB


def test_a_file_without_text_fails_its_requests_only(spark):
    session = RS.PassageLocator().open("")
    session.feed(1, "--- a (lines 1-1) ---\n1\tq")
    try:
        session.feed(1, None)
    except TypeError as e:
        assert str(e) == "sequence item 1: expected str instance, NoneType found"
    else:
        raise AssertionError("a block without a text was read")
