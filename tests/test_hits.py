"""Hit processing: JSON edges (I1-I3), range merging as sets of lines (E1), de-duplication (E3),
rendering notices (J5) and the outcome summary (D14)."""

import random

from pyspark.sql import functions as F

from corpusflow.operators import hits as H
from spec import lines_within


def test_argument_parsing_edges(spark):
    rows = [(1, '{"results": [{"file": "a.py", "start_line": 1, "end_line": 2}, '
                '{"file": "a.py", "start_line": "5", "end_line": 6}, {"file": "b.py", "start_line": 2.5}]}'),
            (2, '{"results": ['),
            (3, '{"results": {"file": "x"}}'),
            (4, '{"other": 1}'),
            (5, '{"results": [{"file": 7, "start_line": 1, "end_line": 1}]}')]
    df = spark.createDataFrame(rows, "query_id long, arguments string") \
              .withColumn("corpus_id", F.lit("c")).withColumn("shard_id", F.lit("s")).withColumn("shard_ord", F.lit(1))
    p = H.parse_arguments(df)
    assert [r.parse_error for r in p.orderBy("query_id").collect()] == [False, True, False, False, False]
    e = H.explode_hits(p).orderBy("query_id", "hit_ord").collect()
    assert [(r.query_id, r.hit_ord, r.path, r.start_line, r.end_line, r.type_ok) for r in e] == [
        (1, 0, "a.py", 1.0, 2.0, True), (1, 1, "a.py", None, 6.0, False), (1, 2, "b.py", 2.5, None, False),
        (5, 0, None, 1.0, 1.0, True)]


def test_merged_ranges_are_the_lines_and_their_small_gaps(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(60):
        for f in range(3):
            rs = [(s, s + rng.randrange(0, 6)) for s in (rng.randrange(1, 60) for _ in range(rng.randrange(1, 9)))]
            want[(q, f"f{f}")] = lines_within(rs, 3)
            rows += [(q, "c", f"f{f}", 0, i, s, e) for i, (s, e) in enumerate(rs)]
    df = spark.createDataFrame(rows, "query_id long, corpus_id string, path string, shard_ord int, hit_ord long, "
                                     "start_line long, end_line long")
    got = {}
    for r in H.coalesce_ranges(df).orderBy("query_id", "path", "range_no").collect():
        got.setdefault((r.query_id, r.path), []).append((r.start_line, r.end_line))
    for key, ranges in got.items():
        lines = [n for a, b in ranges for n in range(a, b + 1)]
        assert len(lines) == len(set(lines)) and set(lines) == want[key]
        assert all(b[0] - a[1] > 3 for a, b in zip(ranges, ranges[1:]))


def test_gaps_of_three_and_four(spark):
    rows = [(1, "c", "a", 0, 0, 1, 2), (1, "c", "a", 0, 1, 5, 6), (1, "c", "a", 0, 2, 11, 12)]
    df = spark.createDataFrame(rows, "query_id long, corpus_id string, path string, shard_ord int, hit_ord long, "
                                     "start_line long, end_line long")
    got = [(r.start_line, r.end_line) for r in H.coalesce_ranges(df).orderBy("range_no").collect()]
    assert got == [(1, 6), (11, 12)]


def test_dedupe_keeps_first_in_shard_then_answer_order(spark):
    rows = [(1, "c", "a", 2, 0, 1.0, 2.0), (1, "c", "a", 1, 5, 1.0, 2.0), (1, "c", "a", 1, 3, 1.0, 2.0),
            (1, "c", "a", 1, 4, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "query_id long, corpus_id string, path string, shard_ord int, hit_ord long, "
                                     "start_line double, end_line double")
    got = sorted((r.shard_ord, r.hit_ord) for r in H.dedupe_hits(df).collect())
    assert got == [(1, 3), (1, 4)]


def test_outcome_and_render_notices(spark):
    resp = spark.createDataFrame([
        (1, "s1", 1, "s1/", None), (1, "s2", 2, "", "API error 400: bad"),
        (2, "s1", 1, "s1/", "x"), (2, "s2", 2, "s2/", "y"),
        (3, "s1", 1, "s1/", None), (4, "s1", 1, "s1/", None), (5, "__all__", 1, "", "Failed after 3 retries: x")],
        "query_id long, shard_id string, shard_ord int, prefix string, error string")
    oc = H.outcome_summary(resp)
    n_merged = spark.createDataFrame([(1, 0), (3, 2), (4, 0)], "query_id long, n_results long")
    snips = spark.createDataFrame([], "query_id long, snippet string, file_rank long, start_line long")
    out = {r.query_id: (r.text, r.is_error) for r in H.render_outcome(oc, n_merged, snips).collect()}
    assert out[1] == ('\n\n--- Shard Errors ---\n[shard "s2" (s2)]: API error 400: bad', False)
    assert out[2] == ('\n\n--- Shard Errors ---\n[shard "s1" (s1/)]: x\n[shard "s2" (s2/)]: y', True)
    assert out[3] == ("No matching files found in snapshot.", False)
    assert out[4] == ("No matching code found.", False)
    assert out[5] == ("Error: Failed after 3 retries: x", True)


def test_snippets_cut(spark):
    files = spark.createDataFrame([("c", "a.py", "l1\nl2\nl3\nl4")], "corpus_id string, path string, content string")
    r = spark.createDataFrame([(1, "c", "a.py", 2, 3)], "query_id long, corpus_id string, path string, "
                                                       "start_line long, end_line long")
    assert H.cut_snippets(r, files).first().snippet == "--- a.py:2-3 ---\n2\tl2\n3\tl3"


def test_snippets_of_a_crowded_file_are_cut_from_one_split(spark):
    lines = [f"l{i}" for i in range(1, 401)]
    files = spark.createDataFrame([("c", "a.py", "\n".join(lines)), ("c", "b.py", "x\ny")], "corpus_id string, path string, content string")
    want = [(q, "a.py", 1 + q % 390, 1 + q % 390 + q % 5) for q in range(1000)] + [(5, "b.py", 1, 2), (6, "gone.py", 1, 1)]
    r = spark.createDataFrame([(q, "c", p, s, e) for q, p, s, e in want], "query_id long, corpus_id string, path string, start_line long, end_line long")
    cut = H.cut_snippets(r, files)
    got = {(x.query_id, x.path): (x.start_line, x.end_line, x.snippet) for x in cut.collect()}
    assert len(got) == 1001 and got[5, "b.py"][2] == "--- b.py:1-2 ---\n1\tx\n2\ty"
    for q, p, s, e in want[:1000]:
        body = "\n".join(f"{i}\t{lines[i - 1]}" for i in range(s, e + 1))
        assert got[q, p] == (s, e, f"--- a.py:{s}-{e} ---\n{body}")
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(content") == 1 and set(cut.columns) == {*r.columns, "snippet"}


def test_chunked_running_totals_equal_plain_window(spark):
    from pyspark.sql import Window
    from paths import SF_SMALL
    from corpusflow.fixtures import views as V
    from corpusflow.operators import usage as U
    u = V.usage(spark, SF_SMALL)
    w = Window.partitionBy("session").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {r.request_id: (r.a, r.b) for r in u.select("request_id", F.sum("prompt_tokens").over(w).alias("a"),
                                                         F.sum("prompt_cache_hit_tokens").over(w).alias("b")).collect()}
    for chunk in (3, 50, 1 << 20):
        got = {r.request_id: (r.cum_prompt, r.cum_hit) for r in U.cumulative_hit_rate(u, rows_per_chunk=chunk).collect()}
        assert got == plain, chunk


def test_change_ratio_edges(spark):
    from corpusflow.operators import changes as C
    base = spark.createDataFrame([("k", "s", "a", "h1"), ("k", "s", "b", "h2"), ("k", "z", "c", "h3")],
                                 "corpus_id string, shard_id string, path string, hash string")
    cur = spark.createDataFrame([("k", "s", "a", "h1", 5)], "corpus_id string, shard_id string, path string, "
                                                            "hash string, tokens long")
    ch = C.detect_changes(cur, base)
    assert sorted((r.path, r.status) for r in ch.collect()) == [("a", "unchanged"), ("b", "deleted"), ("c", "deleted")]
    bs = spark.createDataFrame([("k", "s", 10), ("k", "z", 0)], "corpus_id string, shard_id string, base_token_count long")
    s = {r.shard_id: (r.change_ratio, r.needs_rebuild) for r in C.change_summary(ch, bs, 0.1).collect()}
    # only deletions: ratio 0, no rebuild; base count 0: ratio 1
    assert s == {"s": (0.0, False), "z": (1.0, True)}
    # strict comparison at the threshold
    cur2 = spark.createDataFrame([("k", "s", "a", "hx", 1)], "corpus_id string, shard_id string, path string, "
                                                             "hash string, tokens long")
    s2 = C.change_summary(C.detect_changes(cur2, base.where("shard_id = 's'")), bs.where("shard_id = 's'"), 0.1).first()
    assert s2.change_ratio == 0.1 and not s2.needs_rebuild
