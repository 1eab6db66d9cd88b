"""Sources on disk (A1, A2, A4, A6, A7), state (A8-A11, I5) and refresh."""

import json
import os

from pyspark.sql import functions as F

from corpusflow.plans.refresh import refresh
from corpusflow.sources import commit_log as CL
from corpusflow.sources import files as SF
from corpusflow.sources import ignore as IG
from corpusflow.sources import state as ST


def write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_scan_listing_snapshot(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "ws")
    write(root, "src/a.py", b"x = 1\r\ny = 2\n")
    write(root, "src/b.md", b"# doc")
    write(root, "README", b"none")
    write(root, ".corpusflow/base.json", b"{}")
    write(root, "lib/c.ts", b"\xff\xfe")
    write(root, "lib/__init__.py", b"")
    write(root, ".eslintrc.js", b"x")
    write(root, ".github/w.yml", b"y")
    raw = SF.scan_files(spark, root, "ws")
    got = sorted(r.path for r in raw.collect())
    assert got == [".corpusflow/base.json", ".eslintrc.js", ".github/w.yml", "README", "lib/__init__.py", "lib/c.ts", "src/a.py", "src/b.md"]
    assert {r.path: r.size for r in SF.scan_files(spark, root, with_content=False).collect()}["src/a.py"] == 13
    files = SF.snapshot(SF.exclude_reserved(raw, anywhere=True))
    kept = SF.filter_extensions(files, SF.allow_table(spark))
    rows = {r.path: r for r in kept.collect()}
    assert sorted(rows) == [".eslintrc.js", ".github/w.yml", "lib/__init__.py", "lib/c.ts", "src/a.py"]
    assert rows["src/a.py"].content == "x = 1\ny = 2\n" and rows["src/a.py"].n_lines == 3
    # listing: trimmed, blanks dropped, state dir dropped, missing files skipped
    listing = spark.createDataFrame([("ws", " src/a.py "), ("ws", ""), ("ws", ".corpusflow/base.json"),
                                     ("ws", "gone.py"), ("ws", "src/a.py")], "corpus_id string, line string")
    assert sorted(r.path for r in SF.scan_listing(listing, raw).collect()) == ["src/a.py"]


def test_ignore_rules_semantics(spark):
    files = spark.createDataFrame([("k", p) for p in
                                   ["build/x.py", "build/keep.py", "src/a.py", "src/gen/b.py", "docs/n.md",
                                    "docs/keep.md", "deep/x/y/z.c"]], "corpus_id string, path string")
    rules = spark.createDataFrame([("k", i, p) for i, p in enumerate(
        ["build/", "!build/keep.py", "gen", "*.md", "!keep.md", "deep/**/*.c", "# c"])],
        "corpus_id string, ord int, pattern string")
    kept = sorted(r.path for r in IG.filter_ignored(files, rules).collect())
    # a file under an ignored directory cannot be re-included
    assert kept == ["docs/keep.md", "src/a.py"]


def test_allow_list_resolution(spark):
    conf = spark.createDataFrame([("a", '{"ext_whitelist": [".x", "y", 3], "ext_whitelist_override": true}'),
                                  ("b", '{"ext_whitelist": [".x", ".py"]}'), ("c", "{bad"), ("d", None)],
                                 "corpus_id string, config_json string")
    r = {x.corpus_id: x for x in SF.resolve_allow_list(conf, defaults=[".py", ".ts"]).collect()}
    assert r["a"].allow == [".x"] and r["a"].override
    assert r["b"].allow == [".py", ".ts", ".x"]
    assert r["c"].allow == [".py", ".ts"] and r["d"].allow == [".py", ".ts"]
    env = SF.resolve_allow_list(conf.where("corpus_id = 'd'"), env_list=" .go, ,.rs ")
    assert env.first().allow == [".go", ".rs"]


def test_commit_log_chunked_fill(spark):
    lines = ["src/orphan.py", "200 ab12", "", "a.py", "b.py", "150 cd34", "a.py", "c.py", "100 ef56", "d.py"]
    df = spark.createDataFrame([("k", i, l) for i, l in enumerate(lines)], "corpus_id string, line_no long, line string")
    for chunk in (2, 3, 1000):
        got = {r.path: r.commit_time for r in CL.parse_commit_log(df, chunk_lines=chunk).collect()}
        assert got == {"a.py": 200, "b.py": 200, "c.py": 150, "d.py": 100}, chunk


def test_upsert_idempotent_and_order_free(spark):
    e = spark.createDataFrame([("k", "s1", 10, "t", 100), ("k", "s2", 10, "t", 100)], ST.BASE_SHARDS_SCHEMA)
    n = spark.createDataFrame([("k", "s1", 20, "n", 100), ("k", "s2", 30, "n", 200), ("k", "s3", 5, "n", 50)],
                              ST.BASE_SHARDS_SCHEMA)
    won = {r.shard_id: r.base_token_count for r in ST.upsert_base(e, n).collect()}
    assert won == {"s1": 10, "s2": 30, "s3": 5}  # tie keeps the existing one
    again = {r.shard_id: r.base_token_count for r in ST.upsert_base(ST.upsert_base(e, n), n).collect()}
    assert again == won
    plan = spark.createDataFrame([("k", "s2")], "corpus_id string, shard_id string")
    assert [r.shard_id for r in ST.prune_base(ST.upsert_base(e, n), plan).collect()] == ["s2"]


def test_state_versions_and_import(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "state")
    assert ST.read_state(spark, root, "base_shards").count() == 0
    b = spark.createDataFrame([("k", "s", 3, "txt", 1)], ST.BASE_SHARDS_SCHEMA)
    f = spark.createDataFrame([("k", "s", "a.py", "h", 1)], ST.BASE_FILES_SCHEMA)
    p = spark.createDataFrame([("k", "s", "s/", 1, "abc", 1)], ST.PLAN_SCHEMA)
    assert ST.write_state(root, b, f, p) == 1
    assert ST.write_state(root, b, f, p) == 2
    os.makedirs(os.path.join(root, "v=3", "base_files"))  # incomplete version is ignored
    assert ST.versions(spark, root) == [1, 2]
    assert ST.read_state(spark, root, "shard_plan").first().plan_hash == "abc"
    # a writer of another corpus adds its own state and leaves the rest in force
    other = [df.withColumn("corpus_id", F.lit("other")) for df in (b, f, p)]
    assert ST.write_state(root, *other, mark="m1") == 3 and ST.has_mark(spark, root, "m1") and not ST.has_mark(spark, root, "m2")
    assert sorted(r.corpus_id for r in ST.read_state(spark, root, "shard_plan").collect()) == ["k", "other"]
    # a corpus that a version replaces by nothing is gone
    ST.write_state(root, b.limit(0), f.limit(0), p.limit(0), corpora=b.select("corpus_id"))
    assert [r.corpus_id for r in ST.read_state(spark, root, "base_shards").collect()] == ["other"]
    assert ST.drop_superseded(spark, root) == 2 and ST.versions(spark, root) == [3, 4]
    assert [r.corpus_id for r in ST.read_state(spark, root, "base_files").collect()] == ["other"]
    jd = os.path.join(tmpdir_path, "json", "proj")
    os.makedirs(jd)
    json.dump({"base_token_count": 7, "base_request_text": "t", "file_hashes": {"a/b.py": "h1", "c.py": "h2"},
               "timestamp": 1700000000000}, open(os.path.join(jd, "shard_a__b.json"), "w"))
    open(os.path.join(jd, "shard_bad.json"), "w").write("{truncated")
    shards, files = ST.import_state(spark, os.path.join(tmpdir_path, "json", "*", "*.json"))
    assert [(r.corpus_id, r.shard_id, r.base_token_count) for r in shards.collect()] == [("proj", "a/b", 7)]
    assert sorted(r.path for r in files.collect()) == ["a/b.py", "c.py"]
    # state keys that several ids share are told apart by the plan, or by the shard's own paths
    for key, paths in (("__root__", {"x.py": "h"}), ("src____root__", {"src/x.py": "h"}), ("my__pkg", {"my__pkg/x.py": "h"})):
        json.dump({"base_token_count": 1, "base_request_text": "t", "file_hashes": paths, "timestamp": 1},
                  open(os.path.join(jd, f"shard_{key}.json"), "w"))
    wanted = [("__root__", ""), ("src/__root__", "src/"), ("my__pkg", "my__pkg/")]
    json.dump({"planHash": "h", "shards": [{"id": i, "prefix": p} for i, p in wanted], "timestamp": 1},
              open(os.path.join(tmpdir_path, "json", "proj", "shard_meta.json"), "w"))
    plan = ST.import_plan(spark, os.path.join(tmpdir_path, "json", "*", "shard_meta.json"))
    assert [(r.corpus_id, r.shard_id, r.prefix, r.shard_ord) for r in plan.orderBy("shard_ord").collect()] == \
        [("proj", i, p, k + 1) for k, (i, p) in enumerate(wanted)]
    source = os.path.join(tmpdir_path, "json", "*", "shard_*.json")
    assert {r.shard_id for r in ST.import_state(spark, source)[0].collect()} == {"a/b"} | {i for i, _ in wanted}
    assert {r.shard_id for r in ST.import_state(spark, source, plan=plan)[0].collect()} == {i for i, _ in wanted}


def test_ignore_case_is_a_parameter(spark):
    files = spark.createDataFrame([("k", "Build/x.py"), ("k", "a[&&b]/x")], "corpus_id string, path string")
    rules = spark.createDataFrame([("k", 0, "build/"), ("k", 1, "[a&&b]")], "corpus_id string, ord int, pattern string")
    assert IG.filter_ignored(files, rules).count() == 2
    assert [r.path for r in IG.filter_ignored(files, rules, ignore_case=True).collect()] == ["a[&&b]/x"]


def test_refresh_twice_is_stable(spark, tmpdir_path):
    from paths import SF_SMALL
    from corpusflow.fixtures import views as V
    root = os.path.join(tmpdir_path, "st")
    v1 = V.files(spark, SF_SMALL, "v1")
    d1 = refresh(v1, root, budget=1500, snapshot_ts=1)["decisions"]
    assert d1.where(~F.col("needs_rebuild")).count() == 0
    d2 = refresh(v1, root, budget=1500, snapshot_ts=2)["decisions"]
    # unchanged corpus: nothing to rebuild except documented id drift of oversize directories
    rebuilt = [r.shard_id for r in d2.where(F.col("needs_rebuild")).collect()]
    assert all(s.endswith("__root__") for s in rebuilt)
    d3 = refresh(v1, root, budget=1500, snapshot_ts=3)["decisions"]
    assert d3.where(F.col("needs_rebuild")).count() == 0
    # edits: modified shards are compared against their base
    v2 = V.files(spark, SF_SMALL, "v2")
    d4 = refresh(v2, root, budget=1500, snapshot_ts=4)["decisions"]
    assert d4.where(F.col("change_ratio") > 0).count() > 0
    bs = ST.read_state(spark, root, "base_shards")
    plan = ST.read_state(spark, root, "shard_plan")
    assert bs.join(plan, ["corpus_id", "shard_id"], "left_anti").count() == 0
