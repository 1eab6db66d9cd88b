"""Planning (D4, D5, D6, C4): properties of the plans of many random trees per
Spark job (one corpus per tree)."""

import random

from pyspark.sql import functions as F

from corpusflow.operators import shards as S
from spec import check_fresh, check_resolved

SEGS = ["a", "b", "c", "src", "lib", "x"]


def random_tree(rng, n):
    files = {}
    for _ in range(n):
        depth = rng.choice([0, 1, 1, 2, 2, 3, 4])
        path = "/".join(rng.choice(SEGS) for _ in range(depth))
        name = f"f{rng.randrange(1000)}.py"
        files[(path + "/" if path else "") + name] = rng.choice([1, 2, 5, 10, 40, 100])
    return files


def to_df(spark, corpora):
    rows = [(cid, p, t) for cid, files in corpora.items() for p, t in files.items()]
    return spark.createDataFrame(rows, "corpus_id string, path string, tokens long")


def as_map(plan_rows):
    out = {}
    for cid, sid, prefix, path in plan_rows:
        out.setdefault(cid, {})[path] = (sid, prefix)
    return out


def test_fresh_plans_are_the_coarsest_that_fit(spark):
    rng = random.Random(7)
    corpora = {f"c{i}": random_tree(rng, rng.randrange(1, 40)) for i in range(80)}
    budgets = {cid: rng.choice([5, 20, 60, 150, 400]) for cid in corpora}
    got = {}
    for b in sorted(set(budgets.values())):
        sub = {c: f for c, f in corpora.items() if budgets[c] == b}
        rows = S.plan_shards(to_df(spark, sub), b).select("corpus_id", "shard_id", "prefix", "path").collect()
        got.update(as_map(rows))
    for cid, files in corpora.items():
        check_fresh(files, budgets[cid], got[cid])


def test_resolved_plans_over_generations(spark):
    rng = random.Random(11)
    budget = 60
    corpora = {f"c{i}": random_tree(rng, rng.randrange(5, 40)) for i in range(60)}
    first = as_map(S.plan_shards(to_df(spark, corpora), budget).select("corpus_id", "shard_id", "prefix", "path").collect())
    stored = {cid: sorted(set(first[cid].values())) for cid in corpora}
    for gen in range(3):
        nxt = {}
        for cid, files in corpora.items():
            f2 = {p: t for p, t in files.items() if rng.random() > 0.15}
            for p in list(f2):
                if rng.random() < 0.2:
                    f2[p] = rng.choice([1, 5, 40, 100])
            f2.update(random_tree(rng, rng.randrange(0, 8)))
            nxt[cid] = f2 or {"keep.py": 1}
        corpora = nxt
        st_rows = [(cid, sid, p, i + 1) for cid, plan in stored.items() for i, (sid, p) in enumerate(plan)]
        st = spark.createDataFrame(st_rows, "corpus_id string, shard_id string, prefix string, shard_ord int")
        res = S.resolve_plan(to_df(spark, corpora), st, budget)
        rows = res.select("corpus_id", "shard_id", "prefix", "path", "shard_ord").collect()
        got = as_map([r[:4] for r in rows])
        ords = {}
        for cid, sid, _, _, o in rows:
            ords.setdefault(cid, {})[sid] = o
        new_stored = {}
        for cid, files in corpora.items():
            check_resolved(files, budget, stored[cid], got[cid])
            shards = set(got[cid].values())
            ids = [s for s, _ in shards]
            assert len(ids) == len(set(ids)), (gen, cid)
            new_stored[cid] = sorted(shards, key=lambda x: ords[cid][x[0]])
            # shard_ord is dense 1..n
            assert sorted(ords[cid].values()) == list(range(1, len(ids) + 1))
        stored = new_stored


def test_plan_invariants_and_metamorphic(spark):
    from corpusflow.fixtures import views as V
    from paths import SF_SMALL
    f = V.files(spark, SF_SMALL)
    sf = S.plan_shards(f, 1500)
    # every file in exactly one shard
    assert sf.count() == f.count() == sf.select("corpus_id", "path").distinct().count()
    h1 = {r.corpus_id: r.plan_hash for r in S.plan_hash(S.plan_table(sf)).collect()}
    # shuffled, repartitioned input gives the same plan hash
    f2 = f.repartition(3, F.rand(5)).orderBy(F.rand(3))
    h2 = {r.corpus_id: r.plan_hash for r in S.plan_hash(S.plan_table(S.plan_shards(f2, 1500))).collect()}
    assert h1 == h2
    # shards over budget are direct-child shards or directories without subdirectories
    pt = S.plan_table(sf)
    paths = {(r.corpus_id, r.shard_id): r.path for r in sf.collect()}
    for r in pt.where(F.col("tokens") > 1500).collect():
        members = [p for (c, sid), p in paths.items() if c == r.corpus_id and sid == r.shard_id]
        assert r.shard_id.endswith("__root__") or all("/" not in p[len(r.prefix):] for p in members)
    # resolving an unchanged corpus only renames unsplittable oversize directories
    stored = pt.select("corpus_id", "shard_id", "prefix", "shard_ord")
    again = S.plan_table(S.resolve_plan(f, stored, 1500))
    before = {(r.corpus_id, r.shard_id) for r in stored.collect()}
    after = {(r.corpus_id, r.shard_id) for r in again.collect()}
    for c, sid in before - after:
        assert (c, sid + "/__root__") in after
    # and from then on the plan is stable
    third = S.plan_table(S.resolve_plan(f, again.select("corpus_id", "shard_id", "prefix", "shard_ord"), 1500))
    assert {(r.corpus_id, r.shard_id, r.prefix) for r in third.collect()} == \
        {(r.corpus_id, r.shard_id, r.prefix) for r in again.collect()}


def test_id_drift_of_unsplittable_directory(spark):
    # a directory with direct files only, over budget: fresh 's', then 's/__root__'
    files = {"s/a.py": 50, "s/b.py": 50, "t/c.py": 1}
    df = to_df(spark, {"k": files})
    p1 = S.plan_table(S.plan_shards(df, 60))
    ids1 = {r.shard_id for r in p1.collect()}
    assert ids1 == {"s", "t"}
    p2 = S.plan_table(S.resolve_plan(df, p1.select("corpus_id", "shard_id", "prefix", "shard_ord"), 60))
    ids2 = {r.shard_id for r in p2.collect()}
    assert ids2 == {"s/__root__", "t"}


def test_claim_longest_prefix(spark):
    files = {"a.py": 1, "src/x.py": 1, "src/sub/y.py": 1, "lib/z.py": 1}
    stored = [("k", "__root__", "", 1), ("k", "src", "src/", 2), ("k", "src/sub", "src/sub/", 3)]
    st = spark.createDataFrame(stored, "corpus_id string, shard_id string, prefix string, shard_ord int")
    c = {r.path: r.shard_id for r in S.claim_files(to_df(spark, {"k": files}), st).collect()}
    assert c == {"a.py": "__root__", "src/x.py": "src", "src/sub/y.py": "src/sub"}
    orphans = [r.path for r in S.orphan_files(to_df(spark, {"k": files}), st).collect()]
    assert orphans == ["lib/z.py"]


def test_nested_direct_child_shard_adopts_new_subdirectory(spark):
    # stored 'src/__root__' (prefix 'src/') claims a new 'src/new/' directory; the
    # top-level '__root__' only takes slash-free paths
    stored = [("k", "__root__", "", 1), ("k", "src/__root__", "src/", 2), ("k", "src/a", "src/a/", 3)]
    st = spark.createDataFrame(stored, "corpus_id string, shard_id string, prefix string, shard_ord int")
    files = {"top.py": 1, "src/x.py": 1, "src/a/y.py": 1, "src/new/z.py": 1, "lib/w.py": 1}
    res = S.resolve_plan(to_df(spark, {"k": files}), st, 100)
    got = {r.path: r.shard_id for r in res.collect()}
    assert got == {"top.py": "__root__", "src/x.py": "src/__root__", "src/a/y.py": "src/a",
                   "src/new/z.py": "src/__root__", "lib/w.py": "lib"}
    check_resolved(files, 100, [(s, p) for _, s, p, _ in stored], {r.path: (r.shard_id, r.prefix) for r in res.collect()})


def test_directory_named_root_is_rejected(spark):
    import pytest
    df = to_df(spark, {"k": {"a/__root__/x.py": 1, "b.py": 1}})
    with pytest.raises(Exception, match="__root__ is reserved"):
        S.plan_shards(df, 10).count()
    ok = to_df(spark, {"k": {"a/__root__": 1}})  # a file with that name is fine
    assert S.plan_shards(ok, 10).count() == 1
