"""Join helpers and lineage cuts: same rows as the plain forms."""

from pyspark.sql import functions as F

from corpusflow.operators import joins
from corpusflow.operators.joins import salted_join
from corpusflow.session import _is_scan, materialize


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([("a" if i % 10 else "b", f"p{i}", i) for i in range(500)],
                                "corpus_id string, path string, v long")
    small = spark.createDataFrame([("a", 1), ("b", 2)], "corpus_id string, w long")
    plain = sorted(tuple(r) for r in big.join(small, "corpus_id").collect())
    salted = sorted(tuple(r) for r in salted_join(big, small, ["corpus_id"]).select(*big.columns, "w").collect())
    assert plain == salted
    left = salted_join(big, small.where("corpus_id = 'a'"), ["corpus_id"], how="left")
    assert left.count() == 500 and left.where(F.col("w").isNull()).count() == 50


def _generated(node):
    """Rows made by all explodes of an executed plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _generated(node.executedPlan())
    inner = node.plan() if name.endswith("QueryStageExec") else None
    kids = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("numOutputRows").value() if name == "GenerateExec" else 0
    return own + sum(_generated(k) for k in kids)


def test_salted_join_copies_only_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 1000, raising=False)
    rows = [("hot", f"h{i}") for i in range(1500)] + [(f"k{i}", f"p{i}") for i in range(2000)] + [(None, "n")]
    big = spark.createDataFrame(rows, "shard_id string, path string")
    small = spark.createDataFrame([("hot", 0)] + [(f"k{i}", i) for i in range(2000)], "shard_id string, w long")
    for how, lost in (("inner", 0), ("left", 1)):
        out = salted_join(big, small, ["shard_id"], how=how)
        got = out.collect()
        assert len(got) == 3500 + lost and all(r.shard_id in (None, "hot") or r.w == int(r.path[1:]) for r in got)
        assert _generated(out._jdf.queryExecution().executedPlan()) == 2000 + joins.SALTS


def test_materialize_skips_plain_scans_only(spark, tmpdir_path):
    import os
    p = os.path.join(tmpdir_path, "t")
    spark.range(20).selectExpr("id", "cast(id as string) as s").write.parquet(p)
    scan = spark.read.parquet(p)
    assert _is_scan(scan) and _is_scan(scan.select("s").where("id > 3")) and _is_scan(scan.withColumn("k", F.lit(1)))
    assert not _is_scan(scan.select(F.sha2("s", 256))) and not _is_scan(scan.groupBy("s").count())
    assert materialize(scan.select("id"), "x") is not None
    m = materialize(scan.groupBy((F.col("id") % 3).alias("g")).count(), "agg")
    assert _is_scan(m) and sorted(r[1] for r in m.collect()) == [6, 7, 7]
