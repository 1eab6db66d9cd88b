"""Session construction and lineage cuts.

Library functions never create a session; they take DataFrames. This module is
for entry points (bench, tests, examples) and for the one place where a plan is
materialized on purpose: :func:`materialize` writes to the shared checkpoint
directory named by the cluster (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that matter at scale: AQE re-plans joins and partition counts from
#: runtime sizes, splits skewed join partitions, and only broadcasts a side whose
#: measured size is under the threshold.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None,
                  app: str = "corpusflow", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory; a scratch one is made only on a local
    master (tests). A cluster has to name a folder that all its machines share."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # a core setting some deployments refuse at runtime
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def _is_scan(df: DataFrame) -> bool:
    """True when ``df`` only selects, renames or filters columns of a file scan, or
    adds constants (re-reading it is as cheap as reading a copy); computed
    columns do not count."""
    def plain(e) -> bool:
        name = e.getClass().getSimpleName()
        if name == "AttributeReference":
            return True
        return name == "Alias" and e.child().getClass().getSimpleName() in ("AttributeReference", "Literal")

    try:
        node = df._jdf.queryExecution().optimizedPlan()
        while True:
            kind = node.getClass().getSimpleName()
            if kind == "Project":
                exprs = node.projectList()
                if not all(plain(exprs.apply(i)) for i in range(exprs.size())):
                    return False
            elif kind != "Filter":
                break
            node = node.child()
        return node.getClass().getSimpleName() == "LogicalRelation"
    except Exception:  # noqa: BLE001 - plan introspection is best effort
        return False


def materialize(df: DataFrame, name: str, force: bool = False) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint directory and read it
    back, cutting the lineage. Survives executor loss (files are on shared storage)
    and makes non-repeatable stages (model calls) run exactly once per row set
    (use ``force=True`` for those). A plain file scan is returned as is."""
    if not force and _is_scan(df):
        return df
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's materialized tables under the checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/corpusflow-{spark.sparkContext.applicationId}"


def cleanup_materialized(spark: SparkSession) -> None:
    """Delete this application's materialized tables (call when its jobs are done;
    DataFrames read from them become invalid)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)
