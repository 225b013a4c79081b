"""Session helpers: recommended settings and a shared scratch folder.

Nothing here is required: every operator takes DataFrames and works on the
caller's session. ``get_session`` only applies the settings the operators are
tuned for (AQE with skew splitting) when the caller builds a fresh session.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Recommended for a session of one's own; no operator depends on them. AQE re-plans joins from
# measured sizes and splits skewed partitions of sort-merge joins.
RECOMMENDED_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
RECOMMENDED_CONF = {**RECOMMENDED_SQL_CONF, "spark.ui.enabled": "false"}


def get_session(app_name: str = "basketry", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the recommended settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once an application.

    A job submitted with ``--py-files`` or an installed package doesn't need it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="basketry-py-"), "basketry-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only a local session may leave it unset
    (tests): on a cluster a machine's own temporary folder is not seen by the
    other machines, so its absence is an error there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="basketry-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def scratch_root(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/basketry-scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for intermediate files."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate files, once results are saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one task sorts or keeps in a hash table at a time.
TASK_ROWS = 1 << 20


def tasks_of(spark: SparkSession, rows: int) -> list[int]:
    """How many tasks of about ``TASK_ROWS`` ``rows`` take; empty, the planner's choice, if one is enough."""
    return [max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism)] if rows > TASK_ROWS else []


def dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df`` dealt out by ``cols`` over tasks of about ``TASK_ROWS`` of its ``rows``.

    Their number grows with the rows, so a task's sorts and hash tables don't, whatever
    ``spark.sql.shuffle.partitions`` is and however many partitions adaptive execution would put in one
    task. Few rows are left to the planner.
    """
    n = tasks_of(df.sparkSession, rows)
    return df.repartition(*n, *cols) if n else df


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to shared scratch and read back.

    The branches of a plan then read files that outlive any executor, instead
    of running the plan below once each.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
