"""Session construction and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Image rows are large: keep Arrow batches small when Python sees them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.python.worker.reuse": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cohortbeam", **extra: str) -> SparkSession:
    """Build (or reuse) a session with the defaults this library assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:  # else the cluster's own value
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is.
    Only when it is unset (tests, ad-hoc local runs) a private folder is
    created and registered, for both the setting and RDD checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/NFS) for this cluster")
        base = tempfile.mkdtemp(prefix="cohortbeam-ckpt-", dir="/tmp")  # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    if base.startswith("file:"):  # a plain path would belong to the default file system
        path = "/" + base[len("file:"):].lstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        base = path if conf.get("fs.defaultFS", "file:///").startswith("file:") else f"file:{path}"
    return base


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for derived tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "cohortbeam", *parts)
