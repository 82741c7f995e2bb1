"""Session defaults and the shared scratch location.

Every job reads ``spark.checkpoint.dir`` from the session: on a cluster it
names a shared folder (HDFS/S3/ABFS).  Only a single-process session (master
``local[...]``: tests and trial runs) may leave it unset; any other raises.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

# Folder of single-process runs that name none.
LOCAL_ROOT = "/tmp/chronoframe"

# Settings that matter at scale; all can be overridden by the caller's conf.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "chronoframe",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, stream checkpoints and
    intermediate tables.  Read from the session; set only when unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return spark.sparkContext.getCheckpointDir() or conf_dir
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    local = os.path.join(LOCAL_ROOT, spark.sparkContext.applicationId)
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for one job's tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialize ``df`` once into the shared checkpoint folder (reliable
    checkpoint: survives executor loss) and return the re-read DataFrame."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str):
    """``df`` from files of the shared folder: like ``cut_lineage``, but columnar and compressed, for whole tables
    that a job reads and then replaces."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
