"""Shared-folder helpers: where to cut lineage, and how."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read, taken from ``spark.checkpoint.dir``.

    Only a ``local`` session without that setting gets a temporary folder of its own; a cluster must name one.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        application = spark.sparkContext.applicationId
        if application not in _local_folders:
            _local_folders[application] = tempfile.mkdtemp(prefix="bazaarlens-")
        folder = _local_folders[application]
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative Spark ML fits cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later jobs then scan only the columns they need instead of repeating the joins, and a lost executor
    costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
