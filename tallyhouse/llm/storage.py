"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # application -> the folder made for it


def shared_folder(spark: SparkSession) -> str:
    """The folder of the application in the cluster's shared one. Only where all tasks run in the driver's own process, as in tests, and nothing is
    set, one is made; on a cluster without the setting nothing can be stored.
    """
    folder, application = spark.conf.get(SETTING, None), spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        if application not in _own:
            _own[application] = "file://" + tempfile.mkdtemp(prefix="tallyhouse-")
        folder = _own[application]
    return f"{folder.rstrip('/')}/tallyhouse-{application}"


def drop_stored(spark: SparkSession) -> None:
    """Deletes what this application has stored. Results that were not written elsewhere can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet and read back. It cuts the lineage and outlives lost executors."""
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
