"""Session helpers: durable work folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Names the folder of a session among those of all jobs that share the work folder.
_OWN = "veilscan.work"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir`` so
    that it outlives any executor. Only a local session where nothing is set uses a
    temporary folder; on a cluster executors would not share one, so that is an error.
    """
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veilscan-"))
        base = context.getCheckpointDir()
    own = spark.conf.get(_OWN, None)
    if own is None:
        own = f"{context.applicationId}-{uuid.uuid4().hex}"
        spark.conf.set(_OWN, own)
    return f"{base.rstrip('/')}/veilscan/{own}"


def _file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_folder(spark: SparkSession, name: str) -> bool:
    files, path = _file_system(spark, name)
    return files.getFileStatus(path).isDirectory()


def _delete(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def remove_work(spark: SparkSession) -> None:
    """Delete what this session has written to the shared work folder; for the end of a job, when
    its results have been stored elsewhere. Folders of other sessions stay."""
    _delete(spark, _own_folder(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared work folder and read it back, cutting lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)
