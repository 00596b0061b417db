"""Binary files in the shared folder, written and read by tasks.

Paths are URIs that pyarrow's file systems know (file, hdfs, s3, gs …), so the same code works
on a laptop and where the shared folder is an object store. A task writes under a name of its
own; what a lost or repeated task leaves behind is never named by a committed table, and so is
never read.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from veilscan.session import work_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder as a full URI, in the shared folder of the cluster."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark, name))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    return store.makeQualified(path).toString()


def release_shuffles(spark: SparkSession) -> None:
    """Finished steps leave shuffle files that Spark deletes once the driver's garbage is
    collected; asking for that keeps the disk to one step at a time. The second time finds what
    the first has only made unreachable."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def own_name(folder: str, stem: str, ending: str) -> str:
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{ending}"


def writer(uri: str):
    store, path = located(uri)
    return store.open_output_stream(path, compression=None)


def reader(uri: str):
    store, path = located(uri)
    return store.open_input_stream(path, compression=None)


def mapped(uri: str):
    """A file for reads at any place; local ones are memory-mapped."""
    store, path = located(uri)
    if isinstance(store, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path, "r")
    return store.open_input_file(path)
