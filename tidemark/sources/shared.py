"""Tables in the folder that the driver and all executors share, to cut the lineage of loops."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this run by session.
_FOLDERS: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session on this machine alone that names none uses a temporary folder;
    on a cluster, whose machines don't share that, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it is deleted when the application ends."""
    path = f"{root(spark)}/tidemark-{name}/{uuid.uuid4().hex}"
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        _FOLDERS[application] = []
        atexit.register(_delete, spark, application)
    _FOLDERS[application].append(path)
    return path


def _delete(spark: SparkSession, application: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        for path in _FOLDERS.pop(application, []):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: neither recomputed nor lost with an executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
