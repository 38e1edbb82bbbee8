"""Tables that are written once beside a source and then read: event files in order, rollups, and
statistics of granules. Queries read them instead of making them anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import shared

_MADE: dict[tuple, str] = {}


def _state_of(spark: SparkSession, path: str) -> tuple:
    """Length and time of change of a source's files: what is made from it is kept while that stays."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(root)
    listed = fs.listStatus(root) if status.isDirectory() else [status]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def prepared(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], **options: str) -> DataFrame:
    """What ``make`` gives, as a table that is written on first use in this application and again
    only after files of ``source`` have changed."""
    key = (spark.sparkContext.applicationId, source, name, _state_of(spark, source))
    if key not in _MADE:
        path = shared.folder(spark, name)
        make().write.options(compression="zstd", **options).parquet(path)
        _MADE[key] = path
    return spark.read.parquet(_MADE[key])
