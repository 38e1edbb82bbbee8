"""Shared folders for tables and files that cut lineage, and small helpers around them.

Everything here lives below ``spark.checkpoint.dir``, the one folder that the driver and all
executors of a cluster share. A lost executor therefore never loses a written stage.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session on this machine alone that names none gets
    a temporary one; on a cluster, whose machines don't share that, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """One run's folder below the checkpoint folder.

    ``stage`` writes a DataFrame as Parquet and reads it back, so that what follows neither
    recomputes it nor depends on the executors that made it. ``drop`` removes a stage which later
    stages have replaced. What a returned DataFrame still reads stays until the session ends.
    ``files``: files of a stage at most, where no other number is given.
    """

    def __init__(self, spark: SparkSession, name: str, files: int | None = None):
        self.spark, self.files = spark, files
        short_batches(spark)
        self.uri = f"{checkpoint_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def stage(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        path, files = self.path(name), files or self.files
        df = df.coalesce(files) if files else df
        df.write.mode("overwrite").options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def mkdirs(self, name: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return self.path(name)

    def _delete(self, uri: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            self._delete(self.uri)


def open_fs(uri: str):
    """A pyarrow file system and the path within it, for file:, hdfs:, s3: and gs: addresses."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def atomic_output(uri: str):
    """A stream to a new file that appears under its name only when complete: a retried or
    doubled task attempt replaces the file whole and never leaves half of one."""
    filesystem, path = open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part) as stream:
        yield stream
    filesystem.move(part, path)


def slices(batches, rows: int = 1000):
    """Arrow batches cut into short ones, so that a worker holds few of their values as Python objects.
    After the last one, what was freed goes back to the system: workers live on from stage to stage."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of an Arrow batch at most: batches of whole texts fill a worker and its JVM twice over.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: Input bytes (as stored) for one partition, and partitions at most, where ranges are cut: past
#: that many, partitions grow and are sorted on disk.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 100_000
#: A result or a written stage has no more files than this for each core, unless its input's size
#: asks for more, one for each FILE_BYTES.
FILES_PER_CORE, FILE_BYTES = 2, 4 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_bytes(df: DataFrame) -> int:
    """The input's stored size, which Spark's plan knows; 0 for sources without one, which claim the most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of all of ``df``: the session's number, or more where the input's
    size asks for it."""
    return max(shuffle_partitions(df.sparkSession), min(-(-stored_bytes(df) // PARTITION_BYTES), MOST_PARTITIONS))


def files_for(df: DataFrame) -> int:
    """Files at most for what is made from ``df``."""
    return max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(df) // FILE_BYTES))


@dataclass(frozen=True)
class Cuts:
    """How ids are cut into ranges: the lowest ``nulls`` ranges are for rows without id, the others
    lie between ``bounds`` (rising). An id that holds many rows is there several times."""

    nulls: int
    bounds: tuple[int, ...]


def cut_ranges(df: DataFrame, column: str, n: int, sample: int = 50, most: int = 2_000_000) -> Cuts:
    """Cut ``df`` into ``n`` ranges of about equal rows by the long ``column``, at the quantiles of
    a sample of about ``sample`` ids a range, ``most`` in all."""
    c = F.col(column)
    total, absent = df.agg(F.count("*"), F.count_if(c.isNull())).first()
    nulls = max(1, round(n * absent / total)) if absent else 0
    rest, there = max(n - nulls, 1), total - absent
    share = min(1.0, min(sample * n, most) / max(there, 1))
    ids = df.select(c).where(c.isNotNull())
    found = sorted(r[0] for r in (ids if share == 1 else ids.sample(share, seed=1)).collect())
    return Cuts(nulls, tuple(found[i * len(found) // rest] for i in range(1, rest)) if found else ())


def range_of(cuts: Cuts, column: str, spread: Column) -> Column:
    """The range of a row. Rows of an id that several ranges can hold, and those without id, are
    dealt to these by ``spread``, a 64-bit hash: a higher hash never goes to a lower range."""
    share = spread.cast("double") / float(1 << 64) + 0.5
    among = lambda lo, hi: F.least(lo + F.floor(share * (hi - lo + 1)), hi)
    c = F.col(column)
    there = F.lit(cuts.nulls) + among(_below(cuts.bounds, lambda b: b < c), _below(cuts.bounds, lambda b: b <= c))
    return F.when(c.isNull(), among(F.lit(0), F.lit(max(cuts.nulls - 1, 0)))).otherwise(there).cast("int")


def _below(bounds: tuple[int, ...], test) -> Column:
    """How many of the rising ``bounds`` pass ``test``, which the lowest do; found in two steps of
    about their root."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values, kind: F.from_json(F.lit(str([list(v) if isinstance(v, tuple) else v for v in values])), kind)
    passed = F.size(F.filter(longs([b[-1] for b in blocks], "array<bigint>"), test))
    inside = F.size(F.filter(F.get(longs([*blocks, ()], "array<array<bigint>>"), passed), test))
    return passed * step + F.when(passed == len(blocks), len(bounds) - step * len(blocks)).otherwise(inside)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers from the driver, as one literal of the plan."""
    import json

    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = ", ".join(f"{name}: {c.split()[1]}" for name, c in zip(names, schema.split(",")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))
