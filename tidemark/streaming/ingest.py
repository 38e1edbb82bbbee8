"""Ingest: deduplicated batches get contiguous sequence ranges and become visible as files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.times import bucket
from tidemark.operators.ranges import helper, ranked
from tidemark.sources.shared import written

DEDUPE = ["dedupe_hash_low", "dedupe_hash_high"]


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def submitted(batch: DataFrame, known: DataFrame) -> DataFrame:
    """``batch`` with receipt: 'ready' for the first row of a new dedupe key, 'duplicate' for a key
    that is known or comes again."""
    nth, met = helper(), helper()
    first = F.row_number().over(Window.partitionBy(*DEDUPE).orderBy("occurred_at", F.xxhash64(*batch.columns)))
    seen = known.select(*DEDUPE, F.lit(True).alias(met)).distinct()
    return batch.withColumn(nth, first).join(seen, DEDUPE, "left").withColumn("receipt", F.when(F.col(met) | (F.col(nth) > 1), "duplicate").otherwise("ready")).drop(nth, met)


def retry_receipts(batch: DataFrame, known: DataFrame, guard: DataFrame) -> DataFrame:
    """The same within a replay guard: a key whose fate isn't durable yet is 'unresolved'."""
    open_ = helper()
    pending = guard.select(*DEDUPE, F.lit(True).alias(open_)).distinct()
    return submitted(batch, known).join(pending, DEDUPE, "left").withColumn("receipt", F.when((F.col("receipt") == "ready") & F.col(open_), "unresolved").otherwise(F.col("receipt"))).drop(open_)


def numbered(batch: DataFrame, base: int, order: tuple[str, ...] = ("occurred_at", "event_id"), epoch: int = 1) -> DataFrame:
    """``batch`` with epoch and sequence base + 1, base + 2, ... by ``order``, without gaps or
    repetitions. ``batch`` is evaluated several times and must be the same each time: a source's
    rows, or a written table."""
    return ranked(batch, list(order), "sequence").withColumn("epoch", F.lit(epoch).cast("long")).withColumn("sequence", F.lit(base).cast("long") + F.col("sequence"))


@dataclass(frozen=True)
class Roll:
    """When a batch's file ends: at so many bytes (estimated from the batch's own rows) or rows, or
    where its time window of occurrence ends, whichever comes first."""

    target: int = 1 << 30
    rows: int = 0
    window: int = 3600 * 10**9


class Publisher:
    """Writes micro-batches as files below ``path`` and lists them in a manifest.

    A batch's folder carries its number and is replaced, not added to, when the batch runs again;
    its manifest row is written last. So a batch is visible whole or not at all, and once. Files
    end by the roll policy. A batch's keys are compared with those of the last ``horizon`` batches,
    or of all; keys lie apart from the events, a few bytes each.
    """

    def __init__(self, spark: SparkSession, path: str, epoch: int = 1, roll: Roll = Roll(), horizon: int | None = None):
        self.spark, self.path, self.epoch, self.roll, self.horizon = spark, path.rstrip("/"), epoch, roll, horizon

    def manifest(self) -> DataFrame:
        schema = "batch long, epoch long, first long, last long, row_count long"
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/manifest/*")
        except Exception as e:  # nothing was published yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _visible(self, table: str, manifest: DataFrame) -> DataFrame:
        """The rows of published batches; a folder that isn't listed is not read."""
        listed = manifest.where("row_count > 0").select(F.col("batch").alias("_batch"))
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        return rows.join(F.broadcast(listed), rows["batch"] == listed["_batch"], "left_semi").drop("batch", "roll_window")

    def events(self) -> DataFrame:
        """All published events."""
        return self._visible("events", self.manifest())

    def publish(self, batch: DataFrame, number: int) -> None:
        done = self.manifest()
        if not done.where(F.col("batch") == number).isEmpty():
            return  # published before a restart
        base, count = done.agg(F.coalesce(F.max("last"), F.lit(0)), F.count_if(F.col("row_count") > 0)).first()
        recent = done if self.horizon is None else done.where(F.col("batch") >= number - self.horizon)
        known = self._visible("keys", recent) if count else self.spark.createDataFrame([], batch.select(*DEDUPE).schema)
        # written once, so that every later read numbers the same rows
        ready = written(submitted(batch, known).where("receipt = 'ready'").drop("receipt"), "batch")
        n = ready.count()
        folder = f"batch={number:012d}"
        if n:
            out = numbered(ready, base, epoch=self.epoch)
            rows = self.roll.rows or max(1, self.roll.target * n // max(_size(ready), 1))
            out = out.withColumn("roll_window", bucket("occurred_at", self.roll.window))
            out = out.repartitionByRange("roll_window", "sequence").sortWithinPartitions("roll_window", "epoch", "sequence")
            out.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("roll_window").parquet(f"{self.path}/events/{folder}")
            ready.select(*DEDUPE).write.mode("overwrite").parquet(f"{self.path}/keys/{folder}")
        row = [(number, self.epoch, base + 1, base + n, n)]
        self.spark.createDataFrame(row, "batch long, epoch long, first long, last long, row_count long").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{folder}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run ``stream`` into this publisher; ``trigger`` as for writeStream, at once by default."""
        return stream.writeStream.foreachBatch(self.publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _size(table: DataFrame) -> int:
    """Bytes of a written table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def rolling_counts(stream: DataFrame, width: str = "1 minute", lateness: str | None = None) -> DataFrame:
    """Counts per tumbling window. Late events always count unless ``lateness`` opts into a
    watermark that drops them."""
    stream = stream if lateness is None else stream.withWatermark("ts", lateness)
    return stream.groupBy(F.window("ts", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def deduplicated(stream: DataFrame, horizon: str) -> DataFrame:
    """Drops repeated dedupe keys within a horizon of event time, with bounded state."""
    return stream.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(DEDUPE)
