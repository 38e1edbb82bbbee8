"""Reading and writing event files. A file is Parquet; a granule is a run of rows within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.protobuf import Field, json_of
from tidemark.sources.journal import GRANULE_ROWS

#: Writer options that end row groups and pages with granules, so that a scan skips what its filters
#: rule out by their statistics.
GRANULES = {"parquet.block.row.count.limit": str(GRANULE_ROWS), "parquet.page.row.count.limit": str(GRANULE_ROWS)}
#: Profiles and what a file of each must obey.
PROFILES = ("event", "graph", "snapshot", "audit", "log", "inbox", "time_series")


def open_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Files on any Hadoop file system; remote ones are read by ranges and pruned by their statistics."""
    return spark.read.parquet(*paths)


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """A record stream in order: position, record."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("position"), F.col("value").alias("record"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines as text and variant payload; malformed lines have a null payload."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.try_parse_json("value").alias("payload"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Raw payload files: path, content and its SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("digest"))


def read_protobuf(df: DataFrame, column: str, fields: dict[int, Field]) -> DataFrame:
    """Protobuf messages as variant payloads by field name: enums by name (or number, if unknown),
    timestamps in nanoseconds. Malformed messages have a null payload."""
    return df.withColumn("payload", F.try_parse_json(json_of(fields)(column)))


def verify_external(df: DataFrame, content: str = "content", digest: str = "digest") -> DataFrame:
    """External payloads with their verdict: content is what the digest names."""
    return df.withColumn("verified", F.coalesce(F.sha2(F.col(content), 256) == F.lower(digest), F.lit(False)))


def checked(df: DataFrame, profile: str = "event", bucket_width: int | None = None) -> DataFrame:
    """``df`` after the profile's rules; a breach raises ValueError. Each rule is one aggregate."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    if (bucket_width is not None) != (profile == "time_series"):
        raise ValueError("a bucket width belongs to time series and to nothing else")
    if bucket_width is not None and bucket_width <= 0:
        raise ValueError("the bucket width must be positive")
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("a column is named twice")
    if missing := [c for c in {"snapshot": ["entity_id"], "inbox": ["recipient", "row_ordinal"], "time_series": ["occurred_at"]}.get(profile, []) if c not in df.columns]:
        raise ValueError(f"a {profile} file needs {', '.join(missing)}")
    tests = {"a file needs a row": F.count("*") == 0}
    if profile == "snapshot":
        tests["a snapshot has one epoch"] = F.min("epoch") < F.max("epoch")
        tests["a snapshot's rows need an entity_id"] = F.count_if(F.col("entity_id").isNull()) > 0
    row = df.agg(*[F.coalesce(t, F.lit(False)).alias(str(i)) for i, t in enumerate(tests.values())]).first()
    for i, rule in enumerate(tests):
        if row[str(i)]:
            raise ValueError(rule)
    twice = df.groupBy("epoch", "sequence").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("two rows have the same epoch and sequence")
    if profile == "inbox" and not sorted_by(df, ["row_ordinal"], "recipient"):
        raise ValueError("an inbox file is in recipient order")
    if profile == "time_series" and not sorted_by(df, ["epoch", "sequence"], "occurred_at"):
        raise ValueError("occurred_at goes back")
    return df


def sorted_by(df: DataFrame, order: list[str], column: str) -> bool:
    """Whether ``column`` never falls along ``order``: by ranges, each checked by itself, and the
    ranges' ends against each other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(*order, column).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # per part: does it fall anywhere, and its first and last value; parts are few
    from pyspark.sql import Window

    part = ranged.withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*order)
    fell = part.withColumn("_falls", F.col(column) < F.lag(column).over(w))
    ends = fell.groupBy("_part").agg(F.max(F.coalesce("_falls", F.lit(False))).alias("falls"), F.min(column).alias("low"), F.max(column).alias("high"), F.min(F.struct(*order)).alias("at")).orderBy("at").collect()
    held = [r for r in ends if r["high"] is not None]  # a part may hold nulls only
    return not any(r["falls"] for r in ends) and all(a["high"] <= b["low"] for a, b in zip(held, held[1:]))


def write_events(df: DataFrame, path: str, profile: str = "event", order: tuple[str, ...] = ("epoch", "sequence"), files: int | None = None, rows_per_file: int = 0, **checks) -> None:
    """Rows in (epoch, sequence) order, over all files; a repeated write replaces, never adds."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = checked(df, profile, **checks).repartitionByRange(n, *order).sortWithinPartitions(*order)
    out.write.mode("overwrite").options(maxRecordsPerFile=rows_per_file, compression="zstd", **GRANULES).parquet(path)


#: Other sort orders of the same rows.
PROJECTIONS = {
    "entity": ("entity_id_hash_low", "entity_id_hash_high", "epoch", "sequence"),
    "time_major": ("occurred_at", "epoch", "sequence"),
    "source_type_major": ("source_id", "event_type_id", "epoch", "sequence"),
    "context_major": ("trace_id_hash_low", "epoch", "sequence"),
    "revenue_metric_major": ("account_id_hash_low", "event_type_id", "occurred_at", "epoch", "sequence"),
}


def write_projection(df: DataFrame, path: str, projection: str = "entity") -> None:
    """The same rows in a projection's order; duplicate points are refused."""
    write_events(df, path, order=PROJECTIONS[projection])


def with_changes(df: DataFrame, changes: DataFrame, key: str = "row_ordinal") -> DataFrame:
    """``df`` with changed rows replaced: ``changes`` has the same columns, one row per key."""
    return df.join(changes.select(key), key, "left_anti").unionByName(changes.select(*df.columns))


def snapshot_get(df: DataFrame, key: str) -> DataFrame:
    """The payload under a key, or no row."""
    return df.where(F.col("entity_id") == key).select("entity_id", "payload")


def granule_of(ordinal: str = "row_ordinal", rows: int = GRANULE_ROWS):
    return F.floor(F.col(ordinal) / rows)
