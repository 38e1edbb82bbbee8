"""The event model: an envelope of fixed columns and one semi-structured payload.

``journal`` gives the test tables' events the envelope's shape; other sources need only deliver the
columns of ``ENVELOPE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import nanos_of

GRANULE_ROWS = 8192

# The envelope's columns, in order, and their types.
_REQUIRED = {
    "epoch": "long", "sequence": "long", "stream_id": "long", "stream_sequence": "long", "occurred_at": "long", "ingested_at": "long",
    "source_id": "long", "event_type_id": "long", "entity_type_id": "long", "entity_id_hash_low": "long", "entity_id_hash_high": "long", "payload_ref": "long",
    "flags": "long", "schema_version": "long", "event_id": "string", "entity_id": "string", "actor_id": "string", "account_id": "string",
    "actor_id_hash_low": "long", "account_id_hash_low": "long", "trace_id_hash_low": "long", "dedupe_hash_low": "long", "dedupe_hash_high": "long", "payload_flags": "long",
}
_NULLABLE = {"entity_id", "actor_id", "account_id"}
ENVELOPE = T.StructType([T.StructField(n, {"string": T.StringType(), "long": T.LongType()}[t], n in _NULLABLE) for n, t in _REQUIRED.items()])
# Columns that only internal callers may read: points, hashes, references, raw bytes and row places.
INTERNAL = [
    "epoch", "sequence", "entity_id_hash_low", "entity_id_hash_high", "payload_ref", "actor_id_hash_low", "account_id_hash_low", "trace_id_hash_low", "dedupe_hash_low", "dedupe_hash_high", "payload_flags",
    "parent_ref", "root_ref", "linked_refs", "related_refs", "prev_refs", "auth_refs", "raw_payload", "row_ordinal", "granule_id",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str, granule_rows: int = GRANULE_ROWS) -> DataFrame:
    """The events table as an event stream: epoch 1, sequence event_id + 1, nanosecond times."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.lit(1).cast("long").alias("epoch"),
        (F.col("event_id") + 1).alias("sequence"),
        "event_id",
        nanos_of("ts", dict(events.dtypes)["ts"]).alias("occurred_at"),
        "ts",
        "user_id",
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity_id"),
        "event_type",
        "value",
        F.col("props").alias("payload"),
        F.col("event_id").alias("row_ordinal"),
        F.floor(F.col("event_id") / granule_rows).alias("granule_id"),
    )


#: The same in SQL, for comparisons.
JOURNAL_SQL = """j AS (SELECT 1::BIGINT AS epoch, event_id + 1 AS sequence, event_id, epoch_us(ts) * 1000 AS occurred_at, ts, user_id,
  'user-' || user_id AS entity_id, event_type, value, props AS payload, event_id AS row_ordinal, event_id // 8192 AS granule_id FROM events)"""
