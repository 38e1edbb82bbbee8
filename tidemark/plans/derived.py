"""Tables that follow from the events by plain rules, in Spark and in SQL alike: file and overlay
copies, deletions, corrections, the event graph and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import pruning, rollup
from tidemark.sources.files import GRANULES
from tidemark.sources.journal import JOURNAL_SQL, journal
from tidemark.sources.prepared import prepared

DAY = 86_400 * 10**9
#: 2024-01-01 in nanoseconds.
YEAR = 1_704_067_200 * 10**9


def with_sql(*ctes: str) -> str:
    return "WITH " + ", ".join((JOURNAL_SQL, *ctes))


def deletes(j: DataFrame) -> DataFrame:
    return j.where("event_id % 13 = 4").select(F.lit("f").alias("file_id"), "row_ordinal")


DELETES_SQL = "d AS (SELECT row_ordinal FROM j WHERE event_id % 13 = 4)"


def copies(j: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, overlay): the first 90 % of each ten in a file of generation 1, multiples of 5 again
    in generation 2 with doubled value, and every fourth of ten in the overlay with value -1."""
    base = j.select("epoch", "sequence", "event_id", "entity_id", "event_type", "occurred_at", "value")
    one = base.where("event_id % 10 <> 9").withColumn("generation", F.lit(1)).withColumn("file_id", F.lit("a"))
    two = base.where("event_id % 5 = 0").withColumn("value", F.col("value") * 2).withColumn("generation", F.lit(2)).withColumn("file_id", F.lit("b"))
    over = base.where("event_id % 10 in (4, 9)").withColumn("value", F.lit(-1.0)).withColumn("generation", F.lit(9)).withColumn("file_id", F.lit(None).cast("string"))
    return one.unionByName(two), over


#: What is left of the copies: newest file copy, else the overlay.
NEWEST_SQL = """n AS (SELECT epoch, sequence, event_id, entity_id, event_type, occurred_at,
  CASE WHEN event_id % 5 = 0 THEN value * 2 WHEN event_id % 10 = 9 THEN -1.0 ELSE value END AS value FROM j)"""


def corrections(j: DataFrame) -> DataFrame:
    """Event n corrects event n - 1 where n % 97 = 1 (amendment), n - 2 where n % 89 = 2
    (replacement), n - 3 where n % 83 = 3 (retraction), and n - 1 where n % 97 = 2: a second hop."""
    n = F.col("event_id")
    rules = [("n % 97 = 1", 1, "amendment"), ("n % 97 = 2", 1, "replacement"), ("n % 89 = 2", 2, "replacement"), ("n % 83 = 3", 3, "retraction")]
    out = None
    for rule, back, kind in rules:
        part = j.where(rule.replace("n ", "event_id ")).select((n - back).alias("corrects_event_id"), F.col("epoch").alias("correction_epoch"), F.col("sequence").alias("correction_sequence"), F.lit(1).alias("correction_generation"), F.lit(kind).alias("correction_type"))
        out = part if out is None else out.unionByName(part)
    return out.where("corrects_event_id >= 0")


CORRECTIONS_SQL = """c AS (SELECT event_id - 1 AS target, sequence AS cseq, 'amendment' AS kind FROM j WHERE event_id % 97 = 1
  UNION ALL SELECT event_id - 1, sequence, 'replacement' FROM j WHERE event_id % 97 = 2
  UNION ALL SELECT event_id - 2, sequence, 'replacement' FROM j WHERE event_id % 89 = 2
  UNION ALL SELECT event_id - 3, sequence, 'retraction' FROM j WHERE event_id % 83 = 3 AND event_id >= 3),
cc AS (SELECT target, cseq, kind FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cseq DESC) AS nth FROM c) WHERE nth = 1 AND target >= 0)"""


def edges(j: DataFrame) -> DataFrame:
    """prev: the user's event before; auth: the first event of the type."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    prev = j.select(F.lit("all").alias("subject"), F.col("event_id").alias("child_sn"), F.lit("prev").alias("kind"), F.lag("event_id").over(w).alias("parent_sn"), F.lit(0).alias("ord")).where("parent_sn is not null")
    first = j.groupBy("event_type").agg(F.min("event_id").alias("parent_sn"))
    auth = j.join(first, "event_type").where("parent_sn < event_id").select(F.lit("all").alias("subject"), F.col("event_id").alias("child_sn"), F.lit("auth").alias("kind"), "parent_sn", F.lit(0).alias("ord"))
    return prev.unionByName(auth)


EDGES_SQL = """p AS (SELECT event_id AS child_sn, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_sn FROM j),
a AS (SELECT j.event_id AS child_sn, f.parent_sn FROM j JOIN (SELECT event_type, min(event_id) AS parent_sn FROM j GROUP BY 1) f ON f.event_type = j.event_type WHERE f.parent_sn < j.event_id),
e AS (SELECT child_sn, 'prev' AS kind, parent_sn FROM p WHERE parent_sn IS NOT NULL UNION ALL SELECT child_sn, 'auth', parent_sn FROM a)"""


def state_deltas(j: DataFrame) -> DataFrame:
    """Each event sets (type, user) to itself; an 'error' with an even number takes the key out."""
    return j.select(F.col("event_type").alias("type_id"), F.col("entity_id").alias("state_key_id"), F.col("event_id").alias("sn"), F.when(~((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)), F.col("event_id")).alias("value"))


STATE_SQL = "s AS (SELECT event_type AS type_id, entity_id AS state_key_id, event_id AS sn, CASE WHEN NOT (event_type = 'error' AND event_id % 2 = 0) THEN event_id END AS value FROM j)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as rows of three segments."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select((F.col("vec_id") % 3).alias("segment"), F.col("vec_id").alias("row"), F.col("vec_id").cast("string").alias("event_id"), F.col("label").alias("room_id"), (F.col("vec_id") % 7).cast("string").alias("sender"), F.col("vec_id").alias("timestamp"), F.lit("m1").alias("model"), "embedding")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").first()["embedding"])


def of_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir)


def stored_events(spark: SparkSession, sf_dir: str, granule_rows: int) -> DataFrame:
    """The journal as files in (epoch, sequence) order, whose row groups and pages are granules."""
    rows = journal(spark, sf_dir, granule_rows)
    options = {k: str(granule_rows) for k in GRANULES}
    return prepared(spark, f"{sf_dir}/events.parquet", f"events-{granule_rows}", lambda: rows.repartitionByRange("epoch", "sequence").sortWithinPartitions("epoch", "sequence"), **options)


def stored_stats(spark: SparkSession, sf_dir: str, granule_rows: int) -> DataFrame:
    """One row per granule: row_count and the spans of the columns that queries prune by."""
    make = lambda: pruning.granule_stats(stored_events(spark, sf_dir, granule_rows), ["sequence", "occurred_at", "event_type", "entity_id"]).coalesce(1)
    return prepared(spark, f"{sf_dir}/events.parquet", f"stats-{granule_rows}", make)


def stored_rollup(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """Summaries of ``value`` per bucket of ``width``."""
    return prepared(spark, f"{sf_dir}/events.parquet", f"rollup-{width}", lambda: rollup.rollup(journal(spark, sf_dir), ["value"], width).coalesce(1))


def stored_revenue(spark: SparkSession, sf_dir: str, granule_rows: int) -> DataFrame:
    """Exact sums and counts of ``value`` per granule and event type."""
    rows = journal(spark, sf_dir, granule_rows)
    make = lambda: rows.groupBy("granule_id", "event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("s"), F.count("*").alias("c")).coalesce(1)
    return prepared(spark, f"{sf_dir}/events.parquet", f"revenue-{granule_rows}", make)
