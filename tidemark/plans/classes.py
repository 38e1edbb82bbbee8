"""The query classes of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import payload, predicates, text, times, vectors
from tidemark.operators import aggregates, rollup, scan, timeline, vector_search
from tidemark.plans import derived as d
from tidemark.plans.registry import query
from tidemark.sources.journal import GRANULE_ROWS, journal, table

MONEY = "CAST(value AS DECIMAL(18,2))"
HOUR = 3600 * 10**9


def money(c="value"):
    return F.col(c).cast("decimal(18,2)")


@query("q01_time_range_count", d.with_sql() + f" SELECT count(*) AS n FROM j WHERE occurred_at BETWEEN {d.YEAR + 3 * d.DAY} AND {d.YEAR + 9 * d.DAY}")
def q01(spark: SparkSession, sf: str) -> DataFrame:
    span = (predicates.Bound(d.YEAR + 3 * d.DAY), predicates.Bound(d.YEAR + 9 * d.DAY))
    return journal(spark, sf).where(predicates.in_range("occurred_at", *span)).agg(F.count("*").alias("n"))


@query("q02_time_bucket_count", d.with_sql() + f" SELECT occurred_at // {HOUR} AS bucket, count(*) AS n FROM j GROUP BY 1")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    return journal(spark, sf).groupBy(times.bucket("occurred_at", HOUR).alias("bucket")).agg(F.count("*").alias("n"))


@query("q03_filtered_count", d.with_sql() + " SELECT count(*) AS n FROM j WHERE event_type = 'click' AND user_id < 20")
def q03(spark: SparkSession, sf: str) -> DataFrame:
    return journal(spark, sf).where(predicates.equals("event_type", "click") & predicates.in_range("user_id", None, predicates.Bound(20, False))).agg(F.count("*").alias("n"))


@query("q04_sparse_cube", d.with_sql() + " SELECT event_type, user_id, count(*) AS n, grouping(event_type, user_id)::BIGINT AS level FROM j GROUP BY CUBE (event_type, user_id)")
def q04(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.sparse_cube(journal(spark, sf), ["event_type", "user_id"])


@query("q05_entity_timeline", d.with_sql() + " SELECT epoch, sequence, event_id, occurred_at, event_type, value FROM j WHERE user_id = 7 AND sequence BETWEEN 10 AND 100000 ORDER BY sequence LIMIT 50")
def q05(spark: SparkSession, sf: str) -> DataFrame:
    mine = timeline.timeline(journal(spark, sf), F.col("user_id") == 7, low=(1, 10), high=(1, 100000), limit=50)
    return mine.select("epoch", "sequence", "event_id", "occurred_at", "event_type", "value")


@query("q06_account_timeline", d.with_sql() + " SELECT sequence, event_id, event_type FROM j WHERE user_id % 10 = 3 ORDER BY sequence DESC LIMIT 100")
def q06(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.timeline(journal(spark, sf), F.col("user_id") % 10 == 3, descending=True, limit=100).select("sequence", "event_id", "event_type")


@query("q07_opportunity_timeline", d.with_sql() + " SELECT sequence, event_id, payload FROM j WHERE json_extract_string(payload, '$.k') = '42'")
def q07(spark: SparkSession, sf: str) -> DataFrame:
    rows = journal(spark, sf)
    return rows.where(payload.field(payload.parse("payload"), "k", "bigint") == 42).select("sequence", "event_id", "payload")


@query("q08_metadata_revenue", d.with_sql() + f" SELECT event_type, sum({MONEY})::DOUBLE AS revenue, count(*) AS n FROM j GROUP BY 1")
def q08(spark: SparkSession, sf: str) -> DataFrame:
    """From the stored sums of granules: no event is read."""
    return d.stored_revenue(spark, sf, GRANULE_ROWS).groupBy("event_type").agg(F.sum("s").cast("double").alias("revenue"), F.sum("c").alias("n"))


@query("q09_prepared_revenue", d.with_sql() + f" SELECT count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM j WHERE occurred_at >= {d.YEAR + 90 * 10**9} AND occurred_at < {d.YEAR + 20 * d.DAY + 12345}")
def q09(spark: SparkSession, sf: str) -> DataFrame:
    """Whole hours from the stored rollup, the two cut hours from the stored events."""
    rows, rolled = d.stored_events(spark, sf, GRANULE_ROWS), d.stored_rollup(spark, sf, HOUR)
    return rollup.range_aggregate(rows, rolled, "value", d.YEAR + 90 * 10**9, d.YEAR + 20 * d.DAY + 12345, HOUR).withColumn("sum", F.round("sum", 4))


@query("q10_dashboard", d.with_sql(d.NEWEST_SQL) + f" SELECT event_type, count(*) AS n, sum({MONEY})::DOUBLE AS total FROM n GROUP BY 1")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    rows = timeline.files_and_overlay(*d.copies(journal(spark, sf)))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(money()).cast("double").alias("total"))


@query("q11_overlay_timeline", d.with_sql(d.NEWEST_SQL) + " SELECT sequence, event_id, value FROM n WHERE entity_id = 'user-7' ORDER BY sequence LIMIT 60")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    files, overlay = d.copies(journal(spark, sf))
    return timeline.timeline(files.unionByName(overlay), F.col("entity_id") == "user-7", limit=60).select("sequence", "event_id", "value")


@query("q12_payload_predicate", d.with_sql() + " SELECT event_id, json_extract_string(payload, '$.k')::BIGINT AS k FROM j WHERE json_extract_string(payload, '$.k')::BIGINT > 90")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    rows = journal(spark, sf).withColumn("k", payload.field(payload.parse("payload"), "k", "bigint"))
    return rows.where(predicates.in_range("k", predicates.Bound(90, False))).select("event_id", "k")


@query("q13_shredded_filter", d.with_sql() + " SELECT event_type, count(*) AS n, sum(json_extract_string(payload, '$.k')::BIGINT)::BIGINT AS total FROM j WHERE json_extract_string(payload, '$.k')::BIGINT BETWEEN 10 AND 20 GROUP BY 1")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    shredded = journal(spark, sf).select("event_type", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))
    return shredded.where(F.col("k").between(10, 20)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("q14_residual_path", d.with_sql() + " SELECT event_id, json_extract_string(payload, '$.k') AS k, json_extract_string(payload, '$.absent') AS absent FROM j WHERE event_type = 'error' AND value > 15")
def q14(spark: SparkSession, sf: str) -> DataFrame:
    v = payload.parse("payload")
    return journal(spark, sf).where("event_type = 'error' and value > 15").select("event_id", payload.field(v, "k").alias("k"), payload.field(v, "absent").alias("absent"))


@query("q15_late_events", d.with_sql("l AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN sequence + 100000 ELSE sequence END AS sequence, occurred_at FROM j)") + f" SELECT event_id, sequence FROM l WHERE occurred_at BETWEEN {d.YEAR} AND {d.YEAR + 2 * d.DAY}")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    late = journal(spark, sf).withColumn("sequence", F.when(F.col("event_id") % 50 == 0, F.col("sequence") + 100000).otherwise(F.col("sequence")))
    return timeline.late_events(late, (d.YEAR, d.YEAR + 2 * d.DAY)).select("event_id", "sequence")


@query("q16_deletion_heavy", d.with_sql(d.DELETES_SQL) + f" SELECT event_type, count(*) AS n, sum({MONEY})::DOUBLE AS total FROM j WHERE row_ordinal NOT IN (SELECT row_ordinal FROM d) GROUP BY 1")
def q16(spark: SparkSession, sf: str) -> DataFrame:
    j = journal(spark, sf).withColumn("file_id", F.lit("f"))
    return timeline.without_deleted(j, d.deletes(j)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(money()).cast("double").alias("total"))


_CHAIN = """h AS (SELECT j.event_id AS root, j.event_id AS cur, j.event_id AS base, [j.payload][1:0] AS am, 0 AS hop, false AS gone FROM j WHERE j.sequence NOT IN (SELECT cseq FROM cc)
  UNION ALL SELECT h.root, n.event_id, CASE WHEN cc.kind = 'replacement' AND len(h.am) = 0 THEN n.event_id ELSE h.base END,
    CASE WHEN cc.kind = 'amendment' THEN list_append(h.am, n.payload) WHEN cc.kind = 'replacement' AND len(h.am) > 0 THEN list_append(h.am[1:len(h.am) - 1], n.payload) ELSE h.am END, h.hop + 1, cc.kind = 'retraction'
  FROM h JOIN cc ON cc.target = h.cur JOIN j n ON n.sequence = cc.cseq WHERE NOT h.gone),
z AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY hop DESC) AS nth FROM h)"""


@query(
    "q17_latest_view",
    d.with_sql(d.CORRECTIONS_SQL, _CHAIN).replace("WITH ", "WITH RECURSIVE ", 1)
    + " SELECT b.event_id, b.sequence, replace(json_extract_string(coalesce(z.am[len(z.am)], b.payload), '$.k'), ' ', '')::BIGINT AS k FROM z JOIN j b ON b.event_id = z.base WHERE z.nth = 1 AND NOT z.gone",
)
def q17(spark: SparkSession, sf: str) -> DataFrame:
    j = journal(spark, sf).select("epoch", "sequence", "event_id", "payload")
    latest = timeline.latest_versions(j, d.corrections(journal(spark, sf)), j)
    return latest.select("event_id", "sequence", payload.field(payload.parse("payload"), "k", "bigint").alias("k"))


@query("q18_context_packet", d.with_sql() + " SELECT occurred_at, event_type, entity_id, 'event ' || event_id AS title FROM j WHERE entity_id = 'user-3'")
def q18(spark: SparkSession, sf: str) -> DataFrame:
    rows = journal(spark, sf).where("entity_id = 'user-3'").withColumn("title", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    return scan.context_packet(rows)


@query("q19_token_search", r"SELECT doc_id, n_chars FROM documents WHERE list_contains(list_filter(string_split_regex(lower(text), '[\s!-&(-/:-@\[-`{-~]+'), lambda x: x <> ''), 'the') AND list_contains(list_filter(string_split_regex(lower(text), '[\s!-&(-/:-@\[-`{-~]+'), lambda x: x <> ''), 'of')")
def q19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(text.has_tokens("text", ["the", "of"])).select("doc_id", "n_chars")


@query("q20_semantic_retrieval", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id % 3 AS segment, vec_id AS row, vec_id::VARCHAR AS event_id, round(list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]), 5) AS score FROM embeddings, q WHERE label IN (1, 2, 3) AND vec_id BETWEEN 10 AND 400 ORDER BY list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, segment, row LIMIT 20")
def q20(spark: SparkSession, sf: str) -> DataFrame:
    rows, wanted = d.vectors(spark, sf), d.first_vector(spark, sf)
    where = vector_search.row_filter(rooms=[1, 2, 3], time=(10, 400))
    return vector_search.search(rows, wanted, 20, where, model="m1", metric="dot").withColumn("score", F.round("score", 5))


@query("q21_late_materialization", "SELECT doc_id, text FROM documents WHERE lang = 'de' AND n_chars > 3000")
def q21(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where((F.col("lang") == "de") & (F.col("n_chars") > 3000)).select("doc_id", "text")
