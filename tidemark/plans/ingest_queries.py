"""Queries over writing, ingest, the overlay and what is left of payloads, sorts and security."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import identifiers, payload, predicates, times, vectors
from tidemark.operators import aggregates, corrections, graph, lifecycle, pruning, security
from tidemark.plans import derived as d
from tidemark.plans.classes import HOUR
from tidemark.plans.registry import query
from tidemark.sources import files, replay, shared
from tidemark.sources.journal import journal, table
from tidemark.streaming import ingest, watermarks

J = d.with_sql()


def _folder(spark: SparkSession) -> str:
    return shared.folder(spark, "queries")


@query("s08_live_overlay_segments", J + " SELECT event_id, 401::BIGINT AS asked_first FROM j WHERE sequence BETWEEN 401 AND 500")
def s08b(spark, sf):
    """The segments that a live read gets: those of 401..500, which are there whole; 501..600 waits."""
    segments = journal(spark, sf).where("sequence <> 550").select("epoch", F.col("sequence").alias("first"), F.col("sequence").alias("last"), "event_id")
    asked = spark.createDataFrame([(1, 401, 500), (1, 501, 600)], "epoch long, first long, last long")
    return watermarks.live_read(segments, segments, asked)[0].select("event_id", "asked_first")


@query("s08_live_overlay_read", J + " SELECT 1::BIGINT AS epoch, 501::BIGINT AS first, 600::BIGINT AS last")
def s08(spark, sf):
    """Which asked ranges a live read must wait for: 401..500 is durable, 501..600 has a hole."""
    rows = journal(spark, sf).where("sequence <> 550").select("epoch", F.col("sequence").alias("first"), F.col("sequence").alias("last"))
    asked = spark.createDataFrame([(1, 401, 500), (1, 501, 600)], "epoch long, first long, last long")
    return watermarks.missing(rows, asked)


@query("s12_write_events", J + " SELECT epoch, sequence, event_id, occurred_at, entity_id, event_type, value FROM j")
def s12(spark, sf):
    path = _folder(spark)
    rows = journal(spark, sf).select("epoch", "sequence", "event_id", "occurred_at", "entity_id", "event_type", "value")
    files.write_events(rows, path)
    return files.open_events(spark, path)


@query("s14_time_projection", J + " SELECT epoch, sequence, occurred_at FROM j")
def s14(spark, sf):
    path = _folder(spark)
    files.write_projection(journal(spark, sf).select("epoch", "sequence", "occurred_at"), path, "time_major")
    return files.open_events(spark, path)


@query("s11_json_source", J + " SELECT json_extract_string(payload, '$.k')::BIGINT AS k, count(*) AS n FROM j GROUP BY 1")
def s11(spark, sf):
    path = _folder(spark)
    journal(spark, sf).select("payload").write.text(path)
    return files.read_json(spark, path).groupBy(payload.field("payload", "k", "bigint").alias("k")).agg(F.count("*").alias("n"))


def _submitted(spark, sf):
    n = F.col("event_id")
    return journal(spark, sf).select("event_id", "occurred_at", "ts", (n % 700).alias("dedupe_hash_low"), F.lit(7).cast("long").alias("dedupe_hash_high"))


@query("t01_submit_receipts", J + " SELECT event_id, CASE WHEN event_id % 700 < 100 OR event_id >= 700 THEN 'duplicate' ELSE 'ready' END AS receipt FROM j")
def t01(spark, sf):
    rows = _submitted(spark, sf)
    return ingest.submitted(rows, rows.where("event_id < 100")).select("event_id", "receipt")


@query("t02_sequence_range", J + " SELECT event_id, 1000 + row_number() OVER (ORDER BY occurred_at DESC) AS sequence FROM j")
def t02(spark, sf):
    rows = journal(spark, sf).select("event_id", (-F.col("occurred_at")).alias("occurred_at"))
    return ingest.numbered(rows, 1000).select("event_id", "sequence")


@query("s16_publish_stream", J + " SELECT event_id, sequence FROM j WHERE event_id < 700")
def s16(spark, sf):
    """A stream of the events into published files; repeated dedupe keys come through once."""
    path = _folder(spark)
    _submitted(spark, sf).sortWithinPartitions("event_id").coalesce(1).write.parquet(f"{path}/in")
    publisher = ingest.Publisher(spark, f"{path}/out")
    schema = spark.read.parquet(f"{path}/in").schema
    publisher.start(ingest.read_stream(spark, f"{path}/in", schema), f"{path}/checkpoint").awaitTermination()
    return publisher.events().select("event_id", "sequence")


@query("t09_expired_leases", J + " SELECT epoch, sequence * 10 AS first, sequence * 10 + 9 AS last FROM j WHERE event_id <= 400 AND event_id % 3 <> 0")
def t09(spark, sf):
    rows = journal(spark, sf)
    leases = rows.select("epoch", (F.col("sequence") * 10).alias("first"), (F.col("sequence") * 10 + 9).alias("last"), F.col("event_id").alias("expires_at"), (F.col("event_id") % 3 == 0).alias("used"))
    return watermarks.expired_leases(leases, 400)


@query("t10_safe_retry", J + " SELECT event_id, CASE WHEN event_id % 700 < 100 OR event_id >= 700 THEN 'duplicate' WHEN event_id BETWEEN 300 AND 320 THEN 'unresolved' ELSE 'ready' END AS receipt FROM j")
def t10(spark, sf):
    rows = _submitted(spark, sf)
    return ingest.retry_receipts(rows, rows.where("event_id < 100"), rows.where("event_id between 300 and 320")).select("event_id", "receipt")


@query("t11_tumbling_buckets", J + f" SELECT (occurred_at // {HOUR}) * 3600 AS start_second, event_type, count(*) AS n FROM j GROUP BY 1, 2")
def t11(spark, sf):
    return journal(spark, sf).groupBy(times.bucket_start("occurred_at", HOUR).alias("s"), "event_type").agg(F.count("*").alias("n")).select(times.seconds("s").alias("start_second"), "event_type", "n")


@query("f13_granules_by_entity", J + " SELECT DISTINCT event_id // 256 AS granule_id FROM j WHERE entity_id = 'user-7'")
def f13(spark, sf):
    return journal(spark, sf, 256).where(F.col("entity_id") == "user-7").select("granule_id").distinct()


@query("p03_payload_merged", J + " SELECT event_id, json_extract_string(payload, '$.k')::BIGINT AS k, event_type AS kind FROM j")
def p03(spark, sf):
    """A shredded field and the residual merged back into one payload."""
    rows = journal(spark, sf).select("event_id", F.get_json_object("payload", "$.k").cast("bigint").alias("k"), F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("residual"))
    whole = corrections.merged_payload(F.try_parse_json("residual"), F.array(F.try_parse_json(F.to_json(F.struct("k")))))
    return rows.withColumn("payload", whole).select("event_id", payload.field("payload", "k", "bigint").alias("k"), payload.field("payload", "kind").alias("kind"))


@query("p05_nested_path", J + " SELECT event_id, json_extract_string(payload, '$.k')::BIGINT AS k, NULL::VARCHAR AS wrong FROM j")
def p05(spark, sf):
    v = payload.parse(F.concat(F.lit('{"a": [0, '), "payload", F.lit("]}")))
    return journal(spark, sf).select("event_id", payload.nested(v, ["a", 1, "k"], "bigint").alias("k"), payload.nested(v, ["a", "k"]).alias("wrong"))


@query("c01_json_numbers", J + " SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'double' WHEN event_id % 3 = 1 THEN 'int' ELSE 'decimal' END AS kind FROM j")
def c01(spark, sf):
    v = lambda text: payload.kind_of(payload.nested(payload.parse(text), ["x"], "variant"))
    """Whole numbers, numbers with a fraction, and such as no 64 bits hold, side by side in a column."""
    n, third = F.col("event_id").cast("string"), F.col("event_id") % 3
    number = F.when(third == 0, F.concat(n, F.lit(".50"))).when(third == 1, n).otherwise(F.concat(F.lit("99999999999999999"), n, F.lit("0000")))
    return journal(spark, sf).select("event_id", v(F.concat(F.lit('{"x": '), number, F.lit("}"))).alias("kind"))


@query("c04_collect_keys", J + " SELECT 'k' AS key UNION ALL SELECT 'outer' UNION ALL SELECT 'list'")
def c04(spark, sf):
    text = F.concat(F.lit('{"outer": {"list": [1, '), "payload", F.lit("]}}"))
    return payload.collect_keys(journal(spark, sf).select(payload.parse(text).alias("payload")))


@query("c15_content_hash", J + " SELECT event_id, rtrim(base64(unhex(sha256('{\"n\":' || event_id || '}'))), '=') AS hash FROM j")
def c15(spark, sf):
    text = F.concat(F.lit('{"unsigned": {}, "n": '), F.col("event_id").cast("string"), F.lit("}"))
    return journal(spark, sf).select("event_id", identifiers.content_hash(text).alias("hash"))


@query("c16_hex", J + " SELECT event_id, lower(hex(encode(event_type))) AS h FROM j")
def c16(spark, sf):
    there = identifiers.to_hex(F.col("event_type").cast("binary"))
    return journal(spark, sf).select("event_id", identifiers.to_hex(identifiers.from_hex(there)).alias("h"))


@query("c19_half_floats", "SELECT vec_id, true AS close FROM embeddings")
def c19(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", vectors.half("embedding").alias("h"))
    return v.select("vec_id", F.forall(F.zip_with("embedding", "h", lambda x, y: F.abs(x - y) <= F.abs(x) / 1024 + 1e-7), lambda t: t).alias("close"))


@query("c19_one_bit_decoded", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x > 0)::INT))::BIGINT AS ups FROM embeddings")
def c19b(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", vectors.dequantize_u1(vectors.quantize_u1("embedding")).alias("x"))
    return v.select("vec_id", F.size(F.filter("x", lambda x: x > 0)).cast("long").alias("ups"))


@query("a05_distinct_of_parts", J + " SELECT 'user_id' AS part, true AS merged, true AS whole UNION ALL SELECT 'event_id', true, true")
def a05(spark, sf):
    """Sketches per granule, merged, and one sketch of all rows: both estimates lie within four
    standard errors of the exact number."""
    rows, out = journal(spark, sf, 256), None
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 4 * aggregates.HLL_ERROR * F.col("exact")
    for c in ("user_id", "event_id"):
        merged = aggregates.merged_distinct(aggregates.distinct_sketch(rows, c, ["granule_id"]))
        whole = aggregates.merged_distinct(aggregates.distinct_sketch(rows, c, [])).withColumnRenamed("distinct", "whole")
        exact = rows.agg(F.count_distinct(c).alias("exact"))
        one = merged.join(whole).join(exact).select(F.lit(c).alias("part"), near("distinct").alias("merged"), near("whole").alias("whole"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a15_quantiles", J + " SELECT event_type, 0.1::DOUBLE AS fraction, quantile_disc(value, 0.1) AS quantile FROM j GROUP BY 1 UNION ALL SELECT event_type, 0.5, quantile_disc(value, 0.5) FROM j GROUP BY 1 UNION ALL SELECT event_type, 0.9, quantile_disc(value, 0.9) FROM j GROUP BY 1")
def a15(spark, sf):
    """Exact where a group has fewer rows than the sketch's accuracy, 10,000; near it beyond."""
    found = aggregates.quantiles(journal(spark, sf), "value", [0.1, 0.5, 0.9], ["event_type"])
    at = F.explode(F.arrays_zip(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)).alias("fraction"), F.col("quantiles").alias("quantile"))).alias("x")
    return found.select("event_type", at).select("event_type", F.col("x.fraction").alias("fraction"), F.col("x.quantile").alias("quantile"))


@query("a15_frequent_values", J + " SELECT event_type AS item, count(*) AS count FROM j GROUP BY 1 ORDER BY 2 DESC LIMIT 2")
def a15b(spark, sf):
    """Few distinct values: the approximate answer is exact."""
    return aggregates.frequent(journal(spark, sf), "event_type", 2)


@query("a13_revenue", "SELECT l_returnflag, sum(CAST(CAST(l_extendedprice AS DECIMAL(38,4)) AS DOUBLE))::DECIMAL(38,2)::DOUBLE AS revenue, count(*) AS n FROM lineitem GROUP BY 1")
def a13(spark, sf):
    rows = aggregates.revenue(F.col("l_extendedprice"), [F.col("l_returnflag")], table(spark, sf, "lineitem"))
    return rows.withColumn("revenue", F.col("revenue").cast("decimal(38,2)").cast("double"))


@query("w04_sortedness", J + ", p AS (SELECT event_id // 256 AS granule_id, value < lag(value) OVER (PARTITION BY event_id // 256 ORDER BY sequence) AS falls, occurred_at < lag(occurred_at) OVER (PARTITION BY event_id // 256 ORDER BY sequence) AS back FROM j) SELECT granule_id, NOT coalesce(bool_or(falls), false) AS by_value, NOT coalesce(bool_or(back), false) AS by_time FROM p GROUP BY 1")
def w04(spark, sf):
    """Which granules prove an order; a sort may be left out only if all do."""
    w = Window.partitionBy("granule_id").orderBy("sequence")
    falls = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False))
    rows = journal(spark, sf, 256).select("granule_id", (F.col("value") < F.lag("value").over(w)).alias("f"), (F.col("occurred_at") < F.lag("occurred_at").over(w)).alias("b"))
    return rows.groupBy("granule_id").agg((~falls("f")).alias("by_value"), (~falls("b")).alias("by_time"))


@query("d02_correction_kinds", d.with_sql(d.CORRECTIONS_SQL) + " SELECT kind AS correction_type, count(*) AS n FROM c WHERE target >= 0 GROUP BY 1")
def d02(spark, sf):
    return d.corrections(journal(spark, sf)).groupBy("correction_type").agg(F.count("*").alias("n"))


@query("g03_chain_labels", J + " SELECT event_id * 2 AS sn, CASE WHEN event_id * 2 IN (SELECT event_id FROM j) THEN (event_id * 2) % 7 END AS chain_id FROM j")
def g03(spark, sf):
    rows = journal(spark, sf)
    labels = rows.select(F.col("event_id").alias("sn"), (F.col("event_id") % 7).alias("chain_id"), F.col("sequence").alias("seq"))
    return graph.chain_labels(labels, rows.select((F.col("event_id") * 2).alias("sn"))).select("sn", "chain_id")


@query("g05_resolved_edges", J + " SELECT a.event_id AS child_sn, b.sequence AS parent_sn FROM j a JOIN j b ON b.event_id = a.event_id // 2")
def g05(spark, sf):
    rows = journal(spark, sf)
    refs = rows.select(F.col("event_id").alias("child_sn"), F.floor(F.col("event_id") / 2).alias("parent_id"))
    return graph.resolved_edges(refs, rows.select("event_id", F.col("sequence").alias("sn")))


@query("x06_filter_choices", J + " SELECT 'event_type' AS \"column\", 'bitmap_or_value_set' AS choice UNION ALL SELECT 'event_id', 'split_block_bloom'")
def x06(spark, sf):
    rows = journal(spark, sf)
    n = rows.count()
    found = aggregates.distinct_estimate(rows, ["event_type", "event_id"], 256).collect()
    return spark.createDataFrame([(r["column"], pruning.recommend_filter(r["distinct"], n, False)) for r in found], "column string, choice string")


@query("x10_fold_settled", J + " SELECT event_id, event_id % 100 <= 40 AS embedded FROM j")
def x10(spark, sf):
    sidecar = journal(spark, sf).select("event_id", (F.col("event_id") % 100).alias("horizon"))
    settled, rest = lifecycle.fold_settled(sidecar, 40)
    return settled.select("event_id", F.lit(True).alias("embedded")).unionByName(rest.select("event_id", F.lit(False).alias("embedded")))


@query("x12_retirable_files", J + " SELECT event_id AS file_id FROM j WHERE event_id % 4 = 0 AND event_id <= 600 AND event_id + 50 <= 500")
def x12(spark, sf):
    rows = journal(spark, sf).select(F.col("event_id").alias("file_id"), F.when(F.col("event_id") % 4 == 0, "outdated").otherwise("active").alias("state"), F.col("event_id").alias("outdated_at_generation"), (F.col("event_id") + 50).alias("horizon"))
    return lifecycle.retirable(rows, spark.createDataFrame([(600,), (900,)], "generation long"), 500).select("file_id")


@query("k05_seal", J + " SELECT count(*) AS n, true AS same FROM j")
def k05(spark, sf):
    rows = journal(spark, sf).select("event_id", "payload")
    a, b = security.seal(rows, ["event_id", "payload"]), security.seal(rows.orderBy(F.col("event_id").desc()), ["event_id", "payload"])
    return a.crossJoin(b.select(F.col("seal").alias("other"))).select("n", (F.col("seal") == F.col("other")).alias("same"))




_FRAMES_SQL = J + """, f AS (SELECT event_id // 100 AS segment, event_id AS position, event_type AS payload,
  CASE WHEN event_id % 300 = 170 THEN 'altered' ELSE sha256(event_type) END AS hash, sha256(lag(event_type) OVER (PARTITION BY event_id // 100 ORDER BY event_id)) AS previous FROM j WHERE event_id % 500 <> 260)"""


@query("s10_journal_replay", _FRAMES_SQL + " SELECT segment, count(*) FILTER (position % 100 < CASE WHEN segment % 5 = 2 THEN 60 WHEN segment % 3 = 1 THEN 70 ELSE 100 END) AS kept, segment % 3 = 1 OR segment % 5 = 2 AS torn FROM f GROUP BY 1")
def s10(spark, sf):
    """Segments of 100 frames; in some a frame was altered, in some one is missing."""
    w = Window.partitionBy("segment").orderBy("position")
    rows = journal(spark, sf).where("event_id % 500 <> 260").select(F.floor(F.col("event_id") / 100).alias("segment"), F.col("event_id").alias("position"), F.col("event_type").alias("payload"))
    rows = rows.withColumn("hash", F.when(F.col("position") % 300 == 170, "altered").otherwise(F.sha2("payload", 256))).withColumn("previous", F.sha2(F.lag("payload").over(w), 256))
    return replay.tails(rows)


@query("s09_log_records", J + " SELECT event_type || ' ' || event_id AS record FROM j")
def s09(spark, sf):
    path = _folder(spark)
    journal(spark, sf).select(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value")).write.text(path)
    return files.open_log(spark, path).select("record")


@query("x07_bloom_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (17, 42)")
def x07(spark, sf):
    """A written copy with a Bloom filter on a column; equality reads may skip by it."""
    path = _folder(spark)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rows.write.options(**pruning.bloom_options({"l_partkey": 100_000})).parquet(path)
    return files.open_events(spark, path).where(F.col("l_partkey").isin(17, 42)).select("l_orderkey", "l_linenumber")


@query("c08_stable_hash", J + " SELECT count(DISTINCT event_type) AS types, count(DISTINCT entity_id) AS entities FROM j")
def c08(spark, sf):
    return journal(spark, sf).agg(F.count_distinct(identifiers.stable_hash("event_type")).alias("types"), F.count_distinct(identifiers.stable_hash("entity_id")).alias("entities"))


@query("c11_relationship_kinds", J + " SELECT event_id, event_id % 3 <> 0 AND (event_id % 3 <> 1 OR event_id % 2 = 0) AS valid FROM j")
def c11(spark, sf):
    """Unknown kinds, single-valued kinds with one or two references, and many-valued kinds."""
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "cousin").when(n % 3 == 1, "parent").otherwise("prev")
    refs = F.when(n % 2 == 0, "event:01").otherwise("event:01 event:02")
    return journal(spark, sf).select("event_id", identifiers.relationships_valid(kind, refs).alias("valid"))


@query("f06_other_kind", J + " SELECT event_id FROM j WHERE false")
def f06(spark, sf):
    return journal(spark, sf).where(predicates.numeric_on_other_kind("event_type")).select("event_id")
