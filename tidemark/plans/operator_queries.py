"""A query for every other operator, named by what it does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import identifiers, payload, predicates, text, times, vectors
from tidemark.functions.predicates import Bound
from tidemark.operators import aggregates, audit, bitmaps, corrections, graph, inbox, lifecycle, pruning, ranges, relations, rollup, scan, security, state, timeline, vector_search
from tidemark.plans import derived as d
from tidemark.plans.classes import HOUR, money
from tidemark.plans.registry import query
from tidemark.sources import files, manifest
from tidemark.sources.journal import GRANULE_ROWS, journal, table
from tidemark.streaming import watermarks

J = d.with_sql()
#: Smaller granules than production's, so that small tables have several.
ROWS = 256


def _j(spark: SparkSession, sf: str) -> DataFrame:
    return journal(spark, sf)


def _g(spark: SparkSession, sf: str) -> DataFrame:
    return journal(spark, sf, ROWS)


G_SQL = f"g AS (SELECT * REPLACE (event_id // {ROWS} AS granule_id) FROM j)"

# scans and projection


@query("s05_projected_scan", d.with_sql(G_SQL) + " SELECT event_type, sequence, value FROM g WHERE granule_id IN (1, 3) UNION ALL SELECT event_type, sequence, value FROM g WHERE granule_id = 1")
def s05(spark, sf):
    return scan.projected(_g(spark, sf), ["event_type", "sequence", "value"], [3, 1, 1])


@query("s06_family_egress", d.with_sql(G_SQL) + " SELECT granule_id, row_ordinal, value FROM g")
def s06(spark, sf):
    return scan.family_egress(_g(spark, sf), "value", internal=True)


@query("s07_row_to_event", J + " SELECT event_id, event_type, value, payload FROM j WHERE row_ordinal = 123")
def s07(spark, sf):
    return scan.row(_j(spark, sf), 123).select("event_id", "event_type", "value", "payload")


@query("s07_granule_events", d.with_sql(G_SQL) + " SELECT event_id, event_type FROM g WHERE granule_id = 2")
def s07b(spark, sf):
    return scan.granule_rows(_g(spark, sf), 2).select("event_id", "event_type")


@query("s15_update_rows", J + " SELECT event_id, row_ordinal, CASE WHEN event_id % 10 = 3 THEN -value ELSE value END AS value FROM j")
def s15(spark, sf):
    rows = _j(spark, sf).select("event_id", "row_ordinal", "value")
    return files.with_changes(rows, rows.where("event_id % 10 = 3").withColumn("value", -F.col("value")))


@query("s13_entity_projection", J + " SELECT entity_id, epoch, sequence, row_number() OVER (ORDER BY entity_id, epoch, sequence) AS place FROM j")
def s13(spark, sf):
    return ranges.ranked(_j(spark, sf).select("entity_id", "epoch", "sequence"), ["entity_id", "epoch", "sequence"], "place")


@query("s18_snapshot_get", J + " SELECT entity_id, arg_max(payload, sequence) AS payload FROM j WHERE entity_id = 'user-5' GROUP BY 1")
def s18(spark, sf):
    snapshot = _j(spark, sf).groupBy("entity_id").agg(F.max_by("payload", "sequence").alias("payload"))
    return files.snapshot_get(snapshot, "user-5")


def _manifest(spark, sf):
    """One file per granule of small granules; every third is owned by another tenant and every
    seventh is outdated."""
    spans = _g(spark, sf).groupBy("granule_id").agg(F.count("*").alias("row_count"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.min("occurred_at").alias("min_time"), F.max("occurred_at").alias("max_time"))
    return spans.select(
        F.when(F.col("granule_id") % 3 == 2, "t2").otherwise("t1").alias("tenant_id"), F.col("granule_id").alias("file_id"), F.lit("event").alias("profile"), F.lit(1).cast("long").alias("generation"), F.lit(1).cast("long").alias("epoch"),
        "first_sequence", "last_sequence", "row_count", "min_time", "max_time", F.when(F.col("granule_id") % 7 == 6, "outdated").otherwise("active").alias("state"), (F.col("row_count") * (1 + F.col("granule_id") % 4)).alias("size_bytes"),
    )


MANIFEST_SQL = G_SQL + """, m AS (SELECT CASE WHEN granule_id % 3 = 2 THEN 't2' ELSE 't1' END AS tenant_id, granule_id AS file_id, 'event' AS profile, 1::BIGINT AS generation, 1::BIGINT AS epoch,
  min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS row_count, min(occurred_at) AS min_time, max(occurred_at) AS max_time, CASE WHEN granule_id % 7 = 6 THEN 'outdated' ELSE 'active' END AS state FROM g GROUP BY granule_id)"""


@query("s19_system_files", d.with_sql(MANIFEST_SQL) + " SELECT min_time AS created_at, sha256(file_id::VARCHAR) AS file_seal, file_id, row_count * 100 AS file_size, generation AS generation_id, 1::BIGINT AS granule_count, row_count FROM m WHERE tenant_id = 't1'")
def s19(spark, sf):
    rows = _manifest(spark, sf).withColumnsRenamed({"generation": "generation_id", "min_time": "created_at"})
    rows = rows.withColumn("file_seal", F.sha2(F.col("file_id").cast("string"), 256)).withColumn("file_size", F.col("row_count") * 100).withColumn("granule_count", F.lit(1).cast("long"))
    return manifest.system_files(rows, "tenant", "t1")


@query("s20_system_granules", d.with_sql(G_SQL) + " SELECT granule_id, count(*) AS row_count, min(sequence) AS first_sequence, max(sequence) AS last_sequence, min(occurred_at) AS min_time, max(occurred_at) AS max_time FROM g GROUP BY 1")
def s20(spark, sf):
    return manifest.system_granules(_g(spark, sf))


@query("p02_authorized_columns", J + " SELECT event_type, value FROM j")
def p02(spark, sf):
    rows = _j(spark, sf)
    allowed, _ = scan.authorize(["event_type", "row_ordinal", "value", "nothing"], rows.columns, "public")
    return rows.select(*allowed)


@query("p06_field_redaction", d.with_sql(d.DELETES_SQL) + " SELECT event_id, CASE WHEN event_id % 13 = 4 THEN NULL ELSE value END AS value, event_type FROM j")
def p06(spark, sf):
    rows = _j(spark, sf)
    return scan.redact_fields(rows, d.deletes(rows), ["value"]).select("event_id", "value", "event_type")


@query("p07_deidentify", "SELECT o_orderkey, NULL::BIGINT AS o_custkey, '[redacted]' AS status, '[redacted]' AS priority, o_totalprice FROM orders")
def p07(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_totalprice", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("personal"))
    return scan.deidentify(rows, "o_custkey", "personal").select("o_orderkey", "o_custkey", F.col("personal")["status"].alias("status"), F.col("personal")["priority"].alias("priority"), "o_totalprice")


# predicates


@query("f01_string_predicates", J + " SELECT event_type = 'click' AS eq, event_type <> 'click' AS ne, event_type IN ('view', 'error') AS isin, event_type >= 'c' AND event_type < 'p' AS rng, count(*) AS n FROM j GROUP BY ALL")
def f01(spark, sf):
    c = "event_type"
    tests = [predicates.equals(c, "click").alias("eq"), predicates.not_equals(c, "click").alias("ne"), predicates.is_in(c, ["view", "error"]).alias("isin"), predicates.in_range(c, Bound("c"), Bound("p", False)).alias("rng")]
    return _j(spark, sf).select(*tests).groupBy("eq", "ne", "isin", "rng").agg(F.count("*").alias("n"))


@query("f01_null_never_matches", "WITH o AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) SELECT count(*) FILTER (s = 'O') AS eq, count(*) FILTER (s <> 'O') AS ne, count(*) FILTER (s IN ('O', 'F')) AS isin FROM o")
def f01b(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("s"))
    return rows.agg(F.count_if(predicates.equals("s", "O")).alias("eq"), F.count_if(predicates.not_equals("s", "O")).alias("ne"), F.count_if(predicates.is_in("s", ["O", "F"])).alias("isin"))


@query("f02_contains_all", "SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ing')")
def f02(spark, sf):
    return table(spark, sf, "documents").where(predicates.contains_all("text", ["THE", "", "ing"], ignore_ascii_case=True)).select("doc_id")


@query("f03_integer_predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) AND l_orderkey > 100 AND l_orderkey <= 900 AND l_partkey <> 7")
def f03(spark, sf):
    keep = predicates.is_in("l_linenumber", [1, 3]) & predicates.in_range("l_orderkey", Bound(100, False), Bound(900)) & predicates.not_equals("l_partkey", 7)
    return table(spark, sf, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


_NAN_SQL = "WITH v AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN -0.0 ELSE value END AS x FROM events)"


def _nan(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select(F.when(n % 11 == 0, float("nan")).when(n % 17 == 0, None).when(n % 19 == 0, F.lit(-0.0)).otherwise(F.col("value")).alias("x"))


@query("f04_float_predicates", _NAN_SQL + " SELECT count(*) FILTER (x = 0 AND NOT isnan(x)) AS zero, count(*) FILTER (x IS NOT NULL AND (isnan(x) OR x <> 1.5)) AS ne, count(x) AS ne_nan, 0::BIGINT AS eq_nan, count(*) FILTER (NOT isnan(x) AND x >= 5) AS rng, count(x) AS unbounded FROM v")
def f04(spark, sf):
    nan = float("nan")
    tests = {"zero": predicates.float_equals("x", 0.0), "ne": predicates.float_not_equals("x", 1.5), "ne_nan": predicates.float_not_equals("x", nan), "eq_nan": predicates.float_equals("x", nan), "rng": predicates.float_range("x", Bound(5.0)), "unbounded": predicates.float_range("x")}
    return _nan(spark, sf).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


@query("f08_count_matching", J + " SELECT count(*) AS n FROM j WHERE event_type > 'e'")
def f08(spark, sf):
    return _j(spark, sf).where(predicates.in_range("event_type", Bound("e", False))).agg(F.count("*").alias("n"))


@query("f09_global_dictionary", J + " SELECT event_type AS value, dense_rank() OVER (ORDER BY event_type) - 1 AS code, count(*) AS n FROM j GROUP BY 1")
def f09(spark, sf):
    rows = _j(spark, sf)
    codes = bitmaps.global_dictionary(rows, "event_type")
    return bitmaps.encoded(rows, "event_type", codes).groupBy(F.col("event_type").alias("value"), F.col("event_type_code").cast("long").alias("code")).agg(F.count("*").alias("n"))


_TOKENS = r"list_filter(string_split_regex(lower(text), '[\s!-&(-/:-@\[-`{-~]+'), lambda x: x <> '')"


@query("f10_token_counts", f"SELECT doc_id, len({_TOKENS}) AS n_tokens FROM documents")
def f10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.tokens("text")).cast("long").alias("n_tokens"))


@query("f11_substring", "SELECT doc_id FROM documents WHERE contains(text, 'tion the')")
def f11(spark, sf):
    return text.search_substring(table(spark, sf, "documents"), "text", "tion the").select("doc_id")


@query("f11_trigram_pruning", "SELECT count(*) AS n FROM documents WHERE list_has_all(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3)), ['pas', 'ass', 'ssa'])")
def f11b(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(text.may_contain(text.trigrams("text"), "passa")).agg(F.count("*").alias("n"))


@query("f12_granules_by_sequence", d.with_sql(G_SQL) + " SELECT granule_id FROM g GROUP BY 1 HAVING min(sequence) <= 700 AND max(sequence) >= 300")
def f12(spark, sf):
    """From stored statistics alone."""
    return pruning.evaluate(d.stored_stats(spark, sf, ROWS), [("sequence", "range", 300, 700)]).where("keep").select("granule_id")


@query("f12_granules_by_time", d.with_sql(G_SQL) + f" SELECT granule_id FROM g GROUP BY 1 HAVING min(occurred_at) <= {d.YEAR + 9 * d.DAY} AND max(occurred_at) >= {d.YEAR + 4 * d.DAY}")
def f12b(spark, sf):
    return pruning.evaluate(d.stored_stats(spark, sf, ROWS), [("occurred_at", "range", d.YEAR + 4 * d.DAY, d.YEAR + 9 * d.DAY)]).where("keep").select("granule_id")


@query("f14_metadata_answers", d.with_sql(G_SQL) + " SELECT granule_id, CASE WHEN granule_id % 3 = 0 THEN 'NoRowsMatch' WHEN granule_id % 3 = 1 THEN 'AllRowsMatch' ELSE 'MustDecode' END AS answer FROM g GROUP BY 1")
def f14(spark, sf):
    c = F.when(F.col("granule_id") % 3 == 1, "x").when(F.col("granule_id") % 3 == 2, F.when(F.col("event_id") % 2 == 0, "x").otherwise("y"))
    stats = bitmaps.block_stats(_g(spark, sf).withColumn("c", c), ["c"])
    return stats.select("granule_id", bitmaps.metadata_answer("x").alias("answer"))


@query("f15_bitmap_algebra", J + " SELECT count(*) FILTER (event_type = 'click' AND value > 10) AS both, count(*) FILTER (event_type = 'click' AND NOT value > 10) AS only_first FROM j")
def f15(spark, sf):
    rows = _j(spark, sf)
    a, b = rows.where("event_type = 'click'"), rows.where("value > 10")
    return bitmaps.cardinality(bitmaps.intersect(a, b)).withColumnRenamed("n", "both").crossJoin(bitmaps.cardinality(bitmaps.difference(a, b)).withColumnRenamed("n", "only_first"))


@query("f15_carrying_all", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def f15b(spark, sf):
    return bitmaps.carrying_all(table(spark, sf, "lineitem"), "l_returnflag", ["A", "N", "A"], "l_orderkey")


@query("f15_runs", J + ", f AS (SELECT row_ordinal, row_ordinal - row_number() OVER (ORDER BY row_ordinal) AS i FROM j WHERE event_id % 7 < 5) SELECT min(row_ordinal) AS first, max(row_ordinal) AS last FROM f GROUP BY i")
def f15c(spark, sf):
    return bitmaps.runs(_j(spark, sf).where("event_id % 7 < 5"), block=100)


@query("f16_rank_select", J + ", r AS (SELECT event_id, event_type, coalesce(sum((event_type = 'click')::INT) OVER (ORDER BY row_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM j) SELECT event_id, rank, CASE WHEN event_type = 'click' THEN rank END AS \"select\" FROM r")
def f16(spark, sf):
    return bitmaps.ranked(_j(spark, sf), F.col("event_type") == "click", block=100).select("event_id", "rank", "select")


# joins in disguise


@query("j01_deletion_anti_join", d.with_sql(d.DELETES_SQL) + " SELECT count(*) AS n FROM j WHERE row_ordinal NOT IN (SELECT row_ordinal FROM d)")
def j01(spark, sf):
    rows = _j(spark, sf).withColumn("file_id", F.lit("f"))
    return timeline.without_deleted(rows, d.deletes(rows)).agg(F.count("*").alias("n"))


_REF_SQL = """w AS (SELECT event_id, user_id, 'event:' || first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS root_ref,
  CASE WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT NULL THEN 'event:' || lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS parent_ref,
  'event:' || event_id // 2 || ' event:' || event_id // 3 AS linked_refs FROM j)"""


def _refs(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = F.col("event_id")
    return _j(spark, sf).select(
        "event_id", "user_id", F.concat(F.lit("event:"), F.first("event_id").over(w).cast("string")).alias("root_ref"), F.concat(F.lit("event:"), F.lag("event_id").over(w).cast("string")).alias("parent_ref"),
        F.concat(F.lit("event:"), F.floor(n / 2).cast("string"), F.lit(" event:"), F.floor(n / 3).cast("string")).alias("linked_refs"),
    )


@query("j02_pointing_at", d.with_sql(_REF_SQL) + " SELECT event_id FROM w WHERE list_contains(string_split(linked_refs, ' '), 'event:30')")
def j02(spark, sf):
    return relations.pointing_at(_refs(spark, sf), "linked_refs", "event:30").select("event_id")


@query("j02_children_of_many", d.with_sql(_REF_SQL) + " SELECT parent_ref AS ref, event_id FROM w WHERE parent_ref IN (SELECT 'event:' || event_id FROM j WHERE event_id % 20 = 0)")
def j02b(spark, sf):
    asked = _j(spark, sf).where("event_id % 20 = 0").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("ref"))
    return relations.children_of(_refs(spark, sf), asked).select("ref", "event_id")


@query("j03_threads", d.with_sql(_REF_SQL) + " SELECT root_ref, count(*) AS n FROM w WHERE root_ref <> 'event:' || event_id GROUP BY 1")
def j03(spark, sf):
    rows = _refs(spark, sf)
    return rows.where(F.col("root_ref") != F.concat(F.lit("event:"), F.col("event_id").cast("string"))).groupBy("root_ref").agg(F.count("*").alias("n"))


@query("j04_resolve_references", J + ", r AS (SELECT 'event:' || event_id * 3 AS ref FROM j WHERE event_id % 4 = 0 UNION ALL SELECT 'external:x' || event_id FROM j WHERE event_id % 9 = 0) SELECT r.ref, f.event_id AS found_event_id FROM r LEFT JOIN j f ON r.ref = 'event:' || f.event_id OR r.ref = 'external:x' || f.event_id + 5")
def j04(spark, sf):
    rows = _j(spark, sf).select("event_id", F.concat(F.lit("x"), (F.col("event_id") + 5).cast("string")).alias("external_id"))
    n = F.col("event_id")
    refs = rows.where("event_id % 4 = 0").select(F.concat(F.lit("event:"), (n * 3).cast("string")).alias("ref")).unionByName(rows.where("event_id % 9 = 0").select(F.concat(F.lit("external:x"), n.cast("string")).alias("ref")))
    return relations.resolve(refs, rows, {"event": "event_id", "external": "external_id"})


@query("j05_sequence_numbers", J + " SELECT a.event_id AS place, (a.event_id * 7)::VARCHAR AS id, b.sequence AS sn FROM j a LEFT JOIN j b ON b.event_id = a.event_id * 7 WHERE a.event_id % 3 = 0")
def j05(spark, sf):
    rows = _j(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), F.col("sequence").alias("sn"), F.col("event_id").alias("n"))
    ids = rows.where("n % 3 = 0").select(F.col("n").alias("place"), (F.col("n") * 7).cast("string").alias("id"))
    return relations.sequence_numbers(ids, rows)


@query("j06_sidecar_alignment", J + " SELECT event_id, value * 3 AS tripled FROM j WHERE event_id % 2 = 0")
def j06(spark, sf):
    base = _j(spark, sf).select(F.lit("f").alias("file_id"), "row_ordinal", "event_id")
    derived = _j(spark, sf).where("event_id % 2 = 0").select(F.lit("f").alias("file_id"), "row_ordinal", (F.col("value") * 3).alias("tripled"))
    return relations.aligned(base, derived).select("event_id", "tripled")


@query("j07_newest_external", J + " SELECT 'x' || event_id % 40 AS external_id, max(event_id) AS row_ordinal FROM j GROUP BY 1")
def j07(spark, sf):
    rows = _j(spark, sf).select(F.concat(F.lit("x"), (F.col("event_id") % 40).cast("string")).alias("external_id"), F.lit("f").alias("file_id"), F.lit(1).alias("generation"), "row_ordinal")
    return relations.newest_external(rows).select("external_id", "row_ordinal")


@query("j08_range_overlap", "SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a, orders b WHERE a.o_orderkey % 5 = 0 AND b.o_orderkey % 7 = 0 AND a.o_orderkey <= b.o_orderkey + 20 AND b.o_orderkey <= a.o_orderkey + 11")
def j08(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    a = o.where("k % 5 = 0").select(F.col("k").alias("left_key"), F.col("k").alias("a0"), (F.col("k") + 11).alias("a1"))
    b = o.where("k % 7 = 0").select(F.col("k").alias("right_key"), F.col("k").alias("b0"), (F.col("k") + 20).alias("b1"))
    return relations.overlapping(a, b, ("a0", "a1"), ("b0", "b1"), 64).select("left_key", "right_key")


# aggregates


@query("a01_float_aggregate", _NAN_SQL + " SELECT count(x) AS count, 'NaN'::DOUBLE AS sum, min(x) FILTER (NOT isnan(x)) AS min, max(x) FILTER (NOT isnan(x)) AS max FROM v")
def a01(spark, sf):
    from tidemark.functions import floats

    return _nan(spark, sf).agg(*floats.summary("x"))


@query("a02_merged_rollup", J + f" SELECT occurred_at // {24 * HOUR} AS day, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM j GROUP BY 1")
def a02(spark, sf):
    hours = rollup.rollup(_j(spark, sf), ["value"], HOUR)
    return rollup.merge(hours.withColumn("day", times.floor_div("bucket", 24)), ["day"]).withColumn("sum", F.round("sum", 4))


@query("a03_time_bucket_rollup", J + f" SELECT occurred_at // {HOUR} AS bucket, 'value' AS \"column\", count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM j GROUP BY 1")
def a03(spark, sf):
    return rollup.rollup(_j(spark, sf), ["value"], HOUR).withColumn("sum", F.round("sum", 4))


@query("a05_distinct_exact", J + " SELECT 'event_type' AS \"column\", count(DISTINCT event_type) AS \"distinct\", true AS exact FROM j UNION ALL SELECT 'user_id', count(DISTINCT user_id), true FROM j")
def a05(spark, sf):
    return aggregates.distinct_estimate(_j(spark, sf), ["event_type", "user_id"], limit=1 << 17)


@query("a06_exact_counts", "SELECT count(*) AS n FROM lineitem")
def a06(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("a07_block_stats", d.with_sql(G_SQL) + " SELECT granule_id, 'event_type' AS \"column\", min(event_type) AS min, max(event_type) AS max, count(*) FILTER (event_type IS NULL) AS null_count, count(*) AS row_count FROM g GROUP BY 1")
def a07(spark, sf):
    return bitmaps.block_stats(_g(spark, sf), ["event_type"])


@query("a08_less_deleted", d.with_sql(d.DELETES_SQL) + " SELECT count(*) AS count, round(sum(value), 4) AS sum FROM j WHERE row_ordinal NOT IN (SELECT row_ordinal FROM d)")
def a08(spark, sf):
    rows = _j(spark, sf)
    totals = rows.agg(F.count("*").alias("count"), F.sum("value").alias("sum"))
    return aggregates.less_deleted(totals, rows.join(d.deletes(rows).select("row_ordinal"), "row_ordinal", "left_semi"), "value").withColumn("sum", F.round("sum", 4))


@query("a09_path_statistics", J + ", t AS (SELECT unnest(json_keys(payload)) AS path, unnest(list_transform(json_keys(payload), lambda k: json_type(payload, '$.' || k))) AS t FROM j) SELECT path, 'int' AS kind, count(*) AS n FROM t GROUP BY 1")
def a09(spark, sf):
    return payload.path_statistics(_j(spark, sf).select(payload.parse("payload").alias("payload")))


@query("a10_centroids", "WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS len FROM p GROUP BY 1) SELECT p.label, i::INTEGER AS place, round(m / len, 5) AS x FROM p JOIN n ON n.label = p.label")
def a10(spark, sf):
    means = vector_search.centroids(table(spark, sf, "embeddings"), "label")
    return means.select("label", F.posexplode("centroid").alias("i", "m")).select("label", (F.col("i") + 1).alias("place"), F.round("m", 5).alias("x"))


@query("a11_file_summary", J + " SELECT count(*) AS row_count, min(sequence) AS min_sequence, max(sequence) AS max_sequence, min(occurred_at) AS min_time, max(occurred_at) AS max_time FROM j")
def a11(spark, sf):
    return manifest.file_summary(_j(spark, sf))


@query("a12_aggregate_shortcut", J + f" SELECT count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM j WHERE occurred_at >= {d.YEAR + d.DAY} AND occurred_at < {d.YEAR + 8 * d.DAY}")
def a12(spark, sf):
    """Whole buckets: the stored rollup alone."""
    return rollup.answer(d.stored_events(spark, sf, GRANULE_ROWS), d.stored_rollup(spark, sf, HOUR), "value", d.YEAR + d.DAY, d.YEAR + 8 * d.DAY, HOUR).withColumn("sum", F.round("sum", 4))


@query("a14_aggregate_law", d.with_sql(d.NEWEST_SQL, d.DELETES_SQL) + " SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total FROM n WHERE event_id % 10 = 9 OR event_id NOT IN (SELECT row_ordinal FROM d) GROUP BY 1")
def a14(spark, sf):
    """Files and overlay less deletions, which mark rows of files only."""
    j = _j(spark, sf)
    rows = timeline.files_and_overlay(*d.copies(j)).withColumn("row_ordinal", F.col("event_id"))
    marks = rows.where("file_id is not null and event_id % 13 = 4").select("file_id", "row_ordinal")
    return timeline.without_deleted(rows, marks).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(money()).cast("double").alias("total"))


# order, windows and sets


@query("w02_newest_copy", d.with_sql(d.NEWEST_SQL) + " SELECT event_id, value FROM n")
def w02(spark, sf):
    files_, overlay = d.copies(_j(spark, sf))
    return timeline.newest_copies(files_.unionByName(overlay)).select("event_id", "value")


@query("w03_limit_after_drops", d.with_sql(d.DELETES_SQL) + " SELECT sequence FROM j WHERE user_id = 2 AND row_ordinal NOT IN (SELECT row_ordinal FROM d) ORDER BY sequence DESC LIMIT 15")
def w03(spark, sf):
    rows = _j(spark, sf).withColumn("file_id", F.lit("f"))
    return timeline.timeline(rows, F.col("user_id") == 2, deletes=d.deletes(rows), descending=True, limit=15).select("sequence")


@query("w05_first_at_least", J + f" SELECT min(row_ordinal) AS row_ordinal FROM j WHERE occurred_at >= {d.YEAR + 5 * d.DAY}")
def w05(spark, sf):
    return bitmaps.first_at_least(_j(spark, sf), "occurred_at", d.YEAR + 5 * d.DAY)


@query("w06_vector_top_k", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS row, round(list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]), 5) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, vec_id LIMIT 10")
def w06(spark, sf):
    q = vectors.literal(d.first_vector(spark, sf))
    return vector_search.top_k(d.vectors(spark, sf), vectors.dot("embedding", q), 10).select("row", F.round("score", 5).alias("score"))


@query("w07_clustering", J + f", b AS (SELECT sequence, CASE WHEN event_id % 400 < 3 THEN 0 ELSE occurred_at // {d.DAY} END AS bucket FROM j), s AS (SELECT bucket, coalesce((bucket <> lag(bucket) OVER (ORDER BY sequence))::INT, 1) AS new FROM b) SELECT bucket, sum(new)::BIGINT AS islands FROM s GROUP BY 1")
def w07(spark, sf):
    bucket = F.when(F.col("event_id") % 400 < 3, F.lit(0).cast("long")).otherwise(times.bucket("occurred_at", d.DAY))
    return bitmaps.clustered(_j(spark, sf), bucket, block=100)


@query("w09_disjoint_union", d.with_sql() + " SELECT count(*) AS n, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total FROM (SELECT value FROM j WHERE sequence <= 600 UNION ALL SELECT value * 2 FROM j WHERE sequence > 600)")
def w09(spark, sf):
    rows = _j(spark, sf).select("epoch", "sequence", "event_id", "value")
    file = rows.where("sequence <= 600").withColumn("file_id", F.lit("f"))
    overlay = rows.where("sequence > 300").withColumn("value", F.col("value") * 2)
    coverage = file.groupBy("epoch").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
    return timeline.files_and_overlay(file, overlay, coverage).agg(F.count("*").alias("n"), F.sum(money()).cast("double").alias("total"))


# deletes and corrections


@query("d04_superseded", d.with_sql(d.CORRECTIONS_SQL) + " SELECT event_id FROM j WHERE event_id IN (SELECT target FROM c WHERE target >= 0)")
def d04(spark, sf):
    return corrections.superseded(_j(spark, sf), d.corrections(_j(spark, sf))).select("event_id")


@query("d05_raw_history", J + " SELECT sequence, event_id FROM j WHERE user_id = 1")
def d05(spark, sf):
    return corrections.raw_history(_j(spark, sf).where("user_id = 1")).select("sequence", "event_id")


@query("d07_derived_invalidation", J + " SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'pending' WHEN event_id % 3 = 0 THEN 'published' END AS state, CASE WHEN event_id % 3 = 0 AND event_id % 6 <> 0 THEN event_id END AS value FROM j")
def d07(spark, sf):
    rows = _j(spark, sf)
    one = rows.where("event_id % 3 = 0").select("event_id", F.lit(1).alias("at"), F.lit("publish").alias("action"), F.col("event_id").alias("value"))
    two = rows.where("event_id % 6 = 0").select("event_id", F.lit(2).alias("at"), F.lit("invalidate").alias("action"), F.lit(None).cast("long").alias("value"))
    return corrections.derived_values(rows, one.unionByName(two))


@query("d07_invalidated_neighbours", J + ", w AS (SELECT event_id, max((event_id % 50 = 0)::INT) OVER (PARTITION BY entity_id ORDER BY sequence ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM j) SELECT event_id FROM w WHERE near = 1")
def d07b(spark, sf):
    rows = _j(spark, sf)
    return corrections.invalidation(rows, rows.where("event_id % 50 = 0"), 2).select("event_id")


@query("d08_jurisdictions", "WITH t AS (SELECT o_custkey AS k, o_orderkey AS o, ['retain', 'restrict_suppress', 'physical_destruction', 'crypto_shred'][o_orderkey % 4 + 1] AS disposition, o_orderkey % 4 AS rank, o_orderkey % 9 = 0 AS carve_out FROM orders) SELECT k, coalesce(arg_min(disposition, o) FILTER (carve_out), arg_max(disposition, rank * 1000000000 + o)) AS disposition, bool_or(carve_out) AS carve_out FROM t GROUP BY 1")
def d08(spark, sf):
    names = F.array(*map(F.lit, corrections.DISPOSITIONS))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("disposition"), (F.col("o_orderkey") % 9 == 0).alias("carve_out"))
    return corrections.resolved_disposition(rows, ["k"], "o")


# scalar functions


@query("c05_shred_plan", J + " SELECT 'k' AS path, 'int' AS kind, 'dense' AS tier, count(*) AS present FROM j")
def c05(spark, sf):
    rows = _j(spark, sf).select(payload.parse("payload").alias("payload"))
    return payload.shred_plan(payload.path_statistics(rows), rows.count())


@query("c06_promoted_column", J + " SELECT event_id, json_extract_string(payload, '$.k')::BIGINT AS k FROM j")
def c06(spark, sf):
    v = payload.parse("payload")
    rows = _j(spark, sf).withColumn("schema_version", F.when(F.col("event_id") % 2 == 0, 2).otherwise(1)).withColumn("promoted", F.when(F.col("schema_version") == 2, F.get_json_object("payload", "$.k").cast("bigint")))
    return rows.select("event_id", payload.resolved("promoted", v, "k", "bigint", since=2).alias("k"))


@query("c07_trigrams", "SELECT p_partkey, len(list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substr(p_name, i, 3))) AS n FROM part")
def c07(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(text.trigrams("p_name")).cast("long").alias("n"))


@query("c10_reference_text", J + " SELECT event_id, 'event:' || lower(hex(encode(entity_id))) AS ref FROM j")
def c10(spark, sf):
    return _j(spark, sf).select("event_id", identifiers.reference("event", F.col("entity_id").cast("binary")).alias("ref"))


@query("c12_time_bucket", J + f" SELECT event_id, (occurred_at - {d.YEAR + 7 * d.DAY} - (((occurred_at - {d.YEAR + 7 * d.DAY}) % {HOUR}) + {HOUR}) % {HOUR}) // {HOUR} AS bucket FROM j")
def c12(spark, sf):
    """Buckets around a point, so that half of them are negative."""
    return _j(spark, sf).select("event_id", times.floor_div(F.col("occurred_at") - (d.YEAR + 7 * d.DAY), HOUR).alias("bucket"))


@query("c13_claimed_seconds", J + " SELECT event_id, occurred_at // 1000000000 AS seconds FROM j")
def c13(spark, sf):
    return _j(spark, sf).select("event_id", times.seconds("occurred_at").alias("seconds"))


@query("c14_protocol_event_id", J + " SELECT event_id, sha256('[0,\"' || lower(hex(encode(entity_id))) || '\",' || occurred_at // 1000000000 || ',1,[],\"' || event_type || '\"]') AS id FROM j")
def c14(spark, sf):
    made = identifiers.protocol_event_id(identifiers.to_hex(F.col("entity_id").cast("binary")), times.seconds("occurred_at"), F.lit(1), F.lit("[]"), F.col("event_type"))
    return _j(spark, sf).select("event_id", made.alias("id"))


@query("c15_canonical_json", J + " SELECT event_id, '{\"a\":\"' || event_type || '\",\"z\":' || event_id || '}' AS canonical FROM j")
def c15(spark, sf):
    made = F.concat(F.lit('{ "z": '), F.col("event_id").cast("string"), F.lit(', "a": "'), "event_type", F.lit('"}'))
    return _j(spark, sf).select("event_id", identifiers.canonical_json(made).alias("canonical"))


# vectors


@query("c18_scores", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q.e), 5) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 5) AS cosine, round(-(list_distance(embedding::DOUBLE[], q.e) ** 2), 5) AS l2 FROM embeddings, q")
def c18(spark, sf):
    q = vectors.literal(d.first_vector(spark, sf))
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(f("embedding", q), 5).alias(n) for n, f in vectors.SCORES.items()])


@query("c19_quantize_i8", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT vec_id, e, (list_max(e) - list_min(e)) / 255 AS scale, list_min(e) + 128 * ((list_max(e) - list_min(e)) / 255) AS offs FROM v) SELECT vec_id, list_sum(list_transform(e, lambda x: greatest(-128, least(127, round((x - offs) / scale)))))::BIGINT AS total, round(scale, 9) AS scale, round(offs, 9) AS offs FROM f")
def c19(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.quantize_i8("embedding").alias("q"))
    return rows.select("vec_id", F.aggregate("q.values", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"), F.round("q.scale", 9).alias("scale"), F.round("q.offset", 9).alias("offs"))


@query("c20_hamming", "WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings), q AS (SELECT s FROM b WHERE vec_id = 0) SELECT b.vec_id, list_sum(list_transform(range(1, 65), lambda i: (b.s[i] = q.s[i])::INT))::INTEGER AS shared FROM b, q")
def c20(spark, sf):
    q = vectors.quantize_u1(vectors.literal(d.first_vector(spark, sf)))
    return table(spark, sf, "embeddings").select("vec_id", vectors.quantize_u1("embedding").alias("b")).select("vec_id", vectors.hamming("b", q).alias("shared"))


@query("c21_estimated_dot", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_dot_product(e, e)) * list_sum(list_transform(range(1, 65), lambda i: CASE WHEN e[i] > 0 THEN q[i] ELSE -q[i] END)) / (8 * (list_sum(list_transform(e, lambda x: abs(x))) / (sqrt(list_dot_product(e, e)) * 8))), 5) AS estimate FROM v, q")
def c21(spark, sf):
    q = vectors.literal(d.first_vector(spark, sf))
    return table(spark, sf, "embeddings").select("vec_id", vectors.quantize_u1("embedding").alias("b")).select("vec_id", F.round(vectors.estimated_dot(q, "b"), 5).alias("estimate"))


_EXACT_SQL = """SELECT segment, row, event_id, round(score, 5) AS score FROM (SELECT vec_id % 3 AS segment, vec_id AS row, vec_id::VARCHAR AS event_id, list_dot_product(embedding::DOUBLE[], q.e) AS score
  FROM embeddings, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, segment, row LIMIT 10)"""


@query("v01_two_stage_recall", "SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def v01b(spark, sf):
    """Of the ten best rows of every row whose id is divisible by 20, those that the two stages find,
    against the exact search: at least 0.9 of them."""
    rows = d.vectors(spark, sf).withColumn("bits", vectors.quantize_u1("embedding"))
    asked = rows.where("row % 20 = 0").select(F.col("row").alias("q"), "embedding")
    exact = vector_search.search_all(rows, asked, 10, metric="dot").select("q", "segment", "row")
    found = vector_search.search_all(rows, asked, 10, coarse="bits", metric="dot").select("q", "segment", "row", F.lit(True).alias("met"))
    both = exact.join(found, ["q", "segment", "row"], "left")
    return both.agg(F.lit(asked.count()).cast("long").alias("asked"), (F.count("met") >= 0.9 * F.count("*")).alias("enough"))


@query("v01_two_stage_search", _EXACT_SQL)
def v01(spark, sf):
    rows = d.vectors(spark, sf).withColumn("bits", vectors.quantize_u1("embedding"))
    return vector_search.search(rows, d.first_vector(spark, sf), 10, coarse="bits", metric="dot").withColumn("score", F.round("score", 5))


@query("v02_rescore", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id % 3 AS segment, vec_id AS row, round(list_dot_product(embedding::DOUBLE[], q.e), 5) AS score FROM embeddings, q WHERE vec_id % 11 = 5")
def v02(spark, sf):
    rows = d.vectors(spark, sf)
    return vector_search.rescore(rows, rows.where("row % 11 = 5"), d.first_vector(spark, sf), "dot").withColumn("score", F.round("score", 5))


@query("v03_prune_segments", "SELECT vec_id // 50 AS segment FROM embeddings GROUP BY 1 HAVING min(label) <= 4 AND max(label) >= 4 AND min(vec_id) <= 260 AND max(vec_id) >= 120")
def v03(spark, sf):
    rows = d.vectors(spark, sf).withColumn("segment", F.floor(F.col("row") / 50))
    return vector_search.prune_segments(vector_search.segment_stats(rows), rooms=[4], time=(120, 260)).select("segment")


@query("v04_nearest_segments", "WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS len FROM p GROUP BY 1), q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT p.label AS segment, round(sum(m / len * q.e[i]), 5) AS score FROM p JOIN n ON n.label = p.label, q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def v04(spark, sf):
    means = vector_search.centroids(d.vectors(spark, sf).withColumn("segment", F.col("room_id")))
    return vector_search.nearest_segments(means, d.first_vector(spark, sf), 4).withColumn("score", F.round("score", 5))


@query("v05_to_reembed", "SELECT DISTINCT vec_id % 3 AS segment FROM embeddings WHERE vec_id % 3 <> 1")
def v05(spark, sf):
    return vector_search.to_reembed(d.vectors(spark, sf).withColumn("model", F.when(F.col("segment") == 1, "m2").otherwise("m1")), "m2")


@query("v06_merge_segments", "SELECT vec_id AS event_number, CASE WHEN vec_id % 2 = 0 THEN vec_id // 2 ELSE (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) + vec_id // 2 END AS row FROM embeddings")
def v06(spark, sf):
    rows = d.vectors(spark, sf)
    parts = [rows.where(F.col("row") % 2 == r).withColumn("row", F.floor(F.col("row") / 2)) for r in (0, 1)]
    return vector_search.merged(parts).select(F.col("event_id").cast("long").alias("event_number"), "row")


@query("v07_write_checks", "SELECT count(*) AS n FROM embeddings")
def v07(spark, sf):
    return vector_search.checked(d.vectors(spark, sf), 64).agg(F.count("embedding").alias("n"))


@query("v08_prefix_fetch", "SELECT i::INTEGER AS place, round(embedding[i]::DOUBLE, 6) AS x FROM embeddings, range(1, 9) t(i) WHERE vec_id = 31")
def v08(spark, sf):
    return vector_search.fetch(d.vectors(spark, sf), 31 % 3, 31, 8).select(F.posexplode("embedding").alias("i", "x")).select((F.col("i") + 1).alias("place"), F.round(F.col("x").cast("double"), 6).alias("x"))


# graph and state


@query("g01_parents", d.with_sql(d.EDGES_SQL) + " SELECT j.event_id AS sn, count(e.parent_sn) AS n, coalesce(sum(e.parent_sn), 0)::BIGINT AS total FROM j LEFT JOIN e ON e.child_sn = j.event_id GROUP BY 1")
def g01(spark, sf):
    rows = _j(spark, sf)
    lists = graph.parents(d.edges(rows), rows.select(F.col("event_id").alias("sn")))
    return lists.select("sn", F.size("parents").cast("long").alias("n"), F.aggregate("parents", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query("g01_children", d.with_sql(d.EDGES_SQL) + " SELECT j.event_id AS sn, count(DISTINCT e.child_sn) AS n, min(e.child_sn) AS first FROM j LEFT JOIN e ON e.parent_sn = j.event_id GROUP BY 1")
def g01b(spark, sf):
    rows = _j(spark, sf)
    lists = graph.children(d.edges(rows), rows.select(F.col("event_id").alias("sn")))
    return lists.select("sn", F.size("children").cast("long").alias("n"), F.get("children", F.lit(0)).alias("first"))


@query("g02_walk", d.with_sql(d.EDGES_SQL, "w AS (SELECT 700::BIGINT AS sn UNION SELECT e.parent_sn FROM w JOIN e ON e.child_sn = w.sn)").replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT sn FROM w WHERE sn <> 700")
def g02(spark, sf):
    return graph.walk(d.edges(_j(spark, sf)), [700]).select("sn")


@query("g03_chain_links", J + " SELECT DISTINCT user_id % 5 AS from_chain, event_id // 10 AS from_seq, user_id % 3 AS to_chain, event_id // 15 AS to_seq FROM j WHERE user_id % 5 IN (1, 2)")
def g03(spark, sf):
    links = _j(spark, sf).select((F.col("user_id") % 5).alias("from_chain"), F.floor(F.col("event_id") / 10).alias("from_seq"), (F.col("user_id") % 3).alias("to_chain"), F.floor(F.col("event_id") / 15).alias("to_seq"))
    return graph.chain_links(links, spark.createDataFrame([(1,), (2,)], "chain_id long"))


@query("g04_unresolved", J + " SELECT event_id AS child_sn, event_id * 2 AS parent_id FROM j WHERE event_id * 2 NOT IN (SELECT event_id FROM j)")
def g04(spark, sf):
    rows = _j(spark, sf)
    return graph.unresolved(rows.select(F.col("event_id").alias("child_sn"), (F.col("event_id") * 2).alias("parent_id")), rows)


@query("g05_graph_faults", J + " SELECT 'all' AS subject, 'gap' AS fault, event_id AS sn FROM j WHERE event_id % 100 = 51")
def g05(spark, sf):
    rows = _j(spark, sf).where("event_id % 100 <> 50").select(F.lit("all").alias("subject"), F.col("event_id").alias("sn"))
    known = d.edges(_j(spark, sf)).where("child_sn % 100 <> 50")
    return graph.faults(rows, known)


@query("g06_state_at", d.with_sql(d.STATE_SQL) + ", l AS (SELECT type_id, state_key_id, arg_max(struct_pack(v := value), sn) AS x FROM s WHERE sn <= 500 GROUP BY 1, 2) SELECT type_id, state_key_id, x.v AS value FROM l WHERE x.v IS NOT NULL")
def g06(spark, sf):
    return state.state_at(d.state_deltas(_j(spark, sf)), 500)


_AT = "(SELECT type_id, state_key_id, x.v AS value FROM (SELECT type_id, state_key_id, arg_max(struct_pack(v := value), sn) AS x FROM s WHERE sn <= {} GROUP BY 1, 2) WHERE x.v IS NOT NULL)"


@query("g07_state_diff", d.with_sql(d.STATE_SQL) + f", a AS {_AT.format(300)}, b AS {_AT.format(420)} SELECT coalesce(a.type_id, b.type_id) AS type_id, coalesce(a.state_key_id, b.state_key_id) AS state_key_id, a.value AS old_value, b.value AS new_value FROM a FULL JOIN b ON a.type_id = b.type_id AND a.state_key_id = b.state_key_id WHERE a.value IS DISTINCT FROM b.value")
def g07(spark, sf):
    return state.state_diff(d.state_deltas(_j(spark, sf)), 300, 420)


@query("g08_state_update", d.with_sql(d.STATE_SQL) + f" SELECT * FROM {_AT.format(420)}")
def g08(spark, sf):
    deltas = d.state_deltas(_j(spark, sf))
    return state.updated(state.state_at(deltas, 300), deltas.where("sn > 300 and sn <= 420"))


@query("g09_read_inbox", J + " SELECT entity_id AS recipient, sequence FROM j WHERE user_id % 4 = 1 AND sequence > 200 + user_id AND event_id % 13 <> 4")
def g09(spark, sf):
    rows = _j(spark, sf).where("user_id % 4 = 1").select(F.lit("t").alias("tenant_id"), F.col("entity_id").alias("recipient"), "epoch", "sequence", F.lit("f").alias("file_id"), "row_ordinal", "user_id")
    acks = rows.select("tenant_id", "recipient", F.lit(1).cast("long").alias("ack_epoch"), (F.col("user_id") + 200).alias("ack_sequence")).distinct()
    return inbox.unread(rows, acks, "t", deletes=d.deletes(_j(spark, sf))).select("recipient", "sequence")


@query("g10_fully_acked", J + ", x AS (SELECT event_id // 100 AS file_id, user_id, max(sequence) AS p FROM j GROUP BY 1, 2) SELECT file_id, bool_and(p <= 500) AS done FROM x GROUP BY 1")
def g10(spark, sf):
    rows = _j(spark, sf).select(F.floor(F.col("event_id") / 100).alias("file_id"), F.col("entity_id").alias("recipient"), "epoch", "sequence")
    acks = rows.select("recipient", F.lit(1).cast("long").alias("ack_epoch"), F.lit(500).cast("long").alias("ack_sequence")).distinct()
    return inbox.fully_acked(rows, acks)


@query("g11_audit_chain", J + " SELECT event_id // 200 AS file_id, CASE WHEN event_id // 200 = 2 THEN 'rows altered' ELSE 'ok' END AS verdict FROM j GROUP BY ALL")
def g11(spark, sf):
    """Files are sealed, then a row of one of them is altered."""
    rows = _j(spark, sf).select(F.floor(F.col("event_id") / 200).alias("file_id"), "row_ordinal", "event_type", "value")
    plain = rows.groupBy("file_id").agg(F.lit("").alias("chain_start"), F.lit("").alias("chain_end")).withColumn("position", F.col("file_id"))
    start = F.sha2(F.concat(F.lit("start"), F.col("file_id").cast("string")), 256)
    link = plain.withColumn("chain_start", F.when(F.col("file_id") == 0, F.lit(audit.GENESIS)).otherwise(start))
    ends = audit.chain_ends(rows, link, ["event_type", "value"]).select("file_id", "position", "chain_start", F.col("computed_end").alias("chain_end"))
    altered = rows.withColumn("value", F.when(F.col("row_ordinal") == 450, -1.0).otherwise(F.col("value")))
    checked = audit.chain_ends(altered, ends, ["event_type", "value"])
    return checked.select("file_id", F.when(F.col("computed_end") == F.col("chain_end"), "ok").otherwise("rows altered").alias("verdict"))


# streams' batch side and planning


_RANGES = "r AS (SELECT 1::BIGINT AS epoch, event_id // 10 AS f, min(sequence) AS first, max(sequence) AS last FROM j WHERE event_id // 10 % 30 <> 20 GROUP BY ALL)"


def _ranges(spark, sf):
    return _j(spark, sf).withColumn("f", F.floor(F.col("event_id") / 10)).where("f % 30 <> 20").groupBy("epoch", "f").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))


@query("t03_commit_watermark", d.with_sql(_RANGES) + " SELECT 1::BIGINT AS epoch, 200::BIGINT AS watermark")
def t03(spark, sf):
    return watermarks.commit_watermark(_ranges(spark, sf))


@query("t04_visibility_watermark", J + " SELECT 1::BIGINT AS epoch, min(sequence) - 1 AS watermark FROM j WHERE event_id % 300 = 299")
def t04(spark, sf):
    return watermarks.watermark_of_rows(_j(spark, sf).where("event_id % 300 <> 299"), block=100)


@query("t05_seal_epoch", d.with_sql(_RANGES, "m AS (SELECT *, lag(last) OVER (ORDER BY first) AS before FROM r)") + " SELECT epoch, before + 1 AS first, first - 1 AS last FROM m WHERE first > before + 1")
def t05(spark, sf):
    return watermarks.voids(_ranges(spark, sf), spark.createDataFrame([(1,)], "epoch long"))


@query("t06_covers", d.with_sql(_RANGES) + " SELECT 1::BIGINT AS epoch, s * 50 + 1 AS first, s * 50 + 25 AS last, NOT EXISTS (SELECT 1 FROM j WHERE event_id // 10 % 30 = 20 AND sequence BETWEEN s * 50 + 1 AND s * 50 + 25) AS covered FROM range(0, 18) t(s)")
def t06(spark, sf):
    asked = spark.range(18).select(F.lit(1).cast("long").alias("epoch"), (F.col("id") * 50 + 1).alias("first"), (F.col("id") * 50 + 25).alias("last"))
    return watermarks.covers(_ranges(spark, sf), asked)


@query("t07_overlay_eviction", d.with_sql(_RANGES) + " SELECT first, last FROM r WHERE NOT ((first >= 1 AND last <= 205) OR (first >= 301 AND last <= 505))")
def t07(spark, sf):
    segments = _ranges(spark, sf).withColumn("tenant_id", F.lit("t"))
    covering = spark.createDataFrame([("t", 1, 1, 205), ("t", 1, 301, 505), ("u", 1, 1, 9999999)], "tenant_id string, epoch long, first long, last long")
    return watermarks.kept_segments(segments, covering).select("first", "last")


_ARBITRATION = """f AS (SELECT event_id AS position, entity_id AS tenant_id, epoch, event_id * 7 % 100 AS first, event_id * 7 % 100 + event_id % 6 AS last, row_number() OVER (PARTITION BY entity_id ORDER BY event_id) AS nth FROM j),
s AS (SELECT tenant_id, 0::BIGINT AS nth, [{'a': 0::BIGINT, 'b': 0::BIGINT}][1:0] AS held FROM f GROUP BY 1
  UNION ALL SELECT f.tenant_id, f.nth, CASE WHEN len(list_filter(s.held, lambda x: x.a <= f.last AND x.b >= f.first)) = 0 THEN list_append(s.held, {'a': f.first, 'b': f.last}) ELSE s.held END FROM s JOIN f ON f.tenant_id = s.tenant_id AND f.nth = s.nth + 1)"""


@query("t08_replay_arbitration", d.with_sql(_ARBITRATION).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT f.position, f.tenant_id, f.epoch, f.first, f.last FROM f JOIN s a ON a.tenant_id = f.tenant_id AND a.nth = f.nth - 1 JOIN s b ON b.tenant_id = f.tenant_id AND b.nth = f.nth WHERE len(b.held) > len(a.held)")
def t08(spark, sf):
    frames = _j(spark, sf).select(F.col("event_id").alias("position"), F.col("entity_id").alias("tenant_id"), "epoch", (F.col("event_id") * 7 % 100).alias("first")).withColumn("last", F.col("first") + F.col("position") % 6)
    return watermarks.arbitrated(frames)


@query("x02_pruned_scan", J + " SELECT event_id FROM j WHERE event_type IN ('click', 'error') AND sequence BETWEEN 300 AND 620 AND value >= 3.5")
def x02(spark, sf):
    """Stored statistics pick the granules; the scan of the stored events is given them as a filter."""
    clauses = [("event_type", "in", ["click", "error"], None), ("sequence", "range", 300, 620), ("value", "range", 3.5, None)]
    return pruning.pruned_scan(d.stored_events(spark, sf, ROWS), d.stored_stats(spark, sf, ROWS), clauses).select("event_id")


@query("x02_pruning_decisions", d.with_sql(G_SQL) + " SELECT granule_id, NOT (max(sequence) < 300 OR min(sequence) > 620) AS keep, true AS residual_required FROM g GROUP BY 1")
def x02b(spark, sf):
    return pruning.evaluate(d.stored_stats(spark, sf, ROWS), [("sequence", "range", 300, 620), ("value", "eq", 1.0, None)]).select("granule_id", "keep", "residual_required")


@query("x04_file_pruning", d.with_sql(MANIFEST_SQL) + f" SELECT file_id FROM m WHERE min_time <= {d.YEAR + 9 * d.DAY} AND max_time >= {d.YEAR + 2 * d.DAY} AND first_sequence <= 800 AND last_sequence >= 100")
def x04(spark, sf):
    spans = _manifest(spark, sf).withColumnsRenamed({"first_sequence": "min_sequence", "last_sequence": "max_sequence"})
    return spans.where(manifest.keeps_file((d.YEAR + 2 * d.DAY, d.YEAR + 9 * d.DAY), (100, 800))).select("file_id")


_COMPACTION = """s AS (SELECT granule_id AS file_id, granule_id // 7 AS run, count(*) * (1 + granule_id % 4) AS size FROM g WHERE granule_id % 7 <> 6 GROUP BY granule_id),
r AS (SELECT run, sum(size) AS total, dense_rank() OVER (ORDER BY run) - 1 AS job FROM s GROUP BY run HAVING count(*) > 1 AND sum(size) >= 2 * max(size))"""


@query("x09_compaction_plan", d.with_sql(G_SQL, _COMPACTION) + " SELECT r.job::INTEGER AS job, s.file_id, r.total::BIGINT AS expected_bytes FROM s JOIN r ON r.run = s.run WHERE r.job < 4")
def x09(spark, sf):
    jobs = lifecycle.plan_compaction(_manifest(spark, sf).withColumn("tenant_id", F.lit("t1")), "t1")
    return spark.createDataFrame([(i, f, s) for i, (ids, s) in enumerate(jobs) for f in ids], "job int, file_id long, expected_bytes long")


@query("x11_selectable_files", d.with_sql(MANIFEST_SQL) + " SELECT file_id FROM m WHERE state = 'active'")
def x11(spark, sf):
    return manifest.selectable(_manifest(spark, sf)).select("file_id")


@query("x13_garbage_chunks", J + " SELECT event_id AS chunk_id FROM j WHERE event_id % 3 <> 0 AND sequence + 100 <= 700")
def x13(spark, sf):
    rows = _j(spark, sf)
    chunks = rows.select(F.col("event_id").alias("chunk_id"), F.col("sequence").alias("written_at"))
    return lifecycle.garbage_chunks(chunks, chunks.where("chunk_id % 3 = 0"), 700, 100).select("chunk_id")


@query("x14_duplicate_points", d.with_sql() + " SELECT 1::BIGINT AS epoch, sequence // 2 AS sequence, count(*) AS copies FROM j WHERE event_id % 4 IN (0, 1, 2) GROUP BY ALL HAVING count(*) > 1")
def x14(spark, sf):
    rows = _j(spark, sf).where("event_id % 4 in (0, 1, 2)").withColumn("sequence", F.floor(F.col("sequence") / 2))
    return lifecycle.duplicates(rows)


# security


@query("k02_crypto_shred", J + " SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'plain' WHEN user_id % 5 = 1 THEN 'tombstone' WHEN user_id % 5 = 2 THEN 'rejected' ELSE 'opened' END AS outcome, CASE WHEN user_id % 5 NOT IN (1, 2) THEN payload END AS text FROM j")
def k02(spark, sf):
    rows = _j(spark, sf).select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("entity_id")).alias("subject"), "user_id", "payload")
    subjects = rows.where("subject is not null").select("subject", "user_id").distinct()
    key = lambda word: F.substring(F.sha2(F.concat("subject", F.lit(word)), 256), 1, 32).cast("binary")
    stored = security.encrypted(rows, subjects.select("subject", key("a").alias("key")))
    left = subjects.where("user_id % 5 <> 1").select("subject", F.when(F.col("user_id") % 5 == 2, key("b")).otherwise(key("a")).alias("key"))
    return security.opened(stored, left).select("event_id", "outcome", "text")


@query("k03_residency", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 END AS readable FROM orders")
def k03(spark, sf):
    n = F.col("o_orderkey")
    protection = F.when(n % 3 == 0, "none").when(n % 3 == 1, "tenant_key").otherwise("subject_keys")
    readable = security.readable_in(protection, F.when(n % 2 == 0, "eu").otherwise("us"), F.when(n % 5 == 0, "eu"), "eu")
    return table(spark, sf, "orders").select("o_orderkey", readable.alias("readable"))


@query("k04_tenant_isolation", J + " SELECT event_id FROM j WHERE user_id % 3 = 1")
def k04(spark, sf):
    rows = _j(spark, sf).withColumn("tenant_id", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")))
    return security.of_tenant(rows, "t1").select("event_id")


@query("k07_external_digest", "SELECT doc_id, doc_id % 4 <> 0 AS verified FROM documents")
def k07(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    return files.verify_external(rows).select("doc_id", "verified")


