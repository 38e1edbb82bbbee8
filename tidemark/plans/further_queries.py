"""Queries over write rules, projections, skip filters, protocols' ids and other payload formats."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import identifiers, payload, text
from tidemark.functions.protobuf import Field, encode
from tidemark.operators import filters, pruning, security
from tidemark.plans import derived as d
from tidemark.plans.registry import query
from tidemark.sources import files, manifest, shared
from tidemark.sources.journal import journal, table
from tidemark.streaming import ingest

J = d.with_sql()
ROWS = 256


def _values(rows: list[tuple], names: str) -> str:
    literal = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::BIGINT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


# files


_RULES = [("event", "kept"), ("no rows", "a file needs a row"), ("a point twice", "two rows have the same epoch and sequence"), ("snapshot of two epochs", "a snapshot has one epoch"), ("snapshot without entity", "a snapshot's rows need an entity_id"), ("time series that goes back", "occurred_at goes back"), ("time series in order", "kept"), ("width 0", "the bucket width must be positive"), ("width of an event file", "a bucket width belongs to time series and to nothing else"), ("inbox in recipient order", "kept"), ("inbox out of order", "an inbox file is in recipient order")]


@query("s12_write_rules", _values(_RULES, 'file, "verdict"'))
def s12b(spark, sf):
    """What the rules say of whole tables of each profile, right and wrong ones."""
    j = journal(spark, sf).select("epoch", "sequence", "entity_id", "occurred_at", "row_ordinal", "event_id")
    snapshot = j.withColumn("entity_id", F.concat("entity_id", F.lit("-"), F.col("event_id").cast("string")))
    inbox = j.withColumn("recipient", F.floor(F.col("row_ordinal") / 100))
    cases = {
        "event": (j, "event", None),
        "no rows": (j.limit(0), "event", None),
        "a point twice": (j.unionByName(j.where("event_id = 7")), "event", None),
        "snapshot of two epochs": (snapshot.withColumn("epoch", F.col("epoch") + F.col("event_id") % 2), "snapshot", None),
        "snapshot without entity": (snapshot.withColumn("entity_id", F.when(F.col("event_id") != 3, F.col("entity_id"))), "snapshot", None),
        "time series that goes back": (j.withColumn("occurred_at", F.when(F.col("event_id") == 500, 0).otherwise(F.col("sequence"))), "time_series", 10),
        "time series in order": (j.withColumn("occurred_at", F.col("sequence")), "time_series", 10),
        "width 0": (j, "time_series", 0),
        "width of an event file": (j, "event", 10),
        "inbox in recipient order": (inbox, "inbox", None),
        "inbox out of order": (inbox.withColumn("recipient", -F.col("recipient")), "inbox", None),
    }
    rows = []
    for name, (df, profile, width) in cases.items():
        try:
            files.checked(df, profile, width)
            rows.append((name, "kept"))
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "file string, verdict string")


def _projection(name: str, columns: str, sql: str):
    @query(f"s14_{name}", J + f" SELECT epoch, sequence, occurred_at, {sql} FROM j")
    def stored(spark, sf):
        path = shared.folder(spark, "queries")
        files.write_projection(journal(spark, sf).selectExpr("epoch", "sequence", "occurred_at", *columns.split("; ")), path, name)
        return files.open_events(spark, path)


_projection("source_type_major", "user_id % 5 as source_id; cast(length(event_type) as long) as event_type_id", "(user_id % 5)::BIGINT AS source_id, length(event_type)::BIGINT AS event_type_id")
_projection("context_major", "cast(user_id as long) as trace_id_hash_low", "user_id::BIGINT AS trace_id_hash_low")
_projection("revenue_metric_major", "user_id % 10 as account_id_hash_low; cast(length(event_type) as long) as event_type_id", "(user_id % 10)::BIGINT AS account_id_hash_low, length(event_type)::BIGINT AS event_type_id")


@query("s20_system_columns", _values([("event_id", "bigint", 0), ("event_type", "string", 1), ("value", "double", 2)], 'name, "type", place'))
def s20b(spark, sf):
    rows = manifest.system_columns(journal(spark, sf).select("event_id", "event_type", "value"))
    return rows.select("name", "type", F.col("place").cast("long").alias("place"))


_FILES = """f AS (SELECT event_id // 64 AS file_id, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM j GROUP BY 1)"""


@query("s20_system_rewrites", d.with_sql(_FILES) + " SELECT a.file_id AS old_file_id, 1000000 + a.file_id // 4 AS new_file_id FROM f a WHERE a.file_id // 4 % 2 = 0")
def s20c(spark, sf):
    """Files of 64 events; of every second four files the four were merged into one."""
    old = journal(spark, sf).groupBy(F.floor(F.col("event_id") / 64).alias("file_id")).agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
    old = old.withColumn("four", F.floor(F.col("file_id") / 4)).withColumn("merged", F.col("four") % 2 == 0)
    new = old.where("merged").groupBy("four").agg(F.min("first_sequence").alias("first_sequence"), F.max("last_sequence").alias("last_sequence"))
    columns = [F.lit("t1").alias("tenant_id"), F.lit(1).alias("epoch"), "first_sequence", "last_sequence"]
    both = old.select("file_id", *columns, F.lit(1).alias("generation"), F.when(F.col("merged"), "outdated").otherwise("active").alias("state"))
    both = both.unionByName(new.select((F.col("four") + 1_000_000).alias("file_id"), *columns, F.lit(2).alias("generation"), F.lit("active").alias("state")))
    return manifest.system_rewrites(both)


# payload formats and ids


MESSAGE = {1: Field("id", "int"), 2: Field("type", "enum", names=((0, "view"), (1, "click"), (2, "error"))), 3: Field("value", "double"), 4: Field("at", "timestamp"), 5: Field("tags", "string", repeated=True)}


@query("c02_protobuf_payload", J + " SELECT event_id, event_id AS id, CASE event_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error' ELSE '3' END AS kind, value, occurred_at AS at, event_type AS tag FROM j")
def c02(spark, sf):
    """Messages with an enum of which one number has no name, a timestamp and a repeated field."""

    @F.arrow_udf("binary")
    def message(n: pa.Array, value: pa.Array, at: pa.Array, tag: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (n, value, at, tag)))
        return pa.array([encode({"id": i, "type": i % 4, "value": v, "at": t, "tags": ["first", g]}, MESSAGE) for i, v, t, g in rows], pa.binary())

    rows = journal(spark, sf).select("event_id", message("event_id", "value", "occurred_at", "event_type").alias("message"))
    p = files.read_protobuf(rows, "message", MESSAGE)
    field = lambda name, kind="string": payload.field("payload", name, kind)
    return p.select("event_id", field("id", "bigint").alias("id"), field("type").alias("kind"), field("value", "double").alias("value"), field("at", "bigint").alias("at"), payload.nested("payload", ["tags", 1]).alias("tag"))


@query("c09_token_hashes", r"SELECT count(DISTINCT t) AS tokens, count(DISTINCT t) AS hashes FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[\s!-&(-/:-@\[-`{-~]+'), lambda x: x <> '')) AS t FROM documents)")
def c09(spark, sf):
    """Every token has a hash of its own."""
    rows = table(spark, sf, "documents").select(F.explode(text.tokens("text")).alias("t"))
    return rows.agg(F.count_distinct("t").alias("tokens"), F.count_distinct(identifiers.stable_hash("t")).alias("hashes"))


_QUOTED = "to_json(event_type || chr((1 + event_id % 31)::INT) || 'é\"/\\')"
for _code in (11, 14, 15, *range(26, 32)):
    _QUOTED = f"replace({_QUOTED}, '\\u{_code:04X}', '\\u{_code:04x}')"


@query("c14_control_characters", J + " SELECT event_id, sha256('[0,\"ab\",' || sequence || ',1,[],' || " + _QUOTED + " || ']') AS id FROM j")
def c14b(spark, sf):
    content = F.concat("event_type", F.chr(1 + F.col("event_id") % 31), F.lit('é"/\\'))
    return journal(spark, sf).select("event_id", identifiers.protocol_event_id(F.lit("ab"), F.col("sequence"), F.lit(1), F.lit("[]"), content).alias("id"))


@query("c15_event_ids", J + """ SELECT event_id, '$' || replace(replace(rtrim(base64(unhex(sha256('{"auth_events":[],"content":{},"depth":' || sequence || ',"origin_server_ts":' || occurred_at // 1000000 || ',"prev_events":[],"room_id":"!r:x","sender":"@' || entity_id || ':x","type":"m.room.message"}'))), '='), '+', '-'), '/', '_') AS id FROM j""")
def c15b(spark, sf):
    """The ids of room events: the hash of what redaction keeps."""
    event = F.to_json(F.struct(
        F.lit("m.room.message").alias("type"), F.lit("!r:x").alias("room_id"), F.concat(F.lit("@"), "entity_id", F.lit(":x")).alias("sender"), F.col("sequence").alias("depth"), F.expr("occurred_at div 1000000").alias("origin_server_ts"),
        F.array().cast("array<string>").alias("prev_events"), F.array().cast("array<string>").alias("auth_events"), F.struct(F.col("event_type").alias("body")).alias("content"), F.lit("gone").alias("unsigned"), F.lit("gone").alias("other"),
    ))
    return journal(spark, sf).select("event_id", identifiers.event_id_udf(10)(event).alias("id"))


# skip filters


@query("x07_token_filter", r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(lower(text), '[\s!-&(-/:-@\[-`{-~]+'), lambda x: x = 'apache' OR x = 'license')) > 0 AND list_has_all(string_split_regex(lower(text), '[\s!-&(-/:-@\[-`{-~]+'), ['apache', 'license'])")
def x07b(spark, sf):
    """Documents with both tokens, from groups of 64 whose filters don't rule one out."""
    docs = table(spark, sf, "documents").withColumn("granule_id", F.floor(F.col("doc_id") / 64))
    made = filters.membership_filter(docs, text.tokens("text"), "text_token", "text")
    gone = filters.skipped(made, "text_token", "text", filters.lacks_any(["apache", "license"]))
    return filters.filtered_scan(docs, gone, text.has_tokens("text", ["apache", "license"])).select("doc_id")


def _rare(spark, sf):
    """Events whose payload has a further field in some granules."""
    rows = journal(spark, sf, ROWS)
    rare = (F.col("granule_id") % 5 == 2) & (F.col("event_id") % 3 == 0)
    return rows.withColumn("payload", F.when(rare, F.regexp_replace("payload", r"\}$", ', "rare": 1}')).otherwise(F.col("payload")))


@query("x07_path_presence", J + f" SELECT event_id FROM j WHERE event_id // {ROWS} % 5 = 2 AND event_id % 3 = 0")
def x07c(spark, sf):
    rows = _rare(spark, sf).withColumn("payload", payload.parse("payload"))
    names = F.map_keys(F.try_variant_get("payload", "$", "map<string,variant>"))
    gone = filters.skipped(filters.membership_filter(rows, names, "path_presence", "payload"), "path_presence", "payload", filters.lacks_any(["rare"]))
    return filters.filtered_scan(rows, gone, payload.field("payload", "rare", "bigint").isNotNull()).select("event_id")


@query("x07_range_filter", J + " SELECT event_id FROM j WHERE user_id % 2 = 0 AND sequence BETWEEN 300 AND 420")
def x07d(spark, sf):
    rows = journal(spark, sf, ROWS)
    gone = filters.skipped(filters.range_filter(rows, "sequence", 16), filters.RANGE, "sequence", filters.lacks_range(300, 420))
    return filters.filtered_scan(rows, gone, F.col("sequence").between(300, 420) & (F.col("user_id") % 2 == 0)).select("event_id")


@query("x08_index_artifacts", J + f" SELECT event_id // {ROWS} AS granule, CASE WHEN event_id // {ROWS} % 4 = 1 THEN 0 ELSE 2 END::BIGINT AS artifacts FROM j GROUP BY ALL")
def x08(spark, sf):
    """A sidecar of two filters per granule; then a row of every fourth granule changes, whose
    artifacts are passed over."""
    path = shared.folder(spark, "sidecar")
    rows = journal(spark, sf, ROWS).select("granule_id", "event_id", "sequence", "event_type", "value")
    columns = ["event_id", "sequence", "event_type", "value"]
    made = filters.range_filter(rows, "sequence", 16).unionByName(filters.membership_filter(rows, F.array("event_type"), "split_block_bloom_filter", "event_type"))
    filters.write_sidecar(made, filters.state_of(rows, columns), path)
    changed = rows.withColumn("value", F.when((F.col("granule_id") % 4 == 1) & (F.col("event_id") % ROWS == 0), -1.0).otherwise(F.col("value")))
    states = filters.state_of(changed, columns)
    used = filters.usable(spark, path, states).groupBy("granule").agg(F.count("*").alias("artifacts"))
    return states.select("granule").join(used, "granule", "left").select("granule", F.coalesce("artifacts", F.lit(0).cast("long")).alias("artifacts"))


_CHOICES = [("range", "range_filter min_max", "min_max"), ("range", "split_block_bloom_filter", None), ("equality", "split_block_bloom_filter min_max", "min_max"), ("membership", "text_token split_block_bloom_filter", "text_token"), ("range", "sequence_range time_range", "sequence_range"), ("equality", "", None)]


@query("x05_choose_index", _values(_CHOICES, "shape, available, choice"))
def x05(spark, sf):
    rows = [(shape, available, pruning.choose_index(shape, available.split())) for shape, available, _ in _CHOICES]
    return spark.createDataFrame(rows, "shape string, available string, choice string")


_READERS = [("rollup", "later", 2, "reads"), ("rollup variant_payload", "", 3, "reads"), ("later", "", 2, "refuses"), ("", "", 0, "refuses"), ("", "", 4, "refuses"), ("", "", 1, "reads")]


@query("k06_features_and_versions", _values(_READERS, '"required", optional, version, verdict'))
def k06(spark, sf):
    rows = []
    for required, optional, version, _ in _READERS:
        try:
            security.check_features(set(required.split()), set(optional.split()))
            security.check_version(version)
            rows.append((required, optional, version, "reads"))
        except ValueError:
            rows.append((required, optional, version, "refuses"))
    return spark.createDataFrame(rows, "required string, optional string, version long, verdict string")


# a stream that opts into a watermark


_LATE = """w AS (SELECT max(ts) FILTER (event_id % 10 <> 0) - INTERVAL 5 HOUR AS mark FROM j),
c AS (SELECT date_trunc('hour', ts) AS start, count(*) FILTER (event_id % 10 <> 0) AS early, count(*) FILTER (event_id % 10 = 0) AS late FROM j GROUP BY 1)"""


@query("t12_opt_in_watermark", d.with_sql(_LATE) + " SELECT epoch(start)::BIGINT AS start_second, early + CASE WHEN start + INTERVAL 1 HOUR > mark THEN late ELSE 0 END AS n FROM c, w WHERE early + CASE WHEN start + INTERVAL 1 HOUR > mark THEN late ELSE 0 END > 0")
def t12(spark, sf):
    """Hourly counts of a stream that stops after its first file and goes on with a second, which has
    every tenth event: with a watermark of five hours only those count whose hour isn't over."""
    path = shared.folder(spark, "queries")
    rows = journal(spark, sf).select("event_id", F.timestamp_micros(F.expr("occurred_at div 1000")).alias("ts"))
    for file in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        rows.where(file).coalesce(1).write.mode("append").parquet(f"{path}/in")
        counts = ingest.rolling_counts(ingest.read_stream(spark, f"{path}/in", rows.schema, 1), "1 hour", "5 hours")
        writer = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}/out")).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("start").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.unix_timestamp("start").alias("start_second"), "n")
