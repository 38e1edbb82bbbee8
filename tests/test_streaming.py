"""Streams run to their end over files, restarts and repeated batches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.streaming import ingest, watermarks

SCHEMA = "event_id long, occurred_at long, ts timestamp, dedupe_hash_low long, dedupe_hash_high long"


def batch(spark, ids):
    rows = [(i, i * 10, i + 1000, i % 1000, 7) for i in ids]
    return spark.createDataFrame(rows, "event_id long, occurred_at long, s long, dedupe_hash_low long, dedupe_hash_high long").select("event_id", "occurred_at", F.timestamp_seconds("s").alias("ts"), "dedupe_hash_low", "dedupe_hash_high")


def test_publisher_numbers_events_once(spark, tmp_path):
    source = f"{tmp_path}/in"
    batch(spark, range(0, 100)).coalesce(1).write.mode("append").parquet(source)
    out = ingest.Publisher(spark, f"file://{tmp_path}/out")
    run = lambda: out.start(ingest.read_stream(spark, source, batch(spark, [0]).schema, 1), f"{tmp_path}/ck").awaitTermination()
    run()
    batch(spark, range(50, 160)).coalesce(1).write.mode("append").parquet(source)  # half of them again
    run()
    run()  # nothing new
    rows = out.events().orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(1, 161)) and sorted(r["event_id"] for r in rows) == list(range(160))
    out.publish(batch(spark, range(500, 510)), 1)  # a batch that ran before
    assert out.events().count() == 160
    assert watermarks.commit_watermark(out.manifest().where("row_count > 0")).first()["watermark"] == 160


def test_receipts(spark):
    known = batch(spark, [1])
    got = {r["event_id"]: r["receipt"] for r in ingest.submitted(batch(spark, [1, 2, 1002, 3]), known).collect()}
    assert got == {1: "duplicate", 2: "ready", 1002: "duplicate", 3: "ready"}
    got = {r["event_id"]: r["receipt"] for r in ingest.retry_receipts(batch(spark, [1, 2, 3]), known, batch(spark, [3])).collect()}
    assert got == {1: "duplicate", 2: "ready", 3: "unresolved"}


def test_windows_and_deduplication(spark, tmp_path):
    batch(spark, [*range(0, 200), *range(0, 50)]).write.parquet(f"{tmp_path}/in")
    stream = ingest.read_stream(spark, f"{tmp_path}/in", batch(spark, [0]).schema)
    for name, df, mode in (("w", ingest.rolling_counts(stream), "complete"), ("d", ingest.deduplicated(stream, "1 hour"), "append")):
        df.writeStream.format("memory").queryName(f"q_{name}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("q_w").agg(F.sum("n")).first()[0] == 250
    assert spark.table("q_d").count() == 200


def test_watermarks_equal_brute_force(spark):
    r = random.Random(6)
    for _ in range(4):
        ranges = [(1, s, s + r.randrange(6)) for s in (r.randrange(1, 60) for _ in range(14))] + [(1, 1, 3)]
        df = spark.createDataFrame(ranges, "epoch long, first long, last long")
        have = {i for _, a, b in ranges for i in range(a, b + 1)}
        mark = next(i for i in range(1, 99) if i not in have) - 1
        assert watermarks.commit_watermark(df).first()["watermark"] == mark
        rows = spark.createDataFrame([(1, i) for i in have], "epoch long, sequence long")
        assert watermarks.watermark_of_rows(rows, block=8).first()["watermark"] == mark
        gaps = {i for _, a, b in map(tuple, watermarks.voids(df, spark.createDataFrame([(1,)], "epoch long")).collect()) for i in range(a, b + 1)}
        assert gaps == set(range(1, max(have) + 1)) - have
        asked = spark.createDataFrame([(1, a, a + 4) for a in range(1, 60, 5)], "epoch long, first long, last long")
        for x in watermarks.covers(df, asked).collect():
            assert x["covered"] == all(i in have for i in range(x["first"], x["last"] + 1))


def test_a_missing_start_has_no_watermark(spark):
    assert watermarks.commit_watermark(spark.createDataFrame([(1, 2, 9)], "epoch long, first long, last long")).first()["watermark"] is None


def test_arbitration_equals_brute_force(spark):
    r = random.Random(11)
    frames = [(p, f"t{p % 2}", 1, (s := r.randrange(80)), s + r.randrange(8)) for p in range(70)]
    kept = []
    for f in frames:
        if not any(k[1] == f[1] and k[3] <= f[4] and f[3] <= k[4] for k in kept):
            kept.append(f)
    df = spark.createDataFrame(frames, "position long, tenant_id string, epoch long, first long, last long").repartition(5)
    assert sorted(tuple(x) for x in watermarks.arbitrated(df).collect()) == kept


def test_eviction(spark):
    seg = spark.createDataFrame([("t", 1, 1, 5), ("t", 1, 6, 9), ("u", 1, 1, 5)], "tenant_id string, epoch long, first long, last long")
    cover = spark.createDataFrame([("t", 1, 1, 7)], "tenant_id string, epoch long, first long, last long")
    assert [tuple(x) for x in watermarks.evictable(seg, cover).collect()] == [("t", 1, 1, 5)]
    assert watermarks.kept_segments(seg, cover).count() == 2


def test_numbers_have_no_gaps_at_size(spark):
    """Several ranges and partitions, further columns, many equal keys."""
    rows = spark.range(400_000, numPartitions=7).select(F.col("id").alias("event_id"), F.expr("abs(xxhash64(id)) % 1000").alias("occurred_at"), F.expr("repeat('x', cast(id % 50 as int))").alias("payload"), F.lit(1).alias("_part"))
    got = ingest.numbered(rows, 1000).select("sequence", "occurred_at", "event_id", "payload")
    found = got.agg(F.count_distinct("sequence"), F.min("sequence"), F.max("sequence"), F.count("*")).first()
    assert tuple(found) == (400_000, 1001, 401_000, 400_000)
    w = Window.partitionBy(F.floor(F.col("sequence") / 50_000)).orderBy("sequence")
    key = F.struct("occurred_at", "event_id")
    assert got.select((key < F.lag(key).over(w)).alias("falls")).where("falls").isEmpty()
    none = ingest.numbered(rows.limit(0), 0)
    assert none.isEmpty() and none.columns == [*rows.columns, "sequence", "epoch"]
    same = ingest.numbered(rows.limit(500).withColumn("occurred_at", F.lit(5).cast("long")).withColumn("event_id", F.lit(None).cast("long")), 0)
    assert sorted(r[0] for r in same.select("sequence").collect()) == list(range(1, 501))


def test_files_end_by_the_roll_policy(spark, tmp_path):
    out = ingest.Publisher(spark, f"file://{tmp_path}/out", roll=ingest.Roll(rows=30, window=500), horizon=1)
    out.publish(batch(spark, range(0, 100)), 0)
    out.publish(batch(spark, range(90, 120)), 1)
    out.publish(batch(spark, range(0, 10)), 2)  # their keys lie before the horizon
    files = spark.read.parquet(f"file://{tmp_path}/out/events").select("roll_window", "occurred_at", F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b")).collect()
    assert all(r["n"] <= 30 and r["a"] // 500 == r["b"] // 500 for r in files)
    rows = out.events().orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(1, 131)) and "roll_window" not in rows[0]


def test_blocks_change_nothing(spark):
    r = random.Random(9)
    ranges = [(e, s, s + r.choice([0, 1, 5, 40])) for e in (1, None) for s in (r.randrange(-50, 900) for _ in range(60))]
    df = spark.createDataFrame(ranges, "epoch long, first long, last long")
    want = set()
    for e in (1, None):
        have = sorted({i for x, a, b in ranges if x == e for i in range(a, b + 1)})
        starts = [i for i in have if i - 1 not in have]
        want |= {(e, a, next(j for j in range(a, 2000) if j + 1 not in have)) for a in starts}
    for block in (1, 7, 100, 1 << 20):
        assert {tuple(x) for x in watermarks.merged_ranges(df, block=block).collect()} == want


def test_arbitration_in_clusters_equals_one_list(spark):
    r = random.Random(3)
    frames = [(i, f"t{r.randrange(2)}", 1, a, a + r.randrange(12)) for i, a in enumerate(r.randrange(400) for _ in range(150))]
    kept = []
    for f in frames:
        if not any(f[1] == g[1] and f[3] <= g[4] and g[3] <= f[4] for g in kept):
            kept.append(f)
    df = spark.createDataFrame(frames, "position long, tenant_id string, epoch long, first long, last long")
    for block in (10, 1 << 20):
        assert sorted(tuple(x) for x in watermarks.arbitrated(df, block).collect()) == sorted(kept)


def test_a_live_read_is_ready_or_waits(spark):
    segments = spark.createDataFrame([(1, 1, 10, "a"), (1, 11, 20, "b"), (1, 25, 30, "c")], "epoch long, first long, last long, name string")
    asked = spark.createDataFrame([(1, 5, 12), (1, 18, 26), (2, 1, 1)], "epoch long, first long, last long")
    ready, wait = watermarks.live_read(segments, segments, asked)
    assert {(r["name"], r["asked_first"]) for r in ready.collect()} == {("a", 5), ("b", 5)}
    assert {tuple(r) for r in wait.collect()} == {(1, 18, 26), (2, 1, 1)}


def test_an_opt_in_watermark_drops_late_rows(spark, tmp_path):
    batch(spark, range(0, 600)).coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = batch(spark, [0]).schema

    def run(lateness):
        """The counts of the windows that the new files change."""
        seen = []
        counts = ingest.rolling_counts(ingest.read_stream(spark, f"{tmp_path}/in", schema, 1), "1 minute", lateness)
        changed = counts.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(r["n"] for r in df.collect()))
        changed.option("checkpointLocation", f"{tmp_path}/ck-{lateness}").trigger(availableNow=True).start().awaitTermination()
        return sum(seen)

    assert run(None) == run("10 seconds") == 600
    batch(spark, [1]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run("10 seconds") == 0  # far behind the watermark
    assert run(None) > 1  # the window and its late row
