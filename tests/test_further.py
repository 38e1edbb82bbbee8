"""Stored statistics are what is read, filters skip and never lie, and messages come back."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import payload, text
from tidemark.functions.identifiers import escaped
from tidemark.functions.protobuf import Field, decode, encode
from tidemark.operators import filters, graph, pruning, ranges, rollup
from tidemark.plans import catalogue, derived
from tidemark.sources import files, prepared
from tidemark.sources.journal import journal

SF = "/root/testdata/sf0.01"


def scanned(df):
    """The files that a plan reads."""
    return {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}


def test_whole_buckets_read_the_rollup_alone(spark):
    df = catalogue.QUERIES["a12_aggregate_shortcut"](spark, SF)
    assert all("tidemark-rollup" in f for f in scanned(df)) and scanned(df)
    assert all("tidemark-revenue" in f for f in scanned(catalogue.QUERIES["q08_metadata_revenue"](spark, SF)))
    for name in ("f12_granules_by_sequence", "f12_granules_by_time", "x02_pruning_decisions"):
        assert all("tidemark-stats" in f for f in scanned(catalogue.QUERIES[name](spark, SF)))


def rows_read(df):
    """Rows that the scans of a collected plan gave out, by its own counters."""
    df.collect()
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
    return total


def test_cut_buckets_and_kept_granules_read_little(spark):
    n = journal(spark, SF).count()
    rows = derived.stored_events(spark, SF, 256)
    hour = 3600 * 10**9
    cut = rollup.range_aggregate(rows, derived.stored_rollup(spark, SF, hour), "value", derived.YEAR + 90 * 10**9, derived.YEAR + 20 * derived.DAY + 12345, hour)
    assert rows_read(cut) < n // 4
    kept = pruning.pruned_scan(rows, derived.stored_stats(spark, SF, 256), [("sequence", "range", 300, 620)])
    assert 321 <= rows_read(kept) <= n // 4 and kept.count() == 321
    assert pruning.pruned_scan(rows, derived.stored_stats(spark, SF, 256), [("sequence", "range", 10**9, None)]).isEmpty()


def test_prepared_tables_follow_their_source(spark, tmp_path):
    path, made = f"{tmp_path}/t.parquet", []

    def make():
        made.append(1)
        return spark.read.parquet(path).selectExpr("id * 2 as x")

    spark.range(5).write.parquet(path)
    assert [prepared.prepared(spark, path, "t", make).count() for _ in range(3)] == [5, 5, 5] and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(path)
    assert prepared.prepared(spark, path, "t", make).count() == 7 and len(made) == 2


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tidemark.sources import shared

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    assert shared.root(session("local[4]")).startswith("file:")
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared.root(session(master))


def test_membership_filters_never_hide_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("granule_id", F.floor(F.col("doc_id") / 8))
    made = filters.membership_filter(docs, text.tokens("text"), "text_token", "text").cache()
    per = {r[0]: set(r[1]) for r in docs.groupBy("granule_id").agg(F.array_distinct(F.flatten(F.collect_list(text.tokens("text"))))).collect()}
    words = random.Random(2).sample(sorted(set().union(*per.values())), 12) + ["nowhere-at-all"]
    skipped = 0
    for w in words:
        gone = {r[0] for r in filters.skipped(made, "text_token", "text", filters.lacks_any([w])).collect()}
        assert not any(w in per[g] for g in gone)
        skipped += len(gone)
    assert skipped > len(per)
    assert made.count() == len(per)
    with pytest.raises(ValueError):
        filters.membership_filter(docs, text.tokens("text"), "guess", "text")


def test_range_filters_find_empty_gaps(spark):
    rows = [(g, v) for g in range(6) for v in range(g * 1000, g * 1000 + 300, 7)] + [(6, -5), (7, None)]
    df = spark.createDataFrame(rows, "granule_id long, v long")
    made = filters.range_filter(df, "v", 16)
    for low, high in ((310, 990), (0, 10), (1300, 1900), (-6, -4), (-40, -20), (5, 4), (0, 10**9)):
        gone = {r[0] for r in filters.skipped(made, filters.RANGE, "v", filters.lacks_range(low, high)).collect()}
        have = {g for g, v in rows if v is not None and low <= v <= high}
        assert not gone & have
        assert low > high or high - low > 10**6 or gone >= {g for g in range(7)} - {g for g, v in rows if v is not None and low - 16 <= v <= high + 16}


def test_messages_come_back():
    inner = ((1, Field("a", "sint")), (2, Field("b", "bytes")))
    fields = {1: Field("i", "int"), 2: Field("s", "string"), 3: Field("d", "double"), 4: Field("f", "fixed32"), 5: Field("m", "message", fields=inner), 6: Field("r", "int", repeated=True), 7: Field("e", "enum", names=((0, "zero"), (5, "five"))), 8: Field("t", "timestamp"), 9: Field("u", "uint"), 10: Field("y", "bool"), 11: Field("ms", "message", repeated=True, fields=inner)}
    values = {"i": -7, "s": "é", "d": 1.5, "f": -3, "m": {"a": -9, "b": "AAE="}, "r": [1, 300, -1], "e": "five", "t": 1_704_067_200_123_456_789, "u": 2**64 - 1, "y": True, "ms": [{"a": 1}, {"a": 2}]}
    data = encode(values, fields)
    assert decode(data, fields) == values
    assert decode(data + encode({"x": "unknown"}, {99: Field("x", "string")}), fields) == values
    assert decode(b"\x32\x03\x01\x02\x03", fields) == {"r": [1, 2, 3]}  # packed
    assert decode(b"\x38\x09", fields) == {"e": 9} and decode(b"", fields) == {}
    for bad in (b"\x08", b"\x12\x05ab", b"\x0b", b"\x12\x01\xff", data[:-1], b"\x0a\x01a"):
        if bad != b"\x0a\x01a":
            with pytest.raises(ValueError):
                decode(bad, fields)


def test_malformed_messages_are_null(spark):
    df = spark.createDataFrame([(bytearray(b"\x08\x05"),), (bytearray(b"\x08"),), (None,)], "m binary")
    rows = files.read_protobuf(df, "m", {1: Field("i", "int")}).select(payload.field("payload", "i", "bigint").alias("i")).collect()
    assert [r["i"] for r in rows] == [5, None, None]


def test_every_control_character_is_escaped(spark):
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    df = spark.createDataFrame([(i, f"a{chr(i)}b") for i in range(128)] + [(200, '"\\é\u2028')], "i long, c string")
    for r in df.select("i", "c", escaped(F.col("c")).alias("e")).collect():
        if r["i"] == 200:
            assert r["e"] == '\\"\\\\é\u2028'
        else:
            c = chr(r["i"])
            assert r["e"] == "a" + (short.get(r["i"], f"\\u{r['i']:04x}") if r["i"] < 32 else {'"': '\\"', "\\": "\\\\"}.get(c, c)) + "b"


def test_places_along_a_whole_table(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "b", f"k{r.randrange(50)}"]), r.randrange(20)) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, v long")
    for n in (1, 3, 40):
        got = sorted((x["place"], x["k"], x["v"]) for x in ranges.ranked(df, ["k", "v"], "place", n).collect())
        assert [g[0] for g in got] == list(range(1, 701))
        assert [g[1:] for g in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))


def test_a_sequence_gap_over_blocks(spark):
    numbers = [1, 2, 3, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, (1 << 21) + 5]
    events = spark.createDataFrame([("s", n) for n in numbers], "subject string, sn long")
    edges = spark.createDataFrame([], "subject string, child_sn long, kind string, parent_sn long, ord int")
    assert sorted(r["sn"] for r in graph.faults(events, edges).collect()) == [(1 << 20) - 1, (1 << 21) + 5]


def test_row_groups_end_with_granules(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(20_000).selectExpr("1L as epoch", "id + 1 as sequence", "id as event_id")
    files.write_events(df, f"{tmp_path}/e", files=1)
    part = next(p for p in (tmp_path / "e").iterdir() if p.suffix == ".parquet")
    meta = pq.ParquetFile(part).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [8192, 8192, 3616]


def test_a_column_of_nulls_is_sorted(spark):
    df = spark.range(100).selectExpr("id as a", "cast(if(id < 50, null, id) as long) as b", "cast(null as long) as c")
    assert files.sorted_by(df, ["a"], "b") and files.sorted_by(df, ["a"], "c") and not files.sorted_by(df.selectExpr("-a as a", "b"), ["a"], "b")


def test_trigrams_are_code_points(spark):
    texts = ["", "ab", "abc", "añb🙂cd\n x", None, "x" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text.trigrams("t")).collect()]
    assert got == [None if t is None else [t[i : i + 3] for i in range(len(t) - 2)] for t in texts]
