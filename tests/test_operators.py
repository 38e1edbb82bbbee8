"""Operators on hand-made cases that the driver's tables don't have."""

import random
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import audit, bitmaps, corrections, graph, inbox, lifecycle, pruning, relations, rollup, scan, security, state, timeline, vector_search
from tidemark.sources import files, manifest


def events(spark, rows):
    """(sequence, event_id, payload) in one file."""
    return spark.createDataFrame([(1, s, e, p, "f", s) for s, e, p in rows], "epoch long, sequence long, event_id long, payload string, file_id string, row_ordinal long")


def fixes(spark, rows):
    """(corrects, sequence, type)"""
    return spark.createDataFrame([(c, 1, s, 1, t) for c, s, t in rows], "corrects_event_id long, correction_epoch long, correction_sequence long, correction_generation int, correction_type string")


def latest(spark, rows, corrected, deleted=()):
    e = events(spark, rows)
    marks = spark.createDataFrame([("f", d) for d in deleted], "file_id string, row_ordinal long")
    return {r["event_id"]: r["payload"] for r in corrections.latest_versions(e, fixes(spark, corrected), e, marks).collect()}


ROWS = [(1, 10, '{"a":1,"b":1}'), (2, 20, '{"a":2}'), (3, 30, '{"c":3}'), (4, 40, '{"b":4}'), (5, 50, '"whole"'), (6, 60, None)]


def test_amendments_overlay_fields(spark):
    got = latest(spark, ROWS, [(10, 2, "amendment"), (20, 3, "amendment")])
    assert got.pop(10) == '{"a":2,"b":1,"c":3}' and sorted(got) == [40, 50, 60]


def test_replacement_replaces_the_base_or_the_last_amendment(spark):
    assert latest(spark, ROWS, [(10, 2, "replacement")])[20] == '{"a":2}'
    assert latest(spark, ROWS, [(10, 2, "amendment"), (20, 4, "replacement")])[10] == '{"a":1,"b":4}'


def test_retraction_anywhere_drops(spark):
    got = latest(spark, ROWS, [(10, 2, "amendment"), (20, 3, "retraction")])
    assert sorted(got) == [40, 50, 60]


def test_newest_correction_counts(spark):
    assert latest(spark, ROWS, [(10, 2, "retraction"), (10, 4, "amendment")])[10] == '{"a":1,"b":4}'


def test_other_payloads(spark):
    assert latest(spark, ROWS, [(10, 5, "amendment")])[10] == '"whole"'
    assert latest(spark, ROWS, [(10, 6, "amendment")])[10] == '{"a":1,"b":1}'


def test_deleted_rows_whose_payload_is_served(spark):
    chain = [(10, 2, "amendment"), (20, 4, "replacement")]
    assert 10 not in latest(spark, ROWS, chain, [1])
    assert 10 not in latest(spark, ROWS, chain, [4])
    assert 10 in latest(spark, ROWS, chain, [2])  # replaced, so no longer served


def test_cycles_and_lost_rows_are_errors(spark):
    with pytest.raises(PySparkException, match="comes back"):
        latest(spark, ROWS, [(10, 2, "amendment"), (20, 3, "amendment"), (30, 2, "amendment")])
    with pytest.raises(PySparkException, match="not there"):
        latest(spark, ROWS, [(10, 99, "amendment")])


def test_long_chains(spark):
    n = 12
    rows = [(i, i * 10, f'{{"k{i}":{i}}}') for i in range(1, n + 1)]
    got = latest(spark, rows, [(i * 10, i + 1, "amendment") for i in range(1, n)])
    assert list(got) == [10] and got[10].count(":") == n


def test_timeline_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for generation in (1, 2):
        for s in range(1, 40):
            for file in ("a", None):
                if r.random() < 0.5:
                    rows.append((1, s, s * 10, f"e{s % 3}", generation, file, s))
    df = spark.createDataFrame(rows, "epoch long, sequence long, event_id long, entity_id string, generation int, file_id string, row_ordinal long")
    deleted = [("a", 6), ("a", 9)]
    marks = spark.createDataFrame(deleted, "file_id string, row_ordinal long")
    got = [x["sequence"] for x in timeline.timeline(df, F.col("entity_id") == "e0", deletes=marks, low=(1, 3), high=(1, 30), limit=5, descending=True).collect()]
    best = {}
    for _, s, _, e, g, f, _ in rows:
        if e == "e0" and 3 <= s <= 30:
            best[s] = max(best.get(s, (False, 0, "")), (f is not None, g, f or ""))
    want = sorted((s for s, b in best.items() if (b[2], s) not in deleted), reverse=True)[:5]
    assert got == want


def test_walk_equals_brute_force(spark):
    r = random.Random(5)
    edges = sorted({(c, r.randrange(c)) for c in range(1, 60) for _ in range(3)})
    df = spark.createDataFrame([("s", c, "prev", p, 0) for c, p in edges], "subject string, child_sn long, kind string, parent_sn long, ord int")
    up = defaultdict(set)
    for c, p in edges:
        up[c].add(p)
    seen, level, want = {55, 40}, [55, 40], []
    while level:
        level = sorted({p for c in level for p in up[c]} - seen)
        seen |= set(level)
        want += level
    assert [x["sn"] for x in graph.walk(df, [55, 40]).collect()] == want
    assert [x["sn"] for x in graph.walk(df, [55, 40], limit=7).collect()] == want[:7]
    asked = spark.createDataFrame([(0,), (5,)], "sn long")
    got = {x["sn"]: (x["parents"]) for x in graph.parents(df, asked).collect()}
    assert got[0] == [] and sorted(got[5]) == sorted(up[5])


def test_needed_links_and_faults(spark):
    links = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 2, 4), (1, 3, 2, 6), (1, 3, 2, 6)], "from_chain long, from_seq long, to_chain long, to_seq long")
    assert sorted(tuple(x) for x in graph.needed_links(links).collect()) == [(1, 1, 2, 5), (1, 3, 2, 6)]
    ev = spark.createDataFrame([("s", 0), ("s", 1), ("s", 3)], "subject string, sn long")
    ed = spark.createDataFrame([("s", 1, "prev", 1, 0), ("s", 3, "prev", 0, 0), ("s", 3, "prev", 0, 1), ("s", 9, "auth", 0, 0)], "subject string, child_sn long, kind string, parent_sn long, ord int")
    assert {(x["fault"], x["sn"]) for x in graph.faults(ev, ed).collect()} == {("gap", 3), ("parent not earlier", 1), ("edge repeated", 3), ("unknown event", 9)}


def test_state_updates_equal_a_rebuild(spark):
    r = random.Random(9)
    deltas = [(f"t{r.randrange(3)}", f"k{r.randrange(4)}", sn, None if r.random() < 0.3 else sn) for sn in range(60)]
    df = spark.createDataFrame(deltas, "type_id string, state_key_id string, sn long, value long")
    for cut in (0, 20, 59):
        a = state.updated(state.state_at(df, cut), df.where(F.col("sn") > cut))
        b = state.state_at(df, 60)
        assert state.state_digest(a).first() == state.state_digest(b).first()
    assert state.diff_states(state.state_at(df, 20), state.state_at(df, 40)).collect() == state.state_diff(df, 20, 40).collect()


def test_rollup_equals_scan(spark):
    r = random.Random(2)
    rows = [(r.randrange(-500, 500), r.choice([None, float("nan"), r.random()]) if r.random() < 0.1 else round(r.random(), 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "occurred_at long, x double")
    rolled = rollup.rollup(df, ["x"], 30)
    for a, b in [(-500, 500), (-47, 133), (3, 9), (30, 60), (29, 61), (10, 10)]:
        x = [str(round(v, 9)) for v in rollup.range_aggregate(df, rolled, "x", a, b, 30).first()]
        assert x == [str(round(v, 9)) for v in rollup.scan_aggregate(df, "x", a, b).first()], (a, b)
    assert not rollup.can_answer_exact(1, 60, 30) and rollup.can_answer_exact(0, 60, 30) and not rollup.can_answer_exact(0, 60, 30, profile="event")


def test_compaction_plans(spark):
    def of(sizes, **more):
        rows = [("t", i, "event", 1, i * 10, i * 10 + 9, s, "active") for i, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "tenant_id string, file_id long, profile string, epoch long, first_sequence long, last_sequence long, size_bytes long, state string")
        return [ids for ids, _ in lifecycle.plan_compaction(more.get("change", lambda d: d)(df), "t", lifecycle.CompactionPolicy(target=100, **more.get("policy", {})))]

    assert of([10, 10, 10]) == [[0, 1, 2]]
    assert of([50, 10, 10]) == [[1, 2]]
    assert of([90, 5]) == []
    assert of([90, 20]) == [[0, 1]]
    assert of([10, 100, 10, 10]) == [[2, 3]]
    assert of([10] * 20) == [list(range(8)), list(range(8, 16)), list(range(16, 20))]
    assert of([10] * 20, policy={"jobs": 1}) == [list(range(8))]
    assert of([10] * 4, policy={"width": 1}) == []
    assert of([10] * 4, change=lambda d: d.where("file_id <> 1")) == [[2, 3]]
    graph_rows = [("t", i, "graph", i * 10, i * 10 + 9, 1, "active", "s") for i in range(9)]
    df = spark.createDataFrame(graph_rows, "tenant_id string, file_id long, profile string, first_sequence long, last_sequence long, size_bytes long, state string, subject string")
    assert lifecycle.plan_graph_compaction(df, "t") == [(list(range(9)), 9)]
    assert lifecycle.plan_graph_compaction(df, "t", lifecycle.GraphPolicy(output=3)) == [([0, 1, 2], 3), ([3, 4, 5], 3), ([6, 7, 8], 3)]


def test_pruning_never_loses_a_row(spark):
    r = random.Random(4)
    rows = [(g, r.choice([None, r.randrange(g * 5, g * 5 + 9)]), r.choice("abc")) for g in range(12) for _ in range(20)]
    df = spark.createDataFrame(rows, "granule_id long, x long, s string")
    stats = pruning.granule_stats(df, ["x", "s"])
    for clauses in ([("x", "eq", 20, None)], [("x", "in", [3, 44], None), ("s", "eq", "a", None)], [("x", "range", 10, 21)], [("x", "null", None, None)], [("x", "not_null", None, None)], [("x", "range", 9, 2)], [("x", "range", None, 4)]):
        got = sorted(map(tuple, pruning.pruned_scan(df, stats, clauses).select(*df.columns).collect()), key=str)
        assert got == sorted(map(tuple, df.where(pruning.clause_filter(clauses)).collect()), key=str)
    assert pruning.evaluate(stats, [("x", "eq", 20, None)]).where("keep").count() < 12


def test_index_choice():
    assert pruning.choose_index("range", ["split_block_bloom_filter", "range_filter", "min_max"]) == "min_max"
    assert pruning.choose_index("range", ["split_block_bloom_filter"]) is None
    assert pruning.choose_index("membership", ["text_token", "binary_fuse_filter"]) == "text_token"
    assert pruning.recommend_filter(300, 1000, True) == "binary_fuse" and pruning.recommend_filter(255, 300, True) == "bitmap_or_value_set"
    assert pruning.recommend_filter(300, 4000, False) == "bitmap_or_value_set" and pruning.recommend_filter(300, 0, False) == "bitmap_or_value_set"


def test_files_and_their_rules(spark, tmp_path):
    rows = spark.createDataFrame([(1, s, s * 10, f"e{s % 4}", s % 4, 1) for s in range(50, 0, -1)], "epoch long, sequence long, occurred_at long, entity_id string, entity_id_hash_low long, entity_id_hash_high long")
    files.write_events(rows, f"{tmp_path}/f")
    files.write_events(rows, f"{tmp_path}/f")
    back = files.open_events(spark, f"{tmp_path}/f")
    assert back.count() == 50 and files.sorted_by(back, ["epoch", "sequence"], "occurred_at")
    files.write_projection(rows, f"{tmp_path}/e")
    assert files.open_events(spark, f"{tmp_path}/e").count() == 50
    with pytest.raises(ValueError, match="same epoch"):
        files.write_events(rows.unionByName(rows.limit(1)), f"{tmp_path}/g")
    with pytest.raises(ValueError, match="needs a row"):
        files.checked(rows.limit(0))
    with pytest.raises(ValueError, match="goes back"):
        files.checked(rows.withColumn("occurred_at", -F.col("occurred_at")), "time_series", 60)
    with pytest.raises(ValueError):
        files.checked(rows, "time_series")
    with pytest.raises(ValueError):
        files.checked(rows, "event", 60)
    with pytest.raises(ValueError, match="one epoch"):
        files.checked(rows.withColumn("epoch", F.col("sequence")), "snapshot")
    with pytest.raises(ValueError, match="entity_id"):
        files.checked(rows.withColumn("entity_id", F.lit(None).cast("string")), "snapshot")


def test_scan_errors_and_rights(spark):
    df = spark.createDataFrame([(0, 0, "x"), (1, 1, "y")], "granule_id long, row_ordinal long, v string")
    for bad in (lambda: scan.projected(df, ["nope"]), lambda: scan.projected(df, ["v"], [7])):
        with pytest.raises(ValueError):
            bad()
    assert [r["v"] for r in scan.projected(df, ["v"], [1, 0, 1]).collect()] == ["y", "x", "y"]
    with pytest.raises(PermissionError):
        scan.family_egress(df, "v", internal=False)
    assert scan.authorize(["row_ordinal", "v", "q"], df.columns, "public") == (["v"], ["row_ordinal", "q"])
    assert scan.authorize(["row_ordinal", "q"], df.columns, "internal") == (["row_ordinal", "q"], [])
    m = spark.createDataFrame([("t1", 5, "s", 1, 10, 1, 2, 9)], "tenant_id string, created_at long, file_seal string, file_id long, file_size long, generation_id long, granule_count long, row_count long")
    with pytest.raises(PermissionError):
        manifest.system_files(m, "public")
    assert manifest.system_files(m, "tenant", "t2").count() == 0 and manifest.system_files(m, "admin").count() == 1
    assert manifest.can_move("open_tmp", "sealed") and manifest.can_move("active", "outdated") and not manifest.can_move("outdated", "active")


def test_vector_search(spark):
    r = random.Random(1)
    rows = [(i % 3, i, str(i), i % 5, "s", i, "m", [r.gauss(0, 1) for _ in range(16)]) for i in range(200)]
    df = spark.createDataFrame(rows, "segment long, row long, event_id string, room_id long, sender string, timestamp long, model string, embedding array<double>")
    q = rows[3][7]
    dot = lambda v: sum(a * b for a, b in zip(v, q))
    want = sorted(rows, key=lambda x: (-dot(x[7]), x[0], x[1]))[:7]
    assert [x["row"] for x in vector_search.search(df, q, 7, metric="dot").collect()] == [x[1] for x in want]
    assert vector_search.search(df, q, 500, metric="dot").count() == 200 and vector_search.search(df, q, 0).count() == 0
    from tidemark.functions.vectors import quantize_u1

    coarse = vector_search.search(df.withColumn("b", quantize_u1("embedding")), q, 7, coarse="b", metric="dot").collect()
    assert len({x["row"] for x in coarse} & {x[1] for x in want}) >= 5
    with pytest.raises(PySparkException, match="another model"):
        vector_search.search(df, q, 5, model="other").collect()
    with pytest.raises(PySparkException, match="not fit"):
        vector_search.checked(df, 16).collect()
    assert vector_search.checked(df, 16, "dot").count() == 200
    with pytest.raises(ValueError):
        vector_search.merged([df, df.withColumn("model", F.lit("n"))])
    stats = vector_search.segment_stats(df).withColumn("min_sender", F.lit(None).cast("string"))
    assert vector_search.prune_segments(stats, senders=["s"]).count() == 0 and vector_search.prune_segments(stats, rooms=[1]).count() == 3


def test_audit_finds_breaks(spark):
    rows = spark.createDataFrame([(f, i, f"v{f}{i}") for f in range(3) for i in range(4)], "file_id long, row_ordinal long, v string")
    start, links = audit.GENESIS, []
    for f in range(3):
        one = spark.createDataFrame([(f, f, start, "")], "file_id long, position long, chain_start string, chain_end string")
        end = audit.chain_ends(rows, one, ["v"]).first()["computed_end"]
        links.append((f, f, start, end))
        start = end
    table = spark.createDataFrame(links, "file_id long, position long, chain_start string, chain_end string")
    verdicts = lambda r, t: {x["file_id"]: x["verdict"] for x in audit.verify(r, t, ["v"]).collect()}
    assert set(verdicts(rows, table).values()) == {"ok"}
    assert verdicts(rows.where("not (file_id = 1 and row_ordinal = 2)"), table) == {0: "ok", 1: "rows altered", 2: "ok"}
    assert verdicts(rows, table.where("file_id <> 1")) == {0: "ok", 2: "chain break"}


def test_inbox_and_lifecycle(spark):
    rows = spark.createDataFrame([("t", "a", 1, 5, "f", 0), ("t", "a", 1, 9, "f", 1), ("u", "a", 1, 10, "f", 2), ("t", None, 1, 3, "g", 0)], "tenant_id string, recipient string, epoch long, sequence long, file_id string, row_ordinal long")
    acks = spark.createDataFrame([("t", "a", 1, 5)], "tenant_id string, recipient string, ack_epoch long, ack_sequence long")
    assert [r["sequence"] for r in inbox.unread(rows, acks, "t", "a").collect()] == [9]
    assert {r["file_id"]: r["done"] for r in inbox.fully_acked(rows, acks).collect()} == {"f": False, "g": False}
    m = spark.createDataFrame([(1, "outdated", 5, 10), (2, "outdated", 9, 10), (3, "outdated", 5, 99)], "file_id long, state string, outdated_at_generation long, horizon long")
    snaps = spark.createDataFrame([(7,), (8,)], "generation long")
    assert [r["file_id"] for r in lifecycle.retirable(m, snaps, 50).collect()] == [1]
    assert sorted(r["file_id"] for r in lifecycle.retirable(m, snaps.limit(0), 50).collect()) == [1, 2]
    assert lifecycle.should_roll(1 << 30, 0, 1) and not lifecycle.should_roll(1, 0, 1)


def test_overlaps_and_runs_equal_brute_force(spark):
    r = random.Random(8)
    a = [(i, (s := r.randrange(300)), s + r.randrange(90)) for i in range(60)]
    b = [(i, (s := r.randrange(300)), s + r.randrange(9)) for i in range(60)]
    got = relations.overlapping(spark.createDataFrame(a, "i long, a0 long, a1 long"), spark.createDataFrame(b, "j long, b0 long, b1 long"), ("a0", "a1"), ("b0", "b1"), 32)
    want = {(x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2]}
    pairs = [(x["i"], x["j"]) for x in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    marks = sorted({r.randrange(200) for _ in range(120)})
    df = spark.createDataFrame([(m,) for m in marks], "row_ordinal long")
    spans = [tuple(x) for x in bitmaps.runs(df, block=16).orderBy("first").collect()]
    assert [m for s, e in spans for m in range(s, e + 1)] == marks and all(b[0] > a[1] + 1 for a, b in zip(spans, spans[1:]))


def test_features_and_versions():
    assert security.check_features({"rollup"}, {"rollup", "new"}) == {"rollup"}
    with pytest.raises(ValueError):
        security.check_features({"new"})
    with pytest.raises(ValueError):
        security.check_version(9)
    with pytest.raises(PermissionError):
        security.of_tenant(None, "")
