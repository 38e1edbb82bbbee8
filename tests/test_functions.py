"""Functions against plain Python and hand-made cases."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import floats, identifiers, payload, predicates, text, times, vectors
from tidemark.functions.predicates import Bound

NAN = float("nan")


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def values(spark, rows, kind, column):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(column).collect()]


def test_string_predicates_ignore_nulls(spark):
    rows = ["a", "B", None, "é", ""]
    assert values(spark, rows, "string", predicates.not_equals("x", "a")) == [False, True, False, True, True]
    assert values(spark, rows, "string", predicates.in_range("x", Bound("B"), Bound("a", False))) == [False, True, False, False, False]
    assert values(spark, rows, "string", predicates.is_in("x", [])) == [False] * 5
    assert values(spark, rows, "string", predicates.contains_all("x", [""])) == [True, True, False, True, True]
    assert values(spark, ["ÉA", "éa"], "string", predicates.contains_all("x", ["Éa"], True)) == [True, False]


def test_float_predicates_follow_ieee(spark):
    rows = [1.0, NAN, -0.0, 0.0, None, math.inf]
    run = lambda c: values(spark, rows, "double", c)
    assert run(predicates.float_equals("x", 0.0)) == [False, False, True, True, False, False]
    assert run(predicates.float_equals("x", NAN)) == [False] * 6
    assert run(predicates.float_not_equals("x", 1.0)) == [False, True, True, True, False, True]
    assert run(predicates.float_not_equals("x", NAN)) == [True, True, True, True, False, True]
    assert run(predicates.float_range("x", Bound(0.0))) == [True, False, True, True, False, True]
    assert run(predicates.float_range("x")) == [True, True, True, True, False, True]
    assert run(predicates.float_range("x", Bound(NAN))) == [False] * 6
    assert run(predicates.float_in("x", [1.0, NAN, math.inf])) == [True, False, False, False, False, True]


def test_float_summary(spark):
    df = spark.createDataFrame([(1, 0.0), (1, -0.0), (1, NAN), (2, NAN), (3, None), (4, 2.0), (4, None), (4, 3.0)], "g int, x double")
    got = {r["g"]: r for r in df.groupBy("g").agg(*floats.summary("x", exact_zeros=True)).collect()}
    assert got[1]["count"] == 3 and math.isnan(got[1]["sum"])
    assert math.copysign(1, got[1]["min"]) == -1 and math.copysign(1, got[1]["max"]) == 1
    assert got[2]["count"] == 1 and math.isnan(got[2]["min"])
    assert (got[3]["count"], got[3]["sum"]) == (0, 0.0) and math.isnan(got[3]["max"])
    assert (got[4]["count"], got[4]["sum"], got[4]["min"], got[4]["max"]) == (2, 5.0, 2.0, 3.0)
    again = df.groupBy("g").agg(*floats.summary("x")).agg(*floats.merged()).first()
    assert again["count"] == 6 and math.isnan(again["sum"]) and again["max"] == 3.0


def test_tokens(spark):
    assert values(spark, ["Don't STOP,now! é Ü x", "", None], "string", text.tokens("x")) == [["don't", "stop", "now", "é", "ü", "x"], [], None]
    assert values(spark, ["abcd", "ab", None], "string", text.trigrams("x")) == [["abc", "bcd"], [], None]
    assert values(spark, ["abcdef"], "string", text.may_contain(text.trigrams("x"), "bcx")) == [False]
    assert values(spark, ["abcdef"], "string", text.may_contain(text.trigrams("x"), "zz")) == [True]


def test_times_round_down(spark):
    assert values(spark, [-1, 0, 59, 60, -61, 2**62], "long", times.floor_div("x", 60)) == [x // 60 for x in (-1, 0, 59, 60, -61, 2**62)]
    with pytest.raises(ValueError):
        times.floor_div("x", 0)


def test_payload_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, {"c": 2.50}]}, "s": "x", "n": null, "big": 99999999999999999999}',), ("not json",), (None,)], "p string").select(payload.parse("p").alias("payload"))
    rows = df.select(
        payload.nested("payload", ["a", "b", 1, "c"], "double").alias("c"), payload.nested("payload", ["s", "x"]).alias("wrong"), payload.field("payload", "s").alias("s"), payload.field("payload", "none").alias("none")
    ).collect()
    assert [tuple(r) for r in rows] == [(2.5, None, "x", None), (None,) * 4, (None,) * 4]
    assert {r["key"] for r in payload.collect_keys(df).collect()} == {"a", "b", "c", "s", "n", "big"}
    kinds = {r["path"]: r["kind"] for r in payload.path_statistics(df).collect()}
    assert kinds == {"a": "object", "s": "string", "n": "null", "big": "decimal"}


def test_shred_plan(spark):
    rows = [("dense", "int", 60), ("mixed", "int", 60), ("mixed", "string", 30), ("rare", "string", 4), ("obj", "object", 90)] + [(f"s{i:02d}", "string", 10 + i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "path string, kind string, n long")
    plan = {r["path"]: r["tier"] for r in payload.shred_plan(df, 100, ["s01"]).collect()}
    assert plan.pop("dense") == "dense"
    assert sorted(plan) == sorted([f"s{i:02d}" for i in range(3, 20, 2)] + [f"s{i:02d}" for i in range(0, 14, 2)])
    with pytest.raises(ValueError):
        payload.validate_promotion([("amount", "double")])


def test_identifiers(spark):
    e = {"type": "m.room.member", "content": {"membership": "join", "x": 1}, "z": 1, "unsigned": {}, "hashes": {"sha256": "q"}, "event_id": "$own", "origin": "o"}
    df = spark.createDataFrame([(json.dumps(e),), ('{"a": 1.5}',), ("nope",), (None,), (json.dumps({"a": 2**53}),)], "e string")
    got = [r[0] for r in df.select(identifiers.canonical_json("e")).collect()]
    assert got == [json.dumps(e, sort_keys=True, separators=(",", ":")), None, None, None, None]
    ids = {v: df.select(identifiers.event_id_udf(v)("e")).first()[0] for v in (1, 3, 4, 11)}
    assert ids[1] == "$own" and len(ids[3]) == 44 and ids[3].translate(str.maketrans("+/", "-_")) == ids[4] != ids[11]
    assert len(df.select(identifiers.content_hash("e")).first()[0]) == 43
    assert tuple(one(spark, identifiers.parse_reference(F.lit("event:0aff")))[0]) == ("event", bytearray(b"\x0a\xff"))
    assert one(spark, identifiers.parse_reference(F.lit("event:0AFF")))[0] is None
    assert one(spark, identifiers.relationships_valid(F.lit("parent"), F.lit("a b")), identifiers.relationships_valid(F.lit("prev"), F.lit("a b"))) == (False, True)
    content = 'say "hi"\n\\'
    made = one(spark, identifiers.protocol_event_id(F.lit("ab"), F.lit(5), F.lit(1), F.lit("[]"), F.lit(content)))[0]
    assert made == hashlib.sha256(f'[0,"ab",5,1,[],{json.dumps(content)}]'.encode()).hexdigest()


def test_vectors(spark):
    v = [0.5, -1.0, 0.25, 2.0] * 20
    x = vectors.literal(v)
    q, u = vectors.quantize_i8(x), vectors.quantize_u1(x)
    r = one(spark, vectors.dequantize_i8(q), vectors.dequantize_u1(u), vectors.hamming(u, vectors.quantize_u1(vectors.literal([-a for a in v]))), vectors.estimated_dot(x, u), vectors.quantize_i8(vectors.literal([3.0, 3.0])), vectors.half(x.cast("array<float>")), vectors.cosine(x, vectors.literal([0.0] * 80)))
    assert max(abs(a - b) for a, b in zip(r[0], v)) <= 3.0 / 255
    assert [a > 0 for a in r[1]] == [a > 0 for a in v]
    assert r[2] == 0
    norm = sum(a * a for a in v) ** 0.5
    assert r[3] == pytest.approx(norm * sum(abs(a) for a in v) / (80**0.5 * (sum(abs(a) for a in v) / (norm * 80**0.5))))
    assert (r[4]["values"], r[4]["scale"], r[4]["offset"]) == ([0, 0], 1.0, 3.0)
    assert r[5] == v and r[6] == 0.0
    with pytest.raises(ValueError):
        vectors.prefix("x", 2, "i8")
