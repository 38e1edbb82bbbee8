"""The search of many queries in blocks against single searches and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import search_blocks, vector_search
from tidemark.plans import catalogue

SCHEMA = "segment string, row long, event_id string, model string, embedding array<float>"


def made(n, dimension, seed, values=None):
    """Vectors of few values, so that scores and shared bits tie; a third are copies."""
    rng = np.random.default_rng(seed)
    x = rng.choice(values, (n, dimension)) if values else rng.normal(size=(n, dimension))
    copies = rng.random(n) < 1 / 3
    x[copies] = x[rng.integers(0, max(n // 20, 1), copies.sum())]
    return x.astype(np.float32)


@pytest.fixture
def tiles(monkeypatch):
    monkeypatch.setattr(search_blocks, "TILE_ROWS", 100)
    monkeypatch.setattr(search_blocks, "TILE_QUERIES", 4)


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_each_query_as_by_itself(spark, tiles, metric):
    x = made(330, 70, 3, [-1.0, -0.3, 0.0, 0.7, 1.0])
    x[5] = 0
    segments = ["b", None, "a", "é"]
    rows = spark.createDataFrame([(segments[i * 7 % 4] if i < 320 else "few", i, str(i), "m", v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(5)
    rows = rows.withColumn("bits", vectors.quantize_u1("embedding"))
    asked = [0, 5, 17, 200, 329]
    queries = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in asked], "q string, embedding array<float>")
    for options in ({}, {"coarse": "bits", "share": 0.3, "oversample": 1}, {"coarse": "bits", "share": 0.0, "oversample": 2, "where": F.col("row") > 3}):
        found = vector_search.search_all(rows, queries, 9, metric=metric, model="m", **options)
        assert found.columns == ["q", "segment", "row", "event_id", "score"]
        got = {}
        for r in found.orderBy("q", F.col("score").desc(), "segment", "row").collect():
            got.setdefault(r["q"], []).append(tuple(r)[1:])
        for i in asked:
            alone = [tuple(r) for r in vector_search.search(rows, x[i].tolist(), 9, metric=metric, model="m", **options).collect()]
            assert got[f"q{i}"] == alone, (metric, options, i)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search_blocks, "TILE_ROWS", 2_500)
    monkeypatch.setattr(search_blocks, "TILE_QUERIES", 1_100)
    n, k, share = 5_000, 10, 0.1
    x = made(n, 16, 4)
    rows = spark.createDataFrame([(str(i % 2), i, str(i), "m", v.tolist()) for i, v in enumerate(x)], SCHEMA).withColumn("bits", vectors.quantize_u1("embedding"))
    asked = random.Random(5).sample(range(n), 1_300)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in asked], "q long, embedding array<float>")
    score = np.zeros((len(asked), n))
    for j in range(16):
        score = score + np.outer(x[asked, j].astype(float), x[:, j].astype(float))
    shared = ((x[asked] > 0)[:, None] == (x > 0)[None]).sum(2)
    segment, row = np.arange(n) % 2, np.arange(n)
    for coarse in (None, "bits"):
        want = set()
        for a, i in enumerate(asked):
            left = row
            if coarse:
                parts = [row[segment == s] for s in (0, 1)]
                left = np.concatenate([p[np.lexsort((p, -shared[a, p]))[: max(100, int(np.ceil(len(p) * share)))]] for p in parts])
            best = left[np.lexsort((left, segment[left], -score[a, left]))[:k]]
            want |= {(i, int(r), float(score[a, r])) for r in best}
        found = vector_search.search_all(rows, queries, k, metric="dot", coarse=coarse, share=share)
        assert {tuple(r) for r in found.select("q", "row", "score").collect()} == want
        assert found.count() == len(want)


def test_unfit_vectors_and_nothing(spark, tiles):
    rows = spark.createDataFrame([("a", i, str(i), "m", v.tolist()) for i, v in enumerate(made(20, 8, 6))], SCHEMA)
    queries = rows.select(F.col("row").alias("q"), "embedding")
    assert vector_search.search_all(rows, queries.limit(0), 3).count() == 0
    assert vector_search.search_all(rows.limit(0), queries, 3).count() == 0
    for bad in ([1.0] * 7, [float("nan")] * 8, None):
        more = rows.unionByName(spark.createDataFrame([("a", 99, "99", "m", bad)], SCHEMA))
        with pytest.raises(Exception, match="a vector is"):
            vector_search.search_all(more, queries, 3).collect()


def test_recall_is_one_plan_for_any_number_of_queries(spark, tmp_path):
    """One plan a query would not end within minutes on ten thousand rows."""
    sizes = {}
    for n in (400, 4_000):
        x = made(n, 64, 7)
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
        found = catalogue.QUERIES["v01_two_stage_recall"](spark, folder)
        sizes[n] = found._jdf.queryExecution().analyzed().toString().count("\n")
        assert [r["asked"] for r in found.collect()] == [n // 20]
    assert sizes[400] == sizes[4_000]
