import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp


def h(*parts):
    """Spark's xxhash64 of strings and longs, chained by seed."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True) if isinstance(p, int) else None
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def sketch(text):
    words = [h(w) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if len(words) >= 5:
        every = {h(*words[i : i + 5]) for i in range(len(words) - 4)}
    elif words:  # all words and their number, which is a 32-bit integer, as one shingle
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.to_bytes(8, "little", signed=True), seed=seed)
        seed = xxhash.xxh64_intdigest(len(words).to_bytes(4, "little"), seed=seed)
        every = {seed - (1 << 64) if seed >> 63 else seed}
    else:
        every = set()
    kept = sorted(x for x in every if x < fp.bound())
    return kept or sorted(every)[:1]


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def expected(docs):
    """(doc_id, text) -> rows by brute force; docs have distinct ids."""
    docs = sorted(docs, reverse=True)
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        k = len(t) // 3
        yield d, t, t[: len(t) - k] + nxt[:k], nxt


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in fp.op1_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    checked = 0
    for d, t, e, nxt in expected(docs):
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = sketch(t), sketch(e), sketch(nxt)
        checked += len(t.split()) < 5
        assert r["fingerprint"] == "".join(f"{x & (1 << 64) - 1:016x}" for x in a)
        assert r["edited_fingerprint"] == "".join(f"{x & (1 << 64) - 1:016x}" for x in b)
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
    assert checked  # short ones are among them


def test_odd_rows(spark, odd_docs, no_docs):
    rows = fp.with_next(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["next_text"].startswith("one two three") and by[2]["next_text"] == "" and by[3]["next_text"] == " \t\n "
    assert by[1]["next_text"] == "no id here" and by[None]["next_text"].startswith("lorem")
    assert len({r["next_text"] for r in rows if r["doc_id"] == 9}) == 2
    assert by[5]["sketch"] == by[4]["sketch"] and by[1]["sketch"] == []
    assert fp.with_next(no_docs).collect() == []


def test_merge_and_containment(spark):
    whole = [f"w{i}" for i in range(4000)]
    rows = [(" ".join(whole), " ".join(whole[1000:1400]))]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "x"), "b", "y")
    r = df.select(fp.containment("y", "x").alias("c"), fp.containment("x", "y").alias("d"), (fp.merged("x", "y") == F.col("x")).alias("same")).first()
    assert r["c"] == 1.0 and r["same"] and 0.06 < r["d"] < 0.14


def test_ranges_split_anywhere(spark):
    from tidemark.llm import workspace

    for bounds in ((), (3,), (3, 5, 5 + 1, 9, 12, 40, 41), (2, 7, 7, 7, 9), tuple(range(-50, 50))):
        for nulls in (0, 1, 3):
            cuts = workspace.Cuts(nulls, bounds)
            df = spark.range(-60, 60).select(F.col("id").alias("x")).unionByName(spark.range(1).selectExpr("cast(null as long) as x"))
            df = df.select("x", F.explode(F.array(*[F.lit(h).cast("long") for h in (-(1 << 63), -(1 << 62), 0, 1 << 62, (1 << 63) - 1)])).alias("h"))
            rows = df.select("x", "h", workspace.range_of(cuts, "x", F.col("h")).alias("r")).collect()
            rows = sorted(rows, key=lambda r: (r["x"] is not None, r["x"] or 0, r["h"]))
            found = [r["r"] for r in rows]
            assert found == sorted(found) and 0 <= found[0] and found[-1] <= nulls + len(bounds)
            for r in rows:
                if r["x"] is None:
                    assert r["r"] < max(nulls, 1)
                else:
                    assert all((b <= r["x"]) if i < r["r"] - nulls else (b >= r["x"]) for i, b in enumerate(bounds))


def test_cuts_give_hot_ids_several_ranges(spark):
    from tidemark.llm import workspace

    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 777 when id % 3 = 1 then id end as x", "xxhash64(id) as h")
    cuts = workspace.cut_ranges(df, "x", 12)
    counts = [r[1] for r in df.groupBy(workspace.range_of(cuts, "x", F.col("h"))).count().collect()]
    assert cuts.nulls == 4 and len(counts) >= 10 and max(counts) < 700
    assert workspace.cut_ranges(df.limit(0), "x", 12) == workspace.Cuts(0, ())
    assert workspace.cut_ranges(df.where("x is null"), "x", 12) == workspace.Cuts(12, ())


@pytest.mark.parametrize("ids", ["one", "none", "some"])
def test_order_of_repeated_and_missing_ids(spark, ids):
    rows = [({"one": 7, "none": None, "some": (None, 7, i)[i % 3]}[ids], f"text {i % 40} " + "word " * (i % 5)) for i in range(90)]
    got = fp.with_next(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "next_text").collect()
    want = sorted(((d is not None, d or 0, h(t), t) for d, t in rows), reverse=True)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, h(r["text"]), r["text"], r["next_text"]) for r in got) == sorted((*w, want[(i + 1) % len(want)][3]) for i, w in enumerate(want))


def test_driver_rows_need_no_python_workers(spark):
    from tidemark.llm import workspace

    rows = [(None, -(1 << 63), 1), ((1 << 63) - 1, 5, 2)]
    df = workspace.literal_rows(spark, rows, "a long, b long, c int")
    assert [tuple(r) for r in df.collect()] == rows and "Python" not in df._jdf.queryExecution().toString()


def test_short_texts_are_compared_exactly(spark):
    whole = [f"w{i}" for i in range(300)]
    rows = [(" ".join(whole), " ".join(whole[i : i + 7]), " ".join([*whole[i : i + 7], "other"])) for i in range(0, 290, 5)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for text in "abc":
        df = fp.with_sketch(df, text, f"{text}s")
    for r in df.select(fp.containment("bs", "as").alias("in"), fp.containment("cs", "as").alias("part"), fp.likeness("bs", "as").alias("like"), fp.likeness("bs", "cs").alias("near")).collect():
        assert (r["in"], r["part"], r["near"]) == (1.0, 0.75, 0.75) and r["like"] == pytest.approx(3 / 296)


def test_a_guard_tells_nothing_of_a_longer_text(spark):
    whole = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(whole), " ".join(whole[i : i + 5])) for i in range(64)], "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "x", scale=8), "b", "y", scale=8)
    rows = df.select(fp.containment("y", "x", 8).alias("c"), fp.likeness("y", "x", 8).alias("l"), fp.likeness("y", "y", 8).alias("same"), (F.get("y", F.lit(0)) < fp.bound(8)).alias("proper")).collect()
    assert {r["proper"] for r in rows} == {True, False} and all(r["same"] == 1.0 for r in rows)
    assert all((r["c"], r["l"] is None) == ((1.0, False) if r["proper"] else (None, True)) for r in rows)
