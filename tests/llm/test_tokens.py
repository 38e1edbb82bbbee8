import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_store
from tidemark.llm.token_ids import default_path, encoder
from tidemark.llm.workspace import Workspace


LIBRARY = Tokenizer.from_file(default_path())


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.text(max_size=60), max_size=4))
@settings(max_examples=60, deadline=None)
def test_ids_equal_the_library(texts):
    enc = encoder(default_path())
    assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(texts)] == [library_ids(t) for t in texts]


@given(st.lists(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", " ", "a", "é", "\n", "<|", "|>"]), st.characters(exclude_categories=["Cs"]))).map("".join), max_size=4))
@settings(max_examples=60, deadline=None)
def test_special_tokens_are_the_librarys(texts):
    enc = encoder(default_path())
    texts = [*texts, "end <|endoftext|> here", "<|endoftext|>" * 3]
    assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(texts)] == [library_ids(t) for t in texts]
    assert 50256 in library_ids(texts[-2])


def test_another_tokenizer_goes_through_the_library(tmp_path):
    import json

    import public_tokenizers

    other = public_tokenizers.path("word_bpe_49k.json")
    with open(default_path()) as f:
        rules = json.load(f)
    rules["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "spaced.json").write_text(json.dumps(rules))
    for path in (other, str(tmp_path / "spaced.json")):
        library, enc = Tokenizer.from_file(path), encoder(path)
        texts = ["Hello there World", "  two  spaces\n", "", "naïve 日本", "it's 12"]
        assert not enc.known_rule
        assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder(default_path()).known_rule


def store_rows(spark, docs):
    ws = Workspace(spark, "test")
    manifest = ws.stage(token_store.write_store(docs, ws.mkdirs("store")), "manifest")
    return token_store.read_store(spark, manifest).collect()


def test_store_round_trip(spark, odd_docs):
    rows = sorted(store_rows(spark, odd_docs), key=lambda r: r["start"])
    expected = sorted(((r["doc_id"], [*library_ids(r["text"]), 0]) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(d, len(i), crc(i)) for d, i in expected]
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [len(i) for _, i in expected])[:-1])


def test_store_keeps_every_id(spark):
    rows = [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (0, "zero"), *[(None, f"none {i}") for i in range(40)], *[(7, f"seven {i % 9}") for i in range(60)]]
    got = sorted(store_rows(spark, spark.createDataFrame(rows, "doc_id long, text string")), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(library_ids(t)) + 1, crc([*library_ids(t), 0])) for d, t in rows)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]


def test_store_of_nothing(spark, no_docs):
    assert store_rows(spark, no_docs) == []


def test_store_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in token_store.op5_token_store(spark, sf).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library_ids(r["text"]), 0]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def check_packed(rows, docs, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text, copies in docs:
        ids = [*library_ids(text), 2]
        mine = sorted(by_doc.pop(doc_id), key=lambda r: r["piece"])
        assert len(mine) == copies * -(-len(ids) // capacity)
        assert sum(r["length"] for r in mine) == copies * len(ids)
        for r in mine:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
            assert r["piece"] == 0 or r["length"] == capacity
    assert not by_doc
    return len(by_sequence)


def test_packing_odd_rows(spark, odd_docs, no_docs):
    counts = defaultdict(int)
    texts = {}
    for r in odd_docs.collect():
        counts[r["doc_id"]] += 1
        texts[r["doc_id"]] = r["text"]
    check_packed(packing.pack(odd_docs).collect(), [(d, texts[d], c) for d, c in counts.items()])
    assert packing.pack(no_docs).collect() == []


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = packing.op10_packing(spark, sf).collect()
    used = check_packed(rows, [(r["doc_id"], r["text"], 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert used <= 1 + -(-sum(r["length"] for r in rows) // 1024) * 1.02


def optimum(sizes, capacity):
    """Fewest bins, by trying everything."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {v: k for k, v in enumerate(bins)}.values():
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                go(i + 1, bins)
                bins[b] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_plan_is_near_the_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    counts = {n: sizes.count(n) for n in sizes}
    patterns = packing.plan(counts, 20)
    got = defaultdict(int)
    for pattern, times in patterns:
        assert sum(n * each for n, each in pattern) <= 20
        for n, each in pattern:
            got[n] += each * times
    assert dict(got) == counts
    assert sum(t for _, t in patterns) <= optimum(sizes, 20) + (1 if len(sizes) else 0)


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=300, deadline=None)
def test_reduction_keeps_the_optimum(sizes):
    """Sets fixed by dominance, of any piece, can be completed to an optimal packing."""
    left = {n: sizes.count(n) for n in sizes}
    for j in sorted(left):
        k = packing._dominating(j, left, sorted(left), 20)
        if k is not None:
            rest = sorted(sizes, reverse=True)
            rest.remove(j)
            if k:
                rest.remove(k)
            assert 1 + optimum(rest, 20) == optimum(sorted(sizes, reverse=True), 20)
    fixed = sum(times for _, times in packing._reduced(left, 20))
    assert fixed + optimum(sorted((n for n, c in left.items() for _ in range(c)), reverse=True), 20) == optimum(sorted(sizes, reverse=True), 20)


def test_reduction_goes_past_a_length_that_has_no_dominating_set():
    # 10 has none (3 + 3 + 4 fit beside it), 15 with 5 is exact
    left = {10: 1, 15: 1, 5: 1, 3: 2, 4: 1}
    assert packing._reduced(dict(left), 20)[0] == (((15, 1), (5, 1)), 1)
    left = {12: 1, 4: 1, 3: 3, 2: 2, 11: 1, 9: 1}
    assert (((11, 1), (9, 1)), 1) in packing._reduced(left, 20)


def test_plan_refuses_bad_lengths():
    with pytest.raises(ValueError):
        packing.plan({0: 1})


def test_partitions_follow_the_input(spark):
    from tidemark.llm import workspace

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert workspace.partitions_for(docs) == workspace.shuffle_partitions(spark)
    old, workspace.PARTITION_BYTES = workspace.PARTITION_BYTES, 100_000
    try:
        assert workspace.partitions_for(docs) > 100
    finally:
        workspace.PARTITION_BYTES = old
    assert workspace.partitions_for(spark.createDataFrame([(1,)], "x long")) == workspace.shuffle_partitions(spark)
