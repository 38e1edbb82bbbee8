import random
import re

import pytest

from tidemark.llm import near_duplicates as nd
from tidemark.llm.workspace import Workspace


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute(docs, words, percent):
    """doc_id -> (set size, component) by comparing every two documents."""
    sets = {}
    for d, t in docs:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= percent * large:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (small + large - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def clump(n, seed, edits):
    """Near copies of one text with up to ``edits`` words changed, and texts that share a passage."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(60)]
    docs = [(0, " ".join(base))]
    for d in range(1, n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(60)}"
        docs.append((d, " ".join(w)))
    for d in range(n, n + n // 3):
        docs.append((d, " ".join(passage + [f"y{r.randrange(300)}" for _ in range(r.randint(0, 40))])))
    return docs


@pytest.mark.parametrize("edits", [3, 9])
def test_clump_equals_brute_force(spark, edits):
    docs = clump(150, edits, edits)
    assert got(nd.link_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85)) == brute(docs, 3, 85)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = nd.op3_near_duplicates(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_exact_prefixes_alone_find_every_link(spark):
    docs = clump(120, 5, 8)
    ws = Workspace(spark, "test")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    signed = nd.signatures(df, 3, 4)
    sets = nd.full_sets(df, signed.selectExpr("doc_id as id", "doc_id as doc", "key"), 3).cache()
    assert sets.count() == len(docs)
    pairs = nd.prefix_pairs(ws, sets.selectExpr("*", "id as label"), 85)
    links = {(r["a"], r["b"]) for r in nd.confirmed(pairs, sets, 85).collect()}
    full = {r["id"]: set(r["shingles"]) for r in sets.collect()}
    want = {(a, b) for a in full for b in full if a < b and 100 * len(full[a] & full[b]) >= 85 * len(full[a] | full[b])}
    assert links == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in nd.link_components(odd_docs).collect())
    assert rows == [(-1, 1, None, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 3, 4, True), (5, 3, 4, False), (7, 4, 7, True), (9, 3, 9, True), (9, 3, 9, True)]
    assert nd.link_components(no_docs).collect() == []


def test_matches_needed():
    t = nd.matches_needed(64, 85)
    assert 36 <= t <= 42
    assert nd.matches_needed(64, 100) == 64


def long_text(seed, n=80):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def by_rows(rows, words, percent):
    """Rows (doc_id, text) -> (set size, component, smallest id) by place, ids repeated or missing."""
    places = brute([(i, t) for i, (_, t) in enumerate(rows)], words, percent)
    least = {}
    for i, (d, _) in enumerate(rows):
        root = places[i][1]
        least[root] = min((x for x in (least.get(root), d) if x is not None), default=None)
    return [(d, places[i][0], places[i][1], least[places[i][1]]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_ids_with_several_texts_lose_no_link(spark, seed):
    a, b, c = long_text(100 + seed), long_text(200 + seed), long_text(300 + seed)
    rows = [(5, a), (5, b), (9, a + " extra"), (9, c), (None, c + " more"), (None, c + " more words"), (None, None), (7, b), (7, b), (5, a), (11, c + " more words again"), (12, ""), (12, "")]
    rows += [(3, long_text(400 + seed)), (3, long_text(400 + seed) + " end"), (None, long_text(500 + seed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in nd.link_components(df, 3, 85).collect()), key=str)
    want = sorted(((d is None, d, n, (least if n else d) or -1, d is not None and (not n or d == least)) for d, n, _, least in by_rows(rows, 3, 85)), key=str)
    assert got == want
    left = nd.one_of_each(df, 3, 85).collect()
    groups = {}
    for (d, t), (_, n, root, _) in zip(rows, by_rows(rows, 3, 85)):
        groups.setdefault((root,) if n else (d, t, root, "empty"), []).append((d, t))
    assert len(left) == len(groups)
    assert sorted(str((r["doc_id"], r["text"])) for r in left) == sorted(str(min(g, key=lambda x: (x[0] is None, x[0] or 0, nd.hashlib.md5((x[1] or "").encode()).hexdigest()))) for g in groups.values())


def test_names_that_clash_with_helpers(spark):
    names = ["key", "digest", "least", "component", "id", "doc", "first", "stays", "none", "n", "_nth"]
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    df = df.selectExpr("*", *(f"'{c}' as `{c}`" for c in names), "'dot' as `a.b`")
    rows = nd.one_of_each(df).collect()
    assert [tuple(r) for r in rows] == [(1, "a b c d e f", *names, "dot")]


def test_words_hash_alike_however_texts_are_cut():
    from tidemark.llm.shingles import word_hashes

    r = random.Random(1)
    texts = [" ".join("x" * r.randrange(1, 30) + str(r.random()) for _ in range(r.randrange(40))).encode() for _ in range(40)] + [b"", b"y" * 5000, b"  ", b"\x0b"]
    for span in (1, 7, 64, 1000):
        (a, b), (c, d) = word_hashes(texts, span), word_hashes(texts)
        assert (a == c).all() and (b == d).all()
