import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tidemark.llm import merge_dropout as md

LIBRARY = SentencePieceProcessor(model_file=md.default_path())
TEXT = st.text(st.one_of(st.sampled_from(" \n▁aeinrst"), st.characters(exclude_categories=["Cs"])), max_size=80)


def ids(seg, text, variant=0):
    return np.frombuffer(seg.encode([text], [variant])[0], seg.width).tolist()


WORD = re.compile(rf"\n|{md.SPACE}*[^{md.SPACE}\n]+|{md.SPACE}+").findall


def lockstep(s, word, salt):
    """The ids of one word in lockstep."""
    return s.segment(word, np.array([0]), np.array([salt], np.uint64))[0].tolist()


def long(s, word, salt):
    """The same by a heap agenda."""
    return [i for c in s._long(word, salt) for i in ([c] if c >= 0 else [s.byte_ids[b] for b in chr(-2 - c).encode()])]


@pytest.fixture(scope="module")
def seg():
    return {p: md.Segmenter(md.default_path(), p, 7) for p in (0.0, 0.3, 1.0)}


def test_no_dropout_equals_the_library(spark, seg):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["a  b", " a", "a\nb\tc", "ﬁ é ½", "", "   ", "日本語🙂", "x" * 500, "   lead", "trail  ", "\n\n"]
    for t in texts:
        assert ids(seg[0.0], t) == LIBRARY.encode(t), t[:80]


@given(TEXT, st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_decoding_is_lossless(seg, text, variant):
    for s in seg.values():
        assert s.decode(s.encode([text], [variant])[0]) == text


@given(st.text(st.sampled_from("aeinrstlo "), min_size=1, max_size=60), st.integers(0, 2**64 - 1))
@settings(max_examples=150, deadline=None)
def test_lockstep_equals_a_heap_agenda(seg, text, salt):
    for s in seg.values():
        for w in WORD(md.SPACE + text.replace(" ", md.SPACE)):
            assert lockstep(s, w, salt) == long(s, w, salt)


def brute(seg, word, salt):
    """The agenda one candidate at a time, from its definition."""
    parts = [(i, i + 1) for i in range(len(word))]
    vocabulary = {p: i for i, p in enumerate(seg.pieces) if i > 258}
    while True:
        best = None
        for k, ((a, b), (_, c)) in enumerate(zip(parts, parts[1:])):
            piece = vocabulary.get(word[a:c])
            skip = piece is not None and seg.skip_below is not None and md.hashed(np.uint64(salt), [a], [b], [c])[0] < seg.skip_below
            if piece is not None and not skip and (best is None or seg.scores[piece] > best[0]):
                best = (seg.scores[piece], k, (a, c))
        if best is None:
            return [word[a:b] for a, b in parts]
        parts[best[1] : best[1] + 2] = [best[2]]


@given(st.text(st.sampled_from("aeinrstlo"), min_size=1, max_size=14), st.integers(0, 2**64 - 1))
@settings(max_examples=150, deadline=None)
def test_agenda_equals_its_definition(seg, word, salt):
    for s in seg.values():
        assert [s.pieces[i] for i in lockstep(s, md.SPACE + word, salt)] == brute(s, md.SPACE + word, salt)


def test_segmentations_vary_and_repeat(seg):
    text = "internationalization of the representation " * 3
    found = {tuple(ids(seg[0.3], text, v)) for v in range(8)}
    assert len(found) == 8
    assert ids(md.Segmenter(md.default_path(), 0.3, 7), text, 3) == ids(seg[0.3], text, 3) != ids(md.Segmenter(md.default_path(), 0.3, 8), text, 3)
    assert len(ids(seg[1.0], text)) == len(text) + 1
    assert len(ids(seg[0.0], text)) < len(ids(seg[0.3], text)) < len(ids(seg[1.0], text))


def test_rows(spark, odd_docs, no_docs):
    made = md.encode(odd_docs).cache()
    back = sorted((r["doc_id"] or -1, r["text"]) for r in md.decode(made).collect())
    assert back == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_docs.collect())
    assert md.encode(no_docs).collect() == []


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = md.op8_merge_dropout(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_every_occurrence_has_its_own_skips(spark, seg):
    word = "internationalization"
    df = spark.createDataFrame([(i, f"{word} " * 40) for i in range(20)], "doc_id long, text string")
    rows = md.encode(df, dropout=0.3).collect()
    assert len({bytes(r["ids"]) for r in rows}) == 20
    s, cuts = seg[0.3], set()
    for piece in "".join(s.pieces[i] + "|" for i in np.frombuffer(rows[0]["ids"], s.width).tolist()).split(md.SPACE):
        cuts.add(piece)
    assert len(cuts) > 15


@given(st.lists(st.text(st.sampled_from("aeinrstlo日"), min_size=1, max_size=70), min_size=1, max_size=8), st.integers(0, 2**64 - 1))
@settings(max_examples=100, deadline=None)
def test_words_together_equal_each_alone(seg, words, key):
    for s in seg.values():
        many = words * 3
        salts = s.salts(np.full(len(many), key, np.uint64), np.arange(len(many)))
        ids_, counts = s.segment("".join(many), np.cumsum([0, *map(len, many)])[:-1], salts)
        got = [x.tolist() for x in np.split(ids_, np.cumsum(counts)[:-1])]
        assert got == [long(s, w, v) for w, v in zip(many, salts)]


@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 40)), st.integers(0, 1000), max_size=60))
@settings(max_examples=50, deadline=None)
def test_pairs_are_found(joins):
    table = md.Pairs({a << 32 | b: v for (a, b), v in joins.items()})
    left, right = (x.ravel() for x in np.meshgrid(np.arange(-2, 41), np.arange(-2, 41)))
    got = table.get(left.astype(np.int32), right.astype(np.int32))
    assert got.tolist() == [joins.get((a, b), -1) for a, b in zip(left.tolist(), right.tolist())]


def test_query_equals_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    s = md.Segmenter(md.default_path(), md.DROPOUT, md.SEED)
    pieces = {p: i for i, p in enumerate(s.pieces) if i > 258}
    got = {r["doc_id"]: r for r in md.op8_merge_dropout(spark, sf).collect()}
    for d, text in [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][::12]:
        want, place = [], 0
        for word in WORD(md.SPACE + text.replace(" ", md.SPACE)):
            for part in brute(s, word, s.salts(np.array([md.key_of(d, md.SEED)], np.uint64), np.array([place]))[0]):
                want += [pieces[part]] if part in pieces else [s.byte_ids[b] for b in part.encode()]
            place += 1
        assert (got[d]["n_tokens"], got[d]["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes())), d


@pytest.mark.parametrize("unit", ["x", "abcdefg", "日本語のテキストです", "QmFzZTY0IHRleHQgd2l0aG91dCBzcGFjZXM"])
def test_long_texts_without_spaces(seg, unit):
    text = (unit * (1 + 40_000 // len(unit)))[:40_000]
    for s in seg.values():
        assert s.decode(s.encode([text], [5])[0]) == text
    assert ids(seg[0.0], text) == LIBRARY.encode(text)
    word = md.SPACE + text[:63]
    assert all(lockstep(s, word, 3) == long(s, word, 3) for s in seg.values())


def test_places_past_22_bits(seg):
    unit = "internationalisation#"
    text = unit * (4_600_000 // len(unit))
    s = seg[0.3]
    made = s.encode([text], [1])[0]
    assert s.decode(made) == text
    # far along too, every place is cut by its own skips
    end = "".join(s.pieces[i] + "|" for i in np.frombuffer(made, s.width)[-4000:].tolist()).split("#")
    assert len(set(end[1:-1])) > 50
