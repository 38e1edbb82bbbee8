import itertools

import numpy as np
import pytest

from tidemark.llm import quality


@pytest.mark.parametrize("sizes", [[1], [3, 1, 5], [4, 4]])
def test_marginals_equal_enumeration(sizes):
    r = np.random.default_rng(sum(sizes))
    firsts = np.cumsum([0, *sizes])
    score, move = r.normal(size=firsts[-1]), r.normal(size=(2, 2))
    good, pairs, log_z = quality.marginals(score, move, firsts)
    want, want_pairs, want_z = np.zeros(firsts[-1]), np.zeros((2, 2)), 0.0
    for a, b in zip(firsts[:-1], firsts[1:]):
        z, g, p = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(score[a:b] @ np.array(path) + sum(move[i, j] for i, j in zip(path, path[1:])))
            z += w
            g += w * np.array(path)
            for i, j in zip(path, path[1:]):
                p[i, j] += w
        want[a:b] = g / z
        want_pairs += p / z
        want_z += np.log(z)
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_features_do_not_depend_on_the_batch():
    texts = ["A line.\nANOTHER!! LINE!!\n\nA line.", "", None, "x " * 5000, "a | b | c\n"]
    x, size, firsts = quality.line_features(texts)
    assert firsts.tolist() == [0, 4, 5, 6, 7, 9]
    for i, t in enumerate(texts):
        alone, s, _ = quality.line_features([t])
        assert np.array_equal(alone, x[firsts[i] : firsts[i + 1]]) and np.array_equal(s, size[firsts[i] : firsts[i + 1]])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op7_quality(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 500
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.98
    bad = [r["score"] for r in held if labels[r["doc_id"]] == 0]
    good = [r["score"] for r in held if labels[r["doc_id"]] == 1]
    assert np.mean(np.array(bad)[:, None] < np.array(good)) > 0.99


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (3, None), (None, 1), (9, 7), (4, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0].asDict().keys() == {*odd_docs.columns, "score"}
    none = quality.train(no_docs, labels.limit(0))
    assert quality.score(no_docs, none).collect() == []
    assert {r["score"] for r in quality.score(odd_docs, none).collect()} == {0.5}


def plain_score(text, model):
    """A document's score from the definitions: lines, neighbours, all paths' sums by recursion."""
    import math

    lines = (text or "").split("\n")
    x, size, firsts = quality.line_features([text])
    assert firsts.tolist() == [0, len(lines)] and size.tolist() == [len(line.encode()) for line in lines]
    n, k = x.shape
    zero = np.zeros(k)
    logits = []
    for i in range(n):
        full = [*x[i], *(x[i - 1] if i else zero), *(x[i + 1] if i + 1 < n else zero), i == 0, i == n - 1, 1]
        logits.append(max(-30.0, min(30.0, sum(float(a) * float(b) for a, b in zip(full, model.weights)))))

    def total(i, state, step):
        """The log of the summed weights of all ways onwards from line i in ``state``."""
        values = {state: 0.0}
        at = i
        while 0 <= at + step < n:
            at += step
            values = {t: (logits[at] if t else 0.0) + _log_sum([v + (model.move[s, t] if step > 0 else model.move[t, s]) for s, v in values.items()]) for t in (0, 1)}
        return _log_sum(list(values.values()))

    weight = score = 0.0
    for i in range(n):
        both = [total(i, s, 1) + total(i, s, -1) + (logits[i] if s else 0.0) for s in (0, 1)]
        w = max(size[i], 1)
        weight += w
        score += w * math.exp(both[1] - _log_sum(both))
    a, b = model.curve
    return 1 / (1 + math.exp(-(a * score / weight + b)))


def _log_sum(values):
    top = max(values)
    return top + np.log(sum(np.exp(v - top) for v in values))


def test_query_scores_equal_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality.op7_quality(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        if (t or "").count("\n") < 60:
            assert got[d] == pytest.approx(plain_score(t, model), abs=1e-5), d


def test_a_fit_takes_a_bounded_part(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, size, firsts, label, prior: seen.update(lines=np.diff(firsts).tolist(), label=label.tolist()))
    rows = [(1, "a line\n" * 5000)] * 3 + [(1, "another"), (2, "one\ntwo"), (3, None)]
    labels = [(i, i % 2) for i in range(1, 60) for _ in range(2)]
    quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), lines=50)
    assert len(seen["lines"]) <= 3 and max(seen["lines"]) <= 50


def test_features_have_other_definitions_too():
    """Some of the features, counted character by character."""
    text = "Hello, World! 42%\nHello, World! 42%\nno no no stop.\n\nÉcoute | bien"
    x, _, _ = quality.line_features([text])
    for line, row in zip(text.split("\n"), x):
        words, n = sum(c in " \t\r\x0b\x0c" for c in line) + 1, len(line.encode())
        letters = sum(c.isalpha() for c in line)
        assert row[1] == pytest.approx(sum("A" <= c <= "Z" for c in line) / (letters + 1))
        assert row[2] == pytest.approx(sum(c.isdigit() for c in line) / (n + 1))
        assert row[3] == pytest.approx(min(line.count("!") / words, 2))
        assert row[8] == pytest.approx(letters / (n + 1))
        assert row[9] == (text.split("\n").count(line) > 1 and line != "") and row[13] == (line == "")
    assert x[2][10] == pytest.approx(2 / 4)
