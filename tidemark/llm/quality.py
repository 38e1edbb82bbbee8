"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are those of the line and of the lines before and after
it; transitions tie neighbours together. Labels exist for documents only, so line labels are
learned by alternation: all lines of a bad document start as bad, and after each fit those that
the field finds good are relabelled (a bad document keeps its worst line bad). A document's score
is the length-weighted mean of its lines' forward-backward marginals, put on a probability scale
by a logistic curve fitted to the labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shingles import SPACE, _powers, mix
from tidemark.llm.workspace import short_batches, slices

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lead": bytes(range(0xC2, 0xF5)),
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "stop": b".,;:?'\"-",
    "loud": b"!",
    "symbol": b"#$%&*@^~=+_\\",
    "bar": b"|<>{}[]/",
}
N_FEATURES = 14
#: Labelled documents of each label that a fit uses at most, those whose ids have the smallest hashes.
SAMPLE = 2000
#: Lines of a labelled document that a fit uses at most: a run of lines from its middle.
FIT_LINES = 400
ROUNDS = 3
THRESHOLD = 0.7


def _tables() -> list[np.ndarray]:
    names = list(_CLASSES)
    out = []
    for i in range(0, len(names), 2):
        t = np.zeros(256, np.int64)
        for j, name in enumerate(names[i : i + 2]):
            t[list(_CLASSES[name])] += 1 << (31 * j)
        out.append(t)
    return out


TABLES = _tables()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, bytes of each, and where each text's lines begin (and the last end).

    Every text has a line: an empty or null text is one empty line.
    """
    plain = [(t or "").encode() for t in texts]
    buffer = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    text_ends = np.cumsum([len(t) + 1 for t in plain]) - 1
    firsts = np.concatenate([[0], np.searchsorted(ends, text_ends) + 1])

    counts = []
    for t in TABLES:
        both = np.add.reduceat(t[buffer], starts)
        counts += [both & 0x7FFFFFFF, both >> 31]
    lower, upper, lead, digit, space, stop, loud, symbol, bar = (c.astype(np.float64) for c in counts[: len(_CLASSES)])

    up, down = _powers.of(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(buffer.astype(np.uint64) * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + size.astype(np.uint64))
    owner = np.repeat(np.arange(len(plain)), np.diff(firsts))
    _, back, times = np.unique(mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = (times[back] > 1) & (size > 0)

    edges = np.flatnonzero(np.diff(SPACE[buffer], prepend=True))
    a, b = edges[::2], edges[1::2]
    word = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
    echo = np.zeros(len(starts))
    same = a[1:][word[1:] == word[:-1]]
    np.add.at(echo, np.searchsorted(starts, same, side="right") - 1, 1)

    letters = lower + upper + lead
    words = space + 1
    last = buffer[np.maximum(ends - 1, 0)]
    first = buffer[starts]
    x = np.stack(
        [
            np.log1p(size) / 5,
            upper / (letters + 1),
            digit / (size + 1),
            np.minimum(loud / words, 2),
            np.minimum(symbol / words, 4) / 2,
            np.minimum(bar / words, 1),
            np.minimum(stop / words, 1),
            np.minimum(size / words, 20) / 10,
            letters / (size + 1),
            again,
            echo / words,
            np.isin(last, np.frombuffer(b".?:;", np.uint8)) & (size > 0),
            (first >= 65) & (first <= 90) | (first == 0xC3),
            size == 0,
        ],
        axis=1,
    ).astype(np.float32)
    return x, size, firsts


def with_neighbours(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Features of each line, the line before, the line after, whether those exist, and a constant."""
    n = len(x)
    begins, stops = np.zeros(n, bool), np.zeros(n, bool)
    begins[firsts[:-1]] = True
    stops[firsts[1:] - 1] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1]
    after[:-1] = x[1:]
    before[begins] = 0
    after[stops] = 0
    return np.concatenate([x, before, after, begins[:, None], stops[:, None], np.ones((n, 1))], axis=1).astype(np.float32)


def marginals(score: np.ndarray, move: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains of two states (0 bad, 1 good).

    ``score``: the good state's log-odds per line; ``move``: 2 x 2 log transition scores. Returns
    P(good) per line, the summed probabilities of each transition, and the log partition function
    of all chains. Chains go in step, longest first, so each step is one array operation.
    """
    sizes = np.diff(firsts)
    order = np.argsort(-sizes, kind="stable")
    first, size = firsts[:-1][order], sizes[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    clipped = np.clip(score.astype(np.float64), -30, 30)
    e = np.stack([np.ones_like(clipped), np.exp(clipped)], axis=1)
    e /= (top := e.max(axis=1, keepdims=True))
    a = np.exp(move)
    alpha, scale = np.empty_like(e), np.empty(len(e))
    for t, n in enumerate(active):
        at = first[:n] + t
        v = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        s = v.sum(axis=1)
        alpha[at], scale[at] = v / s[:, None], s
    beta = np.ones_like(e)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        v = e[at] * beta[at] / scale[at, None]
        pairs += (alpha[at - 1].T @ v) * a
        beta[at - 1] = v @ a.T
    return np.clip(alpha[:, 1] * beta[:, 1], 0, 1), pairs, float(np.log(scale).sum() + np.log(top).sum())


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    curve: tuple[float, float]

    def line_scores(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return marginals(with_neighbours(x, firsts) @ self.weights, self.move, firsts)[0]

    def document_scores(self, texts: list[str | None]) -> np.ndarray:
        x, size, firsts = line_features(texts)
        return self.calibrated(_mean(self.line_scores(x, firsts), size, firsts))

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * share + b)))


def _mean(good: np.ndarray, size: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Means over each text's lines, weighted by their bytes (an empty line weighs as one byte)."""
    w = np.maximum(size, 1)
    return np.add.reduceat(good * w, firsts[:-1]) / np.add.reduceat(w, firsts[:-1])


def fit(x: np.ndarray, size: np.ndarray, firsts: np.ndarray, label: np.ndarray, prior: float, steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Fit to documents with labels 0 and 1. ``prior``: the share of label 1 among all labelled
    documents, which the sample may not have; the curve weighs documents by it."""
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(3 * x.shape[1] + 3, np.float32), np.zeros((2, 2)), (0.0, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (20.0 if prior >= 1 else -20.0)))
    # both labels weigh alike: documents of the rarer one are repeated
    ones, zeros = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    most = max(len(ones), len(zeros))
    picks = np.concatenate([np.resize(ones, most), np.resize(zeros, most)])
    lines = np.concatenate([np.arange(firsts[i], firsts[i + 1]) for i in picks])
    x, size, label, firsts = x[lines], size[lines], label[picks], np.cumsum(np.concatenate([[0], np.diff(firsts)[picks]]))
    full = with_neighbours(x, firsts).astype(np.float64)
    owner = np.repeat(np.arange(len(label)), np.diff(firsts))
    y = label[owner].astype(np.float64)
    begins = np.zeros(len(y), bool)
    begins[firsts[:-1]] = True
    w, move = np.zeros(full.shape[1]), np.zeros((2, 2))
    for _ in range(ROUNDS):
        m = [np.zeros_like(w), np.zeros_like(move)]
        v = [np.zeros_like(w), np.zeros_like(move)]
        inner = np.flatnonzero(~begins)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        for k in range(1, steps + 1):
            good, pairs, _ = marginals(full @ w, move, firsts)
            grads = (full.T @ (y - good) / len(y) - decay * w, (seen - pairs) / len(y) - decay * move)
            for i, (p, g) in enumerate(zip((w, move), grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
        # relabel by what the lines themselves show: transitions, learned from all-alike documents, kept out
        alone = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        y = np.where(label[owner] == 1, 1.0, (alone > 0.5).astype(float))
        worst = np.minimum.reduceat(alone, firsts[:-1])
        y[(alone == worst[owner]) & (label[owner] == 0)] = 0
    good = marginals(full @ w, move, firsts)[0]
    return Model(w.astype(np.float32), move, _curve(_mean(good, size, firsts), label, prior))


def _curve(share: np.ndarray, label: np.ndarray, prior: float, steps: int = 60) -> tuple[float, float]:
    """Logistic regression of the label on the share of good lines, by Newton steps."""
    x = np.stack([share, np.ones_like(share)], axis=1)
    weight = np.where(label == 1, prior / max(label.mean(), 1e-9), (1 - prior) / max(1 - label.mean(), 1e-9))
    p = np.zeros(2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        p = p + np.clip(np.linalg.solve(h, x.T @ (weight * (label - q)) - 1e-2 * p), -4, 4)
    return float(p[0]), float(p[1])


def is_held_out(doc_id="doc_id"):
    """Rows that no fit may see."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = FIT_LINES) -> Model:
    """Fit to up to ``sample`` labelled documents of each label, none of them held out, and up to
    ``lines`` lines of each. That bounds what reaches the driver, whatever the tables hold.

    Rows of ``labels`` without doc_id or with a quality other than 0 and 1 are left out; of
    several rows of one document the smallest label counts, and of several texts that with the
    smallest MD5. With labels of one kind only, or none, every score is that share of label 1 (a
    half if there are none).
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for q in (0, 1):
        part = known.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                x, size, firsts = line_features(batch.column(1).to_pylist())
                middle = [(a + max(0, (b - a - lines) // 2), min(b - a, lines)) for a, b in zip(firsts[:-1], firsts[1:])]
                rows = [(x[a : a + n].tobytes(), size[a : a + n].tobytes()) for a, n in middle]
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "quality", "x", "size"])

    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    rows = once.select("doc_id", "text", "quality").mapInArrow(described, "doc_id long, quality int, x binary, size binary").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows] or [np.zeros((0, N_FEATURES), np.float32)])
    size = np.concatenate([np.frombuffer(r["size"]) for r in rows] or [np.zeros(0)])
    firsts = np.cumsum([0] + [len(r["size"]) // 8 for r in rows])
    return fit(x, size, firsts, np.array([r["quality"] for r in rows], int), prior)


def score(docs: DataFrame, model: Model, name: str = "score", span: int = 1 << 18) -> DataFrame:
    """``docs`` with column ``name``, the probability that its quality is 1.

    A null or empty text is one empty line. Null doc_ids, repeated rows and all other columns are
    kept; a column of that name is replaced.
    """

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(text), 1000):
            texts, start, size = text.slice(at, 1000).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                if size and size + len(t or "") > span:
                    parts.append(model.document_scores(texts[start:i]))
                    start, size = i, 0
                size += len(t or "")
            parts.append(model.document_scores(texts[start:]))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    short_batches(docs.sparkSession)
    return docs.withColumn(name, scored(F.col("text").cast("string")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned without the held-out rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
