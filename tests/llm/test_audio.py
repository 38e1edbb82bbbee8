import cmath
import hashlib
import io
import math
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import audio
from tidemark.llm.audio import Settings
from tidemark.llm.workspace import Workspace, open_fs


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wav_is_lossless_and_readable(n):
    data = audio.padded(bytes(i % 256 for i in range(n)))
    assert len(data) % 64 == 0 and len(data) >= max(64, n)
    media = audio.wav(data, 16_000)
    assert audio.samples_of(media) == (16_000, data)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getframerate(), w.getsampwidth(), w.readframes(w.getnframes())) == (16_000, 1, data)


@pytest.mark.parametrize("rate,target", [(16_000, 10_000), (8_000, 16_000), (16_000, 16_000), (16_000, 8_000), (44_100, 16_000)])
def test_resampling_keeps_a_tone(rate, target):
    t = np.arange(rate) / rate
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), rate, target, 32)
    assert len(y) == target
    want = np.sin(2 * np.pi * 440 * np.arange(target) / target)
    best = max(np.corrcoef(y[200:-200], np.roll(want, k)[200:-200])[0, 1] for k in range(-3, 4))
    assert best > 0.98
    assert abs(np.abs(y[200:-200]).max() - 1) < 0.05


def test_mel_peak_follows_the_tone():
    s = Settings()
    peaks = []
    for f in (200, 800, 3000):
        mel, _ = audio.log_mel(np.sin(2 * np.pi * f * np.arange(5000) / s.target).astype(np.float32), s)
        peaks.append(int(mel.mean(axis=0).argmax()))
    assert peaks == sorted(set(peaks))


def test_hysteresis_segments():
    e = np.array([0, 0, 9, 5, 9, 0, 0, 5, 0, 9, 9], float)
    assert audio.segments(e, 0.5, -0.5) == [(2, 5), (9, 11)]
    assert audio.segments(np.zeros(4), 0.5, -0.5) == [(0, 4)]


def told(spark, docs):
    ws = Workspace(spark, "test")
    media = ws.stage(audio.store(docs), "media")
    return audio.read_tensors(ws.stage(audio.write_tensors(media, ws.mkdirs("tensors")), "manifest")).collect()


def test_rows(spark, odd_docs, no_docs):
    rows = told(spark, odd_docs)
    texts = sorted((r["text"] or "" for r in odd_docs.collect()))
    assert sorted(r["payload_sha256"] for r in rows) == sorted(hashlib.sha256(audio.padded(t.encode())).hexdigest() for t in texts)
    by = {}
    for r in rows:
        assert by.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    for r in odd_docs.collect():
        p = audio.padded((r["text"] or "").encode())
        mine = [x for x in rows if x["doc_id"] == r["doc_id"]]
        assert all((x["n_bytes"], x["payload_bytes"], x["tail_crc32"]) == (len((r["text"] or "").encode()), len(p), zlib.crc32(p[-64:])) for x in mine)
        assert all(x["media_sha256"] == hashlib.sha256(audio.wav(p, 16_000)).hexdigest() for x in mine)
    assert told(spark, no_docs) == []


def test_tensor_files(spark, odd_docs):
    ws = Workspace(spark, "test")
    files = audio.write_tensors(audio.store(odd_docs), ws.mkdirs("tensors")).collect()
    total = documents = 0
    for path, n in files:
        fs, local = open_fs(path)
        table = pa.ipc.open_file(fs.open_input_file(local)).read_all()
        assert table.num_rows == n
        assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (4, 24))
        assert all(0 < b - a <= 0.176 for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist()))
        assert [d is not None for d in table["document"].to_pylist()] == table["first"].to_pylist()
        documents += sum(table["first"].to_pylist())
        total += n
    assert documents == odd_docs.count() and total > documents + 100  # a long text has many windows


def plainly(text, s=Settings()):
    """Windows and tensors of a text from the definitions, number by number."""
    data = (text or "").encode()
    data += bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    x = [(b - 128) / 128 for b in data]
    up, down = 5, 8
    n = s.taps * up
    h = [(math.sin(math.pi * t / down) / (math.pi * t / down) if t else 1.0) * (0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1))) for i, t in ((i, i - (n - 1) / 2) for i in range(n))]
    y = []
    for k in range(-(-len(x) * up // down)):
        first, phase = divmod(k * down, up)
        branch = h[up - 1 - phase :: up]
        y.append(sum(w * (x[j] if 0 <= (j := first - (s.taps // 2 - 1) + i) < len(x) else 0.0) for i, w in enumerate(branch)) / sum(branch))
    frames = max(1, 1 + (len(y) - s.frame) // s.hop)
    y += [0.0] * ((frames - 1) * s.hop + s.frame - len(y))
    mel_of = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel_of(s.target / 2) * i / (s.mels + 1) / 2595) - 1) for i in range(s.mels + 2)]
    energy, mel = [], []
    for f in range(frames):
        w = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / (s.frame - 1))) for i, v in enumerate(y[f * s.hop : f * s.hop + s.frame])]
        energy.append(math.log(sum(v * v for v in w) + 1e-6))
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / s.fft) for i, v in enumerate(w))) ** 2 for k in range(s.fft // 2 + 1)]
        hz = [k * s.target / s.fft for k in range(s.fft // 2 + 1)]
        mel.append([math.log(sum(p * max(0.0, min((z - a) / (b - a), (c - z) / (c - b))) for p, z in zip(power, hz)) + 1e-6) for a, b, c in zip(edges, edges[1:], edges[2:])])
    mean = sum(energy) / frames
    deviation = math.sqrt(sum((e - mean) ** 2 for e in energy) / frames)
    found, start = [], None
    for f, e in enumerate(energy):
        if start is None and e > mean + s.rise * deviation:
            start = f
        elif start is not None and e < mean + s.fall * deviation:
            found.append((start, f))
            start = f if e > mean + s.rise * deviation else None
    found += [(start, frames)] if start is not None else []
    spans, tensors = [], []
    for a, b in found or [(0, frames)]:
        n = -(-(b - a) // s.window)
        for i in range(n):
            lo, hi = a + (b - a) * i // n, a + (b - a) * (i + 1) // n
            spans.append((lo * s.hop / s.target, ((hi - 1) * s.hop + s.frame) / s.target))
            parts = [(lo + (hi - lo) * k // s.slices, max(lo + (hi - lo) * (k + 1) // s.slices, lo + (hi - lo) * k // s.slices + 1)) for k in range(s.slices)]
            tensors.append([[sum(mel[f][m] for f in range(p, q)) / (q - p) for m in range(s.mels)] for p, q in parts])
    return spans, tensors


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in audio.op9_audio_features(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for d, t in docs.items():
        spans, tensors = audio.features(audio.wav(audio.padded((t or "").encode()), 16_000), Settings())
        assert rows[d]["feature"] == audio.feature(spans, tensors)
    for d in sorted(docs, key=lambda d: len(docs[d] or ""))[:160:16]:
        want_spans, want = plainly(docs[d])
        spans, tensors = audio.features(audio.wav(audio.padded((docs[d] or "").encode()), 16_000), Settings())
        assert np.allclose(spans, want_spans) and tensors.shape == np.shape(want)
        assert np.abs(tensors - np.array(want)).max() < 0.02
        bands = [int(v) for v in rows[d]["feature"].split(";")[1].split(",")]
        assert np.abs(np.array(bands) - 100 * np.array(want).mean(axis=(0, 1))).max() < 2
