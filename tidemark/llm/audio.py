"""Audio media columns: lossless WAV storage, log-mel features and energy segments.

Media are stored as WAV files in a binary column (8-bit unsigned mono PCM). Features come from the
stored bytes: a polyphase resampler, overlapped log-mel frames, and segments between a rise of the
frame energy over a high threshold and its fall under a low one. Each segment is cut into as many
windows as its length asks for, and each window becomes one tensor of fixed shape (slices x mels)
with its time span. ``write_tensors`` stores them as Arrow files whose column has the fixed-shape
tensor type; ``read_tensors`` derives everything it tells of a document from those files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, atomic_output, files_for, open_fs, short_batches, slices

_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000  # of the stored samples
    target: int = 10_000  # after resampling
    taps: int = 16  # of each polyphase branch
    frame: int = 250  # samples, 25 ms
    hop: int = 100  # samples, 10 ms
    fft: int = 256
    mels: int = 24
    slices: int = 4  # of a window's tensor
    window: int = 16  # frames of a window at most
    rise: float = 0.5  # thresholds in standard deviations around the mean log energy
    fall: float = -0.5


def wav(samples: bytes, rate: int) -> bytes:
    """A WAV file of 8-bit unsigned mono samples."""
    odd = len(samples) & 1
    return _HEADER.pack(b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * odd


def samples_of(media: bytes) -> tuple[int, bytes]:
    """The rate and samples of a stored WAV file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(payload: bytes, block: int = 64) -> bytes:
    """``payload`` and zero bytes up to a positive multiple of ``block``."""
    return payload + b"\0" * (max(1, -(-len(payload) // block)) * block - len(payload))


@lru_cache(maxsize=8)
def _branches(rate: int, target: int, taps: int) -> tuple[int, int, np.ndarray]:
    """up, down and a matrix that maps an input window to the ``up`` outputs it yields."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / up, 1 / down)
    h = np.sinc(t * cut) * np.hamming(n) * cut * up
    width = taps + ((up - 1) * down) // up
    m = np.zeros((width, up))
    for p in range(up):
        first, phase = divmod(p * down, up)
        # output p of a block: inputs first .. first+taps-1 under the branch of its phase
        m[first : first + taps, p] = h[(up - 1 - phase) :: up][:taps] if up > 1 else h
    m /= m.sum(axis=0, keepdims=True)
    return up, down, m.astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int, taps: int) -> np.ndarray:
    """Polyphase resampling: every block of ``down`` samples and its neighbours give ``up`` outputs."""
    up, down, m = _branches(rate, target, taps)
    blocks = -(-len(x) // down)
    before = taps // 2 - 1
    wide = np.zeros(before + blocks * down + m.shape[0], np.float32)
    wide[before : before + len(x)] = x
    windows = np.lib.stride_tricks.as_strided(wide, (blocks, m.shape[0]), (4 * down, 4))
    out = np.ascontiguousarray(windows) @ m
    return out.reshape(-1)[: -(-len(x) * up // down)]


@lru_cache(maxsize=8)
def _mel(fft: int, rate: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, one column each."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames x mels) and the log energy of each; a short signal gives one frame."""
    n = max(1, 1 + (len(y) - s.frame) // s.hop) if len(y) else 1
    need = (n - 1) * s.hop + s.frame
    if len(y) < need:
        y = np.concatenate([y, np.zeros(need - len(y), np.float32)])
    y = np.ascontiguousarray(y, np.float32)
    frames = np.lib.stride_tricks.as_strided(y, (n, s.frame), (4 * s.hop, 4)) * np.hanning(s.frame).astype(np.float32)
    energy = np.log(np.einsum("ij,ij->i", frames, frames) + np.float32(1e-6))
    spectrum = np.fft.rfft(frames, s.fft)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log(power @ _mel(s.fft, s.target, s.mels) + np.float32(1e-6)), energy


def segments(energy: np.ndarray, rise: float, fall: float) -> list[tuple[int, int]]:
    """Frame ranges from a rise over mean + rise * deviation to the fall under mean + fall *
    deviation. A signal that never rises is one whole segment."""
    mean, deviation = float(energy.mean()), float(energy.std())
    high, low = energy > mean + rise * deviation, energy < mean + fall * deviation
    found, at = [], 0
    ups, downs = np.flatnonzero(high), np.flatnonzero(low)
    while True:
        i = np.searchsorted(ups, at)
        if i == len(ups):
            break
        start = int(ups[i])
        j = np.searchsorted(downs, start)
        at = int(downs[j]) if j < len(downs) else len(energy)
        found.append((start, at))
    return found or [(0, len(energy))]


def windows(found: list[tuple[int, int]], s: Settings) -> np.ndarray:
    """Frame ranges (windows x 2): each segment cut evenly into windows of at most ``window`` frames."""
    out = []
    for a, b in found:
        n = -(-(b - a) // s.window)
        edges = a + (b - a) * np.arange(n + 1) // n
        out.append(np.stack([edges[:-1], edges[1:]], axis=1))
    return np.concatenate(out)


def features(media: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Time spans in seconds (windows x 2) and tensors (windows x slices x mels): the mean log-mel
    frame of each slice, in hundredths."""
    rate, samples = samples_of(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    mel, energy = log_mel(resample(x, rate, s.target, s.taps), s)
    cut = windows(segments(energy, s.rise, s.fall), s)
    sums = np.concatenate([np.zeros((1, s.mels)), np.cumsum(mel, axis=0, dtype=np.float64)])
    edges = cut[:, :1] + (cut[:, 1:] - cut[:, :1]) * np.arange(s.slices + 1) // s.slices
    stops = np.maximum(edges[:, 1:], edges[:, :-1] + 1)  # a slice has one frame at least
    tensors = ((sums[stops] - sums[edges[:, :-1]]) / (stops - edges[:, :-1])[..., None]).astype(np.float32)
    spans = np.stack([cut[:, 0] * s.hop / s.target, ((cut[:, 1] - 1) * s.hop + s.frame) / s.target], axis=1)
    return spans, np.round(tensors, 2) + np.float32(0)


def store(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, media: texts as UTF-8 bytes, padded to a positive multiple of 64 and stored
    as WAV. A null text is empty. Null doc_ids and repeated rows stay; other columns are ignored."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [(t or "").encode() for t in batch.column(1).to_pylist()], batch.column(0)
            for part in _parts(texts):
                yield pa.record_batch(
                    [ids.slice(part.start, part.stop - part.start), pa.array([len(t) for t in texts[part]], pa.int64()), pa.array([wav(padded(t), s.rate) for t in texts[part]], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def _parts(texts: list[bytes], most: int = 8 << 20) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


#: What a tensor file and ``read_tensors`` tell of each document.
DOCUMENT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]


def tensor_schema(s: Settings) -> pa.Schema:
    """One row for each window; a document's own columns are in its first row only."""
    return pa.schema([("first", pa.bool_()), ("document", pa.struct(DOCUMENT)), ("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", pa.fixed_shape_tensor(pa.float32(), (s.slices, s.mels)))])


def write_tensors(media: DataFrame, uri: str, s: Settings = Settings()) -> DataFrame:
    """Arrow files below ``uri`` with the time span and the tensor (fixed shape slices x mels) of
    every window of ``media`` (doc_id, n_bytes, media), document after document; returns path and
    n_rows, one row a task. Only listed files are whole and current."""
    schema = tensor_schema(s)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, n = f"{uri}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow", 0
        with atomic_output(path) as stream, pa.ipc.new_file(stream, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in slices(batches, 500):
                documents, spans, tensors = [], [], []
                for doc_id, size, m in zip(*(c.to_pylist() for c in batch.columns)):
                    _, payload = samples_of(m)
                    documents.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest()))
                    for made, parts in zip(features(m, s), (spans, tensors)):
                        parts.append(made)
                if documents:
                    out.write_batch(_rows(documents, spans, tensors, schema))
                    n += sum(map(len, spans))
        yield pa.record_batch([[path], [n]], names=["path", "n_rows"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(written, "path string, n_rows long")


def _rows(documents: list[tuple], spans: list[np.ndarray], tensors: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in spans])
    first = np.zeros(sizes.sum(), bool)
    first[np.cumsum(sizes) - sizes] = True
    columns = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*documents), DOCUMENT)], names=[name for name, _ in DOCUMENT])
    place = pa.array(np.cumsum(first) - 1, mask=~first)  # null in later rows
    span = np.concatenate(spans)
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(np.concatenate(tensors)))
    return pa.record_batch([pa.array(first), columns.take(place), pa.array(span[:, 0]), pa.array(span[:, 1]), tensor], schema=schema)


def read_tensors(manifest: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and
    feature of every document, from the tensor files (path) alone. feature: the number of windows,
    the mean of each mel band over all of them in hundredths, and a digest of all time spans and
    tensors."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, local = open_fs(path)
                with filesystem.open_input_file(local) as stream:
                    reader = pa.ipc.open_file(stream)
                    for i in range(reader.num_record_batches):
                        rows = reader.get_batch(i)
                        yield _told(rows)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    short_batches(manifest.sparkSession)
    return manifest.select("path").repartition(max(manifest.count(), 1)).mapInArrow(told, ", ".join(f"{name} {kinds[k]}" for name, k in DOCUMENT) + ", feature string")


def _told(rows: pa.RecordBatch) -> pa.RecordBatch:
    at = np.flatnonzero(rows.column("first").to_numpy(zero_copy_only=False))
    ends = np.append(at[1:], rows.num_rows)
    spans = np.stack([rows.column("start_s").to_numpy(), rows.column("end_s").to_numpy()], axis=1)
    tensors = rows.column("tensor").to_numpy_ndarray()
    said = [feature(spans[a:b], tensors[a:b]) for a, b in zip(at, ends)]
    documents = rows.column("document").take(pa.array(at))
    return pa.record_batch([*documents.flatten(), pa.array(said)], names=[*(name for name, _ in DOCUMENT), "feature"])


def feature(spans: np.ndarray, tensors: np.ndarray) -> str:
    digest = hashlib.sha256(spans.tobytes() + tensors.tobytes()).hexdigest()
    bands = ",".join(map(str, np.round(tensors.mean(axis=(0, 1), dtype=np.float64) * 100).astype(int).tolist()))
    return f"{len(spans)};{bands};{digest}"


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as audio, its tensors stored from the media read back, and told from
    the tensors read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "op9", files_for(docs))
    media = ws.stage(store(docs), "media")
    return read_tensors(ws.stage(write_tensors(media, ws.mkdirs("tensors")), "manifest")).coalesce(files_for(docs))
