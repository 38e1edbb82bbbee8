"""Token-ID output: per-document zstandard frames with one shared dictionary.

A store is a folder with ``dictionary.zdict`` and shard files in ascending doc_id order. A shard:

    magic "TMTOK002", 32 bytes SHA-256 of the dictionary, then one zstandard frame per document
    index: int64 doc_id, uint64 offset and uint64 id count per document and one byte that is 1
    where it has a doc_id, one array after another
    trailer: uint64 index offset, uint64 documents, uint64 ids, uint32 bytes per id, magic

A reader seeks to one frame by the index and decompresses only that document. Null texts count as
empty and hold the end id alone; documents without doc_id come first. Repeated rows are separate
documents. An id that holds many rows, or many rows without one, fill several shards. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.token_ids import default_path, encoder, spans_of
from tidemark.llm.workspace import Workspace, atomic_output, cut_ranges, files_for, open_fs, partitions_for, range_of, short_batches, slices

MAGIC = b"TMTOK002"
TRAILER = struct.Struct("<QQQI8s")
END_ID = 0


def train_dictionary(docs: DataFrame, tokenizer_path: str, samples: int = 512, size: int = 64 * 1024) -> bytes:
    """A zstandard dictionary from the serialized ids of ``samples`` documents, those whose id has
    the smallest hashes. It only changes how well frames compress, never what they hold.

    The ids of long sample documents are cut into pieces of 1,024 ids, 2,048 pieces in all.
    """
    import zstandard

    text = F.xxhash64("text").alias("h")
    ids = docs.select("doc_id", text).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(samples)
    chosen = [tuple(r) for r in ids.collect()]
    picked = docs.select("doc_id", text, "text").where(F.col("doc_id").isin([c[0] for c in chosen]) & F.col("h").isin([c[1] for c in chosen])).dropDuplicates(["doc_id", "h"])

    def pieces(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [x[i : i + 1024 * enc.width.itemsize] for x in enc.encode(texts) for i in range(0, len(x), 1024 * enc.width.itemsize)]
            yield pa.record_batch([pa.array(found, pa.binary())], names=["piece"])

    made = picked.select("text").mapInArrow(pieces, "piece binary")
    found = sorted(bytes(r[0]) for r in made.orderBy(F.xxhash64("piece"), "piece").limit(2048).collect())
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return b"".join(found)[-size:]


def _dictionary(data: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind) if len(data) >= 8 else None


def write_store(docs: DataFrame, uri: str, tokenizer_path: str | None = None, level: int = 3) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write a store below ``uri``; returns its manifest:
    path, shard, n_docs, n_tokens, dictionary_sha256, one row per shard file."""
    tokenizer_path = tokenizer_path or default_path()
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained = train_dictionary(docs, tokenizer_path)
    with atomic_output(f"{uri}/dictionary.zdict") as f:
        f.write(trained)
    shards = partitions_for(docs)
    sharded = docs.select("doc_id", "text", range_of(cut_ranges(docs, "doc_id", shards), "doc_id", F.xxhash64("text")).alias("shard"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer_path)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained), write_checksum=False).compress
        end = np.array([END_ID], enc.width).tobytes()
        for batch in slices(batches):
            every = [t or "" for t in batch.column(1).to_pylist()]
            for span in spans_of(every):
                ids, _, shard = batch.slice(span.start, span.stop - span.start).columns
                arrays = [x + end for x in enc.encode(every[span])]
                yield pa.record_batch(
                    [shard, ids, pa.array([len(x) // enc.width.itemsize for x in arrays], pa.int64()), pa.array([squeeze(x) for x in arrays], pa.binary())],
                    names=["shard", "doc_id", "n_tokens", "frame"],
                )

    def shard_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer_path).width.itemsize
        for shard, rows in _runs(batches):
            # an attempt has a name of its own; only the names that reach the manifest are ever read
            path = f"{uri}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
            n, total = _write_shard(path, rows, hashlib.sha256(trained).digest(), width)
            yield pa.record_batch([[path], pa.array([shard], pa.int32()), [n], [total], [hashlib.sha256(trained).hexdigest()]], names=["path", "shard", "n_docs", "n_tokens", "dictionary_sha256"])

    made = sharded.mapInArrow(frames, "shard int, doc_id long, n_tokens long, frame binary")
    return (
        made.repartition(shards, "shard")
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
        .mapInArrow(shard_files, "path string, shard int, n_docs long, n_tokens long, dictionary_sha256 string")
    )


def _runs(batches: Iterator[pa.RecordBatch]):
    """(shard, iterator of its batches) for batches sorted by shard; each iterator is read whole."""
    batches = iter(batches)
    waiting: list[pa.RecordBatch] = []

    def pull() -> bool:
        while not waiting:
            batch = next(batches, None)
            if batch is None:
                return False
            if batch.num_rows:
                waiting.append(batch)
        return True

    while pull():
        shard = waiting[0].column(0)[0].as_py()

        def rows(shard=shard):
            while pull():
                batch = waiting.pop()
                n = int(np.searchsorted(batch.column(0).to_numpy(), shard, side="right"))
                if n < batch.num_rows:
                    waiting.append(batch.slice(n))
                if n:
                    yield batch.slice(0, n)
                if n < batch.num_rows:
                    return

        yield shard, rows()


def _write_shard(path: str, batches, dictionary_hash: bytes, width: int) -> tuple[int, int]:
    ids, there, sizes, counts = [], [], [], []
    with atomic_output(path) as out:
        out.write(MAGIC + dictionary_hash)
        for batch in batches:
            frames = batch.column(3).to_pylist()
            out.write(b"".join(frames))
            ids.append(batch.column(1).fill_null(0).to_numpy())
            there.append(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            sizes.append(np.fromiter(map(len, frames), np.uint64, len(frames)))
            counts.append(batch.column(2).to_numpy().astype(np.uint64))
        ids, there, sizes, counts = (np.concatenate(x) for x in (ids, there, sizes, counts))
        first = len(MAGIC) + len(dictionary_hash)
        offsets = np.cumsum(np.concatenate([[np.uint64(first)], sizes])).astype("<u8")
        out.write(ids.astype("<i8").tobytes() + offsets[:-1].tobytes() + counts.astype("<u8").tobytes() + there.astype("u1").tobytes())
        out.write(TRAILER.pack(int(offsets[-1]), len(ids), int(counts.sum()), width, MAGIC))
    return len(ids), int(counts.sum())


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, path: str):
        filesystem, local = open_fs(path)
        self.file = filesystem.open_input_file(local)
        size = self.file.size()
        self.index_at, self.n, self.n_tokens, width, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        index = self.file.read_at(25 * self.n, self.index_at)
        self.doc_ids, self.offsets, self.counts = (np.frombuffer(index, t, self.n, i * 8 * self.n) for i, t in enumerate(("<i8", "<u8", "<u8")))
        self.has_id = np.frombuffer(index, "u1", self.n, 24 * self.n) == 1
        self.width = np.dtype(f"<u{width}")
        store = path.rsplit("/", 1)[0]
        fs2, local2 = open_fs(f"{store}/dictionary.zdict")
        with fs2.open_input_file(local2) as f:
            trained = f.read()
        if hashlib.sha256(trained).digest() != head[len(MAGIC) :]:
            raise ValueError(f"{path} was written with another dictionary")
        import zstandard

        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(trained)).decompress

    def ids(self, first: int, stop: int) -> list[np.ndarray]:
        """Id arrays of documents first..stop-1 by place, fetched with one range read."""
        ends = np.append(self.offsets, np.uint64(self.index_at))
        at = int(ends[first])
        data = memoryview(self.file.read_at(int(ends[stop]) - at, at))
        return [np.frombuffer(self.expand(data[int(ends[i]) - at : int(ends[i + 1]) - at]), self.width) for i in range(first, stop)]


def read_store(spark: SparkSession, manifest: DataFrame, read_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files alone.

    ``start`` adds the ids of earlier shards, from the manifest (one row per file), to those of
    earlier documents in the shard.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                starts = base + np.cumsum(shard.counts.astype(np.int64)) - shard.counts.astype(np.int64)
                first = 0
                while first < shard.n:
                    stop = int(np.searchsorted(shard.offsets, int(shard.offsets[first]) + read_bytes))
                    stop = min(max(stop, first + 1), first + 8192, shard.n)
                    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in shard.ids(first, stop)]
                    ids = pa.array(shard.doc_ids[first:stop], pa.int64(), mask=~shard.has_id[first:stop])
                    yield pa.record_batch(
                        [ids, pa.array(starts[first:stop]), pa.array(shard.counts[first:stop].astype(np.int64)), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    first = stop
                shard.file.close()

    return files.repartition(max(files.count(), 1)).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to a token store and read back from its files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ws = Workspace(spark, "op5", files_for(docs))
    manifest = ws.stage(write_store(docs, ws.mkdirs("store")), "manifest")
    return read_store(spark, manifest).coalesce(files_for(docs))
