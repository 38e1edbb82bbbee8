"""WARC archives inside ZIP packages: a writer and a reader that never extracts.

A package holds ``archive/data.warc.gz``, one gzip member per WARC record, and
``indexes/index.cdx``, one tab-separated line per record: page_id ("-" if null), WARC type, offset
and length within the archive member, and target address. Both are ZIP members with method 0
(stored), so any record is a byte range of the package. Sizes or offsets of 4 GiB and more, and
more than 65,534 members, are told by ZIP64 fields.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, atomic_output, files_for, open_fs, partitions_for, slices

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads of fewer bytes are always whole responses.
LEAST_REVISIT = 100
_LOCAL = struct.Struct("<4s5H3I2H")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_END = struct.Struct("<4s4H2IH")
_END64 = struct.Struct("<4sQ2H2I4Q")
_LOCATOR = struct.Struct("<4sIQI")
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


class ZipWriter:
    """Stored members, written in one pass to a stream that can't seek."""

    def __init__(self, stream, limit: int = _MAX32):
        self.stream, self.at, self.members, self.limit = stream, 0, [], limit

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        # sizes and checksum follow the data: flag bit 3, with a ZIP64 field so that they have 8 bytes
        raw = name.encode()
        self.current = [raw, self.at, 0, 0]
        extra = struct.pack("<2H2Q", 1, 16, 0, 0)
        self._put(_LOCAL.pack(b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """The offset of ``data`` within the open member."""
        at = self.current[2]
        self.current[2] += len(data)
        self.current[3] = zlib.crc32(data, self.current[3])
        self._put(data)
        return at

    def close_member(self) -> None:
        _, _, size, crc = self.current
        self._put(struct.pack("<4sI2Q", b"PK\7\10", crc, size, size))
        self.members.append(tuple(self.current))

    def finish(self) -> None:
        start = self.at
        for raw, offset, size, crc in self.members:
            wide = [x for x in (size, size, offset) if x >= self.limit]
            extra = struct.pack(f"<2H{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            short = [x if x < self.limit else _MAX32 for x in (size, offset)]
            self._put(_CENTRAL.pack(b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, short[0], short[0], len(raw), len(extra), 0, 0, 0, 0, short[1]) + raw + extra)
        size, n = self.at - start, len(self.members)
        if max(size, start) >= self.limit or n >= _MAX16:
            end = self.at
            self._put(_END64.pack(b"PK\6\6", _END64.size - 12, 45, 45, 0, 0, n, n, size, start))
            self._put(_LOCATOR.pack(b"PK\6\7", 0, end, 1))
            size, start, n = _MAX32, _MAX32, min(n, _MAX16)
        self._put(_END.pack(b"PK\5\6", 0, 0, n, n, size, start, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    crc: int
    start: int


class ZipReader:
    """Members of a ZIP file by its central directory, each readable by ranges."""

    def __init__(self, file):
        self.file, total = file, file.size()
        tail_at = max(0, total - _END.size - 0xFFFF - _LOCATOR.size)
        tail = file.read_at(total - tail_at, tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and (len(tail) < at + _END.size or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut off")
        _, _, _, _, n, size, start, _ = _END.unpack_from(tail, at)
        if at >= _LOCATOR.size and tail[at - _LOCATOR.size : at - _LOCATOR.size + 4] == b"PK\6\7":
            where = _LOCATOR.unpack_from(tail, at - _LOCATOR.size)[2]
            magic, *_, n, size, start = _END64.unpack(file.read_at(_END64.size, where))
            if magic != b"PK\6\6":
                raise ValueError("the ZIP64 locator points at no ZIP64 directory")
        directory, at = file.read_at(size, start), 0
        self.members: dict[str, Member] = {}
        for _ in range(n):
            magic, _, _, flags, method, _, _, crc, packed, plain, names, extras, comment, _, _, _, offset = _CENTRAL.unpack_from(directory, at)
            if magic != b"PK\1\2":
                raise ValueError("damaged central directory")
            name = directory[at + _CENTRAL.size :][:names].decode("utf-8" if flags & 0x800 else "cp437")
            plain, packed, offset = _wide(directory[at + _CENTRAL.size + names :][:extras], plain, packed, offset)
            self.members[name] = Member(name, method, plain, crc, offset)
            at += _CENTRAL.size + names + extras + comment

    def locate(self, name: str) -> tuple[int, int]:
        """The range (offset, size) of a stored member's bytes within the file."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed and can't be read by ranges")
        head = _LOCAL.unpack(self.file.read_at(_LOCAL.size, m.start))
        if head[0] != b"PK\3\4":
            raise ValueError(f"no local header where the directory puts {name}")
        return m.start + _LOCAL.size + head[9] + head[10], m.size

    def read(self, name: str) -> bytes:
        at, size = self.locate(name)
        data = self.file.read_at(size, at)
        if zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"{name} is damaged")
        return data


def _wide(extra: bytes, plain: int, packed: int, offset: int) -> tuple[int, int, int]:
    values, at = [plain, packed, offset], 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(values):
                if v == _MAX32:
                    values[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + size
    return tuple(values)


def record_id(kind: str, page_id: int | None, url: str | None, digest: str) -> str:
    """One identifier for equal records; a revisit of a page can name the page's record by it."""
    return f"<urn:uuid:{uuid.UUID(hex=hashlib.md5(f'{page_id}|{url}|{kind}|{digest}'.encode()).hexdigest())}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC 1.1 record. A revisit has no payload and names the page it refers to."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(kind, page_id, url, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if _one_line(url) != url:  # an address that a line of a head can't hold, or none
        fields.append(("X-Target-URI-JSON", json.dumps(url)))
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id("response", refers_to, refers_url, digest)),
            ("WARC-Refers-To-Target-URI", _one_line(refers_url)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    """``url`` with control characters as percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "").replace("\x85", "%C2%85").replace("\u2028", "%E2%80%A8").replace("\u2029", "%E2%80%A9")


def address_of(fields: dict[str, str]) -> str | None:
    """The address that a record was written for."""
    return json.loads(fields["X-Target-URI-JSON"]) if "X-Target-URI-JSON" in fields else fields["WARC-Target-URI"]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to, refers_url of the pages (page_id, url, html) whose payload an
    earlier page_id has, one row for each page_id and payload."""
    payload = F.coalesce("html", F.lit(""))
    seen = pages.where("page_id is not null").select("page_id", "url", F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest")).where(f"n >= {LEAST_REVISIT}")
    firsts = seen.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).where("last > first.page_id")
    again = seen.select("page_id", "digest").join(firsts, "digest").where("page_id <> first.page_id")
    return again.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).dropDuplicates(["page_id", "digest"])


def write_packages(pages: DataFrame, uri: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages below ``uri``; returns path and n_records.

    Of pages with equal payloads of at least 100 bytes the smallest page_id is a response and the
    others are revisits; a page_id with several payloads is judged by each. Every row becomes one
    record. A null html is an empty payload. A page without page_id is always a response; repeated
    rows of the smallest page_id too.
    """
    n = partitions_for(pages)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # dealt by id and payload: neither a repeated id nor pages without one meet in one task
    whole = pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256)).repartition(n, "page_id", "digest")
    dealt = whole.join(revisits(pages).hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to", "refers_url")

    def packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # an attempt has a name of its own; only the names that reach the manifest are ever read
        path, lines = f"{uri}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip", []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with atomic_output(path) as stream:
            out = ZipWriter(stream)
            out.open(ARCHIVE)
            for batch in slices(_chain(first, batches)):
                for page_id, url, html, digest, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    kind = "response" if refers is None else "revisit"
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(kind, page_id, url, payload, digest, refers, refers_url)
                    data = squeeze.compress(raw) + squeeze.flush()
                    lines.append(f"{'-' if page_id is None else page_id}\t{kind}\t{out.write(data)}\t{len(data)}\t{_one_line(url)}\n")
            out.close_member()
            out.open(INDEX)
            out.write("".join(lines).encode())
            out.close_member()
            out.finish()
        yield pa.record_batch([[path], [len(lines)]], names=["path", "n_records"])

    return dealt.mapInArrow(packages, "path string, n_records long")


def _chain(first, rest):
    yield first
    yield from rest


class Package:
    """Random access to the records of one package."""

    def __init__(self, path: str):
        filesystem, local = open_fs(path)
        self.file = filesystem.open_input_file(local)
        self.zip = ZipReader(self.file)
        self.base, self.size = self.zip.locate(ARCHIVE)
        self.index = [(p, k, int(a), int(n), u) for p, k, a, n, u in (x.split("\t") for x in self.zip.read(INDEX).decode().split("\n") if x)]

    def records(self, entries, most: int = 8 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records of index entries, in order; neighbours share a range read of up to ``most`` bytes."""
        run: list = []
        for e in entries:
            if run and (e[2] != run[-1][2] + run[-1][3] or e[2] + e[3] - run[0][2] > most):
                yield from self._range(run)
                run = []
            run.append(e)
        if run:
            yield from self._range(run)

    def _range(self, run) -> Iterator[tuple[dict[str, str], bytes]]:
        first = run[0][2]
        data = memoryview(self.file.read_at(run[-1][2] + run[-1][3] - first, self.base + first))
        for _, _, at, n, _ in run:
            yield parse(zlib.decompress(data[at - first : at - first + n], 31))


def read_packages(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest of every record, as the
    records tell (a revisit's payload length and digest are those of what it refers to), and the
    payload where the record has one. A response's payload is checked against its digest."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                package, rows, size = Package(path), [], 0
                for fields, payload in package.records(package.index):
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, address_of(fields), kind, None if refers is None else int(refers), int(fields["X-Payload-Length"]), digest, payload if with_payload and kind == "response" else None))
                    size += len(payload)
                    if size > 8 << 20 or len(rows) == 4096:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)
                package.file.close()

    return manifest.select("path").repartition(max(manifest.count(), 1)).mapInArrow(records, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def op4_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC packages and read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    ws = Workspace(spark, "op4", files_for(pages))
    manifest = ws.stage(write_packages(pages, ws.mkdirs("packages")), "manifest")
    rows = read_packages(spark, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return rows.coalesce(files_for(pages))


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
             min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
