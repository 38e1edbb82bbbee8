import hashlib
import io
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from tidemark.llm import warc
from tidemark.llm.workspace import Workspace


def package(path, members, limit=0xFFFFFFFF):
    with open(path, "wb") as f:
        z = warc.ZipWriter(f, limit)
        for name, data in members:
            z.open(name)
            for at in range(0, len(data), 7):
                z.write(data[at : at + 7])
            z.close_member()
        z.finish()
    return pafs.LocalFileSystem().open_input_file(str(path))


@pytest.mark.parametrize("limit", [0xFFFFFFFF, 10])
def test_zip_round_trip_and_zip64(tmp_path, limit):
    members = [("a/b.gz", bytes(range(256)) * 3), ("é.txt", b""), ("c", b"PK\5\6 not the end")]
    file = package(tmp_path / "x.zip", members, limit)
    z = warc.ZipReader(file)
    assert {n: z.read(n) for n in z.members} == dict(members)
    with zipfile.ZipFile(tmp_path / "x.zip") as other:
        assert {n: other.read(n) for n in other.namelist()} == dict(members)


def test_many_members_need_zip64(tmp_path):
    file = package(tmp_path / "x.zip", [(str(i), b"x") for i in range(66_000)])
    z = warc.ZipReader(file)
    assert len(z.members) == 66_000 and z.read("65999") == b"x"


def test_reads_what_others_write(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as f:
        f.writestr("stored", b"hello")
        f.writestr("packed", b"hello" * 50, zipfile.ZIP_DEFLATED)
        f.comment = b"a comment"
    z = warc.ZipReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.zip")))
    assert z.read("stored") == b"hello"
    with pytest.raises(ValueError):
        z.read("packed")


def test_refuses_a_cut_off_file(tmp_path):
    (tmp_path / "x.zip").write_bytes(b"PK\3\4 something")
    with pytest.raises(ValueError):
        warc.ZipReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.zip")))


def read(spark, pages):
    ws = Workspace(spark, "test")
    manifest = ws.stage(warc.write_packages(pages, ws.mkdirs("p")), "manifest")
    return manifest, warc.read_packages(spark, manifest)


def test_pages_round_trip(spark):
    same, short = "é" * 60, "tiny"
    rows = [(1, "http://a/\n", same), (0, "u", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", short), (6, "u", short), (7, "v", same + "x"), (7, "v", same + "x"), (None, "w", same), (8, "u", "z" * 3_000_000), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9)]
    manifest, out = read(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {}
    for r in out.collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for page_id, _, html in rows:
        data = (html or "").encode()
        for r in got[page_id]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
            assert r["refers_to"] == (0 if page_id in (1, 2) else None)
            assert r["record_type"] == ("revisit" if page_id in (1, 2) else "response")
            assert r["payload"] == (None if page_id in (1, 2) else data)
    assert sorted(r["url"] or "" for rs in got.values() for r in rs) == sorted(u or "" for _, u, _ in rows)
    assert got[2][0]["url"] is None and got[1][0]["url"] == "http://a/\n"
    path = manifest.first()["path"]
    p = warc.Package(path)
    for entry in p.index:  # each record alone
        fields, _ = next(p.records([entry]))
        assert fields["X-Page-ID"] == entry[0].replace("-", "")


def test_an_id_with_several_payloads_keeps_each(spark):
    x, y, z, w = ("x" * 150, "y" * 150, "z" * 150, "w" * 150)
    rows = [(1, "a", x), (2, "b", z), (5, "c", x), (5, "d", y), (5, "e", z), (7, "f", y), (7, "g", x), (7, "g", x), (None, "n", w), (None, "n", x), (3, "h", "tiny"), (2, "i", z), (2, "j", "tiny")]
    _, out = read(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = out.collect()
    least = {p: min(i for i, _, q in rows if q == p and i is not None) for p in (x, y, z)}
    want = [(i, u, "revisit", least[h]) if i is not None and h in least and i != least[h] else (i, u, "response", None) for i, u, h in rows]
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["url"], r["record_type"], r["refers_to"])) for r in got)
    payloads = {r["payload_digest"] for r in got if r["payload"] is not None}
    assert payloads == {hashlib.sha256(p.encode()).hexdigest() for _, _, p in rows}


def test_a_revisit_names_its_response():
    digest = "0" * 64
    one, _ = warc.parse(warc.record("response", 1, "http://a/", b"x" * 100, digest))
    two, _ = warc.parse(warc.record("revisit", 2, "http://b/", b"x" * 100, digest, 1, "http://a/"))
    assert two["WARC-Refers-To"] == one["WARC-Record-ID"] != two["WARC-Record-ID"] and two["WARC-Refers-To-Target-URI"] == "http://a/"
    for url in (None, "", "a\tb\r\nc", "http://x/\u2028\x85%0A", "\x00", "é"):
        assert warc.address_of(warc.parse(warc.record("response", 1, url, b"", digest))[0]) == url


def test_no_pages(spark):
    assert read(spark, spark.createDataFrame([], "page_id long, url string, html string, path string"))[1].collect() == []


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = sorted(con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP4_SQL})").fetchall())
    assert sorted(tuple(r) for r in warc.op4_warc_packages(spark, sf).collect()) == want
