import hashlib
import io
import zipfile

import pytest

from sorimill.llm import queries, warc_zip


class Held:
    """A file in memory that counts what is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def package(rows):
    sink = io.BytesIO()
    p = warc_zip.Package(sink)
    for r in rows:
        p.add(*r)
    p.close()
    return sink.getvalue()


ROWS = [(1, "http://a/\n", None, b""), (2, None, None, b"x" * 2000), (3, "http://b/", 2, b"x" * 2000), (None, "u", None, "é".encode())]


def test_round_trip_of_a_package():
    got = list(warc_zip.records(Held(package(ROWS))))
    assert [h["warc-type"] for h, _ in got] == ["response", "response", "revisit", "response"]
    assert [b for _, b in got] == [b"", b"x" * 2000, b"", "é".encode()]
    assert got[0][0]["warc-target-uri"] == "http://a/%0A" and "warc-target-uri" not in got[1][0]


def test_zip64_and_other_readers(monkeypatch):
    plain = package(ROWS)
    assert zipfile.ZipFile(io.BytesIO(plain)).testzip() is None
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    large = package(ROWS)
    assert b"PK\x06\x06" in large and b"PK\x06\x07" in large
    found = warc_zip.members(Held(large))
    assert [(m.name, m.size, m.header) for m in found] == [(i.filename, i.file_size, i.header_offset) for i in zipfile.ZipFile(io.BytesIO(large)).infolist()]
    assert len(list(warc_zip.records(Held(large)))) == len(ROWS)


def test_ranges_and_broken_files():
    import random

    big = package([(i, "u", None, random.Random(i).randbytes(10_000)) for i in range(200)])
    file = Held(big)
    assert len(warc_zip.members(file)) == 3
    assert file.read < 70_000 < len(big)
    with pytest.raises(ValueError):
        warc_zip.members(Held(b"nothing"))
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    file = Held(sink.getvalue())
    with pytest.raises(ValueError):
        warc_zip.data_start(file, warc_zip.members(file)[0])


def test_revisits_and_edges(spark):
    long, short = "l" * 1000, "s" * 999
    rows = [(1, "a", long, 0), (5, "b", long, 0), (3, None, long, 0), (5, "b", long, 0), (None, "n", long, 0), (7, "c", short, 0), (8, "d", short, 0), (9, "e", None, 0), (10, "f", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((r.id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc_zip.round_trip(spark, pages).collect())
    assert got == [
        (0, "revisit", 5, 1000),
        (1, "revisit", 5, 1000),
        (3, "revisit", 5, 1000),
        (5, "response", None, 1000),
        (5, "response", None, 1000),
        (7, "response", None, 999),
        (8, "response", None, 999),
        (9, "response", None, 0),
        (10, "response", None, 0),
    ]
    assert warc_zip.round_trip(spark, pages.limit(0)).count() == 0
    bodies = warc_zip.read_packages(warc_zip.write_packages(pages), payload=True).where("record_type = 'response'").collect()
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in bodies)


def test_every_page(spark, sf_dir):
    got = {r.page_id: r for r in queries.op3_warc(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = (p.html or "").encode()
        assert (got[p.page_id].payload_bytes, got[p.page_id].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
