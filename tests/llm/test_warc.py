"""Archives: round trips, revisits, ZIP64 directories, missing indexes, odd rows."""

import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest

from feedfold.llm import catalog, warc
from feedfold.session import scratch_path
from checks.compare import compare, duck


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= least:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        lead = first.get(payload, page)
        again = page is not None and lead != page
        out.append((page, len(payload), warc.base32_sha1(payload), "revisit" if again else "response", lead if again else None, True))
    return sorted(map(str, out))


ROWS = [(i, f"http://a.example/{i}", f"<p>{i % 7} é</p>" * (i % 7 * 40)) for i in range(60)] + [
    (100, None, None), (101, "http://x", ""), (102, "", "long " * 200_000), (102, "", "long " * 200_000),
    (None, "u", "<p>1 é</p>" * 40), (None, None, None), (104, "http://bad\r\nWARC-Type: x\r\n\r\n", "line\r\n\r\nend\x00"),
    (-5, "é漢", "<p>2 é</p>" * 80)]


@pytest.mark.parametrize("least", [0, 700])
def test_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)  # several archives of a task
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, sha string, first int")
    got = warc.round_trip(pages.repartition(3), least).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(ROWS, least)


def test_records_and_urls(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    manifest = warc.write_archives(pages.coalesce(1), scratch_path(spark, "warc-test"))
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(ROWS) == sum(r.records for r in manifest.collect())
    by = {r.record_id: r for r in got}
    assert by["<urn:page:104>"].url.startswith("http://bad%0D%0AWARC-Type") and bytes(by["<urn:page:104>"].payload) == b"line\r\n\r\nend\x00"
    assert by["<urn:page:-5>"].url == "é漢" and by["<urn:page:100>"].url is None and by["<urn:page:101>"].payload is None


def test_directories():
    """What a plain ZIP library writes: many members, comments, data before the archive's own, ZIP64 records."""
    def file(raw):
        return pa.BufferReader(raw)

    for comment in (b"", b"PK\x05\x06 in a comment" * 9):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.comment = comment
            for i in range(300):
                z.writestr(f"m{i}é", b"x" * i)
            with z.open("big", "w", force_zip64=True) as f:
                f.write(b"z" * 10)
        raw = out.getvalue()
        members = warc.directory(file(raw), len(raw))
        assert [m["name"] for m in members] == [f"m{i}é" for i in range(300)] + ["big"]
        m = members[77]
        start = warc.data_start(file(raw), m)
        assert raw[start : start + m["size"]] == b"x" * 77
    with pytest.raises(ValueError):
        warc.directory(file(b"nothing"), 7)


def test_zip64_directory():
    """A directory whose counts and places are only in ZIP64 records."""
    name, data = b"archive/data.warc.gz", b"payload"
    local = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 2**32 - 1, 2**32 - 1, len(name), 20) + name + struct.pack(
        "<2H2Q", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 2**32 - 1, 2**32 - 1, len(name), len(extra),
                          0, 0, 0, 0, 2**32 - 1) + name + extra
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    raw = local + central + end64 + locator + end
    (member,) = warc.directory(pa.BufferReader(raw), len(raw))
    assert member == {"name": name.decode(), "method": 0, "compressed": 7, "size": 7, "offset": 0}
    start = warc.data_start(pa.BufferReader(raw), member)
    assert raw[start : start + 7] == data


def test_an_archive_without_index_is_walked_through(spark, tmp_path):
    packed = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), ("Content-Type", "application/http")],
                          warc.HTTP + b"x" * i * 1000) for i in range(30)]
    with zipfile.ZipFile(tmp_path / "plain.wacz", "w") as z:
        z.writestr("archive/other.warc.gz", b"".join(packed))
        z.writestr("notes.txt", "no records")
    got = warc.read_archives(spark.createDataFrame([(str(tmp_path / "plain.wacz"),)], "path string")).collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == sorted((f"<urn:page:{i}>", i * 1000) for i in range(30))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    good, note = compare(spark, duck(sf), sf, catalog.QUERIES["op9_warc"], catalog.ORACLES["op9_warc"])
    assert good, note
