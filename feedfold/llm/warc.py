"""WARC records in ZIP-packaged archives: written by tasks, and read back by range without unpacking.

An archive is a ZIP file whose members are stored as they are: the records, each
compressed by itself, and an index with the place of each one.  The reader takes a file's
tail, its central directory (ZIP64 or not) and its index, and then only the bytes of
records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import fresh, slices, written

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 256 * 2**20
GAP, SPAN = 2**16, 4 * 2**20  # records that lie so near are read at once, up to so many bytes
PER_TASK = 2_000  # records of an archive that are read by one group
READ = 8 * 2**20  # stored bytes of records that a task reads
PAGE = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record as a gzip member; fields without a value are left out, line ends in values are escaped."""
    lines = ["WARC/1.1"]
    for name, value in [*fields, ("Content-Length", str(len(block)))]:
        if value is not None:
            lines.append(f"{name}: " + value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
                         if "\r" in value or "\n" in value else f"{name}: {value}")
    raw = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in
                  (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    return fields, rest[: int(fields.get("content-length", len(rest)))]


class Archive:
    """Writes one archive: records as they come, then their index."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, place = fs.FileSystem.from_uri(self.path)
        self.out = system.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(RECORDS, "w", force_zip64=True)
        self.offset, self.lines = 0, []

    def add(self, entry: dict, packed: bytes) -> None:
        self.data.write(packed)
        self.lines.append(json.dumps({**entry, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line.encode() + b"\n")
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [RECORDS, INDEX]}))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    archive, done = None, []
    for batch in slices(batches, 200):
        for page, url, html, sha, first in zip(*(batch.column(k).to_pylist() for k in ("id", "url", "html", "sha", "first"))):
            archive = archive or Archive(folder)
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            name = f"<{PAGE}{'' if page is None else page}>"
            kind = "response" if first is None else "revisit"
            fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", url),
                      ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
                      ("WARC-Profile", None if first is None else PROFILE),
                      ("WARC-Refers-To", None if first is None else f"<{PAGE}{first}>")]
            archive.add({"digest": f"sha1:{digest}", "type": kind},
                        record(fields, HTTP + (b"" if first is not None else html.encode("utf-8", "surrogatepass"))))
            if archive.offset >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive = None
    if archive:
        done.append(archive.close())
    paths, records = zip(*done) if done else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64())], ["path", "records"])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of ``pages`` and returns the archives that count: (path, records).

    Of rows with equal payloads (the html in UTF-8, null: empty) of at least ``least_bytes``
    bytes, the one with the least id is a response and the others revisit it. Rows without id are
    responses that none revisits; repeated rows are repeated records; a null url is left out. Files of
    tasks that failed are in the folder too, but not in the result. An empty table gives no archives.
    """
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1("html"))
    firsts = pages.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    firsts = firsts.select(F.concat("sha", F.lit("")).alias("sha"), "first")  # a key that AQE can split
    marked = pages.join(firsts, "sha", "left").withColumn("first", F.when(
        F.col("id") != F.col("first"), F.col("first")))
    return written(marked.select("id", "url", "html", "sha", "first").mapInArrow(
        lambda it: _write(it, folder, date), "path string, records long"), "warc-manifest")


def directory(file, size: int) -> list[dict]:
    """The members of a ZIP file by its central directory: name, method, compressed, size, offset (of the local header)."""
    tail = file.read_at(min(size, 22 + 65_535 + 20), max(0, size - (22 + 65_535 + 20)))
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # its mark can also be in the comment
    if at < 0 or len(tail) < 22:
        raise ValueError("no ZIP directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from("<4s4H2LH", tail, at)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end = file.read_at(56, where)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        count, length, start = struct.unpack_from("<3Q", end, 32)
    raw, members, p = file.read_at(length, start), [], 0
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        method = struct.unpack_from("<H", raw, p + 10)[0]
        packed, full = struct.unpack_from("<2L", raw, p + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<3H", raw, p + 28)
        offset = struct.unpack_from("<L", raw, p + 42)[0]
        name = raw[p + 46 : p + 46 + name_n].decode("utf-8", "replace")
        extra, q = raw[p + 46 + name_n : p + 46 + name_n + extra_n], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<2H", extra, q)
            if tag == 1:  # ZIP64: the values that did not fit, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full = next(values) if full == 2**32 - 1 else full
                packed = next(values) if packed == 2**32 - 1 else packed
                offset = next(values) if offset == 2**32 - 1 else offset
            q += 4 + n
        members.append({"name": name, "method": method, "compressed": packed, "size": full, "offset": offset})
        p += 46 + name_n + extra_n + comment_n
    return members


def data_start(file, member: dict) -> int:
    head = file.read_at(30, member["offset"])
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken ZIP member")
    return member["offset"] + 30 + sum(struct.unpack_from("<2H", head, 26))


def _walk(file, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Places of the gzip members of an unindexed run of records."""
    at, begin, unpack = start, start, zlib.decompressobj(31)
    buffer = b""
    while at < start + length or buffer:
        if not buffer:
            buffer = file.read_at(min(2**20, start + length - at), at)
            at += len(buffer)
        unpack.decompress(buffer)
        buffer = b""
        if unpack.eof:
            buffer = unpack.unused_data
            end = at - len(buffer)
            yield begin - start, end - begin
            begin, unpack = end, zlib.decompressobj(31)


def places(path: str) -> list[tuple[int, int]]:
    """Offset and length in the file of every record of an archive, from its indexes; members without one are walked through."""
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as file:
        members = directory(file, file.size())
        stored = [m for m in members if m["method"] == 0]
        records = {m["name"]: data_start(file, m) for m in stored if m["name"].endswith(".warc.gz")}
        found, indexed = [], set()
        for m in stored:
            if m["name"].startswith("indexes/") and m["name"].endswith(".cdxj"):
                for line in file.read_at(m["size"], data_start(file, m)).splitlines():
                    entry = json.loads(line[line.index(b"{"):])
                    name = entry.get("filename", RECORDS)
                    if name in records:
                        indexed.add(name)
                        found.append((records[name] + int(entry["offset"]), int(entry["length"])))
        for m in stored:
            if m["name"] in records and m["name"] not in indexed:
                found += [(records[m["name"]] + o, n) for o, n in _walk(file, records[m["name"]], m["size"])]
        return sorted(found)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            spots = places(path)
            offsets, lengths = zip(*spots) if spots else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(spots), pa.string()), pa.array([k // PER_TASK for k in range(len(spots))], pa.int64()),
                 pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["path", "part", "offset", "length"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("record_id", "type", "url", "digest", "refers_to", "payload")
    kinds = [pa.string()] * 5 + [pa.binary()]
    opened, file = None, None
    for batch in slices(batches, 500):
        rows, begin, chunk = [], 0, b""
        spots = list(zip(*(batch.column(k).to_pylist() for k in ("path", "offset", "length"))))
        for k, (path, offset, length) in enumerate(spots):
            if path != opened:
                system, place = fs.FileSystem.from_uri(path)
                opened, file, chunk = path, system.open_input_file(place), b""
            if not begin <= offset <= offset + length <= begin + len(chunk):
                end = offset + length
                for other, start, n in spots[k + 1 :]:
                    if other != path or start > end + GAP or start + n - offset > SPAN:
                        break
                    end = max(end, start + n)
                begin, chunk = offset, file.read_at(end - offset, offset)
            fields, block = parsed(zlib.decompress(chunk[offset - begin : offset - begin + length], 31))
            payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
            kind = fields.get("warc-type")
            rows.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-payload-digest"),
                         fields.get("warc-refers-to"), None if kind == "revisit" else payload))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], list(names))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (column ``path``): record_id, type, url, digest, refers_to, payload (null for revisits).

    Archives are located by one pass over their directories; their records are then dealt to
    tasks in runs, so one archive is read by many tasks.
    """
    spots = written(archives.select("path").distinct().mapInArrow(_locate, "path string, part long, offset long, length long"), "warc-places")
    # As many tasks as the records' bytes ask for; the list of places is small and would be merged into few.
    tasks = -(-(spots.agg(F.sum("length")).first()[0] or 1) // READ)
    dealt = spots.repartition(tasks, "path", "part").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_read, "record_id string, type string, url string, digest string, refers_to string, payload binary")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [None if p is None else base32_sha1(p) for p in batch.column("payload").to_pylist()]
        sizes = pa.compute.binary_length(batch.column("payload")).cast(pa.int64())
        columns = [batch.column(k) for k in ("record_id", "type", "digest", "refers_to")]
        yield pa.RecordBatch.from_arrays([*columns, sizes, pa.array(own, pa.string())],
                                         ["record_id", "type", "digest", "refers_to", "size", "own"])


def described(records: DataFrame) -> DataFrame:
    """Per record that a page was written as: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Sizes and digests of responses are taken anew from their payloads, a revisit's size is that of
    the response it names; intact: whether the digest is the one in the header.
    """
    page = lambda c: F.regexp_extract(c, f"^<{PAGE}(-?[0-9]+)>$", 1).try_cast("long")
    rows = written(records.mapInArrow(_digested, "record_id string, type string, digest string, refers_to string, size long, "
                                      "own string").select(
        page(F.col("record_id")).alias("page_id"), "type", F.expr("substring(digest, 6)").alias("named"),
        page(F.col("refers_to")).alias("refers_to"), "size", "own"), "warc-records")
    sizes = rows.where("type = 'response' and page_id is not null").groupBy("page_id", "own").agg(
        F.max("size").alias("full")).select(fresh("page_id").alias("refers_to"), F.concat("own", F.lit("")).alias("named"), "full")
    out = rows.join(sizes, ["refers_to", "named"], "left")
    return out.select("page_id", F.coalesce("size", "full").alias("payload_bytes"), F.coalesce("own", "named").alias("payload_digest"),
                      F.col("type").alias("record_type"), "refers_to",
                      F.coalesce(F.col("own") == F.col("named"), F.col("full").isNotNull()).alias("intact"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``described`` records of ``pages``, written to the shared folder and read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return described(read_archives(write_archives(pages, folder, least_bytes)))
