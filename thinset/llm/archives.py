"""ZIP-packaged WARC archives: written by partition, read by range without extraction.

An archive is a ZIP file of two stored members, ``archive/data.warc.gz`` (one gzip
member a record) and ``indexes/index.cdxj`` (one JSON line a record).  Stored members
are plain byte ranges of the file, so a reader parses the central directory (ZIP64
where sizes or counts ask for it), finds where a member's data begin, and reads single
records by offset and length.  Files are opened through Arrow's file systems, so the
shared folder may be a local mount or any store those know.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinset.llm.tables import if_small, stored
from thinset.workspace import new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 8 << 20       # records that lie together are read in ranges of this size
INDEX_BYTES = 16 << 20     # bytes of an index one task step holds
ROLL_BYTES = 1 << 30       # an archive is closed beyond this size and a new one begun
_END, _END64, _LOCATE64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- the ZIP container

class ZipWriter:
    """Stored members one after another; ZIP64 fields where needed or asked for."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow the data, so the local header announces a descriptor."""
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self._put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 1 << 3 | 1 << 11, 0, 0, 33, 0,
                              _FULL32, _FULL32, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Append to the open member; gives the offset inside it."""
        member = self.members[-1]
        at = member[2]
        self._put(data)
        member[2] += len(data)
        member[3] = zlib.crc32(data, member[3])
        return at

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))

    def close(self) -> None:
        begin = self.at
        for raw, at, size, crc in self.members:
            wide = self.zip64 or max(at, size) >= _FULL32
            extra = struct.pack("<2H3Q", 1, 24, size, size, at) if wide else b""
            s, o = (_FULL32, _FULL32) if wide else (size, at)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 1 << 3 | 1 << 11, 0, 0, 33, crc, s, s,
                                  len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, count = self.at - begin, len(self.members)
        if self.zip64 or max(begin, size) >= _FULL32 or count >= _FULL16:
            at = self.at
            self._put(struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, count, count, size, begin))
            self._put(struct.pack("<4sIQI", _LOCATE64, 0, at, 1))
            count, size, begin = _FULL16, _FULL32, _FULL32
        self._put(struct.pack("<4s4H2IH", _END, 0, 0, count, count, size, begin, 0))


def read_at(file, at: int, length: int) -> bytes:
    file.seek(at)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends inside bytes {at} to {at + length}")
    return data


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset of the data, length) of every member; all have to be stored."""
    tail_at = max(0, size - 22 - _FULL16)
    tail = read_at(file, tail_at, size - tail_at)
    end = tail.rfind(_END)
    # The comment may hold the signature too; the right one is followed by its whole comment.
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    count, length, begin = struct.unpack_from("<H2I", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == _LOCATE64:
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = read_at(file, at, 56)
        if record[:4] != _END64:
            raise ValueError("ZIP64 locator points at no end record")
        count, length, begin = struct.unpack_from("<3Q", record, 32)
    directory, at, found = read_at(file, begin, length), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, stored_size, plain_size = struct.unpack_from("<H8x2I", directory, at + 10)
        n, m, k = struct.unpack_from("<3H", directory, at + 28)
        (where,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n].decode()
        stored_size, where = _wide(directory[at + 46 + n:at + 46 + n + m], plain_size, stored_size, where)
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        local = read_at(file, where, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        a, b = struct.unpack_from("<2H", local, 26)
        found[name] = where + 30 + a + b, stored_size
        at += 46 + n + m + k
    return found


def _wide(extra: bytes, plain: int, size: int, where: int) -> tuple[int, int]:
    """Size and offset, from the ZIP64 field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<2H", extra, at)
        if tag == 1:
            values = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            if plain == _FULL32:
                values.pop(0)
            size = values.pop(0) if size == _FULL32 else size
            where = values.pop(0) if where == _FULL32 else where
        at += 4 + n
    return size, where


# ---------------------------------------------------------------- WARC records

def record(kind: str, identity: str, url: str, digest: str, length: int, payload: bytes, refers: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has no body but names digest and length of its own."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identity}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {length}", f"Content-Length: {len(payload)}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[:int(fields["content-length"])]


# ---------------------------------------------------------------- Spark jobs

def _kinds(pages: DataFrame) -> DataFrame:
    """Of equal payloads the page with the largest id; (page_id, refers_to) of the rest."""
    ids = stored(pages.select(F.col("page_id").cast("long").alias("page_id"),
                              F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("sha")), "payloads")
    first = ids.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    return ids.join(first, "sha").where("NOT (page_id <=> first)").select(
        F.col("page_id").alias("_page"), F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); (path, size, records).

    The payload is the html in UTF-8, null as empty.  Of rows with equal payloads the
    one with the largest page_id is a response and the others are revisits of it; rows
    that repeat this page_id are responses too, a null id is smaller than any other.
    A task writes its own archives under names of their own, so an attempt that is lost
    leaves a file that no listing names.  Other columns are not read; an empty table
    gives no archives; control characters are left out of the url's header field.
    """
    revisits = stored(_kinds(pages), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("_page"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    right = if_small(revisits.withColumn("revisit", F.lit(True)))
    rows = rows.join(right, rows["_page"].eqNullSafe(right["_page"]), "left").select(
        rows["_page"].alias("page_id"), "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        archive = None
        for batch in batches:
            for page, url, html, revisit, refers in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(system, base, folder)
                archive.add(page, url or "", (html or "").encode(), revisit, refers)
                if archive.size > ROLL_BYTES:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return stored(rows.mapInArrow(write, "path string, size long, records long"), "archives")


class _Archive:
    """An archive being written; index lines wait until the data member ends."""

    def __init__(self, system, base: str, folder: str):
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri = f"{folder.rstrip('/')}/{name}"
        self.stream = system.open_output_stream(f"{base.rstrip('/')}/{name}")
        self.zip, self.lines = ZipWriter(self.stream), []
        self.zip.begin(DATA)

    @property
    def size(self) -> int:
        return self.zip.at

    def add(self, page: int | None, url: str, payload: bytes, revisit: bool, refers: int | None) -> None:
        digest = base32_sha1(payload)
        data = record("revisit" if revisit else "response", f"urn:page:{'' if page is None else page}", url, digest,
                      len(payload), b"" if revisit else payload, f"urn:page:{refers}" if revisit else None)
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        at = self.zip.write(member)
        self.lines.append(json.dumps({"offset": at, "length": len(member)}))

    def close(self) -> pa.RecordBatch:
        self.zip.end()
        self.zip.begin(INDEX)
        for line in self.lines:
            self.zip.write(line.encode() + b"\n")
        self.zip.end()
        self.zip.close()
        self.stream.close()
        return pa.RecordBatch.from_arrays([pa.array([self.uri]), pa.array([self.size]), pa.array([len(self.lines)])],
                                          ["path", "size", "records"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of the records of each archive, neighbours together up to READ_BYTES."""
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, inside = fs.FileSystem.from_uri(path)
            with system.open_input_file(inside) as file:
                found = members(file, size)
                (data, _), (at, length) = found[DATA], found[INDEX]
                for entries in _entries(file, at, length):
                    group: list[tuple[int, int]] = []
                    groups = [group]
                    for offset, n in entries:
                        if group and offset + n - group[0][0] > READ_BYTES:
                            group = []
                            groups.append(group)
                        group.append((data + offset, n))
                    groups = [g for g in groups if g]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(groups), pa.string()),
                         pa.array([[o for o, _ in g] for g in groups], pa.list_(pa.int64())),
                         pa.array([[n for _, n in g] for g in groups], pa.list_(pa.int64()))],
                        ["path", "offsets", "lengths"])


def _entries(file, at: int, length: int) -> Iterator[list[tuple[int, int]]]:
    """(offset, length) of the lines of an index, read in pieces."""
    rest, end = b"", at + length
    while at < end:
        step = min(INDEX_BYTES, end - at)
        lines = (rest + read_at(file, at, step)).split(b"\n")
        rest, at = lines.pop(), at + step
        yield [(e["offset"], e["length"]) for e in map(json.loads, lines)]
    if rest:
        yield [(e["offset"], e["length"]) for e in map(json.loads, [rest])]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read the ranges and unpack their records."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def page(name: str) -> int | None:
        text = name.strip("<>").rpartition(":")[2]
        return int(text) if text else None

    for batch in batches:
        for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            system, inside = fs.FileSystem.from_uri(path)
            with system.open_input_file(inside) as file:
                begin = offsets[0]
                block = read_at(file, begin, offsets[-1] + lengths[-1] - begin)
            rows = []
            for at, n in zip(offsets, lengths):
                fields, body = parse(zlib.decompress(block[at - begin:at - begin + n], 31))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                response = fields["warc-type"] == "response"
                if response and base32_sha1(body) != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} in {path} is damaged")
                rows.append((page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"],
                             None if response else page(fields["warc-refers-to"]),
                             int(fields["x-payload-length"]), digest, body if response else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(archives: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Records of ``archives`` (path, size): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (both of the full payload) and payload.

    Response payloads are checked against their digests.  An archive that is damaged,
    compressed or not there fails the job; no archives give no rows.  Ranges are dealt
    over all tasks, so one large archive is read by many.
    """
    spark = archives.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    ranges = archives.select("path", "size").repartition(tasks).mapInArrow(
        _ranges, "path string, offsets array<long>, lengths array<long>")
    return ranges.repartition(4 * tasks).mapInArrow(
        _records, "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
                  "payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")))
