"""WARC records in ZIP packages: writer, directory parser and range reader.

A package is a ZIP file with stored members: ``archive/*.warc.gz`` (each record a gzip
member of its own) and ``indexes/*.cdxj`` (a line per record with its byte range). The
reader parses the end record, the ZIP64 records and the central directory, finds the
stored members, and reads each record by its byte range; nothing is extracted. Bytes of
an archive that no index line names are walked record by record.

Packages are written by Spark's own file writer, one file for each, so task retries
and lost executors leave no half files. A package closes once it holds
``PACKAGE_BYTES``, which bounds the memory of either side. ``read_packages`` reads them
by Spark's binary file source, from any store that Spark reads and up to its 2 GB a
file; ``read_at`` then cuts ranges out of the file's buffer without copying it. Larger
packages are read by ``read_ranges``: a task reads directories and indexes alone, the
(path, offset, length) rows are dealt to tasks, and these open the files by range.

Defined results: a null page text is an empty payload; a null url has no header;
a page without an id is written without one and read back as null; of several rows with
the largest id of equal payloads all are responses; other columns are not archived.
Records of other types have their block as payload; a revisit that states no size or
digest has null there; index lines that name no archive of the package, overlap an
earlier one or reach outside are left to the walk.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_BYTES = 16 << 20
#: Shorter payloads are never revisits.
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"

# Signatures and sizes of the ZIP format, and of the WARC revisit profile.
LOCAL, CENTRAL, END, END64, LOCATOR64 = (b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:shelfline:page:"


# ---- records ----


def _header(value: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. ``payload`` None: a revisit of the payload of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return _page(self.headers.get("warc-record-id", ""))

    @property
    def refers_to(self) -> int | None:
        return _page(self.headers.get("warc-refers-to", ""))

    @property
    def kind(self) -> str | None:
        return self.headers.get("warc-type")

    @property
    def payload_bytes(self) -> int | None:
        """Of the full payload; a revisit states it in its HTTP headers."""
        if self.kind != "revisit":
            return len(self.payload)
        stated = self.http.get("content-length", "")
        return int(stated) if stated.isdecimal() else None

    @property
    def payload_digest(self) -> str | None:
        if self.kind != "revisit":
            return hashlib.sha1(self.payload).hexdigest()
        stated = self.headers.get("warc-payload-digest")
        return stated and stated.removeprefix("sha1:")


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix(ID)
    return int(number) if number.lstrip("-").isdigit() else None


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _head(raw: bytes) -> tuple[dict[str, str], int, int]:
    """Header fields of a record, where its block starts, and the block's length."""
    end = raw.find(b"\r\n\r\n")
    headers = _fields(raw[:end]) if end >= 0 else {}
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("a WARC record is cut off, or states no length")
    return headers, end + 4, int(headers["content-length"])


def parse_record(raw: bytes) -> tuple[Record, int]:
    """A record at the start of ``raw`` and its length with the closing empty lines."""
    headers, start, size = _head(raw)
    if start + size > len(raw):
        raise ValueError("a WARC record is cut off")
    block = raw[start : start + size]
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
    return Record(headers, http, payload), start + size + 4


# ---- packages: writing ----


def _member(name: str, data: bytes, at: int) -> tuple[bytes, bytes]:
    """Local header and central entry of a stored member whose local header is at ``at``.
    Sizes and offset are in ZIP64 fields throughout."""
    path, crc = name.encode(), zlib.crc32(data)
    sizes = struct.pack("<QQ", len(data), len(data))
    local = struct.pack("<4s5H3L2H", LOCAL, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(path), 20) + path + struct.pack("<2H", 1, 16) + sizes
    central = struct.pack("<4s6H3L5H2L", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(path), 28, 0, 0, 0, 0, FULL32)
    return local, central + path + struct.pack("<2H", 1, 24) + sizes + struct.pack("<Q", at)


def package(members: list[tuple[str, bytes]], comment: bytes = b"") -> bytes:
    """A ZIP64 file of stored members."""
    parts, entries, at = [], [], 0
    for name, data in members:
        local, central = _member(name, data, at)
        parts += [local, data]
        entries.append(central)
        at += len(local) + len(data)
    size = sum(map(len, entries))
    end64 = struct.pack("<4sQ2H2L4Q", END64, 44, 45, 45, 0, 0, len(entries), len(entries), size, at)
    locator = struct.pack("<4sLQL", LOCATOR64, 0, at + size, 1)
    end = struct.pack("<4s4H2LH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, len(comment)) + comment
    return b"".join([*parts, *entries, end64, locator, end])


class PackageWriter:
    """Collects records of one package."""

    def __init__(self) -> None:
        self.data, self.lines = bytearray(), []

    def add(self, url: str | None, raw: bytes) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = press.compress(raw) + press.flush()
        where = {"url": url, "offset": str(len(self.data)), "length": str(len(member)), "filename": "data.warc.gz"}
        stamp = "".join(c for c in DATE if c.isdigit())
        self.lines.append(f"{_header(url or '-').replace(' ', '%20')} {stamp} {json.dumps(where)}")
        self.data += member

    def close(self, comment: bytes = b"") -> bytes:
        index = "".join(f"{line}\n" for line in self.lines).encode("utf-8", "replace")
        return package([("archive/data.warc.gz", bytes(self.data)), ("indexes/index.cdxj", index)], comment)


# ---- packages: reading ----


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int

    @property
    def stored(self) -> bool:
        return self.method == 0 and not self.flags & 1 and self.packed == self.size


class Package:
    """Directory of a ZIP file that is read by byte ranges only."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        count, length, start = self._directory()
        self.members = {m.name: m for m in self._entries(bytes(read_at(start, length)), count)}

    def _directory(self) -> tuple[int, int, int]:
        """Number of entries, length and offset of the central directory."""
        tail_at = max(0, self.size - 22 - FULL16)
        tail = bytes(self.read_at(tail_at, self.size - tail_at))
        at = tail.rfind(END)
        while at >= 0 and not (at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut off")
        count, length, start = struct.unpack_from("<H2L", tail, at + 10)
        place = tail_at + at - 20
        if place >= 0 and bytes(self.read_at(place, 4)) == LOCATOR64:
            end64 = struct.unpack("<Q", bytes(self.read_at(place + 8, 8)))[0]
            fixed = bytes(self.read_at(end64, 56))
            if fixed[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<3Q", fixed, 32)
        return count, length, start

    @staticmethod
    def _entries(directory: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<2H", directory, at + 8)
            crc, packed, size, n, extra, comment = struct.unpack_from("<3L3H", directory, at + 16)
            header = struct.unpack_from("<L", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
            wide = Package._wide(directory[at + 46 + n : at + 46 + n + extra])
            size, packed, header = (next(wide, None) if x == FULL32 else x for x in (size, packed, header))
            if None in (size, packed, header):
                raise ValueError(f"no ZIP64 field of {name}")
            yield Member(name, method, flags, crc, packed, size, header)
            at += 46 + n + extra + comment

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        """The values of the ZIP64 extra field in order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, at)
            if kind == 1:
                yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
                return
            at += 4 + n

    def start(self, member: Member) -> int:
        """Offset of the bytes of a stored member."""
        if not member.stored:
            raise ValueError(f"{member.name} is compressed or encrypted; only stored members are read by range")
        fixed = bytes(self.read_at(member.header, 30))
        if fixed[:4] != LOCAL:
            raise ValueError(f"no local header of {member.name}")
        return member.header + 30 + sum(struct.unpack_from("<2H", fixed, 26))

    def archives(self) -> list[Member]:
        return [m for m in self.members.values() if m.name.endswith((".warc", ".warc.gz"))]

    def indexes(self) -> list[Member]:
        return [m for m in self.members.values() if m.name.removesuffix(".gz").endswith((".cdx", ".cdxj"))]

    def ranges(self) -> Iterator[tuple[Member, int, int]]:
        """Archive member, offset and length of every indexed record."""
        by_name = {m.name.rpartition("/")[2]: m for m in self.archives()}
        for index in self.indexes():
            lines = _unpacked(bytes(self.read_at(self.start(index), index.size))).split(b"\n")
            for line in lines:
                at = line.find(b"{")
                if at >= 0:
                    where = json.loads(line[at:])
                    member = by_name.get(where.get("filename"))
                    if member and "offset" in where and "length" in where:
                        yield member, int(where["offset"]), int(where["length"])

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Byte ranges of the package that cover its archives: indexed records, and what
        lies between them."""
        named: dict[str, list[tuple[int, int]]] = {m.name: [] for m in self.archives()}
        for member, offset, length in self.ranges():
            if 0 <= offset and 0 < length and offset + length <= member.size:
                named[member.name].append((offset, length))
        for member in self.archives():
            start, at = self.start(member), 0
            for offset, length in sorted(named[member.name]):
                if offset >= at:
                    if offset > at:
                        yield start + at, offset - at
                    yield start + offset, length
                    at = offset + length
            if at < member.size:
                yield start + at, member.size - at

    def records(self) -> Iterator[Record]:
        for start, length in self.pieces():
            yield from walk(self.read_at, start, length)


#: Bytes read at once where the length of a record is not known.
STEP = 1 << 20


def walk(read_at: Callable[[int, int], bytes], at: int, length: int) -> Iterator[Record]:
    """The records of a byte range, read in steps: a record is in memory, the range is not."""
    end = at + length
    while at < end:
        first = bytes(read_at(at, min(STEP, end - at)))
        if first[:2] == b"\x1f\x8b":
            press, raw, step, reached = zlib.decompressobj(31), [], first, at
            while True:
                raw.append(press.decompress(step))
                reached += len(step)
                if press.eof or reached >= end:
                    break
                step = bytes(read_at(reached, min(STEP, end - reached)))
            at = reached - len(press.unused_data)
            yield parse_record(b"".join(raw))[0]
        elif first.strip(b"\r\n"):
            size = sum(_head(first)[1:])
            if size > end - at:
                raise ValueError("a WARC record is cut off")
            found, length = parse_record(first if size <= len(first) else bytes(read_at(at, size)))
            yield found
            at += length
        else:  # empty lines
            at += len(first)


def _plain(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def _unpacked(data: bytes) -> bytes:
    """``data``, or the contents of its gzip members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        press = zlib.decompressobj(31)
        out.append(press.decompress(data))
        data = press.unused_data
    return b"".join(out) or data


# ---- on Spark ----


def with_record_types(pages: DataFrame, identity: str = "page_id", text: str = "html", url: str = "url", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``id``, ``url``, ``body``, ``size``, ``digest`` and ``refers`` of every page: of
    equal payloads of at least ``least_bytes`` the largest id is the original."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(F.col(identity).cast("long").alias("id"), F.col(url).alias("url"), body.alias("body")).withColumns(
        {"size": F.octet_length("body").cast("long"), "digest": F.sha1(F.encode("body", "UTF-8"))}
    )
    originals = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "original")
    )
    refers = F.when(~F.col("original").eqNullSafe(F.col("id")), F.col("original"))
    return rows.join(originals, "digest", "left").select("id", "url", "size", "digest", refers.alias("refers"), F.when(refers.isNull(), F.col("body")).alias("body"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, identity: str = "page_id", text: str = "html", url: str = "url") -> None:
    """Archives every page as a record of a package under ``folder``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark's writer ends the file with a line end; it is the comment of the package.
        done = lambda writer: pa.record_batch([pa.array([writer.close(b"\n")[:-1]], pa.binary())], names=["package"])
        writer = PackageWriter()
        for batch in batches:
            for page_id, link, size, digest, refers, body in zip(*(batch.column(i) for i in range(6)), strict=True):
                payload = None if refers.is_valid else (body.as_py() or "").encode("utf-8", "replace")
                writer.add(link.as_py(), record(page_id.as_py(), link.as_py(), payload, size.as_py(), digest.as_py(), refers.as_py()))
                if len(writer.data) >= package_bytes:
                    yield done(writer)
                    writer = PackageWriter()
        if writer.lines:
            yield done(writer)

    typed = with_record_types(pages, identity, text, url)
    packages = typed.mapInArrow(task, "package binary").select(F.col("package").cast("string").alias("value"))
    packages.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)


SHAPE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _tables(records: Iterator[Record], payload: bool) -> Iterator[pa.RecordBatch]:
    """Batches of about 4 MB of the rows that ``read_packages`` returns."""
    names = [f.split()[0] for f in SHAPE.split(", ")] + (["payload"] if payload else [])
    kinds = KINDS + ([pa.binary()] if payload else [])
    rows, held = [], 0
    for r in records:
        row = (r.page_id, r.headers.get("warc-target-uri"), r.payload_bytes, r.payload_digest, r.kind, r.refers_to)
        rows.append((*row, None if r.kind == "revisit" else r.payload) if payload else row)
        held += len(r.payload) if payload else 200
        if held > 4 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_packages(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """A row per record of all packages under ``folder``: ``page_id``, ``url``,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and, if
    asked for, ``payload`` (null in a revisit). For packages of up to 2 GB."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                yield from _tables(Package(lambda at, n, v=view: v[at : at + n], len(view)).records(), payload)

    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    return files.select("content").mapInArrow(task, SHAPE + (", payload binary" if payload else ""))


Opener = Callable[[str], tuple[Callable[[int, int], bytes], int]]


def open_uri(path: str) -> tuple[Callable[[int, int], bytes], int]:
    """``read_at`` and size of a file of any store that Arrow's file systems reach."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    file = store.open_input_file(name)
    return lambda at, n: file.read_at(n, at), file.size()


def record_ranges(paths: DataFrame, opener: Opener = open_uri) -> DataFrame:
    """``path``, ``start`` and ``length`` of every piece of the packages in column
    ``path``; of a package only its directory and indexes are read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = list(Package(*opener(path)).pieces())
                columns = [pa.array([path] * len(found), pa.string()), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))]
                yield pa.record_batch(columns, names=["path", "start", "length"])

    return paths.select("path").where("path IS NOT NULL").mapInArrow(task, "path string, start long, length long")


def read_ranges(ranges: DataFrame, payload: bool = True, opener: Opener = open_uri) -> DataFrame:
    """The records of ``record_ranges``, as ``read_packages`` returns them. Deal the
    rows out (``repartition``) before, so that pieces of one large package spread."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read_at = None, None
        for batch in batches:
            for name, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != path:
                    path, (read_at, _) = name, opener(name)
                yield from _tables(walk(read_at, start, length), payload)

    return ranges.select("path", "start", "length").mapInArrow(task, SHAPE + (", payload binary" if payload else ""))
