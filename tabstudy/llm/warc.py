"""WARC records in ZIP packages, and a reader that locates them by the directories and reads byte ranges.

A package holds two stored members: the records, each compressed by itself, and an index of their offsets. The reader parses the end record, the ZIP64
locator and directory where there is one, and the central directory, finds the members' bytes in the package, reads the index and
then only the ranges of the records it wants. Nothing is extracted. Sections of packages are read in parallel.

Packages are written by Spark's text writer, one for each task, so retried tasks leave no half package. Each row that it writes is
a piece of the package up to one of its line feeds; the very last line feed is the package's comment.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SECTION = 16 << 20  # bytes of a package that one task reads
LEVEL = 3  # of compression
READ = 4 << 20  # bytes of neighbouring records read at once
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
# Signatures of the ZIP format.
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP headers alone."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Package:
    """Pieces of a ZIP package, made in turn; sizes stand in descriptors and in the central directory."""

    def __init__(self, zip64: bool = False):
        self.at, self.members, self.zip64 = 0, [], zip64

    def _out(self, piece: bytes) -> bytes:
        self.at += len(piece)
        return piece

    def open(self, name: str) -> bytes:
        self.members.append({"name": name.encode(), "header": self.at, "crc": 0, "size": 0})
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        return self._out(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 0x21, 0, MAX32, MAX32, len(name), len(extra)) + name.encode() + extra)

    def add(self, data: bytes) -> bytes:
        m = self.members[-1]
        m["crc"], m["size"] = zlib.crc32(data, m["crc"]), m["size"] + len(data)
        return self._out(data)

    def close(self) -> bytes:
        m = self.members[-1]
        return self._out(DESCRIPTOR + struct.pack("<IQQ", m["crc"], m["size"], m["size"]))

    def end(self, comment: bytes) -> bytes:
        """Central directory and end records, with ``comment``'s length but not its bytes."""
        start, out = self.at, b""
        for m in self.members:
            wide = self.zip64 or max(m["size"], m["header"]) >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["header"]) if wide else b""
            size, header = (MAX32, MAX32) if wide else (m["size"], m["header"])
            out += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, header) + m["name"] + extra
        n, size = len(self.members), len(out)
        wide = self.zip64 or max(start, size) >= MAX32 or n >= MAX16
        if wide:
            out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start) + LOCATOR64 + struct.pack("<IQI", 0, start + size, 1)
        few, short, at = (MAX16, MAX32, MAX32) if wide else (n, size, start)
        return self._out(out + END + struct.pack("<HHHHIIH", 0, 0, few, few, short, at, len(comment)))


def members(file: BinaryIO, length: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset, length) of the bytes of each stored member."""
    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, length - 22 - MAX16)
    tail = at(tail_at, length - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end record: not a ZIP package")
    n, _, size, start = struct.unpack_from("<HHII", tail, end + 8)
    if MAX16 == n or MAX32 in (size, start):
        where = tail_at + end - 20
        mark = at(where, 20) if where >= 0 else b""
        if mark[:4] == LOCATOR64:
            wide = at(struct.unpack_from("<Q", mark, 8)[0], 56)
            if wide[:4] != END64:
                raise ValueError("damaged ZIP64 end record")
            n, _, size, start = struct.unpack_from("<QQQQ", wide, 24)
    directory, found, p = at(start, size), {}, 0
    for _ in range(n):
        if directory[p:p + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, p + 20)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46:p + 46 + name_n].decode()
        extra, q = directory[p + 46 + name_n:p + 46 + name_n + extra_n], 0
        while q + 4 <= len(extra):
            kind, n_bytes = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n_bytes // 8}Q", extra, q + 4))
                full = next(wide) if full == MAX32 else full
                packed = next(wide) if packed == MAX32 else packed
                header = next(wide) if header == MAX32 else header
            q += 4 + n_bytes
        local = at(header, 30)
        if local[:4] != LOCAL:
            raise ValueError("damaged local header")
        if method == 0:
            found[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        p += 46 + name_n + extra_n + comment_n
    return found


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the payload."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["http-length"] = next((x.split(b":")[1].strip().decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), "0")
    return headers, payload


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return system.open_input_file(path)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, zip64: bool = False) -> None:
    """Write a record for each row of ``pages``.

    Of records whose payloads are equal and have at least ``least_bytes`` bytes, those with the smallest id are responses and the
    others revisit them; smaller payloads are all responses. A null html is empty; a null url has no target; a null id revisits
    another id if there is one and else is a response. Repeated rows stay repeated; other columns are ignored; an empty table gives packages without records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"))
    joined = rows.join(first, "sha1").withColumn("size", F.octet_length("html")).withColumn("revisit", (F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    narrow = joined.select("page_id", "url", F.when(F.col("revisit"), "").otherwise(F.col("html")).alias("html"), "size", "sha1", "first", "revisit").sortWithinPartitions("page_id", "sha1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, index = Package(zip64), []
        pending = package.open(RECORDS)
        offset = 0
        for batch in slices(batches, 50):
            for page_id, url, html, size, sha1, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(7))):
                data = package.add(gzip.compress(record(page_id, url, html.encode(), size, base64.b32encode(bytes.fromhex(sha1)).decode(), first, revisit), LEVEL, mtime=0))
                index.append({"page_id": page_id, "url": url, "offset": offset, "length": len(data)})
                offset += len(data)
                pending += data
            cut = pending.rfind(b"\n")
            if cut >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([pending[:cut]], pa.binary())], ["piece"])
                pending = pending[cut + 1:]
        last = pending + package.close() + package.open(INDEX)
        last += package.add("".join(json.dumps(x) + "\n" for x in index).encode()) + package.close() + package.end(b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary())], ["piece"])

    narrow.mapInArrow(run, "piece binary").select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def index_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, page_id, url, offset, length) of all packages: offset and length of the record in its package."""

    def run(batches):
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(uri) as file:
                    inside = members(file, size)
                    start = inside[RECORDS][0]
                    at, n = inside[INDEX]
                    file.seek(at)
                    rows = [json.loads(x) for x in file.read(n).splitlines()]
                kinds = {"page_id": pa.int64(), "url": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items()), pa.array([start + r["offset"] for r in rows], pa.int64()),
                                                  pa.array([r["length"] for r in rows], pa.int64())], ["path", "page_id", "url", "offset", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "length")
    return files.repartition("path").mapInArrow(run, "path string, page_id long, url string, offset long, length long")


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the records that ``index`` names, read by their ranges.

    The digest of a response is computed from its payload and must equal the record's; a revisit's are those of its record.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def row(data: bytes, url: str | None):
        headers, payload = parse_record(gzip.decompress(data))
        named = headers["warc-payload-digest"].removeprefix("sha1:")
        number = lambda key: int(headers[key]) if key in headers else None
        if headers["warc-type"] == "revisit":
            return number("x-page-id"), url, int(headers["http-length"]), named, "revisit", number("x-refers-to-page"), None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != named:
            raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
        return number("x-page-id"), url, len(payload), digest, "response", None, payload

    def run(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][:len(names)]
        opened, file, buffer, base = None, None, b"", 0
        for batch in slices(batches):
            out = []
            for uri, url, offset, length in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if uri != opened:
                    if file:
                        file.close()
                    opened, file, buffer, base = uri, _open(uri), b"", 0
                if not base <= offset <= offset + length <= base + len(buffer):
                    base, buffer = offset, file.read_at(max(READ, length), offset)
                out.append(row(buffer[offset - base:offset - base + length], url)[:len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
        if file:
            file.close()

    dealt = index.repartition("path", F.floor(F.col("offset") / SECTION)).sortWithinPartitions("path", "offset")
    return dealt.select("path", "page_id", "url", "offset", "length").mapInArrow(run, schema)
