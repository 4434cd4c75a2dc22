"""Web archives packed in ZIP files: written by Spark tasks, and read by byte ranges without extraction.

A package holds ``archive/data.warc.gz`` (a gzip member for each record), ``indexes/index.cdxj`` (a line for each
record: where it is) and ``datapackage.json``, all stored without compression. The reader takes the last bytes of a
package, finds the end of the central directory (or the ZIP64 one that it points to), locates the members, reads the index
and then only the records that are asked for. Packages are never unpacked, and the records of one package can be read by many tasks.

Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response and the others
revisit it. The smallest ids are found by a grouped minimum over digests; pages meet their group by digest in a join, whose
large partitions adaptive execution splits, so a payload that a third of the pages share is not one task.

A task writes its package under a name of its own attempt and returns it; only packages of attempts that were committed are
in the manifest, which is a table. A repeated attempt writes anew, a lost executor loses nothing.

Defined cases: a null html is an empty payload; a null url is written as ``urn:page:`` and the id; rows that repeat id and
payload are all responses if the id is the smallest; a row with a null id is a response when no row with an id has its
payload, else it revisits that row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.session import durable, shared_dir

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Records of one package at most; a task goes on with a further package.
RECORDS = 20_000
#: Packages whose indexes one task reads, bytes of packages that one task reads records from, and of a run of neighbours.
PACKAGES = 4
READ = 16_000_000
RUN = 4_000_000

# Fixed values of the ZIP format: signatures and the layout of the records that the reader needs.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, LOCATOR64_SIZE, END64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a folder: a URI that Arrow knows (s3a as s3), or a path that all executors mount."""
    if "://" in path or path.startswith("file:"):
        uri = path.replace("s3a://", "s3://", 1)
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), path


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: str) -> tuple[bytes, dict]:
    """A WARC record and its index entry. ``refers_to`` is None for a response."""
    target = url or f"urn:page:{page_id}"
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Date: {when}", f"WARC-Target-URI: {_escaped(target)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0), {"url": target, "digest": payload_digest(payload), "type": kind}


def parse_record(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of a record; checks the digest."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    if response and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"damaged record of page {fields.get('WARC-Page-ID')}")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {
        "page_id": number("WARC-Page-ID"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page"), "payload": payload if response else None,
    }


def _escaped(url: str) -> str:
    """White space and control characters as percent codes: a url is one word of one line."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def sort_key(url: str) -> str:
    """Host reversed, then the path: the order of an index."""
    scheme, mark, rest = _escaped(url).partition("://")
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash or '/'}{path}" if mark and host else _escaped(url)


class PackageWriter:
    """Writes one package to a stream, forwards only."""

    def __init__(self, stream, when: str, zip64: bool = True):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)
        self.when, self.at, self.lines, self.zip64 = when, 0, [], zip64

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        raw, entry = record(page_id, url, payload, refers_to, self.when)
        self.data.write(raw)
        entry |= {"offset": self.at, "length": len(raw), "filename": DATA}
        stamp = "".join(c for c in self.when if c.isdigit())
        self.lines.append(f"{sort_key(entry['url'])} {stamp} {json.dumps(entry)}")
        self.at += len(raw)

    def close(self) -> None:
        self.data.close()
        for name, text in ((INDEX, "\n".join(sorted(self.lines))), (PACKAGE, json.dumps({
                "profile": "data-package", "resources": [{"path": DATA, "bytes": self.at}, {"path": INDEX}]}))):
            with self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64) as member:
                member.write(text.encode())
        self.zip.close()


class PackageReader:
    """Reads members of a package by ranges. ``read(offset, length)`` gives bytes of the file."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = self._directory()

    def _end(self) -> tuple[int, int, int]:
        """Number of entries, size and place of the central directory."""
        tail_at = max(0, self.size - END_SIZE - FULL16)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(END, 0, len(tail) - END_SIZE + len(END))
        while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(END, 0, at + len(END) - 1)
        if at < 0:
            raise ValueError("no ZIP file: the end of the central directory is missing")
        entries, length, place = struct.unpack_from("<HII", tail, at + 10)
        if tail[at - LOCATOR64_SIZE : at - LOCATOR64_SIZE + 4] == LOCATOR64 and at >= LOCATOR64_SIZE:
            end64 = struct.unpack_from("<Q", tail, at - LOCATOR64_SIZE + 8)[0]
            found = self.read(end64, END64_SIZE)
            if found[:4] != END64:
                raise ValueError("the ZIP64 end of the central directory is not where its locator says")
            entries, length, place = struct.unpack_from("<QQQ", found, 32)
        return entries, length, place

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Place of the local header and size of every stored member."""
        entries, length, place = self._end()
        directory, at, members = self.read(place, length), 0, {}
        for _ in range(entries):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, size, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", directory, at + 20)
            local = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + CENTRAL_SIZE : at + CENTRAL_SIZE + name_size].decode()
            extra = directory[at + CENTRAL_SIZE + name_size : at + CENTRAL_SIZE + name_size + extra_size]
            at += CENTRAL_SIZE + name_size + extra_size + note_size
            while len(extra) >= 4:
                kind, width = struct.unpack_from("<HH", extra)
                if kind == EXTRA64:  # holds, in this order, those of the fields that are full
                    wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    size = next(wide) if size == FULL32 else size
                    packed = next(wide) if packed == FULL32 else packed
                    local = next(wide) if local == FULL32 else local
                extra = extra[4 + width :]
            if method == 0 and packed == size:
                members[name] = (local, size)
        return members

    def start(self, name: str) -> int:
        """Where a member's bytes begin."""
        local, _ = self.members[name]
        header = self.read(local, LOCAL_SIZE)
        if header[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        name_size, extra_size = struct.unpack_from("<HH", header, 26)
        return local + LOCAL_SIZE + name_size + extra_size

    def member(self, name: str) -> bytes:
        return self.read(self.start(name), self.members[name][1])

    def index(self) -> list[dict]:
        """Entries of the index; their offsets are places in the package."""
        starts = {}
        entries = [json.loads(line.split(" ", 2)[2]) for line in self.member(INDEX).decode().split("\n") if line]
        for entry in entries:
            name = entry["filename"]
            if name not in starts:
                starts[name] = self.start(name)
            entry["offset"] += starts[name]
        return entries


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    firsts = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("digest", "first")
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_packages(spark: SparkSession, pages: DataFrame, folder: str, when: str, zip64: bool = True) -> DataFrame:
    """Writes packages into ``folder``; the manifest: path and bytes of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        writer = stream = name = None

        def finish() -> pa.RecordBatch:
            writer.close()
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["path", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                if writer is None:
                    name = f"{root}/{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(name)
                    writer = PackageWriter(stream, when, zip64)
                writer.add(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())
                if len(writer.lines) == RECORDS:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return durable(spark, pages.mapInArrow(run, "path string, bytes bigint"))


def locate(packages: DataFrame, folder: str) -> DataFrame:
    """path, offset, length of every record, from the packages' own indexes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                with store.open_input_file(path) as file:
                    entries = PackageReader(lambda at, n: file.read_at(n, at), size).index()
                entries.sort(key=lambda e: e["offset"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(entries), pa.string()), pa.array([e["offset"] for e in entries], pa.int64()),
                    pa.array([e["length"] for e in entries], pa.int64())], ["path", "offset", "length"])

    return packages.mapInArrow(run, "path string, offset bigint, length bigint")


FIELDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_records(places: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at (path, offset, length)."""
    names = [part.split()[0] for part in FIELDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        opened = path = None
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                for where, at, n in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length"))):
                    if where != path:
                        if opened is not None:
                            opened.close()
                        opened, path = store.open_input_file(where), where
                    rows.append(parse_record(opened.read_at(n, at)))
                    if not payloads:
                        rows[-1]["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
        if opened is not None:
            opened.close()

    return places.mapInArrow(run, FIELDS)


def archive(spark: SparkSession, pages: DataFrame, least: int = 0, when: str | None = None) -> DataFrame:
    """Writes the pages into packages in the shared folder and reads their records back."""
    when = when or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = shared_dir(spark, "packages")
    packages = write_packages(spark, with_revisits(pages, least), folder, when)
    # A package's records go to several tasks, each with a run of neighbouring places. The places are small next to what is
    # read for them, so the number of tasks comes from the packages, not from the size of the rows.
    count, size = packages.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    places = durable(spark, locate(packages.repartition(-(-count // PACKAGES) or 1, "path"), folder))
    tasks = -(-size // READ) or 1
    runs = places.repartition(tasks, "path", (F.col("offset") / RUN).cast("long")).sortWithinPartitions("path", "offset")
    return read_records(runs, folder, payloads=False).drop("payload")
