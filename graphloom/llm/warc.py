"""WARC records in ZIP packages: a writer, and a reader that range-reads stored members without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per record, stored in the ZIP without further
compression) and ``indexes/index.cdxj``. The reader parses the end-of-central-directory record (ZIP64 where it is
used), the central directory and the members' local headers, reads the index by its byte range, and then reads
each record by its range alone: a package is never read or unpacked as a whole.

Packages are written by tasks to a folder that all executors share, to a temporary name and then renamed, so
a task that is run again replaces its own package and half-written ones are never read.

Input contract: a null payload counts as empty; payloads of any length are kept whole; of equal long payloads the
one with the largest key answers and the others revisit it; ties of repeated keys go to one row; null keys are written
as ``null``, and answer only if no other row does; null urls are written as ``urn:none``; an empty table gives no package
and an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import arrow_schema, scratch_path, short_batches, written

#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 1000
#: A task begins a new package beyond this many bytes.
PACKAGE_BYTES = 64 << 20
#: Fixed values of the ZIP format: signatures, and the marks of fields kept in the ZIP64 extra field.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATE = "2020-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder given as a path or a URI."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# --- writing -------------------------------------------------------------------------------------------------


def record(kind: str, url: str, key: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    """One WARC record; a revisit names the record that it refers to and holds no payload."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{key}>", "WARC-Date": DATE, "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(length)}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    fields |= {"Content-Type": "text/html", "Content-Length": str(len(payload))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def zip_package(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """The bytes of a ZIP with stored members; sizes and offsets go to ZIP64 fields where they must, or if asked to."""
    at, central = 0, []
    for name, parts in members:
        size, crc = sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        wide = zip64 or size >= FULL32 or at >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = FULL32 if wide else size
        yield struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if wide else 20, 0, 0, 0, 33, crc, shown, shown, len(name), len(extra)) + name.encode() + extra
        yield from parts
        far = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0, 0, 0, 33, crc, shown, shown, len(name), len(far), 0, 0, 0, 0, FULL32 if wide else at) + name.encode() + far)
        at += 30 + len(name) + len(extra) + size
    listed = b"".join(central)
    yield listed
    wide = zip64 or at >= FULL32 or len(central) >= FULL16
    if wide:
        yield struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(central), len(central), len(listed), at)
        yield struct.pack("<4sIQI", LOCATOR64, 0, at + len(listed), 1)
    n = FULL16 if wide else len(central)
    yield struct.pack("<4sHHHHIIH", END, 0, 0, n, n, FULL32 if wide else len(listed), FULL32 if wide else at, 0)


def write_packages(pages: DataFrame, folder: str, zip64: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes (key, url, payload, digest, refers_to) rows to packages under ``folder``; one row (path, records) per package."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        task, attempt, number = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        parts, lines, held = [], [], 0
        written_: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal parts, lines, held, number
            if not parts:
                return
            # the attempt is in the name: one that runs again may get its rows in another order
            name = f"{base}/part-{task:05d}-{attempt}-{number:04d}.wacz"
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{name}.tmp") as out:
                for piece in zip_package([(DATA, parts), (INDEX, ["".join(lines).encode()])], zip64):
                    out.write(piece)
            system.move(f"{name}.tmp", name)
            written_.append((name, len(lines)))
            parts, lines, held, number = [], [], 0, number + 1

        for batch in batches:
            for key, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                body = payload.encode()
                name = "null" if key is None else str(key)
                made = record("response" if refers_to is None else "revisit", url or "urn:none", name, digest, body if refers_to is None else b"", len(body), refers_to)
                member = gzip_member(made)
                lines.append(json.dumps({"key": key, "offset": held, "length": len(member)}) + "\n")
                parts.append(member)
                held += len(member)
                if held >= package_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in written_], pa.string()), pa.array([n for _, n in written_], pa.int64())], schema=arrow)

    return pages.mapInArrow(run, schema)


# --- reading -------------------------------------------------------------------------------------------------


def _wide(extra: bytes, shown: list[int]) -> list[int]:
    """Values with those that are marked as full taken from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, k, out = extra[at + 4 : at + 4 + size], 0, []
            for value in shown:
                if value == FULL32:
                    value = struct.unpack_from("<Q", field, k)[0]
                    k += 8
                out.append(value)
            return out
        at += 4 + size
    return shown


def central_directory(source, size: int) -> dict[str, tuple[int, int, int]]:
    """Of each member of an open package: (method, size as stored, offset of its local header)."""
    source.seek(max(0, size - 66_000))
    tail = source.read(66_000)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    *_, count, listed, start, _ = struct.unpack_from("<4sHHHHIIH", tail, at)
    if FULL32 in (listed, start) or count == FULL16:
        source.seek(max(0, size - len(tail) + at - 20))
        mark, _, where, _ = struct.unpack("<4sIQI", source.read(20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        source.seek(where)
        mark, *_, count, listed, start = struct.unpack("<4sQHHIIQQQQ", source.read(56))
        if mark != END64:
            raise ValueError("no ZIP64 end record")
    source.seek(start)
    data, at, members = source.read(listed), 0, {}
    for _ in range(count):
        mark, _, _, _, method, _, _, _, stored, plain, n, m, c, *_, offset = struct.unpack_from("<4sHHHHHHIIIHHHHHII", data, at)
        if mark != CENTRAL:
            raise ValueError("broken central directory")
        name, extra = data[at + 46 : at + 46 + n].decode(), data[at + 46 + n : at + 46 + n + m]
        _, stored, offset = _wide(extra, [plain, stored, offset])
        members[name] = (method, stored, offset)
        at += 46 + n + m + c
    return members


def member_start(source, member: tuple[int, int, int]) -> int:
    """Where a stored member's bytes begin."""
    method, _, offset = member
    if method:
        raise ValueError("only stored members can be range-read")
    source.seek(offset)
    *_, n, m = struct.unpack("<4sHHHHHIIIHH", source.read(30))
    return offset + 30 + n + m


def read_record(source, start: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record in a byte range."""
    source.seek(start)
    data = zlib.decompress(source.read(length), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_packages(spark: SparkSession, packages: DataFrame, folder: str, contents: bool = True) -> DataFrame:
    """One row per record of the packages in ``packages`` (path): key, url, record_type, payload_digest, payload_bytes, refers_to,
    ``verified`` (a response's payload, read back, has the named digest and length), and ``payload`` if asked for."""
    fields = [T.StructField("key", T.StringType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.StringType()), T.StructField("verified", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField("payload", T.BinaryType())] * contents)
    arrow = arrow_schema(schema)
    named = lambda x: None if x is None else x[len("<urn:page:") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as source:
                    members = central_directory(source, source.size())
                    at = member_start(source, members[INDEX])
                    source.seek(at)
                    index = source.read(members[INDEX][1]).decode().splitlines()
                    start = member_start(source, members[DATA])
                    for k in range(0, len(index), 500):
                        out: list[list] = [[] for _ in schema]
                        for line in map(json.loads, index[k : k + 500]):
                            head, payload = read_record(source, start + line["offset"], line["length"])
                            digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                            good = head["WARC-Type"] == "revisit" or (hashlib.sha1(payload).hexdigest() == digest and len(payload) == size)
                            row = (named(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], digest, size, named(head.get("WARC-Refers-To")), good, payload)
                            for column, value in zip(out, row, strict=False):
                                column.append(value)
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return packages.select("path").mapInArrow(run, schema)


# --- the operator --------------------------------------------------------------------------------------------


def archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES, zip64: bool = False) -> DataFrame:
    """Writes a record per row under ``folder``, long payloads once; returns the packages (path, records)."""
    short_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h"))
    rows = rows.withColumn("digest", F.sha1(F.col("h").cast("binary")))
    # digests alone are shuffled; only payloads met more than once come back
    again = rows.where(F.octet_length("h") >= revisit_bytes).groupBy("digest").agg(F.max("k").alias("answers"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = written(again, "revisits")
    small = again.limit(100_001).count() <= 100_000
    rows = rows.join(F.broadcast(again) if small else again, "digest", "left")
    refers = F.when(F.col("answers").isNotNull() & ~F.col("k").eqNullSafe(F.col("answers")), F.col("answers").cast("string"))
    return written(write_packages(rows.select("k", "u", "h", "digest", refers.alias("refers_to")), folder, zip64), "packages")


def query(spark, sf_dir: str) -> DataFrame:
    """Archives ``pages`` and reads the packages back."""
    folder = scratch_path(spark, "warc")
    packages = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    parts = max(spark.sparkContext.defaultParallelism, min(packages.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    records = read_packages(spark, packages.repartition(parts, "path"), folder, contents=False)
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    as_key = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return records.select(as_key("key").alias("page_id"), "payload_bytes", checked.cast("string").alias("payload_digest"), "record_type", as_key("refers_to").alias("refers_to"))


#: DuckDB's version of :func:`query`.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
q AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, payload_digest,
         CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS answers FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN answers IS NOT NULL AND answers <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN answers <> page_id THEN answers END AS refers_to
FROM q
"""
