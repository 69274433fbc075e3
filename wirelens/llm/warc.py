"""WARC archives: a deduplicating writer and a splittable reader.

Each record is a gzip member of its own. The writer fills archives of bounded size in the shared
folder; the reader cuts every archive into byte ranges and gives each to a task. A task scans its
range for the gzip magic, takes a candidate for a member only if it inflates to a WARC header and is
followed by another member or the end, owns the records that start inside its range and reads the last
one beyond the range's end. Records of other writers are read too: field names in any case, records
without an HTTP block (``warcinfo``, ``metadata``), digests of other kinds (not checked), missing fields.

Of equal payloads of at least ``min_bytes`` bytes, the one with the least page id is stored
(``response``), the others refer to it (``revisit``). Nulls: a null html is an empty payload; a null
url or page id leaves its header out; a null page id is never the least, unless no copy has one, in
which case all are responses. Copies that share the least id are all responses. An empty table gives
no archives and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import scratch

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 16 << 10
_TASKS = 100_000  # tasks that read ranges, at most
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, archive string, offset long")


def classify(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to) of every page.

    Only digests that occur twice or more are joined; they are stored first, so that a digest with
    very many copies can be split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    copies = scratch.table(
        rows.where(F.octet_length("html") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "copies")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (rows.join(copies, "digest", "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first"))


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}|{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str,
           refers_to: int | None, date: str) -> bytes:
    """One gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}",
                 f"Refers-To-Page-ID: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block
                           + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, path: str, archive_bytes: int = 64 << 20,
          date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write classified pages below ``path``; (archive, size, records) of the archives of successful tasks.

    A task attempt writes files of its own name, so a repeated attempt disturbs none, and only listed
    archives are read. The list is stored: reading it never writes again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        number, out, name, size, records = 0, None, "", 0, 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64)
                        for r in batch.slice(at, 64).to_pylist()):
                if out is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                    records = 0
                member = record(row["page_id"], row["url"], row["html"].encode(), row["digest"],
                                row["record_type"], row["refers_to"], date)
                out.write(member)
                size += len(member)
                records += 1
                if size >= archive_bytes:
                    out.close()
                    yield _listed(f"{path}/{name}", size, records)
                    out, number = None, number + 1
        if out is not None:
            out.close()
            yield _listed(f"{path}/{name}", size, records)

    path = shared_uri(pages.sparkSession, path)
    return scratch.table(
        pages.select("page_id", "url", "html", "digest", "record_type", "refers_to")
        .mapInArrow(run, "archive string, size long, records long"), "archives")


def shared_uri(spark: SparkSession, path: str) -> str:
    """``path``, made, as a URI that tasks on any machine resolve alike: a folder without a scheme lies
    in Hadoop's default file system, not on the disk of whoever opens it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    uri = system.makeQualified(hadoop).toString()
    scheme, rest = uri.split(":", 1)
    if scheme == "file" and not rest.startswith("//"):
        return f"file://{rest}"
    return f"{'s3' if scheme == 's3a' else scheme}:{rest}"


def _listed(name: str, size: int, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([records])],
                                      ["archive", "size", "records"])


@dataclass
class Member:
    end: int
    head: dict[str, str]
    length: int  # of the payload in the record
    digest: str
    payload: bytes | None


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that is none is an error."""
    pairs = [line.split(":", 1) for line in lines if line]
    return {name.strip().lower(): value.strip() for name, value in pairs}


class Archive:
    """Byte positions of an open archive, read a window at a time."""

    def __init__(self, file: pa.NativeFile, size: int, window: int = 1 << 20) -> None:
        self.file, self.size, self.window, self.base, self.held = file, size, window, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``pos`` on."""
        n = min(n, self.size - pos)
        if pos < self.base or pos + n > self.base + len(self.held):
            self.file.seek(pos)
            self.base, self.held = pos, self.file.read(max(n, self.window))
        return self.held[pos - self.base:pos - self.base + max(n, 0)]

    def magic(self, pos: int, end: int) -> int | None:
        """First candidate that starts in [pos, end)."""
        while pos < end:
            part = self.at(pos, min(_STEP, end - pos + len(MAGIC) - 1))
            hit = part.find(MAGIC)
            if hit >= 0:
                return pos + hit if pos + hit < end else None
            pos += max(1, len(part) - len(MAGIC) + 1)
        return None

    def member(self, pos: int, with_payload: bool) -> Member | None:
        """The record that starts at ``pos``; None if the bytes there are not one."""
        inflate, head, left = zlib.decompressobj(31), bytearray(), 0
        fields: dict[str, str] | None = None
        http: bytes | None = b""
        digest, length, kept = hashlib.sha256(), 0, bytearray()
        at = pos
        try:
            while not inflate.eof:
                part = self.at(at, _STEP)
                if not part:
                    return None
                at += len(part)
                data = inflate.decompress(part)
                if fields is None:
                    seen = max(0, len(head) - 3)
                    head += data
                    if not b"WARC/1.".startswith(head[:7]):
                        return None
                    if head.find(b"\r\n\r\n", seen) < 0:  # a header may be of any length
                        continue
                    top, data = bytes(head).split(b"\r\n\r\n", 1)
                    fields = _fields(top.decode().split("\r\n")[1:])
                    left = int(fields["content-length"])
                    if not fields.get("content-type", "").startswith("application/http"):
                        http = None
                data = data[:left]
                left -= len(data)
                if http is not None:
                    http += data
                    if b"\r\n\r\n" not in http:
                        continue
                    top, data = http.split(b"\r\n\r\n", 1)
                    inner = _fields(top.decode("latin-1").split("\r\n")[1:])
                    if "content-length" in inner:
                        fields["http-length"] = inner["content-length"]
                    http = None
                digest.update(data)
                length += len(data)
                if with_payload:
                    kept += data
        except (zlib.error, ValueError, KeyError):
            return None
        end = at - len(inflate.unused_data)
        # a member inside the block of a larger record is followed by other bytes of that record
        if fields is None or left or self.at(end, len(MAGIC)) not in (MAGIC, b""):
            return None
        return Member(end, fields, length, digest.hexdigest(),
                      bytes(kept) if with_payload else None)

    def members(self, start: int, end: int, with_payload: bool) -> Iterator[tuple[int, Member]]:
        pos: int | None = start
        end = min(end, self.size)
        while (pos := self.magic(pos, end)) is not None:
            found = self.member(pos, with_payload)
            if found is None:
                pos += 1
                continue
            yield pos, found
            pos = found.end


def read(archives: DataFrame, range_bytes: int = 16 << 20,
         with_payload: bool = False) -> DataFrame:
    """One row per record of the listed archives (archive, size); stored payloads are checked against
    their digest. ``payload`` (null for revisits) comes only if asked for."""
    ranges = archives.select("archive", "size", F.explode(
        F.expr(f"sequence(0L, size - 1, {range_bytes}L)")).alias("start"))
    # their number is given: the rows are tiny, and adaptive execution would merge them into one task
    tasks = max(1, min(_TASKS, ranges.count()))
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(job["archive"])
                with system.open_input_file(path) as file:
                    rows = []
                    archive = Archive(file, job["size"])
                    for pos, m in archive.members(job["start"], job["start"] + range_bytes,
                                                  with_payload):
                        rows.append(_row(job["archive"], pos, m, with_payload))
                        if len(rows) == (64 if with_payload else 1024):
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    return ranges.repartition(tasks).mapInArrow(
        run, RECORDS + (", payload binary" if with_payload else ""))


def _row(archive: str, pos: int, m: Member, with_payload: bool) -> tuple:
    head = m.head
    kind = head.get("warc-type", "")
    named = head.get("warc-payload-digest", "")
    told = named.removeprefix("sha256:").lower() if named.startswith("sha256:") else None
    if kind != "revisit" and told is not None and m.digest != told:
        raise ValueError(f"damaged record at {pos} of {archive}")
    size = int(head.get("http-length", m.length)) if kind == "revisit" else m.length
    digest = (told or named or None) if kind == "revisit" else m.digest
    page, refers = head.get("page-id"), head.get("refers-to-page-id")
    row = (page and int(page), size, digest, kind, refers and int(refers),
           head.get("warc-target-uri"), archive, pos)
    return row + ((None if kind == "revisit" else m.payload,) if with_payload else ())


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
             pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Archive all pages in the shared folder and read the records back; an error if an archive gives
    other than the records written to it."""
    path = scratch.new_path(pages.sparkSession, "warc")
    archives = write(classify(pages, min_bytes), path)
    return whole(scratch.table(read(archives), "records"), archives)


def whole(rows: DataFrame, archives: DataFrame) -> DataFrame:
    """``rows`` read from ``archives``, after their records have been counted."""
    wrong = (archives.join(rows.groupBy("archive").agg(F.count("*").alias("n")), "archive", "left")
             .where("records <> coalesce(n, 0)").first())
    if wrong:
        raise ValueError(f"{wrong['archive']}: {wrong['n'] or 0} of {wrong['records']} records read")
    return rows
