"""WARC archives: pages are written as one gzip member per record, and read back by byte ranges.

Writing: payloads of at least 100 bytes that are equal are stored once, with the smallest page_id (``response``); the
others are ``revisit`` records that refer to it. Each task writes files of its own into the shared folder, named after the
task's attempt, and reports them; the reader takes only reported files, so what a lost attempt left is never read.

Reading: a file is cut into ranges. A task looks in its range for gzip magic, takes a candidate for a record if its header
decodes to a WARC header and what follows the member is the end of the file or such a member again, goes on from member to
member, and owns the records that begin inside its range. Payload size and digest of a response are computed from what
was read; a revisit has those of its header.

Defined cases: a null html is an empty payload; a null url has no target line; a null page_id counts as smaller than any
other and is read back as null; rows that repeat the smallest page_id of a payload are all responses.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from postwatch.llm import common

LEAST_SHARED = 100
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, n_bytes long, n_records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_NO_ID = -(1 << 63)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, first: the smallest page_id of an equal payload, where this page is to refer to it."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id"),
        "url",
        html.alias("html"),
        F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    shared = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    joined = rows.join(shared.where("n > 1").drop("n"), "digest", "left")
    return joined.select("page_id", "url", "html", "digest", "size", F.when(F.col("least") < F.col("page_id"), F.col("least")).alias("first"))


def _name(page_id: int) -> str:
    return f"<urn:page:{'none' if page_id == _NO_ID else page_id}>"


def _record(page_id: int, url: str | None, html: str, digest: str, size: int, first: int | None) -> bytes:
    block = _HTTP + (html.encode() if first is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}"]
    if first is not None:
        lines += [f"WARC-Refers-To: {_name(first)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out, task = [], None, TaskContext.get()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    done.append([f"{folder}/{name}", 0, 0])
                record = _record(*row)
                out.write(record)
                done[-1][1] += len(record)
                done[-1][2] += 1
                if done[-1][1] >= file_bytes:
                    close()
        close()
        paths, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "n_bytes", "n_records"]
        )

    return write


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of all pages in the folder (a URI); returns path, n_bytes, n_records of each, itself a written table."""
    return common.staged(verdicts(pages).mapInArrow(_writer(folder, file_bytes), MANIFEST), "warc-files")


class _File:
    """Bytes of an open file from a place on, fetched as they are needed."""

    def __init__(self, handle, start: int, size: int):
        self.handle, self.base, self.size, self.held = handle, start, size, b""

    def upto(self, end: int) -> None:
        """Hold the bytes before ``end``."""
        end = min(end, self.size)
        have = self.base + len(self.held)
        if end > have:
            self.handle.seek(have)
            self.held += self.handle.read(max(end - have, min(READ_BYTES, self.size - have)))

    def forget(self, before: int) -> None:
        if before - self.base >= READ_BYTES:
            self.held, self.base = self.held[before - self.base :], before

    def at(self, place: int, n: int) -> bytes:
        self.upto(place + n)
        return self.held[place - self.base : place - self.base + n]

    def find(self, mark: bytes, start: int, limit: int) -> int:
        """The first place in [start, limit) that begins with the mark, or -1."""
        self.upto(limit + len(mark))
        found = self.held.find(mark, start - self.base, limit - self.base + len(mark) - 1)
        return found + self.base if found >= 0 else -1


def _begins(file: _File, place: int) -> bool:
    """Whether a member at this place decodes to the header of a record."""
    unpack = zlib.decompressobj(31)
    head, step = b"", 512
    try:
        while b"\r\n\r\n" not in head and place < file.size and not unpack.eof:
            got = file.at(place, step)
            head += unpack.decompress(got, 1 << 16)
            place += len(got)
            if len(head) >= 6 and not head.startswith(b"WARC/1"):
                return False
    except zlib.error:
        return False
    return head.startswith(b"WARC/1") and b"\r\n\r\n" in head


def _member(file: _File, place: int) -> tuple[bytes, int] | None:
    """The content of the member at this place, and where it ends; None if it is damaged."""
    unpack, parts = zlib.decompressobj(31), []
    try:
        while not unpack.eof:
            got = file.at(place, 1 << 16)
            if not got:
                return None
            parts.append(unpack.decompress(got))
            place += len(got) - len(unpack.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), place


def _parsed(content: bytes) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    ids = [re.fullmatch(r"<urn:page:(-?\d+|none)>", fields[k])[1] if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
    page_id, refers_to = (None if x in (None, "none") else int(x) for x in ids)
    if fields["WARC-Type"] == "revisit":
        size, digest, payload = int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
    else:
        payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return page_id, fields.get("WARC-Target-URI"), fields["WARC-Type"], refers_to, size, digest, payload


def records(handle, size: int, start: int, end: int) -> Iterator[bytes]:
    """The contents of the records that begin in [start, end)."""
    file, place = _File(handle, start, size), start
    while 0 <= place < end:  # the first record of the range
        place = file.find(b"\x1f\x8b\x08", place, end)
        if place < 0:
            return
        if _begins(file, place) and (found := _member(file, place)) and (found[1] >= size or _begins(file, found[1])):
            break
        place += 1
    while place < end and place < size:
        found = _member(file, place)
        if found is None:
            raise ValueError(f"damaged member at byte {place}")
        yield found[0]
        place = found[1]
        file.forget(place)


def _reader(with_payload: bool):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(column.to_pylist() for column in batch.columns)):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as handle:
                    for content in records(handle, size, start, end):
                        row = _parsed(content)
                        rows.append(row if with_payload else (*row[:6], None))
                        held += len(row[6] or b"") * with_payload + 256
                        if held >= common.CHUNK_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read(files: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the files (path, n_bytes), read by ranges: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.where("n_bytes > 0").select("path", "n_bytes", begins).withColumn("end", F.col("start") + range_bytes)
    n_ranges = files.agg(F.sum(F.ceil(F.col("n_bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(int(n_ranges)).mapInArrow(_reader(with_payload), RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All pages written to a fresh folder and read back, without the payloads."""
    files = write(pages, common.fresh_dir(spark, "warc"))
    return read(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
