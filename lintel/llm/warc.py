"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damaged archives still hold."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import fresh_path, stored
from lintel.llm.words import columns, parts

#: Compressed bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 16 << 20
#: Compressed bytes that the reader takes at once.
STEP = 1 << 14
RECORDS = "path string, offset long, length long, kind string, reason string, record_id string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters and spaces as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, target: str | None, payload: bytes, refers_to: str | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed. With refers_to it is a revisit: HTTP headers, which tell the payload's size, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean(target)}"] if target else []),
        *([f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _parse(data: bytes, at: int) -> tuple[int, dict]:
    """The record that begins at `at`: its end and fields. ValueError if anything about it doesn't hold."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    blank = re.compile(rb"\r?\n\r?\n").search(data, at)
    if not blank:
        raise ValueError("headers don't end")
    try:
        lines = data[at : blank.start()].decode().splitlines()[1:]
    except UnicodeDecodeError:
        raise ValueError("headers aren't UTF-8") from None
    head: dict[str, str] = {}
    torn = _VERSION.search(data, at + 1, blank.start() + 2)
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header without a colon")
        if torn and name.strip().lower() in head:
            raise ValueError("the headers are torn, and another record's follow")
        head[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise ValueError("no content length")
    end = blank.end() + int(head["content-length"])
    block = data[blank.end() : end]
    if end > len(data):
        raise ValueError("the block is cut short")
    if (said := head.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest_of(block):
        raise ValueError("the block's digest differs")
    tail = re.compile(rb"(\r?\n){2}").match(data, end)
    if not tail:
        raise ValueError("no blank lines after the block")
    kind, payload, size = head.get("warc-type", ""), block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("HTTP headers don't end")
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(found[1]) if kind == "revisit" and found else len(payload)
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and said and said != digest_of(payload):
        raise ValueError("the payload's digest differs")
    bare = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x or None
    return tail.end(), {"kind": kind, "record_id": bare(head.get("warc-record-id")), "refers_to": bare(head.get("warc-refers-to")), "target": head.get("warc-target-uri"), "payload_digest": said or None, "payload_bytes": size, "payload": None if kind == "revisit" else payload}


def _later(data: bytes, at: int, stop: int) -> int:
    """Where the next version line after `at` begins, or stop. What was torn may end without a newline: a version string
    inside a line counts if a whole record begins there."""
    for hit in _VERSION.finditer(data, at + 1):
        if hit.start() >= stop:
            break
        if data[hit.start() - 1] == 10:
            return hit.start()
        try:
            _parse(data, hit.start())
        except ValueError:
            continue
        return hit.start()
    return stop


def _plain(data: bytes) -> Iterator[tuple[int, int, dict]]:
    """(start, end, fields) of records and gaps of uncompressed bytes."""
    at = 0
    while at < len(data):
        try:
            end, found = _parse(data, at)
        except ValueError as e:
            end, found = _later(data, at, len(data)), {"kind": "gap", "reason": str(e)}
        yield at, end, found
        at = end


def _next_start(data: bytes, at: int) -> int:
    """Where the next member or version line after `at` may begin."""
    found = data.find(_MAGIC, at + 1)
    return _later(data, at, found if found > at else len(data))


def salvage(data: bytes) -> Iterator[tuple[int, int, dict]]:
    """(start, end, fields) for all that an archive holds, in order. Where a check fails, goes on at the next member that
    can be read (or the next version line, if nothing is compressed), and yields the bytes between as kind 'gap'."""
    at, gap, why = 0, None, ""
    while at < len(data):
        if data.startswith(_MAGIC, at):
            inflate = zlib.decompressobj(31)
            try:
                # In steps: what follows the member must not be copied for each member.
                some, fed = [], at
                while not inflate.eof and fed < len(data):
                    some.append(inflate.decompress(data[fed : fed + STEP]))
                    fed += STEP
                plain = b"".join(some)
                if not inflate.eof:
                    raise zlib.error("the member is cut short")
                if gap is not None and not _VERSION.search(plain):
                    raise zlib.error("no record in the member")
            except zlib.error as e:
                gap, why = (at, str(e)) if gap is None else (gap, why)
            else:
                if gap is not None:
                    yield gap, at, {"kind": "gap", "reason": why}
                    gap = None
                end = min(fed, len(data)) - len(inflate.unused_data)
                for _, _, found in _plain(plain):
                    yield at, end, found
                at = end
                continue
        elif _VERSION.match(data, at):
            if gap is not None:
                yield gap, at, {"kind": "gap", "reason": why}
                gap = None
            try:
                end, found = _parse(data, at)
                yield at, end, found
                at = end
                continue
            except ValueError as e:
                gap, why = at, str(e)
                at = _next_start(data, at)
                continue
        elif gap is None:
            gap, why = at, "neither a member nor a version line"
        at = _next_start(data, at)
    if gap is not None:
        yield gap, len(data), {"kind": "gap", "reason": why}


def write_archives(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row of pages into the shared folder; returns the manifest (path, n_records, n_bytes).

    Of rows with equal payloads (html as UTF-8, null as empty) of at least least_bytes, those with the largest key become
    responses, the others revisits of it; all others are responses. A null key is never the largest unless all are null;
    then each is a response. Only archives in the manifest count: what a lost or repeated task has left beside them is
    never read. Equal payloads meet as digests: the group's largest key is an aggregate, joined back on the digest.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first.withColumnRenamed("sha", "other"), (F.col("sha") == F.col("other")) & (F.octet_length("payload") >= least_bytes), "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        held: list[bytes] = []
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            name = f"{base}/{uuid.uuid4().hex}.warc.gz"
            with fs.open_output_stream(name, compression=None) as f:
                f.write(b"".join(held))
            done.append((name.rpartition("/")[2], len(held), sum(map(len, held))))
            held.clear()

        size = 0
        for batch in parts(batches):
            for page, target, payload, to in zip(*columns(batch, "page_id", "url", "payload", "first"), strict=True):
                name = f"urn:lintel:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
                held.append(member(record(name, target, payload, f"urn:lintel:page:{to}" if to is not None and page != to else None)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    size = 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)] if done else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], ["path", "n_records", "n_bytes"])

    return stored(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest").withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))


def read_archives(files: DataFrame) -> DataFrame:
    """Records and gaps of files (path string, content binary): RECORDS. kind is the record's type, or 'gap' with a reason
    for quarantined bytes [offset, offset + length). Null or empty content holds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in parts(batches, 1):
            held: list[dict] = []
            for path, content in zip(*columns(batch, "path", "content"), strict=True):
                for start, end, found in salvage(content or b""):
                    held.append({"path": path, "offset": start, "length": end - start} | found)
                    if len(held) >= 500:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content").mapInArrow(run, RECORDS)


def stored_archives(manifest: DataFrame) -> DataFrame:
    """(path, content) of the archives that a manifest lists, one file a task."""
    folder = (manifest.first() or {"path": ""})["path"].rpartition("/")[0]
    if not folder:
        return manifest.sparkSession.createDataFrame([], "path string, content binary")
    found = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return found.join(manifest.select(name("path").alias("name")), name(found["path"]) == F.col("name"), "left_semi").select("path", "content")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, reads them back, and returns what the records say of each page."""
    found = read_archives(stored_archives(write_archives(pages)))
    number = lambda c: F.regexp_extract(c, r"^urn:lintel:page:(-?\d+)$", 1)
    return found.select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.when(number("refers_to") != "", number("refers_to").cast("long")).alias("refers_to"),
    )
