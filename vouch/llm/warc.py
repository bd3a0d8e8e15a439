"""WARC archives of Zstandard frames: writing with revisits, and a reader that validates."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouch.llm.batches import bound_batches
from vouch.session import materialize

# Fixed values of the formats.
_DICTIONARY_FRAME = 0x184D2A5D
_SKIPPABLE_MASK, _SKIPPABLE = 0xFFFFFFF0, 0x184D2A50
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20  # payload of an archive after which the next one begins
_STEP = 1 << 15


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id, url: str | None, payload: bytes, digest: str, first, date: str) -> bytes:
    """One record; ``first`` names the page whose response holds the payload, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if first is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_plain(url) if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RecordError(ValueError):
    """A record or frame that breaks the format."""


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ``RecordError`` where a header, length or digest is wrong."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in _VERSIONS:
        raise RecordError("no version line or no end of the headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or name != name.strip():
            raise RecordError(f"not a header: {name[:80]}")
        headers[name.lower()] = value.strip()
    for name in _REQUIRED:
        if name.lower() not in headers:
            raise RecordError(f"no {name}")
    if not headers["content-length"].isdecimal():
        raise RecordError("Content-Length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise RecordError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    block = rest[:length]
    wanted = headers.get("warc-block-digest")
    if wanted and wanted != f"sha1:{base32_sha1(block)}":
        raise RecordError("block digest differs")
    kind = headers["warc-type"]
    out = {"type": kind, "id": headers["warc-record-id"], "uri": headers.get("warc-target-uri"),
           "refers_to": headers.get("warc-refers-to"), "payload": None, "bytes": length,
           "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if kind in ("response", "revisit"):
        http, mark, body = block.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)\r?$", http)
        if not mark or not http.startswith(b"HTTP/") or not size:
            raise RecordError("no HTTP headers with a length")
        out["bytes"] = int(size[1])
        if kind == "response":
            if len(body) != out["bytes"]:
                raise RecordError("payload is not as long as its HTTP header says")
            if out["digest"] and out["digest"] != base32_sha1(body):
                raise RecordError("payload digest differs")
            out["payload"] = body
        elif body or not out["refers_to"]:
            raise RecordError("a revisit has no payload and names a record")
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(16 << 10, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small: their own bytes do
        return b"".join(samples)[: 16 << 10]


def pack_archive(records: list[bytes]) -> bytes:
    """A skippable frame with a dictionary trained on up to 200 records' beginnings, then a frame per record."""
    import zstandard

    content = _dictionary([r[:8192] for r in records[:: max(1, len(records) // 200)]])
    known = zstandard.ZstdCompressionDict(content)
    packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", _DICTIONARY_FRAME, len(content)), content, *map(packer.compress, records)])


def unpack_archive(data: bytes) -> Iterator[bytes]:
    """Decoded records, one per frame; raises ``RecordError`` where a frame is cut short or broken."""
    import zstandard

    view, at, known = memoryview(data), 0, None
    while at < len(data):
        if len(data) - at < 8:
            raise RecordError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & _SKIPPABLE_MASK == _SKIPPABLE:
            if len(data) - at - 8 < size:
                raise RecordError("skippable frame is cut short")
            if at == 0 and magic == _DICTIONARY_FRAME:
                content = bytes(view[8 : 8 + size])
                if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                known = zstandard.ZstdCompressionDict(content)
            at += 8 + size
            continue
        frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj() if known else (
            zstandard.ZstdDecompressor().decompressobj()
        )
        parts, fed = [], at
        try:
            while not frame.eof:
                if fed >= len(data):
                    raise RecordError("frame is cut short")
                parts.append(frame.decompress(view[fed : fed + _STEP]))
                fed = min(len(data), fed + _STEP)
        except zstandard.ZstdError as error:
            raise RecordError(f"frame at byte {at}: {error}") from error
        at = fed - len(frame.unused_data)
        yield b"".join(parts)


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """``page_id, url, payload, first``: ``first`` is the page whose response a revisit repeats, else null.

    Of equal payloads of ``min_bytes`` or more, that of the smallest id is the response; rows
    with that same id are all responses.  A null payload is an empty one.  Rows without id are
    revisits where an id has the payload, else responses.
    """
    own = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    many = (
        own.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("least"))
        .where("n > 1 and least is not null")
        .drop("n")
    )
    many = materialize(many, "copies")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return own.join(many, "sha", "left").select("page_id", "url", "payload", first.alias("first"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``plan_records`` rows as ``.warc.zst`` files below ``folder``; ``path, records`` of each.

    ``folder`` lies in a store that all executors share.  A task that runs again writes new files under new names;
    only those of the attempt that ended well are in the result, which is written before it is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)

        def flush(built: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pack_archive(built))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([len(built)], pa.int64())], names=["path", "records"]
            )

        built, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "first")]
            for row in zip(*columns, strict=True):
                page_id, url, payload, first = (v.as_py() for v in row)
                built.append(build_record(page_id, url, payload, base32_sha1(payload), first, date))
                size += len(built[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(built)
                    built, size = [], 0
        if built:
            yield flush(built)

    bound_batches(records.sparkSession)
    return materialize(records.mapInArrow(run, "path string, records bigint"), "archives")


def read_archives(paths: DataFrame, strict: bool = True) -> DataFrame:
    """``path, position, type, record_id, uri, refers_to, digest, bytes, payload, error`` of every record.

    ``paths`` has a column ``path``; one archive is one task's work at a time.  Headers, lengths and digests are
    checked; with ``strict`` a bad record ends the job, else it becomes a row with ``error`` set, and what follows a broken frame in its archive is lost.
    """
    schema = (
        "path string, position bigint, type string, record_id string, uri string, refers_to string, "
        "digest string, bytes bigint, payload binary, error string"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as stream:
                    data = stream.read()
                rows, size = [], 0
                position = 0
                try:
                    for position, raw in enumerate(unpack_archive(data)):  # noqa: B007
                        try:
                            r = parse_record(raw)
                        except RecordError as error:
                            if strict:
                                raise
                            rows.append((path, position, *[None] * 7, str(error)))
                            continue
                        rows.append((path, position, r["type"], r["id"], r["uri"], r["refers_to"], r["digest"],
                                     r["bytes"], r["payload"], None))
                        size += len(raw)
                        if size > 4 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except RecordError as error:
                    if strict:
                        raise
                    rows.append((path, position + 1, *[None] * 7, str(error)))
                if rows:
                    yield out(rows)

    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(tasks).mapInArrow(run, schema)
