"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task turns its pages into archives of at most ``archive_mb`` of
frames. A file gets its name from the task and a random part, and only the
files named in the stored list of finished tasks are read, so a lost or
repeated task leaves no half archive in the result. Of pages with equal payload the
one with the smallest page_id is a response, the others are revisits of it.

Reading: a task opens an archive, loads the dictionary from the skippable
frame, decodes one frame at a time and checks version line, named headers, block
length, record end, digests and the length in the HTTP header.

Defined cases: a null html is an empty payload; a null page_id never is the
smallest, is written without page header and reads back as null; rows that
repeat the smallest id are all responses; a null url becomes the record's own
name; a url with control characters or blanks at its ends is percent-encoded in the archive
and decoded on reading. No pages, no archive. A broken record raises, or with
``on_error="report"`` gives a row with ``error`` set and ends that archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .rows import whole_text
from .store import new_path, stored

#: Magic number of the skippable frame that holds a dictionary; of any Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
NEEDED = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest", b"warc-block-digest"}
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, archive string, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record with its two closing line ends."""
    name = f"urn:x-page:{'none' if page_id is None else page_id}"
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    odd = url is not None and (url != url.strip() or not url.isprintable() or url == "")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", name if url is None else quote(url) if odd else url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head += [("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    if odd:
        head.append(("X-Target-URI-Quoted", "yes"))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; ValueError if it breaks the format."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no version line or no end of headers")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header without colon: {line[:60]!r}")
        fields[key.strip().lower()] = value.strip().decode()
    if missing := NEEDED - fields.keys():
        raise ValueError(f"missing headers: {sorted(missing)}")
    length = int(fields[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes where {length} are announced")
    block = rest[:length]
    if fields[b"warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(sizes) != 1:
        raise ValueError("no HTTP header with one length")
    kind, digest = fields[b"warc-type"], fields[b"warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != sizes[0] or base32_sha1(payload) != digest):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or b"warc-refers-to" not in fields):
        raise ValueError("revisit with payload or without target")
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind}")
    page = fields[b"warc-record-id"].strip("<>").removeprefix("urn:x-page:")
    target = fields.get(b"warc-refers-to", "").strip("<>").removeprefix("urn:x-page:")
    uri = fields.get(b"warc-target-uri")
    if b"x-target-uri-quoted" in fields:
        uri = unquote(uri)
    return {
        "page_id": None if page == "none" else int(page),
        "url": None if uri is None or uri == f"urn:x-page:{page}" else uri,
        "record_type": kind,
        "refers_to": int(target) if target else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": sizes[0],
        "payload_digest": digest,
    }


def make_dictionary(samples: list[bytes], size: int = 32_768):
    """A trained dictionary; from few samples, their raw bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:] or b"WARC/1.1\r\n"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary) -> bytes:
    data = dictionary.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def read_frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time. ``stream`` has read(n)."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("the dictionary frame is cut off")
    if data[:4] == FRAME_MAGIC:  # a dictionary may itself be compressed
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    rest = stream.read(chunk)
    while rest:
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or stream.read(chunk)
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame,
    folder: str,
    date: str = "2024-01-01T00:00:00Z",
    archive_mb: int = 64,
    min_revisit_bytes: int = 0,
    sample_records: int = 200,
) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``folder``; a stored list of archives: archive, n_records, n_bytes."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole_text("html").alias("html")
    ).withColumns({"digest": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    firsts = (
        rows.where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    tagged = rows.join(firsts, ["digest", "size"], "left").select(
        "page_id",
        "url",
        F.col("html").cast("binary").alias("payload"),
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        task, names, counts, sizes = TaskContext.get().partitionId(), [], [], []
        out = encoder = None
        sample: list[bytes] = []

        def begin() -> None:
            nonlocal out, encoder
            dictionary = make_dictionary(sample)
            encoder = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
            names.append(f"part-{task:05d}-{len(names):04d}-{uuid.uuid4().hex}.warc.zst")
            counts.append(0)
            out = system.open_output_stream(f"{base}/{names[-1]}", compression=None)
            frame = dictionary_frame(dictionary)
            out.write(frame)
            sizes.append(len(frame))

        def put(record: bytes) -> None:
            nonlocal out
            if out is None:
                begin()
            frame = encoder.compress(record)
            out.write(frame)
            counts[-1] += 1
            sizes[-1] += len(frame)
            if sizes[-1] >= archive_mb << 20:
                out.close()
                out = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                record = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                if encoder is None and len(sample) < sample_records:  # the first records make the dictionary
                    sample.append(record)
                    continue
                if encoder is None:
                    for held in sample:
                        put(held)
                put(record)
        if encoder is None:
            for held in sample:
                put(held)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["archive", "n_records", "n_bytes"],
        )

    return stored(tagged.mapInArrow(write, "archive string, n_records long, n_bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str, on_error: str = "raise", batch_rows: int = 64) -> DataFrame:
    """Records of the archives named in ``archives.archive`` under ``folder``, one row each; columns as in ``RECORD``."""
    schema = pa.schema(
        [(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[dict] = []
                try:
                    with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                        for data in read_frames(stream):
                            held.append(parse_record(data) | {"archive": name, "error": None})
                            if len(held) >= batch_rows:
                                yield pa.RecordBatch.from_pylist(held, schema)
                                held = []
                except Exception as problem:
                    if on_error != "report":
                        raise
                    held.append({"archive": name, "error": str(problem)})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written as archives in the shared folder and read back."""
    folder = new_path(spark, "warc")
    return read_archives(write_archives(pages, folder), folder)
