"""WARC archives compressed with Zstandard, one frame a record, with a dictionary.

An archive begins with a skippable frame that holds the dictionary; every record is one
frame. Archives are rows ``(path, content)``, as Spark's ``binaryFile`` source gives them,
so that the same reader takes files on any store and archives written by ``write_pages``.
Archives are cut at ``ARCHIVE_BYTES`` and never depend on one another.

Cases: null payloads and urls are empty; equal payloads, the empty one included, share one
response, the row with the largest id, and the others revisit it; of rows that repeat that
largest id one is the response, by its place in the table, which must not change between
two reads; null ids sort below all others; an empty table gives no archive; a frame that
is cut, a wrong length or digest raises ``WarcError``.

The reader takes foreign archives too. Only HTTP responses and revisits have a head before
the payload, with or without a length, and bodies in chunks are put together; of any other
record (``warcinfo``, ``request``, ``metadata``, ``resource``, ...) the block is the payload.
A record without a digest gets that of its payload; a revisit without a length has none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "content-length", "warc-date", "warc-type")

ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 8 << 20, 16 << 10, 4 << 10, 3
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}>"


def _head(value: object) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x1f%]", lambda m: f"%{ord(m[0]):02X}", str(value))


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, again: int | None = None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone; ``again`` tells rows of one id apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page if again is None else f"{page}/{again}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head += [("X-Page-Id", page)] * (page is not None) + [("X-Escaped", "percent")] * (_head(url or "") != (url or ""))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))] + [("X-Refers-To-Page", refers_to)] * (refers_to is not None)
    lines = "".join(f"{k}: {_head(v)}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and the block, after checking the form, the lengths and the digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on with the header before
            headers[name] += " " + line.strip().decode(errors="replace")
            continue
        raw_name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no header: {line[:80]!r}")
        name = raw_name.decode(errors="replace").strip().lower()
        headers[name] = value.strip().decode(errors="replace")
    if missing := [x for x in REQUIRED if x not in headers]:
        raise WarcError(f"missing {', '.join(missing)}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not match the record")
    return headers, rest[:-4]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def unchunked(body: bytes) -> bytes:
    """An HTTP body sent in chunks, put together."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]+)[ \t]*(;.*)?", body[at:end], re.S) if end >= 0 else None
        if size is None:
            raise WarcError("no length of a chunk")
        n, at = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise WarcError("a chunk is cut")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int | None, str]:
    """Length and bare digest of a record's payload, checked where the record holds it."""
    kind = headers["warc-type"]
    said = headers.get("warc-payload-digest", "")
    bare = said.partition(":")[2] if said.lower().startswith("sha1:") else ""
    if kind not in ("response", "revisit") or not headers.get("content-type", "").lower().startswith("application/http"):
        return (None, bare) if kind == "revisit" else (len(block), digest_of(block))
    http, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no HTTP head in the block")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    if kind == "revisit":
        return int(length[1]) if length else None, bare
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", http):
        body = unchunked(body)
    elif length and int(length[1]) != len(body):
        raise WarcError("the payload does not match its length")
    own = digest_of(body)
    if bare and bare.upper() != own:
        raise WarcError("the payload does not match its digest")
    return len(body), own


def pack(records: list[bytes]) -> bytes:
    """One archive: the dictionary's skippable frame, then a frame a record."""
    samples = [r[:SAMPLE_BYTES] for r in records]
    try:
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
        dictionary = zstd.train_dictionary(size, samples)
    except zstd.ZstdError:  # too few or too uniform records to train on: an empty dictionary frame
        dictionary = None
    body = zstd.ZstdCompressor(level=9).compress(dictionary.as_bytes()) if dictionary else b""
    engine = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary else zstd.ZstdCompressor(level=LEVEL)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body + b"".join(map(engine.compress, records))


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of one archive, a frame at a time."""
    at, engine = 0, zstd.ZstdDecompressor()
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        own = archive[8 : 8 + size]
        if len(own) < size:
            raise WarcError("the dictionary's frame is cut")
        if own[:4] == FRAME_MAGIC:
            own = zstd.ZstdDecompressor().decompress(own)
        if own:
            engine = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(own))
        at = 8 + size
    while at < len(archive):
        frame, out = engine.decompressobj(), []
        while not frame.eof:
            piece = archive[at : at + 16384]
            if not piece:
                raise WarcError("a frame is cut")
            try:
                out.append(frame.decompress(piece))
            except zstd.ZstdError as e:
                raise WarcError(f"a frame is damaged: {e}") from e
            at += len(piece) - len(frame.unused_data)
        yield b"".join(out)


def write_pages(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``(path, content)``: every page's record, in archives on the shared folder."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), body.alias("body")).withColumn("sha1", F.sha1("body"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    # The greatest id of every payload, how many rows have it, and the first of them; nulls are the least.
    top = rows.groupBy("sha1", "page").agg(F.count("*").alias("n"), F.min("uid").alias("first")).groupBy("sha1").agg(F.max(F.struct("page", "n", "first")).alias("top"))
    owners = cut(top.select("sha1", F.col("top.page").alias("owner"), F.when(F.col("top.n") > 1, F.col("top.first")).alias("first")), "warc-owners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = pa.array([f"pages-{uuid.uuid4().hex}.warc.zst"])
            return pa.RecordBatch.from_arrays([path, pa.array([pack(held)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for page_id, at, data, sha1, owner, first, uid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                again = uid if page_id == owner and first not in (None, uid) else None
                held.append(build_record(page_id, at, data, digest, owner, page_id != owner or again is not None, again))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    linked = rows.join(owners, "sha1", "left").select("page", "url", "body", "sha1", "owner", "first", "uid")
    return cut(linked.mapInArrow(run, "path string, content binary"), "warc-archives")


RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of ``(path, content)`` archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for headers, block in map(parse_record, unpack(archive.as_py())):
                    size, digest = payload_of(headers, block)
                    ids = [int(headers[k]) if k in headers else None for k in ("x-page-id", "x-refers-to-page")]
                    target = headers.get("warc-target-uri", "").removeprefix("<").removesuffix(">")
                    if "x-escaped" in headers:
                        target = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), target)
                    rows.append((ids[0], size, digest, headers["warc-type"], ids[1], target))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return archives.select("content").mapInArrow(run, RECORDS)
