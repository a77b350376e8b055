"""Media columns: signature sniffing, correction of declared types, carving.

An Aho-Corasick automaton over the magic bytes finds where a format may begin; that
format's validator then checks structure and lengths and says how long the file is. A
blob's type is that of the media validated at its start, whatever was declared; media
validated elsewhere are carved. ``store_wav`` is the lossless store for 8-bit samples.

Cases: null or empty blobs have no media and keep their declared type; damaged or cut
media are not validated; a long blob is scanned once, and only its row is held.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE = 64, 8000

# ---- validators: (bytes, start) -> (type, end) or None ----


def _png(b: memoryview, at: int):
    i = at + 8
    first = True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or (first and (kind, n) != (b"IHDR", 13)):
            return None
        if zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return "image/png", i
    return None


def _jpeg(b: memoryview, at: int):
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark = b[i + 1]
        if mark == 0xD9:
            return "image/jpeg", i + 2
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or not 0xC0 <= mark <= 0xFE:
            return None
        i += 2 + n
        if mark == 0xDA:  # entropy-coded data: up to the next marker that is neither stuffing nor a restart
            whole = b.obj
            while True:
                i = whole.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                elif b[i + 1] == 0xFF:
                    i += 1
                else:
                    break
    return None


def _gif(b: memoryview, at: int):
    if at + 13 > len(b):
        return None
    packed = b[at + 10]
    i = at + 13 + (3 << ((packed & 7) + 1)) * (packed >> 7)

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return "image/gif", i + 1
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            flags = b[i + 9]
            i = blocks(i + 11 + (3 << ((flags & 7) + 1)) * (flags >> 7))
        else:
            return None
    return None


def _bmp(b: memoryview, at: int):
    if at + 30 > len(b):
        return None
    size, reserved, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    fits = header in (40, 52, 56, 108, 124) and not reserved and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    if not fits or width <= 0 or not height or not 14 + header <= offset <= size or at + size > len(b):
        return None
    return ("image/bmp", at + size) if size >= offset + (width * depth + 31) // 32 * 4 * abs(height) else None


def _riff(b: memoryview, at: int):
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(bytes(form))
    if kind is None or end > len(b):
        return None
    names, i = [], at + 12
    while i + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, i)
        names.append(name)
        i += 8 + n + n % 2
    if i != end or (kind == "audio/wav" and not {b"fmt ", b"data"} <= set(names)):
        return None
    return kind, end


def _pdf(b: memoryview, at: int):
    end = b.obj.find(b"%%EOF", at)
    return ("application/pdf", end + 5) if end > 0 and b.obj.find(b"startxref", at, end) > 0 else None


def _zip(b: memoryview, at: int):
    end = b.obj.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
    good = at + offset + size == end and bytes(b[at + offset : at + offset + 4]) == b"PK\x01\x02" and end + 22 + comment <= len(b)
    return ("application/zip", end + 22 + comment) if good else None


def _gzip(b: memoryview, at: int):
    d, i = zlib.decompressobj(31), at
    try:
        while not d.eof and i < len(b):
            piece = d.unconsumed_tail or b[i : i + 65536]
            i += 0 if d.unconsumed_tail else len(piece)
            d.decompress(piece, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", i - len(d.unused_data)) if d.eof else None


def _ogg(b: memoryview, at: int):
    i = at
    while i + 27 <= len(b) and bytes(b[i : i + 5]) == b"OggS\0":
        flags, n = b[i + 5], b[i + 26]
        if (i == at) != bool(flags & 2) or i + 27 + n > len(b):
            return None
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
        if i > len(b):
            return None
        if flags & 4:
            return "audio/ogg", i
    return None


def _mp4(b: memoryview, at: int):
    i, names = at - 4, []
    if i < 0:
        return None
    while i + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, i)
        if not names and name != b"ftyp" or n < 8 or i + n > len(b):
            break
        names.append(name)
        i += n
    return ("video/mp4", i) if b"moov" in names else None


#: Magic bytes, the distance from a file's start to them, and the validator.
SIGNATURES: tuple[tuple[bytes, int, Callable], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, _png),
    (b"\xff\xd8\xff", 0, _jpeg),
    (b"GIF87a", 0, _gif),
    (b"GIF89a", 0, _gif),
    (b"BM", 0, _bmp),
    (b"RIFF", 0, _riff),
    (b"%PDF-", 0, _pdf),
    (b"PK\x03\x04", 0, _zip),
    (b"\x1f\x8b\x08", 0, _gzip),
    (b"OggS", 0, _ogg),
    (b"ftyp", 4, _mp4),
)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, back, check in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), back, check))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of every validated medium, in order; none lies inside an earlier one."""
    view, out, free = memoryview(blob), [], 0
    for last, (n, back, check) in _automaton().iter(blob.decode("latin-1")):
        at = last - n + 1
        if at - back < free:
            continue
        found = check(view, at)
        if found:
            out.append((at - back, found[1], found[0]))
            free = found[1]
    return out


def chunks(wav: bytes) -> dict[bytes, bytes]:
    out, i = {}, 12
    while i + 8 <= len(wav):
        name, n = struct.unpack_from("<4sI", wav, i)
        out[name] = wav[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    return out


def wav_of(raw: bytes) -> bytes:
    """Mono unsigned 8-bit PCM of ``raw``, padded with 0 to a positive multiple of 64; the true length is in ``qlen``."""
    data = raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sIQ", b"qlen", 8, len(raw)) + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def feature_of(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    high = x >= 128
    return f"wav/u8/{RATE};n={x.size};sum={total};squares={squares};peak={int(x.max())};crossings={int((high[1:] != high[:-1]).sum())}"


def store_wav(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, declared, media)``: each text's bytes as a WAV file, declared only as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            media = pa.array([wav_of(x or b"") for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["application/octet-stream"] * len(raw)), media], names=["key", "declared", "media"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "key bigint, declared string, media binary").withColumnRenamed("key", key)


SNIFFED = "media_type string, corrected boolean, media binary, carved array<struct<start:bigint,end:bigint,type:string>>"


def sniff_media(df: DataFrame, key: str, media: str = "media", declared: str = "declared") -> DataFrame:
    """Adds the type found, whether the declared one was wrong, and the spans of embedded media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))
        for batch in batches:
            kinds, wrong, carved = [], [], []
            for said, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = sniff(blob) if blob else []
                kind = found[0][2] if found and found[0][0] == 0 else said
                kinds.append(kind)
                wrong.append(kind != said)
                carved.append([{"start": s, "end": e, "type": t} for s, e, t in found if s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), batch.column(2), pa.array(carved, spans)],
                names=["key", "media_type", "corrected", "media", "carved"],
            )

    return df.select(F.col(key).alias("key"), F.col(declared).alias("declared"), F.col(media).alias("media")).mapInArrow(run, f"key bigint, {SNIFFED}").withColumnRenamed("key", key)


FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string, corrected boolean"


def wav_features(df: DataFrame, key: str) -> DataFrame:
    """Reads the samples of sniffed WAV files back and describes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", *(x.split()[0] for x in FEATURES.split(", "))]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            rows = []
            for k, kind, wrong, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind != "audio/wav":
                    raise ValueError(f"{k}: {kind} is no stored payload")
                own = chunks(blob)
                data = own[b"data"]
                rows.append((k, struct.unpack("<Q", own[b"qlen"])[0], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(data), kind, wrong))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return df.select(F.col(key).alias("key"), "media_type", "corrected", "media").mapInArrow(run, f"key bigint, {FEATURES}").withColumnRenamed("key", key)
