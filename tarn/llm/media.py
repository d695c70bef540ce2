"""Operator 7: media columns, typed by signature sniffing.

One Aho-Corasick automaton locates every magic number in the stored bytes; a validator for each format confirms structure
and lengths and says where the medium ends. A medium at offset 0 gives the column's type, which corrects the declared one;
media at other offsets are carved out. Magic numbers without a valid structure behind them are ignored.

Null media have no type (format null, sizes 0) and nothing to carve; empty ones are application/octet-stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ship

UNIT = 64
#: Fixed values of the formats: magic number, its offset in the medium, media type.
MAGIC = (
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
)


class Finder:
    """Finds byte strings from places that only grow; all searches for one string take one pass over the data."""

    def __init__(self, data: bytes):
        self.data, self.last = data, {}

    def find(self, what: bytes, start: int) -> int:
        at = self.last.get(what, -2)
        if at == -1 or at >= start:
            return at
        self.last[what] = at = self.data.find(what, start)
        return at


def _wav(b: memoryview) -> int | None:
    """Bytes of the RIFF/WAVE file at the start of b, if it is one: chunks fill it, fmt agrees with itself and precedes data."""
    if len(b) < 44 or bytes(b[8:12]) != b"WAVE":
        return None
    end = struct.unpack_from("<I", b, 4)[0] + 8
    at, fmt, data = 12, None, False
    while at + 8 <= end <= len(b):
        name, n = bytes(b[at : at + 4]), struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, at + 8)
            if fmt[4] != fmt[1] * fmt[5] // 8 or fmt[3] != fmt[2] * fmt[4] or not fmt[4]:
                return None
        data |= name == b"data" and fmt is not None and n % fmt[4] == 0
        at += 8 + n + n % 2
    return end if data and at >= end else None


def _png(b: memoryview) -> int | None:
    at, first = 8, True
    while at + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, at)[0], bytes(b[at + 4 : at + 8])
        if at + 12 + n > len(b) or first != (name == b"IHDR") or first and n != 13:
            return None
        if zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        at, first = at + 12 + n, False
        if name == b"IEND":
            return at
    return None


def _gif(b: memoryview) -> int | None:
    if len(b) < 14:
        return None
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 0x80 else 0)
    images = 0
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1 if images else None
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 <= len(b):
            flags = b[at + 9]
            at += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
            images += 1
        else:
            return None
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return None


def _bmp(b: memoryview) -> int | None:
    if len(b) < 54:
        return None
    size, zero, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, 2)
    if zero or planes != 1 or head not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or start < 14 + head or width <= 0:
        return None
    need = start + (width * bits + 31) // 32 * 4 * abs(height)
    return size if need <= size <= len(b) else None


def _jpeg(b: memoryview, f: Finder, start: int) -> int | None:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        if b[at + 1] == 0xDA:
            end = f.find(b"\xff\xd9", start + at)
            return end + 2 - start if end >= 0 else None
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return None
        at += 2 + n
    return None


def _pdf(b: memoryview, f: Finder, start: int) -> int | None:
    """To the last end mark before the next file: updates append marks of their own."""
    following = f.find(b"%PDF-", start + 5)
    end = f.data.rfind(b"%%EOF", start, following if following >= 0 else len(f.data))
    return end + 5 - start if end >= 0 and f.data.find(b"startxref", start, end) >= 0 else None


def _zip(b: memoryview, f: Finder, start: int) -> int | None:
    at = f.find(b"PK\x05\x06", start) - start
    if at < 0 or at + 22 > len(b):
        return None
    size, first, note = struct.unpack_from("<IIH", b, at + 12)
    return at + 22 + note if first + size == at and bytes(b[first : first + 4]) == b"PK\x01\x02" and at + 22 + note <= len(b) else None


def _flac(b: memoryview) -> int | None:
    """Metadata blocks, the first of which has plausible numbers, then a frame. The format doesn't say where it ends: to the end of the data."""
    if len(b) < 42 or b[4] & 0x7F or int.from_bytes(b[5:8], "big") != 34:
        return None
    least, most, rate = int.from_bytes(b[8:10], "big"), int.from_bytes(b[10:12], "big"), int.from_bytes(b[18:21], "big") >> 4
    if not 16 <= least <= most or not 0 < rate <= 655_350:
        return None
    at, last = 4, False
    while not last and at + 4 <= len(b):
        last = bool(b[at] & 0x80)
        at += 4 + int.from_bytes(b[at + 1 : at + 4], "big")
    return len(b) if last and at + 2 <= len(b) and b[at] == 0xFF and b[at + 1] & 0xFE == 0xF8 else None


def _ogg(b: memoryview) -> int | None:
    at, last = 0, False
    while at + 27 <= len(b) and bytes(b[at : at + 4]) == b"OggS" and b[at + 4] == 0 and not last:
        segments = b[at + 26]
        if at + 27 + segments > len(b):
            return None
        last = bool(b[at + 5] & 4)
        at += 27 + segments + sum(b[at + 27 : at + 27 + segments])
    return at if last and at <= len(b) else None


#: Validators that search for where a medium ends, rather than step from length to length.
SEARCHING = {"image/jpeg", "application/pdf", "application/zip"}
VALID = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/bmp": _bmp, "image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip, "audio/flac": _flac, "audio/ogg": _ogg}


def automaton():
    """Over bytes as Latin-1 text, which maps each byte to one character."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) + offset - 1, kind))
    a.make_automaton()
    return a


def sniff(data: bytes, a) -> list[tuple[int, int, str]]:
    """(start, bytes, media type) of the valid media in data, none within another, by start."""
    out, free, view, finder = [], 0, memoryview(data), Finder(data)
    for end, (back, kind) in a.iter(data.decode("latin-1")):
        start = end - back
        if start >= free and (n := VALID[kind](view[start:], finder, start) if kind in SEARCHING else VALID[kind](view[start:])):
            out.append((start, n, kind))
            free = start + n
    return out


def to_wav(payload: bytes) -> bytes:
    """The payload as mono samples of 8 bits at 8 kHz."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(data: bytes) -> bytes:
    """The samples of a WAVE file, found by walking its chunks."""
    at = 12
    while data[at : at + 4] != b"data":
        n = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + n + n % 2
    return data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = automaton()
    for b in batches:
        cols = {k: [] for k in ("format", "corrected", "bytes", "carved")}
        for x, declared in zip(b.column("media"), b.column("declared").to_pylist(), strict=True):
            data = x.as_py()
            found = sniff(data, a) if data else []
            at0 = next((f for f in found if f[0] == 0), None)
            kind = None if data is None else at0[2] if at0 else "application/octet-stream"
            cols["format"].append(kind)
            cols["corrected"].append(None if kind is None else kind != declared)
            cols["bytes"].append(at0[1] if at0 else len(data or b""))
            cols["carved"].append([{"start": s, "format": k, "media": data[s : s + n]} for s, n, k in found if s])
        carved = pa.list_(pa.struct([("start", pa.int64()), ("format", pa.string()), ("media", pa.binary())]))
        arrays = [pa.array(cols["format"], pa.string()), pa.array(cols["corrected"], pa.bool_()), pa.array(cols["bytes"], pa.int64()), pa.array(cols["carved"], carved)]
        yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "format", "corrected", "bytes", "carved"])


def type_media(rows: DataFrame, key: str, media: str, declared: str) -> DataFrame:
    """key, media, declared, format (sniffed), corrected (it differs from the declared one), bytes (of the medium at 0) and carved media."""
    ship(rows.sparkSession)
    rows = rows.select(F.col(key).alias("key"), F.col(media).alias("media"), F.col(declared).alias("declared"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", format string, corrected boolean, bytes bigint, carved array<struct<start:bigint,format:string,media:binary>>"
    return rows.mapInArrow(_typed, out).withColumnRenamed("key", key)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, n_bytes, media, declared)."""
    for b in batches:
        raw = [(x.as_py() or "").encode() for x in b.column(1)]
        media = [to_wav(r + b"\0" * ((-len(r)) % UNIT or UNIT * (not r))) for r in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary()), pa.array(["application/octet-stream"] * len(raw))], names=["doc_id", "n_bytes", "media", "declared"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Every text as UTF-8, filled with zero bytes to a positive multiple of 64, in a WAVE file. Null is empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored, "doc_id bigint, n_bytes bigint, media binary, declared string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sniffs the stored bytes, reads the samples back and digests them."""
    a = automaton()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for key, n, x in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media"), strict=True):
            data = x.as_py()
            found = sniff(data, a)
            if not found or found[0] != (0, len(data), "audio/wav"):
                raise ValueError(f"document {key}: its medium does not read back as one WAVE file")
            payload = from_wav(data)
            inner = sniff(payload, a)
            feature = f"{found[0][2]};rate=8000;bits=8;samples={len(payload)};embedded=" + ",".join(f"{k}@{s}+{m}" for s, m, k in inner)
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


def digest_media(media: DataFrame) -> DataFrame:
    """Digest columns of rows of store_texts(). The two map steps run in one task, without a shuffle."""
    return media.mapInArrow(_read, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
