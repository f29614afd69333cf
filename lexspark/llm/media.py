"""Media columns: typing, checking and carving of binary payloads by signature.

``Sniffer`` finds magic bytes with one Aho-Corasick pass over the stored bytes; a
validator of each format then confirms structure and lengths at every place found.
The outermost confirmed object gives the true type, which corrects the declared one;
confirmed objects inside it are carved out. ``pack_samples``/``unpack_samples`` hold a
payload losslessly as 8-bit mono PCM samples in a RIFF/WAVE file.

Null or empty payloads are stored as one block of zero samples. Equal payloads give
equal values. An unknown type is ``application/octet-stream``. Empty tables give empty
results; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspark.llm.common import map_batches, text_bytes

BLOCK = 64
RATE = 8000
OCTETS = "application/octet-stream"


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """Zero bytes up to a positive multiple of ``block``."""
    return payload + bytes(max(block, -(-len(payload) // block) * block) - len(payload))


def pack_samples(payload: bytes) -> bytes:
    """A RIFF/WAVE file with the payload as unsigned 8-bit mono samples."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def unpack_samples(stored: bytes) -> bytes:
    """The samples of a RIFF/WAVE file with 8-bit mono PCM; ValueError for anything else."""
    found = riff_chunks(stored, 0)
    if found is None or found[0] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    chunks = {k: (at, n) for k, at, n in reversed(found[2])}
    if b"fmt " not in chunks or b"data" not in chunks:
        raise ValueError("no format or no data chunk")
    at, _ = chunks[b"fmt "]
    if struct.unpack_from("<HH", stored, at) != (1, 1) or struct.unpack_from("<H", stored, at + 14) != (8,):
        raise ValueError("not 8-bit mono PCM")
    at, n = chunks[b"data"]
    return stored[at : at + n]


# -- validators: (bytes, start) -> end of the object, or None ------------------------


class Value(bytes):
    """A binary value that is scanned once for what its validators look for, however many
    magic bytes ask."""

    def ahead(self, needle: bytes, at: int) -> int:
        """Where ``needle`` next stands from ``at`` on; -1 if nowhere. Asked in order."""
        known = self.__dict__.setdefault("_ahead", {})
        begin, place = known.get(needle, (len(self) + 1, -1))
        if begin > at or (place >= 0 and place < at):
            begin, place = known[needle] = at, self.find(needle, at)
        return place

    def archives(self) -> dict[int, int]:
        """Start and end of each zip archive: its end record says where it starts."""
        known = self.__dict__.get("_archives")
        if known is None:
            known, p = {}, self.find(b"PK\x05\x06")
            while p >= 0 and p + 22 <= len(self):
                size, offset, comment = struct.unpack_from("<IIH", self, p + 12)
                end = p + 22 + comment
                if end <= len(self):
                    known.setdefault(p - offset - size, end)
                p = self.find(b"PK\x05\x06", p + 4)
            self.__dict__["_archives"] = known
        return known


def riff_chunks(b: bytes, at: int) -> tuple[bytes, int, list[tuple[bytes, int, int]]] | None:
    """Form type, end, and (id, start, length) of the chunks of a RIFF object."""
    if len(b) < at + 12:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    end = at + 8 + size
    if size < 4 or end > len(b):
        return None
    chunks, p = [], at + 12
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        chunks.append((b[p : p + 4], p + 8, n))
        p += 8 + n + (n & 1)
    return (b[at + 8 : at + 12], end, chunks) if p >= end else None


def _wav(b: bytes, at: int) -> int | None:
    found = riff_chunks(b, at)
    if found is None or found[0] != b"WAVE" or not {b"fmt ", b"data"} <= {k for k, _, _ in found[2]}:
        return None
    return found[1]


def _webp(b: bytes, at: int) -> int | None:
    found = riff_chunks(b, at)
    return found[1] if found and found[0] == b"WEBP" and found[2] and found[2][0][0] in (b"VP8 ", b"VP8L", b"VP8X") else None


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n > 1 << 31 or p + 12 + n > len(b) or first != (kind == b"IHDR"):
            return None
        if struct.unpack_from(">I", b, p + 8 + n)[0] != zlib.crc32(b[p + 4 : p + 8 + n]):
            return None
        p += 12 + n
        if kind == b"IEND":
            return p
        first = False
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 13:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b):
            n = b[p]
            p += 1 + n
            if not n:
                return p
        return None

    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, scan = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        m = b[p + 1]
        if m == 0xFF:
            p += 1
            continue
        if m == 0xD9:
            return p + 2 if scan else None
        if m == 0x01 or 0xD0 <= m <= 0xD8:
            return None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None
        p += 2 + n
        if m == 0xDA:
            scan = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return p + 2 if scan and b[p : p + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, _, offset, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or head < 40 or at + size > len(b) or offset < 14 + head or offset > size:
        return None
    if struct.unpack_from("<I", b, at + 30)[0] == 0 and offset + (w * bits + 31) // 32 * 4 * abs(h) > size:
        return None
    return at + size


def _pdf(b: Value, at: int) -> int | None:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    end, xref = b.ahead(b"%%EOF", at), b.ahead(b"startxref", at)
    return end + 5 if 0 < xref and xref + 9 <= end else None


def _zip(b: Value, at: int) -> int | None:
    return b.archives().get(at)


def _gzip(b: bytes, at: int) -> int | None:
    d = zlib.decompressobj(31)
    try:
        for k in range(at, len(b), 1 << 16):
            d.decompress(b[k : k + (1 << 16)])
            if d.eof:
                return min(len(b), k + (1 << 16)) - len(d.unused_data)
    except zlib.error:
        pass
    return None


def _flac(b: bytes, at: int) -> int | None:
    return len(b) if len(b) >= at + 42 and b[at + 4] & 127 == 0 and int.from_bytes(b[at + 5 : at + 8]) == 34 else None


def _ogg(b: bytes, at: int) -> int | None:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        n = b[p + 26]
        last = b[p + 5] & 4
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if last:
            return p
    return None


#: Magic bytes, media type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int | None]], ...] = (
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
)


@dataclass(frozen=True)
class Found:
    media_type: str
    start: int
    end: int


class Sniffer:
    """Confirmed objects in binary values; magic bytes found in one pass."""

    def __init__(self) -> None:
        self.machine = ahocorasick.Automaton()
        by: dict[bytes, list] = {}
        for magic, kind, check in FORMATS:
            by.setdefault(magic, []).append((kind, check))
        for magic, checks in by.items():
            self.machine.add_word(magic.decode("latin-1"), (len(magic), checks))
        self.machine.make_automaton()

    def objects(self, stored: bytes) -> list[Found]:
        """All confirmed objects by start, outer ones before those inside them."""
        out, value = [], Value(stored)
        for last, (n, checks) in self.machine.iter(stored.decode("latin-1")):
            at = last - n + 1
            for kind, check in checks:
                end = check(value, at)
                if end is not None:
                    out.append(Found(kind, at, end))
                    break
        return sorted(out, key=lambda f: (f.start, -f.end))

    def sniff(self, stored: bytes, declared: str | None = None) -> tuple[str, bool, list[Found]]:
        """The true type (of an object at the start), whether the declared type had to
        be corrected, and the objects embedded in the value."""
        found = self.objects(stored)
        kind = found[0].media_type if found and found[0].start == 0 else OCTETS
        return kind, declared is not None and declared != kind, found[kind != OCTETS :]


@lru_cache(maxsize=1)
def sniffer() -> Sniffer:
    return Sniffer()


def sniff_column(df: DataFrame, data_col: str, id_col: str, declared_col: str | None = None) -> DataFrame:
    """Per row: ``id_col``, ``media_type``, ``corrected``, and ``embedded``, an array of
    the objects carved out (type, start, end, their bytes). Null data gives a null type."""
    kind = dict(df.dtypes)[id_col]
    schema = f"{id_col} {kind}, media_type string, corrected boolean, embedded array<struct<media_type:string,start:long,end:long,content:binary>>"
    part = pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.binary())])

    def run(batches):
        s = sniffer()
        for batch in batches:
            said = batch.column(declared_col).to_pylist() if declared_col else [None] * batch.num_rows
            rows = []
            for x, d in zip(batch.column(data_col).to_pylist(), said, strict=True):
                media_type, corrected, found = (None, False, []) if x is None else s.sniff(x, d)
                rows.append((media_type, corrected, [{"media_type": f.media_type, "start": f.start, "end": f.end, "content": x[f.start : f.end]} for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.list_(part))],
                names=[id_col, "media_type", "corrected", "embedded"],
            )

    return map_batches(df.select(id_col, data_col, *([declared_col] if declared_col else [])), run, schema)


def feature(samples: bytes, kind: str, corrected: bool, embedded: list[Found]) -> str:
    """Type, correction, objects carved, and figures of the samples: mean, zero
    crossings of the signal about 128, entropy of the sample values in bits."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    signs = x >= 128
    names = ",".join(f"{f.media_type}@{f.start}-{f.end}" for f in embedded) or "none"
    return f"type={kind};corrected={int(corrected)};embedded={names};samples={len(x)};mean={x.mean():.4f};crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = OCTETS) -> DataFrame:
    """Store each text as samples: ``id_col, n_bytes, media (binary), media_type, corrected``."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        s = sniffer()
        for batch in batches:
            data = text_bytes(batch, text_col)
            stored = [pack_samples(pad(x)) for x in data]
            types = [s.sniff(x, declared)[:2] for x in stored]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(map(len, data), pa.int64()), pa.array(stored, pa.binary()), pa.array([t for t, _ in types], pa.string()), pa.array([c for _, c in types], pa.bool_())],
                names=[id_col, "n_bytes", "media", "media_type", "corrected"],
            )

    return map_batches(df.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes long, media binary, media_type string, corrected boolean")


def media_digests(df: DataFrame, declared: str = OCTETS) -> DataFrame:
    """Digests of the stored form, of the payload read back from it, and its features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        s = sniffer()
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for name, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                stored = pack_samples(pad(data))
                kind, corrected, embedded = s.sniff(stored, declared)
                back = unpack_samples(stored)
                row = (name, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, kind, corrected, embedded))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return map_batches(df.select("doc_id", "text"), run, schema)
