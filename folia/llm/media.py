"""Operator 7, media columns: signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass. Where a signature
stands, the format's validator walks the structure (chunks, blocks, markers, checksums) and yields
the length, or rejects the place: magic bytes alone prove nothing. A structure that starts at byte 0
settles the column's type, whatever was declared; structures inside are carved as embedded media.

Stored form for payloads: 8-bit mono PCM in a WAVE file, one sample a byte. Reading back goes
through the sniffer: the validated data chunk is the payload.

Edge cases: null text is an empty one, stored as one block of zeros; null media is of no type, with no
payload and nothing embedded; very long texts are stored and read whole; truncated structures
aren't recognised (the declared type stays, valid = false); overlapping finds: the earliest start
wins, what lies inside a find isn't reported again; repeated rows give equal values; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.batches import in_python
from folia.llm.common import crc32_sql, table

BLOCK, RATE = 64, 8000
UNKNOWN = "application/octet-stream"

# Media type, magic bytes, their place from the structure's start.
MAGIC = (
    ("audio/wav", b"RIFF", 0),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/bmp", b"BM", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
)


def wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def wav_chunks(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(length of the file, place and length of its samples)."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    i, fmt, data = at + 12, False, None
    while i + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, i)
        if i + 8 + n > end:
            return None
        if name == b"fmt ":
            fmt = n >= 16
        elif name == b"data" and fmt:
            data = (i + 8, n)
        i += 8 + n + n % 2
    return (end - at, *data) if data and i == end else None


def _wav(b: bytes, at: int) -> int:
    found = wav_chunks(b, at)
    return found[0] if found else 0


def _png(b: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first != (name == b"IHDR") or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        i, first = i + 12 + n, False
        if name == b"IEND":
            return i - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while i < len(b):
        kind, i = b[i], i + 1
        if kind == 0x3B:
            return i - at
        if kind == 0x2C:
            if i + 9 > len(b):
                return 0
            i += 10 + (3 << (b[i + 8] & 7) + 1 if b[i + 8] & 128 else 0)
        elif kind == 0x21:
            i += 1
        else:
            return 0
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return 0
        mark = b[i + 1]
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return 0
        i += 2 + n
        if mark == 0xDA:  # the scan: up to a marker that is neither stuffed nor a restart
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b):
                if b[i + 1] == 0xD9:
                    return i + 2 - at
                if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                    break
                i += 2
            if i < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, reserved, pixels, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (width * bits + 31) // 32 * 4
    ok = not reserved and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and header >= 40 and width > 0 and height and pixels >= 14 + header
    return size if ok and at + size <= len(b) and size >= pixels + row * abs(height) else 0


def _gzip(b: bytes, at: int) -> int:
    unzip, view, i = zlib.decompressobj(31), memoryview(b), at
    try:
        while i < len(b) and not unzip.eof:
            rest = view[i : i + (1 << 16)]
            i += len(rest)
            while rest and not unzip.eof:
                unzip.decompress(rest, 1 << 20)
                rest = unzip.unconsumed_tail
    except zlib.error:
        return 0
    return i - at - len(unzip.unused_data) if unzip.eof else 0


class Ends:
    """Where structures of an open length may end, found in the same pass as the magic bytes: nothing
    is searched again for each start."""

    def __init__(self, b: bytes, marks: list[tuple[bytes, int]]):
        places = lambda m: [at for mark, at in marks if mark == m]
        self.eof, self.xref, self.zips = places(b"%%EOF"), places(b"startxref"), {}
        for i in places(b"PK\x05\x06"):
            if i + 22 <= len(b):
                size, place, note = struct.unpack_from("<IIH", b, i + 12)
                start = i - place - size
                if start >= 0 and (not size or b[start + place : start + place + 4] == b"PK\x01\x02") and i + 22 + note <= len(b):
                    self.zips.setdefault(start, i + 22 + note)

    def pdf(self, at: int) -> int:
        """The first end after a cross reference's."""
        end = bisect_left(self.eof, at)
        if end == len(self.eof):
            return 0
        xref = bisect_left(self.xref, at)
        return self.eof[end] + 5 - at if xref < len(self.xref) and self.xref[xref] < self.eof[end] else 0

    def zip(self, at: int) -> int:
        return self.zips.get(at, at) - at


VALID = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp,
    "application/gzip": _gzip,
}


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magic, at in MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, len(magic) + at))
    for mark in (b"%%EOF", b"startxref", b"PK\x05\x06"):
        a.add_word(mark.decode("latin-1"), (mark, len(mark)))
    a.make_automaton()
    return a


def scan(b: bytes, outer: bool = True) -> list[tuple[str, int, int]]:
    """Validated structures as (type, offset, length), by offset. One at 0 doesn't hide those in it."""
    found = [(kind, end + 1 - n) for end, (kind, n) in automaton().iter(b.decode("latin-1"))]
    ends = Ends(b, [f for f in found if isinstance(f[0], bytes)])
    out, free = [], 0
    for kind, at in found:
        if isinstance(kind, bytes) or at < free:
            continue
        length = ends.pdf(at) if kind == "application/pdf" else ends.zip(at) if kind == "application/zip" else VALID[kind](b, at)
        if length:
            out.append((kind, at, length))
            free = at + length if at or not outer else 0
    return out


def _features(payload: bytes) -> str:
    """Of 8-bit samples: mean, deviation, entropy in bits, crossings of the middle."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "n=0"
    n, counts, level = len(x), np.bincount(x, minlength=256), np.arange(256)
    total, squares = int(counts @ level), int(counts @ level**2)  # whole numbers: no order of summing matters
    mean, deviation = total / n, ((n * squares - total * total) / (n * n)) ** 0.5
    p = counts[counts > 0] / n
    entropy = abs(float((p * np.log2(p)).sum()))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"mean={mean:.3f};dev={deviation:.3f};bits={entropy:.3f};crossings={crossings}"


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, declared, media): the text's UTF-8, padded to whole blocks, as a WAVE file."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = [wav(r + bytes(-len(r) % BLOCK or BLOCK * (not r))) for r in raw]
            return pa.record_batch([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([UNKNOWN] * len(raw)), pa.array(media, pa.binary())], [key, "n_bytes", "declared", "media"])

        return work

    return in_python(docs.select(key, text), make, f"`{key}` {kind}, n_bytes bigint, declared string, media binary")


def sniff(stored: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """stored and media_type (corrected), valid, payload (samples of a WAVE file, else the bytes),
    embedded (type, offset, length) and feature."""
    stored = stored.drop("media_type", "valid", "payload", "embedded", "feature")
    names, schema = stored.columns, ", ".join(f"`{c}` {t}" for c, t in stored.dtypes)
    spans = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            kinds, valid, payloads, embedded, features = [], [], [], [], []
            for m, said in zip(b.column(media).to_pylist(), b.column(declared).to_pylist(), strict=True):
                found = scan(m) if m else []
                outer = next((f for f in found if f[1] == 0), None)
                chunks = wav_chunks(m, 0) if outer and outer[0] == "audio/wav" else None
                payload = m[chunks[1] : chunks[1] + chunks[2]] if chunks else m
                inner = [f for f in found if f is not outer]
                kinds.append(outer[0] if outer else said)
                valid.append(outer is not None)
                payloads.append(payload)
                embedded.append([{"type": k, "offset": o, "length": n} for k, o, n in inner])
                features.append(None if m is None else f"type={kinds[-1]};declared={said};embedded={len(inner)};{_features(payload)}")
            cols = [pa.array(kinds, pa.string()), pa.array(valid, pa.bool_()), pa.array(payloads, pa.binary()), pa.array(embedded, spans), pa.array(features, pa.string())]
            return pa.record_batch([*(b.column(c) for c in names), *cols], [*names, "media_type", "valid", "payload", "embedded", "feature"])

        return work

    return in_python(stored, make, f"{schema}, media_type string, valid boolean, payload binary, embedded array<struct<type:string,offset:bigint,length:bigint>>, feature string", rows=256)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sniff(store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{BLOCK}, {BLOCK})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


_LE = "format('{{:02x}}{{:02x}}{{:02x}}{{:02x}}', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, {0} >> 24)"
#: No text of the table holds a medium, so `embedded` is 0.
ORACLE = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n_bytes, b || unhex(repeat('00', CAST(CASE WHEN octet_length(b) % {BLOCK} = 0 AND octet_length(b) > 0 THEN 0 ELSE {BLOCK} - octet_length(b) % {BLOCK} END AS INTEGER))) AS payload FROM t),
x AS (SELECT *, octet_length(payload) AS n, list_transform(regexp_extract_all(hex(payload), '..'), lambda h: ('0x' || h)::INTEGER) AS l FROM p),
f AS (SELECT *, list_sum(l) / n AS mean, CAST(list_sum(l) AS HUGEINT) AS total, CAST(list_sum(list_transform(l, lambda v: v * v)) AS HUGEINT) AS squares, map_values(list_histogram(l)) AS h, unhex(right(hex(payload), {2 * BLOCK})) AS tail,
  unhex('52494646' || {_LE.format('(n + 36)')} || '57415645666d7420100000000100010' || '0401f0000401f000001000800' || '64617461' || {_LE.format('n')}) || payload AS media FROM x)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST({crc32_sql('tail')} AS BIGINT) AS tail_crc32,
  CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256,
  format('type=audio/wav;declared=application/octet-stream;embedded=0;mean={{:.3f}};dev={{:.3f}};bits={{:.3f}};crossings={{}}', mean, sqrt(CAST(n * squares - total * total AS DOUBLE) / CAST(n * n AS DOUBLE)),
    abs(list_sum(list_transform(h, lambda c: (c / n) * log2(c / n)))), CAST(list_sum(list_transform(range(1, n), lambda i: CASE WHEN (l[i] >= 128) <> (l[i + 1] >= 128) THEN 1 ELSE 0 END)) AS BIGINT)) AS feature
FROM f
"""
