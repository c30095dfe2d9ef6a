"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every known signature in one pass over the bytes; a validator of the
format then checks structure and lengths before a hit counts. The format found at byte 0 corrects the
declared type; validated hits further inside are carved out as embedded media.

Cases: null bytes count as empty (type "application/octet-stream", nothing carved); a null declared type
never equals the detected one; repeated rows repeat; other columns are ignored; no rows in, none out.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of

PAYLOAD_UNIT = 192
SAMPLE_RATE = 8000
UNKNOWN = "application/octet-stream"


def _riff(data: bytes, at: int) -> tuple[str, int] | None:
    if len(data) < at + 12:
        return None
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(data[at + 8 : at + 12])
    if kind is None or size < 12 or at + size > len(data):
        return None
    pos, end = at + 12, at + size
    while pos + 8 <= end:
        pos += 8 + struct.unpack_from("<I", data, pos + 4)[0]
        pos += (pos - at) & 1
    return (kind, size) if pos == end else None


def _png(data: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 8
    while pos + 12 <= len(data):
        size, tag = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + size
        if end > len(data) or zlib.crc32(data[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if pos == at + 8 and tag != b"IHDR":
            return None
        if tag == b"IEND":
            return "image/png", end - at
        pos = end
    return None


def _gif(data: bytes, at: int) -> tuple[str, int] | None:
    if len(data) < at + 14:
        return None
    packed = data[at + 10]
    pos = at + 13 + (3 << ((packed & 7) + 1) if packed & 0x80 else 0)

    def blocks(pos: int) -> int:
        while pos < len(data) and data[pos]:
            pos += data[pos] + 1
        return pos + 1

    while pos < len(data):
        tag = data[pos]
        if tag == 0x3B:
            return "image/gif", pos + 1 - at
        if tag == 0x21:
            pos = blocks(pos + 2)
        elif tag == 0x2C and pos + 10 < len(data):
            flags = data[pos + 9]
            pos = blocks(pos + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(data: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 2
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return None
        tag = data[pos + 1]
        if tag == 0xDA:
            end = data.find(b"\xff\xd9", pos)
            return ("image/jpeg", end + 2 - at) if end > 0 else None
        if tag in (0x00, 0xFF, 0xD9):
            return None
        pos += 2 + struct.unpack_from(">H", data, pos + 2)[0]
    return None


def _bmp(data: bytes, at: int) -> tuple[str, int] | None:
    if len(data) < at + 26:
        return None
    size, _, offset, header = struct.unpack_from("<IIII", data, at + 2)
    return ("image/bmp", size) if header in (12, 40, 108, 124) and 14 + header <= offset <= size <= len(data) - at else None


def _pdf(data: bytes, at: int) -> tuple[str, int] | bool | None:
    end = data.find(b"%%EOF", at)
    if end < 0:
        return False
    return ("application/pdf", end + 5 - at) if data.find(b" obj", at, end) > 0 else None


def _zip(data: bytes, at: int) -> tuple[str, int] | bool | None:
    end = data.find(b"PK\x05\x06", at)
    if end < 0:
        return False
    if end + 22 > len(data):
        return None
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    return ("application/zip", end + 22 + note - at) if at + start + size == end else None


def _gzip(data: bytes, at: int) -> tuple[str, int] | None:
    inflate = zlib.decompressobj(31)
    try:
        inflate.decompress(data[at:])
    except zlib.error:
        return None
    return ("application/gzip", len(data) - at - len(inflate.unused_data)) if inflate.eof else None


def _flac(data: bytes, at: int) -> tuple[str, int] | None:
    return ("audio/flac", len(data) - at) if data[at + 4 : at + 8] == b"\x00\x00\x00\x22" else None


#: Signatures of the formats and what checks each.
SIGNATURES = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"%PDF-": _pdf,
    b"PK\x03\x04": _zip,
    b"\x1f\x8b\x08": _gzip,
    b"fLaC": _flac,
}


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(data: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Type and length of what starts at byte 0, and (type, start, length) of what is validated inside."""
    kind, length, carved, covered, ended = UNKNOWN, len(data), [], 0, set()
    for last, magic in automaton().iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if at and at < covered or magic in ended:
            continue
        found = SIGNATURES[magic](data, at)
        if found is False:  # its end mark comes nowhere after this, so no later hit needs to search again
            ended.add(magic)
        elif found:
            if at == 0:
                kind, length = found
            else:
                carved.append((found[0], at, found[1]))
                covered = at + found[1]
    return kind, length, carved


SNIFF_FIELDS = [
    T.StructField("detected_type", T.StringType()),
    T.StructField("type_corrected", T.BooleanType()),
    T.StructField("valid_bytes", T.LongType()),
    T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
]
_EMBEDDED = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def sniff_media(df: DataFrame, data_col: str, declared_col: str, id_col: str) -> DataFrame:
    """One row per input row: the id, the detected type, whether the declared one was wrong, and embedded media."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(data_col).cast("binary").alias("data"), F.col(declared_col).cast("string").alias("declared"))
    schema = T.StructType([rows.schema["doc_id"], *SNIFF_FIELDS])

    def run(batches):
        for batch in batches:
            found = [sniff(x or b"") for x in batch.column(1).to_pylist()]
            declared = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([k for k, _, _ in found], pa.string()),
                    pa.array([k != d for (k, _, _), d in zip(found, declared, strict=True)], pa.bool_()),
                    pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([[{"type": t, "start": s, "length": n} for t, s, n in c] for _, _, c in found], _EMBEDDED),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def to_wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """One channel of unsigned 8-bit PCM: each payload byte is a sample."""
    odd = len(payload) & 1  # chunks are padded to even lengths
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples, found by walking the chunks."""
    pos, rate = 12, 0
    while pos + 8 <= len(media):
        tag, size = struct.unpack_from("<4sI", media, pos)
        if tag == b"fmt ":
            rate = struct.unpack_from("<I", media, pos + 12)[0]
        elif tag == b"data":
            return rate, media[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def pad_payload(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return raw + b" " * (-len(raw) % PAYLOAD_UNIT if raw else PAYLOAD_UNIT)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Texts as WAV media: the stored file (unless keep_media is false), its payload read back, and features.

    The stored bytes are declared as plain text, sniffed, and read only if the validated type is WAV.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    long, string = T.LongType(), T.StringType()
    names = [("n_bytes", long), ("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string)]
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in names], *[T.StructField("media", T.BinaryType())] * keep_media])

    def run(batches):
        import numpy as np

        for batch in batches:
            out = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                media = to_wav(pad_payload(raw))
                kind, length, carved = sniff(media)
                if kind != "audio/wav" or length != len(media):
                    raise ValueError(f"stored media is not what was written: {kind}, {length} bytes")
                rate, back = from_wav(media)
                seen = np.frombuffer(back, np.uint8)
                inside = ",".join(f"{t}@{s}+{n}" for t, s, n in carved) or "none"
                feature = f"{kind};rate={rate};samples={len(back)};low={seen.min()};high={seen.max()};sum={int(seen.sum(dtype=np.int64))};embedded={inside}"
                for column, value in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 7 + keep_media]], names=schema.names)

    return rows.mapInArrow(run, schema)
