"""Media columns: signature sniffing, type correction, carving and a lossless round trip.

An Aho-Corasick automaton finds every magic number in a blob in one pass. A hit counts only if its
format's validator accepts the structure there and gives the length; so "BM" inside prose is no
bitmap. The hit at offset 0 corrects the declared type; accepted hits further on are embedded media.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats: magic bytes, the offset of the magic in a file, media type.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS", 0, "audio/ogg"),
)
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
UNIT = 192


def _automaton():
    a = ahocorasick.Automaton()
    for magic, at, kind in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (len(magic), at, kind))
    a.make_automaton()
    return a


def _png(b: bytes, at: int):
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        end = p + 12 + n
        if end > len(b) or first and (name != b"IHDR" or n != 13):
            return None
        if binascii.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if name == b"IEND":
            return "image/png", end - at
        first, p = False, end
    return None


def _next(b: bytes, mark: bytes, at: int, seen: dict) -> int:
    """The first ``mark`` from ``at`` on, or -1. Hits come in order, so each stretch of a blob is searched once for each mark."""
    if mark not in seen or -1 < seen[mark] < at:
        seen[mark] = b.find(mark, at)
    return seen[mark]


def _jpeg(b: bytes, at: int, seen: dict):
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xDA:  # the scan runs to the end marker
            end = _next(b, b"\xff\xd9", p, seen)
            return ("image/jpeg", end + 2 - at) if end >= 0 else None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None
        p += 2 + n
    return None


def _gif(b: bytes, at: int):
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        elif b[p] == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _bmp(b: bytes, at: int):
    if at + 54 > len(b):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    good = zero == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", size) if good and 14 + header <= start <= size <= len(b) - at else None


def _riff(b: bytes, at: int):
    if at + 12 > len(b):
        return None
    size, kind = struct.unpack_from("<I4s", b, at + 4)
    return (RIFF_KINDS[kind], size + 8) if kind in RIFF_KINDS and at + 8 + size <= len(b) else None


def _pdf(b: bytes, at: int, seen: dict):
    end = _next(b, b"%%EOF", at, seen)
    return ("application/pdf", end + 5 - at) if end >= 0 and b.rfind(b"startxref", max(at, end - 64), end) >= 0 else None


def _zip(b: bytes, at: int, seen: dict):
    end = _next(b, b"PK\x05\x06", at, seen)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return ("application/zip", end + 22 + note - at) if at + start + size == end and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int):
    d, p, view = zlib.decompressobj(31), at, memoryview(b)
    try:
        while not d.eof and p < len(b):  # in pieces: a false hit ends in its first one, and nothing is copied whole
            d.decompress(view[p : p + 4096])
            p += 4096
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - at - len(d.unused_data)) if d.eof else None


def _ogg(b: bytes, at: int):
    p = at
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b):
            return None
        last, p = b[p + 5] & 4, end
        if last:
            return "audio/ogg", p - at
    return None


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg}
#: Formats whose end has to be searched for.
SEARCHED = ("image/jpeg", "application/pdf", "application/zip")


def sniff(blob: bytes, automaton) -> tuple[list[tuple[str, int, int]], int]:
    """Validated media of a blob as (type, offset, length), outermost first, and the number of magic hits.

    Media inside accepted media are not reported again, but what follows them is.
    """
    found, hits, free, seen = [], 0, 0, {}
    for end, (n, at, kind) in automaton.iter(blob.decode("latin-1")):
        hits += 1
        start = end + 1 - n - at
        if start >= free and (good := VALIDATORS[kind](blob, start, seen) if kind in SEARCHED else VALIDATORS[kind](blob, start)):
            found.append((good[0], start, good[1]))
            free = start + good[1]
    return found, hits


def sniff_media(df: DataFrame, id_col: str, data_col: str, declared_col: str) -> DataFrame:
    """(id, declared, media_type, corrected, length, trailing, embedded, hits) for each row.

    ``media_type`` is the validated type at offset 0, else the declared one; ``corrected`` tells that they
    differ; ``trailing`` counts the bytes after the first medium; ``embedded`` lists carved media (type,
    offset, length). Null or empty blobs keep their declared type, with no media. Rows are independent:
    repeats stay, null ids stay, other columns are not read, an empty table gives no rows.
    """

    def run(batches):  # ids are text here, as pandas rounds large ones beside nulls
        automaton = _automaton()
        for pdf in batches:
            rows = []
            for row_id, declared, blob in zip(pdf.id, pdf.declared, pdf.data, strict=True):
                found, hits = sniff(bytes(blob), automaton) if blob is not None else ([], 0)
                head = next((x for x in found if x[1] == 0), None)
                size = len(blob) if blob is not None else 0
                kind = head[0] if head else declared
                rows.append((row_id, declared, kind, bool(head) and kind != declared, head[2] if head else 0, size - head[2] if head else 0, [dict(zip(("type", "offset", "length"), x, strict=True)) for x in found if x[1] > 0], hits))
            yield pd.DataFrame(rows, columns=["id", "declared", "media_type", "corrected", "length", "trailing", "embedded", "hits"])

    out = df.select(F.col(id_col).cast("string").alias("id"), F.col(declared_col).alias("declared"), F.col(data_col).alias("data")).mapInPandas(
        run, "id string, declared string, media_type string, corrected boolean, length long, trailing long, embedded array<struct<type:string,offset:long,length:long>>, hits long"
    )
    return out.withColumn("id", F.col("id").cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def _encode(payload: bytes, kind: str) -> bytes:
    n = len(payload)
    if kind == "audio/wav":  # 8-bit mono samples
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "image/bmp":  # 24-bit rows of 64 pixels: 192 bytes each, top row first
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + n, 0, 54, 40, 64, -(n // UNIT), 1, 24, 0, n, 2835, 2835, 0, 0) + payload
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", binascii.crc32(name + data))
    rows = np.zeros((n // UNIT, UNIT + 1), np.uint8)  # 64 RGB pixels, filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, n // UNIT, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def _decode(blob: bytes, kind: str) -> tuple[bytes, str]:
    """The samples of a stored blob, and its shape."""
    if kind == "audio/wav":
        rate, n = struct.unpack_from("<I", blob, 24)[0], struct.unpack_from("<I", blob, 40)[0]
        return blob[44 : 44 + n], f"{n}@{rate}"
    if kind == "image/bmp":
        start, _, width, height = struct.unpack_from("<IIii", blob, 10)
        return blob[start : start + UNIT * -height], f"{width}x{-height}"
    width, height = struct.unpack_from(">II", blob, 16)
    data, p = b"", 33
    while blob[p + 4 : p + 8] == b"IDAT":
        n = struct.unpack_from(">I", blob, p)[0]
        data, p = data + blob[p + 8 : p + 8 + n], p + 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, -1)
    return rows[:, 1:].tobytes(), f"{width}x{height}"


KINDS = ("audio/wav", "image/bmp", "image/png")
_BLANK = re.compile(rb"\x20*\Z")


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text (null: none), and those bytes with spaces up to a positive multiple of UNIT."""
    data = (text or "").encode()
    return len(data), data + b" " * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def media_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a medium, sniffs and reads it back, and describes what was read.

    The format follows from the text alone; every blob is declared "application/octet-stream", so its true
    type has to be found. One row for each row of ``docs``: null and empty texts store 192 spaces; repeated
    rows give equal rows; null ids stay; other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        automaton = _automaton()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.id, pdf.text, strict=True):
                n_bytes, payload = text_payload(text)
                blob = _encode(payload, KINDS[binascii.crc32(payload) % len(KINDS)])
                found, hits = sniff(blob, automaton)
                kind, start, length = found[0]
                back, shape = _decode(blob[start : start + length], kind)
                values = np.frombuffer(back, np.uint8)
                counts = np.bincount(values, minlength=256)
                share = counts[counts > 0] / len(values)
                entropy = float(-(share * np.log2(share)).sum())
                feature = f"{kind};{shape};mean={values.mean():.4f};entropy={entropy:.4f};distinct={len(share)};hits={hits};embedded={len(found) - 1}"
                rows.append((doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), binascii.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, kind))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type"])

    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string"
    )
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_of_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
