"""Find out what media a binary column really holds, and what is embedded in it.

An Aho-Corasick automaton finds magic bytes anywhere in a value; a validator of
each format then checks the structure from there and gives the exact length.
What holds corrects the declared type, or is carved out of what surrounds it.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import extended, others, quoted

UNKNOWN = "application/octet-stream"

#: Magic bytes, where they stand from the start of the medium, and the medium's type.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"WAVE", 8, "audio/wav"),
    (b"WEBP", 8, "image/webp"),
    (b"AVI ", 8, "video/avi"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"ftyp", 4, "video/mp4"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
]


#: Marks that end a medium or tell that it has contents.
MARKS = [b"%%EOF", b" obj", b"%PDF-", b"PK\x05\x06", b"\xff\xd9"]


class Marks:
    """Places of the marks in a value, found in one pass and looked up by bisection."""

    def __init__(self):
        self.places: dict[bytes, list[int]] = {mark: [] for mark in MARKS}

    def add(self, mark: bytes, place: int) -> None:
        self.places[mark].append(place)

    def first(self, mark: bytes, start: int) -> int | None:
        """The first place of the mark from ``start`` on."""
        places = self.places[mark]
        k = bisect.bisect_left(places, start)
        return places[k] if k < len(places) else None

    def last(self, mark: bytes, end: int) -> int | None:
        """The last place of the mark before ``end``."""
        places = self.places[mark]
        k = bisect.bisect_left(places, end)
        return places[k - 1] if k else None


def _png(data: memoryview) -> int:
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data) or (at == 8 and (kind != b"IHDR" or size != 13)):
            return 0
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            return 0
        at += 12 + size
        if kind == b"IEND":
            return at
    return 0


def _sub_blocks(data: memoryview, at: int) -> int:
    while at < len(data) and data[at]:
        at += 1 + data[at]
    return at + 1 if at < len(data) else 0


def _gif(data: memoryview) -> int:
    if len(data) < 14:
        return 0
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)
    while 0 < at < len(data):
        if data[at] == 0x3B:
            return at + 1
        if data[at] == 0x21:
            at = _sub_blocks(data, at + 2)
        elif data[at] == 0x2C and at + 10 < len(data):
            at = _sub_blocks(data, at + 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(data: memoryview, start: int, marks: Marks) -> int:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xDA:  # coded data: ends at a marker that is neither stuffing nor a restart
            end = marks.first(b"\xff\xd9", start + at)
            return end - start + 2 if end is not None else 0
    return 0


def _riff(form: bytes, first: bytes | None, data: memoryview) -> int:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != form:
        return 0
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    at = 12
    if end > len(data) or (first is not None and data[12:16] != first):
        return 0
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + size + (size & 1)
    return end if at == end or at == end + 1 else 0


def _bmp(data: memoryview) -> int:
    if len(data) < 54:
        return 0
    size, _, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, 2)
    sound = header in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height != 0
    return size if sound and offset + abs(height) * ((width * bits + 31) // 32 * 4) <= size <= len(data) else 0


def _pdf(data: memoryview, start: int, marks: Marks) -> int:
    end = marks.first(b"%%EOF", start)
    if end is None or (marks.first(b" obj", start) or end) >= end:
        return 0
    following = marks.first(b"%PDF-", end + 5)
    last = marks.last(b"%%EOF", len(data) + start if following is None else following)
    return last - start + 5


def _zip(data: memoryview, start: int, marks: Marks) -> int:
    end = marks.first(b"PK\x05\x06", start)
    if end is None or end - start + 22 > len(data):
        return 0
    size, offset, note = struct.unpack_from("<IIH", data, end - start + 12)
    whole = end - start + 22 + note
    return whole if offset + size == end - start and whole <= len(data) else 0


def _gzip(data: memoryview) -> int:
    unpack = zlib.decompressobj(31)
    try:
        at = 0
        while at < len(data) and not unpack.eof:
            unpack.decompress(data[at : at + 65536])
            at += 65536
    except zlib.error:
        return 0
    return min(at, len(data)) - len(unpack.unused_data) if unpack.eof else 0


def _mp4(data: memoryview) -> int:
    at, kinds = 0, []
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if size < 8 or at + size > len(data) or not kind.isalnum():
            break
        kinds.append(kind)
        at += size
    return at if kinds[:1] == [b"ftyp"] and b"moov" in kinds else 0


def _flac(data: memoryview) -> int:
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, size = bool(data[at] & 0x80), int.from_bytes(data[at + 1 : at + 4], "big")
        if at == 4 and (data[4] & 0x7F or size != 34):
            return 0
        at += 4 + size
    return len(data) if last and at < len(data) and data[at] == 0xFF else 0


def _ogg(data: memoryview) -> int:
    at = 0
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS":
        table = at + 27 + data[at + 26]
        end = table + sum(data[at + 27 : table])
        if end > len(data):
            return 0
        at = end
    return at


#: Validators that read on from the start of a medium, and those that look for a mark further on.
READERS = {
    "image/png": _png, "image/gif": _gif, "image/bmp": _bmp, "application/gzip": _gzip, "video/mp4": _mp4, "audio/flac": _flac, "audio/ogg": _ogg,
    "audio/wav": functools.partial(_riff, b"WAVE", b"fmt "), "image/webp": functools.partial(_riff, b"WEBP", None),
    "video/avi": functools.partial(_riff, b"AVI ", b"LIST"),
}
SEEKERS = {"image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip}


@functools.cache
def _automaton():
    """Signatures and marks; what is found is (bytes back to the start, type or None, mark or None)."""
    told = {mark: (len(mark), None, mark) for mark in MARKS}
    for magic, offset, kind in SIGNATURES:
        told[magic] = (len(magic) + offset, kind, magic if magic in MARKS else None)
    found = ahocorasick.Automaton()
    for magic, what in told.items():
        found.add_word(magic.decode("latin-1"), what)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each medium in ``data``; media within a medium follow it.

    One pass finds signatures and marks. A validator reads on from its signature
    or looks marks up, so that no hit makes it search the rest of the value.
    """
    view, out, starts, marks = memoryview(data), [], {}, Marks()
    for end, (back, kind, mark) in _automaton().iter(data.decode("latin-1")):
        if mark is not None:
            marks.add(mark, end + 1 - len(mark))
        if kind is not None and end + 1 - back >= 0:
            starts[end + 1 - back, kind] = None
    for start, kind in starts:
        if kind in READERS:
            length = READERS[kind](view[start:])
        else:
            length = SEEKERS[kind](view[start:], start, marks)
        if length:
            out.append((kind, start, length))
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit samples as a WAV file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = form + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def wav_samples(data: bytes) -> bytes:
    """The bytes of the data chunk of a valid WAV file."""
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


_MEDIA = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))


#: Bytes of values that are held at once.
BATCH_BYTES = 16_000_000


def _slices(sizes: list[int], most: int = BATCH_BYTES):
    """(from, to) of runs of values of about ``most`` bytes; a value that is larger is a run of its own."""
    lo = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield lo, k
            lo, held = k, 0
        held += size + 64
    if lo < len(sizes):
        yield lo, len(sizes)


def describe(data: bytes, claim: str | None) -> tuple[str, bool, list[tuple[str, int, int]]]:
    """The type of a value, whether it is another than claimed, and all media in it."""
    found = sniff(data)
    kind = next((k for k, start, size in found if start == 0 and size == len(data)), UNKNOWN)
    return kind, kind != claim, found


def sniff_media(rows: DataFrame, content: str = "content", declared: str = "declared", carve: bool = True) -> DataFrame:
    """``rows`` plus ``media_type``, ``type_corrected`` and ``media``, one row per row.

    ``media_type`` is that of a medium which fills the value from its first
    byte, else ``application/octet-stream``; ``type_corrected`` says that it
    differs from the declared one. ``media`` lists all media found with type,
    offset and length, and with their bytes if ``carve`` is set.

    A null or empty value has no media. A null declared type counts as
    different. Repeated rows are treated alike. Columns named like the new ones,
    in whatever case, are replaced. An empty table gives an empty result. Long
    values are read whole, a bounded number of bytes at once.
    """
    fresh = ("media_type", "type_corrected", "media")
    kept = rows.select(*[F.col(quoted(c)) for c in others(rows.columns, fresh)])
    value, said = kept.columns.index(content), kept.columns.index(declared)
    schema = extended(kept.schema, "media_type string, type_corrected boolean, media array<struct<type:string,offset:bigint,length:bigint,bytes:binary>>")

    def run(batches):
        for batch in batches:
            for lo, hi in _slices([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(value)]):
                part = batch.slice(lo, hi - lo)
                kinds, wrong, media = [], [], []
                for data, claim in zip(part.column(value).to_pylist(), part.column(said).to_pylist(), strict=True):
                    kind, differs, found = describe(data or b"", claim)
                    kinds.append(kind)
                    wrong.append(differs)
                    media.append([{"type": k, "offset": s, "length": n, "bytes": data[s : s + n] if carve else None} for k, s, n in found])
                columns = [*part.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(media, _MEDIA)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *fresh])

    return kept.mapInArrow(run, schema)


def payload(text: str | None, unit: int = 64) -> bytes:
    """The text's UTF-8 bytes, filled with 0 to a positive multiple of ``unit``; of a null text, those of an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


#: What a text column claims to hold.
TEXT_TYPE = "text/plain"


def text_media(docs: DataFrame, unit: int = 64) -> DataFrame:
    """``docs`` plus ``n_bytes``, ``content`` (the text's payload as a WAV file) and ``declared``, one row per row.

    A null text counts as empty. ``declared`` is what the column claims,
    ``text/plain``, which the sniffer corrects. Repeated rows are treated alike,
    columns named like the new ones are replaced, and an empty table gives an
    empty result.
    """
    fresh = ("n_bytes", "content", "declared")
    kept = docs.select(*[F.col(quoted(c)) for c in others(docs.columns, fresh)])
    place = kept.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi in _slices([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(place)]):
                part = batch.slice(lo, hi - lo)
                texts = part.column(place).to_pylist()
                sizes = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                content = pa.array([wav(payload(t, unit)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, sizes, content, pa.array([TEXT_TYPE] * len(texts), pa.string())], names=[*batch.schema.names, *fresh])

    return kept.mapInArrow(run, extended(kept.schema, "n_bytes bigint, content binary, declared string"))


_DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digest(text: str | None, unit: int = 64) -> tuple:
    """The digests of one text: it is stored as WAV, sniffed, and its samples are read back."""
    stored = wav(payload(text, unit))
    kind, corrected, found = describe(stored, TEXT_TYPE)
    if kind != "audio/wav" or not corrected:
        raise ValueError(f"stored as WAV, found {kind}")
    samples = wav_samples(stored)
    values = np.frombuffer(samples, np.uint8)
    crossings = int(np.count_nonzero((values[1:] >= 128) != (values[:-1] >= 128)))
    carved = hashlib.sha256()
    for _, start, size in found[1:]:
        carved.update(stored[start : start + size])
    feature = f"{TEXT_TYPE}>{kind};samples={len(values)};sum={int(values.sum())};peak={int(values.max())};crossings={crossings};embedded={len(found) - 1}"
    feature += f";carved={carved.hexdigest()}" if len(found) > 1 else ""
    n_bytes = len((text or "").encode("utf-8", "surrogatepass"))
    return n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def media_digests(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Digests of the texts of ``docs`` (doc_id, text) as media: the columns that ``_DIGEST`` names, one row per row.

    What ``text_media`` and ``sniff_media`` make of a text is made here in one
    pass, and only its digests leave the task. Equal texts have equal digests,
    repeated rows come back as often as they came, a null text counts as empty,
    other columns are ignored, and an empty table gives an empty result.
    """
    fields = [part.split() for part in _DIGEST.split(", ")]
    kinds = [pa.string() if kind == "string" else pa.int64() for _, kind in fields]

    def run(batches):
        for batch in batches:
            for lo, hi in _slices([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)]):
                out = [digest(text.as_py(), unit) for text in batch.column(1).slice(lo, hi - lo)]
                columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=[name for name, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DIGEST)
