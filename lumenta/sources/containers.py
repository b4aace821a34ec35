"""What must be read byte by byte, as functions for Arrow batches."""

from __future__ import annotations

import base64
import struct
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIRS = T.MapType(T.StringType(), T.StringType())
EPOCH_1904 = 2082844800
LAST_SECOND = 4102444800
MAX_DEPTH, MAX_TEXT = 10, 512
#: Where a JPEG's metadata is looked for.
HEAD = 1 << 20
_NESTED = (b"moov", b"trak", b"mdia", b"udta", b"meta")
_TEXTS = {b"\xa9mak": "make", b"\xa9mod": "model", b"\xa9day": "creation_time", b"\xa9too": "writing_application"}


def _header_time(body: bytes) -> str | None:
    """A13"""
    width = 8 if body[:1] == b"\x01" else 4
    if len(body) < 4 + width:
        return None
    seconds = int.from_bytes(body[4 : 4 + width], "big") - EPOCH_1904
    if not 0 < seconds < LAST_SECOND:
        return None
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def _text(body: bytes) -> str:
    """The text after its length and language; else up to a length that counts these four
    bytes, else what follows a data header of eight."""
    body = body[:MAX_TEXT]
    size = int.from_bytes(body[:2], "big")
    options = [body[4:]] if size and size == len(body) - 4 else [body[4:size] if 4 <= size <= len(body) else b"", body[8:]]
    for raw in options if len(body) >= 4 else ():
        if text := raw.decode("utf-8", "ignore").strip("\x00").strip():
            return text
    return ""


class File:
    """A file that is read where it is asked: len() and slices, as of bytes."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, end, _ = part.indices(self.size)
        self.file.seek(start)
        return self.file.read(max(0, end - start))

    def find(self, what: bytes) -> int:
        return self[:HEAD].find(what)


def _children(data: bytes | File, at: int, end: int):
    """(kind, start, end) of the bodies of the boxes in a range; a malformed size ends it."""
    while at + 8 <= end:
        first = data[at : at + 16]
        size, kind, head = int.from_bytes(first[:4], "big"), first[4:8], 8
        if size == 1:
            size, head = int.from_bytes(first[8:], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def parse_boxes(data: bytes | File, start: int = 0, end: int | None = None, depth: int = 0, found: dict[str, str] | None = None) -> dict[str, str]:
    """Metadata of an MP4 or MOV file; a malformed size ends its level.  Only the heads of
    boxes and the bodies that matter are read."""
    found = {} if found is None else found
    for kind, a, b in _children(data, start, len(data) if end is None else end) if depth <= MAX_DEPTH else ():
        if kind in _NESTED:
            parse_boxes(data, a + 4 if kind == b"meta" else a, b, depth + 1, found)
        elif kind == b"mvhd" and (stamp := _header_time(data[a : min(b, a + 32)])):
            found.setdefault("creation_time", stamp)
        elif kind in _TEXTS and (text := _text(data[a : min(b, a + MAX_TEXT)])):
            found.setdefault(_TEXTS[kind], text)
    return found


_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "date_time", 0x9003: "date_taken", 0x829A: "shutter", 0x829D: "aperture", 0x8827: "iso", 0x920A: "focal_length", 0xA434: "lens"}
_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


class _Fields:
    """Big-endian numbers, one after the other; 0 past the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, width: int) -> int:
        self.at += width
        return int.from_bytes(self.data[self.at - width : self.at], "big")


def _exif_items(body: bytes) -> set[int]:
    """Ids of the items of kind Exif in an item information box."""
    head = 6 if body[:1] == b"\0" else 8
    found = set()
    for kind, a, b in _children(body, head, len(body)):
        entry = body[a:b]
        if kind == b"infe" and entry[:1] in (b"\2", b"\3"):
            width = 2 if entry[0] == 2 else 4
            if entry[6 + width : 10 + width] == b"Exif":
                found.add(int.from_bytes(entry[4 : 4 + width], "big"))
    return found


def _item_bytes(body: bytes, wanted: set[int], data: bytes | File, own: bytes) -> bytes:
    """The first wanted item, by an item location box: from the file or the box of own data."""
    f = _Fields(body)
    version = f.take(1)
    f.take(3)
    sizes = f.take(2)
    offset_size, length_size, base_size, index_size = (sizes >> s & 15 for s in (12, 8, 4, 0))
    wide = 4 if version == 2 else 2
    for _ in range(f.take(wide)):
        if f.at >= len(body):
            break
        item, method = f.take(wide), f.take(2) & 15 if version else 0
        f.take(2)
        base, parts = f.take(base_size), []
        for _ in range(f.take(2)):
            f.take(index_size if version else 0)
            start, length = base + f.take(offset_size), f.take(length_size)
            if item in wanted and method in (0, 1):
                of = own if method else data
                parts.append(of[start : start + length] if length else of[start : start + HEAD])
            if f.at > len(body):
                break
        if parts:
            return b"".join(parts)
    return b""


def heif_exif(data: bytes | File) -> bytes:
    """A10: the TIFF block of a HEIF file's Exif item, which begins with its own offset."""
    for kind, a, b in _children(data, 0, len(data)):
        if kind == b"meta":
            body = data[a:b]
            inner = {k: body[c:d] for k, c, d in _children(body, 4, len(body))}
            item = _item_bytes(inner.get(b"iloc", b""), _exif_items(inner.get(b"iinf", b"")), data, inner.get(b"idat", b""))
            return item[4 + int.from_bytes(item[:4], "big") :]
    return b""


def parse_exif(data: bytes | File) -> dict[str, str]:
    """The tags of a TIFF block, bare or inside a JPEG or HEIF file; unreadable data
    give none.  In a JPEG the block stands near the start, in at most 64 KiB."""
    if data[4:8] == b"ftyp":
        data = heif_exif(data)
    at = data.find(b"Exif\x00\x00") if data[:2] != b"II" and data[:2] != b"MM" else -1
    tiff = data[at + 6 : at + 6 + HEAD] if at >= 0 else data
    if tiff[:4] not in (b"II*\x00", b"MM\x00*"):
        return {}
    order = "<" if tiff[:2] == b"II" else ">"
    found: dict[str, str] = {}
    todo, seen = [struct.unpack(order + "I", tiff[4:8])[0]] if len(tiff) >= 8 else [], set()
    while todo:
        start = todo.pop()
        if start in seen or start + 2 > len(tiff):
            continue
        seen.add(start)
        (count,) = struct.unpack(order + "H", tiff[start : start + 2])
        for k in range(count):
            entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            size = _WIDTHS.get(kind, 0) * n
            where = struct.unpack(order + "I", entry[8:])[0]
            raw = entry[8 : 8 + size] if size <= 4 else tiff[where : where + size]
            if tag == 0x8769:
                todo.append(where)
            elif tag in _TAGS and len(raw) == size and size:
                if kind == 2:
                    value = raw.split(b"\x00")[0].decode("utf-8", "ignore").strip()
                elif kind in (5, 10):
                    a, b = struct.unpack(order + ("II" if kind == 5 else "ii"), raw[:8])
                    value = str(a) if b == 1 else f"{a}/{b}"
                else:
                    value = str(struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], raw[: _WIDTHS[kind]])[0])
                found.setdefault(_TAGS[tag], value)
    return found


def content_hash(data: bytes | File, size: int | None = None) -> str:
    """F14 in the sampled form: size, first 16 KiB, and last 16 KiB of what is longer than 32."""
    size = len(data) if size is None else size
    h = xxhash.xxh3_64(struct.pack("<Q", size))
    h.update(data[:16384])
    if size > 32768:
        h.update(data[len(data) - 16384 : len(data)])
    return h.hexdigest()


def vector_text(v: np.ndarray) -> str:
    """F34"""
    return base64.b64encode(np.asarray(v, "<f4").tobytes()).decode()


def text_vector(t: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(t), "<f4")


def file_facts(path: str, size: int, video: bool) -> tuple[str | None, dict[str, str]]:
    """(sampled hash, tags) of a file, of which only the parts that matter are read."""
    try:
        with open(path, "rb") as f:
            data = File(f, size)
            return content_hash(data), parse_boxes(data) if video else parse_exif(data)
    except (OSError, ValueError, struct.error):
        return None, {}


@F.pandas_udf(_PAIRS)
def boxes(content: pd.Series) -> pd.Series:
    return content.map(lambda b: parse_boxes(b or b""))


@F.pandas_udf(_PAIRS)
def exif(content: pd.Series) -> pd.Series:
    return content.map(lambda b: parse_exif(b or b""))


@F.pandas_udf(T.StringType())
def sampled_hash(content: pd.Series) -> pd.Series:
    return content.map(lambda b: content_hash(b or b""))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vectors(text: pd.Series) -> pd.Series:
    """F34"""
    return text.map(lambda t: None if t is None else text_vector(t))


@F.pandas_udf(T.StringType())
def vector_texts(vector: pd.Series) -> pd.Series:
    """F34"""
    return vector.map(lambda v: None if v is None else vector_text(v))
