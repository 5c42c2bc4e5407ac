"""The time a photograph was taken, from its EXIF block: pure Python, applied in Arrow batches."""

from __future__ import annotations

import datetime as dt
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pointer to the EXIF directory, and the tags of the original and the digitised time.
EXIF_DIRECTORY, TIMES = 0x8769, (0x9003, 0x9004)
LONG, ASCII = 4, 2


def _block(image: bytes) -> bytes | None:
    """The TIFF block of a JPEG's first EXIF segment."""
    if image[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(image) and image[at] == 0xFF:
        if image[at + 1] in (0xD8, 0xD9):  # these have no length
            at += 2
            continue
        (length,) = struct.unpack_from(">H", image, at + 2)
        body = image[at + 4 : at + 2 + length]
        if length < 2 or len(body) != length - 2:
            return None
        if image[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
            return body[6:]
        at += 2 + length
    return None


def _directory(block: bytes, order: str, at: int) -> list[tuple[int, int, int, int]]:
    """(tag, type, count, place of the value) of a directory's entries."""
    (n,) = struct.unpack_from(order + "H", block, at)
    if at + 2 + n * 12 + 4 > len(block):
        raise ValueError("a directory that leaves its block")
    return [(*struct.unpack_from(order + "HHI", block, at + 2 + 12 * k), at + 10 + 12 * k) for k in range(n)]


def taken(image: bytes) -> dt.datetime | None:
    """The original time, else the digitised one, without a zone; None for other files and broken blocks."""
    try:
        if not (block := _block(image)):
            return None
        order = {b"II": "<", b"MM": ">"}[block[:2]]
        magic, first = struct.unpack_from(order + "HI", block, 2)
        if magic != 42:
            return None
        pointer = next(at for tag, kind, n, at in _directory(block, order, first) if (tag, kind, n) == (EXIF_DIRECTORY, LONG, 1))
        entries = _directory(block, order, *struct.unpack_from(order + "I", block, pointer))
        for wanted in TIMES:
            found = next(((n, at) for tag, kind, n, at in entries if (tag, kind) == (wanted, ASCII)), None)
            if found is None:
                continue
            n, at = found
            at = at if n <= 4 else struct.unpack_from(order + "I", block, at)[0]
            if at + n > len(block):
                return None
            try:
                return dt.datetime.strptime(block[at : at + n].decode("ascii").rstrip("\0 "), "%Y:%m:%d %H:%M:%S")
            except ValueError:
                continue
    except (ValueError, KeyError, StopIteration, struct.error):
        return None
    return None


@F.pandas_udf(T.StringType())
def _taken(images: pd.Series) -> pd.Series:
    times = [taken(bytes(b)) if b is not None else None for b in images]
    return pd.Series([t and t.strftime("%Y-%m-%d %H:%M:%S") for t in times], dtype=object)


def taken_at(content: Column, zone: str = "UTC") -> Column:
    """Timestamp of an image's bytes; the camera's clock is taken to be in zone, the session's to be UTC."""
    return F.to_utc_timestamp(F.try_to_timestamp(_taken(content), F.lit("yyyy-MM-dd HH:mm:ss")), zone)
