"""Whole images: walkers over the containers of PNG, JPEG, GIF, WebP and BMP that read a file to its end.

A file is whole if every part that its container names is there: PNG's chunks with their checksums and as many pixel
bytes as the header asks for, JPEG's segments and scans up to the end mark, GIF's blocks up to the trailer, the sizes of
RIFF's chunks and of BMP's pixel rows. What a format has no checksum for (a flipped bit within a JPEG's scan, say) can't
be told from its container. Files are read where they lie, in Arrow batches; nothing is decoded to pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

PARTS = StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("fault", StringType())])
#: Images of more pixels than this are taken as decompression bombs.
MOST_PIXELS = 178_956_970
#: Bits a pixel by PNG colour type are channels times depth.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Start column, start row, column step, row step of PNG's interlaced passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class Broken(ValueError):
    """What is wrong with a file."""


def need(holds: bool, fault: str) -> None:
    if not holds:
        raise Broken(fault)


def pixel_bytes(width: int, height: int, bits: int, interlaced: bool) -> int:
    """The number of bytes of a PNG's filtered rows."""
    rows = lambda w, h: h * (1 + (w * bits + 7) // 8) if w and h else 0
    if not interlaced:
        return rows(width, height)
    return sum(rows(-(-max(0, width - x) // dx), -(-max(0, height - y) // dy)) for x, y, dx, dy in PASSES)


def png(data: bytes) -> tuple[int, int]:
    at, size, found, expected = 8, None, 0, 0
    pixels = zlib.decompressobj()
    while True:
        need(at + 12 <= len(data), "cut off")
        length, kind = struct.unpack_from(">I4s", data, at)
        need(at + 12 + length <= len(data), "cut off")
        body = memoryview(data)[at + 8 : at + 8 + length]
        need(zlib.crc32(body, zlib.crc32(kind)) == struct.unpack_from(">I", data, at + 8 + length)[0], "checksum")
        at += 12 + length
        if size is None:
            need(kind == b"IHDR" and length == 13, "no header")
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            need(width > 0 and height > 0 and colour in CHANNELS, "header")
            need(width * height <= MOST_PIXELS, "too many pixels")
            size, expected = (width, height), pixel_bytes(width, height, CHANNELS[colour] * depth, interlaced == 1)
        elif kind == b"IDAT":
            rest = body
            while len(rest):
                # A mebibyte at a time, so that a small file can't fill the memory.
                found += len(pixels.decompress(rest, 1 << 20))
                need(found <= expected + (1 << 20), "too many pixels")
                rest = pixels.unconsumed_tail
        elif kind == b"IEND":
            need(found >= expected, "too few pixels")
            return size


def jpeg(data: bytes) -> tuple[int, int]:
    at, size, scans = 2, None, 0
    while True:
        need(at + 2 <= len(data), "cut off")
        need(data[at] == 0xFF, "no mark")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 0xD9:
            need(size is not None and scans > 0, "no scan")
            return size
        elif mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
        else:
            need(at + 4 <= len(data), "cut off")
            length = struct.unpack_from(">H", data, at + 2)[0]
            need(length >= 2 and at + 2 + length <= len(data), "cut off")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                need(length >= 8, "header")
                height, width = struct.unpack_from(">HH", data, at + 5)
                need(width > 0 and height > 0, "header")
                need(width * height <= MOST_PIXELS, "too many pixels")
                size = (width, height)
            at += 2 + length
            if mark == 0xDA:
                need(size is not None, "no header")
                scans += 1
                # A scan ends at the next mark that is neither a stuffed byte nor a restart.
                at = data.find(b"\xff", at)
                while at >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                    at = data.find(b"\xff", at + 2)
                need(at >= 0, "cut off")


def gif(data: bytes) -> tuple[int, int]:
    need(len(data) >= 13, "cut off")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    need(width > 0 and height > 0, "header")
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    at, images = 13 + table(flags), 0
    while True:
        need(at < len(data), "cut off")
        kind = data[at]
        if kind == 0x3B:
            need(images > 0, "no image")
            return width, height
        if kind == 0x21:
            at += 2
        elif kind == 0x2C:
            need(at + 10 <= len(data), "cut off")
            at += 11 + table(data[at + 9])
            images += 1
        else:
            raise Broken("no block")
        while True:
            need(at < len(data), "cut off")
            length = data[at]
            at += 1 + length
            if not length:
                break


def webp(data: bytes) -> tuple[int, int]:
    need(len(data) >= 12, "cut off")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    need(end <= len(data), "cut off")
    at, size, images = 12, None, 0
    while at + 8 <= end:
        kind, length = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : min(at + 8 + length, at + 18)]
        need(at + 8 + length <= end, "cut off")
        if kind == b"VP8X":
            need(length >= 10, "header")
            size = tuple(1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
        elif kind == b"VP8 ":
            need(length >= 10 and body[3:6] == b"\x9d\x01\x2a", "header")
            size = size or tuple(x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif kind == b"VP8L":
            need(length >= 5 and body[0] == 0x2F, "header")
            bits = struct.unpack_from("<I", body, 1)[0]
            size = size or (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        images += kind in (b"VP8 ", b"VP8L", b"ANMF")
        at += 8 + length + length % 2
    need(size is not None and images > 0, "no image")
    need(min(size) > 0, "header")
    need(size[0] * size[1] <= MOST_PIXELS, "too many pixels")
    return size


def bmp(data: bytes) -> tuple[int, int]:
    need(len(data) >= 34, "cut off")
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    need(width > 0 and height != 0 and bits in (1, 4, 8, 16, 24, 32), "header")
    need(width * abs(height) <= MOST_PIXELS, "too many pixels")
    length = struct.unpack_from("<I", data, 2)[0] - start if packed in (1, 2) else (width * bits + 31) // 32 * 4 * abs(height)
    need(start + length <= len(data), "cut off")
    return width, abs(height)


#: name -> (whether a file begins as this format does, its walker)
FORMATS: dict[str, tuple[Callable[[bytes], bool], Callable[[bytes], tuple[int, int]]]] = {
    "png": (lambda x: x.startswith(b"\x89PNG\r\n\x1a\n"), png),
    "jpeg": (lambda x: x.startswith(b"\xff\xd8\xff"), jpeg),
    "gif": (lambda x: x.startswith((b"GIF87a", b"GIF89a")), gif),
    "webp": (lambda x: x.startswith(b"RIFF") and x[8:12] == b"WEBP", webp),
    "bmp": (lambda x: x.startswith(b"BM"), bmp),
}


def walked(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None]:
    """(format, width, height, fault) of a file; a whole one has no fault, a null or unknown one no format."""
    if not data:
        return None, None, None, "empty"
    for name, (begins, walk) in FORMATS.items():
        if begins(data):
            try:
                return (name, *walk(data), None)
            except Broken as fault:
                return name, None, None, str(fault)
            except zlib.error:
                return name, None, None, "pixels"
    return None, None, None, "unknown format"


@F.pandas_udf(PARTS)
def image_parts(files: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([walked(x) for x in files], columns=["format", "width", "height", "fault"])
    return out.astype({"width": "Int32", "height": "Int32"})


def checked_images(df: DataFrame, image: str, name: str = "image_check") -> DataFrame:
    """df with a struct (format, width, height, fault) of its binary column; every row stays."""
    return df.withColumn(name, image_parts(F.col(image)))


def whole(check: Column) -> Column:
    """Whether a checked image is whole."""
    return check["fault"].isNull()


def whole_images(df: DataFrame, image: str) -> DataFrame:
    """The rows of df whose image is whole: nulls, empty, unknown, cut off and damaged files go."""
    check = "_image_check"
    while check in df.columns:
        check += "_"
    return checked_images(df, image, check).filter(whole(F.col(check))).drop(check)


def grey_png(pixels: bytes, width: int) -> bytes:
    """A grey image of 8 bits with these pixels, the last row filled with zeros."""
    rows = -(-max(1, len(pixels)) // width)
    pixels = pixels.ljust(rows * width, b"\0")
    raw = b"".join(b"\0" + pixels[k : k + width] for k in range(0, len(pixels), width))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def png_of(text: pd.Series, width: pd.Series) -> pd.Series:
    """The UTF-8 bytes of a text (null: empty) as the pixels of a grey PNG."""
    return pd.Series([grey_png((t or "").encode(), int(w)) for t, w in zip(text, width, strict=True)], dtype=object)
