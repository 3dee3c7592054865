"""Walkers over image containers: whole files pass, cut-off and damaged ones don't."""

import struct
import zlib

import pytest

from corveil.functions import images

PNG = images.grey_png(bytes(range(200)) * 3, 100)
HEAD = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0"
FRAME = b"\xff\xc0\x00\x0b\x08\x00\x07\x00\x05\x01\x01\x11\x00"
SCAN = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12\xff\x00\x34\xff\xd0\x56"
JPEG = HEAD + FRAME + SCAN + b"\xff\xd9"
GIF = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
LOSSLESS = b"\x2f" + struct.pack("<I", 8 | 5 << 14) + b"\0"
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBPVP8L" + struct.pack("<I", 6) + LOSSLESS
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 24, 0, 54, 40, 5, -3, 1, 8, 0, 24, 0, 0, 0, 0) + bytes(24)
WHOLE = {"png": (PNG, 100, 6), "jpeg": (JPEG, 5, 7), "gif": (GIF, 3, 2), "webp": (WEBP, 9, 6), "bmp": (BMP, 5, 3)}


@pytest.mark.parametrize("kind", WHOLE)
def test_whole_and_cut(kind):
    data, width, height = WHOLE[kind]
    assert images.walked(data) == (kind, width, height, None)
    assert images.walked(data + b"tail") == (kind, width, height, None)
    for n in range(len(data)):
        assert images.walked(data[:n])[3] is not None, n


def test_any_flipped_bit_of_a_png():
    for k in range(len(PNG) * 8):
        bad = bytearray(PNG)
        bad[k // 8] ^= 1 << k % 8
        assert images.walked(bytes(bad))[3] is not None, k


def chunked(*chunks):
    return PNG[:8] + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


@pytest.mark.parametrize(("size", "raw", "fault"), [
    ((4, 4), bytes(20), None), ((4, 4), bytes(19), "too few pixels"), ((0, 4), bytes(20), "header"), ((1 << 15, 1 << 15), bytes(20), "too many pixels"),
    ((4, 4), bytes(3 << 20), "too many pixels"),
])
def test_pixels_of_a_png(size, raw, fault):
    data = chunked((b"IHDR", struct.pack(">IIBBBBB", *size, 8, 0, 0, 0, 0)), (b"tEXt", b"a\0b"), (b"IDAT", zlib.compress(raw)), (b"IEND", b""))
    assert images.walked(data)[3] == fault


def test_interlaced_rows():
    # 8 x 8 at 8 bits: rows of one pass each, and a byte of filter a row.
    assert images.pixel_bytes(8, 8, 8, True) == 64 + 1 + 1 + 1 + 2 + 2 + 4 + 4
    assert images.pixel_bytes(1, 1, 8, True) == 2


def test_rows_with_whole_images_stay(spark):
    rows = [(0, PNG), (1, PNG[:-1]), (2, None), (3, b""), (4, b"<html>"), (5, JPEG), (5, JPEG)]
    d = spark.createDataFrame(rows, "id long, image binary").selectExpr("*", "'x' as _image_check")
    assert sorted(r["id"] for r in images.whole_images(d, "image").collect()) == [0, 5, 5]
    assert images.whole_images(d, "image").columns == d.columns
    assert images.whole_images(d.limit(0), "image").count() == 0
    faults = {r["id"]: r["image_check"]["fault"] for r in images.checked_images(d, "image").collect()}
    assert faults == {0: None, 1: "cut off", 2: "empty", 3: "empty", 4: "unknown format", 5: None}
