"""Media columns: Matroska files in a binary column, read into packet tables.

`packets` parses variable-length EBML elements, clusters, the four kinds of lacing and cues into one row per packet
with its time, track and byte range. `wrap` stores bytes losslessly as an 8-bit PCM track, for the round trip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the EBML and Matroska formats.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 2, 4, 6

RATE = 8000
FRAME = 512
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 32


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; the all-ones value of a width is reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, where it ends); None if its bits are all ones: an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"EBML number at byte {at} is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it starts, where its body starts and ends) of the elements between at and end.

    A body of unknown size reaches to its parent's end, or for a cluster to the next cluster or cues.
    """
    while at < end:
        code, body = read_vint(data, at, True)
        size, body = read_vint(data, body)
        if size is None:
            past = end
            if code == CLUSTER:
                for child, start, _, past_child in elements(data, body, end, CLUSTER):
                    if child in (CLUSTER, CUES):
                        past = start
                        break
                    past = past_child
        else:
            past = body + size
            if past > end:
                raise ValueError(f"element {code:X} at byte {at} passes its parent's end")
        yield code, at, body, past
        if parent == CLUSTER and code in (CLUSTER, CUES):
            return
        at = past


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, length) of the frames of a block's body."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("frames of fixed size don't fill their block")
        sizes = [(end - at) // n] * (n - 1)
    for k in range(n - 1 if lacing != FIXED_LACING else 0):
        if lacing == XIPH_LACING:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            value, at = read_vint(data, at)
            width = at - start
            value = (1 << 7 * width) - 1 if value is None else value
            # After the first, differences to the size before, with a bias that makes them positive.
            size = value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames pass their block's end")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> tuple[dict, list[tuple]]:
    """The file's facts and its packets (track, timestamp_ns, cluster, block, frame, keyframe, lacing, offset, length)."""
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0
    facts: dict = {"scale": 1_000_000, "duration": 0.0, "tracks": {}, "cues": [], "clusters": 0, "segment": 0}
    packets: list[tuple] = []
    cluster = {"time": 0, "blocks": 0}
    track: dict = {}

    def block(a: int, b: int, keyframe: bool | None) -> None:
        to, a = read_vint(data, a)
        shift, flags = struct.unpack(">hB", data[a : a + 3])
        time = (cluster["time"] + shift) * facts["scale"]
        frame_ns = facts["tracks"].get(to, {}).get("frame_ns")
        for k, (offset, length) in enumerate(laced(data, a + 3, b, flags & 6)):
            packets.append((to, int(time), facts["clusters"] - 1, cluster["blocks"], k, bool(flags & 128) if keyframe is None else keyframe, flags & 6, offset, length))
            if frame_ns:
                time += length * frame_ns
        cluster["blocks"] += 1

    def walk(a: int, b: int, parent: int) -> None:
        nonlocal track
        for code, start, x, y in elements(data, a, b, parent):
            if code == SEGMENT:
                facts["segment"] = x
            elif code == CLUSTER:
                facts["clusters"] += 1
                cluster.update(time=0, blocks=0, at=start)
            elif code == TRACK_ENTRY:
                track = {"number": 0, "rate": 8000.0, "channels": 1, "bits": 0, "codec": ""}
            if code == BLOCK_GROUP:
                inner = list(elements(data, x, y, code))
                key = not any(e[0] == REFERENCE_BLOCK for e in inner)
                for e in inner:
                    if e[0] == BLOCK:
                        block(e[2], e[3], key)
            elif code in MASTERS:
                walk(x, y, code)
                if code == TRACK_ENTRY:
                    sample = track["channels"] * track["bits"] / 8
                    if track["codec"].startswith("A_PCM") and sample:
                        track["frame_ns"] = 1e9 / track["rate"] / sample
                    facts["tracks"][track["number"]] = track
            elif code == SIMPLE_BLOCK:
                block(x, y, None)
            elif code == TIMESTAMP:
                cluster["time"] = whole(x, y)
            elif code == TIMESTAMP_SCALE:
                facts["scale"] = whole(x, y)
            elif code == DURATION:
                facts["duration"] = real(x, y)
            elif code == TRACK_NUMBER:
                track["number"] = whole(x, y)
            elif code == CODEC_ID:
                track["codec"] = data[x:y].decode("ascii")
            elif code == SAMPLING_FREQUENCY:
                track["rate"] = real(x, y)
            elif code == CHANNELS:
                track["channels"] = whole(x, y)
            elif code == BIT_DEPTH:
                track["bits"] = whole(x, y)
            elif code == CUE_TIME:
                facts["cues"].append([whole(x, y), None, None])
            elif code == CUE_TRACK and facts["cues"]:
                facts["cues"][-1][1] = whole(x, y)
            elif code == CUE_CLUSTER_POSITION and facts["cues"]:
                facts["cues"][-1][2] = whole(x, y)

    walk(0, len(data), 0)
    return facts, packets


def wrap(payload: bytes, rate: int = RATE) -> bytes:
    """A Matroska file with payload as one track of unsigned 8-bit samples; equal payloads give equal files.

    The full blocks have laced frames of one size; the last frames are laced with their sizes.
    """
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    head, cues, per_block = info + element(TRACKS, track), [], FRAME * FRAMES_A_BLOCK
    parts, length = [head], len(head)
    for first in range(0, len(payload), per_block * BLOCKS_A_CLUSTER):
        time = first * 1000 // rate
        body = [number(TIMESTAMP, time)]
        for at in range(first, min(first + per_block * BLOCKS_A_CLUSTER, len(payload)), per_block):
            part = payload[at : at + per_block]
            lead = vint(1) + struct.pack(">h", at * 1000 // rate - time)
            if len(part) == per_block:
                body.append(element(SIMPLE_BLOCK, lead + bytes([0x80 | FIXED_LACING, FRAMES_A_BLOCK - 1]) + part))
            else:
                sizes = [FRAME] * (len(part) // FRAME) + [len(part) % FRAME] * (len(part) % FRAME > 0)
                if len(sizes) == 1:
                    body.append(element(SIMPLE_BLOCK, lead + bytes([0x80]) + part))
                else:
                    # All but the first and last size: the difference to the one before, 0, with its bias of 63.
                    lace = vint(sizes[0]) + vint(63) * (len(sizes) - 2)
                    body.append(element(SIMPLE_BLOCK, lead + bytes([0x80 | EBML_LACING, len(sizes) - 1]) + lace + part))
        whole = element(CLUSTER, b"".join(body))
        cues.append((time, length))
        parts.append(whole)
        length += len(whole)
    parts.append(element(CUES, b"".join(element(CUE_POINT, number(CUE_TIME, t) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, p))) for t, p in cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


PACKETS = "track long, timestamp_ns long, cluster int, block int, frame int, keyframe boolean, lacing int, offset long, length long"


def packets(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """The packet table of the files in a binary column: id, error, and one row per packet as in PACKETS.

    A null or empty file has no packets and no row. A file that can't be parsed gives one row with its error and no
    packet. Packets come in file order; a frame's time in a laced block follows from the samples before it.
    """
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, errors = [], [], []
            for k, data in enumerate(batch.column(1)):
                try:
                    found = parse(data.as_py() or b"")[1]
                    out += found
                    rows += [k] * len(found)
                    errors += [None] * len(found)
                except (ValueError, IndexError, struct.error) as e:
                    out.append((None,) * len(names))
                    rows.append(k)
                    errors.append(str(e))
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(errors, pa.string()), *(pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, PACKETS.split(", "), strict=True))], ["id", "error", *names])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(read, f"id long, error string, {PACKETS}")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(facts: dict, found: list[tuple], payload: bytes) -> str:
    """Packet and cue counts, duration, and the samples' mean and mean square, all from the file as read back."""
    clusters = {p[2] for p in found}
    known = [c for c in facts["cues"] if c[2] is not None]
    mean = sum(payload) / len(payload)
    return f"tracks={len(facts['tracks'])};clusters={len(clusters)};blocks={len({p[2:4] for p in found})};packets={len(found)};laced={sum(p[6] != NO_LACING for p in found)};cues={len(known)};last_ns={max(p[1] for p in found)};duration_ms={facts['duration']:.3f};mean={mean:.4f}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FEATURES of each row: its text's bytes with zeros up to a positive multiple of 64, wrapped, read back, described.

    A null text is empty (64 zeros). Equal texts give equal values. Whole texts, of any length; nothing is sampled.
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                media = wrap(raw + bytes(-len(raw) % 64 if raw else 64))
                facts, found = parse(media)
                payload = b"".join([media[o : o + n] for *_, o, n in found])
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(facts, found, payload)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in FEATURES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(features, FEATURES)
