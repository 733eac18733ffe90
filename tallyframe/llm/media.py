"""Media columns: Matroska files in binary columns, parsed into packet tables.

`mux` stores a payload losslessly as 8-bit mono samples in laced SimpleBlocks of Clusters with Cues;
`parse` reads any such file: variable-length element ids and sizes, unknown-size masters, SimpleBlock
and BlockGroup, and all four lacings (none, Xiph, fixed, EBML), into packets with track, timestamp,
byte range, cluster and key flag.

Cases: null text or media counts as empty (64 zero bytes of payload; no packets); truncated or foreign
bytes give the packets that lie whole before the damage and `damaged` true, never an exception; equal
bytes give equal rows; an empty table gives no rows; other columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import map_columns, table, text_of

# Element ids of the published Matroska specification (fixed values).
EBML, DOC_TYPE, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset({SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS})
LEVEL_ONE = frozenset({INFO, TRACKS, CLUSTER, CUES})
UNKNOWN = -1

UNIT = 64
SAMPLE_RATE = 8000
FRAME = 800
#: Frames of a laced block, blocks of a cluster.
LACE, BLOCKS = 8, 16


# writing
def vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(ident: int, x: float) -> bytes:
    return element(ident, struct.pack(">d", x))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag bits and the block's body after its header."""
    if len(frames) == 1:
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if len(set(sizes)) == 1:
        return 0b100, head + b"".join(frames)
    head += vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        d = b - a
        width = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
        head += vint(d + (1 << (7 * width - 1)) - 1, width)
    return 0b110, head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file of one PCM track: the payload's bytes as unsigned 8-bit samples at 8 kHz."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, 1000 * len(payload) / SAMPLE_RATE))
    audio = element(AUDIO, real(RATE, SAMPLE_RATE) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    body, cues = info + element(TRACKS, track), b""
    parts, at = [body], len(body)
    step = FRAME * LACE * BLOCKS
    for lo in range(0, len(payload), step):
        start = 1000 * lo // SAMPLE_RATE
        blocks = [uint(CLUSTER_TIME, start)]
        for b in range(lo, min(lo + step, len(payload)), FRAME * LACE):
            end = min(b + FRAME * LACE, len(payload))
            bits, laced = lace([payload[x : min(x + FRAME, end)] for x in range(b, end, FRAME)])
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", 1000 * b // SAMPLE_RATE - start, 0x80 | bits) + laced))
        cluster = element(CLUSTER, b"".join(blocks))
        cues += element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at)))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, cues))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


# reading
class Damage(ValueError):
    pass


def read_id(data: memoryview, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise Damage("no element id")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise Damage("element id too long")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: memoryview, at: int, end: int) -> tuple[int, int, int]:
    """(value or UNKNOWN, next position, width)"""
    if at >= end or not data[at]:
        raise Damage("no size")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damage("size cut off")
    n = int.from_bytes(data[at : at + width], "big") ^ 1 << (7 * width)
    return (UNKNOWN if n == (1 << (7 * width)) - 1 else n), at + width, width


def frame_ranges(data: memoryview, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block's body."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise Damage("no lace count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise Damage("uneven fixed lace")
        sizes = [(end - at) // count] * count
    elif lacing == 1:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= end:
                    raise Damage("lace cut off")
                x, at = data[at], at + 1
                n += x
                if x < 255:
                    break
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    else:
        for k in range(count - 1):
            n, at, width = read_vint(data, at, end)
            sizes.append(n if not k else sizes[-1] + n - ((1 << (7 * width - 1)) - 1))
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise Damage("lace too long")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(media: bytes) -> dict:
    """packets: (track, timestamp in ticks, cluster, frame in block, key, lacing, offset, size); cues; codec; damaged."""
    data = memoryview(media)
    out: dict = {"packets": [], "cues": [], "tracks": {}, "clusters": 0, "damaged": False, "doc_type": None, "scale": 1_000_000}
    state = {"time": 0, "track": 0, "cue": 0, "segment": 0}

    def block(at: int, end: int, simple: bool) -> None:
        track, at, _ = read_vint(data, at, end)
        if at + 3 > end:
            raise Damage("block header cut off")
        (delta,), flags = struct.unpack(">h", data[at : at + 2]), data[at + 2]
        lacing = flags >> 1 & 3
        for k, (offset, size) in enumerate(frame_ranges(data, at + 3, end, lacing)):
            out["packets"].append((track, state["time"] + delta, out["clusters"] - 1, k, bool(flags & 0x80) if simple else None, lacing, offset, size))

    stack = [(0, len(data), 0)]
    at = 0
    try:
        while stack:
            _, end, parent = stack[-1]
            if at >= end:
                stack.pop()
                continue
            ident, body = read_id(data, at, end)
            while parent == CLUSTER and ident in LEVEL_ONE:  # a cluster of unknown size ends here
                stack.pop()
                _, end, parent = stack[-1]
            size, body, _ = read_vint(data, body, end)
            stop = end if size == UNKNOWN else body + size
            if stop > end:
                if ident not in MASTERS:
                    raise Damage("element cut off")
                out["damaged"], stop = True, end
            if ident == EBML or ident in MASTERS:
                if ident == CLUSTER:
                    out["clusters"] += 1
                    state["time"] = 0
                elif ident == SEGMENT:
                    state["segment"] = body
                at = body
                stack.append((at, stop, ident))
                continue
            if ident in (SIMPLE_BLOCK, BLOCK):
                block(body, stop, ident == SIMPLE_BLOCK)
            else:
                raw = bytes(data[body:stop])
                n = int.from_bytes(raw[:8], "big")
                if ident == CLUSTER_TIME:
                    state["time"] = n
                elif ident == TIMESTAMP_SCALE:
                    out["scale"] = n
                elif ident == DOC_TYPE:
                    out["doc_type"] = raw.decode("ascii", "replace")
                elif ident == TRACK_NUMBER:
                    state["track"] = n
                elif ident == CODEC_ID:
                    out["tracks"][state["track"]] = raw.decode("ascii", "replace")
                elif ident == CUE_TIME:
                    state["cue"] = n
                elif ident == CUE_CLUSTER:
                    out["cues"].append((state["cue"], state["segment"] + n))
            at = stop
    except Damage:
        out["damaged"] = True
    return out


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def demux(media: bytes, parsed: dict | None = None) -> bytes:
    """The bytes of all frames of the first packet's track, in the order of the file."""
    found = (parsed or parse(media))["packets"]
    return b"".join([media[o : o + n] for track, *_, o, n in found if track == found[0][0]])


def feature_of(payload: bytes, parsed: dict) -> str:
    """Packets, clusters, cues, laced packets and last timestamp of the file; mean, crossings and peak of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    packets = parsed["packets"]
    crossings = int(np.count_nonzero((x[1:] >= 96) != (x[:-1] >= 96)))
    return f"packets={len(packets)};clusters={parsed['clusters']};cues={len(parsed['cues'])};laced={sum(p[5] > 0 for p in packets)};last={packets[-1][1] if packets else -1};sum={int(x.sum(dtype=np.int64))};crossings={crossings};peak={int(x.max(initial=0))}"


def mux_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a Matroska file."""

    def run(ids: list, raws: list) -> list:
        return [ids, [len(x) for x in raws], [mux(payload_of(x)) for x in raws]]

    return map_columns(docs.select("doc_id", F.encode(text_of(docs), "UTF-8").alias("raw")), run, "doc_id long, n_bytes long, media binary", 200)


PACKETS = "packet long, track long, timestamp long, cluster long, frame int, key boolean, lacing int, offset long, size long"


def packets(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """The packet table: one row per frame with its key, in the order of the file by `packet`."""

    def run(keys: list, files: list) -> list:
        rows = [(k, i, *p) for k, m in zip(keys, files, strict=True) for i, p in enumerate(parse(m or b"")["packets"])]
        return list(zip(*rows, strict=True)) or [[]] * 10

    return map_columns(df.select(key, media), run, f"`{key}` {df.schema[key].dataType.simpleString()}, {PACKETS}", 200)


def media_digests(files: DataFrame) -> DataFrame:
    """Reads the stored files (doc_id, n_bytes, media) back and describes them."""

    def run(ids: list, sizes: list, files: list) -> list:
        rows = []
        for doc, n, media in zip(ids, sizes, files, strict=True):
            parsed = parse(media)
            back = demux(media, parsed)
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back, parsed)))
        return list(zip(*rows, strict=True))

    return map_columns(files, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", 200)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(mux_texts(table(spark, sf_dir, "documents")))
