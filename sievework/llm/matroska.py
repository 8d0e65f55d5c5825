"""Media columns in Matroska.

`mux` puts bytes into a Matroska file with one track of 8-bit samples: clusters of laced blocks and cues. `packets`
parses any such file by its variable-length elements into a packet table: track, timestamp, key flag, and the byte
range of each frame, for all kinds of lacing (none, Xiph, EBML, fixed), clusters of known or unknown size, and cues.
Times follow the file's TimestampScale; within a lace they follow its track's DefaultDuration (without one, the frames of
a lace have the time of their block). `packets_from` seeks by the cues. Payloads are read back by these byte ranges only.

The stored form depends on the payload alone, so equal texts have equal media.

Edge cases: a null or empty text is a payload of 64 zero bytes; bytes that end early end the packet table at the last
whole frame, wherever the cut is; a block whose lace sizes do not fit it has no frames; unknown elements are skipped; rows are independent, so null ids and repeated rows need no rule; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import stored

#: Samples a second, samples a frame, frames a block, blocks a cluster. 8 samples are a millisecond.
RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16
PAD = 64

#: The element ids of the format that are written or followed.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION = 0x4282, 0x4287
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP}
UNKNOWN = -1

PACKET = T.StructType([T.StructField(n, t()) for n, t in (("track", T.IntegerType), ("time", T.LongType), ("key", T.BooleanType), ("start", T.LongType), ("length", T.LongType), ("cluster", T.IntegerType))])


def vint(x: int) -> bytes:
    """x as a variable-length size; the size of all ones means unknown and is not used."""
    n = 1
    while x >= (1 << 7 * n) - 1:
        n += 1
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(eid: int, data: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(eid: int, x: int) -> bytes:
    return element(eid, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """Lace header and frames; kind 1 Xiph, 2 fixed, 3 EBML."""
    out = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == 3:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d, n = b - a, 1
            while abs(d) > (1 << 7 * n - 1) - 1:
                n += 1
            out += ((d + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big")
    return bytes(out) + b"".join(frames)


def lacing_of(frames: list[bytes]) -> int:
    """Fixed for equal sizes, Xiph for small frames, EBML else."""
    if len(frames) == 1:
        return 0
    if len({len(f) for f in frames}) == 1:
        return 2
    return 1 if max(map(len, frames)) < 512 else 3


def mux(payload: bytes) -> bytes:
    """A Matroska file of payload as 8-bit samples."""
    head = element(EBML, number(DOC_TYPE_VERSION, 4) + element(DOC_TYPE, b"matroska"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + audio)
    parts = [element(INFO, number(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, track)]
    at, cues, step = sum(map(len, parts)), [], FRAME * LACED * BLOCKS
    for begin in range(0, len(payload), step):
        time = begin * 1000 // RATE
        blocks = [number(TIMESTAMP, time)]
        for b in range(begin, min(begin + step, len(payload)), FRAME * LACED):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + FRAME * LACED, len(payload)), FRAME)]
            kind = lacing_of(frames)
            data = laced(frames, kind) if kind else frames[0]
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b * 1000 // RATE - time, 0x80 | kind << 1) + data))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A number at a place and the place after it; UNKNOWN for a size of all ones."""
    first = data[at]
    n = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + n], "big")
    if n > 8 or at + n > len(data):
        raise IndexError("an element ends early")
    if keep_marker:
        return raw, at + n
    value = raw & ((1 << 7 * n) - 1)
    return (UNKNOWN if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, declared end) of the elements in a range, going into the masters that lead to blocks. The end of an
    element that is cut off lies beyond the range. Only a whole header counts."""
    while at < end:
        try:
            eid, at = read_vint(data, at, keep_marker=True)
            size, at = read_vint(data, at)
        except IndexError:
            return
        stop = end if size == UNKNOWN else at + size
        yield eid, at, stop
        at = at if eid in MASTERS else stop


def frame_ranges(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, length) of the frames of a block's data, none if the lace's sizes do not fit between at and end."""
    if kind == 0:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3 and n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            delta, at = read_vint(data, at)
            sizes.append(sizes[-1] + delta - ((1 << 7 * (at - before) - 1) - 1))
    if kind == 2:
        sizes = [(end - at) // n] * (n - 1)
        if (end - at) % n:
            return []
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        return []
    starts = [at + x for x in itertools.accumulate(sizes, initial=0)]
    return list(zip(starts, sizes))


Packet = tuple[int, int, bool, int, int, int]


def packets(data: bytes, begin: int = 0, cluster: int = -1, head: int | None = None) -> list[Packet]:
    """(track, time in ms, key, start, length, cluster) of each whole frame. With `begin`, the place of a cluster, what comes
    before is read for its head (up to the place `head`) only; `cluster` is the number of the cluster before. A frame of a
    block group is key if the group, as far as the file goes, refers to no other block."""
    out: list[Packet] = []
    first, refers = 0, False  # of the block group that is open: its first packet, and whether it refers to a block
    time, scale, entry, durations = 0, 1_000_000, {}, {}
    parts = [(0, len(data))] if not begin else [(0, head or begin), (begin, len(data))]
    for eid, at, stop in itertools.chain.from_iterable(elements(data, a, b) for a, b in parts):
        if stop > len(data) and eid not in MASTERS and eid not in (SIMPLE_BLOCK, BLOCK):
            continue
        if eid == CLUSTER:
            cluster, time = cluster + 1, 0
            first, refers = len(out), False
        elif eid == BLOCK_GROUP:
            first, refers = len(out), False
        elif eid == REFERENCE_BLOCK:
            refers = True
            out[first:] = [(track, ms, False, a, n, c) for track, ms, _, a, n, c in out[first:]]
        elif eid == TIMESTAMP:
            time = int.from_bytes(data[at:stop], "big")
        elif eid == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:stop], "big")
        elif eid == TRACK_ENTRY:
            entry = {}
        elif eid in (TRACK_NUMBER, DEFAULT_DURATION):
            entry[eid] = int.from_bytes(data[at:stop], "big")
            if len(entry) == 2:
                durations[entry[TRACK_NUMBER]] = entry[DEFAULT_DURATION]
        elif eid in (SIMPLE_BLOCK, BLOCK):
            try:
                track, at = read_vint(data, at)
                offset, flags = struct.unpack_from(">hB", data, at)
                ranges = frame_ranges(data, at + 3, stop, flags >> 1 & 3)
            except (IndexError, struct.error):
                continue
            if eid == SIMPLE_BLOCK:
                first, refers = len(out) + len(ranges), False
            start, each = (time + offset) * scale, durations.get(track, 0)
            for i, (a, n) in enumerate(ranges):
                if a + n <= len(data):
                    out.append((track, (start + i * each) // 1_000_000, not refers if eid == BLOCK else flags >= 128, a, n, cluster))
    return out


def cue_points(data: bytes) -> list[tuple[int, int, int]]:
    """(time in the file's scale, track, place of the cluster) of the whole cues."""
    out, segment = [], 0
    for eid, at, stop in elements(data, 0, len(data)):
        if eid == SEGMENT:
            segment = at
        if eid == CUES:
            for _, a, b in elements(data, at, min(stop, len(data))):
                values = {}
                for sub, c, d in elements(data, a, min(b, len(data))):
                    inner = elements(data, c, min(d, len(data))) if sub == CUE_POSITIONS else [(sub, c, d)]
                    values |= {k: int.from_bytes(data[x:y], "big") for k, x, y in inner if y <= len(data)}
                if values.keys() >= {CUE_TIME, CUE_TRACK, CUE_CLUSTER}:
                    out.append((values[CUE_TIME], values[CUE_TRACK], segment + values[CUE_CLUSTER]))
    return out


def packets_from(data: bytes, time: int, track: int) -> list[Packet]:
    """The packets of a track from the last cue at or before a time (in the file's scale) on; only the file's head and
    the clusters from there are read. Without such a cue, all of the track's packets."""
    cues = sorted(c for c in cue_points(data) if c[1] == track)
    before = [c for c in cues if c[0] <= time]
    found = packets(data, before[-1][2], len({c[2] for c in before}) - 2, cues[0][2]) if before else packets(data)
    return [p for p in found if p[0] == track]


@F.pandas_udf(T.BinaryType())
def muxed(payloads: pd.Series) -> pd.Series:
    return payloads.map(mux)


@F.pandas_udf(T.ArrayType(PACKET))
def packet_table(media: pd.Series) -> pd.Series:
    """The packets of each media value."""
    return media.map(lambda m: [dict(zip(("track", "time", "key", "start", "length", "cluster"), p, strict=True)) for p in packets(m)])


def payload_of(text: Column) -> Column:
    """UTF-8 bytes, zeros appended up to a positive multiple of PAD bytes."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.length(raw)
    padded = F.greatest(F.lit(PAD), F.ceil(n / PAD).cast("int") * PAD)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), padded - n)))


def features(media: bytes) -> tuple[int, str, int, int, str, str]:
    """What the stored bytes say, through their packet table; the tail is read from the last cue on."""
    table = packets(media)
    payload = b"".join(media[a : a + n] for _, _, _, a, n, _ in table)
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(samples))))
    cues = cue_points(media)
    tail = b"".join(media[a : a + n] for _, _, _, a, n, _ in packets_from(media, cues[-1][0], cues[-1][1]))[-PAD:]
    feature = f"ms={len(payload) * 1000 // RATE};packets={len(table)};clusters={table[-1][5] + 1};cues={len(cues)};energy={int((samples * samples).sum())};crossings={crossings}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


FEATURES = T.StructType([T.StructField(n, T.StringType() if n in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])


@F.pandas_udf(FEATURES)
def media_features(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(m) for m in media], columns=FEATURES.names)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes, media of each row, stored as a table in the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stored(docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), muxed(payload_of(text)).alias("media")), "media")


def packet_rows(stored_media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packet table of a media column: a row a packet."""
    return stored_media.select(id_col, F.inline(packet_table("media")))


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, and what the stored media say, read back."""
    return media_column(docs, id_col, text_col).select(id_col, "n_bytes", media_features("media").alias("f")).select(id_col, "n_bytes", "f.*")
