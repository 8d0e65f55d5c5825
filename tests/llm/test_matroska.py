"""Parsing of files that are cut, foreign or malformed, and seeking by cues."""

import hashlib
import struct
import zlib

from sievework.llm import matroska as m


def payload(n, seed=1):
    return b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(-(-n // 32)))[:n]


def test_a_file_cut_anywhere_gives_its_whole_frames():
    data = m.mux(payload(m.FRAME * 20 + 64))
    whole = m.packets(data)
    ends = [a + n for _, _, _, a, n, _ in whole]
    for cut in [*range(0, 2500), *range(2500, len(data), 97), len(data)]:
        assert m.packets(data[:cut]) == [p for p, e in zip(whole, ends, strict=True) if e <= cut]
        assert m.cue_points(data[:cut]) == m.cue_points(data)[: len(m.cue_points(data[:cut]))]


def test_times_follow_scale_and_default_duration():
    head = m.element(m.EBML, b"")
    info = m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, 500_000))
    timed = m.element(m.TRACK_ENTRY, m.number(m.DEFAULT_DURATION, 20_000_000) + m.number(m.TRACK_NUMBER, 3))
    plain = m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 4))
    block = lambda track, offset: m.element(m.SIMPLE_BLOCK, m.vint(track) + struct.pack(">hB", offset, 0x80 | 2 << 1) + m.laced([b"ab", b"cd", b"ef"], 2))
    cluster = m.element(m.CLUSTER, m.number(m.TIMESTAMP, 1000) + block(3, 10) + block(4, -10))
    data = head + m.element(m.SEGMENT, info + m.element(m.TRACKS, timed + plain) + cluster)
    assert [(track, time) for track, time, *_ in m.packets(data)] == [(3, 505), (3, 525), (3, 545), (4, 495), (4, 495), (4, 495)]


def test_laces_that_do_not_fit_have_no_frames():
    assert m.frame_ranges(b"\x02\xff\x00\x05data", 0, 8, 1) == []  # Xiph sizes beyond the block
    assert m.frame_ranges(b"\x02\x81\x80" + b"data", 0, 7, 3) == []  # an EBML size below 0
    assert m.frame_ranges(b"\x01abc", 0, 4, 2) == []  # three bytes in two equal frames
    good = m.element(m.SIMPLE_BLOCK, m.vint(1) + b"\x00\x00\x80" + b"data")
    bad = m.element(m.SIMPLE_BLOCK, m.vint(1) + b"\x00\x00\x82" + b"\x02\xff\x00\x05data")
    data = m.element(m.SEGMENT, m.element(m.CLUSTER, m.number(m.TIMESTAMP, 0) + bad + good))
    assert [data[a : a + n] for *_, a, n, _ in m.packets(data)] == [b"data"]


def test_seeking_by_cues():
    text = payload(3 * m.FRAME * m.LACED * m.BLOCKS + 640)
    data = m.mux(text)
    whole, cues = m.packets(data), m.cue_points(data)
    assert len(cues) == 4 and all(data[at : at + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, at in cues)
    for i, (time, track, _) in enumerate(cues):
        assert m.packets_from(data, time, track) == [p for p in whole if p[5] >= i]
        assert m.packets_from(data, time + 1, track) == [p for p in whole if p[5] >= i]
    assert m.packets_from(data, cues[0][0] - 1, 1) == whole and m.packets_from(data, 5, 2) == []


def test_features_are_those_of_the_payload():
    text = payload(m.FRAME * m.LACED * m.BLOCKS + 128, 5)
    data = m.mux(text)
    n, sha, tail, size, stored_sha, feature = m.features(data)
    centred = [x - 128 for x in text]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(centred, centred[1:]))
    assert (n, sha, tail, size, stored_sha) == (len(text), hashlib.sha256(text).hexdigest(), zlib.crc32(text[-64:]), len(data), hashlib.sha256(data).hexdigest())
    assert feature == f"ms={n * 1000 // m.RATE};packets={-(-n // m.FRAME)};clusters=2;cues=2;energy={sum(x * x for x in centred)};crossings={crossings}"


def test_packet_table(spark):
    texts = [(1, "short"), (2, "long " * 5000), (None, None)]
    media = m.media_column(spark.createDataFrame(texts, "doc_id long, text string"))
    got = sorted(((r["doc_id"] or 0, r["start"], r["length"], r["time"], r["track"], r["cluster"]) for r in m.packet_rows(media).collect()))
    want = []
    for d, text in texts:
        raw = (text or "").encode()
        for track, time, _, a, n, cluster in m.packets(m.mux(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))):
            want.append((d or 0, a, n, time, track, cluster))
    assert got == sorted(want)


def test_key_frames_of_block_groups():
    """A group that refers to another block holds no key frame, wherever in the group the reference stands."""
    block = m.element(m.BLOCK, m.vint(1) + b"\x00\x00\x00" + b"data")
    simple = m.element(m.SIMPLE_BLOCK, m.vint(1) + b"\x00\x00\x80" + b"data")
    reference = m.element(m.REFERENCE_BLOCK, b"\x01")
    groups = [m.element(m.BLOCK_GROUP, x) for x in (block, block + reference, reference + block, block)]
    data = m.element(m.SEGMENT, m.element(m.CLUSTER, m.number(m.TIMESTAMP, 0) + simple + b"".join(groups) + simple))
    assert [key for _, _, key, *_ in m.packets(data)] == [True, True, False, False, True, True]
