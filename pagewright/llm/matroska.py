"""Operator 4: media columns in Matroska.

A payload of 8-bit samples becomes a Matroska file with one PCM track: an EBML header, a segment
with info, tracks, clusters of laced simple blocks, and cues.  Reading parses variable-length EBML
elements anew, of known and of unknown size, takes the timestamp scale and the tracks' frame durations from
the file, follows clusters, all four lacings and block groups, and gives a packet table with timestamps,
tracks and byte ranges; cues are checked against cluster positions.

A null text is an empty one, whose payload is one frame of spaces; rows with a null doc_id are left
out; equal texts give equal files, digests and features; an empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, keyed, tidy

FRAME = 192  # samples of one frame: 24 ms at 8000 Hz
LACED, BLOCKS, RATE = 8, 16, 8000  # frames in a block, blocks in a cluster, samples a second
# Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE, GROUP, BLOCK, POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, NUMBER, DURATION, CODEC = 0x2AD7B1, 0xD7, 0x23E383, 0x86
#: What ends an element of unknown size: the ids of its own level and above.
_TOP = {EBML, SEGMENT}
_LEVEL_1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the given (or least) width."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_INFO = element(INFO, number(0x2AD7B1, 1_000_000) + element(0x4D80, b"pagewright") + element(0x5741, b"pagewright"))
_TRACKS = element(TRACKS, element(ENTRY, number(0xD7, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, 1) + number(0x23E383, FRAME * 1_000_000_000 // RATE) + element(0x86, b"A_PCM/INT/LIT") + element(0xE1, element(0xB5, np.array(RATE, ">f4").tobytes()) + number(0x9F, 1) + number(0x6264, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file of the payload, whose length is a multiple of FRAME."""
    step = FRAME * 1000 // RATE
    body, cues, frames = [_INFO, _TRACKS], [], len(payload) // FRAME
    at = len(_INFO) + len(_TRACKS)
    for lo in range(0, frames, LACED * BLOCKS):
        parts = [number(TIMESTAMP, lo * step)]
        for b in range(lo, min(frames, lo + LACED * BLOCKS), LACED):
            n = min(LACED, frames - b)
            head = b"\x81" + ((b - lo) * step).to_bytes(2, "big") + (bytes([0x84, n - 1]) if n > 1 else b"\x80")  # fixed-size lacing
            parts.append(element(SIMPLE, head + payload[b * FRAME : (b + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(POINT, number(CUE_TIME, lo * step) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_vint(raw: bytes, at: int, marker: bool) -> tuple[int, int]:
    """(value, place behind it); an element id keeps its length marker."""
    first = raw[at]
    if not first:
        raise ValueError(f"no EBML integer at byte {at}")
    width = 9 - first.bit_length()
    n = int.from_bytes(raw[at : at + width], "big")
    return (n if marker else n & (1 << 7 * width) - 1), at + width


def _sized(raw: bytes, at: int, hi: int, key: int) -> tuple[int, int]:
    """(body's start, body's end) of the element whose size stands at ``at``.  One of unknown size ends before the next id of
    its own level or a higher one, or at ``hi``."""
    size, body = read_vint(raw, at, False)
    if size < (1 << 7 * (body - at)) - 1:
        return body, body + size
    ends, end = _TOP if key == SEGMENT else _TOP | _LEVEL_1, body
    while end < hi:
        inner, at = read_vint(raw, end, True)
        if inner in ends:
            break
        end = _sized(raw, at, hi, inner)[1]
    return body, end


def elements(raw: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, body's start, body's end) of the elements in [lo, hi)."""
    while lo < hi:
        key, at = read_vint(raw, lo, True)
        body, end = _sized(raw, at, hi, key)
        if end > hi:
            raise ValueError(f"element {key:#x} at byte {lo} ends outside its parent")
        yield key, lo, body, end
        lo = end


def frames_of(raw: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, byte ranges of the frames) of a block with any lacing."""
    track, at = read_vint(raw, at, False)
    relative = int.from_bytes(raw[at : at + 2], "big", signed=True)
    lacing, at = raw[at + 2] >> 1 & 3, at + 3
    if not lacing:
        return track, relative, [(at, end)]
    n, at = raw[at] + 1, at + 1
    if lacing == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("a fixed-size lace doesn't divide its block")
        sizes = [size] * n
    elif lacing == 1:
        sizes = []
        for _ in range(n - 1):
            size = 0
            while raw[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + raw[at])
            at += 1
        sizes.append(end - at - sum(sizes))
    else:
        sizes = []
        for k in range(n - 1):  # the last frame has what is left; a lace of one frame codes no size
            was = at
            size, at = read_vint(raw, at, False)
            sizes.append(sizes[-1] + size - ((1 << 7 * (at - was) - 1) - 1) if k else size)
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at != end or min(sizes) < 0:
        raise ValueError("a lace doesn't fill its block")
    return track, relative, out


def whole(raw: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(raw[lo:hi], "big")


def tracks(raw: bytes, lo: int, hi: int) -> dict[int, tuple[int, str]]:
    """{track number: (default duration of a frame in ns, 0 if not given; codec)} of a Tracks element's body."""
    out = {}
    for key, _, a, b in elements(raw, lo, hi):
        if key == ENTRY:
            own = {k: (c, d) for k, _, c, d in elements(raw, a, b)}
            out[whole(raw, *own[NUMBER])] = (whole(raw, *own.get(DURATION, (0, 0))), raw[slice(*own.get(CODEC, (0, 0)))].decode("ascii", "replace"))
    return out


def packets(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(track, timestamp in ms, first byte, byte behind the last) of every frame, in file order.

    Times come from the file's own timestamp scale; a lace's later frames follow by their track's default duration, and
    share the block's time if the track gives none."""
    out: list[tuple[int, int, int, int]] = []
    for key, _, lo, hi in elements(raw, 0, len(raw)):
        if key == SEGMENT:
            out += _segment_packets(raw, lo, hi)
    return out


def _segment_packets(raw: bytes, lo: int, hi: int) -> list[tuple[int, int, int, int]]:
    scale, lasting, clusters, cues, laces = 1_000_000, {}, {}, [], []
    for inner, place, a, b in elements(raw, lo, hi):
        if inner == INFO:
            scale = next((whole(raw, c, d) for k, _, c, d in elements(raw, a, b) if k == SCALE), scale)
        elif inner == TRACKS:
            lasting |= {n: ns for n, (ns, _) in tracks(raw, a, b).items()}
        elif inner == CLUSTER:
            time = 0
            for k, _, c, d in elements(raw, a, b):
                if k == TIMESTAMP:
                    time = whole(raw, c, d)
                    clusters[place - lo] = time
                blocks = [(c, d)] if k == SIMPLE else [(e, f) for g, _, e, f in elements(raw, c, d) if g == BLOCK] if k == GROUP else []
                laces += [(time, *frames_of(raw, e, f)) for e, f in blocks]
        elif inner == CUES:
            for _, _, c, d in elements(raw, a, b):
                point = {k: (e, f) for k, _, e, f in elements(raw, c, d)}
                where = {k: whole(raw, e, f) for k, _, e, f in elements(raw, *point[CUE_AT])}
                cues.append((where[CUE_CLUSTER], whole(raw, *point[CUE_TIME])))
    for place, time in cues:
        if clusters.get(place) != time:
            raise ValueError(f"a cue names a cluster at {place}, time {time}, that isn't there")
    return [
        (track, ((time + relative) * scale + i * lasting.get(track, 0)) // 1_000_000, x, y)
        for time, track, relative, ranges in laces for i, (x, y) in enumerate(ranges)
    ]


def feature(samples: np.ndarray) -> str:
    """Eight levels of the signal: the spread of equal stretches, in 1/100 of a step."""
    own = np.array_split(samples.astype(np.float64), 8)
    return ":".join(f"{round(float(x.std()) * 100) if len(x) else 0:x}" for x in own)


def padded(raw: bytes) -> bytes:
    return raw + b" " * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)


def to_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every whole text as a Matroska file."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw = data.tobytes()
            at = offsets.tolist()
            media = [mux(padded(raw[a:b])) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return keyed(documents).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """(doc_id, packet, track, timestamp_ms, byte_start, byte_end) of media rows."""

    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                rows = [(key, i, *p) for i, p in enumerate(packets(raw))]
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "packet", "track", "timestamp_ms", "byte_start", "byte_end"])

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, packet long, track long, timestamp_ms long, byte_start long, byte_end long")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_packets, from the stored bytes."""
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64())]

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                table = packets(raw)
                payload = b"".join([raw[a:b] for _, _, a, b in table])
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(np.frombuffer(payload, np.uint8)), len(table)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])

    return media.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long")
