"""Vectorised word and n-gram hashes over UTF-8 bytes.

A stretch's hash comes from two blocks of the largest power of two that fits, one at its start and one at its end, and a
block's hash from its two halves, through a multiplication and shifts at every level.  Nothing in it is linear, so texts
that differ in a regular way (Thue-Morse words, say) don't collide as they would under a polynomial modulo 2**64.
Stretches of up to seven bytes are hashed one to one.  A hash only groups: where equal hashes decide a result, callers
compare the contents or a 128-bit digest of them.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_ODD1, _ODD2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for a pair of hashes, in this order."""
    x = a * _ODD1
    x ^= x >> _U(32)
    x += b
    x *= _ODD2
    x ^= x >> _U(29)
    return x


def packed(data: np.ndarray, width: int = 8) -> np.ndarray:
    """The big-endian integer of the 8 bytes from each place on (zeros behind the end)."""
    out, have = np.concatenate([data, np.zeros(width, np.uint8)]).astype(np.uint64), 1
    while have < width:
        out = (out[:-have] << np.uint64(8 * have)) | out[have:]
        have *= 2
    return out[: len(data)]


def _by_blocks(blocks: np.ndarray, size: int, start: np.ndarray, length: np.ndarray, out: np.ndarray) -> None:
    """Hashes of stretches of at least ``size`` items, from the hashes of all blocks of that size."""
    level, most = np.frexp((length // size).astype(np.float64))[1], length.max(initial=0)
    k = 1
    while size <= most:
        own = np.flatnonzero(level == k)
        if len(own):
            s, n = start[own], length[own]
            out[own] = mix(paired(blocks[s], blocks[s + n - size]) + n.astype(np.uint64))
        if 2 * size <= most:
            blocks = paired(blocks[:-size], blocks[size:])
        size, k = 2 * size, k + 1


def byte_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte stretches [start, end); place doesn't matter."""
    length = end - start
    out = np.empty(len(start), np.uint64)
    eight = packed(data)
    short = length < 8
    n = length[short].astype(np.uint64)
    some = eight[np.minimum(start[short], max(len(data) - 1, 0))] if len(data) else np.zeros(len(n), np.uint64)
    some = np.where(n > 0, some >> (_U(64) - _U(8) * np.maximum(n, _U(1))), _U(0))
    out[short] = mix((some | n << _U(56)) ^ _U(seed))
    if not short.all():
        long = ~short
        held = np.zeros(int(long.sum()), np.uint64)
        _by_blocks(mix(eight ^ _U(seed ^ 0x5851F42D4C957F2D)), 8, start[long], length[long], held)
        out[long] = held
    return out


def spans(items: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the stretches [start, end) of a sequence of hashed items; empty ones have the hash 0."""
    out = np.zeros(len(start), np.uint64)
    length = end - start
    full = length > 0
    held = np.zeros(int(full.sum()), np.uint64)
    _by_blocks(mix(items ^ _U(seed)), 1, start[full], length[full], held)
    out[full] = held
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document: starts, ends (in bytes of ``data``), hashes,
    and the index of each document's first word (one more entry than documents)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    gap = gaps[data]
    full = np.diff(offsets) > 0
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    before[offsets[:-1][full]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    after[offsets[1:][full] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return start, end, byte_spans(data, start, end), np.searchsorted(start, offsets)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbouring items (of the whole sequence; callers mind document ends)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    blocks, have = mix(h), 1
    while 2 * have <= size:
        blocks, have = paired(blocks[:-have], blocks[have:]), 2 * have
    return mix(paired(blocks[:n], blocks[size - have : size - have + n]) + _U(size))


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte stretch [start, end); two are equal if and only if the bytes are."""
    if not len(start):
        return np.zeros(0, np.int64)
    _, first, where = np.unique(byte_spans(data, start, end), return_index=True, return_inverse=True)
    as_first, size = first[where], end - start
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    other = np.minimum(at + np.repeat(start[as_first] - begin, size), len(data) - 1)
    if (size == size[as_first]).all() and (data[at + np.repeat(start - begin, size)] == data[other]).all():
        return where.astype(np.int64)
    raw, seen = data.tobytes(), {}  # equal hashes of different stretches
    return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist())], np.int64)


def window_names(items: np.ndarray, size: int) -> np.ndarray:
    """A number for every ``size`` neighbouring items, which are numbers themselves: pairs of names get names, so two are
    equal if and only if all their items are."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    named = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)
    out, have = items, 1
    while 2 * have <= size:
        out, have = named(out[:-have], out[have:]), 2 * have
    return named(out[:n], out[size - have : size - have + n]) if have < size else out


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of 128 bits of byte stretches, as two columns of integers."""
    make = hashlib.blake2b
    return np.frombuffer(b"".join([make(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]), "<i8").reshape(-1, 2)


_OTHER = np.ones(256, bool)
_OTHER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased, and the index of each document's first one."""
    _, _, h, first = words(data, offsets, lower=True, gaps=_OTHER)
    return h, first
