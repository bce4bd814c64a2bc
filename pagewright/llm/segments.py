"""Ids of texts through a cache of short stretches, looked up for a whole slice of documents at once.

:class:`SliceIds` is the vectorised part: stretches are byte ranges, hashed without copying, and
only stretches that a worker hasn't seen are encoded.  :class:`LibraryIds` cuts texts where the
pre-tokenizers of the supported vocabularies never join two characters (before a space or a line
feed that follows a character which is surely not white space, and between a letter and an ASCII
character that is no letter), so a text's ids are its stretches' ids one after another; tests hold
this against the library's ids of whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import slices
from .hashing import byte_spans, mix, paired

#: A worker's cache starts anew beyond so many stretches, or so many bytes of long ones or ids: these bound memory, not results.
CACHE_MOST, CACHE_BYTES = 800_000, 16 << 20
#: Places of the table in which hashes are looked up, at least: twice the stretches or more.
TABLE = 1 << 21
#: Bytes that a stretch's first and last eight bytes tell exactly; longer ones are compared byte by byte.
EXACT = 16
_U = np.uint64


def stretched(flat: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``flat``, of which ``used`` items count, with ``more`` behind them."""
    if used + len(more) > len(flat):
        flat = np.concatenate([flat[:used], np.zeros(max(used, len(more)) + len(more), flat.dtype)])
    flat[used : used + len(more)] = more
    return flat


def ends_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each stretch as integers; of one below eight bytes, all of it and 0."""
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # from each place on
    size = end - start
    short = np.minimum(size, 8).astype(_U) * _U(8)
    first = np.where(size > 0, eight[start] << (_U(64) - np.maximum(short, _U(8))), _U(0))
    return first, np.where(size >= 8, eight[np.maximum(end - 8, 0)], _U(0))


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches' bytes one after another, and where each begins."""
    begin = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(start - begin, size)], begin


class SliceIds:
    """Subclasses give :meth:`cut` (stretch starts) and :meth:`learn` (ids of one stretch).

    Stretches meet in the cache by a hash, looked up in a table with open addressing; their bytes are compared with the
    cached ones each time, and what differs is encoded by itself."""

    unit = np.dtype("<u2")

    def __init__(self) -> None:
        self._reset()

    def _reset(self, need: int = 0) -> None:
        self.slots, self.count = np.full(max(TABLE, 1 << (2 * need).bit_length()), -1, np.int32), 0
        self.mask = _U(len(self.slots) - 1)
        self.keys, self.first, self.last = (np.zeros(1 << 12, _U) for _ in range(3))
        self.lo, self.at, self.n, self.size = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.flat, self.used = np.zeros(1 << 16, self.unit), 0
        self.raw, self.raw_used = np.zeros(1 << 12, np.uint8), 0

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def learn(self, stretches: list[bytes]) -> list:
        raise NotImplementedError

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and the start and end in them of each stretch that may have ids."""
        start = self.cut(data, offsets)
        return data, start, np.append(start[1:], len(data))

    def hashed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size, (first, last) = end - start, ends_of(data, start, end)
        out = mix(paired(first, last) + size.astype(_U))
        long = np.flatnonzero(size > EXACT)
        own, begin = gathered(data, start[long], size[long])
        out[long] = byte_spans(own, begin, begin + size[long])
        return out

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, index of each document's first id, with one more at the end)."""
        if not len(data):
            return np.zeros(0, self.unit), np.zeros(len(offsets), np.int64)
        data, start, end = self.stretches(data, offsets)
        coded = pa.array(self.hashed(data, start, end)).dictionary_encode()
        key, where = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        found = self._found(key)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.count + len(new) > len(self.slots) // 2 or self.count > CACHE_MOST or max(self.raw_used, self.used) > CACHE_BYTES:
                self._reset(len(key))
                new = np.arange(len(key))
            sample = np.empty(len(key), np.int64)
            sample[where] = np.arange(len(where))
            found[new] = self._add(key[new], data, start[sample[new]], end[sample[new]])
        at = found[where]
        lo, n, flat = self.lo[at], self.n[at].astype(np.int64), self.flat
        wrong = self._wrong(data, start, end, at)
        if len(wrong):
            raw = data.tobytes()
            got = self.learn([raw[start[i] : end[i]] for i in wrong.tolist()])
            n[wrong] = [len(g) for g in got]
            lo[wrong] = self.used + np.cumsum(n[wrong]) - n[wrong]
            flat = np.concatenate([flat[: self.used], *(np.array(g, self.unit) for g in got)])
        begin = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=begin[1:])
        ids = flat[np.arange(begin[-1]) + np.repeat(lo - begin[:-1], n)]
        return ids, begin[np.searchsorted(start, offsets)]

    def _found(self, key: np.ndarray) -> np.ndarray:
        """The number of each key's stretch, -1 where it isn't cached."""
        out, left, place = np.full(len(key), -1, np.int32), np.arange(len(key)), key & self.mask
        while len(left):
            got = self.slots[place]
            hit = (got >= 0) & (self.keys[got] == key[left])
            out[left[hit]] = got[hit]
            more = ~hit & (got >= 0)
            left, place = left[more], (place[more] + _U(1)) & self.mask
        return out

    def _wrong(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The stretches whose bytes aren't those of the cached stretch with their hash."""
        size, (first, last) = end - start, ends_of(data, start, end)
        wrong = (self.size[at] != size) | (self.first[at] != first) | (self.last[at] != last)
        long = np.flatnonzero((size > EXACT) & ~wrong)
        if len(long):
            own, begin = gathered(data, start[long], size[long])
            wrong[long] = np.logical_or.reduceat(own != gathered(self.raw, self.at[at[long]].astype(np.int64), size[long])[0], begin)
        return np.flatnonzero(wrong)

    def _add(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of stretches with new, distinct keys."""
        raw = data.tobytes()
        got = self.learn([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])
        n, size, (first, last) = np.fromiter(map(len, got), np.int64, len(got)), end - start, ends_of(data, start, end)
        kept = np.where(size > EXACT, size, 0)
        lo, byte = self.used + np.cumsum(n) - n, self.raw_used + np.cumsum(kept) - kept
        self.flat = stretched(self.flat, self.used, np.fromiter(chain.from_iterable(got), self.unit, int(n.sum())))
        self.raw = stretched(self.raw, self.raw_used, gathered(data, start, kept)[0])
        self.used, self.raw_used = self.used + int(n.sum()), self.raw_used + int(kept.sum())
        for name, own in (("keys", key), ("first", first), ("last", last), ("lo", lo), ("at", byte), ("n", n), ("size", size)):
            setattr(self, name, stretched(getattr(self, name), self.count, own))
        number = np.arange(self.count, self.count + len(key), dtype=np.int32)
        self.count += len(key)
        left, place = number, key & self.mask
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            more = self.slots[place] != left  # the place was taken, or another one of these has got it
            left, place = left[more], (place[more] + _U(1)) & self.mask
        return number

    def batches(self, data: np.ndarray, offsets: np.ndarray):
        """For each slice of documents: (first document, ids, offsets of ids)."""
        for lo, hi in slices(offsets):
            ids, at = self.slice_ids(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield lo, ids, at


_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _SURE & ~_LETTER
_LOWER = np.zeros(256, np.uint8)
_LOWER[ord("A") : ord("Z") + 1] = 32
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [chr(b) if b in own else "" for b in range(256)]
    for n, b in enumerate(x for x in range(256) if x not in own):
        out[b] = chr(256 + n)
    return out


class LibraryIds(SliceIds):
    """Ids from the tokenizers library, for byte-level vocabularies whose pre-tokenizer splits
    letters, numbers, other characters and white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 1 << 16:
            self.unit = np.dtype("<u4")
        self.letters = byte_letters()
        probe = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.lowers = probe("A") == probe("a")
        self.space = "" if probe(" a") == probe("a") else self.letters[0x20]
        self.feed = probe("\n")
        super().__init__()

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(0, np.int64)
        wide = np.zeros(len(data), bool)  # ends a two-byte character from U+00C0 on
        wide[1:] = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        letter = wide & np.concatenate([[False], data[:-1] == 0xC3]) & (data != 0x97) & (data != 0xB7)
        at = np.zeros(len(data), bool)
        at[1:] = _GAP[data[1:]] & (_SURE[data[:-1]] | wide[:-1])
        at[1:] |= _MARK[data[1:]] & (_LETTER[data[:-1]] | letter[:-1])
        at[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(at)

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where case and white space give no ids of their own, A-Z are lower-cased, and a stretch's first gap is left out."""
        data, start, end = super().stretches(data, offsets)
        if self.lowers and not self.space and not self.feed:
            simple = np.ones(len(data), bool)  # what follows can't be composed with a letter before it
            simple[:-1] = (data[1:] < 0x80) | (data[1:] == 0xC3)
            start = start + _GAP[data[start]]
            data = data + _LOWER[data] * simple
        return data, start, end

    def learn(self, stretches: list[bytes]) -> list:
        out, letters, tokenize = [], self.letters, self.model.tokenize
        gaps = {b" ": (self.space, []), b"\n": ("", self.feed)}
        for raw in stretches:
            space, feed = gaps.get(raw[:1], ("", []))
            word = raw[1:] if raw[:1] in gaps else raw
            if word.isalpha():  # ASCII letters stand for themselves
                text = word.decode()
                out.append(feed + [t.id for t in tokenize(space + (text.lower() if self.lowers else text))])
            elif m := _PLAIN.fullmatch(text := raw.decode("utf-8", "replace")):
                word = m[2].lower() if self.lowers else m[2]
                out.append(feed + [t.id for t in tokenize(space + "".join([letters[b] for b in word.encode()]))])
            else:
                out.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return out


_OPEN: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    """One tokenizer and cache for each vocabulary in a worker."""
    if path not in _OPEN:
        _OPEN[path] = LibraryIds(path)
    return _OPEN[path]
