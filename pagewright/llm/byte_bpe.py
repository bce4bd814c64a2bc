"""Operator 8: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes; contractions and white space that ends before text are marked by
comparing shifted class arrays; a finite automaton then finds the boundaries.  Its transitions are
functions on states, and composing functions is associative, so blocks of characters are composed
side by side, the blocks' functions are scanned, and every block then runs from its true first
state.  No regular expression is used.  Distinct slices go through cached pair merging, and each
token's bytes are kept in one table with offsets, from which ids are decoded.

Null text is empty and gives no ids; empty tables give empty results; equal rows give equal rows;
rows with a null doc_id are left out; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, keyed, tidy
from .segments import SliceIds

# Character classes; *_LAST: white space with a character that isn't white space behind it.
L, N, O, SP, SP_LAST, WS, WS_LAST, APOS1, APOS2 = range(9)
# States: the last character's class where that is enough, and the place inside a contraction.
START, S_L, S_N, S_O, S_SP, S_WS, ONE_LEFT, TWO_LEFT, CLOSED = range(9)
BLOCK = 64
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts), both by class (plus 9 for a document's first character) and state."""
    step, cut = np.zeros((18, 9), np.uint8), np.zeros((18, 9), bool)
    space = (S_SP, S_WS)
    for c in range(9):
        for s in range(9):
            joins, to = False, S_O
            if c == L:
                joins, to = s in (S_L, S_SP, ONE_LEFT, TWO_LEFT), {ONE_LEFT: CLOSED, TWO_LEFT: ONE_LEFT}.get(s, S_L)
            elif c == N:
                joins, to = s in (S_N, S_SP), S_N
            elif c == O:
                joins = s in (S_O, S_SP)
            elif c in (APOS1, APOS2):
                joins = s in (S_O, S_SP)
                to = S_O if joins else ONE_LEFT if c == APOS1 else TWO_LEFT
            elif c in (SP, WS):
                joins, to = s in space, S_SP if c == SP else S_WS
            else:
                to = S_SP if c == SP_LAST else S_WS
            step[c, s], cut[c, s] = to, not joins
        step[c + 9], cut[c + 9] = step[c, START], True
    return step, cut


_STEP, _CUT = _automaton()
_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _CLASS:
        kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        out = np.full(sys.maxunicode + 1, O, np.uint8)
        out[[k == "L" for k in kinds]] = L
        out[[k == "N" for k in kinds]] = N
        out[_WHITE] = WS
        out[0x20] = SP
        _CLASS.append(out)
    return _CLASS[0]


def boundaries(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point; ``first`` marks each document's first one."""
    n = len(codes)
    kind = classes()[codes]
    follow = np.full(n + 2, 0, np.uint32)
    follow[:n] = codes
    last = np.empty(n, bool)  # of its document
    last[-1], last[:-1] = True, first[1:]
    white = (kind == SP) | (kind == WS)
    ends = np.zeros(n, bool)
    ends[:-1] = ~white[1:]
    kind[white & ends & ~last] += 1
    apos = np.flatnonzero((codes == 0x27) & ~last)
    if len(apos):
        a, b = follow[apos + 1], follow[apos + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ~last[np.minimum(apos + 1, n - 1)] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        kind[apos[one]] = APOS1
        kind[apos[two & ~one]] = APOS2
    kind[first] += 9
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.intp)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T) * 9
    step, cut = _STEP.ravel(), _CUT.ravel()
    whole = np.broadcast_to(np.arange(9, dtype=np.uint8), (rows, 9)).copy()
    for col in grid:  # each block's function on all states
        whole = step.take(col[:, None] + whole)
    gap = 1
    while gap < rows:  # an inclusive scan: the functions of doubling stretches of blocks composed
        whole[gap:] = np.take_along_axis(whole[gap:], whole[:-gap].copy(), axis=1)
        gap *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = whole[:-1, START]
    out = np.empty((BLOCK, rows), bool)
    for t, col in enumerate(grid):
        at = col + state
        out[t] = cut.take(at)
        state = step.take(at)
    return out.T.ravel()[:n]


class ByteBpe(SliceIds):
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        if len(self.tokens) > 1 << 16:
            self.unit = np.dtype("<u4")
        self.names = [str(i) for i in range(len(self.tokens))]
        size = np.array([len(t) for t in self.tokens], np.int64)
        self.table, self.table_n = np.frombuffer(b"".join(self.tokens), np.uint8), size
        self.table_lo = np.cumsum(size) - size
        super().__init__()

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(0, np.int64)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(data), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        return heads[boundaries(codes, first[heads])]

    def learn(self, stretches: list[bytes]) -> list:
        return [self.merge(s) for s in stretches]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: always the pair of lowest rank, leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 128:
            return self._merge_long(parts)
        pair = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pair:
            best = min(pair)
            if best == 1 << 60:
                break
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap, for slices where searching all pairs each time would be slow."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(joined + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, joined + parts[after[i]]))
            if before[i] >= 0 and (r := ranks.get(parts[before[i]] + joined)) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]] + joined))
        return [ranks[p] for p in parts if p]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.table_n[ids]
        begin = np.cumsum(n) - n
        return self.table[np.arange(int(n.sum())) + np.repeat(self.table_lo[ids] - begin, n)].tobytes()


_OPEN: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _OPEN:
        _OPEN[path] = ByteBpe(path)
    return _OPEN[path]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, ids, at in bpe.batches(data, offsets):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo : lo + len(at) - 1], lists], ["doc_id", "ids"])

    return keyed(documents).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, content binary) of rows as :func:`encode` gives them."""

    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            got = [bpe.decode(np.asarray(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.binary())], ["doc_id", "content"])

    return encoded.mapInArrow(tidy(run), "doc_id long, content binary")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, so that
    ids don't leave the worker."""

    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, ids, at in bpe.batches(data, offsets):
                n, a, b = np.diff(at), [], []
                for i in range(len(n)):
                    own = ids[at[i] : at[i + 1]].tolist()
                    a.append(hashlib.sha256(",".join([bpe.names[x] for x in own]).encode()).hexdigest())
                    b.append(hashlib.sha256(b"".join([bpe.tokens[x] for x in own])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo : lo + len(n)], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return keyed(documents).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
