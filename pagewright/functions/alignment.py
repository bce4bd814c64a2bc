"""Matching blocks of many pairs of texts at once, as difflib's get_matching_blocks gives them without autojunk.

Texts stand one behind the other, so that the ranges still to be aligned, of whatever pair, lie in one order in both rows.  Equal
stretches of ``k`` letters give all maximal runs of ``k`` letters or more; the longest run of each range is taken, all ranges at
once, the others are cut by it, and so on.  What is left between holds no run of ``k`` letters and is searched with a smaller ``k``.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

from .kernels import LETTERS, blocks, fold_char

#: Lengths of stretches, and the least product of a range's sides that each is worth while for.
LADDER = ((64, 1 << 24), (16, 1 << 18), (4, 1 << 8), (2, 1 << 7), (1, 1))
#: Letters of both texts that are aligned at once; a longer pair alone, whole.
LETTERS_AT_ONCE = 1 << 17
#: Pairs of equal stretches that are held at once; a range with more is aligned by :func:`pagewright.functions.kernels.blocks`.
SEEDS = 1 << 20


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of stretches of some sizes, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each text starts and the last one ends)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def fold_codes(codes: np.ndarray) -> np.ndarray:
    """:func:`pagewright.functions.kernels.fold` of code points, worked out once for each distinct one."""
    own, number = numbered(codes)
    table = np.array([ord(fold_char(chr(c))) for c in own.tolist()], np.uint32)
    return table[number] if len(own) else codes


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct code points in order, the number of each code point among them)."""
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]


def _alone(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """The blocks of one pair by :func:`pagewright.functions.kernels.blocks`, however many pairs of equal stretches it has."""
    own, number = numbered(np.concatenate([a, b]))
    if len(own) >= 0x110000:  # more of them than letters
        return [tuple(m) for m in SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks() if m.size]
    text = number.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return blocks(text[: len(a)], text[len(a) :])


class _Stretches:
    """Numbers for the stretches of each length at every place of both rows; equal ones are equal."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.cut, self.most = len(a), int(max(a.max(initial=0), b.max(initial=0))) + 1
        self.held = {1: (np.concatenate([a, b]), self.most)}

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        if k not in self.held:
            self.of(k // 2)
            half, most = self._within(*self.held[k // 2], 20)  # else pairs of them overflow
            key = half * most + np.append(half[k // 2 :], np.zeros(min(k // 2, len(half)), np.int64))
            self.held[k] = self._within(key, most * most, 40)
        key, most = self.held[k]
        return key[: self.cut], key[self.cut :], most

    @staticmethod
    def _within(key: np.ndarray, most: int, bits: int) -> tuple[np.ndarray, int]:
        """Numbers below 2**bits or no larger than there are distinct ones."""
        if most <= 1 << bits:
            return key, most
        _, key = np.unique(key, return_inverse=True)
        return key, int(key.max(initial=0)) + 1


def _chosen(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the longest runs of ranges those that are taken: the first in ``a``, then in ``b``, and then always the first behind it."""
    order = np.lexsort((j, i))
    i, j, n = i[order], j[order], n[order]
    taken, x_end, y_end = [], -1, -1
    for k, (x, y, size) in enumerate(zip(i.tolist(), j.tolist(), n.tolist())):
        if x >= x_end and y >= y_end:
            taken.append(k)
            x_end, y_end = x + size, y + size
    return i[taken], j[taken], n[taken]


def _taken(i: np.ndarray, j: np.ndarray, n: np.ndarray, own: np.ndarray, ranges: int, k: int) -> list[tuple]:
    """Blocks from the maximal runs (i, j, n) of ranges (own)."""
    out = []
    while len(i):
        most = np.zeros(ranges, np.int64)
        np.maximum.at(most, own, n)
        longest = n == most[own]
        x, y, size = _chosen(i[longest], j[longest], n[longest])
        out.append((x, y, size))
        # A run is no longer than the blocks beside it, so what is left of it lies before or behind one block, never both.
        g = np.searchsorted(x, i, "right")
        ends = np.stack([np.append(-1, x + size), np.append(-1, y + size)])[:, g]
        starts = np.stack([np.append(x, 1 << 62), np.append(y, 1 << 62)])[:, g]
        skip = np.maximum(0, np.maximum(ends[0] - i, ends[1] - j))
        left = np.minimum(n, np.minimum(starts[0] - i, starts[1] - j)) - skip
        keep = left >= k
        i, j, n, own = (i + skip)[keep], (j + skip)[keep], left[keep], (own + g)[keep]
        ranges += len(x)
    return out


def _found(k: int, stretches: _Stretches, a: np.ndarray, b: np.ndarray, ranges: np.ndarray) -> list[tuple]:
    """The blocks of ``k`` letters or more of ranges (rows: from, to in a; from, to in b)."""
    alo, ahi, blo, bhi = ranges
    na, nb = np.maximum(ahi - alo - k + 1, 0), np.maximum(bhi - blo - k + 1, 0)
    key_a, key_b, most = stretches.of(k)
    at_a, at_b = ragged(alo, na), ragged(blo, nb)
    own_a = np.repeat(np.arange(len(alo)), na)
    key_a, key_b = own_a * most + key_a[at_a], np.repeat(np.arange(len(blo)), nb) * most + key_b[at_b]
    order = np.argsort(key_b)
    held = key_b[order]
    first, last = np.searchsorted(held, key_a), np.searchsorted(held, key_a, "right")
    some = last > first
    at_a, own_a, first, count = at_a[some], own_a[some], first[some], (last - first)[some]
    each = np.bincount(own_a, count, len(alo)).astype(np.int64)
    out = []
    for r in np.flatnonzero(each > SEEDS).tolist():
        got = _alone(a[alo[r] : ahi[r]], b[blo[r] : bhi[r]])
        out.append(tuple(np.array(v, np.int64) + x for v, x in zip(zip(*got), (alo[r], blo[r], 0))))
    each[each > SEEDS] = 0
    part = (np.cumsum(each) - each) // SEEDS  # of the ranges
    able = each[own_a] > 0
    at_a, own_a, first, count = at_a[able], own_a[able], first[able], count[able]
    bounds = np.searchsorted(part[own_a], np.arange(int(part[-1]) + 2)) if len(own_a) else [0]
    side = len(a) + 1
    for lo, hi in zip(bounds, bounds[1:]):
        if lo == hi:
            continue
        i = np.repeat(at_a[lo:hi], count[lo:hi])
        j = at_b[order[ragged(first[lo:hi], count[lo:hi])]]
        key = (i - j + len(b)) * side + i  # by diagonals
        key.sort()
        begins = np.append(0, np.flatnonzero(np.diff(key) != 1) + 1)
        n = np.diff(np.append(begins, len(key))) + k - 1
        i = key[begins] % side
        j = i - (key[begins] // side - len(b))
        out += _taken(i, j, n, np.searchsorted(alo, i, "right") - 1, len(alo), k)
    return out


def _aligned(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, ...]:
    pairs = np.arange(len(a_at) - 1)
    # A place between neighbouring texts, so that no run goes from one to the next.
    _, number = numbered(np.concatenate([a, b]))
    rows, starts = [], []
    for values, at in ((number[: len(a)] + 1, a_at), (number[len(a) :] + 1, b_at)):
        row = np.zeros(len(values) + len(pairs), np.int64)
        row[ragged(at[:-1] + pairs, np.diff(at))] = values
        rows.append(row)
        starts.append(at[:-1] + pairs)
    stretches = _Stretches(*rows)
    todo = np.stack([starts[0], starts[0] + np.diff(a_at), starts[1], starts[1] + np.diff(b_at)])
    # Equal texts are one block.
    same = np.diff(a_at) == np.diff(b_at)
    size = np.where(same, np.diff(a_at), 0)
    unlike = np.append(0, np.cumsum(rows[0][ragged(todo[0], size)] != rows[1][ragged(todo[2], size)]))
    ends = np.append(0, np.cumsum(size))
    same &= unlike[ends[1:]] == unlike[ends[:-1]]
    out = [(todo[0][same], todo[2][same], size[same])]
    todo = todo[:, ~same]
    for k, least in LADDER:
        todo = todo[:, (todo[1] > todo[0]) & (todo[3] > todo[2])]
        sides = todo[1] - todo[0], todo[3] - todo[2]
        chosen = (sides[0] * sides[1] >= least) & (np.minimum(*sides) >= k)
        if not chosen.any():
            continue
        found = _found(k, stretches, *rows, todo[:, chosen])
        if found:
            i, j, n = (np.concatenate(x) for x in zip(*found))
            out.append((i, j, n))
            todo = np.stack([np.sort(np.concatenate(x)) for x in ((todo[0], i + n), (todo[1], i), (todo[2], j + n), (todo[3], j))])
    i, j, n = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(i)
    i, j, n = i[order], j[order], n[order]
    i, j, n = i[n > 0], j[n > 0], n[n > 0]
    # Neighbouring blocks are one.
    begins = np.flatnonzero(np.append(True, (i[1:] != i[:-1] + n[:-1]) | (j[1:] != j[:-1] + n[:-1]))[: len(i)])
    n = np.add.reduceat(n, begins) if len(begins) else n
    i, j = i[begins], j[begins]
    pair = np.searchsorted(starts[0], i, "right") - 1
    return pair, i - starts[0][pair], j - starts[1][pair], n


def many_blocks(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place in a, place in b, length) of the matching blocks of each pair of texts, in order."""
    ends, lo, out = a_at[1:] + b_at[1:], 0, [(np.zeros(0, np.int64),) * 4]
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LETTERS_AT_ONCE, "right")))
        pair, i, j, n = _aligned(a[a_at[lo] : a_at[hi]], a_at[lo : hi + 1] - a_at[lo], b[b_at[lo] : b_at[hi]], b_at[lo : hi + 1] - b_at[lo])
        out.append((pair + lo, i, j, n))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out))


def matched_letters(a: list[str], b: list[str]) -> np.ndarray:
    """How many letters of each pair of texts lie in matching blocks."""
    pair, _, _, n = many_blocks(*coded(a), *coded(b))
    return np.bincount(pair, n, len(a)).astype(np.int64)


def supports(read: list[str], target: list[str]) -> np.ndarray:
    """Of each pair the share of the target's characters that the reading accounts for."""
    (a, a_at), (b, b_at) = coded(read), coded(target)
    pair, _, _, n = many_blocks(fold_codes(a), a_at, fold_codes(b), b_at)
    size = np.diff(b_at)
    return np.where(size > 0, np.bincount(pair, n, len(size)) / np.maximum(size, 1), 0.0)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """2 M / T of the case-folded texts of each pair; 1 for two empty ones."""
    a, b = [t.casefold() for t in a], [t.casefold() for t in b]
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    return np.where(total > 0, 2 * matched_letters(a, b) / np.maximum(total, 1), 1.0)


class Words:
    """The words of more than two letters of case-folded outputs."""

    def __init__(self, outputs: list[str]):
        self.codes, self.at = coded(texts := [t.casefold() for t in outputs])
        found = [[m.span() for m in LETTERS.finditer(t) if m.end() - m.start() > 2] for t in texts]
        self.places = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)
        spans = np.array([x for own in found for x in own], np.int64).reshape(-1, 2)
        self.start, self.end = (spans + np.repeat(self.at[:-1], np.diff(self.places))[:, None]).T

    def anchored(self, references: list[str]) -> np.ndarray:
        """For each word whether at least half of it lies in stretches of three or more characters that its output shares with the
        reference, upper and lower case alike."""
        pair, _, j, n = many_blocks(*coded([t.casefold() for t in references]), self.codes, self.at)
        long = n >= 3
        edge = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(edge, (self.at[pair] + j)[long], 1)
        np.add.at(edge, (self.at[pair] + j + n)[long], -1)
        held = np.append(0, np.cumsum(np.cumsum(edge)[:-1]))
        return 2 * (held[self.end] - held[self.start]) >= self.end - self.start

    def longest(self, flags: np.ndarray) -> np.ndarray:
        """The longest run of true flags among each output's words."""
        size, here = np.diff(self.places), np.arange(len(flags))
        last = np.maximum.accumulate(np.where(flags, -1, here))
        run = here - np.maximum(last, np.repeat(self.places[:-1], size) - 1)
        out = np.zeros(len(size), np.int64)
        if len(flags):
            out[size > 0] = np.maximum.reduceat(run, self.places[:-1][size > 0])
        return out


def stretches_of(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray):
    """For each pair of texts its stretches (from, to in a; from, to in b) as difflib's get_opcodes cuts them, one array a pair."""
    pair, i, j, n = many_blocks(a, a_at, b, b_at)
    bounds = np.searchsorted(pair, np.arange(len(a_at)))
    for p, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        x, y, size = (np.append(v[lo:hi], end) for v, end in ((i, a_at[p + 1] - a_at[p]), (j, b_at[p + 1] - b_at[p]), (n, 0)))
        x0, y0 = np.append(0, (x + size)[:-1]), np.append(0, (y + size)[:-1])
        each = np.stack([np.stack([x0, x, y0, y], 1), np.stack([x, x + size, y, y + size], 1)], 1).reshape(-1, 4)
        yield each[(each[:, 0] < each[:, 1]) | (each[:, 2] < each[:, 3])]


def reprojected(pages: list[tuple[list[str], list[str]]]) -> list[list[str]]:
    """:func:`pagewright.functions.kernels.reproject` of many pages (source lines, returned lines)."""
    (a, a_at), (b, b_at) = (coded(["\n".join(p[k]) for p in pages]) for k in (0, 1))
    out = []
    for (source, returned), edits in zip(pages, stretches_of(a, a_at, b, b_at)):
        text = "\n".join(returned)
        borders = np.cumsum([len(line) + 1 for line in source[:-1]], dtype=np.int64)
        if len(borders):
            i, _, j, j_end = edits[np.searchsorted(edits[:, 0], borders, "right") - 1].T
            borders = np.maximum.accumulate(np.minimum(j + borders - i, j_end))
        cuts = [0, *borders.tolist(), len(text)]
        out.append([text[x:y].strip("\n") for x, y in zip(cuts, cuts[1:])] if source else [])
    return out


def signals(pages: list[tuple[list[str], list[str]]], least: float = 0.5) -> list[tuple[int, int, int]]:
    """Of many pages (source lines, lines) how many lines came out empty, merged, or unlike their source."""
    out, asked = np.zeros((len(pages), 3), np.int64), []
    for p, (source, lines) in enumerate(pages):
        for s, t in zip(source, lines):
            if s.strip() and not t.strip():
                out[p, 0] += 1
                continue
            out[p, 1] += "\n" in t
            if s.strip() and s != t:
                asked.append((p, s, t))
    got = 2 * matched_letters([s for _, s, _ in asked], [t for _, _, t in asked])
    for (p, s, t), n in zip(asked, got.tolist()):
        out[p, 2] += n / (len(s) + len(t)) < least
    return [tuple(x) for x in out.tolist()]
