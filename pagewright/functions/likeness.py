"""How alike two texts are, with upper bounds that spare most of the exact comparisons.

The likeness of two texts is twice the characters in their matching blocks over the characters of both.  Matching blocks are a
common subsequence made of common characters, so three bounds hold, each dearer and closer than the one before: by the
lengths alone, by the characters that both have, and by their longest common subsequence, which bit vectors give for one text
against many at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import Words, coded, likenesses, matched_letters, numbered, ragged
from .kernels import LETTERS, blocks, distance

#: Texts longer than this are compared exactly without the third bound; bit vectors would be as dear as the comparison.
LONGEST = 4096
#: More than rounding changes a bound by.
ROUNDING = 1e-9


def likeness(a: str, b: str) -> float:
    """2 M / T of the case-folded texts; 1 for two empty ones."""
    a, b = a.casefold(), b.casefold()
    return 2 * sum(n for _, _, n in blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(likenesses([x or "" for x in a], [y or "" for y in b]), dtype="float64")


class Texts:
    """Case-folded texts as a matrix of letter numbers (0 where a text has ended) and their letter counts."""

    def __init__(self, texts: list[str]):
        self.texts = [t.casefold() for t in texts]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters, number = np.unique(codes, return_inverse=True)
        self.rows = np.repeat(np.arange(len(texts)), self.size)
        self.number = number.astype(np.int64) + 1
        self.start = np.cumsum(self.size) - self.size
        self.counts = np.zeros((len(texts), len(self.letters) + 1), np.int64)
        np.add.at(self.counts, (self.rows, self.number), 1)

    def numbers(self, text: str) -> np.ndarray:
        """The letters' numbers in a text; 0 for those that none of these texts has."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), max(len(self.letters) - 1, 0))
        return np.where(self.letters[at] == codes, at + 1, 0) if len(self.letters) else np.zeros(len(codes), np.int64)

    def matrix(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(own), int(self.size[own].max(initial=0))), np.int64)
        at = np.arange(out.shape[1])
        inside = at < self.size[own][:, None]
        out[inside] = self.number[(self.start[own][:, None] + at)[inside]]
        return out


def common_subsequence(text: np.ndarray, others: np.ndarray, letters: int) -> np.ndarray:
    """Lengths of the longest common subsequence of a text with each row of others, letter numbers all; 0 matches nothing.

    One bit for each place of the text, in words of 64; an addition carries over from word to word."""
    n, words = len(text), -(-len(text) // 64)
    place = np.arange(n)
    masks = np.zeros((letters + 1, words), np.uint64)
    np.bitwise_or.at(masks, (text, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    masks[0] = 0
    state = np.full((len(others), words), ~np.uint64(0))
    for column in others.T:
        hit = masks[column]
        both = state & hit
        added = state + both
        carry = added < both
        for w in range(1, words):
            more = added[:, w] + carry[:, w - 1]
            carry[:, w] |= more < added[:, w]
            added[:, w] = more
        state = added | (state & ~hit)
    last = np.full(words, ~np.uint64(0))
    if n % 64:
        last[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    return n - np.bitwise_count(state & last).sum(1).astype(np.int64)


def by_characters(text: str, among: Texts, floor: float, skip: np.ndarray | None = None, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, bounds) of the texts from ``lo`` to ``hi`` that may be as like a case-folded one as the floor, by lengths and common
    characters, in the order of their bounds."""
    size, counts = among.size[lo:hi], among.counts[lo:hi]
    total = size + len(text)
    scale = 2 / np.maximum(total, 1)
    bound = np.where(total, scale * np.minimum(size, len(text)), 1.0)
    left = np.flatnonzero(bound >= floor) if skip is None else np.flatnonzero((bound >= floor) & ~skip)
    count = np.bincount(among.numbers(text), minlength=counts.shape[1])
    closer = np.where(total[left], scale[left] * np.minimum(counts[left, 1:], count[1:]).sum(1), 1.0)
    order = np.argsort(-closer, kind="stable")[: np.count_nonzero(closer >= floor)]
    return lo + left[order], closer[order]


def by_subsequence(text: str, among: Texts, left: np.ndarray, bound: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The same after the closest bound, for those of ``left`` that may still reach the floor."""
    left, bound = left[bound >= floor], bound[bound >= floor].copy()
    if 0 < len(text) <= LONGEST:
        number, near = among.numbers(text), np.flatnonzero(among.size[left] <= LONGEST)
        near = near[np.argsort(among.size[left[near]], kind="stable")]  # texts of like lengths together
        for some in np.array_split(near, -(-len(near) * int(among.size[left[near]].max(initial=1)) // (1 << 18)) or 1):
            own = left[some]
            bound[some] = 2 / (among.size[own] + len(text)) * common_subsequence(number, among.matrix(own), len(among.letters))
    order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound >= floor)]
    return left[order], bound[order]


def best_of(text: str, among: Texts, ids: list, own, floor: float, spare=None) -> tuple[float, object] | None:
    """(likeness, id) of the text among others that is most like this one, by (likeness, id), but for the one with the id
    ``own``; None if none reaches the floor.  ``spare(i)`` says whether a text that would win is to be passed over.

    The two that share most characters are compared first; what can't beat them isn't looked at more closely.  Bounds are rounded
    otherwise than likenesses, so what only rounding puts below the best is compared too: it may be as like, and later."""
    text, best = text.casefold(), None
    left, bound = by_characters(text, among, floor, np.array([x == own for x in ids], bool))

    def compare(i: int) -> None:
        nonlocal best
        other = among.texts[i]
        total = len(other) + len(text)
        got = (2 * sum(n for _, _, n in blocks(other, text)) / total if total else 1.0, ids[i])
        if got[0] >= floor and (best is None or got > best) and not (spare and spare(i)):
            best = got

    for i in left[:2].tolist():
        compare(i)
    left, bound = by_subsequence(text, among, left[2:], bound[2:], max(floor, best[0] - ROUNDING) if best else floor)
    for i, most in zip(left.tolist(), bound.tolist()):
        if best is not None and most < best[0] - ROUNDING:
            break
        compare(i)
    return best


#: Bits of state, and letters of texts, that pairs of texts may have that are looked at together.
STATES, CELLS = 1 << 16, 1 << 20
#: Letters of the longer text beyond which one pair's whole numbers are faster than columns of many pairs.
WIDEST = 1024


def _alike(words: np.ndarray, columns: np.ndarray):
    """Pairs in stretches of like sizes, by the words of their states and the letters that they are led through."""
    order, lo = np.lexsort((columns, words)), 0
    while lo < len(order):
        # The widest state and the longest text of a stretch are at most those of its end.
        held = order[lo : lo + STATES]
        rows, wide = np.arange(1, len(held) + 1), words[held]
        fits = (rows * wide <= STATES) & (rows * np.maximum.accumulate(columns[held]) <= CELLS) & (wide <= 2 * wide[0])
        held = held[: max(1, len(fits) if fits.all() else int(np.argmin(fits)))]
        lo += len(held)
        yield held


def common_subsequences(texts: list[np.ndarray], which: np.ndarray, among: Texts, others: np.ndarray) -> np.ndarray:
    """:func:`common_subsequence` of many pairs (which text, which other one), pairs of like sizes together."""
    out = np.zeros(len(which), np.int64)
    words, letters = np.array([-(-len(t) // 64) for t in texts], np.int64), len(among.letters) + 1
    for held in _alike(words[which], among.size[others]):
        own, local = np.unique(which[held], return_inverse=True)
        n = int(words[own].max(initial=1))
        masks = np.zeros((n, len(own) * letters), np.uint64)
        for k, t in enumerate(own.tolist()):
            place = np.arange(len(texts[t]))
            np.bitwise_or.at(masks, (place // 64, k * letters + texts[t]), np.uint64(1) << (place % 64).astype(np.uint64))
        masks[:, np.arange(len(own)) * letters] = 0
        state = np.full((n, len(held)), ~np.uint64(0))
        for column in among.matrix(others[held]).T:
            hit = masks[:, local * letters + column]
            both = state & hit
            added = state + both
            carry = added < both
            for w in range(1, n):
                more = added[w] + carry[w - 1]
                carry[w] |= more < added[w]
                added[w] = more
            state = added | (state & ~hit)
        size = np.array([len(texts[t]) for t in own.tolist()], np.int64)[local]
        bits = np.clip(size - 64 * np.arange(n)[:, None], 0, 64)
        inside = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
        out[held] = size - np.bitwise_count(state & inside).sum(0).astype(np.int64)
    return out


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`pagewright.functions.kernels.distance` of many pairs, pairs of like sizes together."""
    texts = a, b
    (a, a_at), (b, b_at) = coded(a), coded(b)
    sides = [[a, a_at[:-1].copy(), a_at[1:].copy()], [b, b_at[:-1].copy(), b_at[1:].copy()]]
    for end in (False, True):  # what both begin and end with is left out
        most = np.minimum(*(hi - lo for _, lo, hi in sides))
        steps = ragged(np.zeros(len(most), np.int64), most)
        x, y = (codes[np.repeat(hi - 1, most) - steps if end else np.repeat(lo, most) + steps] for codes, lo, hi in sides)
        unlike, at = np.flatnonzero(x != y), np.cumsum(most) - most
        alike = np.minimum(np.append(unlike, len(x))[np.searchsorted(unlike, at)] - at, most)
        for side in sides:
            side[2 if end else 1] += -alike if end else alike
    size = [hi - lo for _, lo, hi in sides]
    out = np.maximum(*size)
    swap = size[0] < size[1]
    letters, number = numbered(np.concatenate([a, b]))
    flat = number.astype(np.int64) + 1
    first = [sides[0][1], sides[1][1] + len(a)]
    long_at, short_at = np.where(swap, first[1], first[0]), np.where(swap, first[0], first[1])
    long_n, short_n = np.maximum(*size), np.minimum(*size)
    for k in np.flatnonzero((short_n > 0) & (long_n > WIDEST)).tolist():
        out[k] = distance(texts[0][k], texts[1][k])
    todo = np.flatnonzero((short_n > 0) & (long_n <= WIDEST))
    for held in _alike(-(-long_n[todo] // 64), short_n[todo]):
        held = todo[held]
        rows, m, columns = len(held), long_n[held], short_n[held]
        n, wide, most = int(-(-m.max() // 64)), len(letters) + 1, int(columns.max())
        masks = np.zeros((n, rows * wide), np.uint64)
        place, row = ragged(np.zeros(rows, np.int64), m), np.repeat(np.arange(rows), m)
        np.bitwise_or.at(masks, (place // 64, row * wide + flat[long_at[held][row] + place]), np.uint64(1) << (place % 64).astype(np.uint64))
        text = np.zeros((most, rows), np.int64)
        inside = np.arange(most)[:, None] < columns
        text[inside] = flat[(short_at[held] + np.arange(most)[:, None])[inside]]
        own, base = np.arange(rows), np.arange(rows) * wide
        top, bit, one = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64), np.uint64(1)
        more, less, count = np.full((n, rows), ~np.uint64(0)), np.zeros((n, rows), np.uint64), m.copy()
        for k in range(most):
            hit = masks[:, base + text[k]]
            straight, both = hit | less, hit & more
            added = both + more
            carry = added < both
            for w in range(1, n):
                next_ = added[w] + carry[w - 1]
                carry[w] |= next_ < added[w]
                added[w] = next_
            across = (added ^ more) | hit
            up, down = less | ~(across | more), more & across
            count += np.where(inside[k], (up[top, own] >> bit & one).astype(np.int64) - (down[top, own] >> bit & one).astype(np.int64), 0)
            up_in, down_in = up[:-1] >> np.uint64(63), down[:-1] >> np.uint64(63)
            up, down = up << one, down << one
            up[0] |= one
            up[1:] |= up_in
            down[1:] |= down_in
            more, less = down | ~(straight | up), up & straight
        out[held] = count
    return out


def best_of_each(texts: list[str], among: Texts, bodies: list[str], ids: list, owns: list, floors: list[float], own_texts: list[str] | None = None, twin: float | None = None, ranges: list[tuple[int, int]] | None = None) -> list[tuple[float, object] | None]:
    """:func:`best_of` of many texts, all together, each among the others of its range (none given: all); with ``twin``, others (``bodies``)
    so like a text's ``own_texts`` are passed over."""
    ranges = [(0, len(ids))] * len(texts) if ranges is None else ranges
    texts, best = [t.casefold() for t in texts], [None] * len(texts)
    twins: dict[tuple[str, int], bool] = {}

    def compare(pairs: list[tuple[int, int]]) -> None:
        scores = [float(2 * m / total) if total else 1.0 for m, total in zip(matched_letters([among.texts[i] for _, i in pairs], [texts[q] for q, _ in pairs]).tolist(), [len(among.texts[i]) + len(texts[q]) for q, i in pairs])]
        won = [(q, i, (score, ids[i])) for (q, i), score in zip(pairs, scores) if score >= floors[q] and (best[q] is None or (score, ids[i]) > best[q])]
        if twin is not None:
            asked = list({(own_texts[q], i): None for q, i, _ in won if (own_texts[q], i) not in twins})
            twins.update(zip(asked, (likenesses([t for t, _ in asked], [bodies[i] for _, i in asked]) >= twin).tolist()))
            won = [x for x in won if not twins[own_texts[x[0]], x[1]]]
        for q, _, got in won:
            if best[q] is None or got > best[q]:
                best[q] = got

    same = np.array(ids, dtype=object)
    left, bound = zip(*(by_characters(t, among, floor, same[lo:hi] == own, lo, hi) for t, floor, own, (lo, hi) in zip(texts, floors, owns, ranges))) if texts else ((), ())
    compare([(q, i) for q, own in enumerate(left) for i in own[:2].tolist()])
    least = [max(f, b[0] - ROUNDING) if b else f for f, b in zip(floors, best)]
    keep = [bounds[2:] >= f for bounds, f in zip(bound, least)]
    left, bound = [x[2:][k] for x, k in zip(left, keep)], [x[2:][k].copy() for x, k in zip(bound, keep)]
    which, others = np.repeat(np.arange(len(texts)), [len(x) for x in left]), np.concatenate([np.zeros(0, np.int64), *left])
    closer = np.concatenate([np.zeros(0), *bound])
    size = np.array([len(t) for t in texts], np.int64)[which]
    near = np.flatnonzero((size > 0) & (size <= LONGEST) & (among.size[others] <= LONGEST))
    closer[near] = 2 / (among.size[others] + size)[near] * common_subsequences([among.numbers(t) if 0 < len(t) <= LONGEST else np.zeros(0, np.int64) for t in texts], which[near], among, others[near])
    order = np.lexsort((-closer, which))
    bounds = np.searchsorted(which, np.arange(len(texts) + 1)).tolist()
    at, step, open_ = bounds[:-1], 1, range(len(texts))
    while open_:
        pairs, still = [], []
        for q in open_:
            limit = max(floors[q], best[q][0] - ROUNDING) if best[q] else floors[q]
            some = order[at[q] : min(at[q] + step, bounds[q + 1])]
            some = some[closer[some] >= limit]
            pairs += [(q, i) for i in others[some].tolist()]
            at[q] += step
            if len(some) == step and at[q] < bounds[q + 1]:
                still.append(q)
        compare(pairs)
        open_, step = still, min(2 * step, 64)
    return best


def unanchored_share(source: str, output: str, least: float = 0.5) -> float:
    """Share of the output's words of three letters or more that aren't in the source: neither somewhere in its text, nor as like
    one of its words as ``least``."""
    low = source.lower()
    own, words = (dict.fromkeys(w for w in LETTERS.findall(t.lower()) if len(w) >= 3) for t in (source, output))
    counted = [w for w in LETTERS.findall(output.lower()) if len(w) >= 3]
    if not counted:
        return 0.0
    among, bad = Texts(list(own)), set()
    for w in words:
        if w not in low and not any(2 * sum(n for _, _, n in blocks(w, among.texts[i])) >= least * (len(w) + len(among.texts[i])) for i in by_characters(w, among, least)[0].tolist()):
            bad.add(w)
    return sum(w in bad for w in counted) / len(counted)


@F.pandas_udf(T.DoubleType())
def unanchored_share_of(source: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([unanchored_share(a or "", b or "") for a, b in zip(source, output)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("run", T.IntegerType()), T.StructField("invented", T.IntegerType())]))
def unanchored_runs_of(source: pd.Series, output: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """The longest runs of the output's words that are anchored not in the source, and neither there nor in the truth."""
    words = Words([t or "" for t in output])
    here = words.anchored([t or "" for t in source])
    # Where source and truth are the same, so are the words that are anchored in them.
    differs = np.array([a != t for a, t in zip(source, truth)], bool)
    there = words.anchored([t or "" if other else "" for t, other in zip(truth, differs)]) | np.repeat(~differs, np.diff(words.places)) & here
    return pd.DataFrame({"run": words.longest(~here), "invented": words.longest(~here & ~there)})
