"""Kernels over whole Arrow columns of lists: widths of tokens and character spans of words, worked out for a batch of rows at once.

A column of lists is its values in one array and the places where each list starts and ends, so all lists are added up together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import fold_codes, many_blocks, numbered, ragged
from .kernels import BOXES, LEAST_WEIGHT, fold, shared_out

#: White space except the three no-break spaces, which belong to words.
SPACE = "^[\t-\r \u0085\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]+$"
# Types as objects: workers import this module where no session can parse type strings.
SPAN = T.StructType([T.StructField("x0", T.LongType()), T.StructField("x1", T.LongType())])
CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])
ALIGNED = T.StructType([T.StructField("support", T.DoubleType()), T.StructField("arms", T.ArrayType(BOXES))])
_MAP = pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())]))
_ALL = pa.list_(pa.struct([("text", pa.string()), ("hpos", pa.int64()), ("width", pa.int64())]))


def places(lists: pa.Array) -> np.ndarray:
    """Where each list starts in the flattened values, and the end of the last; null lists are empty."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)))


def numbers(column: pa.Array, kind=np.int64) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(kind)


def running(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running sums inside each list, added from left to right as a fold adds them; lists of like length stand in one matrix."""
    n = np.diff(at)
    out = np.empty(len(values))
    size = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    for k in np.unique(size[n > 0]):
        rows = np.flatnonzero((size == k) & (n > 0))
        for some in np.array_split(rows, min(len(rows), -(-(len(rows) << int(k)) // (1 << 21)))):
            column = np.arange(int(n[some].max()))
            inside = column < n[some][:, None]
            index = (at[some][:, None] + column)[inside]
            block = np.zeros(inside.shape)
            block[inside] = values[index]
            out[index] = np.cumsum(block, axis=1)[inside]
    return out


def totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of whole numbers by list."""
    sums = np.append(0, np.cumsum(values))
    return sums[at[1:]] - sums[at[:-1]]


def before(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the whole numbers before each one in its list."""
    sums = np.cumsum(values) - values
    return sums - np.repeat(sums[at[:-1][np.diff(at) > 0]], np.diff(at)[np.diff(at) > 0])


def at_least_one(widths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """No width below 1: what is missing is taken from the widest (the first of equal ones), down to 1, until repaid."""
    out = np.maximum(widths, 1)
    owed = totals(out - widths, at)
    for row in np.flatnonzero(owed):
        own = out[at[row] : at[row + 1]]
        order = np.argsort(-own, kind="stable")
        spare = own[order] - 1
        own[order] -= np.clip(owed[row] - (np.cumsum(spare) - spare), 0, spare)
    return out


def widths(tokens: pa.Array, at: np.ndarray, width: np.ndarray, rule: str, weights: np.ndarray | None = None) -> np.ndarray:
    """Widths of flattened tokens in boxes of a ``width``, from rounding running sums half to even.

    ``proportional`` adds up a box's unit times 1 a character, 0.6 a space; ``distributed`` divides once for each boundary, by 10 a
    character, 6 a space, or by ``weights``.  Without weight all tokens are as wide as each other."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    length = numbers(pc.utf8_length(tokens))
    blank = pc.fill_null(pc.match_substring_regex(tokens, SPACE), False).to_numpy(zero_copy_only=False)
    whole = length * np.where(blank, 6, 10)
    total = totals(whole, at)
    with np.errstate(divide="ignore", invalid="ignore"):
        if rule == "proportional":
            unit = width / (total / 10.0)
            edge = running(np.where(blank, length * 0.6, length.astype(float)) * unit[owner], at)
        elif weights is None:
            edge = width[owner] * (before(whole, at) + whole).astype(float) / total.astype(float)[owner]
        else:
            sums = running(weights, at)
            total = np.where(n > 0, sums[np.maximum(at[1:] - 1, 0)], 0.0) if len(sums) else np.zeros(len(n))
            edge = width[owner] * sums / total[owner]
        even = np.floor(width / np.maximum(n, 1)).astype(np.int64)
    edge = np.rint(np.where((total > 0)[owner], edge, 0.0)).astype(np.int64)
    previous = np.append(0, edge[:-1]) if len(edge) else edge
    previous[at[:-1][n > 0]] = 0
    return np.where((total > 0)[owner], edge - previous, even[owner])


def laid_out(tokens: pa.Array, hpos: pa.Array, width: pa.Array, rule: str, weights: pa.Array | None = None) -> pa.Array:
    """Boxes (text, hpos, width) of each row's tokens from ``hpos`` on; null where tokens or the box aren't known."""
    at, values = places(tokens), tokens.flatten()
    own = None if weights is None else numbers(weights.flatten(), float)
    w = at_least_one(widths(values, at, numbers(width), rule, own), at)
    x = np.repeat(numbers(hpos), np.diff(at)) + before(w, at)
    unknown = pc.or_(pc.or_(pc.is_null(tokens), pc.is_null(hpos)), pc.is_null(width)).to_numpy(zero_copy_only=False).copy()
    if values.null_count:
        unknown |= totals(pc.is_null(values).to_numpy(zero_copy_only=False).astype(np.int64), at) > 0
    boxes = pa.StructArray.from_arrays([values.cast(pa.string()), pa.array(x), pa.array(w)], ["text", "hpos", "width"])
    out = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), boxes)
    return pc.if_else(pa.array(unknown), pa.scalar(None, _ALL), out) if unknown.any() else out


@F.arrow_udf(BOXES["boxes"].dataType)
def proportional_of(tokens: pa.Array, hpos: pa.Array, width: pa.Array) -> pa.Array:
    return laid_out(tokens, hpos, width, "proportional")


@F.arrow_udf(BOXES["boxes"].dataType)
def distributed_of(tokens: pa.Array, hpos: pa.Array, width: pa.Array) -> pa.Array:
    return laid_out(tokens, hpos, width, "distributed")


@F.arrow_udf(BOXES["boxes"].dataType)
def weighted_of(tokens: pa.Array, hpos: pa.Array, width: pa.Array, weights: pa.Array) -> pa.Array:
    return laid_out(tokens, hpos, width, "distributed", weights)


@F.arrow_udf(CUT)
def cut_of(words: pa.Array) -> pa.Array:
    """Words (text, hpos, width) to a line's text and a span for each of its characters: each as wide as ``4 + code point % 13``
    from its word's left edge on, a space from one word's end to the next word's start."""
    at, flat = places(words), words.flatten()
    text, hpos, width = (flat.field(k) for k in range(3))
    hpos, end = numbers(hpos), numbers(hpos) + numbers(width)
    length, own = numbers(pc.utf8_length(text)), np.diff(at)
    first = np.zeros(len(length), bool)
    first[at[:-1][own > 0]] = True
    # Every word but a line's first has a space before its characters.
    size = length + ~first
    start = np.cumsum(size) - size
    codes = spelt(text)[0].astype(np.int64)
    wide = 4 + codes % 13
    chars = np.append(0, np.cumsum(length))
    left = np.repeat(hpos, length) + before(wide, chars)
    place = np.repeat(start + ~first - chars[:-1], length) + np.arange(len(codes))
    x0, x1 = np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()), np.int64)
    x0[place], x1[place] = left, left + wide
    blank, k = start[~first], np.flatnonzero(~first)
    x0[blank], x1[blank] = end[k - 1], hpos[k]
    bounds = np.append(0, np.cumsum(totals(size, at)))
    spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x0), pa.array(x1)], ["x0", "x1"]))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), text), " ")
    return pa.StructArray.from_arrays([lines, spans], ["text", "spans"])


#: What :func:`pagewright.functions.kernels.is_space` counts as white space.
BLANK = "^[\t-\r\x1c-\x1f \u0085\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]+$"
#: Cells of the table of blanks by boundaries that lines of like sizes share.
CELLS = 1 << 22


class _Snapping:
    """Boxes and blanks of a batch of lines, flat."""

    def __init__(self, boxes: pa.Array, gaps: pa.Array, hpos: pa.Array, width: pa.Array):
        self.boxes, self.at, self.gap_at = boxes, places(boxes), places(gaps)
        flat, blanks = boxes.flatten(), gaps.flatten()
        self.text, self.x, self.w = flat.field("text"), numbers(flat.field("hpos")), numbers(flat.field("width"))
        self.low, self.high = numbers(blanks.field("start")), numbers(blanks.field("end"))
        self.hpos, self.width = numbers(hpos), numbers(width)
        self.n, self.gaps = np.diff(self.at), np.diff(self.gap_at)
        self.space = pc.fill_null(pc.match_substring_regex(self.text, BLANK), False).to_numpy(zero_copy_only=False)

    def made(self, x: np.ndarray, w: np.ndarray) -> pa.Array:
        own = pa.StructArray.from_arrays([self.text, pa.array(x), pa.array(w)], ["text", "hpos", "width"])
        bounds = pa.array(self.at.astype(np.int32), mask=np.append(pc.is_null(self.boxes).to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(bounds, own)


def assigned(middles: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, gap_at: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """:func:`pagewright.functions.kernels.assign_gaps` for many lines: the number of each boundary's blank in its line; -1 for all of a
    line's boundaries if one of them has none.  Lines of like sizes stand in one table and go boundary by boundary together."""
    n, m, out = np.diff(gap_at), np.diff(at), np.full(len(middles), -1)
    size = (np.ceil(np.log2(np.maximum(n, 1))) * 64 + np.ceil(np.log2(np.maximum(m, 1)))).astype(np.int64)
    able = (n >= m) & (m > 0) & (tolerance > 0)
    for k in np.unique(size[able]):
        rows = np.flatnonzero(able & (size == k))
        for some in np.array_split(rows, min(len(rows), -(-len(rows) * int(n[rows].max() * m[rows].max()) // CELLS))):
            some = some[np.argsort(-m[some], kind="stable")]
            column = np.arange(int(n[some].max()))
            inside = column < n[some][:, None]
            index = np.where(inside, gap_at[some][:, None] + column, 0)
            a, b, off = low[index].astype(float), high[index].astype(float), tolerance[some][:, None]
            widest = np.where(inside, b - a, -np.inf).max(1)
            bonus, centres = 0.75 * (b - a) / np.where(widest == 0, 1.0, widest)[:, None], (a + b) / 2
            last, taken = np.zeros((len(some), len(column) + 1)), []
            for j in range(int(m[some[0]])):
                own = np.count_nonzero(m[some] > j)  # the lines with so many boundaries come first
                away = np.abs(centres[:own] - middles[at[some[:own]] + j][:, None])
                cost = last[:own, :-1] + np.where((away <= off[:own]) & inside[:own], away / off[:own] - bonus[:own], np.inf)
                last[:own, 0] = np.inf
                last[:own, 1:] = np.minimum.accumulate(cost, axis=1)
                taken.append(cost < last[:own, :-1])
            good, g = last[:, -1] < np.inf, np.full(len(some), len(column))
            for j in range(len(taken) - 1, -1, -1):
                own = len(taken[j])
                before_ = np.where(taken[j] & (column < g[:own][:, None]), column, -1).max(1)
                g[:own] = np.where(good[:own], before_, 0)
                out[at[some[:own]] + j] = np.where(good[:own], before_, -1)
    return out


@F.arrow_udf(BOXES["boxes"].dataType)
def snapped_of(boxes: pa.Array, gaps: pa.Array, hpos: pa.Array, width: pa.Array) -> pa.Array:
    """:func:`pagewright.functions.kernels.snapped_to_gaps` of each row."""
    s = _Snapping(boxes, gaps, hpos, width)
    space = np.flatnonzero(s.space)
    spaces = np.searchsorted(space, s.at)
    chars = totals(numbers(pc.utf8_length(s.text)), s.at)
    nth = assigned(s.x[space] + s.w[space] / 2, spaces, s.low, s.high, s.gap_at, 1.5 * s.width / np.maximum(chars, 1))
    owner = np.repeat(np.arange(len(s.n)), np.diff(spaces))
    space, owner, nth = space[nth >= 0], owner[nth >= 0], nth[nth >= 0]
    low, high = np.maximum(s.low[s.gap_at[owner] + nth], s.hpos[owner]), s.high[s.gap_at[owner] + nth]
    x, w = s.x.copy(), s.w.copy()
    x[space], w[space] = low, np.maximum(1, high - low)
    # Stretches of words before each blank and behind the last one of a line.
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    lo = np.where(first, s.at[owner], np.append(0, space[:-1] + 1)[: len(space)])
    left = np.where(first, s.hpos[owner], np.append(0, high[:-1])[: len(high)])
    lo, hi = np.append(lo, space[last] + 1), np.append(space, s.at[owner[last] + 1])
    left, right = np.append(left, high[last]), np.append(low, (s.hpos + s.width)[owner[last]])
    one = hi - lo == 1
    x[lo[one]], w[lo[one]] = left[one], np.maximum(1, right[one] - left[one])
    for i in np.flatnonzero(hi - lo > 1).tolist():
        x[lo[i] : hi[i]], w[lo[i] : hi[i]] = shared_out(s.w[lo[i] : hi[i]].astype(float), float(left[i]), float(right[i]))
    return s.made(x, w)


@F.arrow_udf(BOXES["boxes"].dataType)
def widened_of(boxes: pa.Array, gaps: pa.Array, hpos: pa.Array, width: pa.Array) -> pa.Array:
    """:func:`pagewright.functions.kernels.widened_to_ink` of each row."""
    s = _Snapping(boxes, gaps, hpos, width)
    if not len(s.x) or not len(s.low):
        return s.made(s.x, s.w)
    owner, gap_owner, place = np.repeat(np.arange(len(s.n)), s.n), np.repeat(np.arange(len(s.n)), s.gaps), np.arange(len(s.x))
    h, end = s.hpos[owner], (s.hpos + s.width)[owner]
    x0, x1, middle = s.x, s.x + s.w, s.x + s.w // 2
    # Numbers of one line lie apart from those of the next one, so all lines are searched at once.
    least = min(v.min() for v in (s.low, s.high, middle))
    room = max(v.max() for v in (s.low, s.high, middle)) - least + 1
    key = lambda v, whose: v - least + whose * room
    order_low, order_high = (np.lexsort((v, gap_owner)) for v in (s.low, s.high))
    before_ = np.searchsorted(key(s.high[order_high], gap_owner), key(middle, owner), "right")
    behind = np.searchsorted(key(s.low[order_low], gap_owner), key(middle, owner), "left")
    ink_from = np.where(before_ > s.gap_at[owner], s.high[order_high][np.maximum(before_ - 1, 0)], h)
    ink_to = np.where(behind < s.gap_at[owner + 1], s.low[order_low][np.minimum(behind, len(s.low) - 1)], end)
    x1 = np.where(s.space, x1, np.maximum(x1, np.minimum(ink_to, end)))
    begins = place == s.at[owner]
    previous = np.where(begins, h, np.append(0, x1[:-1]))
    x0 = np.where(s.space, x0, np.minimum(x0, np.maximum.reduce([ink_from, previous, np.maximum(h, 0)])))
    last = np.maximum.accumulate(np.where(s.space, -1, place))
    following = np.minimum.accumulate(np.where(s.space, len(place), place)[::-1])[::-1]
    left = np.where(last >= s.at[owner], x1[np.maximum(last, 0)], h)
    right = np.where(following < s.at[owner + 1], x0[np.minimum(following, len(place) - 1)], end)
    nth = place - np.maximum(last, s.at[owner] - 1) - 1
    a = np.where(nth == 0, left, np.maximum(left + 1, right) + nth - 1)
    b = np.where(nth == 0, np.maximum(left + 1, right), a + 1)
    some = (s.gaps > 0)[owner]
    a, b = np.where(s.space, a, x0), np.where(s.space, b, x1)
    return s.made(np.where(some, a, s.x), np.where(some, b - a, s.w))


@F.arrow_udf(T.ArrayType(SPAN))
def word_spans_of(words: pa.Array, boxes: pa.Array) -> pa.Array:
    """A span for each character of each row's words and of one space between neighbours, from word boxes [left, right]; null where a
    word is empty or has no box."""
    at, box_at, texts = places(words), places(boxes), words.flatten()
    n, own, length = np.diff(at), np.diff(box_at), numbers(pc.utf8_length(texts))
    unknown = pc.or_(pc.is_null(words), pc.is_null(boxes)).to_numpy(zero_copy_only=False)
    fits = ~unknown & (own >= n) & (totals((length == 0).astype(np.int64), at) == 0)
    held = ragged(at[:-1][fits], n[fits])
    each = boxes.flatten().take(pa.array(ragged(box_at[:-1][fits], n[fits])))
    # A box that is null or has no two numbers gives spans without edges.
    edge_at, edges = places(each), each.flatten()
    whole = np.diff(edge_at) >= 2
    value, known = numbers(edges), pc.is_valid(edges).to_numpy(zero_copy_only=False)
    place = np.where(whole, edge_at[:-1], len(value))
    value, known = np.append(value, (0, 0)), np.append(known, (False, False))
    left, right, has_left, has_right = value[place], value[place + 1], known[place], known[place + 1]
    length = length[held]
    first = np.zeros(len(held), bool)
    first[(np.cumsum(n[fits]) - n[fits])[n[fits] > 0]] = True
    size = length + (~first & np.append(False, has_right[:-1])[: len(held)])
    start = np.cumsum(size) - size
    k = ragged(np.zeros(len(length), np.int64), length)
    char = np.repeat(start + size - length, length) + k
    x0, x1 = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
    no0, no1 = np.zeros(len(x0), bool), np.zeros(len(x0), bool)
    from_, one = np.repeat(left.astype(float), length), np.repeat((right - left) / np.maximum(length, 1), length)
    x0[char], x1[char] = np.rint(from_ + k * one).astype(np.int64), np.rint(from_ + (k + 1) * one).astype(np.int64)
    no0[char] = no1[char] = np.repeat(~(has_left & has_right), length)
    space = np.flatnonzero(size > length)
    x0[start[space]], x1[start[space]] = right[space - 1], left[space]
    no1[start[space]] = ~has_left[space]
    spans = pa.StructArray.from_arrays([pa.array(x0, mask=no0), pa.array(x1, mask=no1)], ["x0", "x1"])
    many = np.zeros(len(n), np.int64)
    many[fits] = totals(size, np.append(0, np.cumsum(n[fits])))
    bounds = np.append(0, np.cumsum(many)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(~fits, False)), spans)


#: Words of lines that are cut into windows at once; a longer line alone, whole.
WORDS_AT_ONCE = 1 << 16


def _list(size: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), values)


def windows(lines: pa.RecordBatch, runs: tuple[int, ...]) -> pa.RecordBatch:
    """The windows of every ``run`` neighbouring words (0: the whole line) of lines as cases, with the lines' other columns.

    Windows with overlapping words or words without a box are no cases."""
    words = lines.column("words")
    at, flat = places(words), words.flatten()
    text = flat.field("text").cast(pa.string())
    known = pc.and_(pc.is_valid(flat.field("hpos")), pc.is_valid(flat.field("width"))).to_numpy(zero_copy_only=False)
    hpos, wide = numbers(flat.field("hpos")), numbers(flat.field("width"))
    n, row, run, first, size = np.diff(at), [], [], [], []
    for r in runs:
        many = np.maximum(n - r + 1, 0) if r else (n > 0).astype(np.int64)
        own = np.repeat(np.arange(len(n)), many)
        row.append(own)
        run.append(np.full(len(own), r, np.int32))
        first.append(ragged(np.zeros(len(n), np.int64), many))
        size.append(np.full(len(own), r) if r else n[own])
    row, run, first, size = (np.concatenate(x) for x in (row, run, first, size))
    order = np.argsort(row, kind="stable")
    row, run, first, size = row[order], run[order], first[order], size[order]
    # A word that overlaps the one before it spoils the windows that hold both; one without a box those that hold it.
    overlaps = np.append(0, np.cumsum(np.append(False, hpos[1:] < hpos[:-1] + wide[:-1])[: len(hpos)]))
    unknown = np.append(0, np.cumsum(~known))
    start = at[row] + first
    good = (overlaps[start + size] == overlaps[start + 1]) & (unknown[start + size] == unknown[start])
    row, run, first, size, start = row[good], run[good], first[good], size[good], start[good]
    last, held = start + size - 1, ragged(start, size)
    between = ragged(start, size - 1)
    token = ragged(np.zeros(len(size), np.int64), 2 * size - 1)
    spelt = pa.concat_arrays([text, pa.array([" "])])
    source = np.full(len(token), len(text))
    source[token % 2 == 0] = held
    own = text.take(pa.array(held))
    length = numbers(pc.utf8_length(own))
    box = pa.StructArray.from_arrays([own, pa.array(hpos[held]), pa.array(wide[held])], ["text", "hpos", "width"])
    blanks = pa.StructArray.from_arrays([pa.array(hpos[between] + wide[between]), pa.array(hpos[between + 1])], ["start", "end"])
    columns = {
        **{c: lines.column(c).take(pa.array(row)) for c in lines.schema.names if c != "words"}, "run": pa.array(run), "first": pa.array(first.astype(np.int32)), "words": _list(size, box),
        "source": pc.binary_join(_list(size, pc.fill_null(own, "")), ""), "tokens": _list(2 * size - 1, spelt.take(pa.array(source))), "gaps": _list(size - 1, blanks),
        "box_hpos": pa.array(hpos[start]), "box_width": pa.array(hpos[last] + wide[last] - hpos[start]), "n_chars": pa.array(totals(length, np.append(0, np.cumsum(size))) + size - 1),
    }
    return pa.RecordBatch.from_pydict(columns)


def window_batches(runs: tuple[int, ...]):
    """:func:`windows` of batches of lines, some words at a time."""
    def run(batches):
        for batch in batches:
            ends, lo = places(batch.column("words"))[1:], 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS_AT_ONCE, "right")))
                yield windows(batch.slice(lo, hi - lo), runs)
                lo = hi

    return run


def error_counts(keys: tuple[str, ...]):
    """Cases (keys, unit, errors) of a batch counted by key and error, as :func:`pagewright.operators.scoring.report` adds them up."""
    def run(batches):
        for batch in batches:
            errors = batch.column("errors")
            # A case is counted with its first error; one without any (of them: null for a failure) has a row of its own.
            n = np.diff(places(errors))
            size = np.maximum(n, 1)
            row, value = np.repeat(np.arange(batch.num_rows), size), np.full(int(size.sum()), -1)
            once = np.append(0, np.cumsum(size))[:-1]
            value[np.repeat(n > 0, size)] = np.arange(int(n.sum()))
            e = errors.flatten().take(pa.array(value, mask=value < 0))
            unit = batch.column("unit").take(pa.array(row))
            chars = pc.if_else(pc.greater(unit, 0.0), pc.divide(e, unit), pa.scalar(None, pa.float64()))
            cases, failed = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            cases[once] = 1
            failed[once] = pc.is_null(errors).to_numpy(zero_copy_only=False)
            within = pc.fill_null(pc.less_equal(chars, 0.5), False).cast(pa.int64())
            table = pa.table({**{k: batch.column(k).take(pa.array(row)) for k in keys}, "e": e, "cases": cases, "failures": failed, "c": e, "sized": chars, "chars": chars, "within": within})
            count = table.group_by([*keys, "e"], use_threads=False).aggregate([("cases", "sum"), ("failures", "sum"), ("c", "count"), ("sized", "count"), ("chars", "sum"), ("within", "sum")])
            yield from count.rename_columns({"cases_sum": "cases", "failures_sum": "failures", "c_count": "c", "sized_count": "sized", "chars_sum": "chars", "within_sum": "within"}).combine_chunks().to_batches()

    return run


def spelt(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, places) of texts; null ones are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].tobytes() if raw is not None else b""
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), np.append(0, np.cumsum(numbers(pc.utf8_length(texts))))


def listed(codes: np.ndarray, rule) -> np.ndarray:
    """Which code points a rule for one character holds for, asked once for each distinct one."""
    own, number = numbered(codes)
    return np.array([rule(chr(c)) for c in own.tolist()], bool)[number] if len(own) else np.zeros(0, bool)


class Aligned:
    """Readings of a batch of rows, aligned with the text of the rows' tokens, all rows together: ``support`` (what the reading accounts
    for), ``why`` (a reason for which there can be no boxes, or None), and boxes for the rows without one.

    ``unread`` are rows that have no reading."""

    def __init__(self, codes: np.ndarray, code_at: np.ndarray, unread: np.ndarray, edges: np.ndarray, span_at: np.ndarray, tokens: pa.Array, hpos: np.ndarray, width: np.ndarray):
        self.token_at, self.hpos, self.width = places(tokens), hpos, width
        self.n = np.diff(self.token_at)
        self.letters, self.letter_at = spelt(tokens.flatten())
        self.target_at = self.letter_at[self.token_at]
        size = np.diff(self.target_at)
        row, i, j, n = many_blocks(fold_codes(codes), code_at, fold_codes(self.letters), self.target_at)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.support = np.where(size > 0, np.bincount(row, n, len(size)) / size, 0.0)
        differs, narrow = np.diff(code_at) != np.diff(span_at), width < self.n
        self.why = np.where(unread, "missing line", np.where(differs, "text and spans differ", np.where(narrow, "impossible request", None)))
        held = np.equal(self.why[row], None)
        self.known = np.zeros(len(self.letters), bool)
        self.lo, self.hi = np.zeros(len(self.letters)), np.zeros(len(self.letters))
        to, from_ = ragged((self.target_at[row] + j)[held], n[held]), ragged((span_at[row] + i)[held], n[held])
        self.known[to], self.lo[to], self.hi[to] = True, edges[from_, 0], edges[from_, 1]

    def edges(self, weight: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:func:`pagewright.functions.kernels.char_edges` of rows, from the weights of their characters."""
        size = np.diff(self.target_at)[rows]
        at, place = np.append(0, np.cumsum(size)), ragged(self.target_at[:-1][rows], size)
        known, lo, hi = self.known[place], self.lo[place], self.hi[place]
        left, right = np.repeat(self.hpos[rows].astype(float), size), np.repeat((self.hpos + self.width)[rows].astype(float), size)
        if known.all():
            return lo, hi
        begin, end, here = np.repeat(at[:-1], size), np.repeat(at[1:], size), np.arange(len(place))
        upto = running(weight, at)
        so_far = np.where(here == begin, 0.0, np.append(0.0, upto[:-1]))
        before_ = np.maximum.accumulate(np.where(known, here, -1))
        after = np.minimum.accumulate(np.where(known, here, len(here))[::-1])[::-1]
        has, more = before_ >= begin, after < end
        from_x = np.where(has, hi[before_], left)
        to_x = np.maximum(from_x, np.where(more, lo[np.minimum(after, len(here) - 1)], right))
        base = np.where(has, upto[before_], 0.0)
        step = (to_x - from_x) / np.where(known, 1.0, np.where(more, so_far[np.minimum(after, len(here) - 1)], upto[end - 1]) - base)
        return np.where(known, lo, from_x + (so_far - base) * step), np.where(known, hi, from_x + (upto - base) * step)

    def boxes(self, rows: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the tokens of rows, left edges, widths) in whole pixels, by weights of the rows' characters (none: all alike)."""
        n = self.n[rows]
        place, at = ragged(self.token_at[:-1][rows], n), np.append(0, np.cumsum(n))
        size = np.diff(self.letter_at)[place]
        letters = ragged(self.letter_at[:-1][place], size)
        lo, hi = self.edges(np.ones(len(letters)) if weight is None else weight, rows)
        # Words cover their characters, blanks what lies between words; of neighbouring blanks the first takes all the room.
        a, b, some = np.full(len(place), np.inf), np.full(len(place), -np.inf), size > 0
        starts = (np.cumsum(size) - size)[some]
        if len(starts):
            a[some], b[some] = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
        word = totals((~listed(self.letters, str.isspace))[letters].astype(np.int64), np.append(0, np.cumsum(size))) > 0
        begin, end, here = np.repeat(at[:-1], n), np.repeat(at[1:], n), np.arange(len(place))
        left, right = np.repeat(self.hpos[rows], n), np.repeat((self.hpos + self.width)[rows], n)
        last = np.maximum.accumulate(np.where(word, here, -1))
        following = np.minimum.accumulate(np.where(word, here, len(here))[::-1])[::-1]
        start = np.where(last >= begin, b[last] if len(b) else b, left)
        stop = np.maximum(start, np.where(following < end, a[np.minimum(following, len(here) - 1)] if len(a) else a, right))
        first = here == np.maximum(last, begin - 1) + 1
        lo, hi = np.where(word, a, np.where(first, start, stop)), np.where(word, b, stop)
        # Whole pixels, as whole_pixels of the kernels gives them; rows lie apart, so one running maximum serves all.
        nth, behind = here - begin, end - here
        edges = np.stack([np.minimum(np.rint(lo), right - behind) - nth, np.minimum(np.rint(hi), right - behind + 1) - nth - 1], 1)
        edges = (np.maximum(edges, left[:, None]) - left[:, None]).astype(np.int64)
        apart = (np.repeat(np.arange(len(n)), n) * (int(self.width.max(initial=0)) + 1))[:, None]
        edges = np.maximum.accumulate((edges + apart).ravel()).reshape(-1, 2) - apart + left[:, None]
        x, end_ = edges[:, 0] + nth, edges[:, 1] + nth + 1
        return place, x, end_ - x

    def weights(self, rows: np.ndarray, glyphs: pa.Array) -> np.ndarray:
        """The weights of the rows' characters by a map of letter widths for each row; letters that it lacks, and all without a map, weigh 1."""
        if pa.types.is_map(glyphs.type):
            glyphs = glyphs.cast(_MAP)
        at = places(glyphs)
        keys, values = (glyphs.flatten().field(k) for k in (0, 1))
        one = pc.equal(pc.utf8_length(keys), 1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(rows)), np.diff(at))[one]
        held = owner * (1 << 21) + spelt(keys.filter(pa.array(one)))[0]
        order = np.argsort(held, kind="stable")
        held, own = held[order], numbers(values, float)[one][order]
        size = np.diff(self.target_at)[rows]
        asked = np.repeat(np.arange(len(rows)), size) * (1 << 21) + fold_codes(self.letters)[ragged(self.target_at[:-1][rows], size)]
        place = np.minimum(np.searchsorted(held, asked), max(len(held) - 1, 0))
        return np.where(held[place] == asked, np.maximum(LEAST_WEIGHT, own[place]), 1.0) if len(held) else np.ones(len(asked))


def aligned_rows(read: pa.Array, spans: pa.Array, tokens: pa.Array, hpos: np.ndarray, width: np.ndarray) -> Aligned:
    """:class:`Aligned` of readings that are texts with spans (x0, x1)."""
    flat = spans.flatten()
    edges = np.stack([numbers(flat.field("x0"), float), numbers(flat.field("x1"), float)], 1)
    return Aligned(*spelt(read), pc.is_null(read).to_numpy(zero_copy_only=False), edges, places(spans), tokens, hpos, width)


@F.arrow_udf(ALIGNED)
def aligned_of(read: pa.Array, spans: pa.Array, tokens: pa.Array, hpos: pa.Array, width: pa.Array, arms: pa.Array) -> pa.Array:
    """What a reading accounts for of the tokens' text, and for each of ``arms`` (letter widths; null: none) the tokens' boxes from
    its spans or a reason.  A text is aligned once, whatever is asked of it; null readings give null."""
    got = aligned_rows(read, spans, tokens, numbers(hpos), numbers(width))
    arm_at, glyphs, texts = places(arms), arms.flatten(), tokens.flatten()
    many = np.diff(arm_at)
    row = np.repeat(np.arange(len(many)), many)
    good = np.equal(got.why[row], None)
    plain = pc.is_null(glyphs).to_numpy(zero_copy_only=False)
    taken = np.where(good, got.n[row], 0)
    bounds = np.append(0, np.cumsum(taken))
    place, x, w = (np.zeros(int(bounds[-1]), np.int64) for _ in range(3))
    for which in (good & plain, good & ~plain):
        some = np.flatnonzero(which)
        if len(some):
            to = ragged(bounds[:-1][some], taken[some])
            place[to], x[to], w[to] = got.boxes(row[some], None if plain[some[0]] else got.weights(row[some], glyphs.take(pa.array(some))))
    boxes = pa.StructArray.from_arrays([texts.cast(pa.string()).take(pa.array(place)), pa.array(x), pa.array(w)], ["text", "hpos", "width"])
    each = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(~good, False)), boxes), pa.array(got.why[row], pa.string())], ["boxes", "error"])
    return pa.StructArray.from_arrays([pa.array(got.support, mask=pc.is_null(read).to_numpy(zero_copy_only=False)), _list(many, each)], ["support", "arms"])


def advance_counts(by: tuple[str, ...]):
    """Lines (by, text, spans) to counts (by, glyph, advance, n): each character's distance to the next one's start, the last one's to
    its own end, against the median of those of its line that aren't 0."""
    def run(batches):
        for batch in batches:
            spans, texts = batch.column("spans"), pc.fill_null(batch.column("text"), "").to_pylist()
            at, flat = places(spans), spans.flatten()
            x0, x1 = numbers(flat.field("x0")), numbers(flat.field("x1"))
            size = np.minimum(np.diff(at), [len(t) for t in texts])
            held = ragged(at[:-1], size)
            last = at[:-1][size > 0] + size[size > 0] - 1
            step = np.append(x0[1:], 0)[: len(x0)] - x0
            step[last] = x1[last] - x0[last]
            row, letters, step = np.repeat(np.arange(len(size)), size), np.array(list(fold("".join(t[:n] for t, n in zip(texts, size))))), step[held]
            known = step > 0
            row, letters, step = row[known], letters[known], step[known]
            if not len(step):
                continue
            # The median of each line from its sorted steps.
            ordered = step[np.lexsort((step, row))]
            n = np.bincount(row, minlength=len(size))
            start = np.cumsum(n) - n
            some = n > 0
            middle = np.ones(len(size))
            middle[some] = (ordered[start[some] + (n[some] - 1) // 2] + ordered[start[some] + n[some] // 2]) / 2
            table = pa.table({**{k: batch.column(k).take(pa.array(row)) for k in by}, "glyph": pa.array(letters), "advance": step / middle[row], "n": step})
            count = table.group_by([*by, "glyph", "advance"], use_threads=False).aggregate([("n", "count")])
            yield from count.rename_columns({"n_count": "n"}).combine_chunks().to_batches()

    return run
