"""Whole files in the worker that they were dealt out to: lines by files, letter widths learned from them, and reports by these widths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.alignment import fold_codes
from ..functions.arrays import Aligned, SPACE, error_counts, numbers, places, ragged, running, spelt
from ..functions.kernels import LEAST_WEIGHT
from ..functions.requests import LEAST_SUPPORT, Requests, requests_of
from .widths import fit_letters

def _numbered(values: pa.Array) -> np.ndarray:
    """Numbers that are equal where values are; null is a value."""
    return values.dictionary_encode("encode").indices.to_numpy()


def models_of(lines: pa.RecordBatch, group: np.ndarray) -> dict[int, tuple]:
    """(letters, widths, constant, space, unit) for each group of lines that has one, learned on the lines of the same page's other parity."""
    words, word_at = lines.column("words").flatten(), places(lines.column("words"))
    wide, left = numbers(words.field("width")), numbers(words.field("hpos"))
    codes, at = spelt(words.field("text"))
    codes, out = fold_codes(codes), {}
    order = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)[: len(order)]).tolist()
    for lo, hi in zip(bounds, [*bounds[1:], len(order)]):
        rows = order[lo:hi]
        n = word_at[rows + 1] - word_at[rows]
        word, blank = ragged(word_at[rows], n), ragged(word_at[rows] + 1, n - 1)
        size = at[word + 1] - at[word]
        out[int(group[rows[0]]) ^ 1] = fit_letters(codes[ragged(at[word], size)], size, wide[word].astype(float), (left[blank] - left[blank - 1] - wide[blank - 1]).astype(float))
    return out


def parity_groups(lines: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Lines in order of page and line, and twice the number of each one's page, plus its parity there."""
    page = _numbered(lines.column("corpus")).astype(np.int64) * (lines.num_rows + 1) + _numbered(lines.column("file"))
    order = np.lexsort((lines.column("line_ord").to_numpy(), page))
    lines, page = lines.take(pa.array(order)), page[order]
    start = np.append(True, page[1:] != page[:-1])[: len(page)]
    nth = np.arange(len(page)) - np.maximum.accumulate(np.where(start, np.arange(len(page)), 0))
    return lines, 2 * (np.cumsum(start) - 1) + nth % 2


class Glyphs:
    """Widths of letters by groups: sorted numbers of group and letter, and a width for each."""

    def __init__(self, group: np.ndarray, letter: np.ndarray, width: np.ndarray):
        key = group * (1 << 21) + letter
        order = np.argsort(key, kind="stable")
        self.key, self.width = key[order], width[order]

    def of(self, group: np.ndarray, letter: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
        if not len(self.key):
            return np.broadcast_to(np.asarray(otherwise, float), group.shape).copy()
        asked = group * (1 << 21) + letter
        place = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        return np.where(self.key[place] == asked, self.width[place], otherwise)


def _held(models: dict[int, tuple]) -> Glyphs:
    every = [(np.full(len(m[0]), g), m[0], m[1]) for g, m in models.items()]
    return Glyphs(*(np.concatenate([np.zeros(0, kind), *(x[k] for x in every)]) for k, kind in enumerate((np.int64, np.int64, float))))


def relative(models: dict[int, tuple]) -> Glyphs:
    """:func:`pagewright.operators.readings.relative`: letters against the upper median letter, the space among them."""
    out = {}
    for g, (letters, widths, _, space, unit) in models.items():
        middle = np.sort(widths)[len(widths) // 2] if len(widths) else unit
        scale, own = middle if middle > 0 else 1.0, letters != ord(" ")
        out[g] = np.append(letters[own], ord(" ")), np.append(widths[own], space) / scale
    return _held(out)


def advances(file: np.ndarray, codes: np.ndarray, at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(file, letter, advance) of lines' characters: the distance to the next one's start, the last one's to its own end, against the
    median of those of its line that aren't 0."""
    size = np.diff(at)
    row, last = np.repeat(np.arange(len(size)), size), at[1:][size > 0] - 1
    step = np.append(edges[1:, 0], 0)[: len(edges)] - edges[:, 0]
    step[last] = edges[last, 1] - edges[last, 0]
    known = step > 0
    row, letters, step = row[known], codes[known].astype(np.int64), step[known]
    ordered, n = step[np.lexsort((step, row))], np.bincount(row, minlength=len(size))
    start, some, middle = np.cumsum(n) - n, n > 0, np.ones(len(size))
    middle[some] = (ordered[start[some] + (n[some] - 1) // 2] + ordered[start[some] + n[some] // 2]) / 2
    return file[row], letters, step / middle[row]


def median_advances(file: np.ndarray, letter: np.ndarray, advance: np.ndarray) -> Glyphs:
    """The median advance of each letter of a file (numbers), the mean of both in the middle of an even number."""
    order = np.lexsort((advance, letter, file))
    file, letter, advance = file[order], letter[order], advance[order]
    start = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (letter[1:] != letter[:-1]))[: len(file)])
    n = np.diff(np.append(start, len(file)))
    lo, hi = advance[start + (n - 1) // 2], advance[start + n // 2]
    return Glyphs(file[start], letter[start], np.where(lo == hi, lo, 0.5 * lo + 0.5 * hi))


def learned(r: Requests, group: np.ndarray, models: dict[int, tuple]) -> pa.Array:
    """Errors of requests laid out by the widths of their groups' models; those without one fail."""
    known = np.array([g in models for g in group.tolist()], bool)
    constant, space, unit = (np.array([models[g][k] if g in models else 0.0 for g in group.tolist()]) for k in (2, 3, 4))
    texts = r.tokens.flatten()
    codes, at = spelt(texts)
    size, n = np.diff(at), np.diff(r.at)
    row = np.repeat(np.arange(len(n)), n)
    letter_row = np.repeat(row, size)
    sums = running(_held(models).of(group[letter_row], fold_codes(codes).astype(np.int64), unit[letter_row]), at)
    total = np.zeros(len(size))
    total[size > 0] = sums[at[1:][size > 0] - 1]
    blank = pc.fill_null(pc.match_substring_regex(texts, SPACE), False).to_numpy(zero_copy_only=False)
    x, w = r.laid_out("distributed", np.where(blank, size * space[row], constant[row] + total))
    return r.errors(x, w, known)


def learned_counts(lines: pa.RecordBatch):
    """Counts of errors by corpus of lines of whole files, laid out by their page's letter widths; see
    :func:`pagewright.operators.widths.resolve_learned`."""
    lines = lines.filter(pc.and_(pc.is_valid(lines.column("corpus")), pc.is_valid(lines.column("file"))))
    lines, group = parity_groups(lines)
    models = models_of(lines, group)
    for r in requests_of(lines.append_column("group", pa.array(group))):
        yield from error_counts(("corpus",))([r.scored(learned(r, numbers(r.cases.column("group")), models))])


def moved_counts(lines: pa.RecordBatch):
    """Counts by corpus and arm of boundaries of lines of whole files: how many move, how many there are, and sums of their errors, when
    what three of every seventeen characters were not read is filled by letter widths."""
    lines, group = parity_groups(lines)
    models, number = models_of(lines, group), _numbered(lines.column("file"))
    known = pc.and_(pc.is_valid(lines.column("corpus")), pc.is_valid(lines.column("file"))).to_numpy(zero_copy_only=False)
    group = np.where(known, group, -1)  # what has no page has no model
    read, seen = [], []
    for r in requests_of(lines.append_column("group", pa.array(group)).append_column("number", pa.array(number.astype(np.int64)))):
        _, codes, at, edges = r.cuts()
        keep, kept_at = r.kept(codes, at, lambda k: k >= 3)
        read.append((r, codes[keep], kept_at, edges[keep]))
        seen.append(advances(np.where(r.known, numbers(r.cases.column("number")), -1), fold_codes(codes[keep]), kept_at, edges[keep]))
    if not read:
        return
    file, letter, advance = (np.concatenate(x) for x in zip(*seen))
    own, other = median_advances(file[file >= 0], letter[file >= 0], advance[file >= 0]), relative(models)
    for r, codes, at, edges in read:
        got = Aligned(codes, at, np.zeros(len(r), bool), edges, at, r.tokens, r.hpos, r.width)
        good = np.equal(got.why, None) & (got.support >= LEAST_SUPPORT)
        rows = np.flatnonzero(good)
        size = np.diff(got.target_at)[rows]
        letters = fold_codes(got.letters[ragged(got.target_at[:-1][rows], size)]).astype(np.int64)
        errors, corpus = {}, r.cases.column("corpus")
        for arm, glyphs, column in (("plain", None, None), ("cut_widths", own, "number"), ("box_widths", other, "group")):
            weight = None if glyphs is None else np.maximum(LEAST_WEIGHT, glyphs.of(np.repeat(numbers(r.cases.column(column))[rows], size), letters, 1.0))
            x, w = (np.zeros(int(r.at[-1]), np.int64) for _ in range(2))
            place, own_x, own_w = got.boxes(rows, weight)
            x[place], w[place] = own_x, own_w
            errors[arm] = r.errors(x, w, good)
        whose = pa.array(np.repeat(np.arange(len(r)), np.diff(places(errors["plain"]))))
        base = errors["plain"].flatten().to_numpy()
        for arm in ("cut_widths", "box_widths"):
            e = errors[arm].flatten().to_numpy()
            table = pa.table({"corpus": corpus.take(whose), "moved": (np.abs(base - e) > 1e-9).astype(np.int64), "boundaries": np.ones(len(e), np.int64), "base": base, "own": e})
            sums = table.group_by(["corpus"], use_threads=False).aggregate([(c, "sum") for c in ("moved", "boundaries", "base", "own")])
            sums = sums.rename_columns({f"{c}_sum": c for c in ("moved", "boundaries", "base", "own")}).append_column("arm", pa.array([arm] * sums.num_rows, pa.string()))
            yield from sums.combine_chunks().to_batches()
