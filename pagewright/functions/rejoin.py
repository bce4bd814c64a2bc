"""Words of a page as one stream, words broken at line ends joined, and corrected words put back on their lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import stretches_of
from .arrays import places, ragged
from .kernels import opcodes

#: Words of pages that are aligned at once; a longer page alone, whole.
PAGES_AT_ONCE = 1 << 14

#: The characters that break a word at a line end.
HYPHENS = "-¬‐‑­"
#: A word with the line it begins on; for a joined one also the line of its tail (else -1), the length of its head, and the
#: visible hyphen that the head had.
OWNER = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("tail_line", T.IntegerType()),
    T.StructField("cut", T.IntegerType()), T.StructField("mark", T.StringType()),
])

_OWNERS = pa.list_(pa.struct([("word", pa.string()), ("line", pa.int32()), ("tail_line", pa.int32()), ("cut", pa.int32()), ("mark", pa.string())]))


def linearised(lines: list[str], hyphened: list[bool]) -> list[tuple]:
    """(word, line, tail line, cut, mark) of a page's words in order; the last three are -1, 0 and empty for whole words.

    A line is broken if it is marked as ``hyphened`` or ends with a hyphen, has a word of its own to break, and isn't the
    last.  The tail is what the next line has up to its first space; a line that is only a tail breaks no further."""
    out, head = [], None
    for i, text in enumerate(lines):
        rest = text
        if head is not None:
            tail, _, rest = text.partition(" ")
            word, at, mark = head
            out.append((word + tail, at, i, len(word), mark))
            head = None
        own = rest.split()
        if own and i + 1 < len(lines) and (hyphened[i] or rest.rstrip()[-1] in HYPHENS):
            last = own.pop()
            bare = last.rstrip(HYPHENS)
            head = bare, i, last[len(bare) :]
        out += [(word, i, -1, 0, "") for word in own]
    return out


def edits(pages: list[tuple[list[str], list[str]]]):
    """For each pair of lists of words the stretches (from, to in the first; from, to in the second) by which they are aligned; a word
    counts as one letter."""
    number: dict[str, int] = {}
    sides = []
    for k in (0, 1):
        codes = np.array([number.setdefault(w, len(number)) for page in pages for w in page[k]], np.int64)
        sides += [codes, np.append(0, np.cumsum([len(page[k]) for page in pages])).astype(np.int64)]
    return stretches_of(*sides)


def resplit(word: str, head: str, tail: str) -> int:
    """Where a corrected word is cut that was ``head`` and ``tail`` before: by the first stretch of their alignment that covers
    the old cut."""
    for i, i_end, j, j_end in opcodes(head + tail, word):
        if i_end >= len(head):
            return j + min(len(head) - i, j_end - j)
    return min(len(head), len(word))


def put_back(corrected: list[str], owners: list[tuple], n_lines: int, stretches: np.ndarray | None = None) -> list[str]:
    """The text of every line after its words were corrected; ``stretches`` are those of :func:`edits`, if they are known.

    Each corrected word goes where the source word at its place in the alignment is from; words beyond a stretch's source
    words go with its last one, words inserted where nothing was with the one behind (at the end: before).  Without any
    source word there is no line to put words on."""
    lines: list[list[str]] = [[] for _ in range(n_lines)]
    if not owners:
        return [""] * n_lines
    place = np.zeros(len(corrected), np.int64)
    if stretches is None:
        (stretches,) = edits([([o[0] for o in owners], corrected)])
    i, i_end, j, j_end = stretches.T
    size = j_end - j
    place[ragged(j, size)] = np.minimum(ragged(i, size), np.repeat(np.maximum(i, i_end - 1), size))
    for word, k in zip(corrected, np.minimum(place, len(owners) - 1).tolist()):
        whole, line, tail_line, cut, mark = owners[k]
        if tail_line < 0:
            lines[line].append(word)
            continue
        at = resplit(word, whole[:cut], whole[cut:])
        for part, to in ((word[:at] + mark, line), (word[at:], tail_line)):
            if part:
                lines[to].append(part)
    return [" ".join(own) for own in lines]


def _pages(made, kind: pa.DataType) -> pa.Array:
    """An array from one Python value a page: only a page's objects are held beside the compact arrays."""
    return pa.concat_arrays([pa.array([], kind), *(pa.array([x], kind) for x in made)])


@F.arrow_udf(T.ArrayType(OWNER))
def linearised_of(lines: pa.Array, hyphened: pa.Array) -> pa.Array:
    pages = zip(lines, hyphened)
    return _pages((linearised([t or "" for t in own.as_py()], [bool(x) for x in marks.as_py()]) if own.is_valid else None for own, marks in pages), _OWNERS)


@F.arrow_udf(T.ArrayType(T.StringType()))
def put_back_of(corrected: pa.Array, owners: pa.Array, n_lines: pa.Array) -> pa.Array:
    def made():
        at, flat = places(owners), owners.flatten()
        lo, n = 0, len(corrected)
        while lo < n:  # some pages are aligned together
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PAGES_AT_ONCE, "right")) - 1)
            whole = flat.slice(at[lo], at[hi] - at[lo]).field("word").to_pylist()
            words = corrected.slice(lo, hi - lo).to_pylist()
            aligned = edits([(whole[at[k] - at[lo] : at[k + 1] - at[lo]], own) for k, own in zip(range(lo, hi), words)])
            for k, own, stretches in zip(range(lo, hi), words, aligned):
                page = flat.slice(at[k], at[k + 1] - at[k])
                yield put_back(own, list(zip(*(page.field(c).to_pylist() for c in range(page.type.num_fields)))), n_lines[k].as_py(), stretches)
            lo = hi

    return _pages(made(), pa.list_(pa.string()))
